"""The supplied tables in the shapes that the operators expect, in Spark and in SQL."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column, name: str, digits: int):
    """So many decimals, halves away from zero of the binary value, as DuckDB's round does it."""
    x = (column if isinstance(column, Column) else F.col(column)).cast("double") * 10.0**digits
    whole = F.when(x < 0, F.ceil(x - 0.5)).otherwise(F.floor(x + 0.5)).cast("double")
    return (F.when(F.abs(x) < 4.5e15, whole).otherwise(x) / 10.0**digits).alias(name)


def r6(column, name: str):
    return rounded(column, name, 6)


def r2(column, name: str):
    return rounded(column, name, 2)


def shared(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view whose text both engines read; {name} stands for a supplied table."""
    names = {n for _, n, _, _ in Formatter().parse(text) if n}
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def plain(text: str) -> str:
    """The same view for DuckDB, in brackets."""
    names = {n for _, n, _, _ in Formatter().parse(text) if n}
    return "(" + text.format(**{n: n for n in names}) + ")"


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, d, px): price per unit of each return flag and ship date."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("ticker"), F.to_date("l_shipdate").alias("d")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("px"))


PRICES = "(SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice) / sum(l_quantity) AS px FROM lineitem GROUP BY 1, 2)"
RETURNS = f"(SELECT ticker, d, px, px / lag(px) OVER (PARTITION BY ticker ORDER BY d) - 1 AS ret FROM {PRICES})"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props", F.to_date("ts").alias("d"))


EVENTS = "(SELECT event_id, ts, user_id, event_type, value, props, CAST(ts AS DATE) AS d FROM events)"


def moneylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ml_a, ml_b): American odds of two sides from part sizes, some of them invalid."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), (-(F.col("p_size") * 6.0 + 60)).alias("ml_a"), (F.col("p_size") * 5.0 + 70).alias("ml_b"))


MONEYLINES = "(SELECT p_partkey AS id, -(p_size * 6.0 + 60) AS ml_a, p_size * 5.0 + 70 AS ml_b FROM part)"


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, p, source, fair, odds): labels as outcomes, with a probability from the order of prices and quantities."""
    o = table(spark, sf_dir, "orders")
    p = F.least(F.greatest(F.col("o_totalprice") / 400000, F.lit(0.02)), F.lit(0.98))
    y = F.pmod(F.col("o_orderkey") * 7919, F.lit(100)) < p * 100
    fair = (F.pmod(F.col("o_orderkey"), F.lit(37)) + 1) / 40.0
    return o.select(F.col("o_orderkey").alias("id"), y.cast("int").alias("y"), p.alias("p"), F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("yr"), fair.alias("fair"), (1 / fair).alias("odds"), F.to_date("o_orderdate").alias("d"))


PROBABILITIES = """(SELECT o_orderkey AS id, CASE WHEN (o_orderkey * 7919) % 100 < p * 100 THEN 1 ELSE 0 END AS y, p, o_orderpriority AS grp,
 CAST(year(o_orderdate) AS INT) AS yr, (o_orderkey % 37 + 1) / 40.0 AS fair, 1 / ((o_orderkey % 37 + 1) / 40.0) AS odds, CAST(o_orderdate AS DATE) AS d
 FROM (SELECT *, least(greatest(o_totalprice / 400000, 0.02::DOUBLE), 0.98::DOUBLE) AS p FROM orders))"""


#: One row a game: two sides, scores, whether the ground is neutral.
GAMES_TEXT = """SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS INT) AS season, CAST(floor(o_custkey / 10) AS INT) AS home,
 CAST(floor(o_custkey / 10) + 1 + o_orderkey % 7 AS INT) AS away, CAST(floor(o_totalprice) % 61 + 70 AS INT) AS hs, CAST(floor(o_totalprice / 61) % 61 + 70 AS INT) AS vs, o_orderkey % 5 = 0 AS neutral FROM {orders}"""
GAMES = plain(GAMES_TEXT)
SIDES = f"""(SELECT game_id, d, season, home AS team, away AS opp, 1 AS is_home, hs AS pts, vs AS opp_pts, CASE WHEN hs > vs THEN 1.0 WHEN hs = vs THEN 0.5 ELSE 0.0 END AS won FROM {GAMES}
 UNION ALL SELECT game_id, d, season, away, home, 0, vs, hs, CASE WHEN vs > hs THEN 1.0 WHEN hs = vs THEN 0.5 ELSE 0.0 END FROM {GAMES})"""


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, GAMES_TEXT)


#: Price, volume and rows of each supplier and month.
MONTHLY_TEXT = """SELECT l_suppkey AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, sum(l_extendedprice) / sum(l_quantity) AS px, sum(l_quantity) AS volume,
 CAST(count(*) AS BIGINT) AS n, l_suppkey % 5 AS cls FROM {lineitem} GROUP BY l_suppkey, date_trunc('month', l_shipdate)"""
MONTHLY = plain(MONTHLY_TEXT)


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, MONTHLY_TEXT)


#: Daily returns of two series with a benchmark's.
PAIRS = f"(SELECT r.ticker, r.d, r.ret, b.ret AS bench FROM {RETURNS} r JOIN {RETURNS} b ON r.d = b.d AND b.ticker = 'N' WHERE r.ticker <> 'N' AND r.ret IS NOT NULL AND b.ret IS NOT NULL)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.history import returns

    rets = returns(prices(spark, sf_dir)).where("ret is not null").select("ticker", "d", "ret")
    bench = rets.where("ticker = 'N'").select("d", F.col("ret").alias("bench"))
    return rets.where("ticker <> 'N'").join(bench, "d").select("ticker", "d", "ret", "bench")
