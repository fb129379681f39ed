"""Windows over each entity's history that see only earlier rows, and signals on price series.

All of them partition by the entity and order by time and row id, so Spark sorts each entity once and
several windows share the sort. A frame never includes the row itself unless the name says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _over(by, order):
    return W.partitionBy(*by).orderBy(*order)


def rolling_mean(df: DataFrame, by: list[str], order: list[str], value: str, w: int, out: str) -> DataFrame:
    """Mean of the w rows before; null on an entity's first row."""
    return df.withColumn(out, F.avg(value).over(_over(by, order).rowsBetween(-w, -1)))


def expanding_mean(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.avg(value).over(_over(by, order).rowsBetween(W.unboundedPreceding, -1)))


def rest_days(df: DataFrame, by: list[str], order: list[str], day: str, out: str, first: int = 3, cap: int = 7) -> DataFrame:
    gap = F.datediff(F.col(day), F.lag(day).over(_over(by, order)))
    return df.withColumn(out, F.least(F.coalesce(gap, F.lit(first)), F.lit(cap)))


def count_in_days(df: DataFrame, by: list[str], day: str, days: int, out: str) -> DataFrame:
    """Rows of the entity in the `days` days before this day, this day left out."""
    at = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    return df.withColumn(out, F.count("*").over(W.partitionBy(*by).orderBy(at).rangeBetween(-days, -1)))


def decayed_mean(df: DataFrame, by: list[str], order: list[str], value: str, w: int, decay: float, out: str) -> DataFrame:
    """Mean of the w values before, weighing (1 - decay) to the power of their distance; nulls are skipped before weighing."""
    seen = F.reverse(F.collect_list(value).over(_over(by, order).rowsBetween(-w, -1)))
    weights = F.transform(F.sequence(F.lit(0), F.size("_seen") - 1), lambda k: F.pow(F.lit(1 - decay), k))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(F.zip_with("_seen", "_weights", lambda x, k: x * k)) / total(F.col("_weights"))
    df = df.withColumn("_seen", seen).withColumn("_weights", F.when(F.size("_seen") > 0, weights))
    return df.withColumn(out, F.when(F.size("_seen") > 0, mean)).drop("_seen", "_weights")


def returns(prices: DataFrame, k: int = 1, out: str = "ret") -> DataFrame:
    """p / p k rows before - 1 over (ticker, d, px); null after a price of 0."""
    return prices.withColumn(out, F.try_divide("px", F.lag("px", k).over(_over(["ticker"], ["d"]))) - 1)


def compounded(ret: Column, frame=None) -> Column:
    """Product of 1 + ret over a group or a window frame, total losses and worse included; a null return counts as none."""
    over = lambda c: c if frame is None else c.over(frame)
    x = 1 + F.coalesce(ret, F.lit(0.0))
    size = F.exp(over(F.sum(F.when(x != 0, F.log(F.abs(x))).otherwise(0.0))))
    sign = F.when(over(F.sum((x < 0).cast("int"))) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(over(F.max((x == 0).cast("int"))) == 1, 0.0).otherwise(sign * size)


def growth(rets: DataFrame, out: str = "cum") -> DataFrame:
    """Compounded growth up to and with each row; a null return counts as none, and nothing grows after a total loss."""
    return rets.withColumn(out, compounded(F.col("ret"), _over(["ticker"], ["d"]).rowsBetween(W.unboundedPreceding, 0)))


def above_mean(prices: DataFrame, w: int, out: str) -> DataFrame:
    """1 where the price is above the mean of the last w rows, itself among them; null until there are w."""
    o = _over(["ticker"], ["d"])
    full = F.count("px").over(o.rowsBetween(1 - w, 0)) == w
    return prices.withColumn(out, F.when(full, (F.col("px") > F.avg("px").over(o.rowsBetween(1 - w, 0))).cast("int")))


def turn_of_month(days: DataFrame, n: int = 3, out: str = "turn") -> DataFrame:
    """1 on the first and last n trading days of a month."""
    month = W.partitionBy("ticker", F.trunc("d", "month"))
    near = (F.row_number().over(month.orderBy("d")) <= n) | (F.row_number().over(month.orderBy(F.desc("d"))) <= n)
    return days.withColumn(out, near.cast("int"))


def drawdown(levels: DataFrame, value: str = "cum", out: str = "dd") -> DataFrame:
    return levels.withColumn(out, F.try_divide(F.col(value), F.max(value).over(_over(["ticker"], ["d"]).rowsBetween(W.unboundedPreceding, 0))) - 1)


def longest_drawdown(levels: DataFrame) -> DataFrame:
    """(ticker, days) of the longest run below the peak, from (ticker, d, dd)."""
    island = F.sum((F.col("dd") >= 0).cast("int")).over(_over(["ticker"], ["d"]).rowsBetween(W.unboundedPreceding, 0))
    runs = levels.withColumn("island", island).where("dd < 0").groupBy("ticker", "island").agg(F.datediff(F.max("d"), F.min("d")).alias("days"))
    return runs.groupBy("ticker").agg(F.max("days").alias("days"))


def rolling_beta(pairs: DataFrame, w: int, out: str = "beta") -> DataFrame:
    """Slope of ret on bench over the w rows before (ticker, d, ret, bench); null until there are w, and on a flat benchmark."""
    frame = _over(["ticker"], ["d"]).rowsBetween(-w, -1)
    full = F.count("ret").over(frame) == w
    return pairs.withColumn(out, F.when(full, F.try_divide(F.covar_samp("ret", "bench").over(frame), F.var_samp("bench").over(frame))))


def hold_for_period(signal: DataFrame, value: str, period: str, out: str) -> DataFrame:
    """The value of the first day of each week or month, held through it."""
    o = W.partitionBy("ticker", F.date_trunc(period, "d")).orderBy("d").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return signal.withColumn(out, F.first(value).over(o))


def lagged(df: DataFrame, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.lag(value).over(_over(["ticker"], ["d"])))


def differentials(df: DataFrame, a: str, b: str, stats: list[str]) -> DataFrame:
    """diff_x = a_x - b_x for every stat that both sides have."""
    have = [x for x in stats if f"{a}{x}" in df.columns and f"{b}{x}" in df.columns]
    return df.select("*", *[(F.col(f"{a}{x}") - F.col(f"{b}{x}")).alias(f"diff_{x}") for x in have])


def days_since_epoch(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))
