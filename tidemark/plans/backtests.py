"""Registered queries of exposure rules, rotations, backtests, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import allocate, history
from ..sources import files
from ..sources.saved import shared_folder
from ..streaming import batches
from .queries import query
from .views import EVENTS, PRICES, RETURNS, events, prices, r6, table

BILL = 0.0001
_TREND = f"""(SELECT *, coalesce(lag(up) OVER (PARTITION BY ticker ORDER BY d), 0) AS e FROM (SELECT ticker, d, px, ret,
 CASE WHEN count(px) OVER w = 50 THEN CAST(px > avg(px) OVER w AS INT) END AS up FROM {RETURNS} WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)))"""
_MONTHS = f"(SELECT ticker, min(d) AS d, sum(px) / sum(sum(px)) OVER (PARTITION BY date_trunc('month', d)) AS w FROM {PRICES} GROUP BY ticker, date_trunc('month', d))"
#: Rebalances of two tickers in odd months and of all three in even ones, on the first of the month's days that any has.
_WEIGHTS = f"""(SELECT min(d) OVER (PARTITION BY date_trunc('month', d)) AS d, ticker, w FROM {_MONTHS} WHERE month(d) % 2 = 0 OR ticker <> 'N')"""


def _rets(spark, sf):
    return history.returns(prices(spark, sf))


def _weights(spark, sf):
    month = F.trunc("d", "month")
    px = prices(spark, sf).groupBy("ticker", month.alias("month")).agg(F.min("d").alias("d"), F.sum("px").alias("s")).where("month(month) % 2 = 0 or ticker <> 'N'")
    full = prices(spark, sf).groupBy(month.alias("month")).agg(F.sum("px").alias("t"))
    days = px.groupBy("month").agg(F.min("d").alias("d"))
    return px.drop("d").join(full, "month").join(days, "month").select("d", "ticker", (F.col("s") / F.col("t")).alias("w"))


@query(f"SELECT ticker, d, round(e * ret + (1 - e) * {BILL}, 6) AS ret FROM {_TREND} WHERE ret IS NOT NULL")
def t18_trend_exposure(spark, sf):
    df = allocate.trend(_rets(spark, sf), 50, "e").where("ret is not null")
    return df.select("ticker", "d", r6(allocate.exposed(F.col("e"), F.col("ret"), F.lit(BILL)), "ret"))


_VOL = f"""(SELECT *, coalesce(least(2.0, lag(v) OVER (PARTITION BY ticker ORDER BY d)), 0) AS e FROM (SELECT *, CASE WHEN count(ret) OVER w >= 31
 THEN 0.15 / greatest(stddev_samp(ret) OVER w * sqrt(252), 0.01) END AS v FROM {RETURNS} WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)))"""


@query(f"SELECT ticker, d, round(e, 6) AS e, round(e * ret + (1 - e) * {BILL} - greatest(e - 1, 0) * 50 / 10000.0 / 252, 6) AS ret FROM {_VOL} WHERE ret IS NOT NULL")
def t19_vol_target(spark, sf):
    df = allocate.vol_target(_rets(spark, sf), 63, 0.15, 2.0, "e").where("ret is not null")
    return df.select("ticker", "d", r6("e", "e"), r6(allocate.exposed(F.col("e"), F.col("ret"), F.lit(BILL), 50), "ret"))


@query(f"SELECT ticker, d, round((0.2 + 1.3 * e) * ret + (0.8 - 1.3 * e) * {BILL} - greatest(1.3 * e - 0.8, 0) * 50 / 10000.0 / 252, 6) AS ret FROM {_TREND} WHERE ret IS NOT NULL")
def t20_levered_trend(spark, sf):
    df = allocate.trend(_rets(spark, sf), 50, "e").where("ret is not null")
    return df.select("ticker", "d", r6(allocate.exposed(0.2 + 1.3 * F.col("e"), F.col("ret"), F.lit(BILL), 50), "ret"))


@query(f"SELECT d, round(coalesce(avg(CASE WHEN e > 0 THEN ret END), {BILL}), 6) AS ret FROM {_TREND} GROUP BY d")
def t23_trend_rotation(spark, sf):
    return allocate.trend_rotation(allocate.trend(_rets(spark, sf), 50, "e"), "e", BILL).select("d", r6("ret", "ret"))


@query(f"""SELECT d, round(avg(ret), 6) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY m DESC, ticker) AS k FROM (SELECT *, sum(ret) OVER w AS m, count(ret) OVER w AS n
 FROM {RETURNS} WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING)) WHERE n = 126) WHERE k <= 2 GROUP BY d""")
def t24_momentum_rotation(spark, sf):
    return allocate.momentum_rotation(_rets(spark, sf), 126, 2).select("d", r6("ret", "ret"))


@query(f"""WITH w AS (SELECT * FROM {_WEIGHTS}), n AS (SELECT d, lead(d) OVER (ORDER BY d) AS nd FROM (SELECT DISTINCT d FROM w)),
 m AS (SELECT d, ticker, w FROM w UNION ALL SELECT nd, ticker, -w FROM w JOIN n USING (d) WHERE nd IS NOT NULL)
 SELECT d, round(sum(abs(w) * CASE WHEN ticker = 'A' THEN 5.0 ELSE 12.0 END / 10000), 6) AS cost FROM (SELECT d, ticker, sum(w) AS w FROM m GROUP BY 1, 2) GROUP BY d""")
def t5_rebalance_costs(spark, sf):
    bps = F.when(F.col("ticker") == "A", 5.0).otherwise(12.0)
    return allocate.rebalance_costs(_weights(spark, sf), bps).select("d", r6("cost", "cost"))


@query(f"""SELECT d, round(sum(k * exp(s)) / sum(k * exp(s - l)) - 1, 6) AS ret FROM (SELECT d, k, l, sum(l) OVER (PARTITION BY ticker, year(d) ORDER BY d) AS s
 FROM (SELECT ticker, d, ln(1 + coalesce(ret, 0)) AS l, CASE WHEN ticker = 'A' THEN 0.6 ELSE 0.2 END AS k FROM {RETURNS})) GROUP BY d""")
def t27_drifting_mix(spark, sf):
    weight = F.when(F.col("ticker") == "A", 0.6).otherwise(0.2)
    return allocate.drifting_mix(_rets(spark, sf), weight, F.year("d")).select("d", r6("ret", "ret"))


@query(f"SELECT d, round(sum(ret * CASE WHEN ticker = 'A' THEN 0.5 ELSE 0.25 END), 6) AS ret FROM {RETURNS} WHERE ret IS NOT NULL GROUP BY d HAVING count(*) = 3")
def t34_blend(spark, sf):
    return allocate.blend(_rets(spark, sf), F.when(F.col("ticker") == "A", 0.5).otherwise(0.25), 3).select("d", r6("ret", "ret"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def s13_json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).where("k >= 50")


@query("""SELECT o_custkey, 'F' AS layer, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
 UNION ALL SELECT o_custkey, 'O', count(*) FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def s19_layered(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("layer"))
    got = files.layered(o.where("layer = 'F'"), o.where("layer = 'O'"), ["o_custkey"])
    return got.groupBy("o_custkey", "layer").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, user_id, d FROM {EVENTS} WHERE d = (SELECT max(d) FROM {EVENTS})")
def s8_newest_snapshot(spark, sf):
    return files.newest_snapshot(events(spark, sf).select("event_id", "user_id", "d"), "d")


def run_stream(spark, rows):
    """A stream worked off into the shared checkpoint folder."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return batches.run_once(rows, f"{base}/out", f"{base}/state")


@query("SELECT DISTINCT event_id, user_id, value FROM events")
def q1_stream_without_repeats(spark, sf):
    rows = batches.stream_of(spark, sf, "events.parquet").select("event_id", "ts", "user_id", "value")
    return run_stream(spark, batches.without_repeats(rows, ["event_id"], "ts")).select("event_id", "user_id", "value")


@query("""SELECT day, event_type, n, total FROM (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2),
 (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events) WHERE day + INTERVAL 1 DAY <= mark""")
def q2_stream_daily_totals(spark, sf):
    rows = batches.stream_of(spark, sf, "events.parquet").select("ts", "event_type", "value")
    got = run_stream(spark, batches.daily_totals(rows, "ts", "event_type", "value"))
    return got.select(F.to_date("day").alias("day"), "event_type", "n", r6("total", "total"))
