"""The registered queries of the library's own operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import asof, evaluate, history, portfolio
from .views import EVENTS, MONEYLINES, MONTHLY, PAIRS, PRICES, PROBABILITIES, RETURNS, events, moneylines, monthly, pairs, prices, probabilities, r6, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = re.sub(r'(?<!["\w])at(?!["\w])', '"at"', sql)  # a key word in expressions
        return f

    return add


_BY_USER = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
USER, TIME = ["user_id"], ["ts", "event_id"]


@query(f"SELECT event_id, round(avg(value) {_BY_USER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS m FROM {EVENTS}")
def w1_rolling_mean(spark, sf):
    return history.rolling_mean(events(spark, sf), USER, TIME, "value", 5, "m").select("event_id", r6("m", "m"))


@query(f"SELECT event_id, round(avg(value) {_BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS m FROM {EVENTS}")
def w2_expanding_mean(spark, sf):
    return history.expanding_mean(events(spark, sf), USER, TIME, "value", "m").select("event_id", r6("m", "m"))


@query(f"SELECT event_id, CAST(least(coalesce(date_diff('day', lag(d) {_BY_USER}), d), 3), 7) AS INT) AS rest FROM {EVENTS}")
def w3_rest_days(spark, sf):
    return history.rest_days(events(spark, sf), USER, TIME, "d", "rest").select("event_id", F.col("rest").cast("int"))


@query(f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS n FROM {EVENTS}")
def w5_rows_in_week(spark, sf):
    return history.count_in_days(events(spark, sf), USER, "d", 7, "n").select("event_id", "n")


_LAGS = [f"lag(value, {k}) {_BY_USER})" for k in range(1, 11)]


@query(
    f"SELECT event_id, round(({' + '.join(f'coalesce({x} * pow(0.9, {k}), 0)' for k, x in enumerate(_LAGS))}) / "
    f"nullif({' + '.join(f'CASE WHEN {x} IS NULL THEN 0 ELSE pow(0.9, {k}) END' for k, x in enumerate(_LAGS))}, 0), 6) AS m FROM {EVENTS}"
)
def w9_decayed_mean(spark, sf):
    return history.decayed_mean(events(spark, sf), USER, TIME, "value", 10, 0.1, "m").select("event_id", r6("m", "m"))


@query(f"SELECT ticker, d, round(ret, 6) AS ret FROM {RETURNS}")
def w25_returns(spark, sf):
    return history.returns(prices(spark, sf)).select("ticker", "d", r6("ret", "ret"))


@query(f"SELECT ticker, d, round(exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY ticker ORDER BY d)), 6) AS cum FROM {RETURNS}")
def w26_growth(spark, sf):
    return history.growth(history.returns(prices(spark, sf))).select("ticker", "d", r6("cum", "cum"))


def _sma(w: int) -> str:
    frame = f"OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(px) {frame} = {w} THEN CAST(px > avg(px) {frame} AS INT) END"


@query(f"SELECT ticker, d, {_sma(50)} AS up FROM {PRICES}")
def w27_above_mean(spark, sf):
    return history.above_mean(prices(spark, sf), 50, "up").select("ticker", "d", "up")


@query(f"SELECT ticker, d, round(({_sma(20)} + {_sma(50)} + {_sma(100)}) / 3.0, 6) AS share FROM {PRICES}")
def w28_vote_share(spark, sf):
    df = prices(spark, sf)
    for w in (20, 50, 100):
        df = history.above_mean(df, w, f"s{w}")
    return df.select("ticker", "d", r6((F.col("s20") + F.col("s50") + F.col("s100")) / 3.0, "share"))


@query(
    f"SELECT ticker, d, CAST(row_number() OVER (PARTITION BY ticker, date_trunc('month', d) ORDER BY d) <= 3 "
    f"OR row_number() OVER (PARTITION BY ticker, date_trunc('month', d) ORDER BY d DESC) <= 3 AS INT) AS turn FROM {PRICES}"
)
def w29_turn_of_month(spark, sf):
    return history.turn_of_month(prices(spark, sf)).select("ticker", "d", "turn")


_CUM = f"(SELECT ticker, d, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY ticker ORDER BY d)) AS cum FROM {RETURNS})"
_DD = f"(SELECT ticker, d, cum / max(cum) OVER (PARTITION BY ticker ORDER BY d) - 1 AS dd FROM {_CUM})"


@query(f"SELECT ticker, d, round(dd, 6) AS dd FROM {_DD}")
def w32_drawdown(spark, sf):
    return history.drawdown(history.growth(history.returns(prices(spark, sf)))).select("ticker", "d", r6("dd", "dd"))


@query(f"SELECT ticker, d, lag(CASE WHEN n = 126 THEN CAST(m > 0 AS INT) END) OVER (PARTITION BY ticker ORDER BY d) AS flag FROM (SELECT ticker, d, "
       f"sum(ret) OVER w AS m, count(ret) OVER w AS n FROM {RETURNS} WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 125 PRECEDING AND CURRENT ROW))")
def w33_momentum_flag(spark, sf):
    o = W.partitionBy("ticker").orderBy("d").rowsBetween(-125, 0)
    df = history.returns(prices(spark, sf))
    df = df.withColumn("f", F.when(F.count("ret").over(o) == 126, (F.sum("ret").over(o) > 0).cast("int")))
    return history.lagged(df, "f", "flag").select("ticker", "d", "flag")


_PAIRS = f"(SELECT r.ticker, r.d, r.ret, b.ret AS bench FROM {RETURNS} r JOIN {RETURNS} b ON r.d = b.d AND b.ticker = 'N' WHERE r.ticker <> 'N')"


def _pairs(spark, sf):
    rets = history.returns(prices(spark, sf)).select("ticker", "d", "ret")
    bench = rets.where("ticker = 'N'").select("d", F.col("ret").alias("bench"))
    return rets.where("ticker <> 'N'").join(bench, "d")


@query(f"SELECT ticker, d, round(CASE WHEN count(ret) OVER w = 60 THEN covar_samp(ret, bench) OVER w / var_samp(bench) OVER w END, 6) AS beta FROM {_PAIRS} "
       "WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)")
def w38_rolling_beta(spark, sf):
    return history.rolling_beta(_pairs(spark, sf), 60).select("ticker", "d", r6("beta", "beta"))


@query(f"SELECT ticker, d, first_value(up) OVER (PARTITION BY ticker, date_trunc('month', d) ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS held FROM (SELECT ticker, d, {_sma(50)} AS up FROM {PRICES})")
def w42_monthly_hold(spark, sf):
    return history.hold_for_period(history.above_mean(prices(spark, sf), 50, "up"), "up", "month", "held").select("ticker", "d", "held")


@query(f"SELECT ticker, max(days) AS days FROM (SELECT ticker, island, CAST(date_diff('day', min(d), max(d)) AS INT) AS days FROM (SELECT *, sum(CAST(dd >= 0 AS INT)) OVER (PARTITION BY ticker ORDER BY d) AS island FROM {_DD}) WHERE dd < 0 GROUP BY 1, 2) GROUP BY 1")
def w44_longest_drawdown(spark, sf):
    return history.longest_drawdown(history.drawdown(history.growth(history.returns(prices(spark, sf)))))


@query("SELECT a.o_orderkey, round(a.o_totalprice - b.p_retailprice, 6) AS diff_price FROM orders a JOIN part b ON b.p_partkey = a.o_orderkey % 200 + 1")
def p1_differentials(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("a_price"), (F.col("o_orderkey") % 200 + 1).alias("p_partkey"))
    both = a.join(table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("b_price")), "p_partkey")
    return history.differentials(both, "a_", "b_", ["price", "absent"]).select("o_orderkey", r6("diff_price", "diff_price"))


_DAILY = "(SELECT CAST(o_orderdate AS DATE) AS obs, avg(o_totalprice) AS v FROM orders GROUP BY 1)"


@query(f"SELECT s.d, s.ticker, round(f.v, 6) AS v FROM (SELECT DISTINCT ticker, date_trunc('month', d)::DATE AS d FROM {PRICES}) s ASOF LEFT JOIN (SELECT obs + 30 AS released, v FROM {_DAILY}) f ON s.d > f.released")
def j9_as_of_lagged(spark, sf):
    daily = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("obs")).agg(F.avg("o_totalprice").alias("v"))
    decisions = prices(spark, sf).select("ticker", F.trunc("d", "month").alias("d")).distinct()
    return asof.as_of_dates(decisions, asof.with_lag(daily, "obs", 30), "d", "released", ["v"]).select("d", "ticker", r6("v", "v"))


_MEMBERS = "(SELECT s_nationkey AS ticker, year(l_shipdate) AS yr, CAST(min(l_shipdate) AS DATE) AS start_date, CAST(max(l_shipdate) AS DATE) AS end_date FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


@query(f"SELECT DISTINCT d.d, m.ticker FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) d JOIN {_MEMBERS} m ON m.start_date <= d.d AND d.d < m.end_date")
def j12_members_as_of(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    members = li.groupBy(F.col("s_nationkey").alias("ticker"), F.year("l_shipdate").alias("yr")).agg(F.to_date(F.min("l_shipdate")).alias("start_date"), F.to_date(F.max("l_shipdate")).alias("end_date"))
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return asof.members_as_of(days, members, "d")


@query("""WITH f AS (SELECT o_custkey % 50 AS k, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end",
  CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH AS DATE) + CAST(20 + o_custkey % 40 AS INT) AS filed, sum(o_totalprice) AS val FROM orders GROUP BY 1, 2, 3),
 t AS (SELECT DISTINCT k, CAST(year || '-07-01' AS DATE) AS at FROM f, (SELECT DISTINCT year(o_orderdate) AS year FROM orders))
 SELECT t.k, t.at, f."end" AS period, round(max_by(val, filed), 4) AS val, max(filed) AS filed FROM t JOIN f ON t.k = f.k AND f.filed < t.at GROUP BY 1, 2, 3""")
def x1_latest_filed(spark, sf):
    o = table(spark, sf, "orders")
    quarter = F.add_months(F.trunc("o_orderdate", "quarter"), 3)
    filed = F.date_add(quarter, (20 + F.col("o_custkey") % 40).cast("int"))
    facts = o.groupBy((F.col("o_custkey") % 50).alias("k"), F.date_sub(quarter, 1).alias("end"), filed.alias("filed")).agg(F.sum("o_totalprice").alias("val"))
    years = o.select(F.to_date(F.concat(F.year("o_orderdate").cast("string"), F.lit("-07-01"))).alias("at")).distinct()
    decisions = facts.select("k").distinct().crossJoin(years)
    return asof.latest_filed(facts, decisions, ["k"], "at").select("k", "at", F.col("end").alias("period"), F.round("val", 4).alias("val"), "filed")


_DEC = "CASE WHEN {0} >= 100 THEN {0} / 100 + 1 WHEN {0} <= -100 THEN 100 / abs({0}) + 1 END"
_FAIR = f"(SELECT id, {_DEC.format('ml_a')} AS oa, {_DEC.format('ml_b')} AS ob FROM {MONEYLINES})"


@query(f"SELECT id, round(oa, 6) AS dec_a, round(ob, 6) AS dec_b, round(1 / oa, 6) AS imp_a FROM {_FAIR}")
def f1_decimal_odds(spark, sf):
    a, b = F.col("ml_a"), F.col("ml_b")
    return moneylines(spark, sf).select("id", r6(fn.decimal_odds(a), "dec_a"), r6(fn.decimal_odds(b), "dec_b"), r6(fn.implied(a), "imp_a"))


@query(f"SELECT id, round((1 / oa) / (1 / oa + 1 / ob), 6) AS p_a, round((1 / ob) / (1 / oa + 1 / ob), 6) AS p_b, round(1 / oa + 1 / ob - 1, 6) AS vig FROM {_FAIR}")
def f2_remove_margin(spark, sf):
    a, b, vig = fn.fair_pair(F.col("ml_a"), F.col("ml_b"))
    return moneylines(spark, sf).select("id", r6(a, "p_a"), r6(b, "p_b"), r6(vig, "vig"))


@query(f"SELECT id, round(k, 6) AS full_kelly, round(least(0.25 * k, 0.05), 6) AS stake FROM (SELECT id, greatest(0.0, ((odds - 1) * p - (1 - p)) / (odds - 1)) AS k FROM {PROBABILITIES})")
def f3_kelly(spark, sf):
    p, odds = F.col("p"), F.col("odds")
    return probabilities(spark, sf).select("id", r6(fn.kelly(p, odds), "full_kelly"), r6(fn.kelly_capped(p, odds), "stake"))


@query("SELECT p_partkey, round(1 / (1 + pow(10.0, -(p_retailprice - 1000) / 400)), 6) AS expected FROM part")
def f8_elo_expected(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r6(fn.elo_expected(F.col("p_retailprice") - 1000), "expected"))


@query("SELECT p_partkey, round(CASE p_size % 3 WHEN 0 THEN p_size + (p_partkey % 60) / 60.0 WHEN 1 THEN p_size + (p_partkey % 60) / 60.0 ELSE p_size END, 6) AS mins FROM part")
def f10_minutes(spark, sf):
    sec = (F.col("p_partkey") % 60).cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat_ws(":", "p_size", F.lpad(sec, 2, "0"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("PT"), "p_size", F.lit("M"), sec, F.lit("S"))).otherwise(F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", r6(fn.minutes(text), "mins"))


@query("SELECT c_custkey, round(2 * 6371.0 * asin(sqrt(pow(sin((radians(b) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin((radians(y) - radians(x)) / 2), 2))), 4) AS km "
       "FROM (SELECT c_custkey, c_custkey % 90 * 1.0 AS a, c_custkey % 180 * 1.0 AS b, -(c_nationkey * 3.0) AS x, c_nationkey * 7.0 AS y FROM customer)")
def f11_great_circle(spark, sf):
    c = table(spark, sf, "customer")
    km = fn.great_circle_km(F.col("c_custkey") % 90 * 1.0, -(F.col("c_nationkey") * 3.0), F.col("c_custkey") % 180 * 1.0, F.col("c_nationkey") * 7.0)
    return c.select("c_custkey", F.round(km, 4).alias("km"))


_KNOWN = {"north st": "north state college", "miami (fl)": "miami florida"}
_TEAM = r"CASE c_custkey % 5 WHEN 0 THEN '  North St ' WHEN 1 THEN 'St  John''s Univ' WHEN 2 THEN 'Houston Chr ' || c_nationkey WHEN 3 THEN 'Iowa  St' ELSE 'Miami (FL)' END"
_LOW = f"lower(trim({_TEAM}))"
_LONG = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_LOW}, '\s+', ' ', 'g'), '\bst\b$', 'state', 'g'), '\bst\b(\.*(?:[^.\s]|$))', 'st.\1', 'g'), '\buniv\b', 'university', 'g'), '\bchr\b', 'christian', 'g'))"


@query(f"SELECT c_custkey, CASE {_LOW} WHEN 'north st' THEN 'north state college' WHEN 'miami (fl)' THEN 'miami florida' ELSE {_LONG} END AS name FROM customer")
def f12_team_name(spark, sf):
    k = F.col("c_custkey") % 5
    raw = F.when(k == 0, "  North St ").when(k == 1, "St  John's Univ").when(k == 2, F.concat(F.lit("Houston Chr "), "c_nationkey")).when(k == 3, "Iowa  St").otherwise("Miami (FL)")
    return table(spark, sf, "customer").select("c_custkey", fn.team_name(raw, _KNOWN).alias("name"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 8000 THEN 'large' WHEN c_acctbal >= 4000 THEN 'mid' WHEN c_acctbal >= 0.01 THEN 'small' ELSE 'micro' END AS size FROM customer")
def f28_size_bucket(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fn.size_bucket(F.col("c_acctbal"), 8000, 4000, 0.01).alias("size"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)) / nullif(sum(l_quantity), 0), 6) AS unit, count(*) AS n FROM lineitem GROUP BY 1, 2")
def f29_ratio(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("a"), F.sum("l_quantity").alias("b"), F.count("*").alias("n"))
    return g.select("l_returnflag", "l_linestatus", r6(fn.ratio(F.col("a"), F.col("b")), "unit"), "n")


_LL = "-avg(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))"


@query(f"SELECT grp, count(*) AS n, round({_LL}, 6) AS log_loss, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(pow(p - y, 2)), 6) AS brier FROM {PROBABILITIES} GROUP BY 1")
def v1_binary_scores(spark, sf):
    s = evaluate.binary_scores(probabilities(spark, sf), ["grp"])
    return s.select("grp", "n", *[r6(c, c) for c in ("log_loss", "accuracy", "brier")])


@query(f"SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM {PROBABILITIES} GROUP BY 1")
def v3_calibration_bins(spark, sf):
    return evaluate.calibration_bins(probabilities(spark, sf)).select("bin", "n", r6("mean_p", "mean_p"), r6("mean_y", "mean_y"))


@query(f"SELECT count(*) AS bets, CAST(sum(y) AS BIGINT) AS wins, round(avg(CASE WHEN y = 1 THEN odds - 1 ELSE -1 END), 6) AS roi FROM {PROBABILITIES} WHERE p - fair >= 0.05")
def v4_flat_roi(spark, sf):
    return evaluate.flat_roi(probabilities(spark, sf)).select("bets", "wins", r6("roi", "roi"))


@query(f"SELECT grp, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg(pow(y - p, 2))), 6) AS rmse, round(quantile_cont(abs(y - p), 0.5), 6) AS median_ae FROM {PROBABILITIES} GROUP BY 1")
def v5_errors(spark, sf):
    return evaluate.errors(probabilities(spark, sf), ["grp"]).select("grp", *[r6(c, c) for c in ("mae", "rmse", "median_ae")])


@query(f"SELECT yr, grp, count(*) AS n, round({_LL}, 6) AS log_loss FROM {PROBABILITIES} GROUP BY GROUPING SETS ((yr), (grp), ()) HAVING count(*) >= 30")
def a10_score_slices(spark, sf):
    df = probabilities(spark, sf).groupingSets([["yr"], ["grp"], []], "yr", "grp").agg(F.count("*").alias("n"), r6(evaluate.log_loss(F.col("y"), F.col("p")), "log_loss"))
    return df.where("n >= 30")


@query(f"SELECT ticker, CAST(year(d) AS INT) AS yr, round(product(1 + ret) - 1, 6) AS ret FROM {RETURNS} WHERE ret IS NOT NULL GROUP BY 1, 2")
def a12_yearly_returns(spark, sf):
    df = history.returns(prices(spark, sf)).where("ret is not null")
    return df.groupBy("ticker", F.year("d").alias("yr")).agg(r6(history.compounded(F.col("ret")) - 1, "ret"))


@query(f"SELECT ticker, CAST(date_trunc('month', d) AS DATE) AS month, round(product(1 + ret) - 1, 6) AS ret FROM {RETURNS} WHERE ret IS NOT NULL GROUP BY 1, 2")
def a13_monthly_returns(spark, sf):
    df = history.returns(prices(spark, sf)).where("ret is not null")
    return df.groupBy("ticker", F.trunc("d", "month").alias("month")).agg(r6(history.compounded(F.col("ret")) - 1, "ret"))


@query(f"SELECT yr, n_train, n_test FROM (SELECT yr, count(*) AS n_test, CAST(coalesce(sum(count(*)) OVER (ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_train FROM {PROBABILITIES} GROUP BY yr) WHERE yr >= 1997 AND n_train >= 50")
def g12_walk_forward(spark, sf):
    return evaluate.walk_forward_folds(probabilities(spark, sf), "yr", 1997, 50)


@query(f"""WITH v AS (SELECT id, p, yr < 1998 AS tr FROM {PROBABILITIES}), k AS (SELECT p, sum(CASE WHEN tr THEN 1 ELSE 0 END) AS k FROM v GROUP BY p),
 c AS (SELECT p, coalesce(sum(k) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(k) OVER () AS r FROM k) SELECT id, round(r, 6) AS r FROM v JOIN c USING (p)""")
def g22_percentile_rank(spark, sf):
    return evaluate.percentile_rank(probabilities(spark, sf), F.col("yr") < 1998, "p", "r").select("id", r6("r", "r"))


_CUTS = ", ".join(f"{k / 10}" for k in range(1, 10))


@query(f"""WITH v AS (SELECT p, yr < 1998 AS tr FROM {PROBABILITIES}), c AS (SELECT quantile_cont(p, [{_CUTS}]) AS cuts FROM v WHERE tr),
 b AS (SELECT len(list_filter(list_distinct(cuts), lambda x: x <= p)) AS bin, sum(CASE WHEN tr THEN 1 ELSE 0 END) AS a, sum(CASE WHEN tr THEN 0 ELSE 1 END) AS b FROM v, c GROUP BY 1),
 s AS (SELECT greatest(a / sum(a) OVER (), 1e-6) AS a, greatest(b / sum(b) OVER (), 1e-6) AS b FROM b) SELECT round(sum((b - a) * ln(b / a)), 6) AS psi FROM s""")
def g24_population_stability(spark, sf):
    return evaluate.psi(probabilities(spark, sf), "p", F.col("yr") < 1998).select(r6("psi", "psi"))


@query(f"SELECT ticker, CAST(date_trunc('quarter', d) AS DATE) AS period, min(d) AS rebal FROM {PRICES} GROUP BY 1, 2")
def t1_rebalance_dates(spark, sf):
    return portfolio.rebalance_dates(prices(spark, sf), "quarter")


_VOL = f"(SELECT CAST(year(d) AS INT) AS yr, ticker, stddev_samp(ret) AS vol FROM {RETURNS} GROUP BY 1, 2)"
_IV = f"(SELECT yr, ticker, coalesce((1 / nullif(vol, 0)) / sum(1 / nullif(vol, 0)) OVER (PARTITION BY yr), 0) AS w FROM {_VOL})"


def _weights(spark, sf):
    vols = history.returns(prices(spark, sf)).groupBy(F.year("d").alias("yr"), "ticker").agg(F.stddev_samp("ret").alias("vol"))
    return portfolio.inverse_vol(vols, ["yr"])


@query(f"SELECT yr, ticker, round(w, 6) AS w FROM {_IV}")
def t10_inverse_vol(spark, sf):
    return _weights(spark, sf).select("yr", "ticker", r6("w", "w"))


_CLASSED = f"(SELECT d, cls, ticker, px / sum(px) OVER (PARTITION BY d) * 0.9 AS w FROM {MONTHLY})"
_CAPPED = f"(SELECT *, sum(w) OVER (PARTITION BY d) AS every, CASE WHEN sum(w) OVER (PARTITION BY d, cls) > 0.2 THEN w * 0.2 / sum(w) OVER (PARTITION BY d, cls) ELSE w END AS c FROM {_CLASSED})"


@query(f"SELECT d, ticker, round(c * every / sum(c) OVER (PARTITION BY d), 6) AS w FROM {_CAPPED}")
def t13_class_cap(spark, sf):
    weights = monthly(spark, sf).withColumn("w", F.col("px") / F.sum("px").over(W.partitionBy("d")) * 0.9)
    return portfolio.class_cap(weights, ["d"], "cls", 0.2).select("d", "ticker", r6("w", "w"))


@query(f"SELECT yr AS date, round(sum(abs(w - coalesce(pw, 0))) / 2, 6) AS turnover FROM (SELECT a.yr, a.ticker, a.w, b.w AS pw FROM {_IV} a LEFT JOIN {_IV} b ON b.yr = a.yr - 1 AND b.ticker = a.ticker) GROUP BY 1")
def t7_turnover(spark, sf):
    return portfolio.turnover(_weights(spark, sf).withColumnRenamed("yr", "date")).select("date", r6("turnover", "turnover"))


_LEVELS = f"(SELECT *, cum / max(cum) OVER (PARTITION BY ticker ORDER BY d) - 1 AS dd, row_number() OVER (PARTITION BY ticker ORDER BY ret, d) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY d)) AS cum FROM {PAIRS}))"
_SPELLS = f"(SELECT ticker, max(days) AS dd_days FROM (SELECT ticker, island, date_diff('day', min(d), max(d)) AS days FROM (SELECT *, sum(CAST(dd >= 0 AS INT)) OVER (PARTITION BY ticker ORDER BY d) AS island FROM {_LEVELS}) WHERE dd < 0 GROUP BY 1, 2) GROUP BY 1)"


@query(f"""SELECT ticker, days, round(ln(1 + total), 6) AS log_total, round(cagr, 6) AS cagr, round(vol, 6) AS vol, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(max_dd, 6) AS max_dd, CAST(dd_days AS INT) AS dd_days, round(cvar95, 6) AS cvar95,
 round(cvar99, 6) AS cvar99, round(ir, 6) AS ir, round(corr, 6) AS corr, round(cagr / abs(max_dd), 6) AS calmar FROM (SELECT ticker, count(*) AS days, exp(sum(ln(1 + ret))) - 1 AS total, exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 AS cagr,
 stddev_samp(ret) * sqrt(252) AS vol, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, avg(ret) / sqrt(avg(ret * ret) FILTER (WHERE ret < 0)) * sqrt(252) AS sortino, min(dd) AS max_dd, avg(ret) FILTER (WHERE rn <= greatest(1, ceil(n * 0.05))) AS cvar95,
 avg(ret) FILTER (WHERE rn <= greatest(1, ceil(n * 0.01))) AS cvar99, avg(ret - bench) / stddev_samp(ret - bench) * sqrt(252) AS ir, corr(ret, bench) AS corr FROM {_LEVELS} GROUP BY 1) JOIN {_SPELLS} USING (ticker)""")
def t35_risk(spark, sf):
    got = portfolio.risk(pairs(spark, sf), ["ticker"])
    return got.select("ticker", "days", "dd_days", r6(F.log1p("total"), "log_total"), *[r6(c, c) for c in ("cagr", "vol", "sharpe", "sortino", "max_dd", "cvar95", "cvar99", "ir", "corr", "calmar")])


@query(f"SELECT ticker, round(avg(ret), 6) AS cvar FROM (SELECT ticker, ret, row_number() OVER (PARTITION BY ticker ORDER BY ret, d) AS rn, greatest(1, ceil(count(*) OVER (PARTITION BY ticker) * 0.05)) AS k FROM {RETURNS} WHERE ret IS NOT NULL) WHERE rn <= k GROUP BY 1")
def t36_cvar(spark, sf):
    return portfolio.cvar(history.returns(prices(spark, sf)), ["ticker"]).select("ticker", r6("cvar", "cvar"))


@query("SELECT c_nationkey, c_custkey, CAST(rank AS INT) AS rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def k3_top_k(spark, sf):
    return portfolio.top_k(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey", 3).select("c_nationkey", "c_custkey", "rank")


_BETS = f"(SELECT id, yr, 0.01 * p AS f, CASE WHEN y = 1 THEN odds - 1 ELSE -1 END AS x FROM {PROBABILITIES} WHERE p - fair >= 0.05)"
_ROLL = f"(SELECT id, yr, CAST(sum(CAST(ln(1 + f * x) AS DECIMAL(24, 15))) OVER (PARTITION BY yr ORDER BY id) AS DOUBLE) AS l FROM {_BETS})"


@query(f"SELECT id, yr, round(l, 6) AS log_roll, round(exp(l - greatest(0.0, max(l) OVER (PARTITION BY yr ORDER BY id))) - 1, 6) AS dd FROM {_ROLL}")
def b4_bankroll(spark, sf):
    p = probabilities(spark, sf).where(F.col("p") - F.col("fair") >= 0.05)
    bets = p.select("id", "yr", (0.01 * F.col("p")).alias("f"), F.when(F.col("y") == 1, F.col("odds") - 1).otherwise(-1.0).alias("x"))
    return portfolio.bankroll(bets, ["yr"], ["id"]).select("id", "yr", r6("log_roll", "log_roll"), r6("dd", "dd"))


@query(f"""WITH t AS (SELECT yr AS fam, grp AS test, least(1.0, avg(pow(p - y, 2)) / 10) AS p FROM {PROBABILITIES} GROUP BY 1, 2),
 r AS (SELECT *, p * (count(*) OVER (PARTITION BY fam) - row_number() OVER (PARTITION BY fam ORDER BY p, test) + 1) AS raw FROM t)
 SELECT fam, test, round(least(1.0, max(raw) OVER (PARTITION BY fam ORDER BY p, test ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM r""")
def i8_holm(spark, sf):
    tests = probabilities(spark, sf).groupBy(F.col("yr").alias("fam"), F.col("grp").alias("test")).agg(F.least(F.lit(1.0), F.avg(F.pow(F.col("p") - F.col("y"), 2)) / 10).alias("p"))
    return evaluate.holm(tests, ["fam"], "p", "adjusted").select("fam", "test", r6("adjusted", "adjusted"))


@query("""SELECT user_id, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 GROUP BY 1, 2""")
def s17_keep_latest(spark, sf):
    o = W.partitionBy("user_id", "event_type", "d").orderBy(F.desc("ts"), F.desc("event_id"))
    last = events(spark, sf).withColumn("rn", F.row_number().over(o)).where("rn = 1")
    return last.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), r6(F.sum("value"), "total"))


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def s18_ids_without_rows(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("id"))
    return c.join(table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
