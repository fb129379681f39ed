"""Registered queries of signals, states, selections and weights."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import asof, evaluate, history, portfolio, signals
from .queries import query
from .views import MONTHLY, PAIRS, PRICES, PROBABILITIES, RETURNS, monthly, pairs, prices, probabilities, r6, table

_O = "(PARTITION BY ticker ORDER BY d)"
_W = lambda a, b=0: f"(PARTITION BY ticker ORDER BY d ROWS BETWEEN {a} PRECEDING AND {'CURRENT ROW' if b == 0 else f'{b} PRECEDING'})"


def _rets(spark, sf):
    return history.returns(prices(spark, sf))


@query(f"SELECT ticker, d, CAST(month(d) IN (11, 12, 1, 2, 3, 4) AS INT) AS winter, CAST(month(d) = 1 AS INT) AS january, CAST(month(d) IN (12, 1) AS INT) AS turn, round(CASE WHEN month(d) IN (11, 12, 1, 2, 3, 4) THEN ret ELSE 0.0001 END, 6) AS timed FROM {RETURNS}")
def w30_t22_calendar(spark, sf):
    m = F.month("d")
    winter = m.isin(11, 12, 1, 2, 3, 4)
    return _rets(spark, sf).select("ticker", "d", winter.cast("int").alias("winter"), (m == 1).cast("int").alias("january"), m.isin(12, 1).cast("int").alias("turn"), r6(F.when(winter, F.col("ret")).otherwise(0.0001), "timed"))


_SD = f"(SELECT ticker, d, ret, CASE WHEN count(ret) OVER {_W(62)} >= 31 THEN stddev_samp(ret) OVER {_W(62)} END AS s FROM {RETURNS})"
_CALM = f"(SELECT ticker, d, coalesce(lag(coalesce(CAST(s < 1.5 * m AS INT), 0)) OVER {_O}, 1) AS calm FROM (SELECT *, CASE WHEN count(s) OVER {_W(251)} >= 126 THEN quantile_cont(s, 0.5) OVER {_W(251)} END AS m FROM {_SD}))"
_MOM = f"(SELECT ticker, d, coalesce(lag(CASE WHEN count(ret) OVER {_W(125)} = 126 THEN CAST(sum(ret) OVER {_W(125)} > 0 AS INT) END) OVER {_O}, 0) AS mom FROM {RETURNS})".replace("lag(CASE WHEN count(ret) OVER " + _W(125) + " = 126 THEN CAST(sum(ret) OVER " + _W(125) + " > 0 AS INT) END) OVER " + _O, "lag(f) OVER " + _O).replace(f"FROM {RETURNS})", f"FROM (SELECT ticker, d, CASE WHEN count(ret) OVER {_W(125)} = 126 THEN CAST(sum(ret) OVER {_W(125)} > 0 AS INT) END AS f FROM {RETURNS}))")


@query(f"SELECT ticker, d, calm, mom, CAST(calm + mom >= 2 AS INT) AS vote FROM {_CALM} JOIN {_MOM} USING (ticker, d)")
def w31_w34_w37_votes(spark, sf):
    df = signals.lagged_flag(signals.calm(_rets(spark, sf)), signals.full("ret", 126, F.sum("ret")) > 0, "mom")
    return df.select("ticker", "d", "calm", "mom", (F.col("calm") + F.col("mom") >= 2).cast("int").alias("vote"))


_SMA = f"(SELECT ticker, d, ret, px, CASE WHEN count(px) OVER {_W(49)} = 50 THEN CAST(px > avg(px) OVER {_W(49)} AS INT) END AS up FROM {RETURNS})"


@query(f"SELECT d, count(*) FILTER (WHERE up = 0) AS below, count(up) AS known FROM {_SMA} GROUP BY d")
def w35_y53_breadth(spark, sf):
    up = history.above_mean(prices(spark, sf), 50, "up")
    return up.groupBy("d").agg(F.count(F.when(F.col("up") == 0, 1)).alias("below"), F.count("up").alias("known"))


_JUMPS = f"(SELECT ticker, d, px, coalesce(abs(px / lag(px) OVER {_O} - 1) > 0.5, false) OR coalesce(abs(lead(px) OVER {_O} / px - 1) > 0.5, false) AS bad, volume FROM {MONTHLY})"


@query(f"SELECT ticker, d, bad, round(CASE WHEN NOT bad THEN px END, 6) AS px, CASE WHEN NOT bad THEN volume END AS volume FROM {_JUMPS}")
def w40_w41_y6_spurious(spark, sf):
    """One mask from the price, for price and volume alike."""
    df = monthly(spark, sf).withColumn("bad", signals.spurious(monthly(spark, sf), 0.5))
    return df.select("ticker", "d", "bad", r6(F.when(~F.col("bad"), F.col("px")), "px"), F.when(~F.col("bad"), F.col("volume")).alias("volume"))


@query(f"SELECT ticker, d, coalesce(lag(h) OVER {_O}, 0) AS held FROM (SELECT ticker, d, last_value(a IGNORE NULLS) OVER {_W('UNBOUNDED')} AS h FROM (SELECT ticker, d, CASE WHEN (row_number() OVER {_O} - 1) % 21 = 0 THEN up END AS a FROM {_SMA}))")
def w43_y54_y58_cadence(spark, sf):
    return signals.every_kth(history.above_mean(prices(spark, sf), 50, "up"), "up", 21, "held").select("ticker", "d", "held")


@query(f"SELECT ticker, round(corr(ret, r1), 6) AS auto1, round(corr(ret, r5), 6) AS auto5, round(corr(ret, r22), 6) AS auto22 FROM (SELECT ticker, ret, lag(ret, 1) OVER {_O} AS r1, lag(ret, 5) OVER {_O} AS r5, lag(ret, 22) OVER {_O} AS r22 FROM {RETURNS}) GROUP BY 1")
def w46_autocorrelation(spark, sf):
    df = _rets(spark, sf).withColumns({f"r{k}": F.lag("ret", k).over(signals.series()) for k in (1, 5, 22)})
    return df.groupBy("ticker").agg(*[r6(F.corr("ret", f"r{k}"), f"auto{k}") for k in (1, 5, 22)])


@query(f"SELECT ticker, count(*) AS n, round(avg(CASE WHEN p = 0 THEN CASE WHEN up = 1 THEN 1.0 ELSE 0 END END), 6) AS up, round(avg(CASE WHEN p = 1 THEN CASE WHEN up = 0 THEN 1.0 ELSE 0 END END), 6) AS down, round(sum(CASE WHEN up <> p THEN 1 ELSE 0 END) * 252 / count(*), 6) AS flips_per_year FROM (SELECT ticker, up, lag(up) OVER {_O} AS p FROM {_SMA}) WHERE p IS NOT NULL GROUP BY 1")
def w47_y51_flips(spark, sf):
    got = signals.flips(history.above_mean(prices(spark, sf), 50, "up"), "up")
    return got.select("ticker", "n", *[r6(c, c) for c in ("up", "down", "flips_per_year")])


_STATE = "CASE WHEN s IS NULL THEN 'early' WHEN s > 0 THEN 'bull' ELSE 'bear' END"
_STATED = f"(SELECT ticker, d, ret, bench, {_STATE} AS state FROM (SELECT *, CASE WHEN count(bench) OVER {_W(126, 1)} = 126 THEN sum(bench) OVER {_W(126, 1)} END AS s FROM {PAIRS}))"


@query(f"SELECT ticker, state, n, round(excess, 6) AS excess, round(sharpe, 6) AS sharpe, round(share, 6) AS share FROM (SELECT *, n / sum(n) OVER (PARTITION BY ticker) AS share FROM (SELECT ticker, state, count(*) AS n, avg(ret - bench) * 252 AS excess, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe FROM {_STATED} GROUP BY 1, 2)) WHERE n >= 20")
def w39_t38_t43_y48_y49_states(spark, sf):
    """Excess by the market's state, which is the sign of its sum over the 126 rows before, for states of 20 rows or more; shares are of all rows."""
    past = signals.series().rowsBetween(-126, -1)
    df = pairs(spark, sf).withColumn("s", F.when(F.count("bench").over(past) == 126, F.sum("bench").over(past)))
    got = signals.by_state(df, F.when(F.col("s").isNull(), "early").when(F.col("s") > 0, "bull").otherwise("bear"))
    return got.select("ticker", "state", "n", *[r6(c, c) for c in ("excess", "sharpe", "share")])


@query(f"SELECT ticker, part, count(*) AS n, round(avg(ret - bench) * 252, 6) AS excess, min(sign(avg(ret - bench))) OVER (PARTITION BY ticker) > 0 AS same_sign FROM (SELECT *, CASE WHEN d < DATE '1997-01-01' THEN 1 WHEN d < DATE '1999-01-01' THEN 2 ELSE 3 END AS part FROM {PAIRS}) GROUP BY 1, 2")
def t39_sub_periods(spark, sf):
    part = F.when(F.col("d") < F.lit("1997-01-01").cast("date"), 1).when(F.col("d") < F.lit("1999-01-01").cast("date"), 2).otherwise(3)
    got = pairs(spark, sf).groupBy("ticker", part.alias("part")).agg(F.count("*").alias("n"), (F.avg(F.col("ret") - F.col("bench")) * 252).alias("excess"))
    return got.select("ticker", "part", "n", r6("excess", "excess"), (F.min(F.signum("excess")).over(W.partitionBy("ticker")) > 0).alias("same_sign"))


_SCORES = f"(SELECT ticker, d, px, cls, lag(px, 1) OVER {_O} / lag(px, 7) OVER {_O} - 1 AS score FROM {MONTHLY})"


def _scores(spark, sf):
    df = monthly(spark, sf)
    return df.withColumn("score", signals.trailing(df, 7))


@query(f"SELECT d, ticker, round(1.0 / count(*) OVER (PARTITION BY d), 6) AS w FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, ticker) AS k FROM {_SCORES} WHERE score IS NOT NULL) WHERE k <= 5) WHERE score > 0")
def k4_t9_rotation(spark, sf):
    """The five best by trailing return, those above 0, in equal parts."""
    return signals.picked(_scores(spark, sf), "score", 5).select("d", "ticker", r6("w", "w"))


@query(f"SELECT d, ticker FROM (SELECT d, ticker, row_number() OVER (PARTITION BY d ORDER BY score DESC, ticker) AS k, count(*) OVER (PARTITION BY d) AS n FROM {_SCORES} WHERE score IS NOT NULL) WHERE k <= least(greatest(20, floor(n * 0.1)), 100, n)")
def k2_top_share(spark, sf):
    """The best tenth, 20 at least and 100 at most."""
    day = W.partitionBy("d")
    df = _scores(spark, sf).where("score is not null").withColumn("k", F.row_number().over(day.orderBy(F.desc("score"), "ticker"))).withColumn("n", F.count("*").over(day))
    return df.where(F.col("k") <= F.least(F.greatest(F.lit(20), F.floor(F.col("n") * 0.1)), F.lit(100), F.col("n"))).select("d", "ticker")


_CLASS = f"(SELECT d, ticker, cls, score / sum(score) OVER (PARTITION BY d) AS w FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, ticker) AS k FROM {_SCORES} WHERE score IS NOT NULL) WHERE k <= 10) WHERE score > 0)"


@query(f"SELECT d, ticker, round(coalesce(c * every / nullif(sum(c) OVER (PARTITION BY d), 0), c), 6) AS w FROM (SELECT *, sum(w) OVER (PARTITION BY d) AS every, CASE WHEN sum(w) OVER (PARTITION BY d, cls) > 0.3 THEN w * 0.3 / sum(w) OVER (PARTITION BY d, cls) ELSE w END AS c FROM {_CLASS})")
def l8_capped_momentum(spark, sf):
    best = signals.picked(_scores(spark, sf), "score", 10).withColumn("w", F.col("score") / F.sum("score").over(W.partitionBy("d")))
    return portfolio.class_cap(best, ["d"], "cls", 0.3).select("d", "ticker", r6("w", "w"))


_DUAL = f"(SELECT d, max(s) FILTER (WHERE ticker = 'A') AS h, max(s) FILTER (WHERE ticker = 'R') AS a, max(s) FILTER (WHERE ticker = 'N') AS r FROM (SELECT ticker, d, lag(px, 1) OVER {_O} / lag(px, 126) OVER {_O} - 1 AS s FROM {PRICES}) GROUP BY d)"


@query(f"SELECT d, CASE WHEN h IS NULL OR a IS NULL OR r IS NULL THEN 'A' WHEN h > a THEN CASE WHEN h > 0 THEN 'A' ELSE 'N' END ELSE CASE WHEN a > 0 THEN 'R' ELSE 'N' END END AS ticker FROM {_DUAL}")
def l2_dual_momentum(spark, sf):
    p = prices(spark, sf)
    return signals.dual_momentum(p.withColumn("score", signals.trailing(p, 126)), "A", "R", "N").select("d", "ticker")


_BAND = f"(SELECT ticker, d, px, CASE WHEN count(ret) OVER {_W(63, 1)} = 63 THEN stddev_samp(ret) OVER {_W(63, 1)} * sqrt(252) END AS vol, CASE WHEN count(px) OVER {_W(200, 1)} = 200 THEN CAST(lag(px) OVER {_O} > avg(px) OVER {_W(200, 1)} AS INT) END AS up FROM {RETURNS})"


@query(f"SELECT ticker, d, round(CASE WHEN vol IS NULL THEN 0.6 WHEN vol > 1e-6 THEN least(greatest(1.5 / vol, 0.3), 1.0) ELSE 1.0 END, 6) AS vol_w, CASE WHEN up IS NULL THEN 0.5 ELSE up * 1.0 END AS trend_w, round(vol, 6) AS vol FROM {_BAND}")
def l5_l10_l20_t14_bands(spark, sf):
    """Weight by a volatility target within a band (0.6 until known), and by trend (a half until known)."""
    df = _rets(spark, sf)
    past = lambda w: signals.series().rowsBetween(-w, -1)
    df = df.withColumn("vol", F.when(F.count("ret").over(past(63)) == 63, F.stddev_samp("ret").over(past(63)) * F.sqrt(F.lit(252))))
    df = df.withColumn("up", F.when(F.count("px").over(past(200)) == 200, (F.lag("px").over(signals.series()) > F.avg("px").over(past(200))).cast("double")))
    weight = F.when(F.col("vol").isNull(), 0.6).when(F.col("vol") > 1e-6, F.least(F.greatest(1.5 / F.col("vol"), F.lit(0.3)), F.lit(1.0))).otherwise(1.0)
    return df.select("ticker", "d", r6(weight, "vol_w"), F.coalesce("up", F.lit(0.5)).alias("trend_w"), r6("vol", "vol"))


_MACRO = "(SELECT CAST(o_orderdate AS DATE) AS obs, avg(o_totalprice) / 1000 AS v FROM orders GROUP BY 1)"


@query(f"SELECT d, round(CASE WHEN v IS NULL THEN 0.8 WHEN v > 155 THEN 1.0 WHEN v < 145 THEN 0.6 ELSE 0.8 END, 6) AS w, coalesce(v > 150, false) AS held, round(coalesce(v, 2) / 252, 6) AS rate FROM (SELECT DISTINCT d FROM {PRICES}) p ASOF LEFT JOIN (SELECT obs + 30 AS released, v FROM {_MACRO}) m ON p.d > m.released")
def j11_j18_macro(spark, sf):
    """Weights and switches from the last macro value released before the day; a default where there is none."""
    macro = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("obs")).agg((F.avg("o_totalprice") / 1000).alias("v"))
    got = asof.as_of_dates(prices(spark, sf).select("d").distinct(), asof.with_lag(macro, "obs", 30), "d", "released", ["v"])
    v = F.col("v")
    return got.select("d", r6(F.when(v.isNull(), 0.8).when(v > 155, 1.0).when(v < 145, 0.6).otherwise(0.8), "w"), F.coalesce(v > 150, F.lit(False)).alias("held"), r6(F.coalesce(v, F.lit(2.0)) / 252, "rate"))


@query(f"SELECT ticker, count(*) AS n, round(stddev_samp(ret - bench) * sqrt(252), 6) AS te, round(avg(ret - bench) * 252, 6) AS excess FROM {PAIRS} GROUP BY 1")
def j19_y70_tracking_error(spark, sf):
    x = F.col("ret") - F.col("bench")
    return pairs(spark, sf).groupBy("ticker").agg(F.count("*").alias("n"), r6(F.stddev_samp(x) * F.sqrt(F.lit(252)), "te"), r6(F.avg(x) * 252, "excess"))


@query(f"SELECT d, round(arg_min(ret, rank), 6) AS ret, min(rank) AS rank FROM (SELECT d, ret, 1 AS rank FROM {RETURNS} WHERE ticker = 'A' AND d >= DATE '1998-01-01' UNION ALL SELECT d, ret, 2 FROM {RETURNS} WHERE ticker = 'R' UNION ALL SELECT d, ret, 3 FROM {RETURNS} WHERE ticker = 'N') WHERE ret IS NOT NULL GROUP BY d")
def j25_j26_overlaid(spark, sf):
    """A real series from its first day on, laid over its proxies."""
    rank = F.when(F.col("ticker") == "A", 1).when(F.col("ticker") == "R", 2).otherwise(3)
    parts = _rets(spark, sf).where("ticker <> 'A' or d >= date '1998-01-01'").select("d", "ret", rank.alias("rank"))
    return signals.overlaid(parts, ["d"], "ret", "rank").select("d", r6("ret", "ret"), "rank")


_CHARS = f"(SELECT ticker, d, ln(lag(px, 2) OVER {_O} / lag(px, 12) OVER {_O}) AS mom, CASE WHEN count(ret) OVER {_W(21)} >= 15 THEN max(ret) OVER {_W(21)} END AS maxret, CASE WHEN count(ret) OVER {_W(21)} >= 15 THEN stddev_samp(ret) OVER {_W(21)} * sqrt(252) END AS vol, ln(lead(px, 3) OVER {_O} / px) AS fwd FROM (SELECT *, px / lag(px) OVER {_O} - 1 AS ret FROM {MONTHLY}))"


@query(f"SELECT ticker, d, round(mom, 6) AS mom, round(maxret, 6) AS maxret, round(vol, 6) AS vol, round(fwd - avg(fwd) OVER (PARTITION BY d), 6) AS target FROM {_CHARS}")
def x11_x12_x18_x21_x23_characteristics(spark, sf):
    """Log momentum, largest return and volatility of the last 22 rows (15 at least), and the demeaned forward return to learn from."""
    df = history.returns(monthly(spark, sf))
    last, lag = signals.series().rowsBetween(-21, 0), lambda k: F.lag("px", k).over(signals.series())
    enough = F.count("ret").over(last) >= 15
    df = df.withColumn("mom", F.log(lag(2) / lag(12))).withColumn("maxret", F.when(enough, F.max("ret").over(last))).withColumn("vol", F.when(enough, F.stddev_samp("ret").over(last) * F.sqrt(F.lit(252)))).withColumn("fwd", F.log(F.lead("px", 3).over(signals.series()) / F.col("px")))
    return df.select("ticker", "d", r6("mom", "mom"), r6("maxret", "maxret"), r6("vol", "vol"), r6(F.col("fwd") - F.avg("fwd").over(W.partitionBy("d")), "target"))


_CUTS = "(SELECT ticker, d, CASE WHEN score IS NOT NULL THEN least(greatest(score, lo), hi) END AS x FROM (SELECT *, quantile_cont(score, 0.01) OVER (PARTITION BY d) AS lo, quantile_cont(score, 0.99) OVER (PARTITION BY d) AS hi FROM " + _SCORES + "))"


@query(f"SELECT ticker, d, round(CASE WHEN x IS NULL OR n < 2 THEN 0 ELSE (k + (t - 1) / 2.0 - 1) / (n - 1) - 0.5 END, 6) AS rank FROM (SELECT *, count(x) OVER (PARTITION BY d) AS n, count(x) OVER (PARTITION BY d, x) AS t, rank() OVER (PARTITION BY d ORDER BY x NULLS LAST) AS k FROM {_CUTS})")
def x16_ranks(spark, sf):
    return signals.ranks_around_zero(_scores(spark, sf), "score", "rank").select("ticker", "d", r6("rank", "rank"))


@query(f"SELECT yr, count(*) AS n, round(-avg(ln(greatest(CASE c WHEN 0 THEN a WHEN 1 THEN b ELSE 1 - a - b END, 1e-15))), 6) AS log_loss, round(avg(CASE WHEN c = CASE WHEN a >= b AND a >= 1 - a - b THEN 0 WHEN b >= 1 - a - b THEN 1 ELSE 2 END THEN 1.0 ELSE 0 END), 6) AS accuracy FROM (SELECT yr, id % 3 AS c, p * 0.6 AS a, p * 0.2 + 0.1 AS b FROM {PROBABILITIES}) GROUP BY 1")
def v2_multi_class(spark, sf):
    p = probabilities(spark, sf).select("yr", (F.col("id") % 3).cast("int").alias("c"), F.array(F.col("p") * 0.6, F.col("p") * 0.2 + 0.1, 1 - F.col("p") * 0.6 - (F.col("p") * 0.2 + 0.1)).alias("q"))
    return evaluate.class_scores(p, ["yr"]).select("yr", "n", r6("log_loss", "log_loss"), r6("accuracy", "accuracy"))


@query(f"SELECT CAST(k AS INT) AS k, round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 6) AS log_loss FROM (SELECT k, y, least(greatest(k / 10.0 * p + (1 - k / 10.0) * fair, 0.02), 0.98) AS q FROM {PROBABILITIES}, (SELECT unnest(range(11)) AS k)) GROUP BY 1")
def v12_v13_y36_ensemble_weights(spark, sf):
    """Log loss of every mix of two probabilities on a grid; the best weight is its least row."""
    grid = probabilities(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10))))
    q = F.least(F.greatest(F.col("k") / 10 * F.col("p") + (1 - F.col("k") / 10) * F.col("fair"), F.lit(0.02)), F.lit(0.98))
    return grid.groupBy("k").agg(r6(evaluate.log_loss(F.col("y"), q), "log_loss"))
