"""Registered queries of regressions, covariances, correlations and the inference that rests on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, inference, portfolio, regress
from .inference import _PAIR, _rets, _sharpe, _SHARPE, _sums  # noqa: I001
from .queries import query
from .views import PAIRS, RETURNS, pairs, plain, prices, r6, rounded, shared

BY = ["ticker"]
_RF = 0.0001
_WIDE = f"(SELECT CAST(year(d) AS INT) AS yr, d, max(ret) FILTER (ticker = 'A') AS a, max(ret) FILTER (ticker = 'N') AS n, max(ret) FILTER (ticker = 'R') AS r FROM {RETURNS} GROUP BY d)"


def _wide(spark, sf):
    rets = _rets(spark, sf)
    at = lambda t: F.max(F.when(F.col("ticker") == t, F.col("ret")))
    return rets.groupBy("d").agg(at("A").alias("a"), at("N").alias("n"), at("R").alias("r")).withColumn("yr", F.year("d"))


@query(f"""WITH v AS (SELECT yr, a - {_RF} AS y, n - {_RF} AS m, r AS f FROM {_WIDE} WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL),
 s AS (SELECT yr, count(*) AS n, avg(y) AS ay, avg(m) AS am, avg(f) AS af, var_pop(y) AS vy, var_pop(m) AS vm, var_pop(f) AS vf, covar_pop(y, m) AS cm, covar_pop(y, f) AS cf, covar_pop(m, f) AS c FROM v GROUP BY yr),
 b AS (SELECT *, (cm * vf - cf * c) / (vm * vf - c * c) AS bm, (cf * vm - cm * c) / (vm * vf - c * c) AS bf FROM s), e AS (SELECT *, n * (vy - bm * cm - bf * cf) AS rss FROM b)
 SELECT yr, n, round(252 * (ay - bm * am - bf * af), 4) AS alpha, round(bm, 6) AS b_mkt, round(bf, 6) AS b_factor, round(bf / sqrt(rss / (n - 3) * vm / (n * (vm * vf - c * c))), 4) AS t_factor, round(1 - rss / (n * vy), 6) AS r2 FROM e""")
def t42_factor_loading(spark, sf):
    """Excess returns on the market and a factor, year by year in one job."""
    rows = _wide(spark, sf).select("yr", (F.col("a") - _RF).alias("y"), (F.col("n") - _RF).alias("m"), F.col("r").alias("f"))
    got = regress.least_squares(rows, ["yr"], "y", ["m", "f"])
    return got.select("yr", "n", rounded(252 * F.col("coef")[0], "alpha", 4), r6(F.col("coef")[1], "b_mkt"), r6(F.col("coef")[2], "b_factor"), rounded(F.col("t")[2], "t_factor", 4), r6("r2", "r2"))


_X13 = "OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query(f"""SELECT ticker, d, round(beta, 6) AS beta, round(CASE WHEN beta IS NOT NULL THEN sqrt(greatest(vs + beta * beta * vb - 2 * beta * cv, 0) * 252) END, 6) AS idio FROM (SELECT ticker, d, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY d) >= 126 THEN
 covar_samp(ret, bench) {_X13.format(251)} / var_samp(bench) {_X13.format(251)} END AS beta, var_samp(ret) {_X13.format(125)} AS vs, var_samp(bench) {_X13.format(125)} AS vb, covar_samp(ret, bench) {_X13.format(125)} AS cv FROM {PAIRS})""")
def x13_residual_vol(spark, sf):
    return regress.residual_vol(pairs(spark, sf)).select("ticker", "d", r6("beta", "beta"), r6("idio", "idio"))


@query(f"""WITH v AS (SELECT yr, unnest([a, r]) AS y, unnest(['A', 'R']) AS ticker, n AS x FROM {_WIDE} WHERE n IS NOT NULL), b AS (SELECT yr, ticker, avg(y) AS ay, avg(x) AS ax, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 5.0) AS k FROM v WHERE y IS NOT NULL GROUP BY yr, ticker),
 p AS (SELECT yr, ticker, ay + k * (0.01 - ax) AS pred FROM b), e AS (SELECT *, exp((pred - max(pred) OVER (PARTITION BY yr)) / 0.5) AS e FROM p), s AS (SELECT *, greatest(e / sum(e) OVER (PARTITION BY yr), 0.1) AS s FROM e)
 SELECT yr, ticker, round(pred, 6) AS pred, round(s / sum(s) OVER (PARTITION BY yr), 6) AS w FROM s""")
def v23_ridge_weights(spark, sf):
    """Each class's return predicted by a ridge regression, softmax of the predictions, a floor of a tenth."""
    rows = _wide(spark, sf).select("yr", F.col("n").alias("x"), F.explode(F.array(F.struct(F.lit("A").alias("ticker"), F.col("a").alias("y")), F.struct(F.lit("R").alias("ticker"), F.col("r").alias("y")))).alias("s")).select("yr", "x", "s.*")
    fit = regress.least_squares(rows, ["yr", "ticker"], "y", ["x"], ridge=5.0)
    pred = fit.select("yr", "ticker", (F.col("coef")[0] + 0.01 * F.col("coef")[1]).alias("pred"))
    return regress.softmax_weights(pred, ["yr"], "pred", 0.5, 0.1).select("yr", "ticker", r6("pred", "pred"), r6("w", "w"))


_REGION_TEXT = "SELECT CAST(l_suppkey % 2 AS INT) AS region, l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice) / sum(l_quantity) AS px FROM {lineitem} GROUP BY l_suppkey % 2, l_returnflag, CAST(l_shipdate AS DATE)"
_REGIONS = f"(SELECT region, ticker, d, px, px / lag(px) OVER (PARTITION BY region, ticker ORDER BY d) - 1 AS ret FROM {plain(_REGION_TEXT)})"


def _regions(spark, sf):
    """Returns by region and ticker; the two together name a series."""
    px = shared(spark, sf, _REGION_TEXT).withColumn("ticker", F.concat_ws("|", "region", "ticker"))
    return history.returns(px).withColumn("region", F.split("ticker", r"\|")[0].cast("int"))


@query(f"""WITH u AS (SELECT region, ticker, d, ret, px > avg(px) OVER (PARTITION BY region, ticker ORDER BY d ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AND count(*) OVER (PARTITION BY region, ticker ORDER BY d ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) = 100 AS up FROM {_REGIONS}),
 e AS (SELECT *, coalesce(lag(up) OVER (PARTITION BY region, ticker ORDER BY d), false) AS e FROM u) SELECT d, round(avg(CASE WHEN e THEN 0 ELSE {_RF} - ret END), 6) AS ret FROM e WHERE ret IS NOT NULL GROUP BY d""")
def y57_timed_minus_held(spark, sf):
    """Every factor of every region in trend or in bills, less holding it; the mean of the factors that a day has."""
    from ..operators import allocate

    timed = allocate.trend(_regions(spark, sf), 100, "e").where("ret is not null")
    return timed.groupBy("d").agg(r6(F.avg(F.when(F.col("e") > 0, 0.0).otherwise(_RF - F.col("ret"))), "ret"))


_FULL = f"(SELECT * FROM {_REGIONS} WHERE ret IS NOT NULL QUALIFY count(*) OVER (PARTITION BY region, d) = 3)"
_CORR = f"""(SELECT region, d, avg(c) AS corr FROM (SELECT a.region, a.d, count(*) OVER w AS k, corr(a.ret, b.ret) OVER w AS c FROM {_FULL} a JOIN {_FULL} b ON a.region = b.region AND a.d = b.d AND a.ticker < b.ticker
 WINDOW w AS (PARTITION BY a.region, a.ticker, b.ticker ORDER BY a.d ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) WHERE k >= 31 GROUP BY region, d)"""


@query(f"""SELECT region, d, round(corr, 6) AS corr, coalesce(lag(coalesce(CAST(corr > m AS INT), 0)) OVER (PARTITION BY region ORDER BY d), 0) AS high FROM (SELECT *, CASE WHEN count(corr) OVER w >= 126 THEN quantile_cont(corr, 0.5) OVER w END AS m FROM {_CORR}
 WINDOW w AS (PARTITION BY region ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))""")
def w36_mean_pair_correlation(spark, sf):
    rets = _regions(spark, sf).select("region", "ticker", "d", "ret")
    got = regress.crowded(regress.mean_pair_correlation(rets, ["region"]), ["region"])
    return got.select("region", "d", r6("corr", "corr"), "high")


_UP = f"(SELECT region || '|' || ticker AS ticker, d, CASE WHEN count(*) OVER w = 50 THEN CAST(px > avg(px) OVER w AS INT) END AS up FROM {_REGIONS} WINDOW w AS (PARTITION BY region, ticker ORDER BY d ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"


@query(f"SELECT count(c) AS pairs, round(avg(c), 6) AS mean, round(min(c), 6) AS least, round(max(c), 6) AS most FROM (SELECT corr(a.up, b.up) AS c FROM {_UP} a JOIN {_UP} b ON a.d = b.d AND a.ticker < b.ticker WHERE a.up IS NOT NULL AND b.up IS NOT NULL GROUP BY a.ticker, b.ticker) WHERE NOT isnan(c)")
def y61_signal_correlation(spark, sf):
    got = regress.pair_correlations(history.above_mean(_regions(spark, sf), 50, "up"), "up")
    return got.select("pairs", r6("mean", "mean"), r6("least", "least"), r6("most", "most"))


_REBAL = f"(SELECT yr, ticker, d, ret FROM (SELECT *, CAST(year(d) AS INT) AS yr, row_number() OVER (PARTITION BY ticker, year(d) ORDER BY d DESC) AS k FROM {RETURNS} WHERE ret IS NOT NULL) WHERE k <= 60)"


def _yearly(spark, sf):
    """The last 60 returns of each series and year."""
    from pyspark.sql import Window as W

    rows = _rets(spark, sf).withColumn("yr", F.year("d"))
    return rows.withColumn("k", F.row_number().over(W.partitionBy("ticker", "yr").orderBy(F.desc("d")))).where("k <= 60").drop("k")


@query(f"SELECT yr, ticker, round(1 / s / sum(1 / s) OVER (PARTITION BY yr), 6) AS w FROM (SELECT yr, ticker, stddev_samp(ret) AS s FROM {_REBAL} GROUP BY yr, ticker HAVING count(*) = 60)")
def l4_inverse_vol_parity(spark, sf):
    """Weights by the inverse of each class's deviation, of those with enough rows."""
    vols = _yearly(spark, sf).groupBy("yr", "ticker").agg(F.stddev_samp("ret").alias("vol"), F.count("*").alias("n")).where("n = 60")
    return portfolio.inverse_vol(vols, ["yr"]).select("yr", "ticker", r6("w", "w"))


@query()
def l4_equal_risk(spark, sf):
    """Weights of equal contributions to the variance, from each year's covariances."""
    cov = regress.covariances(_yearly(spark, sf), ["yr"])
    return regress.solved_weights(cov, ["yr"]).select("yr", "ticker", r6("w", "w"))


@query()
def y72_least_vol_weights(spark, sf):
    """Weights from 0 up that have the least variance, from each year's covariances."""
    cov = regress.covariances(_yearly(spark, sf), ["yr"])
    return regress.solved_weights(cov, ["yr"], "least_vol").select("yr", "ticker", r6("w", "w"))


_GRID = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 1.0]
_MIX = "sqrt(greatest((w * w * ss + (1 - w) * (1 - w) * bb + 2 * w * (1 - w) * sb) / n - pow((w * s + (1 - w) * b) / n, 2), 0) * 252)"
_BEST = "SELECT {key}, arg_min(w, v) AS weight, min(v) AS vol FROM (SELECT *, " + _MIX + " AS v FROM {rows}, (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 1.0]::DOUBLE[]) AS w)) GROUP BY {key}"


@query(f"""WITH p AS ({_BEST.format(key='ticker', rows=f'(SELECT ticker, count(*) AS n, sum(ret) AS s, sum(bench) AS b, sum(ret * ret) AS ss, sum(bench * bench) AS bb, sum(ret * bench) AS sb FROM {PAIRS} GROUP BY ticker)')}),
 r AS ({_BEST.format(key='ticker, rep', rows=_sums(PAIRS, _PAIR))}), g AS (SELECT ticker, count(*) AS reps, avg(weight) AS mean, avg(CASE WHEN weight BETWEEN 0.35 AND 0.55 THEN 1.0 ELSE 0 END) AS share FROM r GROUP BY ticker)
 SELECT ticker, weight, round(vol, 6) AS vol, weight BETWEEN 0.35 AND 0.55 AS in_band, reps, round(mean, 6) AS mean, round(share, 6) AS in_band_share FROM p JOIN g USING (ticker)""")
def i19_least_vol_location(spark, sf):
    """The mix of least deviation on a grid, and where 10,000 resamples have it."""
    got = inference.least_vol_weight(pairs(spark, sf), BY, _GRID, (0.35, 0.55))
    return got.select("ticker", "weight", r6("vol", "vol"), "in_band", "reps", r6("mean", "mean"), r6("in_band_share", "in_band_share"))


_PRE, _POST = (f"(SELECT * FROM (SELECT ticker, d, ret, count(*) OVER (PARTITION BY ticker) AS k FROM {RETURNS} WHERE ret IS NOT NULL AND d {op} DATE '1998-07-01') WHERE k >= 252)" for op in ("<", ">="))
_R = {"s": "ret", "ss": "ret * ret"}


@query(f"""WITH a AS (SELECT ticker, rep, {_sharpe('s', 'ss')} AS pre FROM {_sums(_PRE, _R)}), b AS (SELECT ticker, rep, {_sharpe('s', 'ss')} AS post FROM {_sums(_POST, _R).replace("md5('42|'", "md5('43|'")}),
 g AS (SELECT ticker, quantile_cont(pre - post, 0.05) AS lo, quantile_cont(pre - post, 0.95) AS hi FROM a JOIN b USING (ticker, rep) GROUP BY ticker), p AS (SELECT ticker, {_SHARPE.format('ret')} AS pre FROM {_PRE} GROUP BY 1), q AS (SELECT ticker, {_SHARPE.format('ret')} AS post FROM {_POST} GROUP BY 1),
 c AS (SELECT ticker, count(*) FILTER (d < DATE '1998-07-01') AS n_pre, count(*) FILTER (d >= DATE '1998-07-01') AS n_post FROM {RETURNS} WHERE ret IS NOT NULL GROUP BY 1)
 SELECT ticker, n_pre, n_post, round(pre, 6) AS pre, round(post, 6) AS post, round(1 - post / pre, 6) AS decay, round(pre - post, 6) AS diff, round(lo, 6) AS diff_low, round(hi, 6) AS diff_high FROM c LEFT JOIN (p JOIN q USING (ticker)) USING (ticker) LEFT JOIN g USING (ticker)""")
def i15_publication_decay(spark, sf):
    """Sharpe ratios before and after a date, the two samples drawn separately."""
    got = inference.publication_decay(_rets(spark, sf), BY, F.lit("1998-07-01").cast("date"))
    return got.select("ticker", "n_pre", "n_post", *[r6(c, c) for c in ("pre", "post", "decay", "diff", "diff_low", "diff_high")])


@query()
def i16_drawdown_interval(spark, sf):
    """By how much a series falls less than its benchmark at worst, over 5,000 paired paths."""
    return inference.drawdown_interval(pairs(spark, sf), BY).select("ticker", *[r6(c, c) for c in ("point", "low", "high", "share_shallower")])


_TIMED = f"(SELECT ticker, d, ret, CASE WHEN coalesce(lag(up) OVER (PARTITION BY ticker ORDER BY d), 0) > 0 THEN 1.0 ELSE 0.0 END AS e FROM (SELECT ticker, d, ret, CASE WHEN count(*) OVER w = 50 THEN CAST(px > avg(px) OVER w AS INT) END AS up FROM {RETURNS} WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)))"


@query(f"""WITH t AS (SELECT * FROM {_TIMED} WHERE ret IS NOT NULL), o AS (SELECT ticker, avg(e) AS exposure, {_SHARPE.format(f'((1 - e) * ({_RF} - ret))')} AS observed FROM t GROUP BY 1),
 z AS (SELECT t.ticker, sim, CASE WHEN ('0x' || substr(md5('42|' || sim || '|' || d), 1, 8))::BIGINT / 4294967296.0 < exposure THEN 0 ELSE {_RF} - ret END AS x FROM t JOIN o USING (ticker), (SELECT unnest(range(1, 1001)) AS sim)), n AS (SELECT ticker, sim, {_SHARPE.format('x')} AS stat FROM z GROUP BY 1, 2)
 SELECT ticker, round(any_value(exposure), 6) AS exposure, round(any_value(observed), 6) AS observed, count(*) AS sims, round(avg(stat), 6) AS null_mean, round(stddev_pop(stat), 6) AS null_std, round((1 + count(*) FILTER (stat >= observed)) / (count(*) + 1), 6) AS p_upper FROM n JOIN o USING (ticker) GROUP BY ticker""")
def i24_random_timing(spark, sf):
    """A trend rule against 1,000 random timings of equal mean exposure."""
    from ..operators import allocate

    timed = allocate.trend(history.returns(prices(spark, sf)), 50, "e").where("ret is not null").select("ticker", "d", "ret", "e")
    got = inference.random_timing(timed, BY, "e", _RF)
    return got.select("ticker", *[r6(c, c) for c in ("exposure", "observed")], "sims", *[r6(c, c) for c in ("null_mean", "null_std", "p_upper")])
