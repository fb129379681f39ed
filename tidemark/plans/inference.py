"""Registered queries of resampling and inference, with SQL that repeats the same draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import evaluate, history, inference
from .queries import query
from .views import PAIRS, RETURNS, pairs, prices, probabilities, PROBABILITIES, r6  # noqa: I001

REPS, BLOCK, SEED = inference.REPS, inference.MEAN_BLOCK, 42
BY = ["ticker"]


def _rets(spark, sf):
    return history.returns(prices(spark, sf)).where("ret is not null").select("ticker", "d", "ret")


def _draws(n: str, reps: int = REPS) -> str:
    """SQL of block_draws for the lengths in the query n (a column n)."""
    return f"""(SELECT n, rep, start, CASE WHEN k = last THEN n - before ELSE least(size, n - before) END AS size FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY n, rep ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
 FROM (SELECT n, last, rep, k, floor(('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0 * n)::BIGINT AS start, 1 + floor(ln(('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0 + {0.5 / (1 << 32)!r}) / {float(np.log(1 - 1 / BLOCK))!r})::BIGINT AS size
 FROM (SELECT n, last, rep, k, md5('{SEED}|' || rep || '|' || k) AS h FROM (SELECT n, last, rep, unnest(range(1, last + 1)) AS k FROM (SELECT n, ceil(n / {BLOCK} + 6 * sqrt(n / {BLOCK}) + 12)::BIGINT AS last, unnest(range({reps})) AS rep FROM ({n}))))))
 WHERE before < n)"""


def _sums(rows: str, values: dict[str, str], by: str = "ticker", reps: int = REPS) -> str:
    """SQL of block_sums over rows ({by}, d, ...) for named expressions."""
    over = f"OVER (PARTITION BY {by} ORDER BY d ROWS UNBOUNDED PRECEDING)"
    pre = f"(SELECT {by}, count(*) OVER (PARTITION BY {by}) AS n, row_number() OVER (PARTITION BY {by} ORDER BY d) AS at, {', '.join(f'sum({e}) {over} AS {v}' for v, e in values.items())} FROM {rows})"
    draws = _draws(f"SELECT DISTINCT count(*) AS n FROM {rows} GROUP BY {by}", reps)
    ends = f"(SELECT n, rep, at, sign FROM (SELECT n, rep, unnest([least(start + size, n), start, greatest(start + size - n, 0)]) AS at, unnest([1, -1, 1]) AS sign FROM {draws}) WHERE at > 0)"
    return f"(SELECT p.{by}, rep, p.n, {', '.join(f'sum(sign * {v}) AS {v}' for v in values)} FROM {ends} e JOIN {pre} p ON p.n = e.n AND p.at = e.at GROUP BY p.{by}, rep, p.n)"


def _sharpe(s: str, ss: str) -> str:
    return f"({s} / n / greatest(sqrt(greatest({ss} / n - pow({s} / n, 2), 0)), 1e-10) * sqrt(252))"


_ROWS = f"(SELECT ticker, d, ret FROM {RETURNS} WHERE ret IS NOT NULL)"
_PAIR = {"s": "ret", "b": "bench", "ss": "ret * ret", "bb": "bench * bench", "sb": "ret * bench"}
_SHARPE = "avg({0}) / greatest(stddev_pop({0}), 1e-10) * sqrt(252)"


@query(f"SELECT ticker, rep, round({_sharpe('s', 'ss')}, 6) AS sharpe FROM {_sums(_ROWS, {'s': 'ret', 'ss': 'ret * ret'})}")
def i1_bootstrap_sharpe(spark, sf):
    return inference.bootstrap_sharpe(_rets(spark, sf), BY).select("ticker", "rep", r6("sharpe", "sharpe"))


def _tested(stat: str, null: str, observed: str, rows: str) -> str:
    return f"""WITH o AS (SELECT ticker, {observed} AS observed FROM {rows} GROUP BY 1), r AS (SELECT ticker, {stat} AS stat FROM {null}),
 c AS (SELECT ticker, count(*) AS reps, any_value(observed) AS observed, count(*) FILTER (WHERE stat >= observed) AS ge, count(*) FILTER (WHERE stat <= observed) AS le, avg(stat) AS null_mean, stddev_pop(stat) AS null_std FROM r JOIN o USING (ticker) GROUP BY 1)
 SELECT ticker, reps, round(observed, 6) AS observed, round((1 + ge) / (reps + 1), 6) AS p_upper, round((1 + le) / (reps + 1), 6) AS p_lower, round(least(1.0, 2 * least((1 + ge) / (reps + 1), (1 + le) / (reps + 1))), 6) AS p_two_sided,
 round(null_mean, 6) AS null_mean, round(null_std, 6) AS null_std FROM c"""


_EXCESS = f"(SELECT ticker, d, ret - bench AS x FROM {PAIRS})"
_CENTRED = f"(SELECT ticker, d, x - avg(x) OVER (PARTITION BY ticker) AS x FROM {_EXCESS})"
_TESTED = ("observed", "p_upper", "p_lower", "p_two_sided", "null_mean", "null_std")


@query(_tested(_sharpe("s", "ss"), _sums(_CENTRED, {"s": "x", "ss": "x * x"}), _SHARPE.format("x"), _EXCESS))
def i2_centred_test(spark, sf):
    return inference.centred_test(pairs(spark, sf), BY).select("ticker", "reps", *[r6(c, c) for c in _TESTED])


_POINT = f"(SELECT ticker, {_SHARPE.format('ret')} AS strategy, {_SHARPE.format('bench')} AS benchmark, {_SHARPE.format('(ret - bench)')} AS excess FROM {PAIRS} GROUP BY 1)"
_DIFFS = f"(SELECT ticker, rep, {_sharpe('s', 'ss')} - {_sharpe('b', 'bb')} AS diff, {_sharpe('(s - b)', '(ss + bb - 2 * sb)')} AS excess FROM {_sums(PAIRS, _PAIR)})"
_VERDICT = "CASE WHEN {0} > {2} THEN 'STRONG_EDGE' WHEN {0} > 0 THEN 'WEAK_EDGE' WHEN {1} > {2} THEN 'INCONCLUSIVE_POSITIVE' WHEN {1} > 0 THEN 'INCONCLUSIVE' ELSE 'NEGATIVE' END"
_CI = f"(SELECT ticker, quantile_cont(diff, 0.05) AS lo, quantile_cont(diff, 0.95) AS hi, quantile_cont(excess, 0.05) AS elo, quantile_cont(excess, 0.95) AS ehi FROM {_DIFFS} GROUP BY 1)"


@query(f"""SELECT ticker, round(strategy, 6) AS strategy, round(benchmark, 6) AS benchmark, round(strategy - benchmark, 6) AS diff, round(lo, 6) AS diff_low, round(hi, 6) AS diff_high, round(excess, 6) AS excess,
 round(elo, 6) AS excess_low, round(ehi, 6) AS excess_high, lo > 0 OR hi < 0 AS excludes_zero, {_VERDICT.format('lo', 'hi', 0.1)} AS verdict FROM {_POINT} JOIN {_CI} USING (ticker)""")
def i3_sharpe_interval(spark, sf):
    got = inference.sharpe_interval(pairs(spark, sf), BY)
    return got.select("ticker", *[r6(c, c) for c in ("strategy", "benchmark", "diff", "diff_low", "diff_high", "excess", "excess_low", "excess_high")], "excludes_zero", "verdict")


_LOGS = f"(SELECT ticker, d, ln(1 + ret) - ln(1 + bench) AS x FROM {PAIRS})"
_LOGS_CENTRED = f"(SELECT ticker, d, x - avg(x) OVER (PARTITION BY ticker) AS x FROM {_LOGS})"


@query(_tested("x / n * 252", _sums(_LOGS_CENTRED, {"x": "x"}), "avg(x) * 252", _LOGS))
def i4_growth_test(spark, sf):
    return inference.growth_test(pairs(spark, sf), BY).select("ticker", "reps", *[r6(c, c) for c in _TESTED])


_GROWTH = f"""SELECT ticker, diff, lo, hi FROM (SELECT ticker, exp(avg(ln(1 + ret)) * 252) - exp(avg(ln(1 + bench)) * 252) AS diff FROM {PAIRS} GROUP BY 1)
 JOIN (SELECT ticker, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM (SELECT ticker, exp(s / n * 252) - exp(b / n * 252) AS x FROM {_sums(PAIRS, {'s': 'ln(1 + ret)', 'b': 'ln(1 + bench)'})}) GROUP BY 1) USING (ticker)"""


@query(f"SELECT ticker, round(diff, 6) AS diff, round(lo, 6) AS diff_low, round(hi, 6) AS diff_high, {_VERDICT.format('lo', 'hi', 0.02)} AS verdict FROM ({_GROWTH})")
def i5_growth_interval(spark, sf):
    return inference.growth_interval(pairs(spark, sf), BY).select("ticker", *[r6(c, c) for c in ("diff", "diff_low", "diff_high")], "verdict")


_COMMON = f"(SELECT * FROM {PAIRS} WHERE d IN (SELECT d FROM {PAIRS} GROUP BY d HAVING count(*) = 2))"


@query(f"""WITH p AS (SELECT ticker, {_SHARPE.format('ret')} AS strategy, {_SHARPE.format('bench')} AS benchmark FROM {_COMMON} GROUP BY 1),
 r AS (SELECT ticker, rep, {_sharpe('s', 'ss')} - {_sharpe('b', 'bb')} AS boot FROM {_sums(_COMMON, _PAIR)}),
 h AS (SELECT quantile_cont(dev, 0.9) AS half FROM (SELECT rep, max(abs(boot - (strategy - benchmark))) AS dev FROM r JOIN p USING (ticker) GROUP BY rep))
 SELECT ticker, round(strategy - benchmark, 6) AS diff, round(half, 6) AS half, round(strategy - benchmark - half, 6) AS low, round(strategy - benchmark + half, 6) AS high FROM p, h""")
def i6_simultaneous_intervals(spark, sf):
    return inference.simultaneous_intervals(pairs(spark, sf), "ticker").select("ticker", *[r6(c, c) for c in ("diff", "half", "low", "high")])


@query()
def i7_drawdown_interval(spark, sf):
    """Interval of the largest drawdown, which depends on the order of the drawn days."""

    def drawdown(r):
        level = np.cumprod(1 + r)
        return (level / np.maximum.accumulate(level) - 1).min()

    got = inference.metric_interval(_rets(spark, sf), BY, drawdown)
    return got.select("ticker", r6("low", "low"), r6("high", "high"))


_HOLM = "least(1.0, max(p * (m - k + 1)) OVER (ORDER BY p, ticker ROWS UNBOUNDED PRECEDING))"
_GATED = f"""WITH t AS ({_tested(_sharpe("s", "ss"), _sums(_CENTRED, {"s": "x", "ss": "x * x"}), _SHARPE.format("x"), _EXCESS).replace('round((1 + ge) / (reps + 1), 6) AS p_upper', '(1 + ge) / (reps + 1) AS p')}),
 k AS (SELECT ticker, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, ticker) AS k FROM t), a AS (SELECT ticker, p, {_HOLM} AS holm FROM k)"""


def _gate(spark, sf):
    """Test, interval and adjusted p of every strategy, in one job."""
    both = pairs(spark, sf)
    tests = inference.centred_test(both, BY).select("ticker", F.col("p_upper").alias("p"), F.lit(0).alias("family"), F.col("ticker").alias("test"))
    adjusted = evaluate.holm(tests, ["family"], "p", "holm").select("ticker", "p", "holm")
    return inference.sharpe_interval(both, BY).join(adjusted, "ticker")


@query(f"""{_GATED} SELECT ticker, round(excess, 6) AS excess, round(p, 6) AS p, round(holm, 6) AS holm, round(elo, 6) AS excess_low, excess > 0.2 AND holm < 0.05 AND elo > 0 AS passed
 FROM a JOIN {_POINT} USING (ticker) JOIN {_CI} USING (ticker)""")
def i10_gate(spark, sf):
    got = _gate(spark, sf).withColumn("passed", inference.strict_gate(F.col("excess"), F.col("holm"), F.col("excess_low")))
    return got.select("ticker", *[r6(c, c) for c in ("excess", "p", "holm", "excess_low")], "passed")


@query(f"SELECT grp, yr, round(excess, 6) AS excess, round(p, 6) AS p, excess > 0.2 AND p < 0.05 AND low > 0 AS passed, excess > 0.6 AND low > 0 AND same AND diff > 0 AS elevated FROM (SELECT grp, yr, avg(p) AS excess, avg(y) / 5 AS p, min(p) - 0.01 AS low, max(p) > 0.9 AS same, avg(p - fair) AS diff FROM {PROBABILITIES} GROUP BY 1, 2)")
def i9_i12_gates(spark, sf):
    df = probabilities(spark, sf).groupBy("grp", "yr").agg(F.avg("p").alias("excess"), (F.avg("y") / 5).alias("p"), (F.min("p") - 0.01).alias("low"), (F.max("p") > 0.9).alias("same"), F.avg(F.col("p") - F.col("fair")).alias("diff"))
    gate = inference.strict_gate(F.col("excess"), F.col("p"), F.col("low"))
    return df.select("grp", "yr", r6("excess", "excess"), r6("p", "p"), gate.alias("passed"), inference.elevated(F.col("excess"), F.col("low"), F.col("same"), F.col("diff")).alias("elevated"))


@query(f"""WITH t AS ({_tested("x / n * 252", _sums(_LOGS_CENTRED, {"x": "x"}), "avg(x) * 252", _LOGS).replace('round((1 + ge) / (reps + 1), 6) AS p_upper', '(1 + ge) / (reps + 1) AS p')}),
 k AS (SELECT ticker, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, ticker) AS k FROM t), a AS (SELECT ticker, p, {_HOLM} AS holm FROM k)
 SELECT ticker, round(diff, 6) AS diff, round(holm, 6) AS holm, round(lo, 6) AS diff_low, diff > 0 AND holm < 0.05 AND lo > 0 AS passed FROM a JOIN ({_GROWTH}) USING (ticker)""")
def i11_growth_gate(spark, sf):
    both = pairs(spark, sf)
    tests = inference.growth_test(both, BY).select("ticker", F.col("p_upper").alias("p"), F.lit(0).alias("family"), F.col("ticker").alias("test"))
    got = inference.growth_interval(both, BY).join(evaluate.holm(tests, ["family"], "p", "holm").select("ticker", "holm"), "ticker")
    passed = inference.strict_gate(F.col("diff"), F.col("holm"), F.col("diff_low"), least=0.0)
    return got.select("ticker", r6("diff", "diff"), r6("holm", "holm"), r6("diff_low", "diff_low"), passed.alias("passed"))


_COSTS = f"(SELECT ticker || '/' || bps AS ticker, d, ret - 12 * bps / 10000.0 / 252 AS ret, bench FROM {PAIRS}, (VALUES (0), (5), (20)) c(bps))"


@query(f"""WITH r AS (SELECT ticker, {_sharpe('(s - b)', '(ss + bb - 2 * sb)')} AS excess FROM {_sums(_COSTS, _PAIR)})
 SELECT ticker, round(excess, 6) AS excess, round(lo, 6) AS excess_low, round(hi, 6) AS excess_high FROM (SELECT ticker, {_SHARPE.format('(ret - bench)')} AS excess FROM {_COSTS} GROUP BY 1) JOIN (SELECT ticker, quantile_cont(excess, 0.05) AS lo, quantile_cont(excess, 0.95) AS hi FROM r GROUP BY 1) USING (ticker)""")
def i14_cost_levels(spark, sf):
    levels = pairs(spark, sf).withColumn("bps", F.explode(F.array(F.lit(0), F.lit(5), F.lit(20))))
    costed = levels.select(F.concat_ws("/", "ticker", "bps").alias("ticker"), "d", (F.col("ret") - 12 * F.col("bps") / 10000.0 / 252).alias("ret"), "bench")
    return inference.sharpe_interval(costed, BY).select("ticker", r6("excess", "excess"), r6("excess_low", "excess_low"), r6("excess_high", "excess_high"))


_CELLS = f"(SELECT ticker || '/' || CASE WHEN d < DATE '1998-01-01' THEN 'pre' ELSE 'post' END AS ticker, d, ret, bench FROM {PAIRS})"
_CELL_X = f"(SELECT ticker, d, ret - bench AS x FROM {_CELLS})"
_CELL_C = f"(SELECT ticker, d, x - avg(x) OVER (PARTITION BY ticker) AS x FROM {_CELL_X})"


@query(f"""WITH t AS ({_tested(_sharpe("s", "ss"), _sums(_CELL_C, {"s": "x", "ss": "x * x"}), _SHARPE.format("x"), _CELL_X).replace('round((1 + ge) / (reps + 1), 6) AS p_upper', '(1 + ge) / (reps + 1) AS p')}),
 k AS (SELECT ticker, observed, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, ticker) AS k FROM t)
 SELECT ticker, observed, round(p, 6) AS p, round({_HOLM}, 6) AS holm FROM k""")
def i13_regime_cells(spark, sf):
    cells = pairs(spark, sf).withColumn("ticker", F.concat_ws("/", "ticker", F.when(F.col("d") < F.lit("1998-01-01").cast("date"), "pre").otherwise("post")))
    tests = inference.centred_test(cells, BY).select("ticker", r6("observed", "observed"), F.col("p_upper").alias("p"), F.lit(0).alias("family"), F.col("ticker").alias("test"))
    return evaluate.holm(tests, ["family"], "p", "holm").select("ticker", "observed", r6("p", "p"), r6("holm", "holm"))


@query(f"SELECT ticker, round(mean, 6) AS mean, round(lo, 6) AS mean_low, round(hi, 6) AS mean_high FROM (SELECT ticker, avg(x) * 252 AS mean FROM {_LOGS} GROUP BY 1) JOIN (SELECT ticker, quantile_cont(x / n * 252, 0.05) AS lo, quantile_cont(x / n * 252, 0.95) AS hi FROM {_sums(_LOGS, {'x': 'x'})} GROUP BY 1) USING (ticker)")
def i18_log_excess(spark, sf):
    return inference.log_excess_interval(pairs(spark, sf), BY).select("ticker", *[r6(c, c) for c in ("mean", "mean_low", "mean_high")])


@query(f"SELECT ticker, d, round(ret - avg(ret) OVER w + avg(bench) OVER w, 6) AS ret FROM {PAIRS} WINDOW w AS (PARTITION BY ticker)")
def i20_mean_shift(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("ticker")
    return pairs(spark, sf).select("ticker", "d", r6(F.col("ret") - F.avg("ret").over(w) + F.avg("bench").over(w), "ret"))


@query(f"SELECT grp, round(min(fair), 6) AS mde FROM (SELECT grp, fair, avg(p) AS power FROM {PROBABILITIES} GROUP BY 1, 2) WHERE power >= 0.45 GROUP BY grp")
def i25_detectable_effect(spark, sf):
    powers = probabilities(spark, sf).groupBy("grp", "fair").agg(F.avg("p").alias("power"))
    return powers.where("power >= 0.45").groupBy("grp").agg(r6(F.min("fair"), "mde"))


_MIX = f"(SELECT ticker, d, 0.6 * ret + 0.4 * bench - 0.0001 AS ret, bench - 0.0001 AS bench FROM {PAIRS})"


@query(f"SELECT ticker, round(quantile_cont(diff, 0.05), 6) AS diff_low, round(quantile_cont(diff, 0.95), 6) AS diff_high FROM (SELECT ticker, {_sharpe('s', 'ss')} - {_sharpe('b', 'bb')} AS diff FROM {_sums(_MIX, _PAIR)}) GROUP BY 1")
def i17_mix_difference(spark, sf):
    mix = pairs(spark, sf).select("ticker", "d", (0.6 * F.col("ret") + 0.4 * F.col("bench") - 0.0001).alias("ret"), (F.col("bench") - 0.0001).alias("bench"))
    return inference.sharpe_interval(mix, BY).select("ticker", r6("diff_low", "diff_low"), r6("diff_high", "diff_high"))


@query()
def i21_resampled_paths(spark, sf):
    """Terminal value, growth and drawdown of each series and of a half-and-half mix over resampled days, drawn jointly."""
    got = inference.resamples(pairs(spark, sf), BY, ["ret", "bench"], inference.REPS)
    terminal = lambda c: F.aggregate(c, F.lit(1.0), lambda v, r: v * (1 + r))
    worst = lambda c: F.aggregate(c, F.struct(F.lit(1.0).alias("v"), F.lit(1.0).alias("top"), F.lit(0.0).alias("dd")), lambda a, r: F.struct(
        (a["v"] * (1 + r)).alias("v"), F.greatest(a["top"], a["v"] * (1 + r)).alias("top"), F.least(a["dd"], a["v"] * (1 + r) / F.greatest(a["top"], a["v"] * (1 + r)) - 1).alias("dd")))["dd"]
    paths = got.select("ticker", "rep", F.size("ret").alias("n"), terminal("ret").alias("terminal"), worst("ret").alias("max_dd"), terminal("bench").alias("bench_terminal"), worst("bench").alias("bench_dd"))
    return paths.withColumn("cagr", F.pow("terminal", 252 / F.col("n")) - 1)


@query()
def i22_path_percentiles(spark, sf):
    shares = [0.05, 0.25, 0.5, 0.75, 0.95]
    return i21_resampled_paths(spark, sf).groupBy("ticker").agg(*[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in ("terminal", "cagr", "max_dd")])


@query()
def i23_head_to_head(spark, sf):
    """How often a series ends above its benchmark, and with a smaller drawdown, over the same paths."""
    paths = i21_resampled_paths(spark, sf)
    return paths.groupBy("ticker").agg(F.count("*").alias("paths"), F.avg((F.col("terminal") > F.col("bench_terminal")).cast("double")).alias("ahead"), F.avg((F.col("max_dd") > F.col("bench_dd")).cast("double")).alias("shallower"))
