"""Stationary block bootstrap and what is inferred from it, as joins and grouped sums.

A replicate is a list of blocks of geometric length on a circle of n positions. Every statistic here is a function of sums
over the drawn positions, so a block contributes the difference of two prefix sums: the work grows with the
blocks, not with the positions. Draws come from md5 of (seed, replicate, block), so a lost task draws them again, all
series of one length share them, and any engine can repeat them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .portfolio import YEAR

REPS = 10_000
MEAN_BLOCK = 22
TINY = 1e-10
#: Series rows that are broadcast to the blocks (some MB); more are joined by a shuffle.
SMALL = 200_000


def positions(series: DataFrame, by: list[str]) -> DataFrame:
    """series with `pos` 0 ... n - 1 in order of d, and `n`."""
    return series.withColumn("pos", F.row_number().over(W.partitionBy(*by).orderBy("d")) - 1).withColumn("n", F.count("*").over(W.partitionBy(*by)))


def block_draws(lengths: DataFrame, reps: int = REPS, mean_block: int = MEAN_BLOCK, seed: int = 42) -> DataFrame:
    """(n, rep, before, start, size) of the blocks of every replicate for each n of lengths (n): sizes add up to n.

    So many blocks are drawn that they all but always suffice; the last one is as long as it must be.
    """
    expected = F.col("n") / mean_block
    blocks = F.ceil(expected + 6 * F.sqrt(expected) + 12).cast("int")
    drawn = lengths.select("n", blocks.alias("last"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).repartition("rep")
    drawn = drawn.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("last")))).withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), "rep", "k")))
    u, v = (F.conv(F.substring("h", at, 8), 16, 10).cast("double") / float(1 << 32) for at in (1, 9))
    size = 1 + F.floor(F.log(u + 0.5 / (1 << 32)) / np.log(1 - 1 / mean_block))
    drawn = drawn.withColumn("start", F.floor(v * F.col("n"))).withColumn("size", size.cast("long"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("n", "rep").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    drawn = drawn.withColumn("before", before).where(F.col("before") < F.col("n"))
    room = F.col("n") - F.col("before")
    return drawn.select("n", "rep", "before", "start", F.when(F.col("k") == F.col("last"), room).otherwise(F.least("size", room)).alias("size"))


def block_sums(series: DataFrame, by: list[str], values: list[str], draws: DataFrame | None = None, **how) -> DataFrame:
    """(by, rep, n, values): each value's sum over the positions that a replicate draws from (by, pos, n, values)."""
    draws = block_draws(series.select("n").distinct(), **how) if draws is None else draws
    end = F.col("start") + F.col("size")
    ends = F.array(F.struct(F.least(end, F.col("n")).alias("at"), F.lit(1).alias("sign")), F.struct(F.col("start").alias("at"), F.lit(-1).alias("sign")), F.struct(F.greatest(end - F.col("n"), F.lit(0)).alias("at"), F.lit(1).alias("sign")))
    ends = draws.select("n", "rep", F.explode(ends).alias("e")).select("n", "rep", "e.at", "e.sign").where("at > 0")
    upto = W.partitionBy(*by).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    sums = series.select(*by, "n", (F.col("pos") + 1).alias("at"), *[F.sum(v).over(upto).alias(v) for v in values])
    if series.limit(SMALL + 1).count() <= SMALL:
        sums = F.broadcast(sums)
    return ends.join(sums, ["n", "at"]).groupBy(*by, "rep", "n").agg(*[F.sum(F.col("sign") * F.col(v)).alias(v) for v in values])


def sharpe(total: Column, squares: Column, n: Column, periods: int = YEAR) -> Column:
    """Mean over population deviation, a year's, from a sum and a sum of squares."""
    return total / n / F.greatest(F.sqrt(F.greatest(squares / n - F.pow(total / n, 2), F.lit(0.0))), F.lit(TINY)) * F.sqrt(F.lit(periods))


def bootstrap_sharpe(rets: DataFrame, by: list[str], **how) -> DataFrame:
    """(by, rep, sharpe) of (by, d, ret)."""
    sums = block_sums(positions(rets, by).withColumn("rr", F.col("ret") * F.col("ret")), by, ["ret", "rr"], **how)
    return sums.select(*by, "rep", sharpe(F.col("ret"), F.col("rr"), F.col("n")).alias("sharpe"))


def _observed(rets: DataFrame, by: list[str], **figures: Column) -> DataFrame:
    return rets.groupBy(*by).agg(F.count("*").alias("n"), *[c.alias(name) for name, c in figures.items()])


def _group_sharpe(x: Column, periods: int = YEAR) -> Column:
    return F.avg(x) / F.greatest(F.stddev_pop(x), F.lit(TINY)) * F.sqrt(F.lit(periods))


def _p_values(null: DataFrame, by: list[str], stat: str, observed: DataFrame) -> DataFrame:
    met = null.join(observed.select(*by, "observed"), by).groupBy(*by).agg(
        F.count("*").alias("reps"), F.first("observed").alias("observed"), F.sum((F.col(stat) >= F.col("observed")).cast("long")).alias("ge"), F.sum((F.col(stat) <= F.col("observed")).cast("long")).alias("le"), F.avg(stat).alias("null_mean"), F.stddev_pop(stat).alias("null_std"),
    )
    upper, lower = ((1 + F.col(c)) / (F.col("reps") + 1) for c in ("ge", "le"))
    met = met.withColumn("p_upper", upper).withColumn("p_lower", lower)
    return met.withColumn("p_two_sided", F.least(F.lit(1.0), 2 * F.least("p_upper", "p_lower"))).withColumn("p_mc_se", F.sqrt(F.col("p_upper") * (1 - F.col("p_upper")) / F.col("reps"))).drop("ge", "le")


def centred_test(pairs: DataFrame, by: list[str], **how) -> DataFrame:
    """Whether the Sharpe ratio of ret - bench is above that of centred resamples: observed, p_upper, p_lower, p_two_sided, p_mc_se."""
    x = pairs.select(*by, "d", (F.col("ret") - F.col("bench")).alias("ret"))
    observed = _observed(x, by, observed=_group_sharpe(F.col("ret")))
    centred = x.withColumn("ret", F.col("ret") - F.avg("ret").over(W.partitionBy(*by)))
    return _p_values(bootstrap_sharpe(centred, by, **how), by, "sharpe", observed)


def growth_test(pairs: DataFrame, by: list[str], **how) -> DataFrame:
    """Whether mean log growth over the benchmark's, a year's, is above that of centred resamples."""
    x = pairs.select(*by, "d", (F.log1p("ret") - F.log1p("bench")).alias("x"))
    observed = _observed(x, by, observed=F.avg("x") * YEAR)
    centred = positions(x.withColumn("x", F.col("x") - F.avg("x").over(W.partitionBy(*by))), by)
    null = block_sums(centred, by, ["x"], **how).select(*by, (F.col("x") / F.col("n") * YEAR).alias("stat"))
    return _p_values(null, by, "stat", observed)


def _verdict(low: Column, high: Column, strong: float) -> Column:
    return F.when(low > strong, "STRONG_EDGE").when(low > 0, "WEAK_EDGE").when(high > strong, "INCONCLUSIVE_POSITIVE").when(high > 0, "INCONCLUSIVE").otherwise("NEGATIVE")


def _interval(reps: DataFrame, by: list[str], stat: str, confidence: float) -> list[Column]:
    tail = (1 - confidence) / 2
    return [F.percentile(stat, F.lit(tail)).alias(f"{stat}_low"), F.percentile(stat, F.lit(1 - tail)).alias(f"{stat}_high")]  # a value a replicate


def _pair_sums(pairs: DataFrame, by: list[str], **how) -> DataFrame:
    s, b = F.col("ret"), F.col("bench")
    rows = positions(pairs.select(*by, "d", s.alias("s"), b.alias("b"), (s * s).alias("ss"), (b * b).alias("bb"), (s * b).alias("sb")), by)
    return block_sums(rows, by, ["s", "b", "ss", "bb", "sb"], **how)


def sharpe_interval(pairs: DataFrame, by: list[str], confidence: float = 0.90, periods: int = YEAR, **how) -> DataFrame:
    """Paired resamples' interval of Sharpe(ret) - Sharpe(bench) and of Sharpe(ret - bench), with the points and a verdict."""
    n, s, b = F.col("n"), F.col("s"), F.col("b")
    reps = _pair_sums(pairs, by, **how)
    reps = reps.select(*by, (sharpe(s, F.col("ss"), n, periods) - sharpe(b, F.col("bb"), n, periods)).alias("diff"), sharpe(s - b, F.col("ss") + F.col("bb") - 2 * F.col("sb"), n, periods).alias("excess"))
    got = reps.groupBy(*by).agg(*_interval(reps, by, "diff", confidence), *_interval(reps, by, "excess", confidence))
    point = _observed(pairs, by, strategy=_group_sharpe(F.col("ret"), periods), benchmark=_group_sharpe(F.col("bench"), periods), excess=_group_sharpe(F.col("ret") - F.col("bench"), periods))
    met = point.withColumn("diff", F.col("strategy") - F.col("benchmark")).join(got, by)
    return met.withColumn("excludes_zero", (F.col("diff_low") > 0) | (F.col("diff_high") < 0)).withColumn("verdict", _verdict(F.col("diff_low"), F.col("diff_high"), 0.10))


def growth_interval(pairs: DataFrame, by: list[str], confidence: float = 0.90, **how) -> DataFrame:
    """Paired resamples' interval of the difference of yearly growth, with the point and a verdict. A series with a total loss among its drawn days has grown by -1."""
    log = lambda c: F.when(F.col(c) > -1, F.log1p(c)).otherwise(0.0)
    lost = lambda c: (F.col(c) <= -1).cast("double")
    rows = positions(pairs.select(*by, "d", log("ret").alias("s"), log("bench").alias("b"), lost("ret").alias("zs"), lost("bench").alias("zb")), by)
    reps = block_sums(rows, by, ["s", "b", "zs", "zb"], **how)
    yearly = lambda c: F.when(F.col(f"z{c}") > 0.5, -1.0).otherwise(F.expm1(F.col(c) / F.col("n") * YEAR))
    reps = reps.select(*by, (yearly("s") - yearly("b")).alias("diff"))
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("s", "b", "zs", "zb")])
    point = sums.select(*by, "n", (yearly("s") - yearly("b")).alias("diff"))
    return point.join(reps.groupBy(*by).agg(*_interval(reps, by, "diff", confidence)), by).withColumn("verdict", _verdict(F.col("diff_low"), F.col("diff_high"), 0.02))


def log_excess_interval(pairs: DataFrame, by: list[str], confidence: float = 0.90, **how) -> DataFrame:
    """Mean log excess, a year's, and its interval."""
    rows = positions(pairs.select(*by, "d", (F.log1p("ret") - F.log1p("bench")).alias("x")), by)
    reps = block_sums(rows, by, ["x"], **how).select(*by, (F.col("x") / F.col("n") * YEAR).alias("mean"))
    return _observed(rows, by, mean=F.avg("x") * YEAR).join(reps.groupBy(*by).agg(*_interval(reps, by, "mean", confidence)), by)


def simultaneous_intervals(pairs: DataFrame, name: str, confidence: float = 0.90, **how) -> DataFrame:
    """Intervals of Sharpe differences that hold together: half as wide as the largest deviation over the series in a replicate, at its quantile.

    Only days that all series have; the series share each replicate's draws.
    """
    k = pairs.select(name).distinct().count()
    days = pairs.groupBy("d").agg(F.count("*").alias("_k")).where(F.col("_k") == k).select("d")
    rows = pairs.join(days, "d")
    n = F.col("n")
    point = _observed(rows, [name], strategy=_group_sharpe(F.col("ret")), benchmark=_group_sharpe(F.col("bench"))).withColumn("diff", F.col("strategy") - F.col("benchmark")).drop("n")
    reps = _pair_sums(rows, [name], **how).select(name, "rep", (sharpe(F.col("s"), F.col("ss"), n) - sharpe(F.col("b"), F.col("bb"), n)).alias("boot"))
    widest = reps.join(point, name).groupBy("rep").agg(F.max(F.abs(F.col("boot") - F.col("diff"))).alias("dev"))
    half = widest.agg(F.percentile("dev", F.lit(confidence)).alias("half"))
    return point.crossJoin(F.broadcast(half)).withColumn("low", F.col("diff") - F.col("half")).withColumn("high", F.col("diff") + F.col("half"))  # half is one row


def resamples(series: DataFrame, by: list[str], columns: list[str], reps: int, mean_block: int = MEAN_BLOCK, seed: int = 42) -> DataFrame:
    """(by, rep, columns as arrays of n): the drawn rows themselves, a replicate a row, for figures that depend on their order.

    A task holds one series and one replicate at a time.
    """
    rows = positions(series, by)
    whole = rows.groupBy(*by, "n").agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("rows"))
    whole = whole.select(*by, "n", *[F.transform("rows", _field(c)).alias(c) for c in columns])  # before the join, once a series
    blocks = block_draws(rows.select("n").distinct(), reps, mean_block, seed).groupBy("n", "rep").agg(F.array_sort(F.collect_list(F.struct("before", "start", "size"))).alias("blocks"))
    at = F.flatten(F.transform("blocks", lambda b: F.transform(F.sequence(F.lit(0), b["size"] - 1), lambda i: (b["start"] + i) % F.col("n"))))
    met = blocks.join(F.broadcast(whole) if rows.limit(SMALL + 1).count() <= SMALL else whole, "n").withColumn("at", at)
    return met.select(*by, "rep", *[F.transform("at", _picked(c)).alias(c) for c in columns])


def _picked(name: str):
    return lambda i: F.get(F.col(name), i.cast("int"))


def _field(name: str):
    return lambda row: row[name]


def metric_interval(rets: DataFrame, by: list[str], metric, reps: int = REPS, confidence: float = 0.95, **how) -> DataFrame:
    """(by, low, high) of any metric(np.ndarray) -> float over resamples of ret."""

    drawn = resamples(rets, by, ["ret"], reps, **how)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[by].assign(m=[float(metric(np.asarray(r, float))) for r in batch["ret"]])

    got = drawn.mapInPandas(measured, ", ".join(f"{c} {drawn.schema[c].dataType.simpleString()}" for c in by) + ", m double")
    tail = (1 - confidence) / 2
    return got.groupBy(*by).agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))


def strict_gate(excess: Column, holm_p: Column, low: Column, least: float = 0.20, most_p: float = 0.05) -> Column:
    """All of: excess Sharpe above `least`, adjusted p below `most_p`, interval above zero."""
    return (excess > least) & (holm_p < most_p) & (low > 0)


def elevated(excess: Column, low: Column, same_sign: Column, diff: Column, least: float = 0.60) -> Column:
    """All of: excess Sharpe above `least`, interval above zero, sub-periods of one sign, a positive Sharpe difference."""
    return (excess > least) & (low > 0) & same_sign & (diff > 0)


def least_vol_weight(pairs: DataFrame, by: list[str], grid: list[float], band: tuple[float, float], **how) -> DataFrame:
    """(by, weight, vol, in_band, reps, mean, in_band_share): the weight of ret in a mix with bench that has the least deviation, and where resamples have it.

    Of equal deviations the smaller weight counts. Every replicate's deviations come from the sums of its blocks.
    """
    from .regress import mixed_vol

    sums = [F.col(c) for c in ("s", "b", "ss", "bb", "sb", "n")]
    best = lambda: F.array_min(F.array(*[F.struct(mixed_vol(*sums, w).alias("vol"), F.lit(w).alias("weight")) for w in sorted(grid)]))
    inside = lambda c: (c >= band[0]) & (c <= band[1])
    whole = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum("bench").alias("b"), F.sum(F.col("ret") * F.col("ret")).alias("ss"), F.sum(F.col("bench") * F.col("bench")).alias("bb"), F.sum(F.col("ret") * F.col("bench")).alias("sb"))
    point = whole.withColumn("m", best()).select(*by, "m.weight", "m.vol", inside(F.col("m.weight")).alias("in_band"))
    drawn = _pair_sums(pairs, by, **how).withColumn("m", best()).groupBy(*by).agg(F.count("*").alias("reps"), F.avg("m.weight").alias("mean"), F.avg(inside(F.col("m.weight")).cast("double")).alias("in_band_share"))
    return point.join(drawn, by)


def publication_decay(rets: DataFrame, by: list[str], published: Column, least: int = YEAR, confidence: float = 0.90, seed: int = 42, **how) -> DataFrame:
    """(by, n_pre, n_post, pre, post, decay, diff, diff_low, diff_high): Sharpe ratios before a date and from it on, and the interval of their difference.

    The two samples are drawn separately (seed and seed + 1). Figures are null where a sample has fewer than `least` rows.
    """
    parts = {name: rets.where(cond).select(*by, "d", "ret") for name, cond in (("pre", F.col("d") < published), ("post", F.col("d") >= published))}
    enough = {name: df.withColumn("_n", F.count("*").over(W.partitionBy(*by))).where(F.col("_n") >= least).drop("_n") for name, df in parts.items()}
    reps = {name: bootstrap_sharpe(df, by, seed=seed + i, **how).select(*by, "rep", F.col("sharpe").alias(name)) for i, (name, df) in enumerate(enough.items())}
    both = reps["pre"].join(reps["post"], [*by, "rep"]).select(*by, (F.col("pre") - F.col("post")).alias("diff"))
    counts = rets.groupBy(*by).agg(F.count(F.when(F.col("d") < published, 1)).alias("n_pre"), F.count(F.when(F.col("d") >= published, 1)).alias("n_post"))
    point = {name: _observed(df, by, **{name: _group_sharpe(F.col("ret"))}).drop("n") for name, df in enough.items()}
    met = counts.join(point["pre"].join(point["post"], by), by, "left").join(both.groupBy(*by).agg(*_interval(both, by, "diff", confidence)), by, "left")
    return met.withColumn("decay", F.when(F.abs("pre") > 1e-6, 1 - F.col("post") / F.col("pre")).otherwise(F.when(F.col("pre").isNotNull(), 0.0))).withColumn("diff", F.col("pre") - F.col("post"))


def max_drawdown(returns: Column) -> Column:
    """The deepest fall of an array of returns below its own peak, start included: a fold that keeps the value, its peak and the fall."""
    start = F.struct(F.lit(1.0).alias("v"), F.lit(1.0).alias("top"), F.lit(0.0).alias("dd"))
    moved = lambda a, r: F.struct((a["v"] * (1 + r)).alias("v"), F.greatest(a["top"], a["v"] * (1 + r)).alias("top"), F.least(a["dd"], a["v"] * (1 + r) / F.greatest(a["top"], a["v"] * (1 + r)) - 1).alias("dd"))
    return F.aggregate(returns, start, moved)["dd"]


def drawdown_interval(pairs: DataFrame, by: list[str], confidence: float = 0.90, reps: int = 5_000, **how) -> DataFrame:
    """(by, point, low, high, share_shallower): by how much ret falls less than bench at worst, as observed and over paired resamples of the days."""
    drawn = resamples(pairs, by, ["ret", "bench"], reps, **how).select(*by, (max_drawdown(F.col("ret")) - max_drawdown(F.col("bench"))).alias("diff"))
    whole = pairs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("d", "ret", "bench"))).alias("_r"))  # a series' own days
    point = whole.select(*by, (max_drawdown(F.transform("_r", lambda r: r["ret"])) - max_drawdown(F.transform("_r", lambda r: r["bench"]))).alias("point"))
    tail = (1 - confidence) / 2
    spread = drawn.groupBy(*by).agg(F.percentile("diff", F.lit(tail)).alias("low"), F.percentile("diff", F.lit(1 - tail)).alias("high"), F.avg((F.col("diff") > 0).cast("double")).alias("share_shallower"))
    return point.join(spread, by)


def random_timing(rets: DataFrame, by: list[str], exposure: str, bill: float = 0.0, sims: int = 1_000, seed: int = 42) -> DataFrame:
    """(by, exposure, observed, sims, null_mean, null_std, p_upper): the Sharpe ratio of timed minus held returns against that of as many random timings of equal mean exposure.

    A random timing is in on each day by itself with the mean exposure as its chance, by a hash of (seed, sim, d).
    """
    x = (1 - F.col(exposure)) * (bill - F.col("ret"))
    point = rets.groupBy(*by).agg(F.avg(exposure).alias("exposure"), _group_sharpe(x).alias("observed"))
    named = point.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("exposure").alias("_p"), F.col("observed").alias("_o"))
    met = rets.join(F.broadcast(named), [rets[c].eqNullSafe(named[f"_g_{c}"]) for c in by])  # a row a series
    each = met.select(*by, "d", "ret", "_p", F.explode(F.sequence(F.lit(1), F.lit(sims))).alias("sim"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "sim", F.col("d").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    null = each.groupBy(*by, "sim").agg(_group_sharpe(F.when(u < F.col("_p"), 0.0).otherwise(bill - F.col("ret"))).alias("stat"))
    back = null.join(F.broadcast(named), [null[c].eqNullSafe(named[f"_g_{c}"]) for c in by])
    got = back.groupBy(*by).agg(F.count("*").alias("sims"), F.avg("stat").alias("null_mean"), F.stddev_pop("stat").alias("null_std"), ((1 + F.sum((F.col("stat") >= F.col("_o")).cast("long"))) / (F.count("*") + 1)).alias("p_upper"))
    return point.join(got, by)
