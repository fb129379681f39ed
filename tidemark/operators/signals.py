"""Signals, states and weights over long price and return tables, all from rows before the one they act on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def series():
    return W.partitionBy("ticker").orderBy("d")


def lagged_flag(df: DataFrame, flag: Column, out: str) -> DataFrame:
    """A flag as it was on the row before; unknown is 0."""
    return df.withColumn("_f", flag.cast("int")).withColumn(out, F.coalesce(F.lag("_f").over(series()), F.lit(0))).drop("_f")


def full(value: str, w: int, figure) -> Column:
    """A figure over the last w rows, itself among them; null before there are w."""
    frame = series().rowsBetween(1 - w, 0)
    return F.when(F.count(value).over(frame) == w, figure.over(frame))


def calm(df: DataFrame, short: int = 63, long: int = 252, times: float = 1.5, out: str = "calm") -> DataFrame:
    """1 where short-term deviation was below so many times its own long-term median on the row before, and on a series' first row; both need half their rows."""
    half = lambda value, w, figure: F.when(F.count(value).over(series().rowsBetween(1 - w, 0)) >= w // 2, figure.over(series().rowsBetween(1 - w, 0)))
    df = df.withColumn("_s", half("ret", short, F.stddev_samp("ret")))
    df = df.withColumn("_m", half("_s", long, F.percentile("_s", F.lit(0.5))))
    df = df.withColumn("_f", F.coalesce((F.col("_s") < times * F.col("_m")).cast("int"), F.lit(0)))
    return df.withColumn(out, F.coalesce(F.lag("_f").over(series()), F.lit(1))).drop("_s", "_m", "_f")


def spurious(df: DataFrame, most: float = 1.0) -> Column:
    """Whether a price jumps by more than `most` to or from its neighbour, both ways counted; unknown is no."""
    move = lambda a, b: F.abs(F.try_divide(a, b) - 1) > most
    px = F.col("px")
    return F.coalesce(move(px, F.lag("px").over(series())), F.lit(False)) | F.coalesce(move(F.lead("px").over(series()), px), F.lit(False))


def every_kth(df: DataFrame, flag: str, k: int, out: str) -> DataFrame:
    """The flag of every k-th row, held until the next and acting a row later; 0 before the first."""
    at = F.when((F.row_number().over(series()) - 1) % k == 0, F.col(flag))
    held = df.withColumn("_at", at).withColumn("_h", F.last("_at", ignorenulls=True).over(series().rowsBetween(W.unboundedPreceding, 0)))
    return held.withColumn(out, F.coalesce(F.lag("_h").over(series()), F.lit(0))).drop("_at", "_h")


def flips(df: DataFrame, flag: str) -> DataFrame:
    """(ticker, n, up, down, flips_per_year): how often a 0/1 flag turns on from 0, off from 1, and at all."""
    df = df.withColumn("_p", F.lag(flag).over(series())).where("_p is not null")
    rate = lambda a, b: F.avg(F.when(F.col("_p") == a, (F.col(flag) == b).cast("double")))
    turns = F.sum((F.col(flag) != F.col("_p")).cast("int"))
    return df.groupBy("ticker").agg(F.count("*").alias("n"), rate(0, 1).alias("up"), rate(1, 0).alias("down"), (turns * 252 / F.count("*")).alias("flips_per_year"))


def by_state(pairs: DataFrame, state: Column, least: int = 20) -> DataFrame:
    """(ticker, state, n, excess, sharpe, share) of ret over bench in each state with at least so many rows."""
    x = F.col("ret") - F.col("bench")
    got = pairs.groupBy("ticker", state.alias("state")).agg(F.count("*").alias("n"), (F.avg(x) * 252).alias("excess"), (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(252))).alias("sharpe"))
    return got.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("ticker"))).where(F.col("n") >= least)


def trailing(df: DataFrame, k: int) -> Column:
    """Return over k rows that ends on the row before."""
    return F.try_divide(F.lag("px", 1).over(series()), F.lag("px", k).over(series())) - 1


def picked(df: DataFrame, score: str, k: int, positive: bool = True) -> DataFrame:
    """df with `w` = 1 / number picked for the k best scores of each day (those above 0 only), others left out."""
    rank = F.row_number().over(W.partitionBy("d").orderBy(F.desc(score), "ticker"))
    kept = df.where(F.col(score).isNotNull()).withColumn("_k", rank).where(F.col("_k") <= k)
    kept = kept.where(F.col(score) > 0) if positive else kept
    return kept.withColumn("w", 1 / F.count("*").over(W.partitionBy("d"))).drop("_k")


def dual_momentum(scores: DataFrame, home: str, abroad: str, refuge: str) -> DataFrame:
    """(d, ticker, w): the better of two by trailing return, if above 0, else the refuge; home where any of them has no history yet."""
    pick = lambda t: F.max(F.when(F.col("ticker") == t, F.col("score")))
    days = scores.groupBy("d").agg(pick(home).alias("h"), pick(abroad).alias("a"), pick(refuge).alias("r"))
    best = F.when(F.col("h").isNull() | F.col("a").isNull() | F.col("r").isNull(), home).when(F.col("h") > F.col("a"), F.when(F.col("h") > 0, home).otherwise(refuge)).otherwise(F.when(F.col("a") > 0, abroad).otherwise(refuge))
    return days.select("d", best.alias("ticker"), F.lit(1.0).alias("w"))


def ranks_around_zero(df: DataFrame, feature: str, out: str, tail: float = 0.01) -> DataFrame:
    """A day's values, cut at their 1st and 99th percentiles, as ranks from -0.5 to 0.5 (ties share the mean rank); null is 0."""
    day = W.partitionBy("d")
    low, high = (F.percentile(feature, F.lit(q)).over(day) for q in (tail, 1 - tail))
    df = df.withColumn("_x", F.when(F.col(feature).isNotNull(), F.least(F.greatest(F.col(feature), low), high)))
    n, ties = F.count("_x").over(day), F.count("_x").over(W.partitionBy("d", "_x"))
    place = F.rank().over(W.partitionBy("d").orderBy(F.col("_x").asc_nulls_last())) + (ties - 1) / 2
    return df.withColumn(out, F.when(F.col("_x").isNull() | (n < 2), 0.0).otherwise((place - 1) / (n - 1) - 0.5)).drop("_x")


def overlaid(parts: DataFrame, key: list[str], value: str, rank: str) -> DataFrame:
    """One row a key: the value of the source of least rank that has one."""
    return parts.where(F.col(value).isNotNull()).groupBy(*key).agg(F.min_by(value, rank).alias(value), F.min(rank).alias(rank))
