"""Scores of probabilities, splits, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-15


def log_loss(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))


def binary_scores(df: DataFrame, by: list[str]) -> DataFrame:
    """n, log_loss, accuracy and brier of (y, p) for each group, in one pass."""
    y, p = F.col("y"), F.col("p")
    return df.groupBy(*by).agg(F.count("*").alias("n"), log_loss(y, p).alias("log_loss"), F.avg(((p >= 0.5) == (y == 1)).cast("double")).alias("accuracy"), F.avg(F.pow(p - y, 2)).alias("brier"))


def class_scores(df: DataFrame, by: list[str]) -> DataFrame:
    """n, log_loss and accuracy of (c, q): the true class 0 ... k - 1 and an array of k probabilities; the first of equal ones is the guess."""
    true = F.greatest(F.get("q", F.col("c")), F.lit(EPS))
    guess = F.array_position("q", F.array_max("q")) - 1
    return df.groupBy(*by).agg(F.count("*").alias("n"), (-F.avg(F.log(true))).alias("log_loss"), F.avg((guess == F.col("c")).cast("double")).alias("accuracy"))


def calibration_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean p and mean y; bins are [lo, hi), the last one closed, empty ones left out."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))


def errors(df: DataFrame, by: list[str]) -> DataFrame:
    """mae, rmse and median absolute error of (y, p)."""
    off = F.abs(F.col("y") - F.col("p"))
    return df.groupBy(*by).agg(F.avg(off).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"), F.percentile(off, F.lit(0.5)).alias("median_ae"))


def flat_roi(df: DataFrame, edge: float = 0.05) -> DataFrame:
    """Bets, wins and return of one unit on every row of (p, fair, odds, y) whose p is above fair by the edge."""
    bets = df.where(F.col("p") - F.col("fair") >= edge)
    return bets.agg(F.count("*").alias("bets"), F.sum("y").alias("wins"), F.avg(F.when(F.col("y") == 1, F.col("odds") - 1).otherwise(-1.0)).alias("roi"))


def walk_forward_folds(df: DataFrame, fold: str, first: int, least_rows: int) -> DataFrame:
    """(fold, n_train, n_test): every fold value from `first` on with at least so many rows before it."""
    counts = df.groupBy(fold).agg(F.count("*").alias("n_test"))
    before = F.coalesce(F.sum("n_test").over(W.orderBy(fold).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("n_train", before).where((F.col(fold) >= first) & (F.col("n_train") >= least_rows)).select(fold, "n_train", "n_test")


def ranked_values(df: DataFrame, value: str, count=None, buckets: int = 512) -> DataFrame:
    """(value, k, below, n) for each different value that is not null: its rows (or the sum of `count`), the rows below it, and all rows.

    Values are cut in buckets by approximate quantiles; running sums go over the few buckets and inside each, so no task
    sorts them all.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(value).agg((F.count("*") if count is None else F.sum(count)).alias("k"))
    cuts = df.agg(F.array_distinct(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000)).alias("cuts"))
    per = per.crossJoin(F.broadcast(cuts)).withColumn("_b", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col(value))), F.lit(0))).drop("cuts")
    inside = F.coalesce(F.sum("k").over(W.partitionBy("_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = per.groupBy("_b").agg(F.sum("k").alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a bucket
    sums = sums.select("_b", before.alias("_before"), F.sum("_s").over(W.partitionBy(F.lit(0))).alias("n"))
    return per.withColumn("_inside", inside).join(F.broadcast(sums), "_b").select(value, "k", (F.col("_before") + F.col("_inside")).alias("below"), "n")


def quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row with `cuts`, the exact quantiles by linear interpolation, from the values' ranks."""
    ranks = ranked_values(df, value)
    at = lambda idx: F.max(F.when((F.col("below") <= idx) & (idx < F.col("below") + F.col("k")), F.col(value)))
    low = [F.floor((F.col("n") - 1) * q) for q in shares]
    picked = ranks.agg(F.max("n").alias("n"), *[at(i).alias(f"a{j}") for j, i in enumerate(low)], *[at(F.least(i + 1, F.col("n") - 1)).alias(f"b{j}") for j, i in enumerate(low)])
    cut = lambda j, q: F.col(f"a{j}") + (F.col(f"b{j}") - F.col(f"a{j}")) * ((F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q))
    return picked.select(F.array(*[cut(j, q) for j, q in enumerate(shares)]).alias("cuts"))


def psi(df: DataFrame, value: str, train: Column, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability of value: the training rows' deciles, each once, cut both samples in [a, b). One row."""
    cuts = quantiles(df.where(train), value, [k / bins for k in range(1, bins)]).select(F.array_distinct("cuts").alias("cuts"))
    placed = df.crossJoin(F.broadcast(cuts)).select(train.alias("train"), F.size(F.filter("cuts", lambda c: c <= F.col(value))).alias("bin"))
    counts = placed.groupBy("bin").agg(F.sum(F.col("train").cast("long")).alias("a"), F.sum((~F.col("train")).cast("long")).alias("b"))
    whole = W.partitionBy(F.lit(0))
    a, b = (F.greatest(F.try_divide(F.col(x), F.sum(x).over(whole)), F.lit(floor)) for x in "ab")
    return counts.select(((b - a) * F.log(b / a)).alias("x")).agg(F.sum("x").alias("psi"))


def two_sample_ks(df: DataFrame, value: str, train: Column) -> DataFrame:
    """One row (ks, n_train, n_test): the largest gap of the two samples' distribution functions."""
    one = ranked_values(df.withColumn("_w", train.cast("long")), value, F.col("_w")).select(value, (F.col("below") + F.col("k")).alias("a"), F.col("n").alias("n_train"))
    two = ranked_values(df.withColumn("_w", (~train).cast("long")), value, F.col("_w")).select(value, (F.col("below") + F.col("k")).alias("b"), F.col("n").alias("n_test"))
    gap = F.abs(F.try_divide(F.col("a"), F.col("n_train")) - F.try_divide(F.col("b"), F.col("n_test")))
    return one.join(two, value).agg(F.max(gap).alias("ks"), F.max("n_train").alias("n_train"), F.max("n_test").alias("n_test"))


def percentile_rank(df: DataFrame, train: Column, value: str, out: str) -> DataFrame:
    """Share of the training rows below each value; null where the value is null or nothing is trained on."""
    ranked = ranked_values(df.withColumn("_w", train.cast("long")), value, F.col("_w")).select(value, F.try_divide("below", "n").alias(out))
    return df.join(ranked, value, "left")


def holm(tests: DataFrame, by: list[str], p: str, out: str) -> DataFrame:
    """Holm-adjusted p values in each family."""
    w = W.partitionBy(*by).orderBy(p, "test")
    n, rank = F.count("*").over(W.partitionBy(*by)), F.row_number().over(w)
    raw = tests.withColumn("_raw", F.col(p) * (n - rank + 1))
    return raw.withColumn(out, F.least(F.lit(1.0), F.max("_raw").over(w.rowsBetween(W.unboundedPreceding, 0)))).drop("_raw")
