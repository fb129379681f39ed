"""Least squares, covariances and small solvers from grouped sums: a group's rows are read once, and what is solved is a row a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .portfolio import YEAR


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> list[Column]:
    return [left[c].eqNullSafe(right[f"_g_{c}"]) for c in by]


def _solved(batches: Iterator[pd.DataFrame], k: int, ridge: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for n, mean, cov in zip(batch["n"], batch["mean"], batch["cov"]):
            full = np.asarray(cov, float).reshape(k + 1, k + 1) * n
            gram, with_y, yy = full[1:, 1:] + ridge * np.eye(k), full[1:, 0], full[0, 0]
            inverse = np.linalg.pinv(gram)
            slope = inverse @ with_y
            left = yy - 2 * slope @ with_y + slope @ full[1:, 1:] @ slope
            free = n - k - 1
            m = np.asarray(mean, float)
            var = left / free if free > 0 else np.nan
            spread = np.sqrt(np.maximum(var * np.concatenate([[1 / n + m[1:] @ inverse @ m[1:]], np.diag(inverse)]), 0))
            coef = np.concatenate([[m[0] - slope @ m[1:]], slope])
            with np.errstate(divide="ignore", invalid="ignore"):
                t = coef / spread
            out.append((coef.tolist(), [None if not np.isfinite(v) else float(v) for v in t], None if yy <= 0 else float(1 - left / yy)))
        yield batch.drop(columns=["mean", "cov"]).assign(coef=[o[0] for o in out], t=[o[1] for o in out], r2=pd.Series([o[2] for o in out], dtype=float, index=batch.index))


def least_squares(df: DataFrame, by: list[str], y: str, xs: list[str], ridge: float = 0.0) -> DataFrame:
    """(by, n, coef, t, r2): intercept and slopes of y on xs in each group, their t figures, and the share explained.

    From means and covariances, one aggregate for all groups. ridge: penalty of the slopes' squares; t figures hold without one. Rows with a null are left out; a t
    figure without free rows or spread is null.
    """
    names = [y, *xs]
    known = df.dropna(subset=names).select(*by, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)])
    v = [F.col(f"_v{i}") for i in range(len(names))]
    sums = known.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.avg(a) for a in v]).alias("mean"), F.array(*[F.covar_pop(a, b) for a in v for b in v]).alias("cov"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*by).schema], "n long, coef array<double>, t array<double>, r2 double"])
    return sums.mapInPandas(lambda b: _solved(b, len(xs), ridge), schema)


def residual_vol(pairs: DataFrame, long: int = 252, short: int = 126, least: int = 60) -> DataFrame:
    """pairs (ticker, d, ret, bench) with `beta` over the last `long` rows and `idio`, the yearly deviation of ret - beta bench over the last `short`.

    Both null before there are half of `long` rows, or `least`, in all.
    """
    o = W.partitionBy("ticker").orderBy("d")
    far, near = o.rowsBetween(1 - long, 0), o.rowsBetween(1 - short, 0)
    rows = pairs.where("ret is not null and bench is not null").withColumn("_k", F.row_number().over(o))
    var = F.var_samp("bench").over(far)
    rows = rows.withColumn("beta", F.when((F.col("_k") >= max(long // 2, least)) & (var > 0), F.covar_samp("ret", "bench").over(far) / var))
    b = F.col("beta")
    left = F.var_samp("ret").over(near) + b * b * F.var_samp("bench").over(near) - 2 * b * F.covar_samp("ret", "bench").over(near)
    return rows.withColumn("idio", F.when(b.isNotNull(), F.sqrt(F.greatest(left, F.lit(0.0)) * YEAR))).drop("_k")


def softmax_weights(predictions: DataFrame, by: list[str], value: str, temperature: float = 0.02, least: float = 0.0) -> DataFrame:
    """predictions with `w`: softmax of value / temperature in each group, raised to `least` at least, summing to one."""
    g = W.partitionBy(*by)
    e = F.exp((F.col(value) - F.max(value).over(g)) / temperature)
    soft = predictions.withColumn("_e", e).withColumn("_w", F.greatest(F.col("_e") / F.sum("_e").over(g), F.lit(least)))
    return soft.withColumn("w", F.col("_w") / F.sum("_w").over(g)).drop("_e", "_w")


def covariances(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b, cov, n) of every two names, a <= b, over the days that both have; rows (by, ticker, d, ret). Names in a group are few."""
    left = rows.where("ret is not null").select(*by, "d", F.col("ticker").alias("a"), F.col("ret").alias("x"))
    right = left.select(*by, "d", F.col("a").alias("b"), F.col("x").alias("y"))
    return left.join(right, [*by, "d"]).where("a <= b").groupBy(*by, "a", "b").agg(F.covar_samp("x", "y").alias("cov"), F.count("*").alias("n"))


def _equal_risk(cov: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Weights of equal contributions to the variance, by cyclic coordinate steps on the convex form."""
    k = len(cov)
    w = 1 / np.sqrt(np.diag(cov))
    for _ in range(rounds):
        was = w.copy()
        for i in range(k):
            c = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-c + np.sqrt(c * c + 4 * cov[i, i] / k)) / (2 * cov[i, i])
        if np.max(np.abs(w - was) / w) < 1e-13:
            break
    return w / w.sum()


def _least_vol(cov: np.ndarray, rounds: int = 10_000) -> np.ndarray:
    """Weights from 0 up that sum to one and have the least variance: steps towards the best name, as long as they help."""
    k = len(cov)
    w = np.full(k, 1 / k)
    for _ in range(rounds):
        slope = cov @ w
        up, down = int(np.argmin(slope)), int(np.argmax(np.where(w > 0, slope, -np.inf)))
        bend = cov[up, up] + cov[down, down] - 2 * cov[up, down]
        if slope[down] - slope[up] <= 1e-12 * max(abs(slope).max(), 1e-300) or bend <= 0:
            break
        step = min((slope[down] - slope[up]) / bend, w[down])
        w[up] += step
        w[down] = max(w[down] - step, 0.0)
    return w


def solved_weights(cov: DataFrame, by: list[str], how: str = "equal_risk") -> DataFrame:
    """(by, ticker, w) from covariances (by, a, b, cov): `equal_risk`, or `least_vol` with weights from 0 up. A name without variance gets none; a group is solved in one row."""
    solve = {"equal_risk": _equal_risk, "least_vol": _least_vol}[how]
    kind = cov.schema["a"].dataType.simpleString()
    whole = cov.groupBy(*by).agg(F.collect_list(F.struct("a", "b", "cov")).alias("c"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in whole.select(*by).schema], f"w array<struct<ticker:{kind},w:double>>"])

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for cells in batch["c"]:
                var = {r["a"]: r["cov"] for r in cells if r["a"] == r["b"] and r["cov"] is not None and r["cov"] > 0}
                names = sorted(var)
                at = {t: i for i, t in enumerate(names)}
                full = np.zeros((len(names), len(names)))
                for r in cells:
                    if r["a"] in at and r["b"] in at and r["cov"] is not None:
                        full[at[r["a"]], at[r["b"]]] = full[at[r["b"]], at[r["a"]]] = r["cov"]
                out.append([{"ticker": t, "w": float(w)} for t, w in zip(names, solve(full) if names else [])])
            yield batch.drop(columns=["c"]).assign(w=out)

    return whole.mapInPandas(weigh, schema).select(*by, F.explode("w").alias("s")).select(*by, "s.*")


def mean_pair_correlation(rets: DataFrame, by: list[str], w: int = 63) -> DataFrame:
    """(by, d, corr): the mean correlation of all pairs of names over the last w days, from half of w on; days that all names of a group have.

    Without a row a pair: with z the standardised returns of a window, the mean over pairs is ((sum of z)^2 - sum of z^2) / (k (k - 1)), summed over its days. A name
    that does not move in a window is left out of it. What a row holds is w days of k names.
    """
    names = rets.groupBy(*by).agg(F.count_distinct("ticker").alias("_all"))
    days = rets.where("ret is not null").groupBy(*by, "d").agg(F.transform(F.array_sort(F.collect_list(F.struct("ticker", "ret"))), lambda s: s["ret"]).alias("x"), F.count("*").alias("_k"))
    named = names.select(*[F.col(c).alias(f"_g_{c}") for c in by], "_all")
    days = days.join(named, _same(days, named, by)).where("_k = _all").select(*by, "d", "x")
    frame = W.partitionBy(*by).orderBy("d").rowsBetween(1 - w, 0)
    held = days.select(*by, "d", F.collect_list("x").over(frame).alias("win"), F.size("x").alias("k")).where((F.size("win") >= w // 2) & (F.col("k") > 1))
    held = held.withColumn("m", F.expr("transform(sequence(0, k - 1), i -> aggregate(win, 0D, (s, x) -> s + x[i]) / size(win))"))
    held = held.withColumn("q", F.expr("transform(sequence(0, k - 1), i -> aggregate(win, 0D, (s, x) -> s + (x[i] - m[i]) * (x[i] - m[i])))"))
    held = held.withColumn("u", F.expr("transform(q, v -> if(v > 0, 1 / sqrt(v), 0D))")).withColumn("live", F.expr("size(filter(q, v -> v > 0))"))
    total = F.expr("aggregate(transform(win, x -> aggregate(sequence(0, k - 1), 0D, (s, i) -> s + (x[i] - m[i]) * u[i])), 0D, (s, v) -> s + v * v)")
    return held.select(*by, "d", F.when(F.col("live") > 1, (total - F.col("live")) / (F.col("live") * (F.col("live") - 1))).alias("corr"))


def crowded(corr: DataFrame, by: list[str], w: int = 252) -> DataFrame:
    """corr with `high`: 1 where the mean correlation was above its own median of the last w days on the row before; from half of w on, else 0."""
    o = W.partitionBy(*by).orderBy("d")
    frame = o.rowsBetween(1 - w, 0)
    rows = corr.withColumn("_m", F.when(F.count("corr").over(frame) >= w // 2, F.percentile("corr", F.lit(0.5)).over(frame)))
    return rows.withColumn("_f", F.coalesce((F.col("corr") > F.col("_m")).cast("int"), F.lit(0))).withColumn("high", F.coalesce(F.lag("_f").over(o), F.lit(0))).drop("_m", "_f")


def pair_correlations(signals: DataFrame, value: str) -> DataFrame:
    """(pairs, mean, least, most): correlations of every two tickers' signals over the days that both have; tickers are few."""
    left = signals.where(F.col(value).isNotNull()).select("d", F.col("ticker").alias("a"), F.col(value).cast("double").alias("x"))
    right = left.select("d", F.col("a").alias("b"), F.col("x").alias("y"))
    each = left.join(right, "d").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("c")).where("c is not null and not isnan(c)")
    return each.agg(F.count("*").alias("pairs"), F.avg("c").alias("mean"), F.min("c").alias("least"), F.max("c").alias("most"))


def mixed_vol(s: Column, b: Column, ss: Column, bb: Column, sb: Column, n: Column, w: float) -> Column:
    """Yearly population deviation of w in s and the rest in b, from sums."""
    mean = (w * s + (1 - w) * b) / n
    return F.sqrt(F.greatest((w * w * ss + (1 - w) * (1 - w) * bb + 2 * w * (1 - w) * sb) / n - mean * mean, F.lit(0.0)) * YEAR)
