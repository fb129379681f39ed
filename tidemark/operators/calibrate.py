"""Calibration of probabilities: isotonic, logistic, temperature, and curves of one or two parameters, fitted for all groups at once.

Every fit is a few jobs over grouped sums. Where values repeat, rows are summed to one for each group and value first. A round of
Newton steps reads the rows once; what reaches the driver is a row of sums for each group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.saved import saved

LOW, HIGH = 0.03, 0.97
EPS = 1e-12
#: Probabilities are looked up in so many equal parts of 0 to 1.
PARTS = 256
#: Fits that take their steps side by side; of more groups, so many at a time.
SIDE_BY_SIDE = 10_000


def clipped(p: Column, low: float = LOW, high: float = HIGH) -> Column:
    return F.least(F.greatest(p, F.lit(low)), F.lit(high))


def renormalised(q: Column, low: float = LOW, high: float = HIGH) -> Column:
    """An array of probabilities, each clipped, that sums to one again. low has to be above 0."""
    if low <= 0:
        raise ValueError("the lower bound has to be above 0, else a row may sum to 0")
    return _whole(F.transform(q, lambda x: clipped(x, low, high)))


def _whole(parts: Column) -> Column:
    """parts by their sum; the array is bound once, so that it is not computed again for each part."""
    return F.transform(F.array(parts), lambda p: F.transform(p, lambda v: v / F.aggregate(p, F.lit(0.0), lambda s, w: s + w)))[0]


def _pooled(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Pool adjacent violators along sorted (key, lo, hi, n, s): blocks of growing mean. A stack of blocks of one key is held."""
    now, stack = None, []

    def blocks() -> pd.DataFrame:
        return pd.DataFrame([(*now, *b) for b in stack], columns=[*key, "lo", "hi", "n", "s"])

    for batch in batches:
        for row in batch[[*key, "lo", "hi", "n", "s"]].itertuples(index=False, name=None):
            at, (lo, hi, n, s) = row[: len(key)], row[len(key) :]
            if at != now:
                if stack:
                    yield blocks()
                now, stack = at, []
            while stack and stack[-1][3] * n >= s * stack[-1][2]:
                lo, _, m, t = stack.pop()
                n, s = n + m, s + t
            stack.append((lo, hi, n, s))
    if stack:
        yield blocks()


def isotonic(df: DataFrame, by: list[str], x: str = "p", y: str = "y") -> DataFrame:
    """(by, lo, hi, value, n): the non-decreasing steps over x that are nearest to y in squares, for each group.

    Values are dealt by ranges of (by, x) and pooled in each task; the blocks that are left, which are the fit but for the tasks' edges, are
    then pooled in order, group by group. Nulls in x or y are left out; a null group is a group.
    """
    sums = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("lo")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    key = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    keyed = sums.select(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")).alias(k) for c, k in zip(by, key)] or [F.lit("").alias("_k0")], "lo", F.col("lo").alias("hi"), "n", "s")
    pool = lambda rows: rows.mapInPandas(lambda b: _pooled(b, key), keyed.schema)
    first = saved(pool(keyed.repartitionByRange(*key, "lo").sortWithinPartitions(*key, "lo")))
    blocks = pool(first.repartition(*key).sortWithinPartitions(*key, "lo"))
    kinds = {f.name: f.dataType for f in df.schema}
    return blocks.select(*[F.when(F.col(k) != "-", F.substring(k, 2, 1 << 20)).cast(kinds[c]).alias(c) for c, k in zip(by, key)], "lo", "hi", (F.col("s") / F.col("n")).alias("value"), F.col("n").cast("long").alias("n"))


def apply_isotonic(rows: DataFrame, blocks: DataFrame, by: list[str], x: str, out: str) -> DataFrame:
    """rows with `out`, the fitted steps' value at x between 0 and 1: on a line between two steps, the nearest step's outside. Null without a fit.

    A step covers the parts of 0 to 1 up to the next step and meets the rows of those parts only.
    """
    w = W.partitionBy(*by).orderBy("lo")
    part = lambda c: F.greatest(F.least(F.floor(c * PARTS), F.lit(PARTS)), F.lit(0))
    steps = blocks.select(*by, "lo", "hi", "value", F.lead("lo").over(w).alias("_next"), F.lead("value").over(w).alias("_to"), (F.row_number().over(w) == 1).alias("_first"))
    start = F.when(F.col("_first"), F.lit(0)).otherwise(part(F.col("lo")))
    steps = steps.withColumn("_part", F.explode(F.sequence(start, F.coalesce(part(F.col("_next")), F.lit(PARTS)))))
    named = steps.select(*[F.col(c).alias(f"_g_{c}") for c in by], "_part", "lo", "hi", "value", "_next", "_to", "_first")
    left = rows.withColumn("_at", part(F.col(x)))
    same = F.col("_at") == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    met = left.join(named, same & ((F.col(x) >= F.col("lo")) | F.col("_first")) & (F.col("_next").isNull() | (F.col(x) < F.col("_next"))), "left")
    between = F.col("value") + (F.col("_to") - F.col("value")) * (F.col(x) - F.col("hi")) / (F.col("_next") - F.col("hi"))
    return met.select(*[rows[c] for c in rows.columns], F.when((F.col(x) <= F.col("hi")) | F.col("_next").isNull(), F.col("value")).otherwise(between).alias(out))


def linear(coef: Column, features: list[Column], intercept: bool = True) -> Column:
    """Sum of coefficients times features, the intercept first."""
    at = coef[0] if intercept else F.lit(0.0)
    for k, f in enumerate(features, int(intercept)):
        at = at + coef[k] * f
    return at


def sigmoid(t: Column) -> Column:
    return 1 / (1 + F.exp(-t))


@dataclass
class _Descent:
    """One group's Newton steps: the best coefficients so far, the step from them and the share of it that is tried next."""

    coef: np.ndarray
    step: np.ndarray
    share: float = 0.0
    cost: float = float("inf")
    loss: float = float("inf")
    rounds: int = 0

    def tried(self) -> np.ndarray:
        return self.coef + self.share * self.step

    def told(self, sums: np.ndarray, n: int, penalty: np.ndarray, scale: np.ndarray, rounds: int, tolerance: float) -> bool:
        """Whether this was the last step, by the summed loss, gradient and upper half of the Hessian where it was tried."""
        at, size = self.tried(), len(penalty)
        cost = sums[0] + 0.5 * (penalty * at * at).sum()
        gained = (self.cost - cost) / n
        if not cost <= self.cost:
            self.share /= 2
            return gained > -1e-14 or self.share < 0.5**7
        last = gained < 1e-14 or self.rounds >= rounds
        self.coef, self.cost, self.loss, self.rounds = at, cost, sums[0], self.rounds + 1
        if last:
            return True
        hess = np.zeros((size, size))
        hess[np.triu_indices(size)] = sums[1 + size :]
        hess = (hess + np.triu(hess, 1).T) * np.outer(scale, scale) + np.diag(penalty)
        self.step, self.share = np.linalg.lstsq(hess, sums[1 : 1 + size] * scale - penalty * at, rcond=1e-12)[0], 1.0
        if np.abs(self.step).max() < tolerance:
            self.coef = self.tried()
            return True
        return False


def _task_sums(batches: Iterator[pa.RecordBatch], now: dict[int, tuple[list[int], np.ndarray]], intercept: bool, link: str) -> Iterator[pa.RecordBatch]:
    """(_at, _c, _v0 ...): a task's rows (_at, _n, _s, features) summed for each group and each of its coefficients: loss, gradient, upper half of the Hessian."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        at, n, s, *x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        order = np.argsort(at, kind="stable")
        at, n, s = at[order], n[order], s[order]
        x = np.column_stack([*([np.ones(len(at))] if intercept else []), *[c[order] for c in x]])
        i, j = np.triu_indices(x.shape[1])
        pairs = x[:, i] * x[:, j]
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi or int(at[lo]) not in now:
                continue
            g, m, k = int(at[lo]), n[lo:hi, None], s[lo:hi, None]
            t = x[lo:hi] @ now[g][1].T
            if link == "log":
                with np.errstate(all="ignore"):
                    p = np.exp(np.minimum(t, 0.0))
                    rest = np.maximum(1 - p, EPS)
                    slope, bend = k - (m - k) * p / rest, (m - k) * p / (rest * rest)
                    loss = np.where(t < 0, -(k * t + (m - k) * np.log(-np.expm1(t))), np.inf)
            else:
                e = np.exp(-np.abs(t))
                p = np.where(t >= 0, 1.0, e) / (1 + e)
                slope, bend = k - m * p, m * p * (1 - p)
                loss = m * (np.maximum(t, 0.0) + np.log1p(e)) - k * t
            part = np.column_stack([loss.sum(axis=0), slope.T @ x[lo:hi], bend.T @ pairs[lo:hi]])
            totals[g] = totals[g] + part if g in totals else part
    if totals:
        flat = np.concatenate(list(totals.values()))
        names = {"_at": np.repeat(np.array(list(totals), np.int32), [len(v) for v in totals.values()]), "_c": np.array([c for g in totals for c in now[g][0]], np.int32)}
        yield pa.RecordBatch.from_pydict({**{k: pa.array(v) for k, v in names.items()}, **{f"_v{k}": pa.array(np.ascontiguousarray(flat[:, k])) for k in range(flat.shape[1])}})


def _descended(told: Callable[[dict], Iterable], counts: dict[int, int], start: np.ndarray, penalty: np.ndarray, scale: np.ndarray, rounds: int, tolerance: float) -> dict[tuple[int, int], _Descent]:
    """Newton steps of every group and way (row of scale), until each has had its last; told gives (group, way, *sums) at the coefficients that are tried."""
    ways = {(at, c): _Descent(start, np.zeros(len(start))) for at in counts for c in range(len(scale))}
    todo = set(ways)
    while todo:
        now = {at: [c for c in range(len(scale)) if (at, c) in todo] for at in {at for at, _ in todo}}
        tried = {at: (cs, np.array([ways[at, c].tried() * scale[c] for c in cs])) for at, cs in now.items()}
        for at, c, *values in told(tried):
            if ways[at, c].told(np.array(values), counts[at], penalty, scale[c], rounds, tolerance):
                todo.discard((at, c))
    return ways


def _summed(rows: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], size: int) -> list:
    """What task makes of a partition's rows, added up: (group, way, *sums)."""
    sums = [f"_v{k}" for k in range(1 + size + size * (size + 1) // 2)]
    return rows.mapInArrow(task, ", ".join(["_at int, _c int", *[f"{v} double" for v in sums]])).groupBy("_at", "_c").agg(*[F.sum(v).alias(v) for v in sums]).collect()


def fitted(df: DataFrame, by: list[str], features: list[str], y: str = "y", link: str = "logit", intercept: bool = True, ridge: float = 0.0, start: list[float] | None = None, rounds: int = 40, tolerance: float = 1e-9, uses: dict[str, list[float]] | None = None) -> DataFrame:
    """(by, n, coef, loss): coefficients of P(y = 1), the intercept first, by Newton steps for all groups at once; loss is the mean log loss.

    link: `logit`, or `log` for probabilities exp(linear) below 1. ridge: penalty of half its square on each coefficient but
    the intercept. A step that worsens a group's loss, or leaves the range of the link, is halved until it does not. Rows with a null in a
    feature or y are left out; a null group is a group.
    uses: by name, what each feature is multiplied by in a fit of its own (0: left out); the result then has a row for each (config, by), with
    coefficients of the features as they are. A round reads the rows once for all of these. Tasks sum their rows; the driver has
    a row of sums for each group and name, of at most SIDE_BY_SIDE at a time.
    """
    size, penalty = len(features) + intercept, np.array([0.0] * intercept + [ridge] * len(features))
    scales = {"": [1.0] * len(features)} if uses is None else uses
    scale = np.array([[1.0] * intercept + list(u) for u in scales.values()])
    base = df
    for c in [*features, y]:
        base = base.where(F.col(c).isNotNull())
    xs = [f"_x{i}" for i in range(len(features))]
    base = saved(base.select(*by, F.lit(1.0).alias("_n"), F.col(y).cast("double").alias("_s"), *[F.col(c).cast("double").alias(x) for c, x in zip(features, xs)]))
    groups = saved(base.groupBy(*by).agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(*xs)).alias("_d")).where("n > 0").withColumn("_at", F.row_number().over(W.orderBy(*by or [F.lit(0)])) - 1))  # a row a group
    n_groups, n, different = groups.agg(F.count("*"), F.sum("n"), F.sum("_d")).first()
    if n_groups and different * 4 < n:  # values repeat: a row for each
        base = saved(base.groupBy(*by, *xs).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s")))
    turn, found = max(1, SIDE_BY_SIDE // len(scales)), []
    for low in range(0, n_groups, turn):
        mine = groups.where((F.col("_at") >= low) & (F.col("_at") < low + turn)).select(*[F.col(c).alias(f"_g_{c}") for c in by], "_at")
        rows = (base.join(F.broadcast(mine), [base[c].eqNullSafe(mine[f"_g_{c}"]) for c in by]) if by else base.crossJoin(F.broadcast(mine))).select("_at", "_n", "_s", *xs)  # at most SIDE_BY_SIDE rows
        counts = dict(groups.where((F.col("_at") >= low) & (F.col("_at") < low + turn)).select("_at", "n").collect())

        def told(tried: dict) -> list:
            left = rows if len(tried) == len(counts) or len(tried) > 100 else rows.where(F.col("_at").isin(list(tried)))  # noqa: B023
            return _summed(left, lambda b: _task_sums(b, tried, intercept, link), size)

        ways = _descended(told, counts, np.array(start or [0.0] * size), penalty, scale, rounds, tolerance)
        names = list(scales)
        found += [(at, names[c], (way.coef * scale[c]).tolist(), float(way.loss) / counts[at]) for (at, c), way in ways.items()]
    got = df.sparkSession.createDataFrame(found, "_at int, _config string, coef array<double>, loss double")
    return saved(groups.join(F.broadcast(got), "_at").select(*([] if uses is None else [F.col("_config").alias("config")]), *by, "n", "coef", "loss"))


def _fold_by_fold(batches: Iterator[pa.RecordBatch], members: dict[int, list[int]], tried: dict, moved: Callable) -> Iterator[pa.RecordBatch]:
    """Rows (cell, y, features) as those of _task_sums: for each group that is tried, those of its cells, moved as in that group."""
    for batch in batches:
        cell, y = batch.columns[0].to_numpy(), batch.columns[1].to_numpy()
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]])
        null = np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns[2:]])
        kinds, place = np.unique(cell, return_inverse=True)
        of = [set(members.get(c, ())) for c in kinds.tolist()]
        for g in sorted(set().union(*of) & set(tried)):
            here = np.flatnonzero(np.array([g in gs for gs in of])[place])
            a, gone = moved(g, x[here], null[here])
            left = ~gone.any(axis=1)
            a, s = a[left], y[here][left]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(s), g), np.ones(len(s)), s, *np.ascontiguousarray(a.T))], names=["_at", "_n", "_s", *[f"_x{k}" for k in range(a.shape[1])]])


def fitted_folds(rows: DataFrame, members: dict[int, list[int]], counts: dict[int, int], features: list[str], y: str, moved: Callable, ridge: float = 0.0, uses: dict[str, list[float]] | None = None, rounds: int = 40, tolerance: float = 1e-9) -> list[tuple[int, str, list[float], float]]:
    """[(group, config, coef, loss)] as `fitted`, for groups that share rows: those of a cell (`_cell`) go to each of members[cell], which are spread in a task's memory.

    moved(group, x, null): the features' values and which are null as that group has them. counts: each group's rows.
    """
    scales = {"": [1.0] * len(features)} if uses is None else uses
    scale, size, names = np.array([[1.0, *u] for u in scales.values()]), len(features) + 1, list(scales)
    base = rows.where(F.col(y).isNotNull()).select("_cell", F.col(y).cast("double").alias("_s"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    turn, found, groups = max(1, SIDE_BY_SIDE // len(scales)), [], sorted(counts)
    for low in range(0, len(groups), turn):
        mine = {g: counts[g] for g in groups[low : low + turn]}

        def told(tried: dict) -> list:
            cells = [c for c, gs in members.items() if any(g in tried for g in gs)]
            left = base.where(F.col("_cell").isin(cells)) if len(cells) <= 100 else base
            return _summed(left, lambda b: _task_sums(_fold_by_fold(b, members, tried, moved), tried, True, "logit"), size)

        ways = _descended(told, mine, np.zeros(size), np.array([0.0, *[ridge] * len(features)]), scale, rounds, tolerance)
        found += [(at, names[c], (way.coef * scale[c]).tolist(), float(way.loss) / mine[at]) for (at, c), way in ways.items()]
    return found


def softened(q: Column, t: Column) -> Column:
    """Probabilities at temperature t: softmax of log q / t."""
    held = lambda v: F.least(F.greatest(v, F.lit(EPS)), F.lit(1.0))
    return _whole(F.transform(q, lambda v: F.pow(held(v) / held(F.array_max(q)), 1 / t)))


def temperature(df: DataFrame, by: list[str], q: str = "q", c: str = "c", low: float = -5.0, high: float = 5.0, trials: int = 17, rounds: int = 9) -> DataFrame:
    """(by, n, t, loss): the temperature at which the true class c (0 ... k - 1) of the probabilities q has the least mean log loss, group by group.

    The loss has one valley in log t: each round tries so many values between the bounds in one aggregate, and goes on between the best one's neighbours.
    """
    logs = F.transform(q, lambda v: F.log(F.least(F.greatest(v, F.lit(EPS)), F.lit(1.0))))
    rows = df.where(F.col(q).isNotNull() & F.col(c).isNotNull()).select(*by, logs.alias("_q"), F.col(c).cast("int").alias("_c"))
    rows = rows.select(*by, F.transform("_q", lambda v: v - F.array_max("_q")).alias("_q"), F.get("_q", F.col("_c")).alias("_t"), F.array_max("_q").alias("_m"))
    rows = saved(rows.groupBy(*by, "_q", F.coalesce(F.col("_t") - F.col("_m"), F.lit(float(np.log(EPS)))).alias("_t")).agg(F.count("*").alias("_n")))
    now = rows.groupBy(*by).agg(F.sum("_n").alias("n")).withColumns({"_lo": F.lit(low), "_hi": F.lit(high)})
    at = lambda k: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * k / (trials - 1)
    loss = lambda t: F.col("_n") * (F.log(F.aggregate("_q", F.lit(0.0), lambda s, v: s + F.exp(v / t))) - F.col("_t") / t)
    for _ in range(rounds):
        now = saved(now)
        named = now.select(*[F.col(x).alias(f"_g_{x}") for x in by], "n", "_lo", "_hi")
        here = rows.join(named, [F.col(x).eqNullSafe(named[f"_g_{x}"]) for x in by]) if by else rows.crossJoin(F.broadcast(named))  # one row
        sums = here.groupBy(*by).agg(F.first("n").alias("n"), F.first("_lo").alias("_a"), F.first("_hi").alias("_b"), F.array(*[F.sum(loss(F.exp(at(k)))) for k in range(trials)]).alias("_l"))
        best, sums = F.array_position("_l", F.array_min("_l")) - 1, sums.withColumnsRenamed({"_a": "_lo", "_b": "_hi"})
        now = sums.select(*by, "n", at(F.greatest(best - 1, F.lit(0))).alias("_lo"), at(F.least(best + 1, F.lit(trials - 1))).alias("_hi"), (F.array_min("_l") / F.col("n")).alias("loss"))
    return saved(now).select(*by, "n", F.exp((F.col("_lo") + F.col("_hi")) / 2).alias("t"), "loss")


def _drawn_start(unit: float) -> list[float]:
    return [float(np.log(0.25)), -((unit / 200) ** 2)]


def draw_curve(df: DataFrame, by: list[str], gap: str, drawn: str, unit: float = 100.0) -> DataFrame:
    """(by, n, base, spread, loss) of P(draw) = base exp(-(gap / spread)^2): a log link in the squared gap. spread is null where draws do not thin out."""
    got = fitted(df.withColumn("_g", F.pow(F.col(gap) / unit, F.lit(2.0))), by, ["_g"], drawn, link="log", start=_drawn_start(unit))
    return got.select(*by, "n", F.exp(F.col("coef")[0]).alias("base"), F.when(F.col("coef")[1] < 0, unit / F.sqrt(-F.col("coef")[1])).alias("spread"), "loss")


def _place_by_place(batches: Iterator[pa.RecordBatch], unit: float) -> Iterator[pa.RecordBatch]:
    """Rows (drawn, gaps) as those of _task_sums, a group for each place of the arrays."""
    for batch in batches:
        drawn, gaps = batch.columns
        if len(drawn):
            flat = gaps.flatten().to_numpy(zero_copy_only=False).reshape(len(drawn), -1)
            places = flat.shape[1]
            columns = np.repeat(np.arange(places), len(drawn)), np.ones(flat.size), np.tile(drawn.to_numpy(zero_copy_only=False), places), np.square(flat / unit).T.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_at", "_n", "_s", "_x0"])


def draw_curves(df: DataFrame, gaps: str, drawn: str, unit: float = 100.0) -> DataFrame:
    """(at, n, base, spread, loss): draw_curve for each place, from 0, of the arrays `gaps`, which are of one length. A round reads a row once for all places.

    Rows with a null in them are left out. Tasks sum their rows; the driver has a row of sums for each place.
    """
    rows = df.where(F.col(drawn).isNotNull() & F.col(gaps).isNotNull() & ~F.exists(gaps, lambda g: g.isNull())).select(F.col(drawn).cast("double").alias("_s"), F.col(gaps).cast("array<double>").alias("_g"))
    n, places, least = rows.agg(F.count("*"), F.max(F.size("_g")), F.min(F.size("_g"))).first()
    if places != least:
        raise ValueError("the arrays have to be of one length")
    told = lambda tried: _summed(rows, lambda b: _task_sums(_place_by_place(b, unit), tried, True, "log"), 2)
    ways = _descended(told, {at: n for at in range(places or 0)}, np.array(_drawn_start(unit)), np.zeros(2), np.ones((1, 2)), 40, 1e-9)
    found = [(at, n, float(np.exp(way.coef[0])), unit / float(np.sqrt(-way.coef[1])) if way.coef[1] < 0 else None, float(way.loss) / n) for (at, _), way in ways.items()]
    return df.sparkSession.createDataFrame(found, "at int, n long, base double, spread double, loss double")


def gap_slope(df: DataFrame, by: list[str], gap: str, won: str, least: int = 30) -> DataFrame:
    """(by, n, slope, rate) of logit P(won) = slope x gap; 0 for groups of fewer than `least` rows. rate: the share won."""
    sums = df.where(F.col(gap).isNotNull() & F.col(won).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(won).cast("double")).alias("rate"))
    fit = fitted(df, by, [gap], won, intercept=False).select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("coef")[0].alias("slope"))
    met = sums.join(fit, [F.col(c).eqNullSafe(fit[f"_g_{c}"]) for c in by], "left") if by else sums.crossJoin(F.broadcast(fit))  # one row
    return met.select(*by, "n", F.when(F.col("n") < least, 0.0).otherwise(F.col("slope")).alias("slope"), "rate")
