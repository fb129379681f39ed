"""Models fitted fold by fold on earlier rows, calibrated on held-out ones, and scored on rows that neither has seen.

Folds are rows of one table, (fold, part, ...) with part train, cal or test, or `splits.Folds`, whose rows are stored once and spread over the
folds where they are read. Transforms, the logistic model and calibration are fitted for all folds in one grouped job; Spark ML's estimators
are fitted fold after fold, as there are few.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.saved import saved
from . import calibrate, evaluate, splits

LEAST_CAL = 11


@dataclass(frozen=True)
class Step:
    """A transform of columns fitted on each fold's training rows: `mean` fills nulls, `zscore` and `minmax` scale; what does not vary becomes 0."""

    kind: str
    columns: tuple[str, ...]

    def fit(self, rows: DataFrame) -> DataFrame:
        """(fold, _a_c, _b_c of each column c): what is taken off and what divides."""
        x = lambda c: F.when(F.col("part") == "train", F.col(c))
        low = {"mean": lambda c: F.avg(x(c)), "zscore": lambda c: F.avg(x(c)), "minmax": lambda c: F.min(x(c))}[self.kind]
        width = {"mean": lambda c: F.lit(1.0), "zscore": lambda c: F.stddev_samp(x(c)), "minmax": lambda c: F.max(x(c)) - F.min(x(c))}[self.kind]
        return rows.groupBy("fold").agg(*[low(c).alias(f"_a_{c}") for c in self.columns], *[width(c).alias(f"_b_{c}") for c in self.columns])

    def moved(self, rows: DataFrame, fit: DataFrame) -> DataFrame:
        met = rows.join(F.broadcast(fit), "fold")  # a row a fold
        scaled = lambda c: F.when(F.col(f"_b_{c}") > 0, (F.col(c) - F.col(f"_a_{c}")) / F.col(f"_b_{c}")).otherwise(F.when(F.col(c).isNotNull(), 0.0))
        return met.withColumns({c: F.coalesce(F.col(c), F.col(f"_a_{c}")) if self.kind == "mean" else scaled(c) for c in self.columns}).select(rows.columns)

    def values(self, x: np.ndarray, null: np.ndarray, a: float | None, b: float | None) -> tuple[np.ndarray, np.ndarray]:
        """The same for one column's values of one fold, and which of them are null."""
        if self.kind == "mean":
            return (x, null) if a is None else (np.where(null, float(a), x), np.zeros_like(null))
        return ((x - float(a)) / float(b) if b is not None and b > 0 else np.zeros_like(x)), null


@dataclass(frozen=True)
class Prepared:
    """Rows after their steps: `rows` (fold, part, ...) spread and lazy, and the folds that they stem from with each step's figures by fold."""

    folds: splits.Folds
    rows: DataFrame
    moves: list[tuple[Step, dict]]

    def fitted(self, features: list[str], y: str, ridge: float, uses: dict[str, list[float]] | None = None) -> DataFrame:
        """(config, fold, coef) of logistic models of the training rows; the stored rows are read once a round."""
        used = self.rows.where("part = 'train'").dropna(subset=[*features, y]).groupBy("fold").agg(F.count("*").alias("n")).collect()  # a row a fold
        at, counts = {r["fold"]: g for g, r in enumerate(used)}, {g: r["n"] for g, r in enumerate(used)}
        members: dict[int, list[int]] = {}
        for r in self.folds.parts.where("part = 'train'").collect():  # a row a cell and fold
            if r["fold"] in at:
                members.setdefault(r["_cell"], []).append(at[r["fold"]])
        moves = {g: [(step, features.index(c), fits[fold][f"_a_{c}"], fits[fold][f"_b_{c}"]) for step, fits in self.moves for c in step.columns if c in features] for fold, g in at.items()}

        def moved(g: int, x: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            for step, k, a, b in moves[g]:
                x[:, k], null[:, k] = step.values(x[:, k], null[:, k], a, b)
            return x, null

        got = calibrate.fitted_folds(self.folds.rows, members, counts, features, y, moved, ridge, uses)
        folds = [r["fold"] for r in used]
        kind = self.rows.schema["fold"].dataType.simpleString()
        return self.rows.sparkSession.createDataFrame([(name, folds[g], coef) for g, name, coef, _ in got], f"config string, fold {kind}, coef array<double>")


def prepared(rows: DataFrame | splits.Folds, row: str, day: str | None = None, steps: list[Step] | None = None) -> Prepared:
    """The rows written once and guarded, and the steps fitted. Rows given as (fold, part, ...) are stored as they stand."""
    if isinstance(rows, splits.Folds):
        folds = splits.Folds(saved(rows.rows), saved(rows.parts))
    else:
        kept = saved(rows)
        parts = saved(kept.select("fold", "part").distinct().withColumn("_cell", F.row_number().over(W.orderBy("fold", "part")).cast("long")))  # a row a fold and part
        folds = splits.Folds(kept.join(F.broadcast(parts), ["fold", "part"]).drop("fold", "part"), parts)
    now, moves = guarded(folds, row, day).spread(), []
    for step in steps or []:
        fit = saved(step.fit(now))
        moves.append((step, {r["fold"]: r for r in fit.collect()}))  # a row a fold
        now = step.moved(now, fit)
    return Prepared(folds, now, moves)


def seasons(df: DataFrame, season: str, kind: str = "previous", width: int | None = None, first: int = 2) -> splits.Folds:
    """Folds of `season_folds`: a season's rows are a cell."""
    cells = df.select(season).distinct().where(F.col(season).isNotNull()).withColumns({"_cell": F.row_number().over(W.orderBy(season)).cast("long"), "_lo": F.min(season).over(W.partitionBy(F.lit(0)))})  # a row a season
    folds = cells.where(F.lit(kind == "leave_one_out") | (F.col(season) - F.col("_lo") >= first)).select(F.col(season).alias("fold"))
    used = F.lit(True) if kind == "leave_one_out" else F.col(season) <= F.col("fold")
    if width:
        used = used & (F.col(season) >= F.col("fold") - width)
    part = F.when(F.col(season) == F.col("fold"), "test")
    if kind == "previous":
        part = part.when(F.col(season) == F.col("fold") - 1, "cal")
    parts = cells.join(F.broadcast(folds), used).select("_cell", "fold", part.otherwise("train").alias("part"))
    return splits.Folds(df.join(F.broadcast(cells.select(season, "_cell")), season).select(*df.columns, "_cell"), parts)


def season_folds(df: DataFrame, season: str, kind: str = "previous", width: int | None = None, first: int = 2) -> DataFrame:
    """df with (fold, part): a fold for each season from `first` seasons after the first on; each row goes to the folds that use it.

    `previous`: the season before is for calibration, earlier ones train. `expanding`: all earlier seasons train; with width, only so many last ones.
    `leave_one_out`: every season is tested once (first does not count), all others train.
    """
    return seasons(df, season, kind, width, first).spread()


def guarded(folds: splits.Folds, row: str, day: str | None = None) -> splits.Folds:
    """folds, after a look that no row stands twice in a fold and, with a day, that training and calibration end before the test. ValueError if not.

    Only rows stored more than once are counted fold by fold, and of a cell's days only the first and last.
    """
    again = folds.rows.groupBy(row).agg(F.count("*").alias("n")).where("n > 1").select(row)
    if not again.isEmpty():
        splits.raise_if_any(folds.spread().groupBy("fold", row).agg(F.count("*").alias("n")).where("n > 1"), "rows that stand twice in a fold")
    if day:
        ends = folds.rows.groupBy("_cell").agg(F.array(F.min(day), F.max(day)).alias("_days")).select("_cell", F.explode("_days").alias(day))
        late = splits.split_order(splits.Folds(ends, folds.parts).spread(), ["fold"], day, F.col("part"))
        splits.raise_if_any(late.where("last_train >= first_test or last_cal >= first_test"), "training after the test began")
    return folds


Model = Callable[[Prepared, list[str], str, str], DataFrame]


def logistic(ridge: float = 1.0) -> Model:
    """Logistic regression with a penalty on the slopes, all folds at once."""

    def fit(given: Prepared, features: list[str], y: str, row: str) -> DataFrame:
        coef = given.fitted(features, y, ridge).select("fold", "coef")
        met = given.rows.where("part <> 'train'").dropna(subset=[*features, y]).join(F.broadcast(coef), "fold")  # a row a fold
        return met.select("fold", row, "part", F.col(y).alias("y"), calibrate.sigmoid(calibrate.linear(F.col("coef"), [F.col(f) for f in features])).alias("raw"))

    return fit


def estimator(make: Callable[[], object], importances: dict | None = None) -> Model:
    """A Spark ML classifier, fitted fold after fold. make(): a new one, reading `features` and `label`; one with a validation column stops early on the calibration rows.

    importances: if given, gets each fold's feature importances by name.
    """

    def fit(given: Prepared, features: list[str], y: str, row: str) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        full = given.rows.dropna(subset=[*features, y]).withColumn("label", F.col(y).cast("double"))
        full = VectorAssembler(inputCols=features, outputCol="features").transform(full.withColumn("held", F.col("part") == "cal")).select("fold", row, "part", "held", "features", "label", F.col(y).alias("y"))
        parts, got = given.folds.parts.select("fold", "part").distinct().collect(), None  # few folds
        for fold in sorted({p["fold"] for p in parts}):
            mine = full.where(F.col("fold") == fold)
            est = make()
            early = est.hasParam("validationIndicatorCol") and not mine.where("held").isEmpty()
            if early:
                est.setValidationIndicatorCol("held")
            model = est.fit(mine.where("part <> 'test'") if early else mine.where("part = 'train'"))
            if importances is not None and hasattr(model, "featureImportances"):
                importances[fold] = dict(zip(features, model.featureImportances.toArray().tolist()))
            scored = model.transform(mine.where("part <> 'train'")).select("fold", row, "part", "y", vector_to_array("probability")[1].alias("raw"))
            got = scored if got is None else got.unionByName(scored)
        return saved(got)

    return fit


def boosted(importances: dict | None = None, **params) -> Model:
    """Gradient-boosted trees that stop when the calibration rows' loss does."""
    from pyspark.ml.classification import GBTClassifier

    return estimator(lambda: GBTClassifier(**{"maxIter": 60, "maxDepth": 3, "stepSize": 0.1, "seed": 42, "validationTol": 1e-4, **params}), importances)


def elastic(penalty: float = 0.01, l1: float = 0.5) -> Model:
    from pyspark.ml.classification import LogisticRegression

    return estimator(lambda: LogisticRegression(regParam=penalty, elasticNetParam=l1, maxIter=100))


def calibrated(scored: DataFrame, row: str, method: str | None = "isotonic", low: float = calibrate.LOW, high: float = calibrate.HIGH) -> DataFrame:
    """(fold, row, y, raw, p) of the test rows: p is raw as each fold's calibration rows correct it, and clipped; with few of them it is clipped only."""
    test, cal = scored.where("part = 'test'").drop("part"), scored.where("part = 'cal'")
    if method is None:
        return test.withColumn("p", calibrate.clipped(F.col("raw"), low, high))
    enough = cal.groupBy("fold").agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST_CAL).select("fold")
    cal = cal.join(F.broadcast(enough), "fold")  # a row a fold
    if method == "isotonic":
        got = calibrate.apply_isotonic(test, calibrate.isotonic(cal, ["fold"], "raw", "y"), ["fold"], "raw", "_p")
    else:
        coef = calibrate.fitted(cal, ["fold"], ["raw"], "y", ridge=1.0).select("fold", "coef")
        got = test.join(F.broadcast(coef), "fold", "left").withColumn("_p", calibrate.sigmoid(calibrate.linear(F.col("coef"), [F.col("raw")])))
    return got.select("fold", row, "y", "raw", calibrate.clipped(F.coalesce("_p", "raw"), low, high).alias("p"))


def run(rows: DataFrame | splits.Folds, features: list[str], y: str, row: str, model: Model | None = None, steps: list[Step] | None = None, method: str | None = "isotonic", day: str | None = None) -> DataFrame:
    """(fold, row, y, raw, p) of every test row: transforms and model fitted on its fold's training rows, calibrated on its calibration rows.

    Rows with a null feature after the steps, or a null y, are not scored. Folds without training rows give none.
    """
    given = prepared(rows, row, day, [Step("zscore", tuple(features))] if steps is None else steps)
    return calibrated((model or logistic())(given, features, y, row), row, method)


def summary(scored: DataFrame) -> DataFrame:
    """(fold, n, log_loss, accuracy, brier) of each fold and, with a null fold, of all test rows together."""
    each = saved(evaluate.binary_scores(scored, ["fold"]))  # a row a fold
    n = F.sum("n").cast("double")
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / n).alias(c)
    return each.unionByName(each.agg(F.lit(None).cast(scored.schema["fold"].dataType).alias("fold"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), mean("log_loss"), mean("accuracy"), mean("brier")).where("n > 0"))


def stacked(scored: DataFrame, row: str, models: list[str], ridge: float = 1.0, first: int = 1) -> DataFrame:
    """(fold, row, y, p) of a logistic mix of the models' out-of-fold probabilities, fitted on the folds before; the first `first` folds only train."""
    cells = scored.select("fold").distinct().where(F.col("fold").isNotNull()).withColumn("_cell", F.row_number().over(W.orderBy("fold")).cast("long"))  # a row a fold
    evals = cells.where(F.col("_cell") > first).select(F.col("fold").alias("_eval"), F.col("_cell").alias("_e"))
    parts = cells.join(F.broadcast(evals), F.col("_cell") <= F.col("_e")).select("_cell", F.col("_eval").alias("fold"), F.when(F.col("_cell") == F.col("_e"), "test").otherwise("train").alias("part"))
    rows = scored.join(F.broadcast(cells), "fold").select("_cell", row, "y", *models)
    kept = splits.Folds(saved(rows), saved(parts))
    return calibrated(logistic(ridge)(Prepared(kept, kept.spread(), []), models, "y", row), row, None).select("fold", row, "y", "p")


def agreement(scored: DataFrame, models: list[str], train: DataFrame) -> DataFrame:
    """scored with the models' mean and standard deviation, and `quintile` (0 agree ... 4 disagree) by cuts of `train`'s deviations; values at a cut fall above."""
    mean = sum(F.col(m) for m in models) / len(models)
    dev = lambda df: df.withColumn("mean", mean).withColumn("std", F.sqrt(sum(F.pow(F.col(m) - F.col("mean"), F.lit(2.0)) for m in models) / len(models)))
    cuts = evaluate.quantiles(dev(train), "std", [0.2, 0.4, 0.6, 0.8])
    met = dev(scored).crossJoin(F.broadcast(cuts))  # one row
    return met.withColumn("quintile", F.size(F.filter("cuts", lambda c: c <= F.col("std")))).drop("cuts")


def search(rows: DataFrame | splits.Folds, y: str, row: str, configs: dict[str, tuple[list[str], float]], day: str | None = None) -> DataFrame:
    """(config, n, log_loss, accuracy, brier) over all test rows of each configuration: the features of its logistic model, and its penalty.

    Configurations are fitted side by side: a round reads each row once for all of them. What a configuration lacks has no coefficient in it, and a
    penalty is a unit one on scaled features. Features are scaled on each fold's training rows first.
    """
    features = sorted({f for used, _ in configs.values() for f in used})
    return _searched(prepared(rows, row, day, [Step("zscore", tuple(features))]), features, y, configs)


def _searched(given: Prepared, features: list[str], y: str, configs: dict[str, tuple[list[str], float]]) -> DataFrame:
    features = [f for f in features if any(f in used for used, _ in configs.values())]
    uses = {name: [penalty**-0.5 if f in used else 0.0 for f in features] for name, (used, penalty) in configs.items()}
    coef = given.fitted(features, y, 1.0, uses)
    p = calibrate.clipped(calibrate.sigmoid(calibrate.linear(F.col("coef"), [F.col(f) for f in features])))
    scored = given.rows.where("part = 'test'").dropna(subset=[*features, y]).join(F.broadcast(coef), "fold").select("config", F.col(y).alias("y"), p.alias("p"))  # a row a configuration and fold
    return evaluate.binary_scores(scored, ["config"])


def drawn_configs(features: list[str], n: int, seed: int = 42, penalties: tuple[float, float] = (0.01, 100.0)) -> dict[str, tuple[list[str], float]]:
    """n random configurations: every feature in with even odds (one at least), penalties even in their logarithm."""
    import random

    rng, out = random.Random(seed), {}
    for k in range(n):
        used = [f for f in features if rng.random() < 0.5] or [rng.choice(features)]
        out[f"c{k:03d}"] = (used, penalties[0] * (penalties[1] / penalties[0]) ** rng.random())
    return out


def ablation(rows: DataFrame | splits.Folds, y: str, row: str, groups: dict[str, list[str]], ridge: float = 1.0, day: str | None = None) -> DataFrame:
    """(left_out, n, log_loss, accuracy, brier, worse): the scores without each group of features, and by how much the log loss is worse than with all (a null left_out)."""
    every = [f for fs in groups.values() for f in fs]
    configs = {"": (every, ridge)} | {g: ([f for f in every if f not in fs], ridge) for g, fs in groups.items()}
    got = search(rows, y, row, configs, day)
    base = got.where("config = ''").select(F.col("log_loss").alias("_all"))
    return got.crossJoin(F.broadcast(base)).select(F.when(F.col("config") != "", F.col("config")).alias("left_out"), "n", "log_loss", "accuracy", "brier", (F.col("log_loss") - F.col("_all")).alias("worse"))  # one row


def forward_selection(rows: DataFrame | splits.Folds, y: str, row: str, features: list[str], ridge: float = 1.0, least: float = 0.0, day: str | None = None) -> list[tuple[str, float]]:
    """[(feature, log loss with it and those before)]: greedily, the feature that lowers the test log loss most, while it does by more than `least`.

    A step is one job over all candidates; the driver sees their scores only. Of equal scores the first name is taken.
    """
    given, chosen, best = prepared(rows, row, day, [Step("zscore", tuple(sorted(features)))]), [], float("inf")
    while len(chosen) < len(features):
        used = [f for f, _ in chosen]
        tried = _searched(given, sorted(features), y, {f: ([*used, f], ridge) for f in features if f not in used}).select("log_loss", "config").collect()
        loss, name = min((r["log_loss"], r["config"]) for r in tried)
        if loss >= best - least:
            break
        chosen.append((name, loss))
        best = loss
    return chosen
