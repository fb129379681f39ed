"""Fold runs: what is guarded, what a fold sees, reruns."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import experiment, splits
from tidemark.plans import calibration
from tidemark.sources.saved import shared_folder


def _games(n=600):
    rng = np.random.default_rng(11)
    rows = [(k, 2000 + k * 6 // n, k, float(a), None if k % 50 == 7 else float(b), int(rng.random() < 1 / (1 + np.exp(-a + 0.5 * b)))) for k, (a, b) in enumerate(rng.normal(size=(n, 2)) * [2, 1] + [1, 5])]
    return rows, "id long, season int, day int, a double, b double, y int"


def _newton(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.array([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
    return w


def test_each_fold_is_fitted_on_its_own_earlier_rows(spark):
    rows, schema = _games()
    df = spark.createDataFrame(rows, schema)
    steps = [experiment.Step("mean", ("b",)), experiment.Step("zscore", ("a", "b"))]
    got = experiment.run(experiment.season_folds(df, "season", "expanding"), ["a", "b"], "y", "id", steps=steps, method=None, day="day")
    out = {(r.fold, r.id): r.raw for r in got.collect()}
    assert {f for f, _ in out} == {2002, 2003, 2004, 2005} and len(out) == sum(r[1] >= 2002 for r in rows)
    for fold in (2002, 2005):
        train = np.array([r for r in rows if r[1] < fold], float)
        test = np.array([r for r in rows if r[1] == fold], float)
        fill = np.nanmean(train[:, 4])
        for x in (train, test):
            x[:, 4] = np.where(np.isnan(x[:, 4]), fill, x[:, 4])
        mean, dev = train[:, 3:5].mean(0), train[:, 3:5].std(0, ddof=1)
        w = _newton((train[:, 3:5] - mean) / dev, train[:, 5])
        want = 1 / (1 + np.exp(-(w[0] + (test[:, 3:5] - mean) / dev @ w[1:])))
        assert np.allclose([out[fold, int(k)] for k in test[:, 0]], want, atol=1e-8)


def test_guards_stop_a_run(spark):
    rows, schema = _games(120)
    df = spark.createDataFrame(rows, schema)
    folds = experiment.season_folds(df, "season", "previous")
    with pytest.raises(ValueError, match="twice"):
        experiment.run(folds.unionByName(folds.limit(1)), ["a"], "y", "id")
    with pytest.raises(ValueError, match="after the test"):
        experiment.run(experiment.season_folds(df, "season", "leave_one_out"), ["a"], "y", "id", day="day")
    parts = {(r.fold, r.season): r.part for r in folds.select("fold", "season", "part").distinct().collect()}
    assert parts[2003, 2002] == "cal" and parts[2003, 2001] == parts[2003, 2000] == "train" and parts[2003, 2003] == "test" and (2003, 2004) not in parts


def test_trees_give_importances_and_reruns_agree(spark):
    rows, schema = _games(300)
    folds = splits.walk_forward(spark.createDataFrame(rows, schema).withColumn("b", F.lit(1.0)), "season", "day", "id", 3, 50).withColumnRenamed("eval", "fold")
    importances: dict = {}
    runs = [sorted(tuple(r) for r in experiment.run(folds, ["a", "b"], "y", "id", experiment.boosted(importances, maxIter=5), steps=[]).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len({r[0] for r in runs[0]}) == 3
    assert all(i == {"a": 1.0, "b": 0.0} for i in importances.values()) and len(importances) == 3
    assert all(0.03 <= r[4] <= 0.97 for r in runs[0])


def _written(spark, made):
    """Rows of the saved tables that made() leaves."""
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    made()
    return sum(spark.read.parquet(f"{folder}/{t}").count() for t in set(os.listdir(folder)) - before)


@pytest.mark.parametrize("name", ["v16_leave_one_season_out", "v14_stacked", "v18_y34_ablation", "y33_fixed_windows"])
def test_rows_are_stored_once_and_not_for_each_fold(spark, name):
    n = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert n <= _written(spark, lambda: getattr(calibration, name)(spark, "/root/testdata/sf0.001").collect()) < 1.2 * n


def test_rows_stored_once_give_what_spread_ones_give(spark):
    rows, schema = _games()
    df = spark.createDataFrame(rows, schema)
    steps = [experiment.Step("mean", ("b",)), experiment.Step("minmax", ("a", "b"))]
    for kind in ("previous", "expanding"):
        got = [experiment.run(folds(df, "season", kind), ["a", "b"], "y", "id", steps=steps, method="platt", day="day").collect() for folds in (experiment.seasons, experiment.season_folds)]
        once, spread = [{(r.fold, r.id): (r.raw, r.p) for r in g} for g in got]
        assert once.keys() == spread.keys() and np.allclose([once[k] for k in once], [spread[k] for k in once], atol=1e-9)
    with pytest.raises(ValueError, match="twice"):
        experiment.run(experiment.seasons(df.unionByName(df.limit(1)), "season"), ["a"], "y", "id")


@pytest.mark.parametrize("days", [1, 7, 600])
def test_walk_forward_cuts_inside_a_day(spark, days):
    rng = np.random.default_rng(days)
    rows = [(int(i), int(2000 + s), None if d == 5 else int(d)) for i, s, d in zip(rng.permutation(900), rng.integers(0, 6, 900), rng.integers(0, days, 900))]
    folds = splits.walked(spark.createDataFrame(rows, "id long, season int, day int").repartition(5), "season", "day", "id", 2)
    assert folds.rows.count() == 900 and folds.rows.select("id").distinct().count() == 900
    got = {(r.eval, r.id): r.part for r in folds.spread("eval").collect()}
    ranked = sorted(rows, key=lambda r: (r[1], -1 if r[2] is None else r[2], r[0]))
    want = {}
    for fold in range(2002, 2006):
        earlier = [r[0] for r in ranked if r[1] < fold]
        want |= {(fold, i): "train" if k < int(len(earlier) * 0.8 + 1e-9) else "cal" for k, i in enumerate(earlier)}
        want |= {(fold, r[0]): "test" for r in rows if r[1] == fold}
    assert got == want
