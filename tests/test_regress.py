"""Least squares, solvers and correlations against numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import experiment, inference, regress

DAY = dt.date(2020, 1, 1)
at = lambda k: DAY + dt.timedelta(int(k))


def test_least_squares_with_t_and_share(spark):
    rng = np.random.default_rng(1)
    rows = [(g, *map(float, x), float(1 + k * x[0] - 2 * x[1] + e)) for k, g in enumerate(["a", None]) for x, e in zip(rng.normal(size=(50, 2)) + 5, rng.normal(size=50))]
    df = spark.createDataFrame([*rows, ("a", None, 1.0, 1.0), ("one", 1.0, 2.0, 3.0)], "g string, x1 double, x2 double, y double")
    got = {r.g: r for r in regress.least_squares(df, ["g"], "y", ["x1", "x2"]).collect()}
    for g in ("a", None):
        x = np.array([(1, *r[1:3]) for r in rows if r[0] == g])
        y = np.array([r[3] for r in rows if r[0] == g])
        b, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
        t = b / np.sqrt(rss / (50 - 3) * np.diag(np.linalg.inv(x.T @ x)))
        assert np.allclose(got[g].coef, b) and np.allclose(got[g].t, t) and got[g].r2 == pytest.approx(float(1 - rss[0] / ((y - y.mean()) ** 2).sum()))
    assert got["one"].n == 1 and got["one"].t == [None] * 3 and got["one"].r2 is None
    ridge = regress.least_squares(df.where("g = 'a'"), ["g"], "y", ["x1"], ridge=7.0).first()
    x, y = (np.array([r[i] for r in rows if r[0] == "a"]) for i in (1, 3))
    assert ridge.coef[1] == pytest.approx(((x - x.mean()) * (y - y.mean())).sum() / (((x - x.mean()) ** 2).sum() + 7))


def _panel(spark, n=200, k=4, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, k)) @ np.diag([1, 2, 0.5, 1])[:k, :k] @ (np.eye(k) + 0.3)
    return x, spark.createDataFrame([("g", at(i), f"t{j}", float(x[i, j])) for i in range(n) for j in range(k)], "g string, d date, ticker string, ret double")


def test_weights_of_equal_risk_and_least_deviation(spark):
    x, rows = _panel(spark)
    cov = regress.covariances(rows.unionByName(rows.select("g", "d", F.lit("flat").alias("ticker"), F.lit(0.0).alias("ret"))), ["g"])
    c = np.cov(x.T)
    w = {r.ticker: r.w for r in regress.solved_weights(cov, ["g"]).collect()}
    v = np.array([w[f"t{j}"] for j in range(4)])
    share = v * (c @ v) / (v @ c @ v)
    assert "flat" not in w and v.sum() == pytest.approx(1) and np.allclose(share, 0.25, atol=1e-6)
    w = {r.ticker: r.w for r in regress.solved_weights(cov, ["g"], "least_vol").collect()}
    v = np.array([w[f"t{j}"] for j in range(4)])
    tries = np.random.default_rng(0).dirichlet([0.3] * 4, 20_000)
    assert v.sum() == pytest.approx(1) and (v >= 0).all() and v @ c @ v <= np.einsum("ni,ij,nj->n", tries, c, tries).min() + 1e-9


def test_mean_correlation_of_all_pairs(spark):
    x, rows = _panel(spark, 60, 3)
    gap = rows.where(~((F.col("ticker") == "t1") & (F.col("d") == at(30))))
    got = {r.d: r["corr"] for r in regress.mean_pair_correlation(gap, ["g"], 20).collect()}
    kept = np.delete(x, 30, 0)
    assert at(30) not in got and len(got) == 59 - 9
    for i in (9, 25, 58):
        c = np.corrcoef(kept[max(0, i - 19) : i + 1].T)
        assert got[at(i if i < 30 else i + 1)] == pytest.approx((c.sum() - 3) / 6)


def test_residual_deviation(spark):
    rng = np.random.default_rng(5)
    b = rng.normal(size=300)
    s = 1.5 * b + rng.normal(size=300)
    df = spark.createDataFrame([("a", at(i), float(s[i]), float(b[i])) for i in range(300)], "ticker string, d date, ret double, bench double")
    got = {r.d: (r.beta, r.idio) for r in regress.residual_vol(df).collect()}
    assert got[at(124)] == (None, None)
    for i in (125, 299):
        lo = max(0, i - 251)
        beta = np.cov(s[lo : i + 1], b[lo : i + 1])[0, 1] / b[lo : i + 1].var(ddof=1)
        left = (s - beta * b)[max(0, i - 125) : i + 1]
        assert got[at(i)] == (pytest.approx(beta), pytest.approx(left.std(ddof=1) * np.sqrt(252)))


def test_drawdowns_of_paths(spark):
    rng = np.random.default_rng(6)
    s, b = rng.normal(0, 0.02, (2, 120))
    df = spark.createDataFrame([("a", at(i), float(s[i]), float(b[i])) for i in range(120)], "ticker string, d date, ret double, bench double")
    fall = lambda r: float(min(0, (np.cumprod(1 + r) / np.maximum.accumulate(np.concatenate([[1.0], np.cumprod(1 + r)]))[1:] - 1).min()))
    got = inference.drawdown_interval(df, ["ticker"], reps=300).first()
    paths = inference.resamples(df, ["ticker"], ["ret", "bench"], 300).collect()
    diffs = [fall(np.array(p.ret)) - fall(np.array(p.bench)) for p in paths]
    assert got.point == pytest.approx(fall(s) - fall(b)) and got.low == pytest.approx(np.quantile(diffs, 0.05)) and got.high == pytest.approx(np.quantile(diffs, 0.95))


def test_search_scores_each_configuration_as_its_own_run(spark):
    rng = np.random.default_rng(8)
    rows = [(k, 2000 + k // 100, k, *map(float, v), int(rng.random() < 1 / (1 + np.exp(-2 * v[0] + v[1])))) for k, v in enumerate(rng.normal(size=(500, 3)))]
    df = experiment.season_folds(spark.createDataFrame(rows, "id long, season int, day int, a double, b double, c double, y int"), "season", "expanding")
    got = {r.config: r.log_loss for r in experiment.search(df, "y", "id", {"ab": (["a", "b"], 1.0), "c": (["c"], 9.0)}, "day").collect()}
    one = lambda features, ridge: experiment.summary(experiment.run(df, features, "y", "id", experiment.logistic(ridge), method=None)).where("fold is null").first().log_loss
    assert got["ab"] == pytest.approx(one(["a", "b"], 1.0), abs=1e-8) and got["c"] == pytest.approx(one(["c"], 9.0), abs=1e-8)
    chosen = experiment.forward_selection(df, "y", "id", ["a", "b", "c"], least=0.002)
    assert [f for f, _ in chosen] == ["a", "b"] and chosen[1][1] == pytest.approx(got["ab"], abs=1e-8)
    worse = {r.left_out: r.worse for r in experiment.ablation(df, "y", "id", {"ab": ["a", "b"], "c": ["c"]}).collect()}
    assert worse[None] == 0 and worse["ab"] > 0.1 > worse["c"]
