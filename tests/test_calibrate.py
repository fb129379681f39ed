"""Fits against plain loops and Newton steps in numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibrate

SCHEMA = "g string, p double, y int"


def _rows(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), rng.choice([round(rng.random(), 2), rng.random()]), 0) for _ in range(n)]
    return [(g, p, int(rng.random() < p * p)) for g, p, _ in rows]


def _pav(points):
    """[(lo, hi, mean)] of points (x, y) by pooling until nothing falls."""
    blocks = []
    for x in sorted({x for x, _ in points}):
        ys = [y for a, y in points if a == x]
        blocks.append([x, x, len(ys), sum(ys)])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            _, hi, n, s = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + n, blocks[-1][3] + s]
    return [(lo, hi, s / n) for lo, hi, n, s in blocks]


def test_isotonic_steps_and_lines_between_them(spark):
    rows = _rows(1, 1500)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    blocks = calibrate.isotonic(df, ["g"])
    at = spark.createDataFrame([(g, x) for g in ("a", "b", None, "none") for x in (0.0, 1.0, *[k / 97 for k in range(98)])], "g string, x double")
    got = {(r.g, r.x): r.q for r in calibrate.apply_isotonic(at, blocks, ["g"], "x", "q").collect()}
    for g in ("a", "b", None):
        want = _pav([(p, y) for k, p, y in rows if k == g])
        mine = sorted((r.lo, r.hi, r.value) for r in blocks.where(F.col("g").eqNullSafe(F.lit(g))).collect())
        assert np.allclose(mine, want)
        xs, vs = zip(*[(x, v) for lo, hi, v in want for x in dict.fromkeys((lo, hi))])
        assert all(abs(got[g, x] - np.interp(x, xs, vs)) < 1e-9 for k, x in got if k == g)
    assert len(got) == 392 and got["none", 0.0] is None
    assert calibrate.isotonic(df.limit(0), ["g"]).count() == 0


def test_isotonic_without_groups(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.1, 1), ("b", 0.3, 0), ("b", None, 1), ("b", 0.9, None)], SCHEMA)
    assert [(r.lo, r.hi, r.value) for r in calibrate.isotonic(df, []).collect()] == [(0.1, 0.3, pytest.approx(1 / 3))]


def _newton(x, y, ridge):
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
    return w


def test_logistic_fits_of_all_groups_at_once(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(a), float(b), int(rng.random() < 1 / (1 + np.exp(-(0.3 + k * a - b))))) for k, g in enumerate(["a", "b", None]) for a, b in rng.normal(size=(400, 2))]
    rows += [("null", None, 1.0, 1), ("c", 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y int")
    got = {r.g: r for r in calibrate.fitted(df, ["g"], ["a", "b"], ridge=2.0).collect()}
    assert set(got) == {"a", "b", None, "c"}
    for g in ("a", "b", None):
        mine = np.array([(1, a, b, y) for k, a, b, y in rows if k == g])
        assert np.allclose(got[g].coef, _newton(mine[:, :3], mine[:, 3], np.array([0, 2.0, 2.0])), atol=1e-6)
    with pytest.raises(ValueError):
        calibrate.renormalised(F.array(F.lit(0.5)), 0.0)


def test_temperature_is_the_best_of_a_fine_grid(spark):
    rng = np.random.default_rng(5)
    q = rng.dirichlet([1, 1, 1], 500)
    sharp = q**2 / (q**2).sum(1, keepdims=True)
    c = [int(rng.choice(3, p=p)) for p in sharp]
    got = calibrate.temperature(spark.createDataFrame([("x", p.tolist(), k) for p, k in zip(q, c)], "g string, q array<double>, c int"), ["g"]).first()
    loss = lambda t: -np.mean(np.log((q ** (1 / t) / (q ** (1 / t)).sum(1, keepdims=True))[np.arange(500), c]))
    best = min(np.linspace(0.2, 2, 3601), key=loss)
    assert abs(got.t - best) < 1e-3 and abs(got.loss - loss(best)) < 1e-6


def test_draw_curves_and_slopes(spark):
    rng = np.random.default_rng(7)
    gaps = rng.uniform(-400, 400, 4000)
    drawn = (rng.random(4000) < 0.3 * np.exp(-((gaps / 200) ** 2))).astype(int)
    df = spark.createDataFrame([("all", float(g), int(d)) for g, d in zip(gaps, drawn)] + [("few", 10.0, 1), ("flat", 10.0, 0), ("flat", 200.0, 1), ("flat", 200.0, 0), ("flat", 10.0, 0)], "g string, gap double, d int")
    got = {r.g: r for r in calibrate.draw_curve(df.where("g <> 'few'"), ["g"], "gap", "d").collect()}

    def loss(base, spread):
        p = base * np.exp(-((gaps / spread) ** 2))
        return -np.mean(drawn * np.log(p) + (1 - drawn) * np.log(1 - p))

    base, spread = min(((b, s) for b in np.linspace(0.2, 0.4, 81) for s in np.linspace(150, 260, 111)), key=lambda v: loss(*v))
    assert got["all"].loss <= loss(base, spread) and abs(got["all"].base - base) < 0.005 and abs(got["all"].spread - spread) < 2
    assert got["flat"].spread is None
    slopes = {r.g: (r.n, r.slope) for r in calibrate.gap_slope(df, ["g"], "gap", "d").collect()}
    assert slopes["few"] == (1, 0.0) and slopes["all"][0] == 4000
    assert abs(slopes["all"][1] - _newton(gaps[:, None], drawn, np.zeros(1))[0]) < 1e-7


def test_fits_with_other_features_and_penalties_side_by_side_and_in_turns(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(g, float(a), float(b), int(rng.random() < 1 / (1 + np.exp(-(0.3 + a - b))))) for g in ["a", None] for a, b in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "g string, a double, b double, y int")
    uses = {"both": [1.0, 1.0], "b": [0.0, 0.5]}
    monkeypatch.setattr(calibrate, "SIDE_BY_SIDE", 2)
    got = {(r.config, r.g): r for r in calibrate.fitted(df, ["g"], ["a", "b"], ridge=1.0, uses=uses).collect()}
    assert len(got) == 4
    for g in ("a", None):
        mine = np.array([(1, a, b, y) for k, a, b, y in rows if k == g])
        assert np.allclose(got["both", g].coef, _newton(mine[:, :3], mine[:, 3], np.array([0, 1.0, 1.0])), atol=1e-6)
        alone = _newton(mine[:, [0, 2]], mine[:, 3], np.array([0, 4.0]))
        assert np.allclose(got["b", g].coef, [alone[0], 0, alone[1]], atol=1e-6) and got["b", g].n == 300


def test_draw_curves_of_arrays_are_those_of_each_place_alone(spark):
    rng = random.Random(9)
    rows = [([rng.gauss(0, 100), rng.gauss(0, 200), rng.gauss(50, 300)], int(rng.random() < 0.25)) for _ in range(500)] + [([1.0, None, 2.0], 1), (None, 0), ([0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "gaps array<double>, d int")
    got = sorted(tuple(r) for r in calibrate.draw_curves(df, "gaps", "d").collect())
    flat = df.where("d is not null and not exists(gaps, g -> g is null)").select("d", F.posexplode("gaps").alias("at", "gap"))
    want = sorted(tuple(r) for r in calibrate.draw_curve(flat, ["at"], "gap", "d").collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] == [(0, 500), (1, 500), (2, 500)]
    for g, w in zip(got, want):
        assert all(a == b or a == pytest.approx(b, rel=1e-6) for a, b in zip(g, w))
    assert calibrate.draw_curves(df.limit(0), "gaps", "d").count() == 0
