"""Backtests by hand: gaps, costs, folds, membership, and paths against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest

from tidemark.operators import simulate

DAY = dt.date(2024, 1, 1)
at = lambda k: DAY + dt.timedelta(k)


def test_a_name_without_a_row_on_the_rebalance_day_is_held_from_the_next(spark):
    rets = spark.createDataFrame([(at(1), "a", 0.1), (at(2), "a", 0.1), (at(2), "b", 0.2), (at(3), "a", 0.0), (at(4), "a", 0.1), (at(4), "b", -0.1)], "d date, ticker string, ret double")
    weights = spark.createDataFrame([(1, at(1), "a", 0.5), (1, at(1), "b", 0.5), (1, at(3), "b", 1.0)], "fold int, d date, ticker string, w double")
    ends = spark.createDataFrame([(1, at(9))], "fold int, end date")
    rate = simulate.rates(spark.createDataFrame([("a", "factor", 0.00252), ("b", None, None)], "ticker string, category string, expense_ratio double"))
    changed = simulate.moves(weights)
    assert {(r.ticker, r.old, r.new) for r in changed.collect()} == {("a", 0.5, 0.0), ("b", 0.5, 1.0)}
    costs = simulate.fund_costs(changed, rate)
    got = {r.d: (r.ret, r.invested) for r in simulate.run(rets, weights, ends, 0.01, rate, costs).collect()}
    own = 0.5 * 0.00252 / 252 + 0.5 * 0.0008 / 252
    assert got[at(2)] == (pytest.approx(0.15 - own), 1.0)
    assert got[at(3)] == (pytest.approx(0.5 * 0.01 - own), 0.5)  # b is cash for the day
    assert got[at(4)] == (pytest.approx(-0.1 - 0.0008 / 252 - 0.5 * 3e-4 - 0.5 * 4e-4), 1.0)
    assert set(got) == {at(2), at(3), at(4)}


def test_members_listed_and_alive(spark):
    weights = spark.createDataFrame([(1, at(k), t, 0.5) for k in (0, 5, 10) for t in ("a", "b")], "fold int, d date, ticker string, w double")
    spans = spark.createDataFrame([("a", at(0), at(5)), ("a", at(8), None), ("b", at(1), None)], "ticker string, start_date date, end_date date")
    kept = simulate.members_only(weights, spans)
    assert {(r.d, r.ticker) for r in kept.collect()} == {(at(0), "a"), (at(5), "b"), (at(10), "a"), (at(10), "b")}
    assert {r.w for r in simulate.renormalised(kept).where("d < '2024-01-08'").collect()} == {1.0}
    with pytest.raises(ValueError, match="not members"):
        simulate.members_only(weights, spans, strict=True)
    assert simulate.members_only(kept, spans, strict=True).count() == 4
    universe = spark.createDataFrame([("a", at(0), at(5)), ("b", at(5), None)], "ticker string, inception_date date, closure_date date")
    assert {(r.d, r.ticker) for r in simulate.listed_only(weights, universe).collect()} == {(at(0), "a"), (at(5), "a"), (at(5), "b"), (at(10), "a"), (at(10), "b")}
    assert {(r.d, r.ticker) for r in simulate.alive_only(weights, universe).collect()} == {(at(0), "a"), (at(5), "b"), (at(10), "b")}


def test_a_day_of_two_folds_counts_in_the_first(spark):
    folds = spark.createDataFrame([(1, at(0), 0.1), (1, at(1), 0.2), (2, at(1), 0.3), (2, at(2), 0.4)], "fold int, d date, ret double")
    assert {r.d: r.ret for r in simulate.pooled(folds).collect()} == {at(0): 0.1, at(1): 0.2, at(2): 0.4}


def test_costs_by_size_and_share(spark):
    changed = spark.createDataFrame([(1, at(0), "a", 0.0, 0.4), (1, at(0), "b", 0.5, 0.3)], "fold int, d date, ticker string, old double, new double")
    figures = spark.createDataFrame([(1, at(0), "a", 5e11, 20.0), (1, at(0), "b", None, None)], "fold int, d date, ticker string, cap double, px double")
    row = simulate.stock_costs(changed, figures, 1e6).first()
    assert row.cost == pytest.approx(0.4 * 2e-4 + 0.4 * 1e6 / 20 * 0.005 / 1e6 + 0.2 * 75e-4) and row.turnover == pytest.approx(0.3)


def _days(spark, seed, n, worst):
    rng = random.Random(seed)
    rows = [(p, at(k), [rng.gauss(0, 0.05) if rng.random() > worst else -1.0 for _ in goal], goal, rng.random() < 0.05) for p, goal in (("x", [0.5, 0.5]), ("y", [0.2, 0.8])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "portfolio string, d date, rets array<double>, goal array<double>, flip boolean").repartition(3)


def test_drift_and_flips_by_a_plain_loop(spark):
    rows, days = _days(spark, 1, 90, 0.1)
    got = {(r.portfolio, r.d): r.ret for r in simulate.drift_rebalanced(days, 0.05, 20).collect()}
    flips = {(r.portfolio, r.d): r.ret for r in simulate.flip_rebalanced(days.where("d <= '2024-02-20'"), 10.0, 20).collect()}
    for name in ("x", "y"):
        mine = [r for r in rows if r[0] == name]
        goal = np.array(mine[0][3])
        w, mark = goal, 0
        for i, (_, d, rets, _, _) in enumerate(mine):
            value = w * (1 + np.array(rets))
            if value.sum() <= 0:
                assert got[name, d] == -1.0
                w = goal
                continue
            assert got[name, d] == pytest.approx(w @ np.array(rets))
            w = value / value.sum()
            if i + 1 - mark >= 20:
                w, mark = goal, i + 1
            elif (abs(w - goal) > 0.05).any():
                w = goal
    rows, days = _days(spark, 2, 90, 0.0)
    flips = {(r.portfolio, r.d): r.ret for r in simulate.flip_rebalanced(days, 10.0, 20).collect()}
    for name in ("x", "y"):
        mine = [r for r in rows if r[0] == name]
        goal, start = np.array(mine[0][3]), 0
        ends = [i for i, r in enumerate(mine) if r[4] or (i + 1) % 20 == 0] + [len(mine) - 1]
        for end in dict.fromkeys(ends):
            grown = np.cumprod(1 + np.array([r[2] for r in mine[start : end + 1]]), axis=0) @ goal
            want = np.diff(np.concatenate([[1.0], grown])) / np.concatenate([[1.0], grown[:-1]])
            if mine[end][4] or (end + 1) % 20 == 0:
                want[-1] -= 0.001
            assert np.allclose([flips[name, r[1]] for r in mine[start : end + 1]], want)
            start = end + 1
