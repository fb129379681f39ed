"""Characteristics, masks and pooled sleeves by hand and by plain loops."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import allocate
from tidemark.operators import characteristics as chars

DAY = dt.date(2020, 1, 1)
at = lambda k: DAY + dt.timedelta(int(k))


def test_momentum_by_offsets_from_the_end(spark):
    rng = np.random.default_rng(2)
    px = {t: np.exp(np.cumsum(rng.normal(0, 0.02, 800))) for t in ("m", "s")}
    df = spark.createDataFrame([(t, at(k), float(v)) for t, p in px.items() for k, v in enumerate(p)] + [("m", at(900), None)], "ticker string, d date, px double")
    got = {(r.ticker, r.d): r for r in chars.price_characteristics(df, "m").collect()}
    p, r = px["s"], got["s", at(799)]
    assert r.mom_12m_1m == pytest.approx(math.log(p[-23] / p[-253])) and r.mom_1m_1m == pytest.approx(math.log(p[-2] / p[-23])) and r.mom_36m_13m == pytest.approx(math.log(p[-274] / p[-757]))
    six = lambda q: math.log(q[-23] / q[-127])
    assert r.chmom == pytest.approx(six(p) - six(p[:-126]))
    ret = p[1:] / p[:-1] - 1
    assert r.maxret_22d == pytest.approx(ret[-22:].max()) and r.retvol_22d == pytest.approx(ret[-22:].std(ddof=1) * np.sqrt(252))
    assert got["m", at(799)].beta_252d == pytest.approx(1) and got["s", at(20)].maxret_22d is None and got["s", at(21)].maxret_22d is not None


def test_skipped_momentum_takes_own_first_and_last_prices(spark):
    rows = [("full", at(k), 100.0 + k) for k in range(40)] + [("late", at(k), 50.0 + k) for k in range(10, 40)] + [("few", at(k), 1.0) for k in range(28, 40)] + [("gap", at(k), 0.0 if k < 12 else 5.0) for k in range(40) if k != 15]
    df = spark.createDataFrame(rows, "ticker string, d date, px double")
    when = spark.createDataFrame([(at(36),), (at(26),), (at(36),)], "at date")
    got = {(r.at, r.ticker): r.score for r in chars.skipped_momentum(df, when, lookback=20, skip=5).collect()}
    # the last day before is 35; the window is days 11 to 30
    assert got == {(at(36), "full"): pytest.approx(130 / 111 - 1), (at(36), "late"): pytest.approx(80 / 61 - 1), (at(26), "full"): pytest.approx(120 / 101 - 1), (at(26), "late"): pytest.approx(70 / 60 - 1)}


def test_volume_figures(spark):
    n = 22
    bars = [("a", at(k), 11.0, 9.0, 10.0 + k % 2, 0.0 if k == 3 else 100.0, 1000.0) for k in range(n)]
    df = spark.createDataFrame(bars, "ticker string, d date, high double, low double, close double, volume double, shares double")
    r = {x.d: x for x in chars.volume_characteristics(df).collect()}[at(n - 1)]
    dv = np.array([b[4] * b[5] for b in bars])
    ret = np.abs(np.array([bars[k][4] / bars[k - 1][4] - 1 for k in range(1, n)]))
    assert r.turn_22d == pytest.approx(2100 / 22 / 1000) and r.dolvol_22d == pytest.approx(np.log(dv.mean())) and r.std_dolvol == pytest.approx(np.log(dv[dv > 0]).std(ddof=1))
    assert r.ill_amihud == pytest.approx((ret[dv[1:] > 0] / dv[1:][dv[1:] > 0]).mean()) and r.baspread_hl == pytest.approx(0.2) and r.zerotrade == pytest.approx(1 / 22)


def test_masks_peers_and_splits(spark):
    df = spark.createDataFrame([("s", at(k), float(k)) for k in range(10)], "ticker string, d date, ret double")
    masks = chars.regime_masks("d", "2020-01-04", {"w": ("2020-01-05", "2020-01-06"), "all": ("2019-01-01", "2021-01-01")})
    kept = {r["mask"]: (r.n_kept, r.first, r.last) for r in chars.mask_coverage(df, ["ticker"], "d", masks).collect()}
    assert kept == {"full": (10, at(0), at(9)), "pre_2020": (3, at(0), at(2)), "post_2020": (7, at(3), at(9)), "ex_w": (8, at(0), at(9)), "ex_all": (0, None, None)}
    assert chars.masked(df, masks).groupBy("mask").count().count() == 4
    peers = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("c", "x", None), ("d", "y", 5.0), ("e", None, 7.0)], "ticker string, sector string, v double")
    assert {r.ticker: r.p for r in chars.peer_mean(peers, ["sector"], "v", "p").collect()} == {"a": 3.0, "b": 1.0, "c": 2.0, "d": 5.0, "e": None}
    parts = {r.d: r.part for r in chars.recent_split(df, "d").collect()}
    assert [d for d, p in sorted(parts.items()) if p == "val"] == [at(8), at(9)] and {r.part for r in chars.recent_split(df.limit(4), "d").collect()} == {"train"}


def test_a_sleeve_that_misses_a_day_is_out_until_the_next_segment(spark):
    rets = {"a": [0.1, 0.2, 0.0, 0.1], "b": [0.5, None, 0.3, 0.2], "c": [0.0, 0.1, 0.1, None]}
    df = spark.createDataFrame([(t, at(k), r) for t, rs in rets.items() for k, r in enumerate(rs) if r is not None], "ticker string, d date, ret double")
    got = {r.d: (r.ret, r.live) for r in allocate.pooled_sleeves(df, F.when(F.col("d") < at(3), 1).otherwise(2)).collect()}
    assert got[at(0)] == (pytest.approx(0.2), 3)
    assert got[at(1)] == (pytest.approx((1.1 * 0.2 + 1.0 * 0.1) / 3.6), 3)
    assert got[at(2)] == (pytest.approx((1.1 * 1.2 * 0.0 + 1.1 * 0.1) / (1.1 * 1.2 + 1.1)), 2)
    assert got[at(3)] == (pytest.approx(0.1), 3)
