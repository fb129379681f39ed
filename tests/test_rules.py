"""Cases that once went wrong, and ratings and resampling against plain loops."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import betting, evaluate, fundamentals, history, inference, portfolio, splits

SMALL = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def _series(spark, rets, bench=None):
    rows = [("a", DAY + dt.timedelta(k), float(r), float(b)) for k, (r, b) in enumerate(zip(rets, bench or [0.0] * len(rets)))]
    return spark.createDataFrame(rows, "ticker string, d date, ret double, bench double")


def test_nothing_divides_by_zero(spark):
    px = spark.createDataFrame([("a", DAY, 1.0), ("a", DAY + dt.timedelta(1), 0.0), ("a", DAY + dt.timedelta(2), 2.0)], "ticker string, d date, px double")
    assert [r.ret for r in history.returns(px).orderBy("d").collect()] == [None, -1.0, None]
    flat = _series(spark, [0.01] * 80, [0.01] * 80)
    assert all(r.beta is None for r in history.rolling_beta(flat, 60).collect())
    got = portfolio.risk(flat, ["ticker"]).first()
    assert got.sharpe > 1e6 and got.sortino > 1e6 and got.max_dd == 0 and got.dd_days == 0
    assert spark.range(1).select(fn.kelly(F.lit(0.9), F.lit(1.0)).alias("k")).first().k == 0
    rows = spark.createDataFrame([(1, 0.5, False), (2, None, False)], "id int, p double, tr boolean")
    assert {r.r for r in evaluate.percentile_rank(rows, F.col("tr"), "p", "r").collect()} == {None}


def test_a_total_loss_is_never_made_good(spark):
    lost = _series(spark, [0.1, -1.0, 0.1])
    assert [round(r.cum, 6) for r in history.growth(lost).orderBy("d").collect()] == [1.1, 0.0, 0.0]
    assert portfolio.risk(lost, ["ticker"]).first().cagr == -1
    bets = spark.createDataFrame([("g", 1, 1.0, -1.0), ("g", 2, 0.5, 1.0)], "g string, t int, f double, x double")
    assert [r.roll for r in portfolio.bankroll(bets, ["g"], ["t"]).orderBy("t").collect()] == [0.0, 0.0]


def test_risk_figures_by_hand(spark):
    got = portfolio.risk(_series(spark, [0.02, -0.01, 0.03, -0.02]), ["ticker"]).first()
    r = np.array([0.02, -0.01, 0.03, -0.02])
    assert math.isclose(got.sortino, r.mean() / math.sqrt((r[r < 0] ** 2).mean()) * math.sqrt(252), rel_tol=1e-9)
    cum = np.cumprod(1 + r)
    assert math.isclose(got.max_dd, (cum / np.maximum.accumulate(cum) - 1).min(), rel_tol=1e-9) and got.cvar95 == -0.02 and got.ir == 0


def test_stability_bins_are_closed_below(spark):
    train, test = [1, 1, 2, 2, 2, 3, 4, 4, 5, 9], [2, 2, 2, 2, 3, 5, 5, 9, 9, 9]
    rows = spark.createDataFrame([(float(v), True) for v in train] + [(float(v), False) for v in test], "v double, tr boolean")
    cuts = np.unique(np.percentile(train, np.linspace(0, 100, 11)[1:-1]))
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    a, b = (np.maximum(np.histogram(x, edges)[0] / len(x), 1e-6) for x in (train, test))
    assert math.isclose(evaluate.psi(rows, "v", F.col("tr")).first().psi, float(((b - a) * np.log(b / a)).sum()), rel_tol=1e-9)


def test_quantiles_and_ranks_by_numpy(spark):
    values = np.random.default_rng(1).normal(size=3000).round(2)
    rows = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = evaluate.quantiles(rows, "v", [0.0, 0.1, 0.37, 0.5, 1.0]).first().cuts
    assert np.allclose(got, np.quantile(values, [0.0, 0.1, 0.37, 0.5, 1.0]))
    assert {r.v: r.below for r in evaluate.ranked_values(rows, "v").collect()} == {v: int((values < v).sum()) for v in set(values.tolist())}


def test_class_cap_keeps_the_sum_and_leaves_others_alone(spark):
    w = spark.createDataFrame([(1, "a", "x", 0.5), (1, "b", "x", 0.2), (1, "c", "y", 0.2), (2, "a", "x", 0.1)], "d int, ticker string, cls string, w double")
    got = {(r.d, r.ticker): r.w for r in portfolio.class_cap(w, ["d"], "cls", 0.3).collect()}
    assert math.isclose(sum(v for (d, _), v in got.items() if d == 1), 0.9) and got[2, "a"] == 0.1 and math.isclose(got[1, "a"], 0.3 * 5 / 7 * 0.9 / 0.5)


def test_block_sums_are_sums_of_the_drawn_rows(spark):
    rets = np.random.default_rng(2).normal(0, 0.01, 50)
    series = inference.positions(_series(spark, rets), ["ticker"])
    sums = {r.rep: r.ret for r in inference.block_sums(series, ["ticker"], ["ret"], reps=20, mean_block=7).collect()}
    rows = {r.rep: r.ret for r in inference.resamples(_series(spark, rets), ["ticker"], ["ret"], 20, 7).collect()}
    assert len(sums) == 20 and all(len(rows[k]) == 50 and math.isclose(sum(rows[k]), v, abs_tol=1e-12) for k, v in sums.items())
    known = {round(r, 12) for r in rets.tolist()}
    assert all(round(x, 12) in known for r in rows.values() for x in r)


def test_quarters_of_three_reporting_patterns(spark):
    d = dt.date
    q = [(d(2023, 1, 1), d(2023, 3, 31)), (d(2023, 4, 1), d(2023, 6, 30)), (d(2023, 7, 1), d(2023, 9, 30))]
    year = (d(2023, 1, 1), d(2023, 12, 31))
    filings = [("left", s, e, v) for (s, e), v in zip([*q, year], (10.0, 20.0, 30.0, 100.0))]
    filings += [("sums", d(2023, 1, 1), e, v) for (_, e), v in zip([*q, year], (10.0, 30.0, 60.0, 100.0))] + [("short", *q[0], 1.0), ("short", *year, 9.0)]
    rows = [(t, d(2024, 6, 1), "revenue", s, e, v, e + dt.timedelta(40)) for t, s, e, v in filings]
    known = spark.createDataFrame(rows, "ticker string, at date, alias string, start_d date, end_d date, val double, filed date")
    got = {}
    for r in fundamentals.quarterise(known).orderBy("end_d").collect():
        got.setdefault(r.ticker, []).append(r.val)
    assert got == {"left": [10.0, 20.0, 30.0, 40.0], "sums": [10.0, 20.0, 30.0, 40.0]}
    assert {r.ticker: r.val for r in fundamentals.trailing_sums(fundamentals.quarterise(known)).collect()} == {"left": 100.0, "sums": 100.0}


def test_known_rows_of_quarters_are_made_once(spark):
    known = spark.createDataFrame([], "ticker string, at date, alias string, start_d date, end_d date, val double, filed date")
    assert "Union" not in fundamentals.quarterise(known)._jdf.queryExecution().executedPlan().toString()


def test_figures_are_dealt_by_the_pairs_of_filings_and_decisions(spark, monkeypatch):
    d = dt.date
    ends = [d(2022, 3, 31), d(2022, 6, 30), d(2022, 9, 30), d(2022, 12, 31)]
    rows = [(f"t{k}", "us-gaap", concept, "USD", e - dt.timedelta(89), e, float(k + j), e + dt.timedelta(40), "10-Q") for k in range(6) for concept in ("NetIncomeLoss", "Assets") for j, e in enumerate(ends)]
    facts = spark.createDataFrame(rows, "ticker string, taxonomy string, concept string, unit string, start_d date, end_d date, val double, filed date, form string")
    decisions = spark.createDataFrame([(f"t{k}", d(y, 6, 1)) for k in range(6) for y in (2022, 2023, 2024)], "ticker string, at date")
    figures = lambda: fundamentals.metrics(facts, decisions).select("ticker", "at", "ttm_net_income", "total_assets", "latest_filing")
    want = sorted(tuple(r) for r in figures().collect() if r.total_assets is not None)
    assert want[:2] == [("t0", d(2022, 6, 1), None, 0.0, d(2022, 5, 10)), ("t0", d(2023, 6, 1), 6.0, 3.0, d(2023, 2, 9))] and len(want) == 18
    monkeypatch.setattr(fundamentals, "PAIRS", 16)  # 48 filings, each with 3 decisions
    got = figures()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 9), REPARTITION_BY_NUM") == 2
    assert sorted(tuple(r) for r in got.collect() if r.total_assets is not None) == want


def test_a_guard_raises_with_examples(spark):
    late = spark.createDataFrame([(DAY, DAY)], "released date, decided date")
    with pytest.raises(ValueError, match="too late"):
        splits.raise_if_any(splits.released_late(late, "released", "decided"), "too late")


def _events(spark, *rows):
    return spark.createDataFrame([("x", dt.date.fromisoformat(d), kind, "") for d, kind in rows], "ticker string, d date, kind string, reason string")


@pytest.mark.parametrize(
    "rows, seed, want",
    [
        ([("2001-01-01", "add"), ("2005-01-01", "add")], None, [("2001-01-01", "2005-01-01"), ("2005-01-01", None)]),
        ([("2001-01-01", "add"), ("2001-06-01", "remove"), ("2001-06-20", "add")], None, [("2001-01-01", "2001-06-01"), ("2001-06-20", None)]),
        ([("2001-01-01", "add"), ("2001-01-20", "add"), ("2001-02-10", "add")], None, [("2001-01-01", "2001-02-10"), ("2001-02-10", None)]),
        ([("2023-09-17", "add")], "2023-09-18", [("2023-09-17", None)]),
        ([("2010-06-01", "add"), ("2013-05-01", "remove")], "2024-01-01", [("2024-01-01", None)]),
        ([("2010-06-01", "remove"), ("2015-03-01", "add")], "2005-01-01", [("2005-01-01", "2010-06-01"), ("2015-03-01", None)]),
        ([("2005-01-01", "remove")], "2005-01-01", [("2005-01-01", None)]),
    ],
)
def test_membership_from_events(spark, rows, seed, want):
    seeds = spark.createDataFrame([("x", dt.date.fromisoformat(seed))], "ticker string, start_date date") if seed else None
    got = splits.consolidated(_events(spark, *rows), seeds).collect()
    assert sorted((str(r.start_date), None if r.end_date is None else str(r.end_date)) for r in got) == want


def test_orphans_and_reasons(spark):
    seeds = spark.createDataFrame([("x", DAY)], "ticker string, start_date date")
    log = splits.membership(_events(spark, ("2010-06-01", "add"), ("2013-05-01", "remove")), seeds)
    assert {(str(r.start_date), r.what) for r in log.collect()} == {("2010-06-01", "orphan"), ("2013-05-01", "orphan"), ("2024-01-01", "interval")}
    gone = spark.createDataFrame([("y", DAY, "remove", "Filed for bankruptcy"), ("z", DAY, "remove", "Acquired"), ("x", DAY, "remove", "")], "ticker string, d date, kind string, reason string")
    assert {(r.ticker, r.delist_return, r.category) for r in splits.delistings(gone, seeds).collect()} == {("y", -0.99, "bankruptcy"), ("z", 0.0, "acquisition")}


def test_bets_of_a_day_follow_each_other(spark):
    bets = spark.createDataFrame([(1, DAY, 0.05, 0.05), (1, DAY, 0.05, -0.05), (1, DAY, 0.05, 0.05)], "yr int, d date, stake double, profit double")
    assert betting.daily_path(bets, ["yr"], "d").first().roll == pytest.approx(1.05 * 0.95 * 1.05)


def test_delisted_tickers_may_be_text(spark):
    days = [dt.date(2020, 1, k) for k in (9, 10, 13, 14)]
    prices = spark.createDataFrame([(t, d, 100.0 + k) for t in ("GOOD", "DEAD") for k, d in enumerate(days)], "ticker string, d date, px double")
    gone = spark.createDataFrame([("DEAD", dt.date(2020, 1, 11), -0.8)], "ticker string, delist_date date, delist_return double")
    got = {(r.ticker, r.d): r.px for r in fundamentals.delisted_prices(prices, gone).collect()}
    assert len(got) == 8 and got["GOOD", days[3]] == 103.0
    assert got["DEAD", days[0]] == 100.0 and got["DEAD", days[1]] == pytest.approx(20.0) and got["DEAD", days[2]] is None


def test_a_total_loss_is_no_growth(spark):
    got = inference.growth_interval(_series(spark, [0.01] * 59 + [-1.0]), ["ticker"], reps=200).first()
    assert got["diff"] == -1.0 and got.diff_low == -1.0 and got.verdict != "STRONG_EDGE"


def test_bad_cells_are_null(spark):
    from tidemark.sources import files

    got = files.percent_block(spark.createDataFrame([("x\n20240102, n/a, 1.0\n",)], "value string"), ["a", "b"]).first()
    assert got.a is None and got.b == 0.01


def test_cells_keep_the_digit_of_their_column(spark):
    from tidemark.sources import files

    got = files.percent_block(spark.createDataFrame([("x\n20240102, 1.51, 2.2\n",)], "value string"), ["a", "b"]).first()
    assert (got.a, got.b) == (pytest.approx(0.0151), pytest.approx(0.022))


def test_a_bankroll_past_what_a_double_holds_keeps_its_drawdown(spark):
    bets = spark.createDataFrame([("g", t, 0.5, 2.0 if t < 2000 else -1.0) for t in range(2002)], "g string, t int, f double, x double")
    last = portfolio.bankroll(bets, ["g"], ["t"]).orderBy(F.desc("t")).first()
    assert abs(last.log_roll - 1998 * np.log(2)) < 1e-6 and abs(last.dd + 0.75) < 1e-9


def test_states_of_few_rows_are_left_out_by_query_and_sql(spark, tmp_path):
    import duckdb
    from oracle import differs

    from tidemark.plans import signals as plans
    from tidemark.plans.queries import ORACLES

    rows = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    first = rows.agg(F.min("l_shipdate")).first()[0]
    rows.where(F.datediff("l_shipdate", F.lit(first)) < 145).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = plans.w39_t38_t43_y48_y49_states(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert set(got.state) == {"early"} and (got.share < 1).all()
    assert not differs(got, con.sql(ORACLES["w39_t38_t43_y48_y49_states"]).df())


def test_latest_values_look_at_filings_before_the_decision_only(spark):
    facts = [(1, "assets", "2019-12-31", 5.0, "2020-02-01"), (1, "assets", "2020-03-31", 6.0, "2020-05-01"), (1, "assets", "2020-03-31", 7.0, "2020-06-01"), (1, "assets", "2019-12-31", 5.5, "2020-07-01"), (1, "cash", "2020-03-31", 1.0, "2020-05-01"), (1, "cash", "2020-03-31", 2.0, "2020-05-01"), (2, "cash", "2020-03-31", 9.0, None)]
    filings = spark.createDataFrame(facts, "ticker int, alias string, end_d string, val double, filed string").selectExpr("ticker", "alias", "end_d::date", "val", "filed::date")
    at = spark.createDataFrame([(1, d) for d in ("2020-02-01", "2020-02-02", "2020-06-01", "2020-07-02")] + [(2, "2020-07-02")], "ticker int, at string").selectExpr("ticker", "at::date")
    got = fundamentals.latest_values(filings, at)
    assert sorted((r.ticker, str(r.at), r.alias, r.val, str(r.filed), str(r.newest)) for r in got.collect()) == [
        (1, "2020-02-02", "assets", 5.0, "2020-02-01", "2020-02-01"), (1, "2020-06-01", "assets", 6.0, "2020-05-01", "2020-05-01"), (1, "2020-06-01", "cash", 2.0, "2020-05-01", "2020-05-01"),
        (1, "2020-07-02", "assets", 7.0, "2020-06-01", "2020-07-01"), (1, "2020-07-02", "cash", 2.0, "2020-05-01", "2020-05-01"),
    ]
