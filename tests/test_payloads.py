"""Golden payloads: odds, props, rounds, scraped tables, blocks, names."""

import datetime as dt
import json

import pytest

from tidemark.operators import splits
from tidemark.sources import payloads


def _json(spark, *payload):
    return spark.createDataFrame([(k, p if isinstance(p, str) else json.dumps(p)) for k, p in enumerate(payload)], "file int, json string")


def test_outright_odds_of_both_layouts(spark):
    raw = _json(spark, [{"event_id": 7, "date": "2024-04-11", "player_name": "A", "dg_id": 11, "odds": {"x": 5, "y": 5.5, "z": "n/a", "w": None}}, {"event_name": "Open", "event_date": "bad", "name": "B", "player_id": "p", "odds": "4.0", "book": "b"}, {"event_name": "Open", "decimal_odds": 2.0}, {"event_name": "Open", "odds": None}], "not json")
    got = {(r.tournament_id, r.player_name, r.book): (r.decimal_odds, r.implied_prob, r.event_date, r.player_id) for r in payloads.outright_odds(raw).collect()}
    assert got == {("7", "A", "x"): (5.0, 0.2, dt.date(2024, 4, 11), "11"), ("7", "A", "y"): (5.5, 1 / 5.5, dt.date(2024, 4, 11), "11"), ("Open", "B", "b"): (4.0, 0.25, None, "p"), ("Open", None, "unknown"): (2.0, 0.5, None, None)}


def test_prop_lines_are_flattened(spark):
    raw = _json(spark, {"id": "g1", "bookmakers": [{"key": "bk", "markets": [{"key": "points", "outcomes": [{"name": "Over", "description": "P", "price": -110, "point": 20.5}, {"name": "Under", "description": "P", "price": "x"}]}, {"key": "none"}]}, {"key": "empty"}]}, {"id": "g2"})
    got = [tuple(r) for r in payloads.prop_lines(raw).collect()]
    assert got == [(0, "g1", "bk", "points", "P", "Over", -110.0, 20.5), (0, "g1", "bk", "points", "P", "Under", None, None)]


def test_rounds_results_and_events(spark):
    rounds = [{"event_id": 1, "dg_id": 9, "player_name": "A", "round_num": k, "score": 70 + k, "sg_total": "bad" if k == 2 else k, "year": 2020, "fin_text": "T5"} for k in (1, 2, 3, 4)]
    rounds += [{"event_id": 1, "dg_id": 8, "player_name": "B", "round_num": 1, "score": 80, "year": 2020, "fin_text": "CUT"}, {"event_id": 1, "dg_id": 8, "player_name": "B", "round_num": 1, "score": 80, "year": 2010}]
    got = payloads.golf_rounds(_json(spark, rounds), 2015)
    assert got.count() == 5
    res = {r.player_name: r for r in payloads.golf_results(got).collect()}
    assert (res["A"].total_score, res["A"].rounds_played, res["A"].finish_position, res["A"].made_cut) == (290.0, 4, 5.0, True) and res["A"].sg_total_avg == pytest.approx(8 / 3)
    assert (res["B"].finish_position, res["B"].made_cut) == (None, False)
    events = payloads.golf_events(_json(spark, [{"event_id": 3, "event_name": "M", "course": "C", "start_date": "2024-01-02", "calendar_year": 2024}, {"event_id": 4, "date": "soon"}])).collect()
    assert [tuple(r) for r in events] == [("3", "M", "C", dt.date(2024, 1, 2), 2024, "pga")]


def test_scraped_membership_with_varying_headers(spark):
    raw = spark.createDataFrame([("brk.b ", "Berkshire", "Financials", "Multi", "February 16, 2010", "1067983"), ("NEW", "New", "IT", "Soft", None, None), (None, "", "", "", "", "")], ["Symbol", "Security", "GICS Sector", "GICS Sub-Industry", "Date added", "CIK"])
    got = {r.ticker: (r.start_date, r.cik, r.notes) for r in payloads.constituents(raw).collect()}
    assert got == {"BRK-B": (dt.date(2010, 2, 16), "0001067983", "current"), "NEW": (dt.date(1957, 3, 4), "", "current")}
    with pytest.raises(ValueError, match="cik"):
        payloads.constituents(raw.drop("CIK"))
    changes = spark.createDataFrame([("March 1, 2015", "aa", "Aa", "bb", "Bb", " merged "), ("2016-02-03", None, None, "cc", "Cc", None), ("never", "x", "", "", "", "")], ["Date|Date", "Added|Ticker", "Added|Security", "Removed|Ticker", "Removed|Security", "Reason|"])
    flat = payloads.change_events(changes)
    assert [tuple(r) for r in flat.orderBy("event_date").collect()] == [(dt.date(2015, 3, 1), "AA", "Aa", "BB", "Bb", "merged"), (dt.date(2016, 2, 3), "", "", "CC", "Cc", "")]
    assert splits.consolidated(payloads.as_events(flat)).count() == 1


def test_files_of_several_blocks(spark):
    text = "A title\n\n,Mkt-RF,  RF\n192607,  2.96, n/a\n192608, -99.99, 0.25\n\n Annual\n,Mkt-RF\n19261231, 1.0, 7.0\nend\n"
    files = spark.createDataFrame([("f", text), ("g", "no data")], "file string, value string")
    got = sorted((r.block, str(r.d), r["name"], r.value) for r in payloads.percent_blocks(files).collect() if r.value is not None)
    assert got == [(1, "1926-07-31", "Mkt-RF", 0.0296), (1, "1926-08-31", "RF", 0.0025), (2, "1926-12-31", "Mkt-RF", 0.01), (2, "1926-12-31", "column 2", 0.07)]
    assert payloads.percent_blocks(files).count() == 6


def test_universes_and_delistings(spark):
    raw = spark.createDataFrame([("a", "2001-02-03", "x"), ("b", "?", ""), ("c", None, None)], "ticker string, inception_date string, closure_date string")
    got = {r.ticker: (str(r.inception_date), r.closure_date, r.rejected) for r in payloads.universe(raw, payloads.FUTURES_DATES).collect()}
    assert got == {"a": ("2001-02-03", None, ["closure_date"]), "b": ("None", None, ["inception_date"]), "c": ("None", None, [])}
    gone = payloads.delisting_table(spark.createDataFrame([("a", "2001-02-03", "-0.5"), ("b", "2001-02-03", None), ("c", None, "0")], "ticker string, delist_date string, delist_return string"))
    assert sorted((r.ticker, r.delist_return, r.reason) for r in gone.collect()) == [("a", -0.5, ""), ("b", 0.0, "")]


def test_game_logs_and_odds(spark):
    logs = spark.createDataFrame([(20120405, "NYA", "BOS", 3, 2, 0), (20090405, "NYA", "BOS", 3, 2, 0), (20120406, "XXX", "BOS", 1, 2, 0)], "date int, home_team string, visiting_team string, home_score int, visiting_score int, game_num int")
    got = [(str(r.game_date), r.home, r.away, r.home_win, r.total) for r in payloads.log_games(logs, {"NYA": "NYY", "BOS": "BOS"}, 2010).orderBy("game_date").collect()]
    assert got == [("2012-04-05", "NYY", "BOS", 1, 5), ("2012-04-06", None, "BOS", 0, 3)]
    odds = spark.createDataFrame([(2012, "20120405x", "a", "b", "-110", "x", "-120", "100"), (2012, "2012", "a", "b", "1", "2", "NL", "100")], "season int, date string, home_team string, away_team string, home_open_ml string, away_open_ml string, home_close_ml string, away_close_ml string")
    assert [(str(r.game_date), r.home, r.away_open_ml, r.home_close_ml) for r in payloads.log_odds(odds, {"a": "A"}).collect()] == [("2012-04-05", "A", None, -120.0)]


def test_similar_names_by_brute_force(spark):
    names = ["West Germany", "East Germany", "Germany", "germany", "Serbia", "Serbia and Montenegro", "Yugoslavia", "FR Yugoslavia", "Czech Republic", "Czechoslovakia", "USA", "U", "", None, "Korea Republic", "Korea DPR"]
    grams = lambda n: {f"^{n.lower()}$"[i : i + 2] for i in range(len(n) + 1)}
    for least in (0.3, 0.6, 1.0):
        want = {(a, b): len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a in names if a is not None for b in names if b is not None and a < b}
        got = {(r.a, r.b): r.similarity for r in payloads.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), least).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items() if v >= least}
    teams, covered = (spark.createDataFrame([(n,) for n in x], "name string") for x in (["Germany", "West Germany", "CIS"], ["CIS"]))
    pairs = spark.createDataFrame([("Germany", "West Germany"), ("Russia", "CIS"), ("Serbia", "Yugoslavia")], "current string, former string")
    got = {r.former: (r.current_in_data, r.former_in_data, r.in_former_names, r.needs_merge) for r in payloads.merge_checks(pairs, teams, covered).collect()}
    assert got == {"West Germany": (True, True, False, True), "CIS": (False, True, True, False), "Yugoslavia": (False, False, False, False)}
