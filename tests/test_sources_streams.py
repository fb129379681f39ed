"""Readers, layered tables and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.streaming import batches


def test_required_and_optional_columns(spark):
    df = spark.createDataFrame([("g", 1.9)], "game_id string, home_odds double")
    assert files.with_optional(df, ["game_id"], ["book"]).first()["book"] == ""
    with pytest.raises(ValueError, match="away_odds"):
        files.require(df, ["game_id", "away_odds"])


def test_csv_round_trip_keeps_the_company_number(spark, tmp_path):
    row = ("AA", "A & A", "Energy", None, None, None, "0000012345", None)
    files.write_csv(spark.createDataFrame([row], files.MEMBERSHIP), str(tmp_path / "m"))
    assert files.members(spark, str(tmp_path / "m")).first()["cik"] == "0000012345"


def test_company_facts(spark):
    entry = {"end": "2020-03-31", "val": 5.0, "filed": "2020-05-01", "form": "10-Q", "fy": 2020, "fp": "Q1", "accn": "a"}
    raw = json.dumps({"facts": {"us-gaap": {"Assets": {"units": {"USD": [entry, {**entry, "val": 6.0}]}}}}})
    got = files.company_facts(spark.createDataFrame([("T", raw), ("U", None), ("V", "{}")], "ticker string, json string")).orderBy("val").collect()
    assert [(r.ticker, r.taxonomy, r.concept, r.unit, r.val, str(r.filed)) for r in got] == [("T", "us-gaap", "Assets", "USD", v, "2020-05-01") for v in (5.0, 6.0)]


def test_book_odds_keeps_credible_margins(spark):
    raw = json.dumps({"odds": {"x": {"p1": 1.9, "p2": 1.9}, "y": {"p1": 1.1, "p2": 1.1}, "z": {"p1": 3.0, "p2": 3.0}, "n": {"p1": None, "p2": 2.0}}})
    got = files.book_odds(spark.createDataFrame([(1, raw)], "id int, json string")).collect()
    assert [(r.id, r.book) for r in got] == [(1, "x")]


def test_percent_block_stops_at_the_first_other_line(spark):
    text = "Notes\n,Mkt,RF\n19260701,  0.10, 0.009\n192607, -99.99, 1.0\n\nAnnual\n1927, 2.0, 3.0\n192708, 5, 6\n"
    got = files.percent_block(spark.createDataFrame([(text,)], "value string"), ["mkt", "rf"]).orderBy(F.desc("rf")).collect()
    assert [(str(r.d), r.mkt, round(r.rf, 8)) for r in got] == [("1926-07-31", None, 0.01), ("1926-07-01", 0.001, 0.00009)]


def test_keep_last_and_layered(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, i int, v string")
    assert sorted(r.v for r in files.keep_last(df, ["k"], ["i"]).collect()) == ["b", "c"]
    more = spark.createDataFrame([(1, 9), (3, 9)], "k int, i int")
    assert sorted((r.k, r.v or "") for r in files.layered(df, more, ["k"]).collect()) == [(1, "a"), (1, "b"), (2, "c"), (3, "")]


def test_canonical_chooses_the_longest_copy(spark):
    rows = [("long", d, 0.01) for d in range(5)] + [("same", d, 0.01) for d in range(3)] + [("off", d, 0.02) for d in range(3)]
    copies = spark.createDataFrame(rows, "copy string, d int, ret double")
    got = {r[0]: (r[1], r[2]) for r in files.canonical(copies).select("copy", "agrees", "chosen").collect()}
    assert got == {"long": (True, True), "same": (True, False), "off": (False, False)}


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = "SELECT id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS ts FROM range({})"
    spark.sql(rows.format(4)).coalesce(1).write.parquet(src)
    run = lambda: batches.run_once(batches.without_repeats(batches.stream_of(spark, src, "*.parquet"), ["id"], "ts"), out, state).count()
    assert run() == 4
    spark.sql(rows.format(6)).coalesce(1).write.mode("append").parquet(src)
    assert run() == 6
