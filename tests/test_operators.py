"""Golden cases of the semantics that are easy to get wrong."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import asof, evaluate, history


def test_a_fact_of_the_same_day_is_not_seen(spark):
    day = dt.date(2024, 1, 10)
    decisions = spark.createDataFrame([("a", day)], "k string, at date")
    facts = spark.createDataFrame([("a", day, 1.0), ("a", dt.date(2024, 1, 9), 2.0)], "k string, rel date, v double")
    assert asof.as_of(decisions, facts, ["k"], "at", "rel", ["v"]).first().v == 2.0


def test_membership_ends_before_its_end_and_open_ends_stay(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 31),), (dt.date(2024, 2, 1),)], "d date")
    members = spark.createDataFrame([("x", dt.date(2024, 1, 1), dt.date(2024, 2, 1)), ("y", dt.date(2024, 2, 1), None)], "ticker string, start_date date, end_date date")
    got = {(r.d.day, r.ticker) for r in asof.members_as_of(days, members, "d").collect()}
    assert got == {(31, "x"), (1, "y")}


def test_odds_between_minus_and_plus_100_are_none(spark):
    got = [r[0] for r in spark.createDataFrame([(150.0,), (-200.0,), (50.0,), (None,)], "m double").select(fn.decimal_odds(F.col("m"))).collect()]
    assert got == [2.5, 1.5, None, None]


def test_minutes(spark):
    got = [r[0] for r in spark.createDataFrame([("12:30",), ("PT3M6.0S",), ("7",), ("x",), (None,)], "t string").select(fn.minutes(F.col("t"))).collect()]
    assert got == [12.5, 3.1, 7.0, 0.0, 0.0]


def test_rolling_mean_leaves_out_the_row_itself(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0), (1, 3, 60.0)], "g int, t int, x double")
    assert [r.m for r in history.rolling_mean(df, ["g"], ["t"], "x", 2, "m").orderBy("t").collect()] == [None, 10.0, 15.0]


def test_holm_never_falls(spark):
    t = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "fam string, test string, p double")
    got = {r.test: round(r.adj, 6) for r in evaluate.holm(t, ["fam"], "p", "adj").collect()}
    assert got == {"a": 0.03, "c": 0.06, "b": 0.06}
