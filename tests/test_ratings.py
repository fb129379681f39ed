"""Ratings by the rules' own cases, against a plain loop, and live on a stream that is stopped and restarted."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ratings
from tidemark.plans.ratings import rated_games
from tidemark.streaming import batches, live

SMALL = "/root/testdata/sf0.001"
SCHEMA = "league string, seq long, season int, side_a string, side_b string, score_a int, score_b int, day int, cls string, finished boolean"


def _rated(spark, rows, config, **more):
    games = spark.createDataFrame([(g[0], k, *g[1:]) for k, g in enumerate(rows)], SCHEMA)
    return {r.seq: r for r in ratings.rate(games.withColumns(more), ["league"], config).collect()}


def test_a_draw_moves_nothing_where_the_margin_counts(spark):
    rows = [("x", 2000, "a", "b", 3, 0, 0, None, False), ("x", 2000, "a", "b", 1, 1, 1, None, False), ("x", 2000, "a", "b", 0, 0, 2, None, False)]
    got = _rated(spark, rows, ratings.Config(home=0.0))
    assert got[0].after_a == 1500 + 10 * math.log(4) and got[1].after_a == got[1].rating_a == got[2].rating_a
    even = _rated(spark, rows, ratings.Config(home=0.0, even_draws=True))
    assert even[1].after_a < even[1].rating_a


def test_signed_margin_keeps_the_favourites_gap(spark):
    rows = [("x", 2000, "h", "a", 2, 7, 0, None, False), ("x", 2001, "h", "a", 4, 4, 1, None, False), ("x", 2004, "h", "b", 1, 0, 2, None, False)]
    got = _rated(spark, rows, ratings.Config(k=4.0, home=24.0, kept=0.67, margin="signed"), neutral=F.lit(False))
    p = 1 / (1 + 10 ** (-24 / 400))
    assert got[0].after_a == pytest.approx(1500 - 4 * math.log(6) * 2.2 / (2.2 + 0.024) * p) and round(got[0].after_a, 3) == 1496.211
    assert got[1].after_a != got[1].rating_a
    assert got[2].rating_a == pytest.approx(1500 + (got[1].after_a - 1500) * 0.67)


def test_idle_sides_fade_by_their_days_and_classes_rate_alone(spark):
    rows = [("x", 2000, "a", "b", 1, 0, 0, "light", True), ("x", 2000, "a", "b", 1, 0, 100, "heavy", False), ("x", 2000, "a", "c", 0, 1, 465, "light", False), ("x", 2000, "c", "b", 0, 1, 470, None, False), ("x", 2000, "d", "e", 1, 0, 470, "light", False)]
    got = _rated(spark, rows, ratings.Config(k=50.0, home=0.0, margin=None, decay=0.15, change=0.2, early=(2, 1.5), finish=1.1))
    first = 50 * 1.5 * 1.1 * 0.5
    assert got[0].after_a == 1500 + first == 1500 + got[0].after_a - got[0].rating_a
    assert got[1].rating_a == pytest.approx(1500 + first * math.exp(-0.15 * 100 / 365) * 0.8) and got[1].class_a == 1500
    assert got[2].class_a == pytest.approx(1500 + first * math.exp(-0.15 * 465 / 365)) and got[2].class_b == 1500
    assert got[2].after_a == pytest.approx(got[2].rating_a - 50 * 1.5 * got[2].expected)  # c has played fewer than two
    assert got[3].class_a is None and got[4].after_a == 1500 + 50 * 1.5 * 0.5


def test_a_null_league_is_a_league(spark):
    rows = [(x, 2000, "a", "b", 9, 0, k, None, False) for k, x in enumerate([None, "x", None, None])]
    got = _rated(spark, rows, ratings.Config())
    assert got[1].rating_a == 1500 and got[2].rating_a == got[0].after_a and got[3].rating_a == got[2].after_a


def test_latest_are_the_current_ratings_highest_first(spark):
    rows = [("x", 2000, "a", "b", 9, 0, 0, None, False), ("x", 2000, "a", "c", 9, 0, 1, None, False), ("x", 2001, "d", "c", 9, 0, 2, None, False), ("x", 2003, "d", "c", 9, 0, 3, None, False)]
    games = spark.createDataFrame([(g[0], k, *g[1:]) for k, g in enumerate(rows)], SCHEMA)
    for config, left in ((ratings.Config(), 0.75**2), (ratings.Config(yearly=True), 0.75**3)):
        rated = ratings.rate(games, ["league"], config)
        got = ratings.latest(rated, ["league"], config).collect()
        after = {r.seq: r.after_a for r in rated.collect()}
        assert [r.rating for r in got] == sorted((r.rating for r in got), reverse=True) and got[0].side == "d" and got[0].rating == after[3]
        assert {r.side: r.rating for r in got}["a"] == pytest.approx(1500 + (after[1] - 1500) * left)


def test_a_side_that_sat_a_season_out_is_rated_before_its_finals(spark):
    rows = [("x", 2000, "a", "b", 9, 0, 0, None, False), ("x", 2001, "c", "b", 9, 0, 1, None, False), ("x", 2003, "a", "c", 9, 0, 2, None, False)]
    games = spark.createDataFrame([(g[0], k, *g[1:]) for k, g in enumerate(rows)], SCHEMA).withColumn("share", F.lit(1.0))
    for config, left in ((ratings.Config(), (0.75, 0.75**2)), (ratings.Config(yearly=True), (0.75, 0.75**3))):
        rated = ratings.rate(games, ["league"], config)
        after = {r.seq: r for r in rated.collect()}
        got = {(r.season, r.side): r.rating for r in ratings.snapshots(rated, ["league"], "share > 0", config).collect()}
        assert len(got) == 8 and got[2000, "a"] == after[0].after_a and got[2003, "a"] == after[2].after_a
        assert got[2001, "a"] == pytest.approx(1500 + (after[0].after_a - 1500) * left[0])
        assert got[2003, "b"] == pytest.approx(1500 + (after[1].after_b - 1500) * (0.75 if not config.yearly else 0.75**2))


@pytest.mark.parametrize("config", [ratings.Config(), ratings.Config(k=4, home=24, kept=0.6, margin="signed"), ratings.Config(margin=None, late=1.0, decay=0.3, yearly=True)])
def test_ratings_are_those_of_a_plain_loop(spark, config):
    games = rated_games(spark, SMALL)
    got = {r.seq: (r.rating_a, r.rating_b) for r in ratings.rate(games, ["league"], config).collect()}
    now, season, seen = {}, {}, {}
    for g in sorted(games.collect(), key=lambda g: (g.league, g.seq)):
        if season.get(g.league, g.season) < g.season:
            for key in [k for k in now if k[0] == g.league]:
                now[key] = 1500 + (now[key] - 1500) * config.kept ** (g.season - season[g.league] if config.yearly else 1)
        season[g.league] = g.season
        a, b = (g.league, g.side_a), (g.league, g.side_b)
        for s in (a, b):
            if s in seen and config.decay:
                now[s] = 1500 + (now.get(s, 1500) - 1500) * math.exp(-config.decay * (g.day - seen[s]) / 365)
            seen[s] = g.day
        ra, rb, edge = now.get(a, 1500.0), now.get(b, 1500.0), 0 if g.neutral else config.home
        assert np.allclose(got[g.seq], (ra, rb), rtol=1e-12)
        k, margin = config.k * (1 + config.late * g.share), g.score_a - g.score_b
        if config.margin == "log":
            k *= math.log(abs(margin) + 1) * 2.2 / (2.2 + 0.001 * abs(ra - rb))
        if config.margin == "signed":
            k *= math.log(max(abs(margin), 1) + 1) * 2.2 / (2.2 + 0.001 * (ra + edge - rb))
        change = k * ((margin > 0) + 0.5 * (margin == 0) - 1 / (1 + 10 ** (-(ra + edge - rb) / 400)))
        now[a], now[b] = ra + change, rb - change


def test_a_restarted_stream_rates_as_the_batch_does(spark, tmp_path):
    config = ratings.Config(decay=0.2, change=0.1, early=(3, 1.5), finish=1.2)
    games = rated_games(spark, SMALL).withColumns({"cls": F.concat(F.lit("c"), F.col("seq") % 3), "finished": F.col("seq") % 4 == 0}).where("league < 2")
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    cuts = [games.where("season < 1997"), games.where("season >= 1997 and season < 1999"), games.where("season >= 1999")]
    before = games.where("season = 1996").limit(3)
    for k, part in enumerate(cuts):
        (part.unionByName(before) if k == 2 else part).coalesce(1).write.mode("append").parquet(src)
        batches.run_once(live.live_ratings(batches.stream_of(spark, src, "*.parquet"), ["league"], config), out, state)
    got = spark.read.parquet(out)
    assert got.where("late").count() == 3 and got.where("late and rating_a is not null").count() == 0
    both = got.where("not late").alias("l").join(ratings.rate(games, ["league"], config).alias("r"), "seq")
    off = [F.max(F.abs(F.col(f"l.{c}") - F.col(f"r.{c}"))).alias(c) for c in ratings.OUT]
    row = both.agg(F.count("*").alias("n"), *off).first()
    assert row.n == games.count() > 300 and max(row[1:]) < 1e-9


def test_a_grid_reads_each_game_once_and_rates_as_each_configuration_does(spark):
    games = rated_games(spark, SMALL).withColumns({"cls": F.when(F.col("seq") % 3 > 0, F.concat(F.lit("c"), F.col("seq") % 3)), "finished": F.col("seq") % 4 == 0})
    grid = {"a": ratings.Config(), "b": ratings.Config(k=40.0, home=0.0, kept=0.5, late=1.0, finish=1.1), "c": ratings.Config(margin="signed", start=1000.0, decay=0.2, change=0.1, early=(3, 1.5), yearly=True)}
    once = ratings.rate_side_by_side(games, ["league"], list(grid.values()), ["rating_a"])
    assert once.count() == games.count() and {len(r.rating_a) for r in once.limit(50).collect()} == {3}
    both = ratings.rate(games, ["league"], grid)
    for name, config in grid.items():
        one, met = ratings.rate(games, ["league"], config), both.where(F.col("config") == name)
        off = [F.max(F.abs(F.col(f"l.{c}") - F.col(f"r.{c}"))).alias(c) for c in ratings.OUT]
        row = met.alias("l").join(one.alias("r"), "seq").agg(F.count("*").alias("n"), F.sum((F.col("l.class_a").isNull() != F.col("r.class_a").isNull()).cast("int")).alias("nulls"), *off).first()
        assert row.n == games.count() and row.nulls == 0 and max(row[2:]) < 1e-9
