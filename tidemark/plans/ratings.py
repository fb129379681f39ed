"""Registered queries of ratings. Each game depends on the ones before, so they have brute-force tests instead of SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import calibrate, evaluate, ratings
from ..sources.saved import saved
from .queries import query
from .views import GAMES_TEXT, games, r6


def rated_games(spark, sf, found=None):
    """Games of leagues of a few hundred sides, in order, with what the rating rules look at."""
    day = F.datediff("d", F.lit("1990-01-01").cast("date"))
    cols = [F.floor(F.col("home") / 200).cast("int").alias("league"), (day.cast("long") * 10_000_000 + F.col("game_id")).alias("seq"), "season", F.col("home").alias("side_a"), F.col("away").alias("side_b"), F.col("hs").alias("score_a"), F.col("vs").alias("score_b"), "neutral"]
    return (games(spark, sf) if found is None else found).select(*cols, (F.dayofyear("d") / 366).alias("share"), day.alias("day"))


def _shown(df):
    return df.select("league", "seq", "season", "side_a", "side_b", r6("rating_a", "rating_a"), r6("rating_b", "rating_b"), r6("expected", "expected"))


@query()
def r1_elo(spark, sf):
    """One season a league: margin and home edge, nothing carried over."""
    return _shown(ratings.rate(rated_games(spark, sf).withColumn("season", F.lit(0)), ["league"], ratings.Config()))


@query()
def r2_r3_seasons(spark, sf):
    """Ratings pulled to the mean between seasons, home edge 75."""
    return _shown(ratings.rate(rated_games(spark, sf).withColumn("neutral", F.lit(False)), ["league"], ratings.Config(home=75.0)))


@query()
def r4_signed_margin(spark, sf):
    return _shown(ratings.rate(rated_games(spark, sf).withColumn("neutral", F.lit(False)), ["league"], ratings.Config(k=6.0, home=24.0, kept=0.67, margin="signed")))


@query()
def r5_fading_and_classes(spark, sf):
    """Sides fade by their idle days, early games and games that finished early count more; ratings of all games and of each class alone."""
    rows = rated_games(spark, sf).withColumns({"cls": F.concat(F.lit("c"), F.col("seq") % 5), "finished": F.col("score_a") + F.col("score_b") > 220})
    got = ratings.rate(rows, ["league"], ratings.Config(k=50.0, home=0.0, kept=1.0, margin=None, decay=0.15, change=0.1, early=(5, 1.5), finish=1.2))
    return got.select("league", "seq", "cls", *[r6(c, c) for c in ratings.OUT])


_LATE = ratings.Config(late=1.0)


def _seasons(spark, sf):
    """Games before day 134 of a year are the regular season and count more as it goes by."""
    day = F.dayofyear(F.date_add(F.lit("1990-01-01").cast("date"), F.col("day")))
    return rated_games(spark, sf).withColumn("share", F.when(day < 134, day / 134).otherwise(0.0))


@query()
def r6_late_games(spark, sf):
    return _shown(ratings.rate(_seasons(spark, sf), ["league"], _LATE))


@query()
def r6_before_the_finals(spark, sf):
    """Each side's rating after the regular season, for every season from its first."""
    got = ratings.snapshots(ratings.rate(_seasons(spark, sf), ["league"], _LATE), ["league"], "share > 0", _LATE)
    return got.select("league", "season", "side", r6("rating", "rating"))


@query()
def r7_tiers(spark, sf):
    """The step of a game by its tier, draws at full step, yearly pull, frozen at an end date."""
    tier = F.when(F.col("seq") % 10 < 2, 60.0).when(F.col("seq") % 10 < 5, 40.0).otherwise(20.0)
    frozen = rated_games(spark, sf).where(F.col("season") < 2000).withColumn("k", tier)
    return _shown(ratings.rate(frozen, ["league"], ratings.Config(kept=0.9, yearly=True, even_draws=True)))


_GRID = {f"k{k}-h{h}-m{m}": ratings.Config(k=float(k), home=float(h), kept=m) for k in (10, 20, 40) for h in (0, 50, 100) for m in (0.6, 0.75, 0.9)}


def _graded(spark, sf):
    """Every game with each configuration's gap of ratings, as an array, and an outcome of three, draws among them."""
    rated = ratings.rate_side_by_side(rated_games(spark, sf), ["league"], list(_GRID.values()), ["rating_a", "rating_b"])
    won = F.when(F.col("score_a") > F.col("score_b"), 0).when(F.col("score_a") < F.col("score_b"), 2).otherwise(1)
    edges = F.array(*[F.lit(c.home) for c in _GRID.values()])
    gaps = F.transform(F.zip_with("rating_a", "rating_b", lambda a, b: a - b), lambda g, k: g + F.when(F.col("neutral"), 0.0).otherwise(edges[k]))
    return rated.select("season", gaps.alias("gaps"), won.alias("c")).withColumn("drawn", (F.col("c") == 1).cast("int"))


def _three(rows, curve):
    """(config, season, c, q): three-way probabilities with the configuration's draw curve."""
    named = curve.select("at", "base", "spread", F.element_at(F.array(*[F.lit(n) for n in _GRID]), F.col("at") + 1).alias("config"))
    met = rows.select("season", "c", F.posexplode("gaps").alias("at", "gap")).join(F.broadcast(named), "at")  # a row a configuration
    won = 1 / (1 + F.pow(F.lit(10.0), -F.col("gap") / 400))
    draw = F.col("base") * F.when(F.col("spread").isNull(), 1.0).otherwise(F.exp(-F.pow(F.col("gap") / F.col("spread"), F.lit(2.0))))
    parts = met.select("config", "season", "c", won.alias("won"), draw.alias("draw"))
    three = [calibrate.clipped(p, 0.02, 0.98) for p in (F.col("won") * (1 - F.col("draw")), F.col("draw"), (1 - F.col("won")) * (1 - F.col("draw")))]
    return parts.select("config", "season", "c", F.array(*[p / (three[0] + three[1] + three[2]) for p in three]).alias("q"))


@query()
def r8_grid(spark, sf):
    """27 configurations: the draw curve is fitted on seasons before 1999, the score is of the seasons from it on."""
    rows = saved(_graded(spark, sf))
    curve = calibrate.draw_curves(rows.where("season < 1999"), "gaps", "drawn")
    got = evaluate.class_scores(_three(rows.where("season >= 1999"), curve), ["config"])
    return got.select("config", "n", r6("log_loss", "log_loss"), r6("accuracy", "accuracy"))


@query()
def r9_walk_forward(spark, sf):
    """For each season from the fourth on, the configuration that was best on all seasons before it, and what it then scores."""
    rows = saved(_graded(spark, sf))
    first = rows.agg(F.min("season")).first()[0] + 1
    curve = calibrate.draw_curves(rows.where(F.col("season") <= first), "gaps", "drawn")
    by = saved(evaluate.class_scores(_three(rows.where(F.col("season") > first), curve), ["config", "season"]))
    w = W.partitionBy("config").orderBy("season").rowsBetween(W.unboundedPreceding, -1)
    past = by.withColumn("past", F.sum(F.col("log_loss") * F.col("n")).over(w) / F.sum("n").over(w)).where("past is not null")
    best = past.withColumn("_at", F.row_number().over(W.partitionBy("season").orderBy("past", "config"))).where("_at = 1")  # a row a configuration
    return best.select("season", "config", "n", r6("past", "past"), r6("log_loss", "log_loss"))


@query()
def r10_latest(spark, sf):
    """Current ratings, the highest first."""
    got = ratings.latest(ratings.rate(rated_games(spark, sf), ["league"]), ["league"])
    return got.select("league", "side", r6("rating", "rating"), "games")


@query()
def q3_live_ratings(spark, sf):
    """The ratings of r1's rule kept live on a file stream of the games."""
    from ..streaming import batches, live
    from .backtests import run_stream

    found = spark.sql(GAMES_TEXT, orders=batches.stream_of(spark, sf, "orders.parquet"))
    rows = rated_games(spark, sf, found).where("league is not null")
    return _shown(run_stream(spark, live.live_ratings(rows, ["league"])).where("not late"))
