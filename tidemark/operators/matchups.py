"""Games of two sides as long rows of one, features of each side's past, and both sides put together again.

A game table has (game_id, d, season, home, away, hs, vs, neutral); `sides` gives (game_id, d, season, team, opp, is_home, pts, opp_pts, won). All
features see only a team's earlier games, in order of (d, game_id), and share one sort of each team.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import great_circle_km

ORDER = ["d", "game_id"]


def sides(games: DataFrame) -> DataFrame:
    """One row for each side of each game; a draw is half a win."""
    won = lambda a, b: F.when(F.col(a) > F.col(b), 1.0).when(F.col(a) == F.col(b), 0.5).otherwise(0.0)
    row = lambda t, o, home, p, q: F.struct(F.col(t).alias("team"), F.col(o).alias("opp"), F.lit(home).alias("is_home"), F.col(p).alias("pts"), F.col(q).alias("opp_pts"), won(p, q).alias("won"))
    return games.select("game_id", "d", "season", "neutral", F.explode(F.array(row("home", "away", 1, "hs", "vs"), row("away", "home", 0, "vs", "hs"))).alias("s")).select("game_id", "d", "season", "neutral", "s.*")


def past(by: list[str] = ["team"], rows: int | None = None):  # noqa: B006
    """The frame of a team's earlier games: all of them, or so many."""
    return W.partitionBy(*by).orderBy(*ORDER).rowsBetween(W.unboundedPreceding if rows is None else -rows, -1)


def both_sides(games: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """games with h_x and a_x of each feature (game_id, team, names), from one table by two joins."""
    got = games
    for side, p in (("home", "h_"), ("away", "a_")):
        got = got.join(features.select("game_id", F.col("team").alias(side), *[F.col(n).alias(p + n) for n in names]), ["game_id", side], "left")
    return got


def prior_season(games: DataFrame, ends: DataFrame, names: list[str]) -> DataFrame:
    """games with each side's figures of the season before: ends (season, team, names) moved on by one season."""
    moved = ends.withColumn("season", F.col("season") + 1)
    got = games
    for side, p in (("home", "h_"), ("away", "a_")):
        got = got.join(moved.select("season", F.col("team").alias(side), *[F.col(n).alias(p + n) for n in names]), ["season", side], "left")
    return got


def season_ends(long: DataFrame) -> DataFrame:
    """(season, team, games, pts, opp_pts, won, share): means of a season, and points over all points from the means."""
    ends = long.groupBy("season", "team").agg(F.count("*").alias("games"), F.avg("pts").alias("pts"), F.avg("opp_pts").alias("opp_pts"), F.avg("won").alias("won"))
    return ends.withColumn("share", F.try_divide("pts", F.col("pts") + F.col("opp_pts")))


def priors(long: DataFrame, stat: str, seasons: int, shrink: float, decay: float) -> DataFrame:
    """(season, team, shrunk, blended): a team's expectation before a season, from the ones before, drawn to the league's mean.

    shrunk is last season's (null without one); blended weighs the last `seasons` by decay to the power of their age.
    """
    ends = long.groupBy("season", "team").agg(F.avg(stat).alias("v")).withColumn("m", F.avg("v").over(W.partitionBy("season")))
    aged = ends.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(seasons)))).select((F.col("season") + F.col("i")).alias("season"), "team", "i", (F.col("m") + shrink * (F.col("v") - F.col("m"))).alias("x"))
    weight = F.pow(F.lit(decay), F.col("i") - 1)
    got = aged.groupBy("season", "team").agg(F.max(F.when(F.col("i") == 1, F.col("x"))).alias("shrunk"), (F.sum(weight * F.col("x")) / F.sum(weight)).alias("blended"))
    return got.join(ends.select("season", "team"), ["season", "team"])


def opponents(long: DataFrame, stat: str, out: str) -> DataFrame:
    """long with the opponent's value of a column in the same game."""
    other = long.select("game_id", F.col("team").alias("opp"), F.col(stat).alias(out))
    return long.join(other, ["game_id", "opp"], "left")


def schedule(long: DataFrame) -> DataFrame:
    """long with back_to_back, three_in_four, last_week (games in the 7 days before) and away_run (away games in a row up to this one)."""
    day = F.datediff("d", F.lit("1970-01-01").cast("date"))
    team, order = W.partitionBy("team"), W.partitionBy("team").orderBy(*ORDER)
    recent = lambda a, b: F.count("*").over(team.orderBy(day).rangeBetween(a, b))
    df = long.withColumn("back_to_back", (F.datediff("d", F.lag("d").over(order)) == 1).cast("int")).withColumn("three_in_four", (recent(-3, 0) >= 3).cast("int")).withColumn("last_week", recent(-7, -1))
    df = df.withColumn("back_to_back", F.coalesce("back_to_back", F.lit(0))).withColumn("_at_home", F.sum("is_home").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return df.withColumn("away_run", F.sum(1 - F.col("is_home")).over(W.partitionBy("team", "_at_home").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0))).drop("_at_home")


def travel(long: DataFrame, venues: DataFrame) -> DataFrame:
    """long with km, hours (time zones) and metres (of height) from the last venue that is known; venues (team, lat, lon, zone, height) are the home teams'.

    Null where this game's venue is unknown, or none is known before.
    """
    at = venues.select(F.col("team").alias("_host"), F.struct("lat", "lon", "zone", "height").alias("here"))
    placed = long.withColumn("_host", F.when(F.col("is_home") == 1, F.col("team")).otherwise(F.col("opp"))).join(at, "_host", "left").drop("_host")
    before = F.last("here", ignorenulls=True).over(past())
    df = placed.withColumn("_was", before)
    km = great_circle_km(F.col("_was.lat"), F.col("_was.lon"), F.col("here.lat"), F.col("here.lon"))
    return df.select(*[c for c in long.columns], km.alias("km"), (F.col("here.zone") - F.col("_was.zone")).alias("hours"), (F.col("here.height") - F.col("_was.height")).alias("metres"))


def weighted_mean(values: Column, decay: float) -> Column:
    """Mean of an array in order of time, newest weighing 1 and each older one (1 - decay) times the next."""
    n = F.size(values)
    # by Horner's rule, oldest first
    fold = F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda a, x: F.struct((a["s"] * (1 - decay) + x).alias("s"), (a["w"] * (1 - decay) + 1).alias("w")))
    return F.when(n > 0, fold["s"] / fold["w"])


def span_mean(long: DataFrame, stat: str, span: int, out: str, by: list[str] = ["team"], adjusted: bool = True) -> DataFrame:  # noqa: B006
    """Exponential mean of a team's earlier games with span s, a = 2 / (s + 1): weights (1 - a)^k over their sum, or the recursive form.

    The weighted sums run as plain window sums with weights that grow by row, cut to the last 40 spans, beyond which a weight is nothing.
    """
    a = 2 / (span + 1)
    seen = F.collect_list(stat).over(past(by, 40 * span))
    if adjusted:
        return long.withColumn("_seen", seen).withColumn(out, weighted_mean(F.col("_seen"), a)).drop("_seen")
    first = F.get("_seen", F.lit(0)).cast("double")
    recursive = F.aggregate(F.slice("_seen", 2, 1_000_000), first, lambda m, x: m * (1 - a) + a * x)
    return long.withColumn("_seen", seen).withColumn(out, F.when(F.size("_seen") > 0, recursive)).drop("_seen")


def streak(long: DataFrame, out: str = "streak") -> DataFrame:
    """Wins (positive) or losses in a row before the game; 0 at first, and after a draw."""
    order = W.partitionBy("team").orderBy(*ORDER)
    kind = F.when(F.col("won") == 1, 1).when(F.col("won") == 0, -1).otherwise(0)
    df = long.withColumn("_k", kind).withColumn("_new", F.coalesce((F.col("_k") != F.lag("_k").over(order)).cast("int"), F.lit(1)))
    df = df.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("_len", F.col("_k") * F.row_number().over(W.partitionBy("team", "_run").orderBy(*ORDER)))
    return df.withColumn(out, F.coalesce(F.lag("_len").over(order), F.lit(0))).drop("_k", "_new", "_run", "_len")


def form(long: DataFrame, windows: tuple[int, ...] = (10, 30, 60), least: int = 10, exponent: float = 1.83) -> DataFrame:
    """Win share over the last w games (null before there are w), season to date from `least` games on, Pythagorean share, deviation of points over 30."""
    df = long
    for w in windows:
        df = df.withColumn(f"win{w}", F.when(F.count("won").over(past(rows=w)) == w, F.avg("won").over(past(rows=w))))
    season = past(["team", "season"])
    scored, let = (F.pow(F.sum(c).over(season), exponent) for c in ("pts", "opp_pts"))
    enough = F.count("won").over(season) >= least
    df = df.withColumn("to_date", F.when(enough, F.avg("won").over(season))).withColumn("pythagoras", F.when(enough, F.try_divide(scored, scored + let)))
    return df.withColumn("volatility", F.when(F.count("pts").over(past(rows=30)) == 30, F.stddev_pop("pts").over(past(rows=30))))


def ratio_of_sums(long: DataFrame, top: str, bottom: str, w: int, out: str) -> DataFrame:
    """Sum over sum of the last w games; null before there are w, and over 0."""
    frame = past(rows=w)
    return long.withColumn(out, F.when(F.count("*").over(frame) == w, F.try_divide(F.sum(top).over(frame), F.sum(bottom).over(frame))))


def pair_key(a: Column, b: Column) -> Column:
    """The same text for two names in either order."""
    return F.concat_ws("|", F.least(a.cast("string"), b.cast("string")), F.greatest(a.cast("string"), b.cast("string")))


def coin(game: Column, seed: int) -> Column:
    """0 or 1 from a hash of the game, whatever its row's place."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), game)), 1, 1), 16, 10).cast("int") % 2


def neutral_flip(day: Column, a: Column, b: Column) -> Column:
    """Whether the sides of a game on neutral ground change places: the low bit of the first byte of SHA-256 of day and sorted pair."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", day.cast("string"), pair_key(a, b)), 256), 1, 2), 16, 10).cast("int") % 2
