"""Ratings of two sides, updated game after game.

A rating depends on the one before, so a league's games are folded in order. They are dealt to tasks by league, sorted there
and streamed in batches; a task keeps the current ratings and nothing else, whatever the number of games. Leagues
run side by side; configurations move with each game, as arrays. The same fold keeps ratings live on a stream (streaming.live).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """k: step; home: edge of side a off neutral ground; kept: share of the distance to `start` that a new season keeps, once a season or, with yearly, once a year.

    margin: `log` scales the step by ln(|margin| + 1), nothing for a draw, less between sides far apart; `signed` by ln(max(|margin|, 1) + 1), less the more side a
    is the favourite, its edge included; None not at all. even_draws: a draw's step is not scaled. late: a game at share s of its season counts (1 + late s) times.
    decay: a side's distance shrinks by exp(-decay days / 365) before each game. change: share of it lost in a game of another class than
    the last. early: (games, factor) of the step while a side has played fewer. finish: factor of the step of a game that was finished early.
    """

    k: float = 20.0
    home: float = 100.0
    start: float = 1500.0
    kept: float = 0.75
    yearly: bool = False
    margin: str | None = "log"
    even_draws: bool = False
    late: float = 0.0
    decay: float = 0.0
    change: float = 0.0
    early: tuple[int, float] = (0, 1.0)
    finish: float = 1.0


def expected(a: float, b: float) -> float:
    return 1.0 / (1.0 + 10 ** (-(a - b) / 400))


def step(config: Config, a: float, b: float, edge: float, margin: float, k: float) -> float:
    """The step of one game."""
    if config.margin is None or margin == 0 and config.even_draws:
        return k
    if config.margin == "signed":
        return k * math.log(max(abs(margin), 1) + 1) * (2.2 / (2.2 + 0.001 * (a + edge - b)))
    return k * math.log(abs(margin) + 1) * (2.2 / (2.2 + 0.001 * abs(a - b)))


@dataclass
class System:
    """Current ratings and last days of the sides of a league or class."""

    ratings: dict = field(default_factory=dict)
    seen: dict = field(default_factory=dict)

    def faded(self, config: Config, side, day: int) -> None:
        idle = day - self.seen.get(side, day)
        if config.decay and idle > 0:
            self.ratings[side] = config.start + (self.ratings.get(side, config.start) - config.start) * math.exp(-config.decay * idle / 365)

    def moved(self, config: Config, a, b, edge: float, margin: float, k: float, won: float, day: int) -> tuple[float, float, float, float]:
        """Ratings of both sides before a game and its expected score, and the change of side a; the change is made."""
        ra, rb = self.ratings.get(a, config.start), self.ratings.get(b, config.start)
        p = expected(ra + edge, rb)
        by = step(config, ra, rb, edge, margin, k) * (won - p)
        self.ratings[a], self.ratings[b] = ra + by, rb - by
        self.seen[a] = self.seen[b] = day
        return ra, rb, p, by


@dataclass
class Fold:
    """Ratings of one league, game after game: all games', and those of each class of games by itself."""

    config: Config
    season: int | None = None
    whole: System = field(default_factory=System)
    classes: dict = field(default_factory=dict)
    last: dict = field(default_factory=dict)
    played: dict = field(default_factory=dict)

    def game(self, season, a, b, score_a: float, score_b: float, neutral: bool, k: float | None, share: float, day: int, cls, finished: bool) -> tuple:
        """rating_a, rating_b, expected, after_a, after_b, class_a, class_b, class_expected; the last three are null without a class."""
        c = self.config
        if self.season is not None and season > self.season:
            kept = c.kept ** (season - self.season if c.yearly else 1)
            self.whole.ratings = {side: c.start + (r - c.start) * kept for side, r in self.whole.ratings.items()}
        self.season = season if self.season is None else max(season, self.season)
        for side in (a, b):
            self.whole.faded(c, side, day)
            if cls is not None and side in self.last and self.last[side] != cls:
                self.whole.ratings[side] = c.start + (self.whole.ratings.get(side, c.start) - c.start) * (1 - c.change)
        k = (c.k if k is None else k) * (1 + c.late * share) * (c.finish if finished else 1.0)
        k *= max(c.early[1] if self.played.get(side, 0) < c.early[0] else 1.0 for side in (a, b))
        won = 1.0 if score_a > score_b else 0.5 if score_a == score_b else 0.0
        edge, margin = 0.0 if neutral else c.home, score_a - score_b
        ra, rb, p, by = self.whole.moved(c, a, b, edge, margin, k, won, day)
        own = (None, None, None)
        if cls is not None:
            system = self.classes.setdefault(cls, System())
            for side in (a, b):
                system.faded(c, side, day)
            own = system.moved(c, a, b, edge, margin, k, won, day)[:3]
        for side in (a, b):
            self.last[side] = cls
            self.played[side] = self.played.get(side, 0) + 1
        return ra, rb, p, ra + by, rb - by, *own


GAME = ["season", "side_a", "side_b", "score_a", "score_b", "neutral", "k", "share", "day", "cls", "finished"]
OUT = ["rating_a", "rating_b", "expected", "after_a", "after_b", "class_a", "class_b", "class_expected"]


def completed(games: DataFrame, by: list[str]) -> DataFrame:
    """games with a score, and with the columns that rules look at where they are not there."""
    absent = {"neutral": F.lit(True), "k": F.lit(None).cast("double"), "share": F.lit(0.0), "day": F.lit(0), "cls": F.lit(None).cast("string"), "finished": F.lit(False)}
    filled = lambda c: F.coalesce(F.col(c), absent[c]).alias(c) if c in absent else F.col(c)
    return games.where("score_a is not null and score_b is not null").select(*by, "seq", *[filled(c) if c in games.columns else absent[c].alias(c) for c in GAME])


def plain_rows(batch: pd.DataFrame, columns: list[str]) -> Iterator[tuple]:
    """Rows of a batch with None for every null."""
    return zip(*[batch[c].astype(object).where(batch[c].notna(), None) for c in columns])


def stacked(configs: list[Config]) -> list[tuple[list[int], Config]]:
    """Configurations that differ in numbers only, as one of arrays with their places: a fold of it moves all of them with each game."""
    alike: dict = {}
    for at, c in enumerate(configs):
        alike.setdefault((c.yearly, c.margin, c.even_draws, c.decay, c.change, c.early), []).append(at)
    over = lambda at, name: np.array([getattr(configs[k], name) for k in at])
    return [(at, replace(configs[at[0]], **{name: over(at, name) for name in ("k", "home", "start", "kept", "late", "finish")})) for at in alike.values()]


def rate(games: DataFrame, by: list[str], config: Config | dict[str, Config] = Config()) -> DataFrame:  # noqa: B008
    """games with rating_a, rating_b and expected as they were before each game, league (by) by league in order of (seq, side_a, side_b).

    Columns: by, seq, season, side_a, side_b, score_a, score_b, and where there: neutral, k (a step of the game's own), share (of the season
    gone by), day, cls, finished. after_a and after_b are the ratings that the game left; class_a, class_b and class_expected those of the game's class alone.
    With a dictionary each of its configurations rates all games, named in `config`. Games without a score are left out; a null
    league is a league.
    """
    if isinstance(config, dict):
        name = F.element_at(F.array(*[F.lit(n) for n in config]), F.col("_r._at") + 1).alias("config")
        rated = rate_side_by_side(games, by, list(config.values()))
        rows = rated.select(*[c for c in rated.columns if c not in OUT], F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(config) - 1)).alias("_at"), *OUT)).alias("_r"))
        return rows.select(*[c for c in rows.columns if c != "_r"], name, *[F.col(f"_r.{c}").alias(c) for c in OUT])
    rows = completed(games, by)

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fold = None, None
        for batch in batches:
            got = []
            for league, row in zip(plain_rows(batch, by) if by else repeat(()), plain_rows(batch, GAME)):
                if league != now:
                    now, fold = league, Fold(config)
                got.append(fold.game(*row))
            yield batch.assign(**{c: pd.Series([t[i] for t in got], index=batch.index, dtype=float) for i, c in enumerate(OUT)})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", {c} double" for c in OUT)
    return _in_order(rows, by).mapInPandas(folded, schema)


def _in_order(rows: DataFrame, by: list[str]) -> DataFrame:
    return (rows.repartition(*by) if by else rows.repartition(1)).sortWithinPartitions(*by, "seq", "side_a", "side_b")  # one league, one order


def rate_side_by_side(games: DataFrame, by: list[str], configs: list[Config], out: list[str] = OUT) -> DataFrame:
    """games with the columns `out` of rate as arrays, a number for each configuration: a game is dealt and read once for all of them."""
    rows = completed(games, by)
    places = [OUT.index(c) for c in out]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, folds = None, []
        for batch in batches:
            frame = batch.to_pandas()
            got = {i: np.full((len(frame), len(configs)), np.nan) for i in places}
            for r, (league, row) in enumerate(zip(plain_rows(frame, by) if by else repeat(()), plain_rows(frame, GAME))):
                if league != now or not folds:
                    now, folds = league, [(at if len(at) < len(configs) else slice(None), Fold(c)) for at, c in stacked(configs)]
                for at, fold in folds:
                    figures = fold.game(*row)
                    for i in places:
                        if figures[i] is not None:
                            got[i][r, at] = figures[i]
            ends = pa.array(np.arange(0, (len(frame) + 1) * len(configs), len(configs), dtype=np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(got[i].ravel(), from_pandas=True)) for i in places]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, *out])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", {c} array<double>" for c in out)
    return _in_order(rows, by).mapInArrow(folded, schema)


def latest(rated: DataFrame, by: list[str], config: Config = Config()) -> DataFrame:  # noqa: B008
    """(by, side, rating, games), the highest first: each side's rating after its last game, pulled to the mean for every season that its league began since."""
    side = lambda x: F.struct(F.col(f"side_{x}").alias("side"), F.col(f"after_{x}").alias("r"), "seq", "season")
    sides = rated.select(*by, F.explode(F.array(side("a"), side("b"))).alias("s"))
    last = sides.groupBy(*by, "s.side").agg(F.max_by("s.r", "s.seq").alias("r"), F.max("s.season").alias("season"), F.count("*").alias("games"))
    seasons = rated.groupBy(*by).agg(F.collect_set("season").alias("_seasons"))  # a league's seasons are few
    named = seasons.select(*[F.col(c).alias(f"_g_{c}") for c in by], "_seasons")
    met = last.join(named, [F.col(c).eqNullSafe(named[f"_g_{c}"]) for c in by])
    since = (F.array_max("_seasons") - F.col("season")) if config.yearly else F.size(F.filter("_seasons", lambda s: s > F.col("season")))
    rating = config.start + (F.col("r") - config.start) * F.pow(F.lit(config.kept), since)
    return met.select(*by, "side", rating.alias("rating"), "games").orderBy(F.desc("rating"), *by, "side")


def snapshots(rated: DataFrame, by: list[str], regular: str, config: Config = Config()) -> DataFrame:  # noqa: B008
    """(by, season, side, rating) before each season's closing games: after the side's last game of the season that is `regular`, else as the season began.

    A side is rated from its first season to the league's last; seasons that it sat out pull it to the mean as others do.
    """
    side = lambda x: F.struct(F.col(f"side_{x}").alias("side"), F.col(f"after_{x}").alias("r"))
    sides = rated.select(*by, "season", "seq", F.expr(regular).alias("_regular"), F.explode(F.array(side("a"), side("b"))).alias("s")).select(*by, "season", "seq", "_regular", "s.*")
    per = sides.groupBy(*by, "side", "season").agg(F.max_by(F.when(F.col("_regular"), F.col("r")), F.when(F.col("_regular"), F.col("seq"))).alias("now"), F.max_by("r", "seq").alias("end"))
    seasons = rated.groupBy(*by).agg(F.array_sort(F.collect_set("season")).alias("_all"))  # a league's seasons are few
    key = lambda df, extra: df.select(*[F.col(c).alias(f"_g_{c}") for c in by], *extra)
    same = lambda left, right: [left[c].eqNullSafe(right[f"_g_{c}"]) for c in by]
    named = key(seasons, ["_all"])
    whole = per.groupBy(*by, "side").agg(F.collect_list(F.struct("season", "now", "end")).alias("_had"))
    grid = whole.join(named, same(whole, named)).select(*by, "side", "_had", F.posexplode("_all").alias("_at", "season"))
    mine = F.get(F.filter("_had", lambda h: h["season"] == F.col("season")), F.lit(0))  # null for a season sat out
    grid = grid.where(F.array_min(F.transform("_had", lambda h: h["season"])) <= F.col("season")).select(*by, "side", "_at", "season", mine["now"].alias("now"), mine["end"].alias("end"))
    w = W.partitionBy(*by, "side").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("end").isNotNull(), F.struct("_at", "season", "end")), ignorenulls=True).over(w)
    since = (F.col("season") - last["season"]) if config.yearly else (F.col("_at") - last["_at"])
    began = F.coalesce(config.start + (last["end"] - config.start) * F.pow(F.lit(config.kept), since), F.lit(config.start))
    return grid.select(*by, "season", "side", F.coalesce("now", began).alias("rating"))
