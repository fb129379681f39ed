"""Ratings kept live on a stream of games: the fold of operators.ratings with its state in Spark's state store."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import ratings

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A league's own state and, by side, what is known of it in all games and in each class.
_LEAGUE, _SIDE = "season int, seq long, a string, b string", "known string"


class LiveRatings(StatefulProcessor):
    """Folds the games of a league, batch after batch. Each side is a row of the state, so that a batch writes only the sides that played, but for a new season.

    A game that does not come after the league's last one in order of (seq, side_a, side_b) is late: it is handed on with `late` and rates nothing.
    """

    def __init__(self, config: ratings.Config, by: list[str]):
        self.config, self.by = config, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.league = handle.getValueState("league", _LEAGUE)
        self.sides = handle.getMapState("sides", "side string", _SIDE)

    def _loaded(self) -> tuple[ratings.Fold, tuple]:
        fold, last = ratings.Fold(self.config), None
        if self.league.exists():
            season, *last = self.league.get()
            fold.season, last = season, tuple(last)
        for (side,), (known,) in self.sides.iterator():
            side, known = json.loads(side), json.loads(known)
            fold.whole.ratings[side], fold.whole.seen[side], fold.last[side], fold.played[side], classes = known
            for cls, (rating, day) in classes.items():
                system = fold.classes.setdefault(cls, ratings.System())
                system.ratings[side], system.seen[side] = rating, day
        return fold, last

    def _kept(self, fold: ratings.Fold, sides: set, last: tuple) -> None:
        self.league.update((fold.season, *last))
        for side in sides:
            classes = {cls: (s.ratings[side], s.seen[side]) for cls, s in fold.classes.items() if side in s.ratings}
            known = (fold.whole.ratings[side], fold.whole.seen[side], fold.last.get(side), fold.played[side], classes)
            self.sides.updateValue((json.dumps(side),), (json.dumps(known),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["seq", "side_a", "side_b"], kind="stable", ignore_index=True)  # a league's games of one micro-batch
        fold, last = self._loaded()
        season, got, touched = fold.season, [], set()
        for at, row in zip(ratings.plain_rows(batch, ["seq", "side_a", "side_b"]), ratings.plain_rows(batch, ratings.GAME)):
            at = (int(at[0]), *(json.dumps(x) for x in at[1:]))
            late = last is not None and (at[0], *map(json.loads, at[1:])) <= (last[0], *map(json.loads, last[1:]))
            got.append((*([None] * len(ratings.OUT) if late else fold.game(*row)), late))
            if not late:
                last = at
                touched |= {row[1], row[2]}
        if last is not None:
            self._kept(fold, set(fold.whole.ratings) if fold.season != season else touched, last)
        for i, c in enumerate(ratings.OUT):
            batch[c] = pd.Series([t[i] for t in got], dtype=float)
        batch["late"] = [t[-1] for t in got]
        yield batch

    def close(self) -> None:
        pass


def live_ratings(games: DataFrame, by: list[str], config: ratings.Config = ratings.Config()) -> DataFrame:  # noqa: B008
    """The columns of operators.ratings.rate, and `late`, for a stream of games, league (by) by league; by may not be null.

    Within a micro-batch a league's games are put in order; over batches they have to come in order, and those that do not are handed on with `late`
    and null ratings. A restart from the checkpoint goes on with the state.
    """
    games.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = ratings.completed(games, by)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", {c} double" for c in ratings.OUT) + ", late boolean"
    return rows.groupBy(*by).transformWithStateInPandas(statefulProcessor=LiveRatings(config, by), outputStructType=schema, outputMode="Append", timeMode="None")
