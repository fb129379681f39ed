"""Guards against looking ahead, splits and folds, fitted transforms, membership intervals.

A guard returns the violations as rows (or one summary row); `raise_if_any` is the strict form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import leaving_reason
from .evaluate import quantiles


def raise_if_any(violations: DataFrame, what: str, shown: int = 3) -> None:
    """ValueError with a few examples if there is a row."""
    rows = violations.limit(shown).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def split_order(df: DataFrame, by: list[str], day: str, part: Column) -> DataFrame:
    """(by, last_train, first_cal, last_cal, first_test, ok): training ends before calibration, and calibration before the test. part is train, cal or test."""
    at = lambda f, p: f(F.when(part == p, F.col(day)))
    got = df.groupBy(*by).agg(at(F.max, "train").alias("last_train"), at(F.min, "cal").alias("first_cal"), at(F.max, "cal").alias("last_cal"), at(F.min, "test").alias("first_test"))
    before = lambda a, b: F.coalesce(F.col(a) < F.col(b), F.lit(True))
    return got.withColumn("ok", before("last_train", "first_test") & before("last_train", "first_cal") & before("last_cal", "first_test"))


def fold_audit(df: DataFrame, by: list[str], part: Column, day: str) -> DataFrame:
    return df.groupBy(*by, part.alias("part")).agg(F.count("*").alias("n"), F.min(day).alias("first"), F.max(day).alias("last"))


def varying_share(df: DataFrame, by: str, features: list[str]) -> DataFrame:
    """(feature, share) of entities for which a feature takes more than one value; an entity of one row counts as varying."""
    each = df.groupBy(by).agg(F.count("*").alias("_n"), *[F.count_distinct(f).alias(f) for f in features])
    varies = lambda f: F.avg(((F.col(f) > 1) | (F.col("_n") == 1)).cast("double"))
    return each.agg(*[varies(f).alias(f) for f in features]).unpivot([], features, "feature", "share")


def released_late(facts: DataFrame, released: str, decided: str) -> DataFrame:
    """Rows whose value was not out before the decision."""
    return facts.where(F.col(released) >= F.col(decided))


def season_split(df: DataFrame, season: str, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """df with `part` by its season's place among the sorted seasons: the first 60 per cent of them train, the next 20 validate, the rest test."""
    seasons = df.select(season).distinct()
    n, rank = F.count("*").over(W.partitionBy(F.lit(0))), F.row_number().over(W.orderBy(season))  # a row a season
    cut = lambda share: F.floor(n * share + 1e-9)
    parts = seasons.withColumn("part", F.when(rank <= cut(train), "train").when(rank <= cut(train) + cut(val), "val").otherwise("test"))
    return df.join(F.broadcast(parts), season)


def drawn_split(df: DataFrame, season: str, seed: int, train: float = 0.6, val: float = 0.2, test: Column | None = None) -> DataFrame:
    """The same over seasons in the order of a hash with a seed; seasons of `test` are held out and not drawn."""
    seasons = df.select(season).distinct().withColumn("_held", F.lit(False) if test is None else test)
    w = W.partitionBy("_held")
    n, rank = F.count("*").over(w), F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.lit(seed), season))))
    cut = lambda share: F.floor(n * share + 1e-9)
    parts = seasons.withColumn("part", F.when(F.col("_held"), "test").when(rank <= cut(train), "train").when(rank <= cut(train) + cut(val), "val").otherwise("test")).drop("_held")
    return df.join(F.broadcast(parts), season)


@dataclass(frozen=True)
class Folds:
    """Rows that stand once, each in a cell (`_cell`), and the folds that use a cell's rows: parts (_cell, fold, part), which are few."""

    rows: DataFrame
    parts: DataFrame

    def spread(self, name: str = "fold") -> DataFrame:
        """(rows, fold, part): a row for each fold that uses it."""
        return self.rows.join(F.broadcast(self.parts.withColumnRenamed("fold", name)), "_cell").drop("_cell")  # a row a cell and fold


def walked(df: DataFrame, fold: str, day: str, row: str, first: int, least: int = 50, cal: float = 0.2) -> Folds:
    """Folds of `walk_forward`. A fold value's rows are told apart only where a calibration part begins, so rows are counted by day, and only those of such days sorted."""
    values = df.groupBy(fold).agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(W.orderBy(fold).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a fold
    values = values.withColumns({"_b": before, "_i": F.row_number().over(W.orderBy(fold)), "_lo": F.min(fold).over(W.partitionBy(F.lit(0)))})
    evals = values.where((F.col(fold) - F.col("_lo") >= first) & (F.col("_b") >= least)).select(F.col(fold).alias("_eval"), F.floor(F.col("_b") * (1 - cal) + 1e-9).alias("_cut"))
    met = values.join(F.broadcast(evals), F.col(fold) <= F.col("_eval")).withColumn("_c", F.col("_cut") - F.col("_b"))  # a row a fold
    inside = met.where((F.col(fold) < F.col("_eval")) & (F.col("_c") > 0) & (F.col("_c") < F.col("_k"))).select(fold, "_c").distinct()
    days = df.groupBy(fold, day).agg(F.count("*").alias("_m"))
    days = days.withColumn("_to", F.sum("_m").over(W.partitionBy(fold).orderBy(day))).join(F.broadcast(inside), fold).where((F.col("_c") > F.col("_to") - F.col("_m")) & (F.col("_c") <= F.col("_to")))
    ends = days.select(F.col(fold).alias("_f"), F.col(day).alias("_d"), (F.col("_c") - F.col("_to") + F.col("_m")).alias("_nth"))
    at = df.join(F.broadcast(ends.select("_f", "_d").distinct()), (F.col(fold) == F.col("_f")) & F.col(day).eqNullSafe(F.col("_d"))).select("_f", "_d", F.col(row).alias("_row"))  # a row a fold
    at = at.withColumn("_r", F.row_number().over(W.partitionBy("_f", "_d").orderBy("_row"))).withColumnsRenamed({"_f": "_g", "_d": "_e"})
    last = at.join(F.broadcast(ends), (F.col("_f") == F.col("_g")) & F.col("_d").eqNullSafe(F.col("_e")) & (F.col("_r") == F.col("_nth")))  # a row a fold
    lasts = last.groupBy(F.col("_f").alias(fold)).agg(F.collect_list(F.struct(F.col("_d").alias("a"), F.col("_row").alias("b"))).alias("_lasts"))
    known = values.select(fold, "_i").join(F.broadcast(lasts), fold, "left")  # a row a fold
    cell = lambda j: F.col("_i") * 1_000_000 + j
    passed = F.size(F.filter("_lasts", lambda e: e < F.struct(F.col(day).alias("a"), F.col(row).alias("b"))))
    rows = df.join(F.broadcast(known), fold).select(*df.columns, cell(F.when(F.col("_lasts").isNull(), 0).otherwise(passed)).cast("long").alias("_cell"))
    cuts = inside.groupBy(fold).agg(F.array_sort(F.collect_list("_c")).alias("_cuts"))
    each = met.join(F.broadcast(cuts), fold, "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<bigint>")))
    each = each.withColumn("_j", F.explode(F.sequence(F.lit(0), F.size("_cuts"))))
    part = F.when(F.col(fold) == F.col("_eval"), "test").when(F.col("_c") >= F.coalesce(F.get("_cuts", F.col("_j")), F.col("_k")), "train").otherwise("cal")
    return Folds(rows, each.select(cell(F.col("_j")).cast("long").alias("_cell"), F.col("_eval").alias("fold"), part.alias("part")))


def walk_forward(df: DataFrame, fold: str, day: str, row: str, first: int, least: int = 50, cal: float = 0.2) -> DataFrame:
    """(rows of df, eval, part): for each fold value from first + `first` on, its rows test and all earlier ones train, the newest fifth of those calibrate.

    Folds with fewer than `least` earlier rows are left out. Each row goes to the folds after it, so the output grows with the folds.
    """
    return walked(df, fold, day, row, first, least, cal).spread("eval")


def month_folds(days: DataFrame, train: int = 36, test: int = 12, step: int = 12, least: int = 20, stop: bool = True) -> DataFrame:
    """(fold, train_start, test_start, test_end, n): months of training, then of test, moved on by steps; test days counted, end not included.

    Folds end (stop) or are skipped where fewer than `least` test days are left. The last day itself is outside every test.
    """
    d = days.select("d").distinct()
    span = d.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    starts = span.select("lo", "hi", F.posexplode(F.sequence("lo", "hi", F.expr(f"INTERVAL {step} MONTH"))).alias("fold", "_s"))
    starts = starts.withColumn("train_start", F.add_months("lo", F.col("fold") * step)).withColumn("test_start", F.add_months("train_start", train)).withColumn("test_end", F.least(F.add_months("test_start", test), "hi")).where("test_start < hi")
    counted = starts.join(d, (F.col("d") >= F.col("test_start")) & (F.col("d") < F.col("test_end")), "left").groupBy("fold", "train_start", "test_start", "test_end").agg(F.count("d").alias("n"))
    if not stop:
        return counted.where(F.col("n") >= least)
    short = F.max((F.col("n") < least).cast("int")).over(W.orderBy("fold").rowsBetween(W.unboundedPreceding, 0))  # a row a fold
    return counted.withColumn("_short", short).where("_short = 0").drop("_short")


def normalised(df: DataFrame, train: Column, columns: list[str], kind: str = "zscore") -> DataFrame:
    """Columns as z-scores or between 0 and 1 by the training rows' figures; a column that does not vary there is 0."""
    x = lambda c: F.when(train, F.col(c))
    if kind == "zscore":
        fit = df.agg(*[F.avg(x(c)).alias(f"_a_{c}") for c in columns], *[F.stddev_samp(x(c)).alias(f"_b_{c}") for c in columns])
    else:
        fit = df.agg(*[F.min(x(c)).alias(f"_a_{c}") for c in columns], *[(F.max(x(c)) - F.min(x(c))).alias(f"_b_{c}") for c in columns])
    met = df.crossJoin(F.broadcast(fit))  # one row
    return met.withColumns({c: F.when(F.col(f"_b_{c}") > 0, (F.col(c) - F.col(f"_a_{c}")) / F.col(f"_b_{c}")).otherwise(F.when(F.col(c).isNotNull(), 0.0)) for c in columns}).select(df.columns)


def imputed(df: DataFrame, train: Column, column: str, by: str | None = None, median: bool = False) -> DataFrame:
    """Nulls of a column filled by the training rows' mean or median, of the group where it has one, else of all."""
    whole = quantiles(df.where(train), column, [0.5]).select(F.col("cuts")[0].alias("_all")) if median else df.where(train).agg(F.avg(column).alias("_all"))
    got = df.crossJoin(F.broadcast(whole))  # one row
    if by:
        middle = F.percentile(column, F.lit(0.5)) if median else F.avg(column)
        got = got.join(df.where(train).groupBy(by).agg(middle.alias("_own")), by, "left")
    return got.withColumn(column, F.coalesce(column, "_own", "_all") if by else F.coalesce(column, "_all")).select(df.columns)


def overlapping(intervals: DataFrame) -> DataFrame:
    """(ticker, start_date, end_date, fault) of membership intervals: an end not after the start, or a start before the last end (an open end is never)."""
    o = W.partitionBy("ticker").orderBy("start_date", F.col("end_date").asc_nulls_last())
    last = F.lag(F.coalesce("end_date", F.lit("9999-12-31").cast("date"))).over(o)
    fault = F.when(F.col("end_date") < F.col("start_date"), "negative").when(F.col("end_date") == F.col("start_date"), "empty").when(last > F.col("start_date"), "overlap")
    return intervals.withColumn("fault", fault).where("fault is not null").select("ticker", "start_date", "end_date", "fault")


def _intervals(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Membership of one ticker after the other; what is kept is the start of its open interval."""
    now, start = None, None
    for batch in batches:
        out = []
        for ticker, d, kind in zip(batch["ticker"], batch["d"], batch["kind"]):
            if ticker != now:
                if start is not None:
                    out.append((now, "interval", start, None))
                now, start = ticker, None
            gap = None if start is None else (d - start).days
            if kind == "seed":
                start = d
            elif kind == "remove" and gap is not None and gap > 0:
                out.append((ticker, "interval", start, d))
                start = None
            elif kind == "remove" or gap is not None and gap < -window:
                out.append((ticker, "orphan", d, None))
            elif gap is not None and abs(gap) <= window:
                start = min(start, d)
            else:
                if gap is not None:
                    out.append((ticker, "interval", start, d))
                start = d
        yield pd.DataFrame(out, columns=["ticker", "what", "start_date", "end_date"])
    if start is not None:
        yield pd.DataFrame([(now, "interval", start, None)], columns=["ticker", "what", "start_date", "end_date"])


def membership(events: DataFrame, seeds: DataFrame | None = None, window: int = 30) -> DataFrame:
    """(ticker, what, start_date, end_date) from additions and removals (ticker, d, kind): intervals, an open end being null, and orphan events.

    seeds (ticker, start_date): current members, whose interval is open beforehand. A removal ends the open interval if that began before it. An addition at most
    `window` days from the open interval's start is the same one, told twice, and the earlier day counts; a later one ends that interval and opens
    another; an earlier one is an orphan, as is a removal that meets no interval. Of one day removals come first. Each ticker's events are
    streamed in order; a task keeps one day.
    """
    rows = events.select("ticker", "d", "kind", F.when(F.col("kind") == "remove", 1).otherwise(2).alias("_o"))
    if seeds is not None:
        rows = rows.unionByName(seeds.select("ticker", F.col("start_date").alias("d"), F.lit("seed").alias("kind"), F.lit(0).alias("_o")))
    first = rows.withColumn("_s", F.when(F.col("kind") == "seed", 0).otherwise(1)).repartition("ticker").sortWithinPartitions("ticker", "_s", "d", "_o").select("ticker", "d", "kind")
    return first.mapInPandas(lambda b: _intervals(b, window), f"ticker {events.schema['ticker'].dataType.simpleString()}, what string, start_date date, end_date date")


def consolidated(events: DataFrame, seeds: DataFrame | None = None, window: int = 30) -> DataFrame:
    """(ticker, start_date, end_date): the intervals of `membership`."""
    return membership(events, seeds, window).where("what = 'interval'").drop("what")


def delistings(events: DataFrame, current: DataFrame) -> DataFrame:
    """(ticker, delist_date, delist_return, category, reason): the last removal of tickers that are not current members, and what its reason says of the return."""
    gone = events.where("kind = 'remove'").groupBy("ticker").agg(F.max("d").alias("delist_date"), F.max_by("reason", "d").alias("reason"))
    ret, category = leaving_reason(F.col("reason"))
    return gone.join(current.select("ticker").distinct(), "ticker", "left_anti").withColumns({"delist_return": ret, "category": category})
