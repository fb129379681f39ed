"""Bets from probabilities and prices, and what a bankroll makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.odds import decimal_odds, fair_pair, kelly
from .history import compounded


def candidates(games: DataFrame, fraction: float = 0.25, most: float = 0.10, least_p: float = 0.0) -> DataFrame:
    """(game columns, side, p, fair, edge, odds, stake, won, profit) of both sides of (ml_a, ml_b, p_a, y), where the edge is above half the overround.

    y is 1 if side a won, null while open; profit is per unit of bankroll at the capped fractional Kelly stake.
    """
    fair_a, fair_b, vig = fair_pair(F.col("ml_a"), F.col("ml_b"))
    side = lambda name, p, fair, ml, won: F.struct(F.lit(name).alias("side"), p.alias("p"), fair.alias("fair"), (p - fair).alias("edge"), decimal_odds(ml).alias("odds"), won.alias("won"))
    both = F.array(side("a", F.col("p_a"), fair_a, F.col("ml_a"), F.col("y") == 1), side("b", 1 - F.col("p_a"), fair_b, F.col("ml_b"), F.col("y") == 0))
    kept = [c for c in games.columns if c not in ("ml_a", "ml_b", "p_a", "y")]
    bets = games.withColumn("_vig", vig).select(*kept, "_vig", F.explode(both).alias("s")).select(*kept, "_vig", "s.*").where((F.col("edge") > F.col("_vig") / 2) & (F.col("p") >= least_p)).drop("_vig")
    bets = bets.withColumn("stake", F.least(kelly(F.col("p"), F.col("odds")) * fraction, F.lit(most)))
    return bets.withColumn("profit", F.when(F.col("won"), F.col("stake") * (F.col("odds") - 1)).when(~F.col("won"), -F.col("stake")))


def scaled(bets: DataFrame, bankroll: float) -> DataFrame:
    """bets with `size`: stakes scaled so that they add up to the bankroll (0 where there are none), and their profit."""
    total = bets.agg(F.sum("stake").alias("_all"))
    got = bets.crossJoin(F.broadcast(total)).withColumn("size", F.coalesce(F.try_divide(F.col("stake") * bankroll, "_all"), F.lit(0.0))).drop("_all")  # one row
    return got.withColumn("profit", F.when(F.col("won"), F.col("size") * (F.col("odds") - 1)).when(~F.col("won"), -F.col("size")))


def daily_path(bets: DataFrame, by: list[str], day: str, cap: float = 0.20, stop: float = 0.5) -> DataFrame:
    """(by, day, bets, staked, ret, roll, dd, stopped): a bankroll that stakes `stake` on each bet of a day, together at most `cap` of it.

    The bets of a day follow each other: each stakes its share of what the ones before have left. A day opening below `stop` of the start bets nothing, nor
    does any later one. Growth is a product over bets and days, so the whole path is a few windows.
    """
    scale = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(cap), F.sum("stake").over(W.partitionBy(*by, day))), F.lit(1.0)))
    scaled = bets.withColumn("_scale", scale)
    days = scaled.groupBy(*by, day).agg(F.count("*").alias("bets"), F.sum(F.col("stake") * F.col("_scale")).alias("staked"), (compounded(F.col("profit") * F.col("_scale")) - 1).alias("ret"))
    o = W.partitionBy(*by).orderBy(day)
    days = days.withColumn("_open", F.coalesce(compounded(F.col("ret"), o.rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0)))
    days = days.withColumn("stopped", F.max((F.col("_open") < stop).cast("int")).over(o.rowsBetween(W.unboundedPreceding, 0)) == 1)
    days = days.withColumn("ret", F.when(F.col("stopped"), 0.0).otherwise(F.col("ret"))).withColumn("roll", compounded(F.col("ret"), o.rowsBetween(W.unboundedPreceding, 0)))
    return days.withColumn("dd", F.col("roll") / F.greatest(F.lit(1.0), F.max("roll").over(o.rowsBetween(W.unboundedPreceding, 0))) - 1).drop("_open")


def report(bets: DataFrame, by: list[str]) -> DataFrame:
    """(by, bets, staked, profit, roi, win_rate, flat_roi) of settled bets."""
    flat = F.avg(F.when(F.col("won"), F.col("odds") - 1).otherwise(-1.0))
    got = bets.where("won is not null").groupBy(*by).agg(F.count("*").alias("bets"), F.sum("stake").alias("staked"), F.sum("profit").alias("profit"), F.avg(F.col("won").cast("double")).alias("win_rate"), flat.alias("flat_roi"))
    return got.withColumn("roi", F.try_divide("profit", "staked"))


def shuffled(df: DataFrame, label: str, within: list[str], row: str, times: int, seed: int = 7) -> DataFrame:
    """df `times` over with `perm` and the label dealt anew inside each group, by the order of a hash."""
    reps = df.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(times))))
    group = W.partitionBy("perm", *within)
    place = reps.withColumn("_i", F.row_number().over(group.orderBy(row))).withColumn("_j", F.row_number().over(group.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "perm", row)))))
    dealt = place.select("perm", *within, F.col("_j").alias("_i"), F.col(label).alias("_y"))
    return place.join(dealt, ["perm", *within, "_i"]).withColumn(label, F.col("_y")).drop("_i", "_j", "_y")
