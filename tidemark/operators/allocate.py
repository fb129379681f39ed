"""Exposure rules, rotations and backtests over long tables of (ticker, d, ret): windows and grouped sums, no loop over dates.

A rule for a day never sees that day: every signal is taken one row late. A null signal exposes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .history import compounded
from .portfolio import YEAR


def _series():
    return W.partitionBy("ticker").orderBy("d")


def trend(df: DataFrame, w: int, out: str, value: str = "px") -> DataFrame:
    """1.0 where `value` was above its mean of w rows on the row before, else 0.0 (also before there are w rows)."""
    frame = _series().rowsBetween(1 - w, 0)
    up = F.when(F.count(value).over(frame) == w, (F.col(value) > F.avg(value).over(frame)).cast("double"))
    return df.withColumn("_up", up).withColumn(out, F.coalesce(F.lag("_up").over(_series()), F.lit(0.0))).drop("_up")


def vol_target(df: DataFrame, w: int, target: float, cap: float, out: str) -> DataFrame:
    """target / trailing yearly vol of the rows before (half of w, and 22, at least), from 0 to cap."""
    frame = _series().rowsBetween(1 - w, 0)
    vol = F.when(F.count("ret").over(frame) >= max(22, w // 2), F.stddev_samp("ret").over(frame) * F.sqrt(F.lit(YEAR)))
    df = df.withColumn("_v", vol).withColumn("_e", F.when(F.col("_v").isNotNull(), F.lit(target) / F.greatest("_v", F.lit(0.01))))
    return df.withColumn(out, F.coalesce(F.least(F.lag("_e").over(_series()), F.lit(cap)), F.lit(0.0))).drop("_v", "_e")


def exposed(exposure: Column, ret: Column, bill: Column, borrow_bps: float = 0.0) -> Column:
    """Return of holding `exposure` of an asset and the rest in bills, borrowing above one at a spread."""
    borrowed = F.greatest(exposure - 1.0, F.lit(0.0)) * (borrow_bps / 10000.0 / YEAR)
    return exposure * ret + (1.0 - exposure) * bill - borrowed


def trend_rotation(df: DataFrame, flag: str, bill: float) -> DataFrame:
    """(d, ret): mean return of the tickers in trend each day, the bill rate where there are none."""
    held = F.avg(F.when((F.col(flag) > 0) & F.col("ret").isNotNull(), F.col("ret")))
    return df.groupBy("d").agg(F.coalesce(held, F.lit(bill)).alias("ret"))


def momentum_rotation(df: DataFrame, lookback: int, k: int) -> DataFrame:
    """(d, ret): mean return of the k tickers with the largest sums of the `lookback` returns before; only days with all of them."""
    past = _series().rowsBetween(-lookback, -1)
    df = df.withColumn("_m", F.when(F.count("ret").over(past) == lookback, F.sum("ret").over(past))).where("_m is not null")
    best = df.withColumn("_k", F.row_number().over(W.partitionBy("d").orderBy(F.desc("_m"), "ticker")))
    return best.where(F.col("_k") <= k).groupBy("d").agg(F.avg("ret").alias("ret"))


def rebalance_costs(weights: DataFrame, bps: Column) -> DataFrame:
    """(d, cost): the sum of absolute weight changes times each name's rate in basis points; an absent name weighs 0.

    `bps` is an expression over the ticker.
    """
    days = weights.select("d").distinct().withColumn("next", F.lead("d").over(W.orderBy("d")))
    gone = weights.join(days, "d").where("next is not null").select(F.col("next").alias("d"), "ticker", (-F.col("w")).alias("w"))
    moves = weights.select("d", "ticker", "w").unionByName(gone).groupBy("d", "ticker").agg(F.sum("w").alias("w"))
    return moves.groupBy("d").agg(F.sum(F.abs("w") * bps / 10000.0).alias("cost"))


def drifting_mix(rets: DataFrame, weight: Column, segment: Column) -> DataFrame:
    """(d, seg, ret): a static mix set back to its weights at the start of each segment, drifting inside it.

    The value in a segment is the weighted sum of each ticker's growth since its start; a null return is none.
    """
    seg = rets.withColumn("seg", segment).withColumn("_w", weight)
    frame = W.partitionBy("ticker", "seg").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("ticker", "seg").orderBy("d").rowsBetween(W.unboundedPreceding, -1)
    grown = seg.withColumn("_g", compounded(F.col("ret"), frame)).withColumn("_b", F.coalesce(compounded(F.col("ret"), before), F.lit(1.0)))
    return grown.groupBy("d", "seg").agg((F.try_divide(F.sum(F.col("_w") * F.col("_g")), F.sum(F.col("_w") * F.col("_b"))) - 1).alias("ret"))


def blend(streams: DataFrame, weight: Column, n: int) -> DataFrame:
    """(d, ret): weighted sum of n return streams (ticker, d, ret) on the days that all of them have."""
    full = streams.where("ret is not null").groupBy("d").agg(F.sum(F.col("ret") * weight).alias("ret"), F.count("*").alias("_n"))
    return full.where(F.col("_n") == n).drop("_n")


def switching_costs(rets: DataFrame, flip: str, bps: float, out: str = "net") -> DataFrame:
    """Returns less a one-way cost on the trading day after a signal flips."""
    return rets.withColumn(out, F.col("ret") - F.when(F.lag(flip).over(_series()) > 0.5, bps / 10000).otherwise(0.0))


def pooled_sleeves(streams: DataFrame, segment: Column) -> DataFrame:
    """(d, ret, live): an equal mix of all sleeves (ticker, d, ret), set back at the start of each segment and drifting inside it.

    A sleeve without a return on a day that others have earns nothing that day and is out until the next segment; the rest then are the whole. Days are those that any sleeve has.
    The grid has a row a sleeve and day, sleeves being few.
    """
    names = streams.select("ticker").distinct()
    grid = streams.where("ret is not null").select("d").distinct().withColumn("seg", segment).crossJoin(F.broadcast(names)).join(streams.select("ticker", "d", "ret"), ["ticker", "d"], "left")
    before = W.partitionBy("ticker", "seg").orderBy("d").rowsBetween(W.unboundedPreceding, -1)
    missed = F.coalesce(F.max(F.col("ret").isNull().cast("int")).over(before), F.lit(0))
    rows = grid.withColumns({"_out": missed, "_v": F.coalesce(compounded(F.col("ret"), before), F.lit(1.0))})
    value = F.when(F.col("_out") == 0, F.col("_v"))
    earned = F.sum(value * F.coalesce("ret", F.lit(0.0)))
    return rows.groupBy("d").agg(F.coalesce(F.try_divide(earned, F.sum(value)), F.lit(0.0)).alias("ret"), F.count(value).alias("live"))


def row_segment(n: int, by: list[str]) -> Column:
    """The number of the run of n rows that a row stands in, in order of d."""
    return F.floor((F.row_number().over(W.partitionBy(*by).orderBy("d")) - 1) / n)


def complete_mean(streams: DataFrame) -> DataFrame:
    """(d, ret): the mean of all sleeves (ticker, d, ret) on the days that all have."""
    names = streams.select("ticker").distinct().agg(F.count("*").alias("_all"))
    days = streams.where("ret is not null").groupBy("d").agg(F.avg("ret").alias("ret"), F.count("*").alias("_k"))
    return days.crossJoin(F.broadcast(names)).where("_k = _all").select("d", "ret")  # one row


def trend_top_k(df: DataFrame, flag: str, lookback: int, k: int, bill: float) -> DataFrame:
    """(d, ret): each day the mean of the k tickers in trend with the largest sums of the `lookback` returns before; the bill rate where none is in trend."""
    past = _series().rowsBetween(-lookback, -1)
    known = df.withColumn("_m", F.when((F.col(flag) > 0) & (F.count("ret").over(past) == lookback), F.sum("ret").over(past))).where("ret is not null")
    ranked = known.withColumn("_k", F.row_number().over(W.partitionBy("d").orderBy(F.desc_nulls_last("_m"), "ticker")))
    return ranked.groupBy("d").agg(F.coalesce(F.avg(F.when(F.col("_m").isNotNull() & (F.col("_k") <= k), F.col("ret"))), F.lit(bill)).alias("ret"))


def trend_inverse_vol(df: DataFrame, flag: str, w: int, bill: float) -> DataFrame:
    """(d, ret): each day the tickers in trend by the inverse of their deviation over the w rows before; the bill rate where none is."""
    past = _series().rowsBetween(-w, -1)
    inv = F.when((F.col(flag) > 0) & (F.count("ret").over(past) == w) & (F.stddev_samp("ret").over(past) > 0), 1 / F.stddev_samp("ret").over(past))
    known = df.withColumn("_i", inv).where("ret is not null")
    return known.groupBy("d").agg(F.coalesce(F.try_divide(F.sum(F.col("_i") * F.col("ret")), F.sum("_i")), F.lit(bill)).alias("ret"))


def monthly_vol_target(daily: DataFrame, target: float, cap: float, days: int = 63, months: int = 12) -> DataFrame:
    """(ticker, month, ret, exposure): monthly returns and the exposure target / vol of the month before, from 0 to cap, 0 where nothing is known.

    vol: a year's, of the last `days` daily returns at the month's end where there are half of them and 22, else of the last `months` monthly returns with half of them and 3.
    """
    frame = _series().rowsBetween(1 - days, 0)
    vol = F.when(F.count("ret").over(frame) >= max(22, days // 2), F.stddev_samp("ret").over(frame) * F.sqrt(F.lit(float(YEAR))))
    rows = daily.withColumn("_v", vol).withColumn("month", F.trunc("d", "month"))
    monthly = rows.groupBy("ticker", "month").agg((compounded(F.col("ret")) - 1).alias("ret"), F.max_by("_v", "d").alias("_v"))
    o = W.partitionBy("ticker").orderBy("month")
    back = o.rowsBetween(1 - months, 0)
    slow = F.when(F.count("ret").over(back) >= max(3, months // 2), F.stddev_samp("ret").over(back) * F.sqrt(F.lit(12.0)))
    rated = monthly.withColumn("_s", F.coalesce("_v", slow)).withColumn("_e", F.lit(target) / F.greatest("_s", F.lit(0.01)))
    return rated.select("ticker", "month", "ret", F.coalesce(F.least(F.lag("_e").over(o), F.lit(cap)), F.lit(0.0)).alias("exposure"))
