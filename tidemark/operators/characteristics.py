"""Characteristics of stocks from prices and volumes, coverage and splits of what a ranker learns from, and subsets of a series by regime.

Figures of a row look at the series' own rows up to and with it; a decision takes the last row before its day (`asof.as_of`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .portfolio import YEAR
from .regress import residual_vol

PRICE = ("mom_1m_1m", "mom_6m_1m", "mom_12m_1m", "mom_36m_13m", "chmom", "maxret_22d", "retvol_22d", "beta_252d", "betasq_252d", "idiovol_126d")
VOLUME = ("turn_22d", "dolvol_22d", "std_dolvol", "ill_amihud", "baspread_hl", "zerotrade")


def _rows(n: int):
    return W.partitionBy("ticker").orderBy("d").rowsBetween(1 - n, 0)


def log_return(start: int, end: int, value: str = "px") -> Column:
    """ln of the price `end` rows ago over that `start` rows ago; null where one is missing or not above 0."""
    o = W.partitionBy("ticker").orderBy("d")
    at = lambda k: F.lag(value, k).over(o) if k else F.col(value)
    return F.when((at(start) > 0) & (at(end) > 0), F.log(at(end) / at(start)))


def price_characteristics(prices: DataFrame, bench: str) -> DataFrame:
    """(ticker, d, px, PRICE) of (ticker, d, px): momentum over skipped months and its change, largest return and deviation of 22 rows, beta and residual deviation against the ticker `bench`.

    Rows without a price are left out; a series has none of them before its 22nd row. Short windows need 15 returns, beta as in `regress.residual_vol`.
    """
    o = W.partitionBy("ticker").orderBy("d")
    rows = prices.where("px is not null").select("ticker", "d", "px").withColumns({"ret": F.try_divide("px", F.lag("px").over(o)) - 1, "_k": F.row_number().over(o)})
    moves = {"mom_1m_1m": (22, 1), "mom_6m_1m": (126, 22), "mom_12m_1m": (252, 22), "mom_36m_13m": (756, 273)}
    rows = rows.withColumns({name: log_return(*span) for name, span in moves.items()})
    enough = F.count("ret").over(_rows(22)) >= 15
    rows = rows.withColumns({"chmom": F.when(F.col("_k") >= 274, F.col("mom_6m_1m") - F.lag("mom_6m_1m", 126).over(o)), "maxret_22d": F.when(enough, F.max("ret").over(_rows(22))), "retvol_22d": F.when(enough, F.stddev_samp("ret").over(_rows(22)) * F.sqrt(F.lit(float(YEAR))))})
    market = rows.where(F.col("ticker") == bench).select("d", F.col("ret").alias("bench"))
    risk = residual_vol(rows.select("ticker", "d", "ret").join(market, "d")).select("ticker", "d", F.col("beta").alias("beta_252d"), (F.col("beta") * F.col("beta")).alias("betasq_252d"), F.col("idio").alias("idiovol_126d"))
    met = rows.join(risk, ["ticker", "d"], "left")
    return met.select("ticker", "d", "px", *[F.when(F.col("_k") >= 22, F.col(c)).alias(c) for c in PRICE])


def peer_mean(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """df with the mean of `value` over the others of the group (a sector on a day); alone in it, the own value; null without a group or any value."""
    g = W.partitionBy(*by)
    total, n = F.sum(value).over(g), F.count(value).over(g)
    others = F.when(n == 0, None).when(F.col(value).isNull() | (n == 1), total / n).otherwise((total - F.col(value)) / (n - 1))
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    return df.withColumn(out, F.when(known, others))


def volume_characteristics(bars: DataFrame) -> DataFrame:
    """(ticker, d, VOLUME) of (ticker, d, high, low, close, volume, shares): turnover, dollar volume and its deviation, illiquidity, spread, share of days without a trade, over 22 rows of which 15 are known.

    The deviation of dollar volume needs 5 days with a trade; turnover needs shares above 0 on the row.
    """
    o = W.partitionBy("ticker").orderBy("d")
    rows = bars.withColumns({"_dv": F.col("close") * F.col("volume"), "_ret": F.abs(F.try_divide("close", F.lag("close").over(o)) - 1)})
    rows = rows.withColumns({"_log": F.when(F.col("_dv") > 0, F.log("_dv")), "_ill": F.when(F.col("_dv") > 0, F.col("_ret") / F.col("_dv")), "_spread": F.try_divide(F.col("high") - F.col("low"), (F.col("high") + F.col("low")) / 2)})
    f = _rows(22)
    n = lambda c: F.count(c).over(f)
    base = (n("volume") >= 15) & (n("close") >= 15)
    traded = F.avg("_dv").over(f)
    figures = {
        "turn_22d": F.when(F.col("shares") > 0, F.avg("volume").over(f) / F.col("shares")), "dolvol_22d": F.when((n("_dv") >= 15) & (traded > 0), F.log(traded)), "std_dolvol": F.when((n("_dv") >= 15) & (n("_log") >= 5), F.stddev_samp("_log").over(f)),
        "ill_amihud": F.when((n("_dv") >= 15) & (n("_ill") >= 15), F.avg("_ill").over(f)), "baspread_hl": F.when(n("_spread") >= 15, F.avg("_spread").over(f)), "zerotrade": F.avg((F.col("volume") == 0).cast("double")).over(f),
    }
    return rows.select("ticker", "d", *[F.when(base, c).alias(name) for name, c in figures.items()])


def covered(df: DataFrame, by: list[str], features: list[str], least: int = 50, share: float = 0.7) -> DataFrame:
    """(by, good, total, valid): tickers with at least this share of their features, of all, and whether they are enough to learn from."""
    known = sum((F.col(f).isNotNull().cast("int") for f in features[1:]), F.col(features[0]).isNotNull().cast("int")) / len(features)
    got = df.groupBy(*by).agg(F.sum((known >= share - 1e-12).cast("long")).alias("good"), F.count("*").alias("total"))
    return got.withColumn("valid", F.col("good") >= least)


def recent_split(df: DataFrame, day: str, fraction: float = 0.2) -> DataFrame:
    """df with `part`: rows of the newest fraction of dates (one at least) are for validation, others train; with fewer than five dates all train."""
    days = df.select(day).distinct()
    rank, n = F.row_number().over(W.orderBy(F.desc(day))), F.count("*").over(W.partitionBy(F.lit(0)))  # a row a date
    marked = days.withColumn("part", F.when((n >= 5) & (rank <= F.greatest(F.lit(1), F.floor(n * fraction + 1e-9))), "val").otherwise("train"))
    return df.join(F.broadcast(marked), day)


def skipped_momentum(prices: DataFrame, decisions: DataFrame, lookback: int = 252, skip: int = 21, least: int | None = None) -> DataFrame:
    """(at, ticker, score): the return from the first to the last price of the `lookback` trading days that end `skip` days before the last day ahead of a decision.

    Each ticker counts by its own first and last price there, if it has `least` of them (half of the window) and the first is above 0. Trading days are those of any ticker; a decision
    with fewer than lookback + skip + 1 of them scores nothing. A decision meets its window's days by equal dates.
    """
    days = prices.where("px is not null").select("d").distinct().withColumn("_r", F.row_number().over(W.orderBy("d")))  # a row a date
    at = decisions.select("at").distinct()
    last = at.join(F.broadcast(days), F.col("d") < F.col("at")).groupBy("at").agg(F.max("_r").alias("_last"))  # dates with dates
    spans = last.where(F.col("_last") >= lookback + skip + 1).select("at", F.explode(F.sequence(F.col("_last") - (lookback + skip) + 1, F.col("_last") - skip)).alias("_r"))
    met = spans.join(days, "_r").join(prices.where("px is not null").select("ticker", "d", "px"), "d")
    got = met.groupBy("at", "ticker").agg(F.count("*").alias("_n"), F.min_by("px", "d").alias("_a"), F.max_by("px", "d").alias("_b"))
    return got.where((F.col("_n") >= (least or max(2, lookback // 2))) & (F.col("_a") > 0)).select("at", "ticker", (F.col("_b") / F.col("_a") - 1).alias("score"))


def regime_masks(day: str, break_day: str, windows: dict[str, tuple[str, str]]) -> dict[str, Column]:
    """Conditions by name: full, pre_ and post_ of the break's year (the break day is after it), and ex_ of each window, whose both ends are left out."""
    d, at = F.col(day), lambda x: F.lit(x).cast("date")
    out = {"full": F.lit(True), f"pre_{break_day[:4]}": d < at(break_day), f"post_{break_day[:4]}": d >= at(break_day)}
    return out | {f"ex_{name}": ~d.between(at(a), at(b)) for name, (a, b) in windows.items()}


def masked(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """The rows of df once for each mask that keeps them, named in `mask`."""
    names = F.array_compact(F.array(*[F.when(keep, F.lit(name)) for name, keep in masks.items()]))
    return df.withColumn("mask", F.explode(names))


def mask_coverage(df: DataFrame, by: list[str], day: str, masks: dict[str, Column]) -> DataFrame:
    """(by, mask, n_full, n_kept, fraction, years, first, last): what each mask keeps of each series; masks that keep nothing are there with 0."""
    flags = F.array(*[F.struct(F.lit(name).alias("mask"), keep.alias("keep")) for name, keep in masks.items()])
    each = df.select(*by, day, F.explode(flags).alias("m"))
    kept = F.when(F.col("m.keep"), F.col(day))
    got = each.groupBy(*by, "m.mask").agg(F.count("*").alias("n_full"), F.count(kept).alias("n_kept"), F.min(kept).alias("first"), F.max(kept).alias("last"))
    return got.select(*by, "mask", "n_full", "n_kept", (F.col("n_kept") / F.col("n_full")).alias("fraction"), (F.col("n_kept") / YEAR).alias("years"), "first", "last")


def commission_drag(ret: Column, turnover: float, bps: float) -> Column:
    """A yearly turnover's commission spread over the days of a year."""
    return ret - turnover * bps / 10_000 / YEAR


def representatives(available: DataFrame, order: DataFrame, by: list[str]) -> DataFrame:
    """(by, cls, ticker): of each class the first ticker in its order (cls, ticker, rank) that is available; classes with none have no row."""
    met = available.join(order, "ticker")
    return met.groupBy(*by, "cls").agg(F.min_by("ticker", F.struct("rank", "ticker")).alias("ticker"))


def available_by_class(available: DataFrame, order: DataFrame, by: list[str]) -> DataFrame:
    """(by, cls, tickers) in the class's order."""
    met = available.join(order, "ticker").groupBy(*by, "cls").agg(F.array_sort(F.collect_list(F.struct("rank", "ticker"))).alias("_t"))  # a class's few tickers
    return met.select(*by, "cls", F.transform("_t", lambda t: t["ticker"]).alias("tickers"))
