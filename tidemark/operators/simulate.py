"""Backtests over long tables: weights decided at rebalances, checked against membership, held from the next day on, less what trading and holding cost.

Weights are rows (fold, d, ticker, w), returns rows (d, ticker, ret). A day's portfolio is that of the newest rebalance before it, so
work grows with the weights held, and there is no loop over folds or dates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .portfolio import YEAR
from .splits import raise_if_any

#: One-way cost of a trade in basis points, spread and slippage, by a fund's category.
COST_BPS = {"broad_us_equity": (1.0, 0.0), "broad_intl_equity": (2.0, 1.0), "broad_us_bond": (1.0, 0.0), "sector_thematic": (3.0, 1.0), "factor": (2.0, 1.0), "cash_equivalent": (1.0, 0.0), "leveraged_etf": (3.0, 2.0), "crypto_etf": (5.0, 3.0), "default": (3.0, 1.0)}
#: Least market value in billions, spread and slippage by size of a company.
SIZE_BPS = {"mega": (200.0, 1.0, 1.0), "large": (10.0, 2.0, 3.0), "mid": (2.0, 4.0, 6.0), "small": (0.3, 10.0, 15.0), "micro": (0.0, 25.0, 50.0)}
EXPENSE = 0.0008
PER_SHARE = 0.005


def category_bps(category: Column) -> Column:
    """One-way cost in basis points of a category; unknown and null ones cost the default."""
    case = F.lit(sum(COST_BPS["default"]))
    for name, parts in COST_BPS.items():
        case = F.when(category == name, sum(parts)).otherwise(case)
    return case


def size_bps(value: Column) -> Column:
    """One-way cost in basis points by market value; none, and none above 0, is micro."""
    case = F.lit(sum(SIZE_BPS["micro"][1:]))
    for least, *parts in sorted(SIZE_BPS.values()):
        case = F.when((value > 0) & (value / 1e9 >= least), sum(parts)).otherwise(case)
    return case


def rates(universe: DataFrame) -> DataFrame:
    """(ticker, bps, expense) from a universe (ticker, category, expense_ratio)."""
    return universe.select("ticker", category_bps(F.col("category")).alias("bps"), F.coalesce("expense_ratio", F.lit(EXPENSE)).alias("expense"))


def members_only(weights: DataFrame, membership: DataFrame, strict: bool = False) -> DataFrame:
    """Weights of tickers that are members on their day: start <= d < end, an open end being null. strict: ValueError if a ticker is not."""
    spans = membership.select("ticker", "start_date", "end_date")
    held = weights.join(spans, "ticker").where((F.col("start_date") <= F.col("d")) & (F.col("end_date").isNull() | (F.col("end_date") > F.col("d")))).select(weights.columns).distinct()
    if strict:
        raise_if_any(weights.select("d", "ticker").join(held.select("d", "ticker"), ["d", "ticker"], "left_anti"), "tickers that were not members")
    return held


def listed_only(weights: DataFrame, universe: DataFrame) -> DataFrame:
    """Weights of tickers that had been listed: inception_date <= d; tickers that the universe does not have go."""
    return weights.join(universe.select("ticker", "inception_date"), "ticker").where(F.col("inception_date") <= F.col("d")).select(weights.columns)


def alive_only(weights: DataFrame, universe: DataFrame) -> DataFrame:
    """Listed, and not closed by then: closure_date, where there is one, is after d."""
    kept = weights.join(universe.select("ticker", "inception_date", "closure_date"), "ticker")
    return kept.where((F.col("inception_date") <= F.col("d")) & (F.col("closure_date").isNull() | (F.col("closure_date") > F.col("d")))).select(weights.columns)


def renormalised(weights: DataFrame, off: float = 0.01) -> DataFrame:
    """Weights of each rebalance that sum to one, where they sum to something above 0 and are off by more than `off`."""
    total = F.sum("w").over(W.partitionBy("fold", "d"))
    return weights.withColumn("_s", total).withColumn("w", F.when((F.col("_s") > 0) & (F.abs(F.col("_s") - 1) > off), F.col("w") / F.col("_s")).otherwise(F.col("w"))).drop("_s")


def _rebalances(weights: DataFrame) -> DataFrame:
    """(fold, d, prev, next): a row a rebalance."""
    w = W.partitionBy("fold").orderBy("d")
    return weights.select("fold", "d").distinct().withColumns({"prev": F.lag("d").over(w), "next": F.lead("d").over(w)})


def moves(weights: DataFrame) -> DataFrame:
    """(fold, d, ticker, old, new) of every rebalance but a fold's first: the weight before and after, 0 where a name is absent."""
    at = _rebalances(weights)
    old = weights.join(at.where("next is not null").select("fold", "d", "next"), ["fold", "d"]).select("fold", F.col("next").alias("d"), "ticker", F.col("w").alias("old"), F.lit(0.0).alias("new"))
    new = weights.join(at.where("prev is not null").select("fold", "d"), ["fold", "d"]).select("fold", "d", "ticker", F.lit(0.0).alias("old"), F.col("w").alias("new"))
    return old.unionByName(new).groupBy("fold", "d", "ticker").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))


def fund_costs(changed: DataFrame, rate: DataFrame) -> DataFrame:
    """(fold, d, cost, turnover) as shares of the portfolio: every change of weight at its ticker's basis points, the default where it has none."""
    met = changed.join(rate.select("ticker", "bps"), "ticker", "left")
    traded = F.abs(F.col("new") - F.col("old"))
    return met.groupBy("fold", "d").agg(F.sum(traded * F.coalesce("bps", F.lit(sum(COST_BPS["default"]))) / 10_000).alias("cost"), (F.sum(traded) / 2).alias("turnover"))


def stock_costs(changed: DataFrame, figures: DataFrame, capital: float, per_share: float = PER_SHARE) -> DataFrame:
    """(fold, d, cost, turnover): changes of weight at the basis points of the company's size, and a commission for each share where a price is known.

    figures (fold, d, ticker, cap, px): what was known at the rebalance.
    """
    met = changed.join(figures.select("fold", "d", "ticker", "cap", "px"), ["fold", "d", "ticker"], "left")
    traded = F.abs(F.col("new") - F.col("old"))
    shares = F.when(F.col("px") > 0, traded * capital / F.col("px")).otherwise(0.0)
    return met.groupBy("fold", "d").agg(F.sum(traded * size_bps(F.col("cap")) / 10_000 + shares * per_share / capital).alias("cost"), (F.sum(traded) / 2).alias("turnover"))


def held_days(weights: DataFrame, days: DataFrame, ends: DataFrame) -> DataFrame:
    """(fold, d, rebal, first): each trading day with the rebalance it is held from, the newest before it, up to and with the fold's end; first after one.

    ends (fold, end). A rebalance meets the days up to the next one, day by day, so the join is on equal dates.
    """
    at = _rebalances(weights).join(ends, "fold").withColumn("_to", F.least(F.coalesce("next", "end"), "end")).where(F.col("_to") > F.col("d"))
    each = at.select("fold", F.col("d").alias("rebal"), F.explode(F.sequence(F.date_add("d", 1), "_to")).alias("d"))
    met = each.join(days.select("d").distinct(), "d")
    return met.withColumn("first", F.row_number().over(W.partitionBy("fold", "rebal").orderBy("d")) == 1)


def run(rets: DataFrame, weights: DataFrame, ends: DataFrame, bills: Column | float = 0.0, rate: DataFrame | None = None, costs: DataFrame | None = None) -> DataFrame:
    """(fold, d, ret, invested): daily returns of each fold's portfolio.

    A ticker without a return on a day is cash, and cash above 0 earns the bill rate (an expression over d). rate (ticker, expense): a 252nd of the yearly expense
    is taken each day, the default for tickers that it lacks; without rate nothing is. costs (fold, d, cost): what a
    rebalance cost, taken on the first day after it.
    """
    days = held_days(weights, rets, ends)
    held = days.join(weights.select("fold", F.col("d").alias("rebal"), "ticker", "w"), ["fold", "rebal"], "left").join(rets.select("d", "ticker", "ret"), ["d", "ticker"], "left")
    yearly = F.lit(0.0)
    if rate is not None:
        held, yearly = held.join(rate.select("ticker", "expense"), "ticker", "left"), F.coalesce("expense", F.lit(EXPENSE))
    known = F.col("ret").isNotNull()
    sums = held.groupBy("fold", "d", "rebal", "first").agg(F.sum(F.when(known, F.col("w") * F.col("ret"))).alias("_r"), F.coalesce(F.sum(F.when(known, F.col("w"))), F.lit(0.0)).alias("invested"), F.sum(F.col("w") * yearly / YEAR).alias("_e"))
    paid = F.lit(0.0)
    if costs is not None:
        sums = sums.join(costs.select("fold", F.col("d").alias("rebal"), "cost"), ["fold", "rebal"], "left")
        paid = F.when(F.col("first"), F.coalesce("cost", F.lit(0.0))).otherwise(0.0)
    bill = bills if isinstance(bills, Column) else F.lit(bills)
    cash = F.greatest(1 - F.col("invested"), F.lit(0.0)) * bill
    return sums.select("fold", "d", (F.coalesce("_r", F.lit(0.0)) + cash - F.coalesce("_e", F.lit(0.0)) - paid).alias("ret"), "invested")


def pooled(folds: DataFrame) -> DataFrame:
    """One series of all folds: of a day that two folds have, the first fold's counts."""
    return folds.withColumn("_k", F.row_number().over(W.partitionBy("d").orderBy("fold"))).where("_k = 1").drop("_k")


def _folded(batches: Iterator[pd.DataFrame], n: int, drift: float | None, cost: float, cap: int | None) -> Iterator[pd.DataFrame]:
    """One portfolio after the other, day by day; what is kept is the weights of the one at hand."""
    now, w, target, since, short = None, [], [], 0, 0
    for batch in batches:
        out = []
        for who, rets, goal, flip in zip(batch["portfolio"], batch["rets"], batch["goal"], batch["flip"]):
            if who != now:
                now, target, w, since, short = who, list(goal), list(goal), 0, 0
            if cap is not None:  # long, short for so many days, then cash: rets are those three
                short = 0 if flip else short + 1
                out.append(rets[0] if flip else rets[1] if short <= cap else rets[2])
                continue
            since += 1
            grown = [a * (1 + r) for a, r in zip(w, rets)]
            total = math.fsum(grown)
            if drift is not None and total <= 0:
                out.append(-1.0)
                w = list(target)
                continue
            was = math.fsum(w)
            ret = total / was - 1 if was else 0.0
            w = [g / total for g in grown] if drift is not None else grown
            if since >= n:
                set_back, since = True, 0
            elif drift is not None:
                set_back = any(abs(a - t) > drift for a, t in zip(w, target))
            else:
                set_back = bool(flip)
            if set_back:
                w = list(target)
                ret -= cost if drift is None else 0.0
            out.append(ret)
        yield batch[["portfolio", "d"]].assign(ret=out)


def _paths(days: DataFrame, n: int, drift: float | None, cost: float, cap: int | None = None) -> DataFrame:
    kind = days.schema["portfolio"].dataType.simpleString()
    rows = days.repartition("portfolio").sortWithinPartitions("portfolio", "d")
    return rows.mapInPandas(lambda b: _folded(b, n, drift, cost, cap), f"portfolio {kind}, d date, ret double")


def drift_rebalanced(days: DataFrame, drift: float = 0.05, n: int = YEAR) -> DataFrame:
    """(portfolio, d, ret): sleeves set back to their weights every n rows, and whenever one has moved from its weight by more than `drift`.

    days (portfolio, d, rets, goal, flip): a portfolio's sleeve returns and weights of a day, as arrays; flip is not looked at. Weights sum to one. The state is path
    dependent: each portfolio is streamed in order of d, and a task keeps one vector of weights. A day that loses all returns -1 and starts anew.
    """
    return _paths(days, n, drift, 0.0)


def flip_rebalanced(days: DataFrame, bps: float = 10.0, n: int = YEAR) -> DataFrame:
    """The same, set back on the days where flip is true and on every n-th row of the portfolio, at a cost in basis points on that day."""
    marked = days.withColumn("flip", F.coalesce("flip", F.lit(False)) | (F.row_number().over(W.partitionBy("portfolio").orderBy("d")) % n == 0))
    return _paths(marked, 1 << 62, None, bps / 10_000)


def short_capped(days: DataFrame, most: int = 10) -> DataFrame:
    """(portfolio, d, ret): rets[0] where flip (the signal of the day before) is true, else rets[1] for `most` days on end, then rets[2]."""
    return _paths(days, 1, None, 0.0, most)
