"""Weights, turnover, risk figures, stakes and ratings over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .history import compounded

YEAR = 252


def rebalance_dates(days: DataFrame, period: str) -> DataFrame:
    """The first trading day of each period."""
    return days.groupBy("ticker", F.date_trunc(period, "d").cast("date").alias("period")).agg(F.min("d").alias("rebal"))


def inverse_vol(vols: DataFrame, by: list[str]) -> DataFrame:
    """Weights by 1 / vol within each group; names without a positive vol get none."""
    inv = F.when(F.col("vol") > 0, 1 / F.col("vol"))
    return vols.withColumn("w", F.coalesce(inv / F.sum(inv).over(W.partitionBy(*by)), F.lit(0.0)))


def class_cap(weights: DataFrame, by: list[str], cls: str, cap: float) -> DataFrame:
    """Scale each class over the cap down to it, then all weights so that they keep their sum; untouched where no class is over."""
    group = W.partitionBy(*by)
    total = F.sum("w").over(W.partitionBy(*by, cls))
    capped = weights.withColumn("_all", F.sum("w").over(group)).withColumn("_c", F.when(total > cap, F.col("w") * cap / total))
    scaled = F.try_divide(F.coalesce("_c", "w") * F.col("_all"), F.sum(F.coalesce("_c", "w")).over(group))
    return capped.withColumn("w", F.when(F.count("_c").over(group) > 0, F.coalesce(scaled, "w")).otherwise(F.col("w"))).drop("_all", "_c")


def turnover(weights: DataFrame) -> DataFrame:
    """Half the sum of absolute weight changes at each date of (date, ticker, w); a name that is absent weighs 0."""
    dates = weights.select("date").distinct().withColumn("prev", F.lag("date").over(W.orderBy("date")))
    moves = weights.join(dates, "date").select("date", "ticker", "w").unionByName(
        weights.withColumnRenamed("date", "prev").join(dates, "prev").select("date", "ticker", (-F.col("w")).alias("w"))
    )
    return moves.groupBy("date", "ticker").agg(F.sum("w").alias("w")).groupBy("date").agg((F.sum(F.abs("w")) / 2).alias("turnover"))


def top_k(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc_nulls_last(score), tie))).where(F.col("rank") <= k)


def cagr(ret: Column, periods: int = YEAR) -> Column:
    """Yearly growth of a group's returns; -1 after a total loss."""
    grown = compounded(ret)
    return F.when(grown <= 0, -1.0).otherwise(F.pow(grown, periods / F.greatest(F.count(ret), F.lit(1))) - 1)


def risk(rets: DataFrame, by: list[str], periods: int = YEAR) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, drawdown and its longest days, Calmar, CVaR at 95 and 99 per cent of each series (by, d, ret).

    With a column `bench` also information ratio and correlation (0 up to ten common days). Ratios over nothing divide by 1e-10.
    One sort of each series serves all windows.
    """
    series, tiny = W.partitionBy(*by), F.lit(1e-10)
    order = series.orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    df = rets.where("ret is not null").withColumn("_cum", compounded(F.col("ret"), order)).withColumn("_peak", F.max("_cum").over(order))
    df = df.withColumn("_dd", F.try_divide(F.col("_cum") - F.col("_peak"), F.col("_peak"))).withColumn("_island", F.sum((F.col("_dd") >= 0).cast("int")).over(order))
    since = F.first(F.when(F.col("_dd") < 0, F.col("d")), ignorenulls=True).over(W.partitionBy(*by, "_island").orderBy("d").rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("_days", F.when(F.col("_dd") < 0, F.datediff("d", since)))
    df = df.withColumn("_rn", F.row_number().over(series.orderBy("ret", "d"))).withColumn("_n", F.count("*").over(series))
    r, year = F.col("ret"), F.sqrt(F.lit(periods))
    worst = lambda share: F.avg(F.when(F.col("_rn") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * share)), r))
    down = F.sqrt(F.avg(F.when(r < 0, r * r)))
    figures = [
        F.count("*").alias("days"), (compounded(r) - 1).alias("total"), cagr(r, periods).alias("cagr"), (F.avg(r) * periods).alias("mean"), (F.stddev_samp(r) * year).alias("vol"),
        (F.avg(r) / F.greatest(F.coalesce(F.stddev_samp(r), tiny), tiny) * year).alias("sharpe"), (F.avg(r) / F.greatest(F.coalesce(down, tiny), tiny) * year).alias("sortino"),
        F.min("_dd").alias("max_dd"), F.coalesce(F.max("_days"), F.lit(0)).alias("dd_days"), worst(0.05).alias("cvar95"), worst(0.01).alias("cvar99"),
    ]
    if "bench" in rets.columns:
        over = r - F.col("bench")
        enough = F.count("bench") > 10
        figures += [F.when(enough, F.avg(over) * periods / F.greatest(F.stddev_samp(over) * year, tiny)).otherwise(0.0).alias("ir"), F.when(enough, F.try_divide(F.covar_pop("ret", "bench"), F.stddev_pop(F.when(F.col("bench").isNotNull(), r)) * F.stddev_pop("bench"))).otherwise(0.0).alias("corr")]
    got = df.groupBy(*by).agg(*figures)
    return got.withColumn("calmar", F.col("cagr") / F.greatest(F.abs("max_dd"), tiny))


def cvar(rets: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Mean of the ceil(n alpha) worst returns, one at least."""
    rets = rets.where("ret is not null")
    n = F.count("*").over(W.partitionBy(*by))
    worst = rets.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy("ret", "d"))).withColumn("k", F.greatest(F.lit(1), F.ceil(n * alpha)))
    return worst.where("rn <= k").groupBy(*by).agg(F.avg("ret").alias("cvar"))


def bankroll(bets: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Growth of a bankroll that stakes `f` at profit `x` per unit, bet after bet, and its drawdown: a closed form over logs.

    log_roll is the log of its size, minus infinity after a total loss; logs are summed as decimals, so that no order of adding shows. The drawdown is taken from logs, as many bets may carry `roll` itself past what a double holds.
    """
    o = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    grown = 1 + F.coalesce(F.col("f") * F.col("x"), F.lit(0.0))
    size = F.when(F.max((grown == 0).cast("int")).over(o) == 1, F.lit(float("-inf"))).otherwise(F.sum(F.when(grown != 0, F.log(F.abs(grown))).otherwise(0.0).cast("decimal(24,15)")).over(o).cast("double"))
    sign = F.when(F.sum((grown < 0).cast("int")).over(o) % 2 == 1, -1.0).otherwise(1.0)
    path = bets.withColumn("roll", compounded(F.col("f") * F.col("x"), o)).withColumn("log_roll", size).withColumn("_sign", sign)
    peak = F.greatest(F.lit(0.0), F.max(F.when(F.col("_sign") > 0, F.col("log_roll"))).over(o))
    return path.withColumn("dd", F.col("_sign") * F.exp(F.col("log_roll") - peak) - 1).drop("_sign")
