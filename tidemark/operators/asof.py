"""Joins that see only what was known before the decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(decisions: DataFrame, facts: DataFrame, by: list[str], at: str, released: str, values: list[str]) -> DataFrame:
    """Each decision with the values of the latest fact released strictly before it.

    One union and one window: decisions sort before facts of the same moment, so a tie is not seen. There is no range
    join, and an entity's rows are read once. Facts of one moment are ordered by their values.
    """
    value = F.struct(*values)
    left = decisions.select(*by, F.col(at).alias("_t"), F.lit(0).alias("_kind"), F.struct(*decisions.columns).alias("_row"), F.lit(None).cast(facts.select(value.alias("v")).schema["v"].dataType).alias("_v"))
    right = facts.select(*by, F.col(released).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), value.alias("_v"))
    order = W.partitionBy(*by).orderBy("_t", "_kind", "_v").rowsBetween(W.unboundedPreceding, 0)
    met = left.unionByName(right).withColumn("_v", F.last("_v", ignorenulls=True).over(order)).where("_kind = 0")
    return met.select("_row.*", *[F.col("_v").getField(v).alias(v) for v in values])


def with_lag(series: DataFrame, day: str, days: int, out: str = "released") -> DataFrame:
    """A fixed publication lag."""
    return series.withColumn(out, F.date_add(day, days))


def members_as_of(days: DataFrame, membership: DataFrame, day: str) -> DataFrame:
    """(day, ticker) for members with start <= day < end, an open end being null.

    Intervals are cut by month, so that the join has an equal key and each interval meets only its own months' days.
    """
    ends = F.coalesce("end_date", F.lit("9999-12-31").cast("date"))
    span = days.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    cut = membership.crossJoin(F.broadcast(span))  # one row
    cut = cut.where((F.col("start_date") <= F.col("_hi")) & (ends > F.col("_lo")))
    months = F.sequence(F.trunc(F.greatest("start_date", "_lo"), "month"), F.trunc(F.least(ends, F.col("_hi")), "month"), F.expr("interval 1 month"))
    cut = cut.withColumn("_m", F.explode(months))
    met = days.select(day, F.trunc(day, "month").alias("_m")).join(cut, "_m").where((F.col("start_date") <= F.col(day)) & (F.col(day) < ends))
    return met.select(day, "ticker").distinct()


def as_of_dates(decisions: DataFrame, facts: DataFrame, at: str, released: str, values: list[str]) -> DataFrame:
    """`as_of` for facts that hold for every entity: solved once for each different date and joined to the decisions.

    The one window has a row a date and a row a fact of the series, not a row a decision.
    """
    known = as_of(decisions.select(at).distinct().withColumn("_all", F.lit(0)), facts.withColumn("_all", F.lit(0)), ["_all"], at, released, values)
    return decisions.join(known.drop("_all"), at)


def known_between(facts: DataFrame, by: list[str], end: str = "end", filed: str = "filed") -> DataFrame:
    """facts with `until`, the next filing for the same period: a value is the known one at filed < t <= until (null: from then on).

    Of filings of one day for one period the last in order of value counts; the others are dropped.
    """
    last = facts.withColumn("_n", F.row_number().over(W.partitionBy(*by, end, filed).orderBy(F.desc("val")))).where("_n = 1").drop("_n")
    return last.withColumn("until", F.lead(filed).over(W.partitionBy(*by, end).orderBy(filed)))


def latest_filed(facts: DataFrame, decisions: DataFrame, by: list[str], at: str, within: list[str] = [], end: str = "end") -> DataFrame:  # noqa: B006
    """For each decision and period end, the newest filing known before it: the decision's columns and the filing's.

    `within` names what else tells periods apart. Each filing meets only the decisions at which it is the known one.
    """
    known = known_between(facts, [*by, *within], end)
    met = decisions.join(known, by).where((F.col("filed") < F.col(at)) & (F.col("until").isNull() | (F.col(at) <= F.col("until"))))
    return met.drop("until")
