"""Readers and writers: schemas are given, never inferred; required columns are checked before anything runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINES = "game_id string, date date, home string, away string, home_odds double, away_odds double, book string"
MEMBERSHIP = "ticker string, name string, gics_sector string, gics_subindustry string, start_date date, end_date date, cik string, notes string"
FACT_ENTRY = "start date, end date, val double, filed date, form string, accn string, fy int, fp string"


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table, if it has these columns; else ValueError."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def with_optional(df: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """Required columns checked, optional ones that are absent filled with the empty string."""
    require(df, required)
    return df.withColumns({c: F.lit("") for c in optional if c not in df.columns}) if set(optional) - set(df.columns) else df


def members(spark: SparkSession, path: str) -> DataFrame:
    """Membership intervals; the company number stays a string of ten digits."""
    return read_csv(spark, path, MEMBERSHIP).withColumn("cik", F.lpad("cik", 10, "0"))


def newest_snapshot(snapshots: DataFrame, day: str, at: Column | None = None) -> DataFrame:
    """The rows of the newest snapshot, not after `at` where it is given. The newest day is one row of an aggregate."""
    known = snapshots if at is None else snapshots.where(F.col(day) <= at)
    newest = known.agg(F.max(day).alias(day))
    return known.join(F.broadcast(newest), day)


def company_facts(raw: DataFrame, json: str = "json") -> DataFrame:
    """Nested company facts (taxonomy, concept, unit, entries) to one row an entry; the other columns are kept."""
    concept = f"struct<units: map<string, array<struct<{', '.join(f.replace(' ', ': ', 1) for f in FACT_ENTRY.split(', '))}>>>>"
    parsed = F.from_json(json, f"facts map<string, map<string, {concept}>>")
    kept = [c for c in raw.columns if c != json]
    a = raw.select(*kept, F.explode(parsed["facts"]).alias("taxonomy", "_c"))
    b = a.select(*kept, "taxonomy", F.explode("_c").alias("concept", "_u"))
    c = b.select(*kept, "taxonomy", "concept", F.explode("_u.units").alias("unit", "_e"))
    return c.select(*kept, "taxonomy", "concept", "unit", F.explode("_e").alias("_f")).select(*kept, "taxonomy", "concept", "unit", "_f.*")


def book_odds(raw: DataFrame, json: str = "json", least_vig: float = 0.0, vig_below: float = 0.20) -> DataFrame:
    """Matchup odds ({"odds": {book: {"p1": decimal, "p2": decimal}}}) to one row a book, those with a credible margin."""
    odds = F.from_json(json, "odds map<string, struct<p1: double, p2: double>>")["odds"]
    kept = [c for c in raw.columns if c != json]
    rows = raw.select(*kept, F.explode(odds).alias("book", "_o")).select(*kept, "book", "_o.p1", "_o.p2").withColumn("vig", 1 / F.col("p1") + 1 / F.col("p2") - 1)
    return rows.where((F.col("vig") >= least_vig) & (F.col("vig") < vig_below))


def percent_block(files: DataFrame, columns: list[str], text: str = "value") -> DataFrame:
    """The first data block of each percent file (one text a row): lines that begin with a date, up to the first that does not.

    Dates are YYYYMMDD or YYYYMM (its last day); percents become fractions, -99.99, -999 and cells that are no numbers nulls.
    """
    lines = files.select(F.posexplode(F.split(text, r"\r?\n")).alias("at", "line"), *[c for c in files.columns if c != text])
    by = [c for c in files.columns if c != text] or [F.lit(0)]
    o = W.partitionBy(*by).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    dated = lines.withColumn("_is", F.col("line").rlike(r"^\s*\d{6}(\d{2})?\s*,"))
    block = dated.withColumn("_seen", F.max("_is").over(o)).withColumn("_end", F.max(F.col("_seen") & ~F.col("_is")).over(o)).where("_seen and not _end")
    cells = F.transform(F.split("line", ","), lambda c: F.trim(c))
    day = F.when(F.length(cells[0]) == 8, F.try_to_date(cells[0], "yyyyMMdd")).otherwise(F.last_day(F.try_to_date(F.concat(cells[0], F.lit("01")), "yyyyMMdd")))
    number = lambda i: F.get(cells, i).try_cast("double")
    figure = lambda i: F.when(~number(i).isin(-99.99, -999.0), number(i) / 100)
    return block.select(*[c for c in files.columns if c != text], day.alias("d"), *[figure(F.lit(i + 1)).alias(c) for i, c in enumerate(columns)])


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by `order`, which must end in a row id."""
    o = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(o)).where("_rn = 1").drop("_rn")


def layered(first: DataFrame, then: DataFrame, key: list[str]) -> DataFrame:
    """All rows of the first table, and those of the second for keys that the first has none of."""
    return first.unionByName(then.join(first.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def canonical(copies: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(copy, n, worst, agrees, chosen) of (copy, d, ret): how far each copy is from the longest on shared days; the longest is chosen."""
    sizes = copies.groupBy("copy").agg(F.count("*").alias("n"))
    longest = sizes.orderBy(F.desc("n"), "copy").limit(1).select(F.col("copy").alias("base"))
    base = copies.join(F.broadcast(longest), F.col("copy") == F.col("base")).select("d", F.col("ret").alias("_r"), "base")
    gaps = copies.join(base, "d", "left").groupBy("copy").agg(F.max(F.abs(F.col("ret") - F.col("_r"))).alias("worst"), F.max("base").alias("base"))
    return gaps.join(sizes, "copy").select("copy", "n", "worst", (F.coalesce("worst", F.lit(0.0)) <= tolerance).alias("agrees"), (F.col("copy") == F.col("base")).alias("chosen"))
