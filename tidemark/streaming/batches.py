"""Streams over the same functions: append without repeats, and daily totals that close behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """A file stream of the parquet files in a folder that match; the schema is that of the files there.

    Times without a zone are taken in the session's zone, as watermarks need instants.
    """
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def without_repeats(rows: DataFrame, key: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; a repeat may come up to `late` after it. State older than that is let go."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def daily_totals(rows: DataFrame, time: str, by: str, value: str, late: str = "1 day") -> DataFrame:
    """Count and sum of each type and day; a day is closed once the watermark has passed its end."""
    got = rows.withWatermark(time, late).groupBy(F.window(time, "1 day"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("window.start").alias("day"), by, "n", "total")


def run_once(rows: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Work off all that is there, append it to a parquet folder, and read that; a restart goes on from the checkpoint."""
    query = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return rows.sparkSession.read.schema(rows.schema).parquet(out)
