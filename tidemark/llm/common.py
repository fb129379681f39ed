"""Helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the cluster's shared checkpoint folder; a temporary one only where Spark runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"{sc.getCheckpointDir()}/saved"


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder, which outlives any executor and is read by column."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_saved(spark: SparkSession) -> None:
    """Delete all that `saved` has written; DataFrames that still read it can't be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(*columns: str, seed: int) -> Column:
    """128 bits of a seed and a row's columns, nulls included: equal rows share it."""
    packed = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])
    return F.md5(packed)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node reachable.

    Alternates large-star and small-star steps, so that the number of rounds grows with the logarithm
    of the longest path. Each round is written to the shared folder; only a count and a checksum of the
    edges reach the driver. Self loops, repeated edges and an empty table are fine; null ends are dropped.
    """
    sized = lambda df, rows: F.broadcast(df) if rows <= 100_000 else df.hint("merge")
    edges = edges.where("a is not null and b is not null and a <> b")
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        sums = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(sums) == state or not sums[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = tuple(sums)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(sized(least, sums[0]), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sized(least, sums[0]), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = saved(small.select("e.u", "e.v").where("u <> v").distinct())


def held_out(folds: int, held: int, id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text has this remainder. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most limit labelled documents outside the held-out fold, chosen by a hash of the id.

    Labels other than 0 and 1 are left out; of several labels of one id the largest counts, of several texts the first in
    order. The marks are broadcast: there are at most limit of them.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(folds, held))
    marks = marks.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(marks), "doc_id")
    return chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def broadcast_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A saved table, marked for broadcast only where it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def met_by_size(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A saved table, marked for broadcast where it has at most so many rows and for a sort-merge join beyond.

    Spark itself would go by the file's compressed bytes, and for what a Python function or an explode makes by its input's bytes.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")
