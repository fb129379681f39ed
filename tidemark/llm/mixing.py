"""A mix of sources at target weights, in equal blocks of words apportioned by Sainte-Lague.

Each source's target is a number of words. The mix is cut in blocks of BLOCK words; blocks go to
sources, and then to the shards of each source, by the highest quotients votes / (2 seats + 1). A shard is a
stream of documents in a seeded order, and its blocks are taken from the start of that order, round
again where the quota asks for more than the shard has. All of it is DataFrame functions: the quotas come
from a closed form that leaves at most three quotients for each source to be ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, n_words, row_key, saved, text_of

#: Another seed puts a shard's documents in another order, so other blocks are taken.
SEED = 17

#: Weights of the sources in order of their code points, repeating.
WEIGHTS = (3, 1, 2)
#: Size of the mix against all words, and the most often that a source's words are taken.
SHARE = 1.5
REPEATS = 2
BLOCK = 16
#: About so many words (and an eighth as many documents) make a shard.
SHARD = 1 << 20


def apportion(df: DataFrame, by: list[str], votes: str, seats: str, order: str) -> DataFrame:
    """df with `quota`: the group's seats dealt by highest quotients votes / (2 k - 1), ties to the smaller `order`.

    Rounding at a divisor that deals too few seats by up to half the group's rows gives seats that are sure;
    one that deals too many bounds the rest. Only the quotients between the two are ranked.
    """
    group, n, total = W.partitionBy(*by), F.count("*").over(W.partitionBy(*by)), F.sum(votes).over(W.partitionBy(*by))
    at = lambda more: F.when(total > 0, F.greatest(F.lit(0), F.floor(F.col(votes) * (F.col(seats) + more) / total + 0.5))).otherwise(F.lit(0)).cast("long")
    df = df.withColumn("_low", at(-n)).withColumn("_high", at(n)).withColumn("_open", F.col(seats) - F.sum("_low").over(group))
    asked = df.where("_high > _low").select(*by, order, "_open", votes, F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
    rank = F.row_number().over(group.orderBy(F.desc(F.col(votes) / (2 * F.col("_k") - 1)), order))
    more = asked.withColumn("_rank", rank).where("_rank <= _open").groupBy(*by, order).agg(F.count("*").alias("_more"))
    return df.join(more, [*by, order], "left").withColumn("quota", F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_low", "_high", "_open", "_more")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, rank, source_size, weight, target) from (source, source_size): one row a source, in one task.

    The mix's words are shared by weight; a source over REPEATS times its size stops there, and the excess is
    shared again. In order of size over weight the sources that stop come first, so one running sum finds the rate.
    """
    everything = W.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*map(F.lit, WEIGHTS))
    df = sizes.withColumn("rank", rank).withColumn("weight", F.get(weights, (F.col("rank") - 1) % len(WEIGHTS)))
    most = F.col("source_size") * REPEATS
    before = everything.orderBy(most / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    spent, used = (F.coalesce(F.sum(x).over(before), F.lit(0)) for x in (most, F.col("weight")))
    rate = (F.sum("source_size").over(everything) * SHARE - spent) / (F.sum("weight").over(everything) - used)
    df = df.withColumn("_rate", F.when(rate <= most / F.col("weight"), rate))
    rate = F.coalesce(F.max("_rate").over(everything), F.lit(float("inf")))
    return df.withColumn("target", F.least(most.cast("double"), F.col("weight") * rate)).drop("_rate")


def _shard(key: Column, shards: Column) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), shards)


def mix(docs: DataFrame, carry: bool = False, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), and with carry `row`, for each row of docs.

    taken counts the words of the document that the mix takes, repeats included: whole copies, and at a
    shard's end the document's first words. A null or word-free text has size 0 and nothing taken; a null source is
    the last one; equal rows are interchangeable. A mix of no words takes none. An empty table
    gives no rows. Only doc_id, text and source are looked at. The order is that of an md5 of the seed and the row, so reruns agree.
    """
    kept = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    text = text_of()
    rows = docs.select("doc_id", "source", n_words(text).alias("size"), row_key("doc_id", "text", seed=seed).alias("key"), *kept)
    sized = saved(rows.drop("row")) if kept else saved(rows)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goals = targets(sizes).withColumn("seats", F.floor(F.sum("target").over(W.partitionBy(F.lit(0))) / BLOCK + 0.5).cast("long")).withColumn("all", F.lit(0))
    shards = F.ceil((F.col("source_size") + 8 * F.col("n")) / SHARD).cast("long")
    goals = saved(apportion(goals, ["all"], "target", "seats", "rank").select("source", "rank", "source_size", "target", F.col("quota").alias("blocks"), shards.alias("shards")))
    named = goals.select(F.col("source").alias("g_source"), "rank", "source_size", "target", "blocks", "shards")
    dealt = lambda df: df.join(broadcast_if_small(named), F.col("source").eqNullSafe(F.col("g_source"))).withColumn("shard", _shard(F.col("key"), F.col("shards")))
    cells = dealt(sized).groupBy("rank", "shard", "source_size", "target", "blocks").agg(F.sum("size").alias("cell"))
    cells = cells.withColumn("votes", F.col("cell").cast("double"))
    cells = saved(apportion(cells, ["rank"], "votes", "blocks", "shard").select("rank", "shard", "cell", F.least(F.col("quota") * BLOCK, F.col("cell") * REPEATS).alias("take")))
    placed = dealt(rows if kept else sized).join(broadcast_if_small(cells), ["rank", "shard"])
    start = F.coalesce(F.sum("size").over(W.partitionBy("rank", "shard").orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("start", start).withColumn("rounds", F.when(F.col("cell") > 0, F.floor(F.col("take") / F.col("cell"))).otherwise(0).cast("long"))
    rest = F.col("take") - F.col("rounds") * F.col("cell")
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if kept else []))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """documents as the mix takes them: each row as often as it is taken whole, and once more with its first words where it is taken in part.

    A piece has its words set apart by one space. Documents of which no word is taken, nulls and empty texts among them, are
    left out; repeated rows are taken each for itself; an empty table gives no rows.
    """
    got = mix(docs, carry=True).where("taken > 0")
    text = F.col("row.text")
    copies, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    words = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    piece = F.when(rest > 0, F.array(F.array_join(F.slice(words, 1, rest), " "))).otherwise(F.array().cast("array<string>"))
    got = got.select("row", F.explode(F.concat(F.array_repeat(text, copies), piece)).alias("new_text"))
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return got.select([new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
