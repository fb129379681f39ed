"""One of each group of near copies: texts whose sets of word shingles have a Jaccard similarity of LEAST or more.

Candidates are texts whose SimHash fingerprints differ in four bits or fewer, found by operator 1's Golay keys, and, as most pairs at
0.8 differ in more, texts that share the key of a band: minima under BANDS x ROWS hash functions are cut in bands, and at a
similarity of 0.8 all but one pair in 20,000 share one. Candidates of both kinds are linked only if their shingles themselves, counted
exactly, are similar enough. A key with many texts is first joined up along centres; what is still apart then meets in
pairs, or in blocks whose tasks return spanning forests, so that no pair of a key is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import broadcast_if_small, components, met_by_size, saved, text_of

SIZE = 5
#: The least Jaccard similarity of near copies, in per cent.
LEAST = 80
BANDS = 25
ROWS = 5
#: A key with more texts than this is compared block by block instead of by a join.
JOINED = 64
BLOCK = 512
SEED = 42
#: The hashes of texts that share a key are broadcast up to so many (8 MB), and joined by a shuffle beyond.
SMALL = 1_000_000

_RANDOM = np.random.default_rng(2025)
_XOR = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_FACTOR = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, size: int = SIZE) -> set[bytes]:
    """Runs of so many words of the lower-cased (A-Z) text; a shorter text is one shingle, a word-free text has none."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)}


def close(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the sets' Jaccard similarity is at least LEAST per cent; two empty sets are equal."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < LEAST * large:
        return False
    both = len(a & b)
    return 100 * both >= LEAST * (small + large - both)


def band_keys(found: set[bytes]) -> list[int]:
    """One signed 64-bit key for each band."""
    from xxhash import xxh64_intdigest as digest

    if not found:
        return list(range(BANDS))
    hashes = np.fromiter((digest(s, SEED) for s in found), np.uint64, len(found))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, ((hashes[at : at + 4096] ^ _XOR) * _FACTOR).min(axis=1), out=least)
    return [digest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            found = [shingles(t) for t in part["text"]]
            keys = np.array([band_keys(s) for s in found], np.int64).ravel()
            yield pd.DataFrame({"key": keys, "h": np.repeat(part["h"].to_numpy(), BANDS), "n": np.repeat([len(s) for s in found], BANDS)})


def _close(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        last, left, out = None, set(), []
        for x, y in zip(a, b):
            if x != last:
                last, left = x, shingles(x)
            out.append(close(left, shingles(y)))
        yield pd.Series(out, dtype=bool)


def _near_size(a: Column, b: Column) -> Column:
    """False only where the numbers of shingles alone rule out LEAST."""
    return 100 * F.least(a, b) >= LEAST * F.greatest(a, b)


def spanning_links(names: list[int], sets: list[set[bytes]], roots: list[int]) -> tuple[list[int], list[int]]:
    """Links between texts of different roots that join up whatever any such links join up."""
    tree = {r: r for r in roots}

    def top(r: int) -> int:
        while tree[r] != r:
            tree[r] = r = tree[tree[r]]
        return r

    a, b = [], []
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if 100 * len(sets[i]) < LEAST * len(sets[j]):
                break
            x, y = top(roots[i]), top(roots[j])
            if x != y and close(sets[i], sets[j]):
                tree[x] = y
                a.append(names[i])
                b.append(names[j])
    return a, b


def _block_links(block: pd.DataFrame) -> pd.DataFrame:
    a, b = spanning_links(block["h"].tolist(), [shingles(t) for t in block["text"]], block["root"].tolist())
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _true_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidates (a, b) whose texts are close."""
    text_a, text_b = (texts.select(F.col("h").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    met = pairs.join(text_b.hint("shuffle_hash"), "b").join(text_a.hint("shuffle_hash"), "a")
    return met.where(F.pandas_udf(_close, "boolean")("text_a", "text_b")).select("a", "b")


def golay_candidates(texts: DataFrame) -> DataFrame:
    """(a, b), a < b: candidates by operator 1's fingerprints, here of SIZE words, and their Golay keys.

    Texts of one fingerprint meet the least of them, and the least ones of fingerprints that are linked (4 bits or fewer) each other.
    """
    prints = saved(simhash.fingerprints(texts, "h", "text", SIZE).distinct())
    first = saved(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("m")))
    same = prints.join(met_by_size(first.where("m > 1")), "fp").select(F.col("first").alias("a"), F.col("id").alias("b"))
    sized = met_by_size(first)
    least = lambda c: sized.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    near = simhash.fingerprint_links(first).distinct().join(least("a"), "a").join(least("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return same.unionByName(near).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(texts: DataFrame) -> DataFrame:
    """(a, b): enough links between the texts (h, text) to join up all candidates that are close. h names a text; rows may repeat."""
    golay = saved(golay_candidates(texts))
    keys = saved(texts.mapInPandas(_keyed, "key long, h long, n int").distinct())
    shared = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    keys = saved(keys.join(shared, "key"))
    likely = broadcast_if_small(saved(keys.select("h").unionByName(golay.select(F.explode(F.array("a", "b")).alias("h"))).distinct()), SMALL)
    texts = saved(texts.join(likely, "h").groupBy("h").agg(F.first("text").alias("text")))

    # every text meets the centre of its part of the key, and that the key's centre; other keys have other centres
    mixed = F.struct(F.xxhash64("key", "h").alias("at"), "h", "n")
    part = F.pmod(F.xxhash64("h", "key"), F.ceil(F.col("m") / JOINED)).cast("int")
    centres = keys.groupBy("key", part.alias("part")).agg(F.min(mixed).alias("c"))
    inner = keys.withColumn("part", part).join(centres.hint("merge"), ["key", "part"])
    inner = inner.where(_near_size(F.col("n"), F.col("c.n"))).select(F.col("c.h").alias("a"), F.col("h").alias("b"))
    firsts = centres.groupBy("key").agg(F.min("c").alias("f"))
    outer = centres.join(firsts.hint("merge"), "key").where(_near_size(F.col("c.n"), F.col("f.n"))).select(F.col("f.h").alias("a"), F.col("c.h").alias("b"))
    tried = inner.unionByName(outer).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = saved(tried.unionByName(golay).distinct())
    found = saved(_true_links(tried, texts))

    rooted = keys.join(components(found).withColumnRenamed("node", "h").hint("merge"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    rooted = saved(rooted.join(apart, "key"))
    few = rooted.where(F.col("m") <= JOINED)
    other = few.select("key", *[F.col(c).alias(f"{c}_b") for c in ("h", "n", "root")])
    rest = few.join(other.hint("merge"), "key").where((F.col("h") < F.col("h_b")) & (F.col("root") != F.col("root_b")) & _near_size(F.col("n"), F.col("n_b")))
    rest = rest.select(F.col("h").alias("a"), F.col("h_b").alias("b")).distinct().join(tried.hint("merge"), ["a", "b"], "left_anti")

    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = rooted.where(F.col("m") > JOINED).withColumn("own", F.pmod(F.xxhash64("h"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "h", "root").distinct().join(texts.hint("merge"), "h")
    many = members.groupBy("key", "i", "j").applyInPandas(_block_links, "a long, b long")
    return found.unionByName(_true_links(rest, texts)).unionByName(many)


def groups(docs: DataFrame) -> DataFrame:
    """(h, component_id, first): the group of every text of docs, by its hash.

    component_id is the smallest id, not null, of the group of near copies, and first the one row (doc_id, h) that stands for it:
    that of the smallest id, an id before none. Groups join up over links: a and c are of one group if both are near copies of b.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    distinct = saved(rows.groupBy("h").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(rows.select("h", "text"))).withColumnRenamed("node", "h")
    rooted = distinct.join(roots.hint("merge"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    row = F.struct(F.col("least_id").isNull().alias("unnamed"), F.col("least_id").alias("doc_id"), "h")
    return rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min(row).alias("first")), "root").select("h", "component_id", "first")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for each row of docs; component_id is the smallest id, not null, of the group of near copies.

    Null and word-free texts are copies of each other, texts of five words or fewer only of the same words. Repeated rows come
    back repeated, no rows give no rows.
    """
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("h"))
    return rows.join(groups(docs), "h").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """documents with one row of each group of near copies: the one with the smallest doc_id, a row without an id only if no other has one.

    Rows are told apart by id and text: of two different texts under one id neither hides the other. Of rows equal in both
    one stays. Null and word-free texts are one group. No rows give no rows, other columns come along as they are.
    """
    firsts = groups(docs).select("first").distinct().select(F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_h"))
    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("_doc"), F.xxhash64(text_of()).alias("_text"))
    kept = named.join(firsts, (F.col("_text") == F.col("_h")) & F.col("_doc").eqNullSafe(F.col("_id")))
    if named.groupBy("_text", "_doc").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["_h", "_id"])
    return kept.select([F.col("row").getField(c).alias(c) for c in docs.columns])
