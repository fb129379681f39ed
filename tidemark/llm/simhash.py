"""Near-duplicate documents by SimHash fingerprints and Golay-code fuzzy keys.

A 64-bit fingerprint is cut in segments of 23, 23 and 18 bits. The perfect (23, 12) Golay code maps a
segment to the one codeword within three bits. A segment's keys are the codewords of all words at most
one bit away (one key, or six): segments at most two bits apart have a word halfway between them, so
they share a key. Four differing bits over three segments leave two segments that differ in at most
two bits together, so for some pair of segments one is equal and the other shares a key, or both
differ in one bit: then each one's own codeword is among the other's keys. Each case is one kind of
join key; a join on them finds every link, and the whole fingerprints decide.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, met_by_size, saved, text_of

SEED = 42
SHINGLE = 4
#: What the three segments can prove; a larger distance would need other segments.
MAX_BITS = 4
#: A key with more fingerprints than this is compared block by block instead of by a join.
JOINED = 64
BLOCK = 2048

# The generator polynomial of the binary (23, 12) Golay code, segment offsets and widths.
GENERATOR = 0xC75
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _code() -> tuple[list[np.ndarray], np.ndarray]:
    """Remainders by byte of the word, and the error of each remainder."""
    rests = [np.array([_remainder((b << shift) & 0x7FFFFF) for b in range(256)], np.int64) for shift in (0, 8, 16)]
    errors = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for bits in itertools.combinations(range(23), weight):
            word = sum(1 << b for b in bits)
            errors[_remainder(word)] = word
    return rests, errors


def decode(words: np.ndarray, code: tuple[list[np.ndarray], np.ndarray]) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    (low, mid, high), errors = code
    rest = low[words & 255] ^ mid[words >> 8 & 255] ^ high[words >> 16 & 127]
    return (words ^ errors[rest]) >> 11


def segment_keys(words: np.ndarray, width: int, code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own index of each word; all its keys in a matrix; which of the matrix's cells are not repeats."""
    near = np.stack([words, *(words ^ (1 << b) for b in range(width))], axis=1)
    keys = np.sort(decode(near, code), axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return decode(words, code), keys, new


def fuzzy_keys(prints: np.ndarray, code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) of every join key. Side 2 meets side 2; side 0 meets side 1."""
    u = prints.view(np.uint64)
    words = [(u >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    found = [segment_keys(w, width, code) for w, (_, width) in zip(words, SEGMENTS)]
    out = []
    for p, (x, y) in enumerate(PAIRS):
        for tag, side, fixed, (_, keys, new) in (
            (3 * p, 2, words[x], found[y]),
            (3 * p + 1, 2, words[y], found[x]),
            (3 * p + 2, 0, found[y][0], found[x]),
            (3 * p + 2, 1, found[x][0], found[y]),
        ):
            row, col = np.nonzero(new)
            key = keys[row, col]
            both = (key << 12 | fixed[row]) if side == 0 else (fixed[row] << 12 | key)
            out.append((row, np.int64(tag) << 40 | both, np.full(len(row), side, np.int8)))
    return tuple(np.concatenate(part) for part in zip(*out))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles, as a signed 64-bit number."""
    from xxhash import xxh64_intdigest as digest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= size:
        hashes = np.array([digest(flat, SEED)], np.uint64)
    else:
        gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(flat)]
        hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])), np.uint64, len(words) - size + 1)
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), 1 << 16):
        parts = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(8, dtype=np.int64) * 256
        ones += np.bincount(parts.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (2 * ones.ravel() > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row."""

    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, size) for t in batch], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), simhash(text_of(text_col)).alias("fp"))


def _emit_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    code = _code()
    for batch in batches:
        prints = batch["fp"].to_numpy(np.int64)
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            row, key, side = fuzzy_keys(part, code)
            yield pd.DataFrame({"key": key, "side": side, "fp": part[row]})


def spanning_links(prints: np.ndarray, max_bits: int = MAX_BITS) -> tuple[list[int], list[int]]:
    """Links that join up whatever any links among these fingerprints join up: fewer than there are prints."""
    prints = np.unique(prints)
    waiting, a, b = prints.view(np.uint64), [], []
    while len(waiting):
        reached, waiting = [waiting[0]], waiting[1:]
        while reached and len(waiting):
            at = reached.pop()
            near = np.bitwise_count(waiting ^ at) <= max_bits
            if near.any():
                new = waiting[near]
                a += [int(at.astype(np.int64))] * len(new)
                b += new.view(np.int64).tolist()
                reached += list(new)
                waiting = waiting[~near]
    return a, b


def _block_links(block: pd.DataFrame) -> pd.DataFrame:
    a, b = spanning_links(block["fp"].to_numpy(np.int64))
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b) links between different fingerprints, enough of them to join up every pair within four bits.

    prints has one row for each distinct fp. Keys shared by at most JOINED fingerprints meet in a join
    that keeps only true links. The others are dealt in blocks of about BLOCK, every pair of
    blocks is one task's group, and a group returns a spanning forest, so that nothing is skipped and
    neither memory nor output grows with the square of a key's fingerprints. A fingerprint has some 64 keys, which
    Spark does not count in the size of what Python returns, so the join is a merge by request.
    """
    keys = prints.select("fp").mapInPandas(_emit_keys, "key long, side byte, fp long")
    hot = met_by_size(saved(keys.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > JOINED)))
    cold = keys.join(hot, "key", "left_anti")
    left = cold.where("side <> 1").select("key", F.col("fp").alias("a"))
    right = cold.where("side <> 0").select("key", F.col("fp").alias("b")).hint("merge")
    within = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    close = left.join(right, (left["key"] == right["key"]) & within).select("a", "b")

    members = keys.join(hot, "key").select("key", "m", "fp").distinct()
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    many = members.groupBy("key", "i", "j").applyInPandas(_block_links, "a long, b long")
    return close.unionByName(many)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs.

    Null and word-free texts have fingerprint zero and link with each other like any other. Rows of one
    fingerprint are linked; a text of under four words is one shingle. A null id keeps its row, and
    component_id is the smallest id that is not null (null if there is none). Repeated rows come back
    repeated. No rows give no rows. Other columns are not looked at.
    """
    prints = saved(fingerprints(docs, id_col, text_col))
    distinct = saved(prints.groupBy("fp").agg(F.min("id").alias("least_id")))
    roots = components(fingerprint_links(distinct)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least.hint("merge"), "root").select("fp", "component_id")
    return prints.join(named.hint("merge"), "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
