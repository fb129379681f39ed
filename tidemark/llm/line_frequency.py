"""Quality rules with cross-document line frequency.

Beside rules on a text's own words, lines are normalised and hashed, and the distinct documents that hold a line
are counted for each host (the source); copies of a text under other ids are documents. Lines in more than MOST_DOCS documents of a host are
removed from its documents, and a document left with too few of its words is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, n_words, saved, text_of

#: A line in more distinct documents of one host than this is removed. Rows equal in doc_id and text are one document.
MOST_DOCS = 20
#: A document is depleted if more than this per cent of its words stand in removed lines.
MOST_LOST = 70
LEAST_WORDS = 10
MOST_REPEATED = 20
WINDOW = 5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_BLANKS = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that are found twice or more."""
    if len(words) < 2 * WINDOW and len(set(words)) == len(words) or len(words) <= WINDOW:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    n = len(words) - WINDOW + 1
    if len(index) < 1 << 12:  # five numbers of 12 bits make one of 60
        grams = sum(ids[k : n + k] << (12 * k) for k in range(WINDOW))
    else:
        grams = ids[:n]
        for k in range(1, WINDOW):
            _, grams = np.unique(grams * len(index) + ids[k : n + k], return_inverse=True)
    order = np.sort(grams)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, place, count = np.unique(grams, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[place] > 1)
    edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + WINDOW, minlength=len(words) + 1)
    return int((np.cumsum(edge) > 0).sum())


def base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "replace").split()
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _base_rules(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([base(t) for t in batch], columns=BASE)


def normalised(line: Column) -> Column:
    """Lower case, runs of digits as 0, words set apart by one space."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " ")))


def rate(docs: DataFrame) -> DataFrame:
    """(doc_id, the base counts, base_failed, n_lines_cut, kept, text) for each row of docs; text is without the removed lines.

    A null text counts as empty and fails the base rules; a null source is a host of its own. Lines without a
    word are never counted. Equal rows get equal results, and rows equal in doc_id and text count as one document. An
    empty table gives no rows. Only doc_id, source and text are looked at.
    """
    text = text_of()
    rows = docs.select("doc_id", "source", text.alias("text"), F.xxhash64(text).alias("h"))
    lines = rows.select("doc_id", "source", "h", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("words", n_words(F.col("line"))).where("words > 0")
    lines = saved(lines.select("doc_id", "source", "h", "pos", F.xxhash64(normalised(F.col("line"))).alias("line"), "words"))
    frequent = lines.select("source", "line", "doc_id", "h").distinct().groupBy("source", "line").agg(F.count("*").alias("n")).where(F.col("n") > MOST_DOCS)
    frequent = broadcast_if_small(saved(frequent.select(F.col("source").alias("f_source"), F.col("line").alias("f_line"))))
    cut = lines.join(frequent, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("line") == F.col("f_line")))
    cut = cut.groupBy("doc_id", "source", "h").agg(F.collect_set(F.struct("pos", "words")).alias("cut"))
    cut = cut.select(F.col("doc_id").alias("c_id"), F.col("source").alias("c_source"), F.col("h").alias("c_h"), "cut")
    base_rules = F.pandas_udf(_base_rules, "struct<" + ", ".join(f"{c}:long" for c in BASE) + ">")
    rated = rows.select("*", base_rules("text").alias("b"))
    met = rated.join(cut, F.col("doc_id").eqNullSafe(F.col("c_id")) & F.col("source").eqNullSafe(F.col("c_source")) & (F.col("h") == F.col("c_h")), "left")
    lost = F.coalesce(F.aggregate("cut", F.lit(0).cast("long"), lambda s, x: s + x["words"]), F.lit(0))
    failed = (F.col("b.n_words") < LEAST_WORDS) | (100 * F.col("b.n_repeat_words") > MOST_REPEATED * F.col("b.n_words"))
    parts = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("cut.pos"))
    clean = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    return met.select("doc_id", "b.*", failed.alias("base_failed"), F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut")).alias("n_lines_cut"), (~failed & (100 * lost <= MOST_LOST * F.col("b.n_words"))).alias("kept"), clean.alias("text"))
