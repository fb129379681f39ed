"""Phrases whose words stand together more often than apart, counted with an FM-index for each shard of texts.

A shard is a run of at most SHARD words of one language in a task. Its words get ids, its texts are laid end to end with breaks between pieces,
and two Burrows-Wheeler transforms, of the sequence and of its reverse, answer for an interval of each which words stand left and
right of all places of a phrase. Starting with the words, every interval is extended by one word up to the depth; an interval's
width is the phrase's count in the shard. Counts are summed across shards.

A phrase reaches LEAST only if its parts do. So words are counted first, then pairs of words that reach it, then threes of such pairs, then longer
phrases of such threes; other words, pairs and threes are breaks. What reaches LEAST is broadcast only up to KNOWN rows; beyond, nothing is
ruled out beforehand and all phrases are shuffled: the result is the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, saved, text_of

LEAST = 100
DEPTH = 5
SHOWN = 2000
#: Words of a shard: about 300 MB in a task.
SHARD = 2_000_000
#: Words, pairs or threes that reach LEAST are broadcast up to so many.
KNOWN = 1_000_000
#: Different words that a task counts before it hands on its counts.
HELD = 500_000

_BREAK = b"\n"
_PLAIN = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """The words of UTF-8 text, A-Z in lower case, with a line feed between pieces; empty tokens say nothing."""
    return text.translate(_PLAIN).replace(_BREAK, b" \n ").split(b" ")


class Index:
    """FM-index of a sequence of ids, 0 a break, with places in order of their next `depth` ids at least.

    Rows are the places sorted by what follows them, `before` the id in front of each. A phrase's rows are an interval; those of the
    phrase with one more id in front start where the id's rows do plus its occurrences among the rows before the interval.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        n = len(ids)
        rank, span = ids, 1
        order = np.arange(n)
        while span < depth:  # the order of places by their next 2 x span ids, and their ranks in it
            after = np.zeros(n, np.int64)
            after[: n - span] = rank[span:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + after
            order = np.argsort(key)
            span *= 2
            if span < depth:
                key = key[order]
                rank = np.empty(n, np.int64)
                rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        if depth == 1:
            order = np.argsort(ids)
        self.before = np.where(order > 0, ids[order - 1], 0)
        self.n = n
        self.places = np.sort(self.before * (n + 1) + np.arange(n))  # rows in order of the id in front, for counting by search
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ids))])

    def step(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Where the rows of a phrase with one more id in front start."""
        found = np.searchsorted(self.places, ids * (self.n + 1) + start)
        return self.first[ids] + found - np.searchsorted(self.places, ids * (self.n + 1))

    def in_front(self, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, id, count, smaller): ids in front of each interval's rows, their rows, and the rows with a smaller id. Breaks are left out."""
        of = np.repeat(np.arange(len(start)), width)
        rows = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(start, width)
        top = int(self.before.max(initial=0)) + 1
        key, count = np.unique(of * top + self.before[rows], return_counts=True)
        of, ids = key // top, key % top
        upto = np.cumsum(count) - count
        smaller = upto - upto[np.searchsorted(of, of)]
        kept = ids > 0
        return of[kept], ids[kept], count[kept], smaller[kept]


def phrases(ids: np.ndarray, shortest: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases, counts) for each length from `shortest` to depth: rows of ids of all runs of the sequence without a break.

    A phrase has an interval in the index and one in the index of the reversed sequence; the words to its right are in front of its
    reversed rows. Phrases are extended to the right and to the left by turns: the interval on the side of the new word moves
    by a step, the other by the rows of smaller words.
    """
    ids = np.concatenate([[0], ids, [0]])  # no word stands at an end
    word, count = np.unique(ids[ids > 0], return_counts=True)
    if not len(word):
        return
    back = Index(ids[::-1], depth)
    forward = Index(ids, depth) if depth > 2 else None
    said, here, there = word[:, None], back.first[word], back.first[word]
    for length in range(1, depth + 1):
        if length >= shortest:
            yield said, count
        if length < depth and length % 2:
            of, nxt, count, smaller = back.in_front(there, count)
            here, there, said = here[of] + smaller, back.step(nxt, there[of]), np.column_stack([said[of], nxt])
        elif length < depth:
            of, nxt, count, smaller = forward.in_front(here, count)
            here, there, said = forward.step(nxt, here[of]), there[of] + smaller, np.column_stack([nxt, said[of]])


def _counted_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, phrase, a) of a task's words, handed on before more than HELD are held."""
    held: dict[str, Counter] = {}

    def counts() -> Iterator[pd.DataFrame]:
        for lang, c in held.items():
            words = [w for w in c if w not in (b"", _BREAK)]
            yield pd.DataFrame({"lang": lang, "phrase": words, "a": [c[w] for w in words]})
        held.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            held.setdefault(lang, Counter()).update(tokens(bytes(text)))
            if sum(map(len, held.values())) > HELD:
                yield from counts()
    yield from counts()


class Codes:
    """Ids of one language's words and, where given, the phrases of two or three words that stay together; other words and phrases are breaks."""

    def __init__(self, words: list[bytes] | None, phrases: list[bytes] | None = None):
        self.open = words is None and phrases is None
        split = [p.split(b" ") for p in phrases or ()]
        self.ids = {w: k for k, w in enumerate(words if words is not None else dict.fromkeys(w for p in split for w in p), 1)}
        self.ids[_BREAK], self.ids[b""] = 0, -1
        self.size = None if phrases is None else max(map(len, split), default=2)
        if self.size is not None:
            coded = np.array([[self.ids[w] for w in p] for p in split], np.int64).reshape(-1, self.size)
            self.known = []  # of each length the sorted codes: the place of all words but the last, and the last
            place = coded[:, 0] if len(coded) else np.zeros(0, np.int64)
            for k in range(1, self.size):
                codes = place * len(self.ids) + coded[:, k]
                self.known.append(np.unique(codes))
                place = np.searchsorted(self.known[-1], codes)

    def _together(self, ids: np.ndarray) -> np.ndarray:
        """Whether a known phrase begins at each place."""
        n = len(ids) - self.size + 1
        place, good = ids[:n], ids[:n] > 0
        for k, known in enumerate(self.known, 1):
            if not len(known):
                return np.zeros(n, bool)
            codes = place * len(self.ids) + ids[k : n + k]
            place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            good &= (known[place] == codes) & (ids[k : n + k] > 0)
        return good

    def of(self, text: bytes) -> np.ndarray:
        said = tokens(text)
        if self.open:  # ids as words come
            ids = np.fromiter((self.ids.setdefault(t, len(self.ids) - 1) for t in said), np.int64, len(said))
        else:
            ids = np.fromiter(map(self.ids.get, said, repeat(0)), np.int64, len(said))
        ids = ids[ids >= 0]
        if self.size is None:
            return ids
        if len(ids) < self.size:
            return ids[:0]
        good = np.flatnonzero(self._together(ids))
        if not len(good):
            return good
        first = np.concatenate([[True], good[1:] != good[:-1] + 1])  # runs of places; a run's words and a break after it
        start, end = good[first], np.concatenate([good[np.flatnonzero(first)[1:] - 1], good[-1:]]) + self.size
        width = end - start + 1
        at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        where = np.repeat(start, width) + at
        return np.where(at < np.repeat(width - 1, width), ids[np.minimum(where, len(ids) - 1)], 0)

    def coded(self, said: np.ndarray) -> np.ndarray:
        """One number for each phrase that is one word longer than what is known: the place of the known phrase it begins with, and its last word."""
        place = said[:, 0]
        for k, known in enumerate(self.known if self.size is not None else (), 1):
            place = np.searchsorted(known, place * len(self.ids) + said[:, k])
        return place * len(self.ids) + said[:, -1]

    def decoded(self, codes: np.ndarray) -> list[bytes]:
        words, parts = self.words(), []
        place = np.asarray(codes, np.int64)
        for known in [None, *reversed(self.known if self.size is not None else ())]:
            place = place if known is None else known[place]
            parts.append(words[place % len(self.ids)].tolist())
            place = place // len(self.ids)
        parts.append(words[place].tolist())
        return [b" ".join(p) for p in zip(*reversed(parts))]

    def words(self) -> np.ndarray:
        out = np.empty(max(self.ids.values()) + 1, object)
        for w, k in self.ids.items():
            out[max(k, 0)] = w
        return out


def _pieces(ids: np.ndarray) -> Iterator[np.ndarray]:
    """A text of more than a shard is cut at breaks."""
    while len(ids) > SHARD and (ids[SHARD:] == 0).any():
        at = SHARD + int(np.argmax(ids[SHARD:] == 0))
        yield ids[:at]
        ids = ids[at:]
    yield ids


def _counted_phrases(batches: Iterator[pd.DataFrame], known, shortest: int, depth: int) -> Iterator[pd.DataFrame]:
    """(lang, phrase, a) of each shard of a task. known: by language its words, or phrases of two or three words if shortest is over 2; None if nothing is known.

    Phrases of two or three words, all whose parts are known, are (lang, code, a); see Codes.coded.
    """
    codes: dict[str, Codes] = {}
    held: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}

    def counts(lang: str) -> Iterator[pd.DataFrame]:
        words = codes[lang].words()
        size.pop(lang)
        for said, count in phrases(np.concatenate(held.pop(lang)), shortest, depth):
            if known is not None and depth <= 3:
                yield pd.DataFrame({"lang": lang, "code": codes[lang].coded(said), "a": count})
                continue
            for at in range(0, len(count), 100_000):
                columns = [words[said[at : at + 100_000, k]].tolist() for k in range(said.shape[1])]
                yield pd.DataFrame({"lang": lang, "phrase": [b" ".join(w) for w in zip(*columns)], "a": count[at : at + 100_000]})

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            if lang not in codes or codes[lang].open and lang not in held:
                codes[lang] = _codes(known, lang, shortest)
            for part in _pieces(codes[lang].of(bytes(text))):
                held.setdefault(lang, []).extend([part, np.zeros(1, np.int64)])
                size[lang] = size.get(lang, 0) + len(part) + 1
                if size[lang] >= SHARD:
                    yield from counts(lang)
    for lang in list(held):
        yield from counts(lang)


def _codes(known, lang: str, shortest: int) -> Codes:
    mine = None if known is None else known.value.get(lang, [])
    return Codes(mine) if shortest <= 2 else Codes(None, mine)


def _named(batches: Iterator[pd.DataFrame], known, shortest: int) -> Iterator[pd.DataFrame]:
    """(lang, phrase, a) of coded phrases."""
    codes: dict[str, Codes] = {}
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            codes[lang] = codes.get(lang) or _codes(known, lang, shortest)
            yield pd.DataFrame({"lang": lang, "phrase": codes[lang].decoded(rows["code"].to_numpy()), "a": rows["a"].to_numpy()})


def _known(found: DataFrame):
    """A broadcast of found (lang, phrase) by language, or None where it has more than KNOWN rows."""
    if found.limit(KNOWN + 1).count() > KNOWN:
        return None
    held: dict[str, list[bytes]] = {}
    for lang, phrase in found.select("lang", F.col("phrase").cast("binary")).collect():
        held.setdefault(lang, []).append(bytes(phrase))
    return found.sparkSession.sparkContext.broadcast(held)


def counted(docs: DataFrame, least: int = LEAST, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and (lang, phrase, m, a): words of each language, and its phrases of m words, one to depth, that stand `least` times or more."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of().cast("binary").alias("text"))
    summed = lambda rows: rows.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    schema = "lang string, phrase binary, a long"
    kept = lambda rows: saved(summed(rows).where(F.col("a") >= least).withColumn("phrase", F.col("phrase").cast("string")))
    words = saved(summed(texts.mapInPandas(_counted_words, schema)))
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    common = words.where(F.col("a") >= least).withColumn("phrase", F.col("phrase").cast("string"))
    length = lambda rows: rows.withColumn("m", F.size(F.split("phrase", " ")))
    found = [common]
    for shortest, longest in ((2, 2), (3, 3), (4, depth)):
        if shortest > depth or longest < shortest:
            break
        known = _known(found[-1])
        counts = lambda b, known=known, shortest=shortest, longest=longest: _counted_phrases(b, known, shortest, longest)
        if known is None or longest > 3:
            found.append(kept(texts.mapInPandas(counts, schema)))
            continue
        codes = texts.mapInPandas(counts, "lang string, code long, a long").groupBy("lang", "code").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
        named = codes.mapInPandas(lambda b, known=known, shortest=shortest: _named(b, known, shortest), schema)
        found.append(saved(named.withColumn("phrase", F.col("phrase").cast("string"))))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return saved(totals), length(rows).select("lang", "phrase", "m", "a")


def _joined(words: str, start: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def mined(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, shown: int = SHOWN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `shown` phrases of highest score.

    The score is floor(1000 a n / (l r)) at the cut of a phrase that gives the least, the first of equals. A phrase that stands in a longer
    one just as often is left out; it is enough to look at phrases one word longer, as those between stand as often too. A null
    language is und; texts that are null or without words add nothing; repeated rows count each; an empty table gives no rows. Only lang and text
    are looked at.
    """
    totals, found = counted(docs, least, depth)
    words = F.split("phrase", " ")
    longer = found.where("m > 2").select("lang", "a", words.alias("w"), "m")
    inner = longer.select("lang", "a", F.explode(F.array(_joined("w", 1, F.col("m") - 1), _joined("w", 2, F.col("m") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    alone = found.where("m > 1").join(inner, ["lang", "phrase"], "left").where("_longer is null or _longer < a")
    cuts = alone.select("lang", "phrase", "a", "m", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined("w", 1, F.col("k")).alias("_left"), _joined("w", F.col("k") + 1, F.col("m") - F.col("k")).alias("_right"))
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    met = cuts.join(part("_left", "l"), ["lang", "_left"]).join(part("_right", "r"), ["lang", "_right"]).join(broadcast_if_small(totals), "lang")
    score = F.expr("(cast(1000 as decimal(4, 0)) * a * n) div (cast(l as decimal(19, 0)) * r)")  # in 38 digits
    best = met.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    rows = best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score").withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = lambda by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = rows.withColumn("_at", first(["lang", "_salt"])).where(F.col("_at") <= shown)  # a language's last window has 64 times `shown` rows at most
    rows = rows.withColumn("rank", first(["lang"]).cast("long")).where(F.col("rank") <= shown)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
