"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton accepts every run of words of any item. A document's words are streamed through it; the state and its length are
the longest run ending at a word that stands in some item. Where that run has WINDOW words or more, the last WINDOW are hit; an item with
fewer words is hit where it ends as a whole. Hit words next to each other are a span; spans beyond a length, or documents beyond a
coverage, are removed by `cleaned`.

Items are cut into parts of at most PART words that overlap by WINDOW - 1, so that no window is lost, and parts are dealt into shards
of at most SHARD words, counted before one is broadcast. Documents stream through one shard's automaton after the other and are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of

WINDOW = 10
#: Words of the items in one automaton: about 60 MB in a task.
SHARD = 200_000
PART = 20_000
#: Spans of this many words or more are removed by `cleaned`; a document with a greater share of hit words is rejected whole.
MOST_SPAN = 10
MOST_COVERED = 0.5

_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_PLAIN = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text in lower case: runs of ASCII letters, digits and any character beyond ASCII."""
    return text.translate(_PLAIN).split()


class Automaton:
    """All runs of words of the items: state 0 is the empty run; a state's strings end at the same places."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.ids = window, {}
        self.next, self.link, self.size = [{}], [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._grow(last, c)
        self._name(coded)

    def _grow(self, last: int, c: int) -> int:
        """The state of a run with one more word, made where the run is new."""
        known = self.next[last].get(c)
        if known is not None:
            return known if self.size[known] == self.size[last] + 1 else self._split(last, c, known)
        new = self._state({}, -1, self.size[last] + 1)
        while last >= 0 and c not in self.next[last]:
            self.next[last][c] = new
            last = self.link[last]
        if last < 0:
            self.link[new] = 0
        else:
            q = self.next[last][c]
            self.link[new] = q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
        return new

    def _state(self, out: dict, link: int, size: int) -> int:
        self.next.append(out)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, at: int, c: int, q: int) -> int:
        """A state for the strings of q that also end elsewhere."""
        twin = self._state(dict(self.next[q]), self.link[q], self.size[at] + 1)
        self.link[q] = twin
        while at >= 0 and self.next[at].get(c) == q:
            self.next[at][c] = twin
            at = self.link[at]
        return twin

    def _name(self, coded) -> None:
        """For each state the one that holds its last `window` words, the items there, and the short items that end there as a whole."""
        self.whole = [-1] * len(self.size)
        order = np.argsort(self.size, kind="stable")
        for v in order:
            if self.size[v] >= self.window:
                self.whole[v] = int(v) if self.size[self.link[v]] < self.window else self.whole[self.link[v]]
        self.items: dict[int, set] = {}
        own: dict[int, dict[int, set]] = {}
        for name, codes in coded:
            v = 0
            for k, c in enumerate(codes, 1):
                v = self.next[v][c]
                if k >= self.window:
                    self.items.setdefault(self.whole[v], set()).add(name)
            if len(codes) < self.window:
                own.setdefault(v, {}).setdefault(len(codes), set()).add(name)
        self.short: list[tuple] = [()] * len(self.size)
        for v in order[1:]:
            self.short[v] = self.short[self.link[v]] + tuple((k, frozenset(names)) for k, names in own.get(int(v), {}).items())

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(first, after last) of the runs of hit words, in order and apart, and the items that occur."""
        nxt, link, size, whole, short, window = self.next, self.link, self.size, self.whole, self.short, self.window
        spans: list[list[int]] = []
        states: set[int] = set()
        found: set = set()
        v = n = 0
        for i, c in enumerate(map(self.ids.get, words)):
            if c is None:
                v = n = 0
                continue
            to = nxt[v].get(c)
            while to is None and v:
                v = link[v]
                n = size[v]
                to = nxt[v].get(c)
            if to is None:
                n = 0
                continue
            v = to
            n += 1
            if n >= window:
                states.add(whole[v])
                _add(spans, i + 1 - window, i + 1)
            for k, names in short[v]:
                if k <= n:
                    found |= names
                    _add(spans, i + 1 - k, i + 1)
        for s in states:
            found |= self.items[s]
        return [(a, b) for a, b in spans], found


def _add(spans: list[list[int]], start: int, end: int) -> None:
    """One more span that ends last; it joins those that it meets."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append([start, end])


def _merged(a: list, b: list) -> list[tuple[int, int]]:
    spans: list[list[int]] = []
    for s, e in sorted([*a, *b]):
        if spans and spans[-1][1] >= s:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    return [(s, e) for s, e in spans]


def _parts(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """(item, part, n): an item's words in parts that share window - 1 words, joined by a space."""
    for batch in batches:
        rows = []
        for item, text in zip(batch["item"], batch["text"]):
            words = words_of(bytes(text))
            for start in range(0, max(1, len(words) - window + 1), PART - window + 1):
                part = words[start : start + PART]
                rows.append((item, b" ".join(part), len(part)))
        yield pd.DataFrame([r for r in rows if r[2]], columns=["item", "part", "n"])


def shards(items: DataFrame, window: int = WINDOW) -> list[list[tuple[str | None, bytes]]]:
    """The items' parts in as few lists as keep each under SHARD words; each list is one broadcast. Equal parts of one item count once."""
    parts = items.select(F.col("item_id").cast("string").alias("item"), text_of().cast("binary").alias("text")).mapInPandas(lambda b: _parts(b, window), "item string, part binary, n long")
    parts = saved(parts.distinct())
    total = parts.agg(F.sum("n")).first()[0] or 0
    k = -(-total // SHARD)
    dealt = lambda k: parts.withColumn("shard", F.pmod(F.xxhash64("item", "part"), F.lit(k)))
    while k > 1 and dealt(k).groupBy("shard").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > SHARD:
        k *= 2
    return [[(r["item"], bytes(r["part"])) for r in dealt(k).where(F.col("shard") == s).select("item", "part").collect()] for s in range(k)]


_built: dict[str, Automaton] = {}


def _automaton(name: str, shared, window: int) -> Automaton:
    """The automaton of a broadcast list, built once in a worker, which keeps the last only."""
    if name not in _built:
        _built.clear()
        _built[name] = Automaton([(item, part.split(b" ")) for item, part in shared.value], window)
    return _built[name]


def _streamed(batches: Iterator[pd.DataFrame], name: str, shared, window: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        automaton = _automaton(name, shared, window)
        found = []
        for text, spans, items in zip(batch["text"], batch["spans"], batch["items"]):
            words = words_of(bytes(text))
            got, names = automaton.hits(words)
            if len(spans):
                got = _merged([(s["start"], s["end"]) for s in spans], got)
            found.append((len(words), [{"start": s, "end": e} for s, e in got], sorted({*items, *(x for x in names if x is not None)})))
        yield batch.assign(n_words=[f[0] for f in found], spans=[f[1] for f in found], items=[f[2] for f in found])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, text, n_words, spans, items) for each row of docs: spans of hit words as (start, end) by number, end not included, in order.

    items: the item_ids, as strings, sorted, of which a window occurs in the document; a null item_id hits words but is no item. Texts that are null have no
    words, items without a word hit nothing, and without items nothing is hit. `row` is the row as it was. An empty table gives no rows.
    """
    kept = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), text_of().cast("binary").alias("text"))
    at = kept.select("row", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for k, shard in enumerate(shards(items, window) or [[]]):
        shared = docs.sparkSession.sparkContext.broadcast(shard)
        at = (saved(at) if k else at).mapInPandas(lambda b, name=uuid.uuid4().hex, shared=shared: _streamed(b, name, shared, window), at.schema)
    return at


def rate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs; see contamination for odd rows."""
    got = contamination(docs.select("doc_id", "text"), items, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    got = got.select("row.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return got.withColumn("contaminated", F.col("n_hit") > 0)


def without(text: str, spans: list, least: int) -> str:
    """The text without the words, and what stands between them, of spans of `least` words or more."""
    spans = [(s["start"], s["end"]) for s in spans if s["end"] - s["start"] >= least]
    if not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    kept, after = [], 0
    for start, end in spans:
        kept.append(text[after : at[start][0]])
        after = at[end - 1][1]
    return "".join([*kept, text[after:]])


def cleaned(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_span: int = MOST_SPAN, most_covered: float = MOST_COVERED) -> DataFrame:
    """docs without hit spans of most_span words or more, and without documents of which a greater share than most_covered is hit.

    A span's words go with what stands between them; n_chars, where it is there, counts what is left. Rows and odd values as for contamination;
    a null text comes back empty.
    """
    got = contamination(docs, items, window)
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    got = got.where(hit <= most_covered * F.col("n_words"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[without(bytes(t).decode("utf-8", "replace"), s, most_span).encode() if len(s) else t for t, s in zip(batch["text"], batch["spans"])])

    got = got.mapInPandas(cut, got.schema)
    text = F.col("text").cast("string")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return got.select([new.get(c, F.col("row").getField(c) if c != "text" else text).alias(c) for c in docs.columns])
