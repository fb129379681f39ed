"""Phrases of the index against counting every run of words; scores against exact integers."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import collocations


@pytest.mark.parametrize("seed", range(30))
def test_the_index_counts_every_run_of_words(seed):
    rng = random.Random(seed)
    ids = np.array([rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randrange(0, 200))], np.int64)
    for shortest, depth in ((1, 1), (2, 2), (1, 5), (3, 4)):
        got = {tuple(p): int(c) for said, count in collocations.phrases(ids, shortest, depth) for p, c in zip(said.tolist(), count)}
        runs = [ids[i : i + m].tolist() for m in range(shortest, depth + 1) for i in range(len(ids) - m + 1)]
        assert got == Counter(tuple(r) for r in runs if 0 not in r)


def brute(rows, least, depth, shown):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, depth + 1) for i in range(len(w) - m + 1))
    out = []
    for (lang, *w), a in f.items():
        if a < least or len(w) < 2 or any(g[0] == lang and len(g) > len(w) + 1 and c >= a and any(list(g[i : i + len(w)]) == w for i in range(1, len(g))) for g, c in f.items()):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[(lang, *w[:k])], f[(lang, *w[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    got = []
    for lang in {o[0] for o in out}:
        rows = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:shown]
        got += [(o[0], i, *o[1:]) for i, o in enumerate(rows, 1)]
    return sorted(got)


def _texts(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "Of", "new", "york", "ñu", "a\x00b", "x" + str(rng.randrange(40))])
    gap = lambda: rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n"])
    said = lambda: "".join(word() + gap() for _ in range(rng.randrange(30))) + rng.choice(["", "in New York City today", "once upon a time there was"])
    return [(rng.choice(["en", "en", "de", None, "und"]), rng.choice([None, "", " ", *[said()] * 9])) for _ in range(n)]


@pytest.mark.parametrize("known, shard", [(1_000_000, 2_000_000), (0, 50), (20, 50)])
def test_mined_phrases_are_those_of_plain_counting(spark, monkeypatch, known, shard):
    monkeypatch.setattr(collocations, "KNOWN", known)
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "HELD", shard)
    rows = _texts(known, 200)
    docs = spark.createDataFrame([(*r, "c", 7) for r in rows], "lang string, text string, phrase string, a int").repartition(3)
    for depth, least in ((5, 4), (2, 6)):
        got = sorted(tuple(r) for r in collocations.mined(docs, least, depth, shown=25).collect())
        assert got == brute(rows, least, depth, 25) and len(got) > 20


def test_odd_tables(spark):
    schema = "lang string, text string"
    assert collocations.mined(spark.createDataFrame([], schema)).count() == 0
    assert collocations.mined(spark.createDataFrame([(None, None), ("en", ""), ("en", "one two")], schema)).count() == 0
    long = spark.createDataFrame([("en", "one two three. " * 60_000)], schema)
    assert [tuple(r) for r in collocations.mined(long).collect()] == [("en", 1, "one two three", 60_000, 60_000, 60_000, 180_000, 3000)]


def test_breaks_where_no_known_phrase_is():
    codes = collocations.Codes(None, [b"a b c", b"b c d", b"d e f"])
    word = {v: k for k, v in codes.ids.items()}
    said = lambda text: "".join("|" if k == 0 else word[k].decode() for k in codes.of(text))
    assert said(b"x a b c d e f a b") == "abcd|def|" and said(b"a b. c d") == "" and said(b"a b") == "" and said(b"") == "" and said(b"a b c") == "abc|"
    pairs = collocations.Codes(None, [b"a b", b"b a"])
    assert len(pairs.of(b"a b a b x b a")) == 4 + 1 + 2 + 1 and len(collocations.Codes(None, []).of(b"a b")) == 0


def test_codes_of_phrases_come_back():
    for known, phrases in ((([b"b", b"a", b"c"],), [b"a b", b"b b", b"c a"]), ((None, [b"a b", b"b c", b"c a", b"b b"]), [b"a b c", b"b b b", b"c a b"])):
        codes = collocations.Codes(*known)
        said = np.array([[codes.ids[w] for w in p.split()] for p in phrases])
        assert codes.decoded(codes.coded(said)) == phrases
