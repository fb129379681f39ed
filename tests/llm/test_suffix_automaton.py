"""Hits against a search for every window in every document."""

import hashlib
import random
import re

import pytest

from tidemark.llm import suffix_automaton as sa


def _words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items, window):
    words, hit, names = _words(text), set(), set()
    for name, item in items:
        w = _words(item)
        for start in range(max(1, len(w) - window + 1)) if w else ():
            run = w[start : start + window]
            for i in range(len(words) - len(run) + 1):
                if words[i : i + len(run)] == run:
                    hit.update(range(i, i + len(run)))
                    names |= {str(name)} - {"None"}
    return len(words), hit, sorted(names)


def _text(rng, n, kinds):
    return " ".join(rng.choice("abcdefgh"[:kinds]) for _ in range(n))


@pytest.mark.parametrize("seed", range(40))
def test_automaton_hits_what_a_plain_search_hits(seed):
    rng = random.Random(seed)
    kinds, window = rng.choice([2, 3, 6]), rng.choice([1, 2, 3, 5])
    items = [(str(k), _text(rng, rng.randrange(0, 12), kinds)) for k in range(rng.randrange(1, 7))]
    automaton = sa.Automaton([(k, sa.words_of(t.encode())) for k, t in items], window)
    for _ in range(10):
        text = _text(rng, rng.randrange(0, 60), kinds + 1)
        n, hit, names = brute(text, items, window)
        spans, found = automaton.hits(sa.words_of(text.encode()))
        assert {i for s, e in spans for i in range(s, e)} == hit and sorted(found) == names
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


ITEMS = [(1, "One two three, four five six seven eight nine ten eleven twelve"), (1, "short item HERE"), (20, "short item"), (3, ""), (4, None), (5, "ñandú Ñandú é9 x"), (None, "nobody asked this question"), (7, "other " * 12)]


@pytest.mark.parametrize("shard, part", [(200_000, 20_000), (14, 11)])
def test_whole_tables(spark, monkeypatch, shard, part):
    monkeypatch.setattr(sa, "SHARD", shard)
    monkeypatch.setattr(sa, "PART", part)
    texts = ["x one-two THREE four five six seven eight nine ten! y", "one two three four five six seven eight nine", "a short item here and a short item", None, "", "Ñandú ñandú Ñandú é9 x", "so: Nobody asked this question.", "other " * 50, "two three four five six seven eight nine ten eleven twelve one two three four five six seven eight nine ten", "word " * 300_000 + "short item"]
    docs = spark.createDataFrame([(k, t, "c", 1) for k, t in enumerate([*texts, texts[0]])], "doc_id long, text string, item_id string, n_words int")
    items = spark.createDataFrame([(*i, "c") for i in ITEMS], "item_id long, text string, doc_id string")
    got = sorted(tuple(r) for r in sa.rate(docs, items).collect())
    want = []
    for k, t in enumerate([*texts, texts[0]]):
        n, hit, names = (300_002, {300_000, 300_001}, ["20"]) if k == 9 else brute(t, ITEMS, 10)
        want.append((k, n, len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    assert got == want
    assert sa.rate(docs.limit(0), items).count() == 0
    assert sa.rate(docs, items.limit(0)).where("contaminated or n_items > 0").count() == 0


def test_spans_and_documents_are_removed(spark):
    run = "One two three, four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before it all, {'my own words ' * 9}: {run}! And (short item) after.", 9, "a"), (2, f"{run} twelve end", 9, "b"), (3, None, 0, "c")], "doc_id long, text string, n_chars int, row string")
    got = {r.doc_id: r for r in sa.cleaned(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    left = f"Before it all, {'my own words ' * 9}: ! And (short item) after."
    assert got[1].text == left and got[1].n_chars == len(left) and got[1].row == "a"
    assert set(got) == {1, 3} and got[3].text == ""
