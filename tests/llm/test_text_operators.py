"""The text operators on odd rows, against brute force, and on held-out rows."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import feistel, fm_quality, line_frequency, line_templates, mil_toxicity, minhash, mixing, packing, queries, simhash
from tidemark.llm.common import components

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h int, row string, size string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon\nshared line of seven plain words here\nown one", "en", "a", 3, 1, "r", "s"),
    (2, "shared line of seven plain words here\nanother text that stands alone today", "en", "a", 3, 1, "r", "s"),
    (2, "shared line of seven plain words here\nanother text that stands alone today", "en", "a", 3, 1, "r", "s"),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, 1, "r", "s"),
    (None, "no id but words enough to be a line", "en", None, 1, 1, "r", "s"),
    (5, LONG, "en", "b", 1, 1, "r", "s"),
    (6, " \t\n  ", "en", "c", 1, 1, "r", "s"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")


def test_operators_keep_odd_rows_and_take_empty_tables(odd, none, labels):
    for docs, n in ((odd, len(ROWS)), (none, 0)):
        assert simhash.near_duplicates(docs).count() == n
        assert mixing.mix(docs).count() == n
        assert line_templates.cut_lines(docs).count() == n
        assert line_frequency.rate(docs).count() == n
        assert feistel.pseudonymise(docs, "k").count() == n
        assert mil_toxicity.score(docs, mil_toxicity.train(docs, labels)).where("score between 0 and 1").count() == n
        assert fm_quality.score(docs, fm_quality.train(docs, labels)).where("score between 0 and 1").count() == n
        packed = packing.pack(docs, with_text=True)
        assert packed.agg(F.sum("length")).first()[0] == (sum(len((r[1] or "").encode().split()) for r in ROWS) if n else None)
        for stage in (line_templates.dedup_lines, mixing.mixed_documents, minhash.one_of_each):
            assert stage(docs).columns == docs.columns
            stage(docs).count()


def test_fingerprints_link_as_brute_force_says(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 40, dtype=np.int64)
    flips = [b ^ np.bitwise_or.reduce(np.int64(1) << rng.choice(63, rng.integers(1, 7), replace=False)) for b in base for _ in range(12)]
    prints = np.unique(np.concatenate([base, np.array(flips)]))
    found = simhash.fingerprint_links(spark.createDataFrame(pd.DataFrame({"fp": prints})))
    roots = {r.node: r.root for r in components(found).collect()}
    want = {int(p): int(p) for p in prints}

    def top(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, p in enumerate(prints):
        for q in prints[i + 1 :][np.bitwise_count((prints[i + 1 :] ^ p).view(np.uint64)) <= 4]:
            a, b = sorted((top(int(p)), top(int(q))))
            want[b] = a
    assert {x: roots.get(x, x) for x in want} == {x: top(x) for x in want}


def test_a_crowded_key_is_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(simhash, "JOINED", 2)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    chain = [(1 << k) - 1 for k in range(0, 60, 3)]
    roots = {r.root for r in components(simhash.fingerprint_links(spark.createDataFrame(pd.DataFrame({"fp": chain})))).collect()}
    assert roots == {0}


def test_nearest_codeword_of_the_code():
    code = simhash._code()
    words = np.random.default_rng(0).integers(0, 1 << 23, 3000)
    own, keys, new = simhash.segment_keys(words, 23, code)
    assert set(new.sum(1)) <= {1, 6}
    for bit in range(0, 23, 5):
        other = words ^ (1 << bit) ^ (1 << ((bit + 7) % 23))
        _, keys2, _ = simhash.segment_keys(other, 23, code)
        assert all(set(a) & set(b) for a, b in zip(keys, keys2))


def test_fingerprint_by_the_plain_rule():
    from xxhash import xxh64_intdigest

    text = "The quick BROWN fox jumps over the lazy dog and the quick brown fox"
    w = text.lower().split()
    hs = [xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(len(w) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text) % (1 << 64) == want and simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("seats", [1, 7, 100, 1001])
def test_apportionment_deals_the_highest_quotients(spark, seats):
    votes = [5000.0, 3100.5, 900.0, 30.0, 0.0, 1.0, 900.0]
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "o": range(len(votes)), "v": votes, "s": seats}))
    got = {r.o: r.quota for r in mixing.apportion(df, ["g"], "v", "s", "o").collect()}
    want: Counter = Counter()
    for _ in range(seats):
        want[max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
    assert got == {i: want[i] for i in range(len(votes))}


def test_mix_meets_targets_and_never_doubles_a_document(spark):
    got = mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet")).toPandas()
    assert (got["taken"] <= 2 * got["size"]).all()
    by = got.groupby("source").agg(t=("target", "first"), k=("taken", "sum"), s=("source_size", "first"))
    assert ((by.t - by.k).abs() <= 4 * mixing.BLOCK).all() and (by.t <= 2 * by.s + 1e-6).all()
    assert abs(by.t.sum() - 1.5 * by.s.sum()) < 1e-3


def test_best_fit_keeps_every_word_once():
    lengths = np.random.default_rng(1).integers(1, 8193, 400)
    bins, sizes = packing.best_fit(lengths)
    used = np.bincount(bins, lengths)
    assert (used <= sizes).all() and set(sizes) <= set(packing.CAPACITIES) and used.sum() / sum(sizes) > 0.9


def test_repeated_words_by_the_plain_rule():
    rng = np.random.default_rng(5)
    for _ in range(60):
        words = [b"%d" % k for k in rng.integers(0, 3, rng.integers(0, 60))]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        many = {g for g, k in Counter(grams).items() if k > 1}
        want = {i + k for i, g in enumerate(grams) if g in many for k in range(5)}
        assert line_frequency.repeated_words(words) == len(want)


def test_a_line_of_many_documents_depletes_those_that_have_little_else(spark):
    own = [" ".join(chr(97 + i % 26) * k + chr(97 + i // 26) for k in range(1, 16)) for i in range(60)]
    docs = [(i, "a common line of some nine words or so\n" + (own[i] if i % 2 else own[i][:8]), "s") for i in range(60)]
    got = line_frequency.rate(spark.createDataFrame(docs, "doc_id long, text string, source string")).toPandas()
    assert got.set_index("doc_id").kept.to_dict() == {i: bool(i % 2) for i in range(60)}


def test_pseudonyms_invert_and_keep_their_format():
    c = feistel.Cipher("secret")
    for kind, value in [("card", "4111 1111 1111 1111"), ("ssn", "123-45-6789"), ("ip", "10.1.200.7"), ("date", "2021-02-28"), ("date", "25/12/2020"), ("date", "03/04/2020"), ("date", "3/4/2020"), ("date", "1.2.2021"), ("date", "12.2.2021"), ("phone", "+1 (243) 555-5526"), ("email", "Ann.b7@mail.example.com"), ("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"), ("iban", "DE89 3704 0044 0532 0130 00")]:
        new = feistel.pseudonym(c, kind, value)
        shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", s)))
        assert new != value and (kind in ("ip", "secret") or shape(new) == shape(value))
        assert feistel.pseudonym(c, kind, new, back=True) == value
        assert feistel._FINDS.fullmatch(value).lastgroup == kind
    assert feistel.luhn(re.sub(r"\D", "", feistel.pseudonym(c, "card", "4111 1111 1111 1111")))
    assert feistel.pseudonym(c, "card", "4111111111111112") is None and feistel.pseudonym(c, "date", "2021-02-30") is None
    short, long = (feistel.pseudonym(c, "date", t) for t in ("3/4/2020", "2020-03-04"))
    assert list(map(int, short.split("/"))) == [int(long.split("-")[k]) for k in (1, 2, 0)]
    text, n = feistel.hide(c, "born 2021-02-28, paid 4111-1111-1111-1111 and 28.02.2021")
    assert n == Counter(date=2, card=1) and text[5:15].split("-") == text[-10:].split(".")[::-1]


def test_models_hold_on_rows_they_have_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    q = queries.op5_fm_quality(spark, sf).where("held_out").toPandas().merge(labels, on="doc_id")
    assert (q.predicted == q.quality).mean() > 0.9
    t = queries.op8_toxicity(spark, sf).where("held_out").toPandas().merge(labels, on="doc_id")
    assert (t.predicted == t.toxic).mean() > 0.9 and t.predicted[t.toxic == 0].sum() <= 1


def test_copies_under_other_ids_are_documents(spark):
    text = "a line of some words that is copied\n" + " ".join(f"w{i}" for i in range(9))
    docs = spark.createDataFrame([(i, text, "s") for i in range(30)] + [(100 + i % 3, text, "t") for i in range(60)], "doc_id long, text string, source string")
    got = line_frequency.rate(docs).groupBy((F.col("doc_id") >= 100).alias("few")).agg(F.sum("n_lines_cut").alias("n")).collect()
    assert {r.few: r.n for r in got} == {False: 60, True: 0}
