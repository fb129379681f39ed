"""The pipeline's near_dedup stage: whole groups of texts with a five-word Jaccard similarity of 0.8 or more."""

import itertools
import random

import corpus_pipeline

from tidemark.llm import line_templates, minhash, simhash

WORDS = [f"w{i}" for i in range(2000)]


def edited(words, places):
    return " ".join("new" if i in places else w for i, w in enumerate(words))


def test_near_dedup_drops_edited_copies_and_keeps_less_similar_texts(spark):
    words = WORDS[:100]
    texts = [edited(words, ()), edited(words, (50,)), edited(words, (10, 30, 80)), None, " \n ", "one two", "One  two", "one three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(r.doc_id for r in stages["near_dedup"](spark, docs, "").collect()) == [0, 2, 3, 5, 7]
    assert minhash.near_copies(docs.limit(0)).count() == 0


def test_groups_are_those_of_every_pair_however_many_texts_share_a_key(spark, monkeypatch):
    monkeypatch.setattr(minhash, "JOINED", 4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    texts = []
    for family in range(4):
        words = WORDS[family * 200 : family * 200 + 150]
        for k in range(40):
            places = set(rng.sample(range(150), rng.randint(0, 6)))
            texts.append(" ".join(f"x{k}" if i in places else w for i, w in enumerate(words)))
    sets = [minhash.shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if minhash.close(sets[i], sets[j]) and root[i] != root[j]:
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_copies(docs).collect()}
    assert got == dict(enumerate(root))
    assert 4 < len(set(root)) < len(texts)


def test_rows_are_told_apart_by_id_and_text(spark):
    rows = [(1, "one text of its own that stands here alone"), (1, "another text that has nothing to do with it"), (2, "one text of its own that stands here alone"), (2, "one text of its own that stands here alone"),
            (None, "a text without an id that no other row has"), (None, "one text of its own that stands here alone"), (7, None), (8, " ")]
    got = [(r.doc_id, r.text) for r in minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS h")).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[1], rows[4], rows[6]], key=str)


def test_golay_keys_give_candidates_and_their_links_are_kept_without_a_shared_band(spark, monkeypatch):
    long = [f"v{i}" for i in range(1500)]
    texts = [" ".join(long), edited(long, (700,)), " ".join(long).upper(), edited(WORDS, range(0, 2000, 3))]
    rows = spark.createDataFrame(list(enumerate(texts)), "h long, text string")
    found = {(r.a, r.b) for r in minhash.golay_candidates(rows).collect()}
    assert {(0, 2), (0, 1)} <= found and not any(3 in pair for pair in found)

    def no_keys(batches):
        for batch in batches:
            yield batch.head(0).assign(key=0, n=0)[["key", "h", "n"]].astype({"key": "int64", "n": "int32"})

    monkeypatch.setattr(minhash, "_keyed", no_keys)
    docs = rows.withColumnRenamed("h", "doc_id")
    got = {r.doc_id: r.component_id for r in minhash.near_copies(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}


def broadcast_parts(df):
    """What each broadcast of a query's plan is made of, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            yield "\n".join(lines[k:end])


def test_keys_of_fingerprints_are_never_broadcast(spark):
    prints = spark.range(1000).selectExpr("xxhash64(id) AS fp")
    got = simhash.fingerprint_links(prints)
    assert not [part for part in broadcast_parts(got) if "MapInPandas" in part]
    assert got.count() == 0


def test_blocks_of_a_common_key_are_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(minhash, "JOINED", 4)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    texts = [" ".join(f"x{k}" if i == k else w for i, w in enumerate(WORDS[:100])) for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "h long, text string")
    assert not [part for part in broadcast_parts(minhash.links(docs)) if "Generate" in part]


def test_tokens_of_lines_are_never_broadcast(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(line_templates, "saved", lambda df, save=line_templates.saved: [plans.append(df._jdf.queryExecution().executedPlan().toString()), save(df)][1])
    texts = ["\n".join(f"one two three four {a} {b}" for a in "abc") for b in "xyz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    line_templates.recurring(line_templates._lines(docs))
    assert any("SortMergeJoin [slot#" in plan for plan in plans)
