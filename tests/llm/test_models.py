"""The trained models against plain rules: noisy-or, its gradient, offending sentences, pairs of a factorisation machine."""

import math

import numpy as np

from tidemark.llm import fm_quality, mil_toxicity


def test_pairs_by_the_sum_of_squares_are_the_explicit_pairs():
    rng = np.random.default_rng(2)
    model = fm_quality.Model(0.3, rng.normal(size=40), rng.normal(size=(40, 5)) / 4)
    for _ in range(20):
        at, x = rng.permutation(40)[:9], rng.normal(size=9)
        total = 0.3 + sum(model.linear[i] * v for i, v in zip(at, x))
        total += sum(model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j] for i in range(9) for j in range(i))
        assert math.isclose(model.score(at, x), 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_a_document_is_toxic_unless_no_sentence_is():
    model = mil_toxicity.Model(-2.0, {"bad": 3.0, "good": -1.0})
    text = "A good day. bad bad word! 12 ...\nNothing more"
    each = [1 / (1 + math.exp(-z)) for z in (-3.0, 1.0, -2.0)]
    assert math.isclose(model.document(text), 1 - math.prod(1 - p for p in each), rel_tol=1e-9)
    score, worst, top, n = model.judged(text)
    assert math.isclose(score, model.document(text)) and worst == 1 and math.isclose(top, each[1]) and n == 1
    assert model.judged("")[1:] == (None, None, 0) and math.isclose(model.judged("")[0], 1 / (1 + math.exp(2)))


def test_the_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(4)
    y, empty = np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 0.0, 2.0, 3.0])
    sentence_doc, at_sentence, word = np.array([0, 0, 1, 2]), np.array([0, 0, 1, 2, 2, 3]), np.array([0, 1, 2, 1, 2, 0])
    run = lambda t: mil_toxicity.loss_and_slope(t, y, empty, sentence_doc, at_sentence, word, 4, 0.01)
    theta = rng.normal(size=4)
    _, slope = run(theta)
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        assert math.isclose((run(theta + step)[0] - run(theta - step)[0]) / 2e-6, slope[k], abs_tol=1e-6)


def test_offending_sentences_are_located(spark):
    model = mil_toxicity.Model(-2.0, {"bad": 5.0})
    rows = [(1, "fine here. Very bad there! ok"), (1, "fine here. Very bad there! ok"), (2, None), (3, ""), (None, "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS sentence", "2 AS score")
    got = sorted((r.doc_id or 0, r.sentence_no, r.sentence) for r in mil_toxicity.locate(docs, model).collect())
    assert got == [(0, 0, "bad"), (1, 1, "Very bad there"), (1, 1, "Very bad there")]
    scored = {r.doc_id: r for r in mil_toxicity.score(docs, model).collect()}
    assert scored[1].worst_sentence == 1 and scored[1].n_offending == 1 and scored[2].worst_sentence is None
    assert mil_toxicity.locate(docs.limit(0), model).count() == 0


def test_a_sample_has_one_row_for_each_labelled_id(spark):
    from tidemark.llm.common import labelled_sample

    docs = spark.createDataFrame([(k % 4, f"text {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(4)] + [(0, 7), (None, 1)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", 3, 1, 2).collect()
    assert len(got) <= 2 and len({r.doc_id for r in got}) == len(got)
