"""Toxicity by multiple-instance learning: a document is a bag of sentences.

Each sentence gets a logistic score from its words, and a document's score is the noisy-or of its
sentences: 1 - prod(1 - p). Only documents carry labels; the gradient of the noisy-or shares a document's
label out among its sentences, so the same weights then point to the offending sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, text_of

#: At most so many labelled documents are learned from.
SAMPLE = 20_000
#: At most so many words carry a weight: those whose share differs most between the labels.
VOCABULARY = 2048
THRESHOLD = 0.7
FOLDS, HELD = 3, 1

_LETTERS = re.compile(r"[^\W\d_]+")
_ENDS = re.compile(r"[.!?\n]+")


def features(word: str) -> list[str]:
    """A word and its first four and five letters, so that rare forms share what their stem has shown."""
    return [word] + [word[:n] + "*" for n in (4, 5) if len(word) > n]


def numbered(text: str) -> list[tuple[int, set[str]]]:
    """Number and distinct words of each sentence that has a letter; numbers count every part between sentence ends."""
    return [(i, s) for i, part in enumerate(_ENDS.split(text.lower())) if (s := set(_LETTERS.findall(part)))]


def sentences(text: str) -> list[set[str]]:
    """The distinct words of each sentence that has a letter; one empty sentence where none has."""
    return [s for _, s in numbered(text)] or [set()]


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    seen: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            got = self.seen[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return got

    def sentence(self, words: set[str]) -> float:
        """Logit of one sentence."""
        return self.bias + sum(map(self.word, words))

    def document(self, text: str) -> float:
        """Noisy-or over the sentences."""
        return noisy_or(np.fromiter(map(self.sentence, sentences(text)), float))

    def judged(self, text: str, threshold: float = 0.5) -> tuple[float, int | None, float | None, int]:
        """Score of a document, number and score of its worst sentence (the first of them), and how many are at or above the threshold."""
        parts = numbered(text)
        logits = np.fromiter((self.sentence(s) for _, s in parts), float, len(parts)) if parts else np.array([self.bias])
        worst = int(logits.argmax())
        if not parts:
            return noisy_or(logits), None, None, 0
        return noisy_or(logits), parts[worst][0], float(_sigmoid(logits[worst])), int((_sigmoid(logits) >= threshold).sum())


def noisy_or(logits: np.ndarray) -> float:
    """1 - prod(1 - p) over sentences of these logits."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def loss_and_slope(theta: np.ndarray, y: np.ndarray, empty: np.ndarray, sentence_doc: np.ndarray, at_sentence: np.ndarray, word: np.ndarray, n_sentences: int, ridge: float) -> tuple[float, np.ndarray]:
    """Mean log loss of the noisy-or plus ridge, and its gradient: a document's label is shared out among its sentences.

    theta: the words' weights, then the bias. Sentences without a weighted word are only counted (`empty`).
    """
    s = theta[-1] + np.bincount(at_sentence, theta[word], n_sentences)
    keep = np.bincount(sentence_doc, np.logaddexp(0, s), len(y)) + empty * np.logaddexp(0, theta[-1])
    whole = np.maximum(-np.expm1(-keep), 1e-9)
    loss = (-(y * np.log(whole)) + (1 - y) * keep).mean() + ridge / 2 * (theta[:-1] ** 2).sum()
    share = (1 - y / whole) / len(y)
    by_sentence = share[sentence_doc] * _sigmoid(s)
    slope = np.bincount(word, by_sentence[at_sentence], len(theta) - 1) + ridge * theta[:-1]
    return float(loss), np.append(slope, by_sentence.sum() + (share * empty).sum() * _sigmoid(theta[-1]))


def _vocabulary(sample: DataFrame) -> list[str]:
    """The features whose document frequencies tell the labels apart best, by the z-score of their log odds."""

    @F.pandas_udf("array<string>")
    def distinct_words(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([list({f for w in set(_LETTERS.findall(t.lower())) for f in features(w)}) for t in batch], dtype=object)

    totals = sample.agg(F.sum("y"), F.count("*")).first()
    pos, neg = totals[0] or 0, totals[1] - (totals[0] or 0)
    words = sample.select("y", F.explode(distinct_words("text")).alias("word"))
    counts = words.groupBy("word").agg(F.sum("y").alias("p"), F.count("*").alias("df")).where("df >= 3").withColumn("n", F.col("df") - F.col("p"))
    odds = F.log((F.col("p") + 0.5) / (pos - F.col("p") + 0.5)) - F.log((F.col("n") + 0.5) / (neg - F.col("n") + 0.5))
    ranked = counts.withColumn("z", F.abs(odds / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5)))).where("z >= 2")
    return [r.word for r in ranked.orderBy(F.desc("z"), "word").limit(VOCABULARY).select("word").collect()]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents outside the held-out fold.

    Without a labelled document of each kind the model has no weights and scores every text alike.
    """
    rows = labelled_sample(docs, labels, label, folds, held, sample).persist()
    try:
        words = _vocabulary(rows)
        index = {w: i for i, w in enumerate(words)}

        @F.pandas_udf("struct<empty:int, lengths:array<int>, words:array<int>>")
        def bags(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in texts:
                out = []
                for text in batch:
                    parts = [[index[f] for w in sorted(s) for f in features(w) if f in index] for s in sentences(text)]
                    full = [p for p in parts if p]
                    out.append((len(parts) - len(full), [len(p) for p in full], [w for p in full for w in p]))
                yield pd.DataFrame(out, columns=["empty", "lengths", "words"])

        got = rows.select("y", bags("text").alias("b")).select("y", "b.*").toPandas()
    finally:
        rows.unpersist()
    if got["y"].nunique() < 2:
        return Model(bias=-3.0)
    return _fit(got, words)


def _fit(got: pd.DataFrame, words: list[str], rounds: int = 400, rate: float = 0.05, ridge: float = 2e-4) -> Model:
    y, empty = got["y"].to_numpy(float), got["empty"].to_numpy(float)
    sentence_doc = np.repeat(np.arange(len(got)), [len(x) for x in got["lengths"]])
    lengths = np.concatenate([np.asarray(x, int) for x in got["lengths"]] or [np.zeros(0, int)])
    at_sentence, word = np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.asarray(x, int) for x in got["words"]] or [np.zeros(0, int)])
    theta = np.zeros(len(words) + 1)
    theta[-1] = np.log(max(y.mean(), 1e-3) / max(empty.mean(), 1.0))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        _, slope = loss_and_slope(theta, y, empty, sentence_doc, at_sentence, word, len(lengths), ridge)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(float(theta[-1]), {w: round(float(x), 6) for w, x in zip(words, theta) if abs(x) > 1e-3})


def score(docs: DataFrame, model: Model, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """(doc_id, held_out, score, predicted, worst_sentence, worst_score, n_offending) for every row: whole texts, a null text as the empty one.

    worst_sentence is the number that `locate` gives the sentence of the highest score, null where no sentence has a letter.
    Row by row: ties and repeated rows score alike, an empty table gives no rows, other columns are not looked at.
    """

    @F.pandas_udf("struct<score:double, worst_sentence:int, worst_score:double, n_offending:int>")
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([model.judged(t) for t in batch], columns=["score", "worst_sentence", "worst_score", "n_offending"]).astype({"worst_sentence": "Int32"})

    scored = docs.select("doc_id", held_out(folds, held).alias("held_out"), toxicity(text_of()).alias("t")).select("doc_id", "held_out", "t.*")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_sentence", "worst_score", "n_offending")


def locate(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, sentence_no, sentence, score) of every sentence with a letter at or above the threshold.

    A null or empty text has none; repeated rows have theirs each; an empty table gives no rows; other columns are not looked at.
    """

    @F.pandas_udf("array<struct<sentence_no:int, sentence:string, score:double>>")
    def offending(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for text in batch:
                parts = _ENDS.split(text)
                scored = [(i, float(_sigmoid(model.sentence(words)))) for i, words in numbered(text)]
                out.append([{"sentence_no": i, "sentence": parts[i].strip(), "score": p} for i, p in scored if p >= threshold])
            yield pd.Series(out, dtype=object)

    return docs.select("doc_id", F.inline(offending(text_of())))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents that the model does not mark as toxic, their columns as they were.

    Null and empty texts are judged as the empty text, repeated rows alike; an empty table gives no rows. Without a
    labelled document of each kind nothing is rejected.
    """
    model = train(docs, labels)

    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.document(t) < THRESHOLD for t in batch], dtype=bool)

    return docs.where(clean(text_of()))
