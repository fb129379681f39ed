"""Quality of a text by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): every pair of
features interacts through low-rank factors, in time linear in the features of a text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, text_of

#: At most so many labelled documents are learned from.
SAMPLE = 8_000
BUCKETS = 1 << 13
RANK = 6
THRESHOLD = 0.7
FOLDS, HELD = 4, 2

_SYMBOLS = re.compile(r"[^\w\s.,;:'\"()!?|\-]")
STATS = ("log_words", "log_chars", "symbols", "bangs", "bars", "capitals", "digits", "distinct", "stutter", "repeated_lines", "word_length", "long_lines", "short_lines", "sentence_ends", "top_word", "copied_window")


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure statistics of a text and its length, each of about unit size; an empty text gives mostly zeros."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    return [
        np.log1p(len(words)) / 4,
        np.log1p(len(text)) / 6,
        min(1.0, 5 * len(_SYMBOLS.findall(text)) / chars),
        min(1.0, 5 * text.count("!") / n),
        min(1.0, 3 * words.count("|") / n),
        sum(map(str.isupper, words)) / n,
        min(1.0, 10 * sum(map(str.isdigit, words)) / n),
        len(counts) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        chars / n / 10,
        float(len(words) > 100 * max(1, len(lines))),
        float(len(words) < 3 * len(lines)),
        min(1.0, 5 * text.count(".") / n),
        max(counts.values(), default=0) / n,
        1 - len(set(windows)) / max(1, len(windows)),
    ]


def features(text: str, buckets: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: the statistics first, then hashed lower-cased words weighted by log counts of unit length."""
    words = text.split()
    counts = Counter(words)
    if len(buckets) > 200_000:
        buckets.clear()
    hashed: Counter = Counter()
    for w, k in counts.items():
        b = buckets.get(w)
        if b is None:
            b = buckets[w] = zlib.crc32(w.lower().encode("utf-8", "replace")) % BUCKETS
        hashed[b] += k
    at = np.fromiter(hashed, np.int64, len(hashed))
    x = np.log1p(np.fromiter(hashed.values(), float, len(hashed)))
    x /= max(1e-9, float(np.sqrt((x * x).sum())))
    return np.concatenate([np.arange(len(STATS)), at + len(STATS)]), np.concatenate([statistics(text, words, counts), x])


@dataclass(frozen=True)
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at]
        total = self.bias + self.linear[at] @ x + 0.5 * (((x @ v) ** 2).sum() - ((x * x) @ (v * v)).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def _fit(y: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], epochs: int = 24, batch: int = 128, rate: float = 0.02, ridge: float = 1e-4, seed: int = 7) -> Model:
    size, rng = len(STATS) + BUCKETS, np.random.default_rng(seed)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    params = {"b": np.array([np.log(share / (1 - share))]), "w": np.zeros(size), "v": rng.normal(0, 0.05, (size, RANK))}
    first, second = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(order), batch):
            chosen = order[start : start + batch]
            at, x = (np.concatenate([rows[i][k] for i in chosen]) for k in (0, 1))
            doc = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
            v = params["v"][at]
            sums = np.stack([np.bincount(doc, x * v[:, f], len(chosen)) for f in range(RANK)], axis=1)
            pair = 0.5 * ((sums**2).sum(1) - np.bincount(doc, x**2 * (v**2).sum(1), len(chosen)))
            total = params["b"][0] + np.bincount(doc, x * params["w"][at], len(chosen)) + pair
            off = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - y[chosen]) / len(chosen)
            pull = off[doc] * x
            used, place = np.unique(at, return_inverse=True)
            by_factor = pull[:, None] * (sums[doc] - x[:, None] * v)
            slopes = {
                "b": (slice(None), np.array([off.sum()])),
                "w": (used, np.bincount(place, pull, len(used)) + ridge * params["w"][used]),
                "v": (used, np.stack([np.bincount(place, by_factor[:, f], len(used)) for f in range(RANK)], axis=1) + ridge * params["v"][used]),
            }
            step += 1
            for k, (where, slope) in slopes.items():
                first[k][where] = 0.9 * first[k][where] + 0.1 * slope
                second[k][where] = 0.999 * second[k][where] + 0.001 * slope**2
                params[k][where] -= rate * (first[k][where] / (1 - 0.9**step)) / (np.sqrt(second[k][where] / (1 - 0.999**step)) + 1e-8)
    return Model(float(params["b"][0]), params["w"], params["v"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents outside the held-out fold.

    Without a labelled document of each kind the model scores every text one half.
    """

    @F.pandas_udf("struct<at:array<int>, x:array<float>>")
    def featured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        buckets: dict[str, int] = {}
        for batch in texts:
            got = [features(t, buckets) for t in batch]
            yield pd.DataFrame({"at": [a.astype(np.int32) for a, _ in got], "x": [x.astype(np.float32) for _, x in got]})

    rows = labelled_sample(docs, labels, label, folds, held, sample)
    got = rows.select("y", "doc_id", featured("text").alias("f")).select("y", "doc_id", "f.*").toPandas().sort_values("doc_id", kind="stable")
    if got["y"].nunique() < 2:
        return Model(0.0, np.zeros(len(STATS) + BUCKETS), np.zeros((len(STATS) + BUCKETS, 1)))
    pairs = [(np.asarray(a, np.int64), np.asarray(x, float)) for a, x in zip(got["at"], got["x"])]
    return _fit(got["y"].to_numpy(float), pairs)


def score(docs: DataFrame, model: Model, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row: whole texts, a null text as the empty one.

    Row by row: ties and repeated rows score alike, an empty table gives no rows, other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear, model.factors))  # of fixed size: (statistics + BUCKETS) x (RANK + 1) numbers

    @F.pandas_udf("double")
    def quality(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets: dict[str, int] = {}
        model = Model(*shared.value)
        for batch in texts:
            yield pd.Series([model.score(*features(t, buckets)) for t in batch], dtype=float)

    scored = docs.select("doc_id", held_out(folds, held).alias("held_out"), quality(text_of()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
