"""Toxicity (operator 1): multiple-instance learning over sentences.

A document is a bag of sentences. Each sentence gets a probability from a logistic model over its words and their
prefixes of 4 and 5 letters; the document's score is their noisy-or, 1 - prod(1 - p). Only document labels are
needed to train it, and the sentence probabilities then point at the offending sentences. The model is fitted on a
bounded sample of the training rows (the first ``SAMPLE_ROWS`` by hash of the id, texts up to ``SAMPLE_CHARS``
characters); every document is scored over its whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import Shared, crc_fold, read, text_slices

SAMPLE_ROWS = 6000
SAMPLE_CHARS = 40_000
MAX_FEATURES = 4000
THRESHOLD = 0.7
_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> tuple[str, ...]:
    if len(word) < 5:
        return (word,)
    return (word, word[:4] + "*", word[:5] + "*") if len(word) > 5 else (word, word[:4] + "*")


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def scorer(self):
        return _Weights(self.weights)


class _Weights(dict):
    """Word to weight; words not met yet are looked up by their features and kept, up to a bound."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        w = sum(get(f, 0.0) for f in features_of(word))
        if len(self) > 200_000:
            self.clear()
        self[word] = w
        return w


def sentence_logits(text: str, bias: float, weights: _Weights) -> list[float]:
    get = weights.__getitem__
    return [bias + sum(map(get, words)) for s in _SENTENCE.split(text.lower()) if (words := _WORD.findall(s))]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def noisy_or(logits: list[float]) -> float:
    """1 - prod(1 - sigmoid(z)); 0 without sentences."""
    return float(-np.expm1(-_softplus(np.array(logits)).sum())) if logits else 0.0


def fit(texts: list[str], toxic: list[int], *, max_features: int = MAX_FEATURES, least_z: float = 3.0, rounds: int = 300, rate: float = 0.15, penalty: float = 5e-5) -> Model:
    """Gradient ascent (Adam) on the noisy-or likelihood of the document labels. Without both labels every score is 0 or the base rate."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return Model(bias=-30.0 if not len(y) or y.max() == 0 else 0.0, weights={})
    seen: dict[str, list[int]] = {}
    for text, label in zip(texts, toxic, strict=True):
        for f in {f for w in set(_WORD.findall(text.lower())) for f in features_of(w)}:
            seen.setdefault(f, [0, 0])[label] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    names = [f for f, (_, b) in seen.items() if b >= 3]
    counts = np.array([seen[f] for f in names], float).reshape(-1, 2)
    p1, p0 = (counts[:, 1] + 0.5) / (n1 + 1), (counts[:, 0] + 0.5) / (n0 + 1)
    z = (p1 - p0) / np.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    best = np.argsort(-z, kind="stable")[:max_features]
    best = best[z[best] >= least_z]
    index = {names[k]: i for i, k in enumerate(best)}
    memo: dict[str, list[int]] = {}
    rows, cols, doc = [], [], []
    for d, text in enumerate(texts):
        for sentence in _SENTENCE.split(text.lower()):
            words = set(_WORD.findall(sentence))
            if not words:
                continue
            own = set()
            for w in words:
                if w not in memo:
                    memo[w] = [index[f] for f in features_of(w) if f in index]
                own.update(memo[w])
            rows += [len(doc)] * len(own)
            cols += own
            doc.append(d)
    del seen, memo
    row, col, at = np.array(rows, np.int64), np.array(cols, np.int64), np.array(doc, np.int64)
    w, bias = np.zeros(len(index)), -5.0
    m, v = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    for t in range(1, rounds + 1):
        logit = bias + np.bincount(row, w[col], len(at))
        prob = 1 / (1 + np.exp(-logit))
        none = np.bincount(at, _softplus(logit), len(y))  # -log P(no sentence is toxic)
        pull = np.where(y == 1, 1 / np.maximum(np.expm1(np.minimum(none, 50)), 1e-9), -1.0)  # (1 - P) / P or -1
        g = pull[at] * prob / len(y)
        step = np.append(np.bincount(col, g[row], len(w)) - penalty * w, g.sum())
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step * step
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w + move[:-1], bias + move[-1]
    return Model(bias=float(bias), weights={f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3})


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold (crc32(id as text) mod 3 is 1).

    Labels that are null or neither 0 nor 1, and rows without a text, are left out; an id labelled more than once counts by its highest label.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    own = own.where(crc_fold(F.col("id"), 3) != 1).groupBy("id").agg(F.max("y").alias("y"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(sample_rows)  # bounded: at most sample_rows pairs of numbers
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where(F.length("t") <= sample_chars)
    found = text.join(F.broadcast(own), "id").select("id", "t", "y").collect()
    found.sort(key=lambda r: (str(r["id"]), r["t"]))
    return fit([r["t"] for r in found], [r["y"] for r in found])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_sentences, worst_sentence) of every row: the noisy-or score, and the position of the likeliest offending sentence.

    A null or empty text, or one without letters, has no sentence: score 0, worst_sentence null. Repeated rows are scored each for itself.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = Shared(docs.sparkSession, model)  # at most MAX_FEATURES weights

    def run(batches):
        model = sent.value
        weights = model.scorer()
        for batch in text_slices(batches, 1, 4 << 20):
            scores, count, worst = [], [], []
            for text in batch.column(1).to_pylist():
                z = sentence_logits(text or "", model.bias, weights)
                scores.append(noisy_or(z))
                count.append(len(z))
                worst.append(int(np.argmax(z)) if z else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(count, pa.int64()), pa.array(worst, pa.int64())], names=["id", "score", "n_sentences", "worst_sentence"])

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, score double, n_sentences bigint, worst_sentence bigint")


def offending(text: str, model: Model, threshold: float = 0.5) -> list[tuple[str, float]]:
    """The sentences whose own probability reaches ``threshold``, with it."""
    weights, out = model.scorer(), []
    for s in _SENTENCE.split(text):
        if words := _WORD.findall(s.lower()):
            p = float(1 / (1 + np.exp(-(model.bias + sum(map(weights.__getitem__, words))))))
            if p >= threshold:
                out.append((s.strip(), p))
    return out


def reject_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; columns unchanged. The score is computed row by row where the row lies."""
    sent = Shared(docs.sparkSession, model)

    def keep(batches):
        model = sent.value
        weights = model.scorer()
        at = names.index(text_col)
        for batch in text_slices(batches, at, 4 << 20):
            ok = [noisy_or(sentence_logits(t or "", model.bias, weights)) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(ok, pa.bool_()))

    names = docs.columns
    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    done = score(docs, model)
    return done.select(
        F.col("id").alias("doc_id"), (crc_fold(F.col("id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "worst_sentence",
    )
