"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

Random indexing gives each word of the vocabulary a fixed sparse vector of a few +1 and -1, and as its
meaning the sum of the fixed vectors of its neighbours: one pass that only adds, so tasks add up their own
texts and Spark adds up the tasks. A document is the mean and spread of its words' vectors, how long it is
and how many of its words differ. A network of two layers in numpy turns that into a score, and a
temperature fitted on rows it did not learn from makes the score a probability.

The vocabulary, the vectors and the network are fitted on a bounded sample of labelled documents (``SAMPLE``);
what reaches the driver is the vocabulary, one vector per word and one per sampled document. Every document
is scored over its whole text. Words outside the vocabulary count by their shape (capitals, digits, ...).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from tenderlake.llm.common import add_columns, find_all, remainder, slices, training_documents

SAMPLE = 12_000
WORDS = 2048
SIZE = 64
ONES = 6
WINDOW = 2
HIDDEN = 32
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
CACHE_WORDS = 100_000
HELD_WORDS = 100_000
TOKEN = re.compile(r"\w+|[^\w\s]+")


def shape(token: str) -> str:
    """The kinds of characters of a token, each run once: ``Word`` is ``<Xx>``, ``A1`` is ``<X9>``."""
    kinds = ("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in token)
    return "<" + "".join(kind for kind, _ in groupby(kinds)) + ">"


class Places(dict):
    """Place of a token in the vocabulary: its own, or its shape's, or -1. Remembers a bounded number."""

    def __init__(self, vocabulary: list[str]):
        super().__init__()
        self.known = {word: i for i, word in enumerate(vocabulary)}

    def __missing__(self, token: str) -> int:
        place = self.known.get(token, -1)
        if place < 0:
            place = self.known.get(shape(token), -1)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[token] = place
        return place


def fixed_vectors(count: int, size: int = SIZE, ones: int = ONES) -> np.ndarray:
    """Sparse vectors of +1 and -1, the same on every machine."""
    draw = np.random.RandomState(17)
    out = np.zeros((count, size), np.int64)
    for row in out:
        row[draw.choice(size, ones, replace=False)] = draw.choice((-1, 1), ones)
    return out


def vocabulary(training: DataFrame, words: int) -> list[str]:
    """The tokens and shapes that occur in most documents of the sample, at most ``words``."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                own = {token for part in find_all(TOKEN, text) for token in part}
                seen.update(own)
                seen.update({shape(token) for token in own})
                if len(seen) > HELD_WORDS:
                    yield pa.RecordBatch.from_pydict({"token": list(seen), "n": list(seen.values())})
                    seen.clear()
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = (
        training.select("text")
        .mapInArrow(counts, "token string, n long")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .orderBy(F.desc("n"), "token")
        .limit(words)
        .collect()
    )
    return sorted(row["token"] for row in rows)


def word_vectors(training: DataFrame, words: list[str]) -> np.ndarray:
    """Vectors of the vocabulary: what stands beside each word in the sample, by random indexing."""
    if not words:
        return np.zeros((0, SIZE))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed, total, places = fixed_vectors(len(words)), np.zeros((len(words), SIZE), np.int64), Places(words)
        # How often word b stands beside word a: a table of the vocabulary's size squared, whatever the texts.
        beside = np.zeros(len(words) * len(words), np.int64)
        some = False
        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                carried = np.zeros(0, np.int64)
                for part in find_all(TOKEN, text):
                    ids = np.fromiter(map(places.__getitem__, part), np.int64, len(part))
                    ids = np.concatenate([carried, ids[ids >= 0]])
                    for step in range(1, WINDOW + 1):
                        # Pairs within what was carried over have been counted.
                        first = max(0, len(carried) - step)
                        a, b = ids[first : len(ids) - step], ids[first + step :]
                        np.add.at(beside, a * len(words) + b, 1)
                        np.add.at(beside, b * len(words) + a, 1)
                    carried = ids[-WINDOW:]
                    some = True
        if some:
            for at in range(0, len(words), 64):
                # Doubles hold these whole numbers exactly.
                total[at : at + 64] = beside.reshape(len(words), -1)[at : at + 64].astype(float) @ fixed.astype(float)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(words))), pa.array(list(total))], names=["word", "v"]
            )

    parts = training.select("text").mapInArrow(add_up, "word long, v array<long>")
    sums = parts.groupBy("word").agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(SIZE)))
    out = np.zeros((len(words), SIZE))
    for row in sums.collect():
        out[row[0]] = row[1:]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[str | None], places: Places, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of each text's words, its length, and its share of different words."""
    out = np.zeros((len(texts), 2 * vectors.shape[1] + 3))
    squares = vectors**2
    for row, text in zip(out, texts, strict=True):
        counts: Counter[int] = Counter()
        total = 0
        for part in find_all(TOKEN, text or ""):
            counts.update(map(places.__getitem__, part))
            total += len(part)
        unknown = counts.pop(-1, 0)
        if counts:
            ids, n = np.fromiter(counts, np.int64), np.fromiter(counts.values(), np.float64)
            share = n / n.sum()
            mean = share @ vectors[ids]
            row[: len(mean)] = mean
            row[len(mean) : 2 * len(mean)] = np.sqrt(np.maximum(share @ squares[ids] - mean**2, 0))
        row[-3:] = np.log1p(total), unknown / max(total, 1), len(counts) / max(total, 1)
    return out


class Network:
    """Two layers on standardised inputs; ``score`` is the probability of label 1 at temperature one over ``scale``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 30):
        draw = np.random.RandomState(5)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        order = draw.permutation(len(x))
        # With fewer than five rows the same ones serve both ends.
        held = order[: len(x) // 5] if len(x) >= 5 else order
        rest = order[len(x) // 5 :]
        z = (x - self.mean) / self.spread
        self.layers = [
            draw.randn(x.shape[1], hidden) / np.sqrt(x.shape[1]), np.zeros(hidden),
            draw.randn(hidden) / np.sqrt(hidden), np.zeros(1),
        ]
        moment = [np.zeros_like(p) for p in self.layers]
        second = [np.zeros_like(p) for p in self.layers]
        best, kept, step = np.inf, [p.copy() for p in self.layers], 0
        for _ in range(epochs):
            for start in range(0, len(rest), 256):
                rows = draw.choice(rest, min(256, len(rest)), replace=False) if start else rest[:256]
                step += 1
                inner = np.tanh(z[rows] @ self.layers[0] + self.layers[1])
                error = (_sigmoid(inner @ self.layers[2] + self.layers[3]) - y[rows]) / len(rows)
                back = np.outer(error, self.layers[2]) * (1 - inner**2)
                slopes = [z[rows].T @ back, back.sum(0), inner.T @ error, error.sum(keepdims=True)]
                for i, slope in enumerate(slopes):
                    slope = slope + 1e-4 * self.layers[i]
                    moment[i] = 0.9 * moment[i] + 0.1 * slope
                    second[i] = 0.999 * second[i] + 0.001 * slope**2
                    rate = 0.003 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.layers[i] = self.layers[i] - rate * moment[i] / (np.sqrt(second[i]) + 1e-8)
            loss = _loss(self._raw(z[held]), y[held])
            if loss < best:
                best, kept = loss, [p.copy() for p in self.layers]
        self.layers = kept
        raw = self._raw(z[held])
        self.scale = min(np.geomspace(0.1, 5, 80), key=lambda s: _loss(s * raw, y[held]))

    def _raw(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        # Row by row, so that a text's score does not depend on the rows beside it.
        raw = np.array([self._raw(row)[0] for row in (x - self.mean) / self.spread])
        return _sigmoid(self.scale * raw)


class Constant:
    """Stands in for a network where the labels teach nothing: no rows, or one label only."""

    def __init__(self, y: np.ndarray):
        self.value = float((y.sum() + 1) / (len(y) + 2))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _loss(raw: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, raw) - y * raw)) if len(y) else np.inf


class Classifier:
    def __init__(self, words: list[str], vectors: np.ndarray, network: Network | Constant):
        self.words, self.vectors, self.network = words, vectors, network


def fit(documents: DataFrame, labels: DataFrame, *, target: str = "quality", sample: int = SAMPLE) -> Classifier:
    """Fit on a bounded sample of labelled documents outside the held-out fold."""
    training = training_documents(documents, labels, target, FOLDS, HELD_OUT, sample)
    words = vocabulary(training, WORDS)
    vectors = word_vectors(training, words)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(words)
        for batch in slices(batches, 1):
            x = pooled(batch.column(1).to_pylist(), places, vectors)
            arrays = [batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "label", "x"])

    # One vector of fixed length per sampled document.
    rows = sorted(training.mapInArrow(features, "doc_id long, label int, x array<double>").collect())
    y = np.array([r["label"] for r in rows], np.float64)
    if not 0 < y.sum() < len(y):
        return Classifier(words, vectors, Constant(y))
    return Classifier(words, vectors, Network(np.array([r["x"] for r in rows]), y))


def score(df: DataFrame, model: Classifier, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: the probability that a text has label 1.

    NULL texts count as empty; an empty text is scored like any other, as a document without words. Repeated
    rows get equal scores; an empty table stays empty; an existing column ``out`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def prepare():
        model = shared.value
        places = Places(model.words)
        return lambda texts: [model.network.score(pooled(texts, places, model.vectors)).tolist()]

    return add_columns(df, text, [StructField(out, DoubleType())], prepare)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, ``held_out``, ``score`` and ``predicted`` of every document. Without an id nothing is held out."""
    model = fit(documents, labels)
    scored = score(documents.select("doc_id", "text"), model)
    fold = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select(
        "doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
