"""Toxicity by multiple-instance learning: sentences are scored, only documents are labelled.

A sentence's score is logistic in the words it holds and their beginnings; a document is toxic unless every sentence is clean and
no leak fires (noisy-or): 1 - (1 - leak) * prod(1 - p_s). The leak takes what labels say beyond any sentence,
so their noise does not make common words toxic. Weights, bias and leak are fitted on document labels alone;
the same weights then point to the sentences at fault.

Features are the words most associated with the label over a bounded sample of labelled documents
(``SAMPLE``). Fitting and scoring take whole texts: sentences without such a word all add the same, so they are
only counted. Bags of more than ``IN_DRIVER`` words and sentences stay a table, and tasks sum the slopes.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tenderlake.llm.common import add_columns, cut, find_all, remainder, slices, training_documents

SAMPLE = 20_000
PREFIXES = (4, 5, 6, 7)
CACHE_WORDS = 300_000
IN_DRIVER = 8_000_000
SLICE = 64
WORDS = 1500
FEWEST = 5
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
FOUND = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])


def features(word: str) -> list[str]:
    """A word in small letters, and its beginnings: inflected and compound words share them."""
    word = word.lower()
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def associated_words(training: DataFrame, words: int) -> list[str]:
    """Features whose documents differ most in label from the others, by the log-likelihood ratio."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()

        def rows():
            every = list(seen[0] | seen[1])
            return pa.RecordBatch.from_arrays(
                [pa.array(every, pa.string())] + [pa.array([s[w] for w in every], pa.int64()) for s in seen],
                names=["word", "zeros", "ones"],
            )

        for batch in slices(batches, 0):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {w for part in find_all(WORD, text) for w in set(part)}
                seen[label].update({f for w in own for f in features(w)})
            if len(seen[0]) + len(seen[1]) > 1_000_000:
                yield rows()
                seen = Counter(), Counter()
        yield rows()

    sums = (
        training.select("text", "label")
        .mapInArrow(counts, "word string, zeros long, ones long")
        .groupBy("word")
        .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
        .where(F.col("zeros") + F.col("ones") >= FEWEST)
    )
    totals = training.agg(F.count("*").alias("all"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    toxic, clean = max(totals["toxic"], 1), max(totals["all"] - totals["toxic"], 1)
    part = lambda seen, base: f"if({seen} > 0, {seen} * ln({seen} / ({base})), 0)"
    share = f"(ones + zeros) / {toxic + clean}"
    ratio = " + ".join(
        [
            part("ones", f"{toxic} * {share}"), part("zeros", f"{clean} * {share}"),
            part(f"({toxic} - ones)", f"{toxic} * (1 - {share})"),
            part(f"({clean} - zeros)", f"{clean} * (1 - {share})"),
        ]
    )
    rows = sums.select("word", F.expr(f"round({ratio}, 6)").alias("ratio"))
    return sorted(r["word"] for r in rows.orderBy(F.desc_nulls_last("ratio"), "word").limit(words).collect())


class Weights(dict):
    """Weight of a word: the sum of its features'. Remembers a bounded number of words."""

    def __init__(self, known: dict[str, float]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> float:
        weight = sum(self.known.get(f, 0.0) for f in features(word))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = weight
        return weight


class Model:
    """Weights of features, a sentence's bias, and the leak."""

    def __init__(self, words: list[str], weights: np.ndarray, bias: float, leak: float):
        self.weights = {w: float(x) for w, x in zip(words, weights, strict=True) if abs(x) > 0.02}
        self.bias, self.leak = float(bias), float(leak)

    def sentences(self, text: str, weights: Weights) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of sentences, and (start, end, raw score) of those with a word of the model."""
        count, found = 0, []
        for m in SENTENCE.finditer(text):
            count += 1
            own = [x for w in sorted({*WORD.findall(m.group())}) if (x := weights[w])]
            if own:
                found.append((m.start(), m.end(), self.bias + sum(own)))
        return count, found

    def judge(self, text: str | None, weights: Weights) -> tuple[float, list[dict]]:
        """A text's score, and its sentences that are toxic on their own."""
        count, found = self.sentences(text or "", weights)
        raw = np.array([s for _, _, s in found])
        clean = np.log1p(-self.leak) - np.logaddexp(0, raw).sum() - (count - len(found)) * np.logaddexp(0, self.bias)
        at_fault = [
            {"start": a, "end": b, "score": float(1 / (1 + np.exp(-s)))} for a, b, s in found if s >= 0
        ]
        return float(-np.expm1(clean)), at_fault


def bags_of(training: DataFrame, words: list[str]) -> DataFrame:
    """One row per document, stored: ``plain``, its sentences without any of ``words``, ``count``, the others, and
    which word (``ids``) is in which of those (``owners``)."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(words)}
        for batch in slices(batches, 1):
            plains, counts, ids, owners = [], [], [], []
            for text in batch.column(1).to_pylist():
                plain, count, own, owner = 0, 0, array("i"), array("i")
                for m in SENTENCE.finditer(text):
                    words_here = {*WORD.findall(m.group())}
                    found = sorted(place[f] for w in words_here for f in features(w) if f in place)
                    if not found:
                        plain += 1
                        continue
                    own.extend(found)
                    owner.extend([count] * len(found))
                    count += 1
                plains.append(plain)
                counts.append(count)
                ids.append(np.array(own, np.int32))
                owners.append(np.array(owner, np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(plains, pa.int32()), pa.array(counts, pa.int32()),
                 pa.array(ids, pa.list_(pa.int32())), pa.array(owners, pa.list_(pa.int32()))],
                names=["doc_id", "label", "plain", "count", "ids", "owners"],
            )

    schema = "doc_id long, label int, plain int, count int, ids array<int>, owners array<int>"
    return cut(training.mapInArrow(bags, schema))


def unpacked(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """Word, sentence and document numbers, labels and plain sentences of rows of ``bags_of``."""
    column = lambda name: rows[name].combine_chunks() if isinstance(rows, pa.Table) else rows[name]
    y, counts = (column(name).to_numpy(zero_copy_only=False) for name in ("label", "count"))
    first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    ids, owners = (column(name).flatten().to_numpy(zero_copy_only=False) for name in ("ids", "owners"))
    lengths = column("ids").value_lengths().to_numpy(zero_copy_only=False)
    sentence = owners + np.repeat(first[:-1], lengths)
    plain = column("plain").to_numpy(zero_copy_only=False).astype(np.float64)
    return ids, sentence, np.repeat(np.arange(len(y)), counts), y.astype(np.float64), plain


def fit(documents: DataFrame, labels: DataFrame, *, target: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of labelled documents outside the held-out fold."""
    training = training_documents(documents, labels, target, FOLDS, HELD_OUT, sample)
    words = associated_words(training, WORDS)
    bags = bags_of(training, words)
    entries = F.sum(F.size("ids").cast("long") + F.col("count"))
    count, toxic, size = bags.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), entries).first()
    if not 0 < toxic < count:
        return Model([], np.zeros(0), -20.0, (toxic + 1) / (count + 2))
    if size > IN_DRIVER:
        return Model(words, *descend(lambda theta: slope_in_tasks(theta, bags, count), len(words)))
    *parts, plain = unpacked(bags.toArrow().sort_by("doc_id"))
    return Model(words, *train(*parts, len(words), plain=plain))


def train(
    ids: np.ndarray,
    sentence: np.ndarray,
    document: np.ndarray,
    y: np.ndarray,
    words: int,
    steps: int = 300,
    plain: np.ndarray | None = None,
) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak of the noisy-or that best explain document labels ``y``, by Adam.

    ``ids`` and ``sentence`` list which word is in which sentence, ``document`` which document a sentence
    belongs to, ``plain`` how many more sentences, without words, a document has.
    """
    bags = ids, sentence, document, y, np.zeros(len(y)) if plain is None else plain
    return descend(lambda theta: slope(theta, *bags, len(y)), words, steps)


def slope(
    theta: np.ndarray,
    ids: np.ndarray,
    sentence: np.ndarray,
    document: np.ndarray,
    y: np.ndarray,
    plain: np.ndarray,
    total: int,
) -> np.ndarray:
    """What these documents, of ``total``, add to the slope of the mean loss at ``theta``."""
    bias = theta[-2]
    raw = bias + np.bincount(sentence, theta[ids], minlength=len(document))
    leak = 1 / (1 + np.exp(-theta[-1]))
    clean = np.log1p(-leak) - np.bincount(document, np.logaddexp(0, raw), minlength=len(y))
    clean = np.minimum(clean - plain * np.logaddexp(0, bias), -1e-7)
    odds = np.where(y > 0, np.exp(clean) / -np.expm1(clean), -1.0) / total
    per_sentence = -odds[document] / (1 + np.exp(-raw))
    out = np.empty_like(theta)
    out[:-2] = np.bincount(ids, per_sentence[sentence], minlength=len(theta) - 2)
    out[-2] = per_sentence.sum() - (odds * plain).sum() / (1 + np.exp(-bias))
    out[-1] = -odds.sum() * leak
    return out


def slope_in_tasks(theta: np.ndarray, bags: DataFrame, total: int) -> np.ndarray:
    """The slope over the stored ``bags``, summed in their tasks: one row of each comes to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros_like(theta)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out += slope(theta, *unpacked(batch.slice(at, SLICE)), total)
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], names=["slope"])

    rows = bags.mapInArrow(sums, "slope array<double>").collect()
    return np.sum([r["slope"] for r in rows], axis=0)


def descend(
    slope_at: Callable[[np.ndarray], np.ndarray], words: int, steps: int = 300
) -> tuple[np.ndarray, float, float]:
    """Adam from no weights. An L1 step after each move keeps words at zero that add nothing."""
    theta = np.zeros(words + 2)
    theta[-2], theta[-1] = -5.0, -3.0
    moment, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        slope = slope_at(theta)
        moment = 0.9 * moment + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        rate = 0.1 * min(1.0, 3 * (1 - step / (steps + 1)))
        move = moment / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        theta -= rate * move
        theta[:-2] = np.sign(theta[:-2]) * np.maximum(np.abs(theta[:-2]) - rate * 0.05, 0)
    return theta[:-2], float(theta[-2]), float(1 / (1 + np.exp(-theta[-1])))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the probability that a text is toxic, and ``sentences``: start, end (code points) and
    score of each sentence that is toxic on its own.

    NULL texts count as empty; a text without sentences has the leak as its score. Repeated rows get equal
    scores; an empty table stays empty; existing columns of the new names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def prepare():
        model = shared.value
        weights = Weights(model.weights)

        def judge(texts: list) -> list[list]:
            rows = [model.judge(text, weights) for text in texts]
            return [[score for score, _ in rows], [found for _, found in rows]]

        return judge

    return add_columns(df, text, [StructField(out, DoubleType()), StructField("sentences", ArrayType(FOUND))], prepare)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, ``held_out``, ``score``, ``predicted`` and ``sentences`` of every document."""
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    fold = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select(
        "doc_id", fold.alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences",
    )
