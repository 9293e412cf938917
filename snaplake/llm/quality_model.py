"""A quality classifier: logistic regression over hashed word n-grams, learnt by follow-the-regularised-leader.

Features of a text are its hashed words, word pairs, and runs of one to three word shapes (which kinds of
characters a word has, whether it repeats the word before it); within each family a feature weighs its
share. The model is one vector of 2**bits weights, so a score is a sparse dot product and the broadcast
model has a fixed size. Only whole texts are read.

It is fitted in one task on at most `sample` labelled rows (4,096 unless said otherwise; the bound is what
keeps fitting from growing with the corpus), chosen by a seeded hash of doc_id among labelled rows outside
the held-out fold, crc32(doc_id as text) mod 3 = 1. The bound holds for the rows of documents too, where an
id stands there many times.

Defined results: a null text counts as empty, and an empty text scores by the bias alone; a null doc_id is
scored and not held out; labels other than 0 and 1, and null ones, are not learnt from; a doc_id labelled
several times is learnt once for each label; equal hashes are ordered by doc_id and label; a very long text is
scanned in segments, whole; without labels the score is 0.5; repeated rows are scored
alike; an empty table gives no rows; other columns are never read, or kept by `keep_good`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied
from .tokens import slices
from .words import Words, features

BITS = 18
SAMPLE = 4096


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Ftrl:
    """Per-coordinate FTRL-proximal."""

    def __init__(self, size: int, alpha: float = 0.6, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * weight * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def sparse(parts: list[np.ndarray], bias: int) -> tuple[np.ndarray, np.ndarray]:
    at, x = [np.array([bias], np.int32)], [np.ones(1)]
    for p in parts:
        if len(p):
            i, n = np.unique(p, return_counts=True)
            at.append(i)
            x.append(n / len(p))
    at, x = np.concatenate(at), np.concatenate(x)
    i, back = np.unique(at, return_inverse=True)
    return i, np.bincount(back, x)


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE, epochs: int = 4, seed: int = 3, column: str = "quality") -> np.ndarray:
    """The weights (float32, 2**bits and the bias)."""
    marked = labels.select("doc_id", F.col(column).cast("int").alias("__y")).filter(F.col("__y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.withColumn("__h", F.xxhash64("doc_id", "__y", F.lit(seed))).orderBy("__h", "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("__text"))
    rows = texts.join(F.broadcast(marked), "doc_id").select("__h", "__text", "__y", "doc_id")
    size = 1 << bits

    def featured(batches):
        for b in batches:
            for h, t, y, d in zip(*b.columns, strict=True):
                at, x = sparse(features(Words([(t.as_py() or "").encode()], True), 0, bits), size)
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (h.as_py(), d.as_py(), y.as_py(), at.astype("<i4").tobytes(), x.astype("<f4").tobytes())], names=["h", "doc_id", "y", "at", "x"])

    def train(batches):
        seen = sorted((h, d, at, x, y) for b in batches for h, d, y, at, x in zip(*[c.to_pylist() for c in b.columns], strict=True))
        model = Ftrl(size)
        share = np.mean([r[4] for r in seen]) if seen else 0.5
        weight = {0: 0.5 / max(1 - share, 1e-9), 1: 0.5 / max(share, 1e-9)}
        for turn in range(epochs):
            for i in np.random.default_rng(seed + turn).permutation(len(seen)):
                _, _, at, x, y = seen[i]
                model.learn(np.frombuffer(at, "<i4"), np.frombuffer(x, "<f4").astype(float), y, weight[y])
        yield pa.RecordBatch.from_pydict({"w": [model.weights(slice(None)).astype("<f4").tobytes()]})

    made = rows.mapInArrow(tidied(featured), "h long, doc_id long, y long, at binary, x binary")
    made = made.orderBy("h", "doc_id", "y", "at", "x").limit(sample)
    one = made.repartition(1).mapInArrow(tidied(train), "w binary").collect()
    return np.frombuffer(one[0].w, "<f4") if one else np.zeros(size + 1, np.float32)


def score_texts(texts: list[bytes], weights: np.ndarray, bits: int) -> list[float]:
    words, out = Words(texts, True), []
    for i in range(len(texts)):
        z = float(weights[-1]) + sum(float(weights[p].mean()) for p in features(words, i, bits) if len(p))
        out.append(1 / (1 + float(np.exp(-np.clip(z, -35, 35)))))
    return out


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """doc_id and score of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for some in slices(batches):
            got = score_texts([t.encode() for _, t in some], model.value, bits)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.int64()), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, bits: int = BITS, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores at least `least`, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    column = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                got = score_texts([str(t.as_py() or "").encode() for t in part.column(column)], model.value, bits)
                yield part.filter(pa.array([g >= least for g in got]))

    return docs.mapInArrow(tidied(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    bits = how.get("bits", BITS)
    out = score(docs, fit(docs, labels, **how), bits)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
