"""Quality rules: countable rules, then a hashed n-gram log-likelihood ratio between two multinomials.

The raw multinomial counts the hashed n-grams of all documents, the target one those of all documents
trusted (labelled with quality 1). Both are smoothed vectors of 2**bits buckets. A document's score is the mean
over its n-grams of log(target / raw), so length does not matter; it is kept if no base rule fails and the
score is at least a threshold. The threshold is set by all labelled documents that pass the base rules: a cut
between their classes with the best balanced accuracy (see `best_cut`).

Defined results: a null text has no words; an empty text fails the base rules; a very long text is scanned in
segments, whole; a null doc_id is never trusted; repeated rows count as often as they stand there; a score equal
to the threshold is kept; of cuts that are equally good the middle of the widest run of neighbouring ones
counts, of equally wide runs the lowest; without labels of both kinds the threshold is -1; without trusted ones
the target is the raw corpus and every score is 0 (all that pass the base rules are kept); an empty table gives
no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied, written
from .tokens import slices
from .words import SPACE, Words, features, grams

BITS = 16
SYMBOLS = "#*$%&|<>"
RUN = 5
FILTER_BITS = 20  # a million numbers at most, about 20 MB
_DROP_SPACE = bytes(np.flatnonzero(SPACE).tolist())
_SYMBOL_BYTES = SYMBOLS.encode()
_REST = bytes(i for i in range(256) if i not in _SYMBOL_BYTES)


def repeated_words(h: np.ndarray, run: int = RUN) -> int:
    """Words in runs of `run` words that are found twice or more."""
    g = grams(h, run)
    if len(g) < 2:
        return 0
    _, back, n = np.unique(g, return_inverse=True, return_counts=True)
    twice = n[back] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + run, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            n += line in seen
            seen.add(line)
    return n


def base(text: str, raw: bytes, h: np.ndarray) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    spaces = len(raw) - len(raw.translate(None, _DROP_SPACE))
    n, again = len(h), repeated_words(h)
    return n, len(text) - spaces, len(raw.translate(None, _REST)), repeated_lines(text), again, n < 10 or 100 * again > 20 * n


def _counts(texts: DataFrame, bits: int) -> np.ndarray:
    """Counts of hashed n-grams of texts (__id, __text). A task sends one sum a bucket."""

    def run(batches):
        n = np.zeros(1 << bits, np.int64)
        for some in slices(batches):
            words = Words([t.encode() for _, t in some], True)
            parts = [p for i in range(len(some)) for p in features(words, i, bits)]
            if parts:
                n += np.bincount(np.concatenate(parts), minlength=1 << bits)
        at = np.flatnonzero(n)
        for i in range(0, len(at), 10_000):
            a = at[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n[a])], names=["at", "n"])

    summed = texts.mapInArrow(tidied(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits)
    out[summed["at"]] = summed["n"]
    return out


def count_ngrams(docs: DataFrame, trusted: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(target, raw) counts of hashed n-grams, over all documents. Raw counts move no text.

    Trusted texts meet their ids in a shuffle. Before it, texts go whose id falls in none of the trusted ids' buckets: at most
    2**FILTER_BITS numbers are broadcast, however many ids there are, and what passes by chance goes in the join.
    """
    rows = docs.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("__text"))
    ids = trusted.select(F.col("doc_id").alias("__id")).filter("__id is not null").distinct()
    bucket = F.pmod(F.xxhash64(F.col("__id").cast("long")), F.lit(1 << FILTER_BITS)).alias("__bucket")
    buckets = F.broadcast(ids.select(bucket).distinct())
    mine = rows.withColumn("__bucket", bucket).join(buckets, "__bucket", "left_semi")
    # a merge join at every size: a plan that broadcasts small label tables would behave otherwise on large ones
    mine = mine.join(ids.hint("merge"), "__id", "left_semi").select("__id", "__text")
    return _counts(mine, bits), _counts(rows, bits)


def ratios(target: np.ndarray, raw: np.ndarray, smooth: float = 0.5, prior: float = 0.2) -> np.ndarray:
    """log(target / raw) by bucket. The target has `prior` pseudo-counts a bucket, shared out as the raw corpus is, so rare buckets say little."""
    if not target.sum():
        return np.zeros(len(raw), np.float32)
    share = (raw + smooth) / (raw + smooth).sum()
    extra = prior * len(raw)
    inside = (target + extra * share) / (target.sum() + extra)
    return np.log(inside / share).astype(np.float32)


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double"


def measure(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """The base columns and the score of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for some in slices(batches):
            raws = [t.encode() for _, t in some]
            words, rows = Words(raws, True), []
            for i, (d, t) in enumerate(some):
                parts = features(words, i, bits)
                n = sum(map(len, parts))
                llr = float(sum(model.value[p].sum(dtype=float) for p in parts)) / n if n else 0.0
                rows.append((d, *base(t, raws[i], words.hashes[words.from_[i] : words.to[i]]), llr))
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), COLUMNS)


def best_cut(bad: np.ndarray, good: np.ndarray) -> int:
    """The number of bins below the best cut, from histograms of both classes: the share of bad ones below it and that of good ones not below it add up to the most.

    Of the best cuts, neighbours without a score between them form runs; the middle of the widest run, rounded down, is taken,
    of equally wide ones the lowest.
    """
    below = np.concatenate([[[0], [0]], np.cumsum([bad, good], axis=1)], axis=1).astype(object)
    # in whole numbers: both shares times both totals
    right = below[0] * int(good.sum()) - below[1] * int(bad.sum())
    edges = np.flatnonzero(np.diff((right == max(right)).astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    first, end = max(edges.tolist(), key=lambda e: (e[1] - e[0], -e[0]))
    return (first + end - 1) // 2


def threshold(scored: DataFrame, labels: DataFrame, bins: int = 4096, low: float = -4.0, high: float = 4.0) -> float:
    """The best cut between the classes of all labelled documents: a histogram of fixed size, whatever their number."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("__y")).filter("__y in (0, 1) and doc_id is not null")
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("score") - low) / (high - low) * bins)))
    found = scored.filter("not base_failed").join(marked, "doc_id").groupBy(at.cast("int").alias("__at"), "__y").count().collect()
    n = np.zeros((2, bins), np.int64)
    for r in found:
        n[r["__y"], r["__at"]] = r["count"]
    if not n[0].sum() or not n[1].sum():
        return -1.0
    return low + best_cut(n[0], n[1]) * (high - low) / bins


def judge(docs: DataFrame, labels: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, n_words, the base columns, base_failed, kept, score."""
    target, raw = count_ngrams(docs, labels.filter("quality = 1"), bits)
    scored = written(measure(docs, ratios(target, raw), bits), "quality-scores")
    least = threshold(scored, labels)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
