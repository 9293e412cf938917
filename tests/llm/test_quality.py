import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from snaplake.llm import quality_model, quality_rules
from snaplake.llm.queries import QUERIES
from snaplake.llm.words import SEGMENT, Words, features, grams

SF = "/root/testdata/sf0.01"
KIND = "doc_id long, text string"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(runs)
    again = {i + k for i, r in enumerate(runs) if n[r] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again), failed


TEXTS = [None, "", " \n\n", "one", "a b c d e f g h i j", "a b c d e a b c d e a b c d e", "x\nx\n x\nx", "é ñ　日 本 語 # | <b> 1 2 3 4", "a " * 5000, "l1 l1\n\t\nl1 l1\nl2\n\n", "tab\tsep\x0bv\x0cf\rr end 6 7 8 9 10 11"]


def test_base_rules(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], KIND)
    got = {r.doc_id: r[1:7] for r in quality_rules.measure(df, np.zeros(1 << quality_rules.BITS, np.float32)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_op4(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, SF).collect()}
    assert set(got) == set(docs)
    assert all(tuple(r[1:7]) == brute(docs[d]) for d, r in got.items())
    assert not any(r.kept and r.base_failed for r in got.values())
    judged = [(got[d].kept, q) for d, q in labels.items() if not got[d].base_failed]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.98


def cut_by_trying(bad, good):
    """The middle of the first widest run of best cuts, each cut tried."""
    n = len(bad)
    right = [sum(bad[:c]) * sum(good) + sum(good[c:]) * sum(bad) for c in range(n + 1)]
    runs, c = [], 0
    while c <= n:
        e = c
        while e <= n and right[e] == max(right):
            e += 1
        if e > c:
            runs.append((c, e - 1))
        c = e + 1
    widest = max(b - a for a, b in runs)
    a, b = next(r for r in runs if r[1] - r[0] == widest)
    return (a + b) // 2


def test_cuts():
    bad, good = np.zeros(50, int), np.zeros(50, int)
    bad[[10, 30]], good[[20, 40]] = 1, 1
    assert quality_rules.best_cut(bad, good) == 15 == cut_by_trying(bad, good)  # plateaus 11 to 20 and 31 to 40: the first
    rng = np.random.default_rng(4)
    for _ in range(300):
        bad, good = (rng.integers(0, 3, 12) * rng.integers(0, 2, 12) for _ in range(2))
        bad[rng.integers(12)] += 1
        good[rng.integers(12)] += 1
        assert quality_rules.best_cut(bad, good) == cut_by_trying(bad.tolist(), good.tolist())
    big = np.full(3, 4 * 10**18 // 1000)
    assert quality_rules.best_cut(big * [1, 0, 0], big * [0, 0, 1]) in (1, 2)


def test_op4_score_and_verdict_by_counting(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = {d: [int(x) for p in features(Words([(t or "").encode()], True), 0, quality_rules.BITS) for x in p] for d, t in docs.items()}
    raw, target = collections.Counter(), collections.Counter()
    for d, f in found.items():
        raw.update(f)
        if labels.get(d) == 1:
            target.update(f)
    size = 1 << quality_rules.BITS
    all_raw, all_target, extra = sum(raw.values()) + 0.5 * size, sum(target.values()), 0.2 * size

    def ratio(x):
        share = (raw[x] + 0.5) / all_raw
        return np.log((target[x] + extra * share) / (all_target + extra) / share)

    score = {d: float(np.mean([ratio(x) for x in f])) if f else 0.0 for d, f in found.items()}
    got = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, sf).collect()}
    assert set(got) == set(docs) and all(abs(got[d].score - s) < 1e-5 for d, s in score.items())
    bins = {0: [0] * 4096, 1: [0] * 4096}
    for d, q in labels.items():
        if d in got and not got[d].base_failed:
            bins[q][min(4095, max(0, int((got[d].score + 4) // (8 / 4096))))] += 1
    least = cut_by_trying(bins[0], bins[1]) * 8 / 4096 - 4
    assert all(r.kept == (not r.base_failed and r.score >= least) for r in got.values())
    assert sum(r.kept for r in got.values()) > 20


def test_op3_by_hand(spark):
    """The weights from a plain dictionary per coordinate, and each score as a sum over the text's features."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    order = {(r.doc_id, r.quality): r.h for r in labels.select("doc_id", "quality", F.xxhash64("doc_id", F.col("quality").cast("int"), F.lit(3)).alias("h")).collect()}
    learnt = sorted((h, d, q) for (d, q), h in order.items() if d in text and zlib.crc32(str(d).encode()) % 3 != 1)
    bias, size = 1 << quality_model.BITS, 1 << quality_model.BITS

    def sparse(t):
        x = collections.defaultdict(float, {bias: 1.0})
        for p in features(Words([t.encode()], True), 0, quality_model.BITS):
            for i in p.tolist():
                x[i] += 1 / len(p)
        return x

    z, n = collections.defaultdict(float), collections.defaultdict(float)
    alpha, beta, l1, l2 = 0.6, 1.0, 1e-4, 1e-3

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else (np.sign(z[i]) * l1 - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)

    share = np.mean([q for _, _, q in learnt])
    rows = [({i: float(np.float32(v)) for i, v in sparse(text[d]).items()}, q) for _, d, q in learnt]
    for turn in range(4):
        for k in np.random.default_rng(3 + turn).permutation(len(rows)):
            x, y = rows[k]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v * (0.5 / share if y else 0.5 / (1 - share))
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    got = {r.doc_id: r.score for r in QUERIES["op3_quality_model"](spark, sf).collect()}
    assert set(got) == set(text)
    for d, t in text.items():
        assert abs(got[d] - 1 / (1 + np.exp(-sum(weight(i) * v for i, v in sparse(t).items())))) < 1e-3


def test_the_bound_holds_for_rows(spark):
    docs = spark.createDataFrame([(1, "good words here")] * 50 + [(2, "# # #")], KIND)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    w = quality_model.fit(docs, labels, sample=4)
    assert len(w) == (1 << quality_model.BITS) + 1 and np.isfinite(w).all()


def test_op3_on_the_held_out_fold(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op3_quality_model"](spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    for q in (0, 1):
        mine = [r.predicted for d, r in got.items() if r.held_out and labels.get(d) == q]
        assert len(mine) > 10 and np.mean([p == q for p in mine]) > 0.95


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").toPandas()
    a = quality_model.fit(docs, spark.createDataFrame(labels))
    out = labels.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)
    labels.loc[out, "quality"] = 1 - labels.loc[out, "quality"]
    assert np.array_equal(a, quality_model.fit(docs, spark.createDataFrame(labels)))


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good words here and there", "s", 1), (2, "$$$ ### $$$", "s", 0), (3, None, None, 5), (None, "x", "s", 7), (4, "", "", 0), (1, "good words here and there", "s", 1)], "doc_id long, text string, score string, quality int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (3, None, 1), (None, 1, 0), (9, 7, 0)], "doc_id long, quality int, toxic int")
    for marked in (labels, labels.limit(0)):
        got = quality_model.classify(docs, marked).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert {r.held_out for r in got if r.doc_id is None} == {False}
        rules = quality_rules.judge(docs, marked).collect()
        assert len(rules) == 6 and all(r.base_failed and not r.kept for r in rules)
        kept = quality_model.keep_good(docs, quality_model.fit(docs, marked))
        assert kept.columns == docs.columns and kept.count() <= 6
    assert [r.score for r in quality_model.classify(docs, labels.limit(0)).collect()] == [0.5] * 6
    none = docs.limit(0)
    assert quality_model.classify(none, labels).count() == quality_rules.judge(none, labels).count() == 0


def test_scan_of_long_texts_is_the_same():
    text = b"ab c\n" * (SEGMENT // 4)
    whole = Words([b"x y", text, b"", b"z"], True)
    assert whole.to.tolist() == [2, 2 + SEGMENT // 4 * 2, 2 + SEGMENT // 4 * 2, 3 + SEGMENT // 4 * 2]
    one = Words([b"ab c"], True)
    assert set(whole.hashes[2:-1].tolist()) == set(one.hashes.tolist())
    assert len(grams(whole.hashes[:2], 3)) == 0


@pytest.mark.parametrize("n", [0, 1, 50])
def test_ftrl_learns(n):
    model, rng = quality_model.Ftrl(8), np.random.default_rng(0)
    for _ in range(n):
        y = int(rng.integers(2))
        model.learn(np.array([y, 8]), np.array([1.0, 1.0]), y, 1.0)
    w = model.weights(slice(None))
    assert n < 50 or w[1] > 0 > w[0]
    assert n or not w.any()
