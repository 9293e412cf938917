import collections
import hashlib
import re

import pytest

import corpus_pipeline
from snaplake.llm import packing
from snaplake.llm.queries import QUERIES
from snaplake.llm.tokens import default_tokenizer, encoder

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        last = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(docs.count())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == COLUMNS
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2]
    tokens = sum(r.length for r in docs.select("length").collect())
    assert tokens == sum(len(x) for x in _ids(last))
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def _ids(docs):
    return encoder(default_tokenizer()).ids([r.text or "" for r in docs.select("text").collect()], 0)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")] and got.count() > 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 2 + [(1, "", "en", "s", 0), (2, "x " * 60000, "en", None, 120000), (2, "x " * 60000, "en", None, 120000), (3, "plain words that mean little", None, "s", 28)]])
def test_stages_take_anything(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, key int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == docs.columns
        assert out.count() <= 200


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept_by_all_pairs(docs):
    """The smallest doc_id of each group that pairs of a Jaccard similarity of 0.8 or more connect."""
    sets = {d: shingle_set(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d for d in docs if top(d) == d}


def taken_by_pouring(docs):
    """(repetitions by doc_id): the budget poured in rounds, then rows in their seeded order until the middle of one lies beyond the target."""
    size = {d: len(words(t)) for d, (t, _) in docs.items()}
    sources = sorted({s for _, s in docs.values()})
    per = {s: sum(size[d] for d in docs if docs[d][1] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(per.values()), set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * per[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * per[s] for s in full}
        left -= sum(2 * per[s] for s in full)
        open_ -= full
    out = {}
    for s in sources:
        mine = sorted((hashlib.md5(f"7:{d}".encode()).hexdigest(), d) for d in docs if docs[d][1] == s)
        whole = int(target[s] // per[s]) if per[s] else 0
        before = 0
        for _, d in mine:
            more = whole < 2 and size[d] > 0 and before + size[d] / 2 <= target[s] - whole * per[s]
            out[d] = whole + more
            before += size[d]
    return out


def test_each_stage_by_brute_force(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        seen.append([docs, docs := spark.read.parquet(f"{tmp_path}/{i}")])
    whole = lambda df: {r.doc_id: (r.text, r.source) for r in df.collect()}
    # quality: those that op3 predicts to be good
    good = {r.doc_id for r in QUERIES["op3_quality_model"](spark, SF).filter("predicted = 1").collect()}
    assert set(whole(seen[0][1])) == good
    # near copies
    before, after = whole(seen[1][0]), whole(seen[1][1])
    assert set(after) == kept_by_all_pairs({d: t for d, (t, _) in before.items()}) and all(after[d] == before[d] for d in after)
    # passages: what is left stands in the text in order, no run of 50 words is left in two documents, and nothing goes that is in one document only
    before, after = whole(seen[2][0]), whole(seen[2][1])
    owners = collections.defaultdict(set)
    for d, (t, _) in after.items():
        w = (t or "").encode().lower().split()
        for k in range(len(w) - 49):
            owners[tuple(w[k : k + 50])].add(d)
    assert not [o for o in owners.values() if len(o) > 1]
    held = collections.Counter(g for t, _ in before.values() for g in shingle_set(t))
    for d, (t, _) in before.items():
        rest = iter(words(t))
        assert d not in after or all(w in rest for w in words(after[d][0]))
        gone = shingle_set(t) - shingle_set(after.get(d, ("", ""))[0])
        assert sum(held[g] > 1 for g in gone) >= 0.75 * len(gone)
    # the mix
    before = whole(seen[3][0])
    got = collections.Counter(r.doc_id for r in seen[3][1].select("doc_id").collect())
    assert got == +collections.Counter(taken_by_pouring(before)) and all(tuple(r) == (r[0], *before[r[0]]) for r in seen[3][1].select("doc_id", "text", "source").collect())
    # packing: every id of every row once, in windows without gaps
    rows, pieces = seen[4][0].select("doc_id", "text").collect(), seen[4][1].collect()
    crc = collections.Counter()
    for r, ids in zip(rows, encoder(default_tokenizer()).ids([r.text or "" for r in rows], 0), strict=True):
        crc[r.doc_id, len(ids)] += 1
    told = collections.Counter()
    for p in pieces:
        told[p.doc_id, p.doc_tokens] += p.length
    assert told == {k: k[1] * n for k, n in crc.items()}
    windows = collections.defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
    for w in windows.values():
        w.sort()
        assert w[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(w, w[1:], strict=False)) and sum(w[-1]) <= 1024
