import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from snaplake.llm import passages, simhash
from snaplake.llm.components import components
from snaplake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string"


def groups(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("seed,shape", [(1, "random"), (2, "chain"), (3, "star"), (4, "none")])
def test_components(spark, seed, shape):
    rng = random.Random(seed)
    links = {"random": [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)], "chain": [(i + 1, i) for i in range(40)], "star": [(0, i) for i in range(1, 50)], "none": []}[shape]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for l in links if l[0] != l[1] for n in l}
    assert got == groups(nodes, links)


def reference(text, size=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n", "a", "A b", "a B c", "x y z x y z x y", "é É İ " * 50, "w " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == reference(text)


def test_op7_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op7_simhash"](spark, SF).collect()}
    fp = {d: reference(t) for d, t in docs.items()}
    ids = sorted(fp)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2]
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{f:016x}" for d, f in fp.items()}
    assert {d: r.component_id for d, r in got.items()} == groups(ids, links)


@pytest.mark.parametrize("distance,tile", [(2, 4), (2, 2048), (6, 8)])
def test_links_lose_nothing(spark, distance, tile):
    """Many fingerprints around few centres, so that buckets are split into tiles."""
    rng = random.Random(distance)
    fps = {0, (1 << 64) - 1}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rng.randint(0, distance + 2)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(simhash.signed(f) for f in fps)
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), distance, tile).collect()
    m = (1 << 64) - 1
    want = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & m).bit_count() <= distance]
    assert {(r.a, r.b) for r in got} <= set(want)
    assert groups(fps, [(r.a, r.b) for r in got]) == groups(fps, want)


def test_masks_cover_all_differences():
    for distance, n in ((2, 100), (2, 10**9), (6, 10**5)):
        tables = simhash.masks(distance, n)
        rng = random.Random(1)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), distance))
            assert any(x & t == 0 for t in tables)


def prose(rng, n, salt=""):
    return [f"{salt}{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(n)]


def planted():
    rng, rows = random.Random(9), []
    for i in range(60):
        rows.append((i, " ".join(prose(rng, rng.randint(60, 300)))))
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    for i in range(5, 15):  # an edit every 60 words or so
        w = rows[i][1].split()
        for k in range(20, len(w), 60):
            w[k] = "edited"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " "), (None, "alone here"), (303, rows[0][1].upper())]
    return rows


def jaccard(a, b):
    s = []
    for t in (a, b):
        w = (t or "").encode().lower().split()
        s.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def test_one_of_each_group_stays(spark):
    rows = planted()
    df = spark.createDataFrame([(*r, "k") for r in [*rows, rows[3]]], KIND + ", key string")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    kept = [r.doc_id for r in out.collect()]
    assert len(kept) == len(set(kept))
    text = dict(rows)
    for d in kept:
        for e in kept:
            if d is not None and e is not None and d < e:
                assert jaccard(text[d], text[e]) < 0.8
    for d in text:
        if d is not None and d not in kept and (text[d] or "").split():
            assert any(jaccard(text[d], text[e]) >= 0.8 for e in text if e is not None and e < d)
    assert set(range(60)) <= set(kept) and None in kept


def test_copies_among_texts_of_one_set_of_words(spark):
    rng = random.Random(21)
    vocabulary = prose(rng, 40, "v")
    texts = [rng.choices(vocabulary, k=400) for _ in range(60)]  # all words in each, in another order
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, " ".join([*t[:200], t[7], *t[201:]])) for i, t in enumerate(texts) if i]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, KIND)).collect()}
    assert kept == set(range(60))


@pytest.mark.parametrize("tile", [7, 512])
def test_alike_is_all_pairs_in_tiles(spark, tile):
    rng = random.Random(22)
    base = [prose(rng, 120, f"b{i}") for i in range(3)]
    rows = []
    for i in range(90):
        w = list(base[i % 3])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.keep for r in simhash.near_copies(spark.createDataFrame(rows, KIND), tile=tile).collect()}
    root = list(range(90))
    for i in range(90):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert got == {x for x in root if root.count(x) > 1}


@pytest.mark.parametrize("tile", [8, 512])
def test_large_bands_of_chains_and_strangers(spark, tile):
    """One large band holds a chain of near copies, its branches and texts that only look alike: what pairs connect is connected, and nothing else."""
    rng = random.Random(52)
    frame = prose(rng, 100, "f")
    rows, now = [], list(frame)
    for i in range(40):  # each differs from the one before by a word; the ends differ by many
        now[(7 * i) % 100] = f"c{i}"
        rows.append((i, " ".join(now)))
    for i in range(40, 80):  # half of the frame, and words of their own
        rows.append((i, " ".join([*frame[:70], *prose(rng, 60, f"o{i}")])))
    for i in range(80, 90):  # near copies of one of those
        w = rows[40 + i % 5][1].split()
        w[i % 30] = f"e{i}"
        rows.append((i, " ".join(w)))
    got = {r.text_key: r.keep for r in simhash.near_copies(spark.createDataFrame(rows, KIND), tile=tile).collect()}
    root = list(range(90))
    for i in range(90):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    want = {x for x in root if root.count(x) > 1}
    assert set(got.values()) == want and len(got) == sum(root.count(x) for x in want)


def test_alike_compares_what_is_reached_with_all_that_is_not():
    rng = np.random.default_rng(23)
    for _ in range(20):
        base = rng.choice(10**6, 60, replace=False)
        sets = [np.unique(np.where(rng.random(60) < rng.random() * 0.3, rng.integers(10**6, 2 * 10**6, 60), base)).astype("<u4") for _ in range(25)] + [np.zeros(0, "<u4")] * 2
        parts = []
        for links in (simhash.alike(sets, 0.8), [(i, j) for i in range(27) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]):
            root = list(range(27))
            for i, j in links:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
            parts.append(root)
        assert parts[0] == parts[1]


def test_blocks_added_or_cut(spark):
    rng = random.Random(24)
    rows, pairs = [], 0
    for n in (30, 100, 400):
        for i in range(40):
            w = prose(rng, n, f"t{n}x{i}")
            block = prose(rng, n // 6, f"u{n}x{i}")
            for k, t in enumerate((w, [*w, *block] if i % 3 else w[: n - n // 7], [*block, *w] if i % 2 else w)):
                rows.append((n * 1000 + i * 10 + k, " ".join(t)))
            pairs += 1
    kept = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, KIND)).collect()]
    assert len(kept) == pairs and all(d % 10 == 0 for d in kept)


def test_near_copies_without_ids(spark):
    rng = random.Random(32)
    rows = []
    for first, second in ((None, None), (None, 7)):
        w = prose(rng, 100)
        rows += [(first, " ".join(w)), (second, " ".join([*w[:50], "edited", *w[51:]]))]
    groups = simhash.near_copies(spark.createDataFrame(rows, KIND)).collect()
    assert sorted(r.keep is None for r in groups) == [False, False, True, True] and {r.keep for r in groups} == {None, 7}


def test_compact_windows_against_all_subsequences():
    rng = np.random.default_rng(5)
    for v in (rng.permutation(30), rng.integers(0, 4, 30), np.zeros(30, int)):
        v = v.astype(np.uint64)
        found = passages.compact_windows(v, 6)
        for i in range(30):
            for j in range(i + 5, 30):
                holds = [(l, c, r) for l, c, r in found if l <= i <= c <= j <= r]
                assert any(v[c] == v[i : j + 1].min() for _, c, _ in holds)
        assert all(r - l >= 5 and v[c] == v[l : r + 1].min() for l, c, r in found)


def shared_passages(spark):
    rng = random.Random(4)
    passage, near = prose(rng, 60, "p"), prose(rng, 120, "q")
    edited = list(near)
    edited[55] = "other"
    rows = [(i, " ".join(prose(rng, 120))) for i in range(30)]
    for i in (3, 8, 20):
        w = rows[i][1].split()
        rows[i] = (i, " ".join(w[:40] + passage + w[40:]))
    rows[5] = (5, " ".join(rows[5][1].split() + near))
    rows[11] = (11, " ".join(edited + rows[11][1].split()))
    short = prose(rng, 30, "s")  # too short to count
    for i in (1, 2):
        rows[i] = (i, rows[i][1] + " " + " ".join(short))
    rows += [(50, None), (51, ""), (52, "few words"), (None, rows[3][1])]
    return spark.createDataFrame(rows, KIND), dict(rows), passage


def test_passages(spark):
    df, text, passage = shared_passages(spark)
    got = passages.repeats(df).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} == {(8, 3), (20, 3), (11, 5)}
    for r in got:
        if r.source_doc_id == 3:
            assert text[r.doc_id].split()[r.start : r.start + r.n_words] == passage
        else:
            assert r.n_words == 120
    out = {r.doc_id: r.text for r in passages.without_repeats(df).collect()}
    assert out[8].split() == [w for w in text[8].split() if w not in set(passage)]
    assert all(out[d] == text[d] for d in text if d not in (8, 20, 11)) and set(out) == set(text)
    assert {r.doc_id for r in passages.occurrences(df).collect()} == {3, 8, 20, 5, 11}


@pytest.mark.parametrize("n", [60, 80, 96])
def test_passages_with_a_word_put_in_or_left_out(spark, n):
    rng = random.Random(n)
    rows = []
    for i in range(20):
        p = prose(rng, n, f"p{i}x")
        q = [*p[: n // 2], "more", *p[n // 2 :]] if i % 2 else [*p[: n // 2], *p[n // 2 + 1 :]]
        rows += [(k * 100 + i, " ".join([*prose(rng, 70, f"s{i}{k}"), *w, *prose(rng, 70, f"s{i}{k}")])) for k, w in enumerate((p, q))]
    got = {(r.doc_id, r.source_doc_id): r for r in passages.repeats(spark.createDataFrame(rows, KIND)).collect()}
    assert len(got) == 20 and all(a == b + 100 for a, b in got)
    assert all((r.start, r.source_start, r.n_words) == (70, 70, n + (1 if b % 2 else -1)) for (_, b), r in got.items())


def test_chained_runs():
    rng = np.random.default_rng(8)
    x = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    y = np.concatenate([x[:90], x[95:180], rng.integers(1, 1 << 60, 20).astype(np.uint64), x[180:]])
    for at, to in ((3, 3), (120, 115), (399, 414)):
        assert passages.joined(passages.chained(x, y, at, to), 46, 0.8) == [(0, 400, 0)]


def test_joined_runs_are_the_widest():
    rng, least = random.Random(3), 2 * 0.8 / 1.8
    for _ in range(300):
        runs, s, t = [], rng.randint(0, 9), rng.randint(0, 9)
        for _ in range(rng.randint(0, 7)):
            n = rng.randint(1, 40)
            runs.append((s, t, n))
            s, t = s + n + rng.choice([0, 5, 5, 6, 20]), t + n + rng.choice([0, 5, 5, 6, 20])
        good = []
        for i in range(len(runs)):
            for j in range(i, len(runs)):
                spans = [runs[j][k] + runs[j][2] - runs[i][k] for k in (0, 1)]
                if 2 * sum(r[2] for r in runs[i : j + 1]) >= least * sum(spans) - 1e-9:
                    good.append((spans[0], runs[i][0], runs[j][0] + runs[j][2], runs[i][1]))
        got = passages.joined(runs, 46, 0.8)
        widest = max((g[0] for g in good), default=0)
        assert max((e - b for b, e, _ in got), default=0) == (widest if widest >= 46 else 0)
        assert all((e - b, b, e, t) in good for b, e, t in got) and all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
    assert passages.joined([(0, 0, 17), (22, 21, 9), (31, 30, 26)], 46, 0.8) == [(0, 57, 0)]


def test_passages_of_lines_that_stand_earlier(spark):
    rng = random.Random(31)
    rows = []
    for i in range(20):
        p, at, lines = prose(rng, 60, f"p{i}x"), 0, []
        while at < 60:
            n = rng.randint(10, 20)
            lines.append(p[at : at + n])
            at += n
        rows.append((i, " ".join(w for line in lines for w in [*prose(rng, 30, f"z{i}"), *line])))
        rows += [(k + i, " ".join([*prose(rng, 60, f"s{i}{k}"), *p, *prose(rng, 60, f"e{i}{k}")])) for k in (100, 200)]
    docs = spark.createDataFrame(rows, KIND)
    got = {(r.doc_id, r.source_doc_id, r.n_words) for r in passages.repeats(docs).collect()}
    assert got == {(200 + i, 100 + i, 60) for i in range(20)}
    found = passages.windows(docs)
    for hot in (0, passages.HOT):  # the plan for hot keys finds the same
        pairs = {(r.a, r.b) for r in passages.candidates(found, hot=hot).collect()}
        assert {(200 + i, 100 + i) for i in range(20)} <= pairs


def test_copies_lose_everything(spark):
    w = " ".join(prose(random.Random(1), 80))
    df = spark.createDataFrame([(1, w, 5), (2, w, 5), (2, w, 5)], KIND + ", n_chars int")
    assert [r.doc_id for r in passages.without_repeats(df).collect()] == [1]


def test_cut_words():
    assert passages.cut_words("a b\n c  d", [(1, 2)]) == "a  d"
    assert passages.cut_words(" a b", [(0, 1)]) == " b"
    assert passages.cut_words("a b", [(0, 2)]) is None


def test_many_equal_passages_are_a_star(spark):
    p = " ".join(prose(random.Random(2), 70))
    rows = [(i, " ".join(prose(random.Random(1000 + i), 60)) + " " + p) for i in range(40)]
    got = passages.repeats(spark.createDataFrame(rows, KIND)).collect()
    assert sorted(r.doc_id for r in got if r.source_doc_id == 0) == list(range(1, 40)) and len(got) < 45  # a word before the passage may be shared too


def test_no_rows(spark):
    none = spark.createDataFrame([], KIND)
    assert passages.repeats(none).count() == passages.without_repeats(none).count() == 0
    assert simhash.linked(none).count() == simhash.keep_one(none).count() == 0


def test_repetitive_text(spark):
    df = spark.createDataFrame([(1, "the " * 20000), (2, "the " * 5000 + "end"), (3, "x y " * 3000)], KIND)
    assert {(r.doc_id, r.source_doc_id) for r in passages.repeats(df).collect()} == {(2, 1)}
    assert df.select(F.count("*")).first()[0] == 3


def exact_repeats(docs, words=50):
    """Of each document, the words that lie in runs of `words` words which an earlier or later document has too (A-Z lower-cased)."""
    split = {d: (t or "").encode().lower().split() for d, t in docs.items()}
    owners = {}
    for d, w in split.items():
        for i in range(len(w) - words + 1):
            owners.setdefault(hash(tuple(w[i : i + words])), set()).add(d)
    out = {}
    for d, w in split.items():
        for i in range(len(w) - words + 1):
            first = min(owners[hash(tuple(w[i : i + words]))])
            if first < d:
                out.setdefault(d, set()).update(range(i, i + words))
    return out, split


def test_op6_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want, split = exact_repeats(docs)
    got = QUERIES["op6_substring_dedup"](spark, SF).collect()
    found = {}
    for r in got:
        if (r.doc_id, r.start) != (r.first_doc_id, r.first_start):
            found.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    total, missed = sum(map(len, want.values())), sum(len(w - found.get(d, set())) for d, w in want.items())
    assert total > 500 and missed <= 0.01 * total
    # every occurrence is one: its shingles are like those of a stretch of the first document, from the place told on
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for r in got:
        assert r.first_doc_id <= r.doc_id and r.n_words >= 50
        mine, theirs = grams(split[r.doc_id][r.start : r.start + r.n_words]), split[r.first_doc_id][r.first_start :]
        like = max(len(mine & (o := grams(theirs[:n]))) / len(mine | o) for n in range(int(r.n_words * 0.75), int(r.n_words * 1.35) + 1))
        assert like >= 0.79


@pytest.mark.parametrize("hub", [2, 256])
def test_texts_of_hubs_are_parted(spark, hub):
    pairs = spark.createDataFrame([(i, 0, [i]) for i in range(1, 40)] + [(50, i, [0]) for i in range(1, 10)], "a long, b long, anchors array<int>")
    texts = spark.createDataFrame([(i, f"text {i}") for i in [*range(40), 50]], "id long, text string")
    got = passages._with_texts(pairs, texts, hub).collect()
    assert len(got) == 48 and all((r.at, r.bt) == (f"text {r.a}", f"text {r.b}") for r in got)


def test_a_document_that_holds_the_anchors_only(spark):
    """An earlier document with the least shingles of a passage, but not the passage, hides it from none."""
    rng = random.Random(77)
    rows = []
    for i in range(12):
        p = prose(rng, 60, f"k{i}x")
        h = passages.shingled([" ".join(p)])[0]
        least = {int(((h ^ m[0]) * m[1]).argmin()) for m in passages._MIX}
        lure = [w for c in least for w in [*prose(rng, 30, f"l{i}"), *p[c : c + 5], *prose(rng, 30, f"l{i}")]]
        rows += [(i, " ".join(lure))] + [(k + i, " ".join([*prose(rng, 60, f"s{i}{k}"), *p, *prose(rng, 60, f"e{i}{k}")])) for k in (100, 200)]
    got = {(r.doc_id, r.source_doc_id) for r in passages.repeats(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {(200 + i, 100 + i) for i in range(12)}


def test_words_in_another_order_and_many_pairs_nearby(spark):
    """Pairs over nearly one vocabulary, whose fingerprints are all close, and reordered texts of one set of words: each pair is one group."""
    rng = random.Random(41)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        w = rng.choices(vocabulary, k=300)
        e = list(w)
        e[150] = "edited"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(e))]
    for i in range(40, 50):
        w = rng.sample(vocabulary, 300)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:140], *w[141:], w[140]]))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, KIND)).collect()}
    assert kept == {2 * i for i in range(50)}


def test_an_earlier_document_with_most_of_a_passage_hides_it_from_none(spark):
    """Documents that hold 30 to 49 words of a passage of 50 to 70, alone or together all of it, stand before those that hold it whole; some of these have a word changed."""
    rng = random.Random(61)
    rows = []
    for i in range(60):
        n = rng.randint(50, 70)
        p = prose(rng, n, f"h{i}x")
        m = rng.randint(30, 49)
        cuts = [rng.randint(0, n - m)] if i % 3 == 0 else [0, n - m]
        for k, at in enumerate(cuts):
            rows.append((k * 100 + i, " ".join([*prose(rng, 60, f"a{i}{k}"), *p[at : at + m], *prose(rng, 60, f"b{i}{k}")])))
        q = list(p)
        if n >= 58 and i % 3 == 0:
            q[3] = "edited"
        rows += [(k + i, " ".join([*prose(rng, 60, f"s{i}{k}"), *w, *prose(rng, 60, f"e{i}{k}")])) for k, w in ((300, p), (400, q))]
    got = {(r.doc_id, r.source_doc_id): r for r in passages.repeats(spark.createDataFrame(rows, KIND)).collect()}
    assert set(got) == {(400 + i, 300 + i) for i in range(60)}
    assert all(r.n_words >= 50 for r in got.values())


def test_near_copies_meet_by_their_fingerprints(spark, monkeypatch):
    """Without a shared band, texts whose fingerprints are linked still meet, and are verified."""
    rng = random.Random(71)
    rows, want = [], set()
    for i in range(12):
        w = prose(rng, 400, f"m{i}x")
        text = " ".join(w)
        rows.append((i, text))
        for k in range(1, 40):  # one word changed: the first that moves at most two bits
            e = " ".join([*w[: 9 * k], "edited", *w[9 * k + 1 :]])
            if (reference(e) ^ reference(text)).bit_count() <= 2:
                rows.append((100 + i, e))
                want.add(i)
                break
    assert len(want) >= 6
    monkeypatch.setattr(simhash, "banded", lambda v: np.random.default_rng([len(v), int(v[0]), int(v[-1]), int(v.sum())]).integers(0, 1 << 63, simhash.BANDS, dtype=np.uint64))
    got = {r.keep for r in simhash.near_copies(spark.createDataFrame(rows, KIND)).collect()}
    assert got == want


def test_anchors_of_one_chain_are_chained_once(monkeypatch):
    """A long pair that is alike in places only: work in proportion to its length, not to its length times its anchors."""
    rng = np.random.default_rng(81)
    x = rng.integers(1, 1 << 60, 4000).astype(np.uint64)
    y, anchors = x.copy(), []
    for at in range(0, 4000, 40):  # 25 shingles in 40 are the same
        y[at + 25 : at + 40] = rng.integers(1, 1 << 60, 15)
        anchors.append((at + 12, at + 12))
    y[2000:2060] = x[2000:2060]
    calls, chained = [], passages.chained
    monkeypatch.setattr(passages, "chained", lambda *a: calls.append(a) or chained(*a))
    got = passages.verified(x, y, anchors, 46, 0.8)
    assert len(calls) <= 3 and any(s <= 2000 and e >= 2060 for s, e, _ in got)


def test_compact_windows_of_many_texts_at_once():
    """The windows of all parts are those of each one, ties in short and in long stretches included."""
    rng = np.random.default_rng(91)
    kinds = [lambda n: rng.integers(1, 1 << 63, n), lambda n: rng.integers(1, 200, n), lambda n: np.tile(rng.integers(1, 1 << 63, 7), n // 7 + 1)[:n], lambda n: np.full(n, 5)]
    for _ in range(30):
        parts = [kinds[rng.integers(0, 4)](int(rng.integers(0, 1500))).astype(np.uint64) for _ in range(rng.integers(1, 6))]
        v, from_ = np.zeros(1, np.uint64), []
        for p in parts:
            from_.append(len(v))
            v = np.concatenate([v, p, np.zeros(1, np.uint64)])
        got = sorted(zip(*(x.tolist() for x in passages.compact_windows_of_all(v, np.array(from_), 46)), strict=True))
        assert got == sorted((i, *w) for i, p in enumerate(parts) for w in passages.compact_windows(p, 46))


def test_first_windows_by_batches(spark):
    """First windows of the same surroundings, a key's rows in many batches, against a plain search."""
    rng = np.random.default_rng(92)
    n = 600
    rows = {(int(d), int(k), int(c)): (int(x), int(f)) for d, k, c, x, f in zip(rng.integers(0, 40, n), rng.integers(0, 30, n) ** 2 // 40, rng.integers(0, 9, n), rng.choice([0, 3, 1 << 16, 3 << 16 | 3, -1], n), rng.choice([0, 7, 5 << 16, -9], n), strict=True)}
    part = lambda v, shift: v >> shift & 0xFFFF
    kinds = [lambda x, f: part(x, 16), lambda x, f: part(x, 0), lambda x, f: part(f, 16), lambda x, f: part(f, 0), lambda x, f: x if part(x, 16) and part(x, 0) else 0]
    want = set()
    for (d, k, c), xf in rows.items():
        for kind in kinds:
            first = min((e, b) for (e, j, b), yg in rows.items() if j == k and kind(*yg) == kind(*xf))
            if kind(*xf) and first[0] < d:
                want.add((d, k, c, *first))
    found = spark.createDataFrame([(d, k, x, f, 0, c, 90) for (d, k, c), (x, f) in rows.items()], "doc_id long, key long, ctx int, far int, l int, c int, r int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for hot in (0, passages.HOT):
            got = [(r.doc_id, r.key, r.c, r.b, r.bc) for r in passages.with_first(found, hot).collect()]
            assert set(got) == want and (hot == 0 or len(got) == len(want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_runs_over_an_edge_are_told_in_few_rows(spark):
    """38 runs reach over each end of what a pair shares: few rows tell them, and runs that a span holds are marked."""
    rng = random.Random(93)
    p = prose(rng, 120, "shared")
    texts = [" ".join([*prose(rng, 90, f"s{i}"), *p[:70], *["edited"] * i, *p[70:], *prose(rng, 90, f"e{i}")]) for i in range(2)]
    pairs = spark.createDataFrame([(1, 0, [100, 100])], "a long, b long, anchors array<int>")
    got = passages._verify(pairs, spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 46, 0.8, edges=True).collect()
    told = [r for r in got if r.edge is not None]
    x, y = passages.shingled(texts[::-1])
    equal = []
    spans = passages.verified(x, y, [(100, 100)], 46, 0.8, equal)
    want = {(int(at), size + 4, int(h)) for size in (46, 24) for at, h in zip(*passages.edge_grams(x, equal, size), strict=True)}
    flat = [(r.start + i, r.n_words, h % (1 << 64), r.held) for r in told for i, h in enumerate(r.runs)]
    assert len(want) >= 3 * 38 and {f[:3] for f in flat} == want and len(told) <= len(want) // 4
    assert all(held == any(s <= at and at + n - 4 <= e for s, e, _ in spans) for at, n, _, held in flat) and {f[3] for f in flat} == {True, False}
