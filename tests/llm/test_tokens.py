import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from snaplake.files import put
from snaplake.llm import packing, passages, sharding, simhash, token_counts, token_files, tokens
from snaplake.llm.queries import QUERIES
from snaplake.llm.token_files import EliasFano
from snaplake.llm.words import Words, run_hashes

PATH = tokens.default_tokenizer()
KIND = "doc_id long, text string"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


PIECES = [" ", "\n", "  ", "a", "The", "'s", " ", "\t", "é", "\x1c", "᠎", " ", "12", "##", "\r", "<|endoftext|>", "日", "\x85", "_", " word", " Word!!"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=5))
def test_pieces_are_whole_texts(plain, texts):
    assert [x.tolist() for x in tokens.encoder(PATH).ids(texts)] == [plain(t) for t in texts]


def test_small_memo_and_long_texts(plain, monkeypatch):
    e = tokens.Encoder(PATH, memo=64)
    monkeypatch.setattr(tokens, "_SEGMENT", 64)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 300))) for _ in range(20)]
    assert [x.tolist() for x in e.ids(texts, end=7)] == [[*plain(t), 7] for t in texts]


def thue_morse(k):
    """Two words of 2**k letters that any polynomial modulo a power of two gives one hash once they are long."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("k", range(10, 17))
def test_words_that_polynomials_confuse(plain, k):
    a, b = thue_morse(k)
    texts = [f"w {a}", f"w {b}", f"{b} {a}", a, b]
    assert [x.tolist() for x in tokens.Encoder(PATH).ids(texts)] == [plain(t) for t in texts]
    h = Words([t.encode() for t in texts]).hashes
    assert len(set(h.tolist())) == 3 and h[1] == h[5] == h[6] and h[3] == h[4] == h[7]


def test_pieces_of_one_hash_are_told_apart(plain, monkeypatch):
    monkeypatch.setattr(tokens, "run_hashes", lambda buf, starts, lengths: lengths.astype(np.uint64) << np.uint64(40))
    e = tokens.Encoder(PATH)
    for texts in (["one two six", "ten"], ["cat dog", "red"], ["one two six"]):
        assert [x.tolist() for x in e.ids(texts)] == [plain(t) for t in texts]


def test_small_pool_of_bytes(plain, monkeypatch):
    monkeypatch.setattr(tokens, "_RAW", 100)
    e = tokens.Encoder(PATH)
    for i in range(20):
        texts = [f"word{j} other{j} same" for j in range(i, i + 5)]
        assert [x.tolist() for x in e.ids(texts)] == [plain(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=20))
def test_run_hashes_depend_on_the_bytes_alone(runs):
    def of(runs):
        joined, n = b"".join(runs), np.array([len(r) for r in runs])
        return run_hashes(np.frombuffer(joined, np.uint8), np.cumsum(n) - n, n).tolist()

    h = of(runs)
    assert h == [of([r])[0] for r in runs] and len(set(h)) == len(set(runs))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    raw = b"xx" + EliasFano.of(np.array(values, dtype=np.uint64)).to_bytes()
    back, at = EliasFano.from_bytes(raw, 2)
    assert at == len(raw) and back.values().tolist() == values
    for i in range(0, len(values), 37):
        assert back.select(i) == values[i]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 3000, 20_000))
    assert len(EliasFano.of(ends).to_bytes()) * 8 < 20_000 * (2.2 + np.log2(ends[-1] / 20_000))


def documents(spark, n=60):
    rng = random.Random(3)
    rows = [(i * 7 - 30, " ".join(rng.choices(["alpha", "béta", "x\ny", "  ", "gamma!"], k=rng.choice([0, 1, 30, 900])))) for i in range(n)]
    rows += [(None, "no id"), (6, None), (6, None), (10**15, "")]
    return spark.createDataFrame(rows, KIND).repartition(5), rows


def test_token_files(spark, plain):
    df, rows = documents(spark)
    manifest = token_files.write_files(df, PATH, end_id=2, roll=500)
    assert manifest.count() > 4
    got = sorted(token_files.read_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda t: zlib.crc32(np.array([*plain(t), 2], "<u4").tobytes())
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or 0, len(plain(t)) + 1, crc(t)) for d, t in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    assert token_files.read_files(token_files.write_files(none, PATH)).collect() == []
    assert token_counts.count_documents(none, PATH).collect() == []
    assert packing.pack(none, PATH).collect() == []


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_separator_scan_across_blocks_and_files(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files, ids = [], []
    for i, n in enumerate([10, 0, 23, 1, 17]):
        x = rng.choice([9, 1, 2, 3], n).astype("<u2")
        if n:
            put(f"file://{tmp_path}/{i}.ids", x.tobytes())
            ids += x.tolist()
        files.append((f"file://{tmp_path}/{i}.ids", i, n))
    want, start = [], 0
    for at, x in enumerate([*ids, None]):
        if x == 9 or x is None and start < at:
            want.append((len(want), start, at - start, x == 9))
            start = at + 1
    df = spark.createDataFrame(files, "path string, place long, ids long")
    got = sorted((r.ordinal, r.start, r.n_tokens, r.closed) for r in token_counts.scan(df, 9, 2, block).collect())
    assert got == want


def test_token_counts(spark, plain):
    df, rows = documents(spark)
    got = token_counts.count_documents(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((d or 0, len(plain(t))) for d, t in rows)


def test_packing(spark, plain):
    df, rows = documents(spark)
    got = packing.pack(df, PATH, capacity=64, end_id=0, piece=16, batch=4).collect()
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append(r)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 64
    texts = {d: [*plain(t), 0] for d, t in rows if d != 6}
    for d, ids in texts.items():
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
        assert all(r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in mine)
        assert sum(r.length for r in mine) == len(ids)
    assert sum(r.doc_id == 6 for r in got) == 2


@pytest.mark.parametrize("seed", range(5))
def test_differencing(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 256) for _ in range(rng.randint(1, 300))]
    window, k = packing.balance(sizes, 1024)
    loads = np.bincount(window, sizes, minlength=k)
    assert len(window) == len(sizes) and loads.max() <= 1024 and loads.sum() == sum(sizes)
    assert k <= -(-sum(sizes) // 1024) + 1 + len(sizes) // 100
    # near-equal: closer than the largest piece
    assert loads.max() - loads.min() <= 256


def test_differencing_by_hand():
    # 8 7 6 5 4 in two windows: differencing gives 16 and 14
    window, most = packing.difference([8, 7, 6, 5, 4], 2)
    assert most == 16 and sorted(np.bincount(window, [8, 7, 6, 5, 4]).tolist()) == [14, 16]


def test_query_columns(spark):
    from snaplake.llm.queries import QUERIES

    out = QUERIES["op9_packing"](spark, "/root/testdata/sf0.001")
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    lengths = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in lengths) <= 1024
    assert 1 - sum(r.n for r in lengths) / (1024 * len(lengths)) < 0.02


def test_op1_against_all_texts(spark, plain):
    """Starts and counts of every document, from the flat files in the order they were written."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = sorted(QUERIES["op1_token_counts"](spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.start)
    assert {r.doc_id: r.n_tokens for r in got} == {d: len(plain(t)) for d, t in text.items()} and len(got) == len(text)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens + 1


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_parts_and_blocks_are_stitched(spark, tmp_path, block):
    rng, flat, rows = np.random.default_rng(block), [], []
    for part in range(4):
        for seq in range(3):
            ids = rng.integers(0, 5, rng.integers(0, 40)).astype("<u2") if part != 2 else np.ones(20, "<u2")
            put(f"{tmp_path}/{part}-{seq}", ids.tobytes())
            rows.append((f"{tmp_path}/{part}-{seq}", (part << 32) + seq, len(ids)))
            flat += ids.tolist()
    got = token_counts.scan(spark.createDataFrame(rows, "path string, place long, ids long"), 0, 2, block).orderBy("ordinal").collect()
    ends = [i for i, x in enumerate(flat) if x == 0]
    starts = [0, *[e + 1 for e in ends]]
    want = [(k, s, e - s, True) for k, (s, e) in enumerate(zip(starts, ends, strict=False))]
    if starts[-1] < len(flat):
        want.append((len(ends), starts[-1], len(flat) - starts[-1], False))
    assert [tuple(r) for r in got] == want


def test_columns_with_clashing_names(spark):
    """Columns that operators use inside may be in the table already."""
    rows = [(i, f"some words of text {i} " * 3, "s", i, "x", 1.0, 2) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, ids long, part string, start double, n long")
    for c in ("seq", "ordinal", "base", "key", "fp", "size", "place", "at", "b", "c", "l", "r", "shard", "slot", "h", "component"):
        docs = docs.withColumn(c, F.lit("clash"))
    assert token_counts.count_documents(docs, PATH).count() == 6
    assert token_files.read_files(token_files.write_files(docs, PATH)).count() == 6
    assert {r.doc_id for r in packing.pack(docs, PATH).collect()} == set(range(6))
    assert {r.doc_id for r in simhash.linked(docs).collect()} == set(range(6))
    assert sharding.interleave(docs, 3).count() == 6
    assert passages.repeats(docs).count() == 0 and passages.without_repeats(docs).columns == docs.columns
    assert simhash.keep_one(docs).columns == docs.columns


def test_files_are_read_by_select(plain):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "bc", "déf"], k=rng.randint(0, 9))) for _ in range(700)]
    keys = sorted([None] * 300 + rng.sample(range(10**6), 400), key=lambda d: (d is not None, d or 0))
    ids = [np.array([*plain(t), 2]) for t in texts]
    file = token_files.TokenFile(b"".join(token_files.pack(keys, ids, 2)))
    ends = np.cumsum([len(x) for x in ids]).tolist()
    want = list(zip(keys, [0, *ends[:-1]], ends, strict=True))
    assert [file.document(i) for i in range(700)] == want
    assert [row for k, s, e in file.stretches() for row in zip(k, s.tolist(), e.tolist(), strict=True)] == want
