import datetime
import hashlib
import random
from bisect import bisect_right
from itertools import accumulate, pairwise

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snaplake.operators import catalog, contrib, diff, layout, log

FILES = "pack string, seq int, path string, checksum string, mode long, size long"


def history(seed, snapshots=6, paths=12):
    rng, rows = random.Random(seed), []
    state = {}
    for seq in range(snapshots):
        for p in range(paths):
            if rng.random() < 0.3:
                state[f"d{p % 3}/f{p}"] = (rng.choice("abc"), rng.choice([33204, 33277]))
            elif rng.random() < 0.2:
                state.pop(f"d{p % 3}/f{p}", None)
        rows += [("p", seq, k, c, m, len(c)) for k, (c, m) in state.items()]
    return rows


def snaps(spark, n=6):
    return spark.createDataFrame([("p", i, f"s{i}") for i in range(n)], "pack string, seq int, tag string")


@pytest.mark.parametrize("seed", range(3))
def test_replay_undoes_encoding(spark, seed):
    rows = history(seed)
    files = spark.createDataFrame(rows, FILES)
    changes = log.delta_encode(files, snaps(spark)).cache()
    assert log.violations(changes).count() == 0
    valid = log.intervals(changes)
    for seq in range(6):
        want = {(r[2], r[3], r[4]) for r in rows if r[1] == seq}
        assert {(r.path, r.checksum, r.mode) for r in log.resolve(changes, seq).collect()} == want
        assert {(r.path, r.checksum, r.mode) for r in log.as_of(valid, seq).collect()} == want
    full = log.materialise_all(changes, snaps(spark))
    assert {(r.seq, r.path, r.checksum, r.mode) for r in full.collect()} == {(r[1], r[2], r[3], r[4]) for r in rows}
    counts = {r.seq: r.files for r in log.running_file_count(changes, snaps(spark)).collect()}
    assert counts == {i: sum(r[1] == i for r in rows) for i in range(6)}


def test_violation_is_found(spark):
    bad = spark.createDataFrame([("p", 0, "R", "x", "a", 1, 1)], "pack string, seq int, op string, path string, checksum string, mode long, size long")
    assert log.violations(bad).count() == 1


def test_intern_is_by_first_appearance(spark):
    rows = [("p", i, v) for i, v in enumerate(["a", "b", "c", "b", "a/a", "a/a", "a", "a/a"])]
    df = spark.createDataFrame(rows, "pack string, i int, v string")
    assert {r.v: r.handle for r in log.intern(df, "v", ["i"]).collect()} == {"a": 0, "b": 1, "c": 2, "a/a": 3}


def state(spark, **files):
    return spark.createDataFrame([(p, c, 1) for p, c in files.items()], "path string, checksum string, mode long")


@pytest.mark.parametrize("old,new,added,removed", [({"A": "1"}, {"A": "2"}, 1, 1), ({"A": "1", "B": "2"}, {"A": "3"}, 1, 2), ({"A": "1", "B": "2"}, {"A": "2", "B": "1"}, 2, 2), ({"A": "1"}, {"A": "1"}, 0, 0)])
def test_entry_diff(spark, old, new, added, removed):
    d = [r.change for r in diff.entry_diff(state(spark, **old), state(spark, **new)).collect()]
    assert (d.count("added"), d.count("removed")) == (added, removed)


def test_plan_and_mode_changes(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1)], "path string, checksum string, mode long")
    new = spark.createDataFrame([("a", "1", 2), ("c", "1", 1), ("d", "1", 1)], "path string, checksum string, mode long")
    assert {(r.path, r.kind) for r in diff.extract_plan(old, new).collect()} == {("a", "M"), ("b", "D"), ("d", "A")}


def test_snapshot_checksum_against_hashlib(spark):
    files = [("b", hashlib.sha1(b"1").hexdigest(), 33204), ("a", hashlib.sha1(b"1").hexdigest(), 33277), ("ü", hashlib.sha1(b"2").hexdigest(), 33204)]
    want = hashlib.sha1()
    for p, c, m in sorted(files, key=lambda f: (f[1], f[0].encode())):
        want.update(p.encode() + bytes.fromhex(c) + m.to_bytes(4, "big"))
    for rows in (files, files[::-1]):
        df = spark.createDataFrame([("p", *r) for r in rows], "pack string, path string, checksum string, mode long")
        assert diff.snapshot_checksum(df, ["pack"]).first().fingerprint == want.hexdigest()


def greedy(sizes, n):
    """Sizes of the runs, by bisection of the running totals."""
    totals = list(accumulate(sizes))
    if not totals:
        return []
    n = max(1, min(n, len(sizes)))
    cuts = [0]
    for _ in range(n - 1):
        before = totals[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(bisect_right(totals, before + totals[-1] // n))
    cuts.append(len(sizes))
    return [b - a for a, b in pairwise(cuts) if b > a]


CASES = [([4, 4, 5, 6, 7, 11, 12], 3), ([3, 8, 500], 5), ([7, 7], 6), ([], 3), ([5], 1), ([640, 3, 9, 4], 3), ([0, 0, 3, 0], 2)] + [([random.Random(i).randint(0, 30) for _ in range(i)], i % 5 + 1) for i in range(1, 14)]


@pytest.mark.parametrize("sizes,n", CASES)
def test_greedy_partition(spark, sizes, n):
    df = spark.createDataFrame([(sizes,)], "s array<long>")
    got = df.select(layout.greedy_partition(F.col("s"), n).alias("p")).first().p
    want = [k for k, count in enumerate(greedy(sizes, n)) for _ in range(count)]
    assert got == want


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 3), (3, 4), (4, 7)])
def test_partition_by_boundaries(spark, seed, n):
    rng = random.Random(seed)
    sizes = sorted(rng.choice([0, 1, 5, rng.randint(1, 100), 900]) for _ in range(25))
    df = spark.createDataFrame([("p", f"{i:04x}", s) for i, s in enumerate(sizes)], "pack string, checksum string, size long")
    placed = layout.object_layout(df).cache()
    ends = [r.offset + r.size for r in placed.orderBy("size", "checksum").collect()]
    assert ends == [sum(sizes[: i + 1]) for i in range(len(sizes))]
    got = [r.frame for r in layout.frames_by_boundaries(placed, n).orderBy("offset", "size", "checksum").collect()]
    assert got == [k for k, count in enumerate(greedy(sizes, n)) for _ in range(count)]


def test_frame_asof(spark):
    frames = spark.createDataFrame([("p", 0, 100, 1000), ("p", 1, 0, 0), ("p", 2, 50, 500)], "pack string, frame int, frame_size long, decompressed_size long")
    entries = spark.createDataFrame([("p", 50), ("p", 800), ("p", 1000), ("p", 1200)], "pack string, offset long")
    got = {r.offset: (r.frame, r.local_offset) for r in layout.assign_frames(entries, frames).collect()}
    assert got == {50: (0, 50), 800: (0, 800), 1000: (2, 0), 1200: (2, 200)}


def test_search_is_literal(spark):
    df = spark.createDataFrame([("p", 0, "a_b"), ("p", 1, "axb"), ("p", 2, "a%b")], "pack string, seq int, tag string")
    assert [r.tag for r in catalog.find_snapshots(df, "_").collect()] == ["a_b"]
    assert [r.tag for r in catalog.find_snapshots(df, "%").collect()] == ["a%b"]


def test_same_tag_rule_keeps_tags(spark):
    prints = spark.createDataFrame([("p2", "snap-1", "f"), ("loose/snap-5", "snap-5", "f"), ("p0", "snap-3", "g"), ("loose/snap-3", "snap-3", "g")], "pack string, tag string, fingerprint string")
    assert {r.tag for r in catalog.redundant_loose(prints).collect()} == {"snap-5", "snap-3"}
    assert {r.tag for r in catalog.redundant_same_tag(prints).collect()} == {"snap-3"}


def test_empty_dirs(spark):
    gone = spark.createDataFrame([("a/b/c",), ("a/d",), ("e/f",)], "path string")
    kept = spark.createDataFrame([("a/x",)], "path string")
    assert {r.dir for r in diff.empty_dirs(gone, kept).collect()} == {"a/b", "e"}


def test_prefixes(spark):
    commits = spark.createDataFrame([("abcdef12",), ("abcdef99",), ("0123456789",), ("0123456789",)], "commit string")
    asked = spark.createDataFrame([("abcdef",), ("abcdef1",), ("012345",), ("ffffff",)], "prefix string")
    assert {r.prefix: (r.n, r.commit) for r in catalog.commit_prefix(commits, asked).collect()} == {"abcdef": (2, None), "abcdef1": (1, "abcdef12"), "012345": (1, "0123456789"), "ffffff": (0, None)}


def test_served(spark):
    df = spark.createDataFrame([("bin/clang-14",), ("bin/lld",), ("lib/clang/x/y.h",), ("lib/z",), ("bin/sub/clang",)], "path string")
    assert {r.path for r in catalog.served(df, "clang", "lld").collect()} == {"bin/clang-14", "bin/lld", "lib/clang/x/y.h"}
    assert {r.path for r in catalog.served(df, "lld", "").collect()} == {"bin/lld"}


def test_compilation_database(spark):
    db = [
        (": && ar qc lib/a.a x.o y.o && ranlib lib/a.a", "lib/a.a"),
        ("clang++-14 -O2 main.o lib/a.a lib/a.a -lm 'odd name' -o bin/t", "bin/t"),
        ("cc main.o -o bin/skip", "bin/skip"),
        ("cmake -E cmake_symlink_library lib/l.so.1.2 lib/l.so.1 lib/l.so", ""),
        ("libtool -static -o lib/b.a z.o w.o", "lib/b.a"),
    ]
    df = spark.createDataFrame([(c, o, i) for i, (c, o) in enumerate(db)], "command string, output string, place long")
    parsed = contrib.parse_commands(df).cache()
    assert {(r.kind, r.output) for r in parsed.collect()} == {("archive", "lib/a.a"), ("link", "bin/t"), ("symlink", "l.so.1.2"), ("symlink", "l.so.1"), ("archive", "lib/b.a")}
    assert [r.line for r in contrib.build_lines(parsed, ["-l"]).collect()] == ["clang++ -O2 main.o x.o y.o 'odd name' -o bin/t"]
    assert [r.object for r in contrib.dump_objects(parsed).collect()] == ["main.o", "x.o", "y.o"]


@pytest.mark.parametrize("names,want", [(["x.o", "lib2.a", "lib1.a"], "{lib{1.a,2.a},x.o}"), (["x"], "x"), ([], ""), (["ab", "abc"], "ab{,c}")])
def test_brace(names, want):
    assert contrib.brace(names) == want


@given(st.lists(st.text("ab/_ '", min_size=1, max_size=6), min_size=1, max_size=12))
def test_braces_expand_to_the_names(names):
    assert contrib.expand_braces(contrib.brace(names)) == sorted(set(names))


@pytest.mark.parametrize("seed", range(6))
def test_prefix_sums_over_grains(spark, seed):
    rng = random.Random(seed)
    rows = [(f"g{rng.randint(0, 2)}", rng.choice([0, 1, 255, 256, 257, rng.randint(0, 1 << rng.randint(1, 50))]), f"{rng.randint(0, 40):04x}{i:03x}") for i in range(200)]
    got = layout.object_layout(spark.createDataFrame(rows, "pack string, size long, checksum string")).collect()
    for g in {r[0] for r in rows}:
        at = 0
        for r in sorted((r for r in got if r.pack == g), key=lambda r: (r.size, r.checksum)):
            assert r.offset == at
            at += r.size


def test_size_grain_rises(spark):
    sizes = sorted({0, 1, 2, *(x + d for k in range(1, 62) for x in (1 << k, 3 << k - 1) for d in (-1, 0, 1))})
    got = [r.g for r in spark.createDataFrame([(n,) for n in sizes], "size long").orderBy("size").select(layout.size_grain(F.col("size")).alias("g")).collect()]
    assert got == sorted(got) and len(set(got)) > 150


def test_many_frames_and_jobs(spark):
    """As many frames as objects, and more; a boundary look-up is no job of its own."""
    rows = [("p", f"{i:05x}", 1 + i // 10) for i in range(2000)] + [("q", f"{i:05x}", 5) for i in range(10)]
    placed = layout.object_layout(spark.createDataFrame(rows, "pack string, checksum string, size long")).cache()
    for n in (1, 7, 400, 5000):
        for pack in ("p", "q"):
            got = [r.frame for r in layout.frames_by_boundaries(placed, n).filter(F.col("pack") == pack).orderBy("offset", "size", "checksum").collect()]
            assert got == [k for k, count in enumerate(greedy([r[2] for r in rows if r[0] == pack], n)) for _ in range(count)]


@pytest.mark.parametrize("seed", range(4))
def test_frame_asof_against_bisection(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 0, 1, rng.randint(1, 50), 5000]) for _ in range(rng.randint(1, 40))]
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    frames = spark.createDataFrame([("p", i, 1, n) for i, n in enumerate(sizes)], "pack string, frame int, frame_size long, decompressed_size long")
    asked = sorted({0, *starts, sum(sizes), *(rng.randint(0, sum(sizes) + 10) for _ in range(30))})
    got = {r.offset: (r.frame, r.local_offset) for r in layout.assign_frames(spark.createDataFrame([("p", o) for o in asked], "pack string, offset long"), frames).collect()}
    assert got == {o: ((k := bisect_right(starts, o) - 1), o - starts[k]) for o in asked}


def test_corrupt_logs_are_errors(spark):
    kind = "pack string, seq int, op string, path string, checksum string, mode long, size long"
    row = lambda seq, op: ("p", seq, op, "a", "c", 1, 5)
    for rows in ([row(0, "A"), row(1, "A")], [row(0, "R")], [row(0, "A"), row(1, "R"), row(2, "R")]):
        changes = spark.createDataFrame(rows, kind)
        assert log.violations(changes).count() == 1
        for read in (lambda c=changes: log.resolve(c, 5), lambda c=changes: log.intervals(c)):
            with pytest.raises(Exception, match="corrupt log"):
                read().collect()
    good = spark.createDataFrame([row(0, "A"), row(1, "R"), row(3, "A")], kind)
    assert log.resolve(good, 2).count() == 0 and log.resolve(good, 3).count() == 1 and log.intervals(good).count() == 2


def test_long_and_repeated_values_are_interned(spark):
    rng = random.Random(2)
    seen = [("x/" * rng.randint(0, 50) + rng.choice("abc"), i) for i in range(300)]
    got = {r.path: r.handle for r in log.intern(spark.createDataFrame([("p", *s) for s in seen], "pack string, path string, seq int"), "path", ["seq"]).collect()}
    first = list(dict.fromkeys(s for s, _ in seen))
    assert got == {s: i for i, s in enumerate(first)}


def test_mainline_between_days(spark):
    rows = [(f"s{i}", datetime.datetime(2024, 1, 1 + i // 4, i % 4), i, i % 5 != 2) for i in range(24)] + [("late", datetime.datetime(2023, 12, 1), 24, True)]
    commits = spark.createDataFrame(rows, "sha string, ts timestamp, place long, mainline boolean")
    got = [r.sha for r in contrib.commits_between(commits, "2024-01-03", "2024-01-05").orderBy("place").collect()]
    assert got == ["s9", "s10", "s11", "s13", "s14", "s15", "late"]  # a clock that goes back keeps its place
    assert contrib.commits_between(commits, "2025-01-03", "2025-01-05").count() == 0
    lines = {r.sha: r.line for r in contrib.commit_list(commits, commits, "2024-01-03", "2024-01-05").collect()}
    assert lines["s9"] == "20240103-00001T010000-s9" and lines["late"] == "20231201-00007T000000-late"


def test_split_and_sample(spark):
    lines = spark.createDataFrame([(f"line{i:03d}" + "x" * (i % 7),) for i in range(40)], "path string")
    parts = contrib.split_by_bytes(lines, "path", 4)
    assert {r.part for r in parts.collect()} == {0, 1, 2, 3} and parts.count() == 40
    assert [r.path[:7] for r in contrib.every_nth(lines, "path", 10).orderBy("path").collect()] == ["line009", "line019", "line029", "line039"]
