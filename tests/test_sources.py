import os
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from snaplake.sinks.packs import join_frames, skippable, write_frames
from snaplake.sources import remotes
from snaplake.sources.packs import header, pack_frames, read_objects
from snaplake.sources.worktree import clean_file_list, file_list, worktree
from snaplake.streaming.ingest import append_changes, changes_stream, churn


def test_worktree_sees_everything(spark, tmp_path):
    for p, d in ((b".dot", b"1"), (b"_under", b""), (b"sub/.d/x", b"22"), (b"bad\xff", b"3"), (b"data/skip", b"no")):
        at = os.path.join(os.fsencode(str(tmp_path)), p)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(d)
    os.symlink("sub/.d/x", tmp_path / "link")
    os.symlink("nowhere", tmp_path / "dangling")
    os.symlink("..", tmp_path / "sub" / "loop")
    rows = worktree(spark, str(tmp_path), str(tmp_path / "data")).collect()
    got = {bytes(r.path): bytes(r.content) for r in rows}
    want = {b".dot": b"1", b"_under": b"", b"sub/.d/x": b"22", b"bad\xff": b"3", b"link": b"22"}
    assert {k: v for k, v in got.items() if not k.startswith(b"sub/loop")} == want
    assert all(r.mode & 0o170000 == 0o100000 and r.readable for r in rows)


def test_file_lists(spark, tmp_path):
    (tmp_path / "l").write_bytes(b"a\n\nb c\n")
    (tmp_path / "z").write_bytes(b"a\0b\nc\0\0")
    assert [r.path for r in file_list(spark, str(tmp_path / "l")).collect()] == ["a", "b c"]
    assert [r.path for r in file_list(spark, str(tmp_path / "z"), nul=True).collect()] == ["a", "b\nc"]
    os.makedirs(tmp_path / "w" / "data")
    for n in ("w/a", "w/data/x"):
        (tmp_path / n).write_text("1")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "path string")
    clean = lambda df: [r.path for r in clean_file_list(df, str(tmp_path / "w"), str(tmp_path / "w" / "data")).collect()]
    assert clean(names("a", "./a", "data/x")) == ["a", "a"]
    for bad in ("/etc/passwd", "missing"):
        with pytest.raises(Exception, match="path|file"):
            clean(names(bad))


def objects(spark):
    import hashlib

    rows, at = [], 0
    for i, d in enumerate([b"", b"a", b"bb" * 40, b"c" * 3000, b"d" * 3000]):
        rows.append((i // 3, at, len(d), hashlib.sha1(d).hexdigest(), bytearray(d)))
        at += len(d)
    return spark.createDataFrame(rows, "frame int, offset long, size long, checksum string, content binary")


def test_packs_round_trip(spark, tmp_path):
    rows = objects(spark)
    frames = spark.createDataFrame(write_frames(rows, f"file://{tmp_path}/data").collect(), "frame int, frame_size long, decompressed_size long, path string, start long")
    starts = {0: 0, 1: 81}
    index = rows.withColumn("local_offset", F.col("offset") - F.when(F.col("frame") == 1, starts[1]).otherwise(0)).drop("content")
    got = {r.checksum: bytes(r.content) for r in read_objects(index, frames).collect()}
    assert got == {r.checksum: bytes(r.content) for r in rows.collect()}
    to = str(tmp_path / "one.pack")
    size = join_frames([(r.path, r.frame_size, r.decompressed_size) for r in frames.orderBy("frame").collect()], to)
    assert size == os.path.getsize(to) and [h[2] for h in header(to)] == [81, 6000]
    whole = b"".join(bytes(r.content) for r in rows.orderBy("offset").collect())
    read = pack_frames(spark, to)
    assert read.rdd.getNumPartitions() == 2
    assert b"".join(bytes(r.data) for r in read.orderBy("frame", "at").collect()) == whole
    assert b"".join(bytes(r.data) for r in pack_frames(spark, to, [1]).collect()) == whole[81:]
    # any zstd reader skips the header
    with open(to, "rb") as f:
        assert zstandard.ZstdDecompressor(max_window_size=1 << 30).stream_reader(f, read_across_frames=True).read() == whole


def test_old_packs_are_one_frame(spark, tmp_path):
    (tmp_path / "old.pack").write_bytes(zstandard.compress(b"hello" * 100))
    assert b"".join(bytes(r.data) for r in pack_frames(spark, str(tmp_path / "old.pack")).collect()) == b"hello" * 100
    assert struct.unpack("<II", skippable(b"xy")[:8]) == (0x184D2A50, 2)


H = "ab" * 20
GOOD = f"meta v1\nurl  http://host/a/index.esi\n\n{H}\t {H.upper()} sub/p.pack\n{H} {H} https://other/q.pack\n{H} {H} /r.pack\n"


def parsed(spark, text):
    return remotes.parse_remotes(remotes.lines_of(spark.createDataFrame([("r", text)], "remote string, value string")))


def test_remote_index(spark):
    got = remotes.remote_packs(parsed(spark, GOOD)).orderBy("line").collect()
    assert [r.url for r in got] == ["http://host/a/sub/p.pack", "https://other/q.pack", "http://host/r.pack"]
    assert all(r.index_checksum == r.pack_checksum == H for r in got)
    assert remotes.read_index(GOOD)[2] == [(r.index_checksum, r.pack_checksum, r.url) for r in got]
    assert remotes.remote_packs(parsed(spark, "meta a\nurl http://h/\n")).count() == 0


@pytest.mark.parametrize("text", ["", "meta\nurl http://h/", "metav1\nurl http://h/", "meta v1 x\nurl http://h/", "meta v1\n", f"meta v1\nurl http://h/\n{H} {H}", f"meta v1\nurl http://h/\n{H}x {H} p", f"meta v1\nurl http://h/\n{H} {H[:-2]} p", f"meta v1\nurl http://h/\n{H} {H} p q"])
def test_bad_remote_index(spark, text):
    from snaplake.model import BadRemoteIndex

    rows = parsed(spark, text).collect()
    kinds = {r.kind for r in rows}
    assert any(r.error for r in rows) or not {"meta", "url"} <= kinds
    with pytest.raises(BadRemoteIndex):
        remotes.read_index(text)


def test_index_files_and_transport(spark, tmp_path):
    import datetime

    (tmp_path / "x.esi").write_text(GOOD)
    (tmp_path / "y.esi").write_text(GOOD)
    rows = remotes.remote_packs(remotes.parse_remotes(remotes.remote_lines(spark, f"{tmp_path}/*.esi")))
    assert {r.remote for r in rows.collect()} == {"x", "y"} and rows.count() == 6
    seen = {}

    def transport(url, headers, timeout):
        seen.update(headers)
        return (304, b"") if headers else (500, b"") if "bad" in url else (200, b"body")

    assert remotes.http_get("u", transport=transport) == b"body"
    assert remotes.http_get("u", datetime.datetime(1970, 1, 1), transport=transport) is None
    assert seen["If-Modified-Since"] == "Thu, 01 Jan 1970 00:00:00 GMT"
    with pytest.raises(OSError):
        remotes.http_get("bad", transport=transport)


def test_streaming_log(spark, tmp_path):
    row = ("p", 0, "A", "x", "c", 1, 5)
    kind = "pack string, seq int, op string, path string, checksum string, mode long, size long"
    src, log, ck = (str(tmp_path / n) for n in ("in", "log", "ck"))
    for batch in range(2):
        spark.createDataFrame([row, row, ("p", batch + 1, "A", "y", "c", 1, 7)], kind).coalesce(1).write.mode("append").parquet(src)
        append_changes(changes_stream(spark, src), log, ck).awaitTermination()
    got = spark.read.parquet(log)
    assert got.count() == 4 and got.filter("path = 'y'").count() == 2
    q = churn(changes_stream(spark, src)).writeStream.format("memory").queryName("churn").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("churn").count() == 3


def test_objects_are_cut_out_of_frames(spark, tmp_path):
    """Objects across chunks, damaged ones and ones that are not there, in two frames."""
    from snaplake.sources.packs import cut_objects, write_spots

    rows = objects(spark).withColumn("local_offset", F.col("offset") - F.when(F.col("frame") == 1, 81).otherwise(0))
    to = f"file://{tmp_path}/spots"
    write_spots(rows, to)
    names = {(r.frame, r.local_offset): r.checksum for r in rows.filter("size > 0").collect()}

    def chunks(frame, data, n):
        return [(frame, at, data[at : at + n]) for at in range(0, len(data), n)]

    first, second = b"a" + b"bb" * 40, b"c" * 3000 + b"d" * 3000
    for n in (1, 7, 81, 10_000):
        got = {checksum: whole for checksum, _, whole in cut_objects(iter(chunks(0, first, n) + chunks(1, second, n)), to)}
        assert got == dict.fromkeys(names.values(), True)
    got = {checksum: whole for checksum, _, whole in cut_objects(iter(chunks(1, second[:2999] + b"x" + second[3000:5000], 100)), to)}
    assert got == {names[1, 0]: False, names[1, 3000]: False}


def test_contents_find_their_frames_and_are_written_once(spark, tmp_path):
    from snaplake.sinks.packs import placed_contents

    rows = objects(spark)
    firsts = [(r.frame, r.size, r.checksum) for r in rows.filter("offset in (0, 81) and (size = 0 or frame = 1)").collect()]
    twice = rows.select("content").union(rows.select("content"))
    made = write_frames(placed_contents(twice, firsts), f"file://{tmp_path}/data", packed=True).collect()
    assert sorted((r.frame, r.decompressed_size) for r in made) == [(0, 81), (1, 6000)]
    for frame, data in ((0, rows.filter("frame = 0")), (1, rows.filter("frame = 1"))):
        path = next(r.path for r in made if r.frame == frame).removeprefix("file://")
        with open(path, "rb") as f:
            assert zstandard.ZstdDecompressor(max_window_size=1 << 30).stream_reader(f).read() == b"".join(bytes(r.content) for r in data.orderBy("size", "checksum").collect())
