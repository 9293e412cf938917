"""Reading packs: frames as a data source, objects by streaming each needed frame forward once."""

from __future__ import annotations

import hashlib
import itertools
import json
import struct
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..files import file_system
from ..model import SKIPPABLE_MAGIC, WINDOW_LOG_MAX, CorruptPack

CHUNK = 1 << 20
#: Bytes of a row of a frame's data: Spark gathers a thousand rows and more before it hands them on.
ROW = 1 << 16


def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(max_window_size=1 << WINDOW_LOG_MAX)


def header(uri: str) -> list[tuple[int, int, int]]:
    """(start, frame size, decompressed size) of each frame of a pack file, from its header; a file without one is a single frame of unknown size."""
    where, path = file_system(uri)
    with where.open_input_file(path) as f:
        magic, n = struct.unpack("<II", f.read_at(8, 0).ljust(8, b"\0"))
        if magic & 0xFFFFFFF0 != SKIPPABLE_MAGIC:
            return [(0, f.size(), -1)]
        made = json.loads(f.read_at(n, 8))
        if made.get("format") != "snaplake-pack-1":
            raise CorruptPack(f"{uri}: not a pack header")
        out, at = [], 8 + n
        for size, data in made["frames"]:
            out.append((at, size, data))
            at += size
        if at != f.size():
            raise CorruptPack(f"{uri}: {f.size()} bytes, the header says {at}")
        return out


class Frame(InputPartition):
    def __init__(self, number: int, start: int, size: int):
        super().__init__(number)
        self.start, self.size = start, size


class _Part:
    """The bytes of one frame, for a reader that would go on to the next."""

    def __init__(self, f, n: int):
        self.f, self.left = f, n

    def read(self, n: int = -1) -> bytes:
        data = self.f.read(self.left if n < 0 else min(n, self.left))
        self.left -= len(data)
        return data


class PackReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]
        self.wanted = json.loads(options["frames"]) if options.get("frames") else None

    def partitions(self) -> list[Frame]:
        frames = [Frame(i, start, size) for i, (start, size, _) in enumerate(header(self.uri))]
        return [f for f in frames if self.wanted is None or f.value in self.wanted]

    def read(self, partition: Frame) -> Iterator[tuple]:
        where, path = file_system(self.uri)
        at = 0
        with where.open_input_file(path) as f:
            f.seek(partition.start)
            with _decompressor().stream_reader(_Part(f, partition.size), closefd=False) as r:
                while data := r.read(ROW):
                    yield partition.value, at, data
                    at += len(data)


class Pack(DataSource):
    """format('pack'), options path and frames (a JSON list; others are never opened): the decompressed data in chunks, one partition a frame."""

    @classmethod
    def name(cls) -> str:
        return "pack"

    def schema(self) -> str:
        return "frame int, at long, data binary"

    def reader(self, schema) -> PackReader:
        return PackReader(self.options)


def pack_frames(spark: SparkSession, path: str, frames: list[int] | None = None) -> DataFrame:
    spark.dataSource.register(Pack)
    reader = spark.read.format("pack").option("path", path)
    return (reader.option("frames", json.dumps(frames)) if frames is not None else reader).load()


def write_spots(index: DataFrame, to: str) -> None:
    """index: frame, local_offset, size, checksum. A folder a frame, whose files by name have its objects in order of local_offset; those of no bytes are left out."""
    spots = index.filter("size > 0").select("frame", "local_offset", "size", "checksum")
    spots.repartitionByRange("frame", "local_offset").sortWithinPartitions("frame", "local_offset").write.partitionBy("frame").parquet(to)


def _spots(to: str, frame: int) -> Iterator[tuple[int, int, str]]:
    where, path = file_system(f"{to}/frame={frame}")
    for info in sorted(where.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda i: i.base_name):
        if info.base_name.endswith(".parquet"):
            with where.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(4096, columns=["local_offset", "size", "checksum"]):
                    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def cut_objects(chunks: Iterator[tuple[int, int, bytes]], to: str) -> Iterator[tuple[str, int, bool]]:
    """checksum, size and whether the bytes are its own, of each object in write_spots' folder, from the data of frames (frame, at, data): whole frames, each forward. One object is held at a time."""
    now, spots, spot, held, start, end = None, iter(()), None, bytearray(), 0, 0

    def rest():
        if spot is not None:
            yield spot[2], spot[1], False
        yield from ((checksum, size, False) for _, size, checksum in spots)

    for frame, at, data in chunks:
        if frame != now:
            yield from rest()
            now, spots, start, end = frame, _spots(to, frame), 0, 0
            held.clear()
            spot = next(spots, None)
        if at != end:
            raise CorruptPack(f"frame {frame}: data at {at} after {end} bytes")
        held += data
        end += len(data)
        while spot is not None and spot[0] + spot[1] <= end:
            done = spot[0] - start
            own = bytes(held[done : done + spot[1]])
            yield spot[2], spot[1], hashlib.sha1(own).hexdigest() == spot[2]
            spot = next(spots, None)
        if (gone := min(end, spot[0] if spot else end) - start) > 0:
            del held[:gone]
            start += gone
    yield from rest()


CUT = "checksum string, size long, whole boolean"


def cut_batches(chunks: Iterator[tuple[int, int, bytes]], to: str) -> Iterator[pa.RecordBatch]:
    """cut_objects in batches with the columns of CUT."""
    rows = cut_objects(chunks, to)
    while some := list(itertools.islice(rows, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), (pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["checksum", "size", "whole"])


def read_objects(index: DataFrame, frames: DataFrame, verify: bool = True) -> DataFrame:
    """checksum, size, content of the objects in index (frame, local_offset, size, checksum) from frames (frame, path, start).

    A frame is opened by one task, only if it holds a wanted object, and read forward: each distinct object once.
    """
    want = index.select("frame", "local_offset", "size", "checksum").distinct()
    want = want.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("local_offset", "size", "checksum"))).alias("objects"))
    met = want.join(frames.select("frame", "path", "start"), "frame").select("path", "start", "objects")

    def read(batches):
        for batch in batches:
            for path, start, objects in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                where, name = file_system(path)
                at, names, sizes, out, held = 0, [], [], [], 0
                with where.open_input_file(name) as f, _decompressor().stream_reader(f) as r:
                    f.seek(start)
                    for o in objects:
                        offset, size, checksum = (o[k].as_py() for k in ("local_offset", "size", "checksum"))
                        while at < offset:
                            at += len(_some(r, min(CHUNK, offset - at), path))
                        data = _exactly(r, size, path)
                        at += size
                        if verify and hashlib.sha1(data).hexdigest() != checksum:
                            raise CorruptPack(f"{path}: object {checksum} is damaged")
                        names.append(checksum)
                        sizes.append(size)
                        out.append(data)
                        held += size
                        if held > 8 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["checksum", "size", "content"])
                            names, sizes, out, held = [], [], [], 0
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["checksum", "size", "content"])

    spread = met.repartition(max(1, index.sparkSession.sparkContext.defaultParallelism), "path", "start")
    return spread.mapInArrow(read, "checksum string, size long, content binary")


PHASES = ("open", "skip", "read", "check")


def read_times(index: DataFrame, frames: DataFrame) -> DataFrame:
    """phase, seconds and share of the whole: where the time goes when the objects in index are read, as read_objects reads them."""
    want = index.select("frame", "local_offset", "size", "checksum").distinct()
    want = want.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("local_offset", "size", "checksum"))).alias("objects"))
    met = want.join(frames.select("frame", "path", "start"), "frame").select("path", "start", "objects")

    def read(batches):
        took = dict.fromkeys(PHASES, 0.0)
        for batch in batches:
            for path, start, objects in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                clock = time.perf_counter()

                def told(phase):
                    nonlocal clock
                    now = time.perf_counter()
                    took[phase] += now - clock
                    clock = now

                where, name = file_system(path)
                with where.open_input_file(name) as f, _decompressor().stream_reader(f) as r:
                    f.seek(start)
                    told("open")
                    at = 0
                    for o in objects:
                        offset, size, checksum = (o[k].as_py() for k in ("local_offset", "size", "checksum"))
                        while at < offset:
                            at += len(_some(r, min(CHUNK, offset - at), path))
                        told("skip")
                        data = _exactly(r, size, path)
                        at += size
                        told("read")
                        if hashlib.sha1(data).hexdigest() != checksum:
                            raise CorruptPack(f"{path}: object {checksum} is damaged")
                        told("check")
        yield pa.RecordBatch.from_pydict({"phase": list(took), "seconds": list(took.values())})

    spread = met.repartition(max(1, index.sparkSession.sparkContext.defaultParallelism), "path", "start")
    per = spread.mapInArrow(read, "phase string, seconds double").groupBy("phase").agg(F.sum("seconds").alias("seconds"))
    return per.withColumn("share", F.col("seconds") / F.sum("seconds").over(Window.partitionBy()))  # one row a phase


def _some(r, n: int, path: str) -> bytes:
    data = r.read(n)
    if not data:
        raise CorruptPack(f"{path}: ends early")
    return data


def _exactly(r, n: int, path: str) -> bytes:
    parts, left = [], n
    while left:
        parts.append(_some(r, left, path))
        left -= len(parts[-1])
    return b"".join(parts)

