"""Writing packs: one task streams a frame's objects through a compressor into a file of its own; frames can be joined into one file."""

from __future__ import annotations

import bisect
import hashlib
import json
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ..files import Writer, file_system
from ..model import COMPRESSION_LEVEL, SKIPPABLE_MAGIC, WINDOW_LOG, CorruptPack

FRAMES = "frame int, frame_size long, decompressed_size long, path string, start long"


def compressor(level: int, size: int) -> zstandard.ZstdCompressor:
    """Long-distance matching over a window as large as the frame, up to 256 MiB."""
    window = max(10, min(WINDOW_LOG, max(size, 1).bit_length()))
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(level, window_log=window, enable_ldm=True))


def placed_contents(contents: DataFrame, starts: list[tuple[int, int, str]]) -> DataFrame:
    """The contents (one binary column, equal ones among them) as packed objects for write_frames. starts: frame, size and checksum of each frame's first object.

    A layout is in order of size and checksum, so a content alone tells its frame: nothing is joined or sorted before the
    frames are made. A task tells a content once, compressed by itself.
    """
    starts = sorted(starts)
    firsts = [(size, checksum) for _, size, checksum in starts]

    def place(batches):
        z, seen = zstandard.ZstdCompressor(), set()
        for batch in batches:
            out = [], [], [], []
            for content in batch.column(0):
                data = content.as_py()
                checksum = hashlib.sha1(data)
                if checksum.digest() not in seen:
                    seen.add(checksum.digest())
                    at = bisect.bisect_right(firsts, (len(data), checksum.hexdigest())) - 1
                    for column, value in zip(out, (starts[at][0], len(data), checksum.hexdigest(), z.compress(data)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["frame", "offset", "checksum", "content"])

    # sizes stand for offsets: they have the same order
    return contents.mapInArrow(place, "frame int, offset long, checksum string, content binary")


def write_frames(objects: DataFrame, folder: str, level: int = COMPRESSION_LEVEL, most: int = 1 << WINDOW_LOG, packed: bool = False) -> DataFrame:
    """objects: frame, offset, size, checksum, content. Writes folder/frame-<n>.zst and tells each frame's sizes. Contents are checked against their checksums. most: bytes of the largest frame, if known to be few.

    An object that is told again is written once. packed: contents are compressed one by one (placed_contents).
    """
    sized = objects.select("frame", "offset", "checksum", "content")

    def write(batches):
        now, last, out, z, total, stored = None, None, None, None, 0, 0
        unpack = zstandard.ZstdDecompressor().decompress if packed else bytes
        kind = pa.schema([("frame", pa.int32()), ("frame_size", pa.int64()), ("decompressed_size", pa.int64()), ("path", pa.string()), ("start", pa.int64())])

        def finish():
            nonlocal stored
            rest = z.flush()
            out.write(rest)
            out.__exit__(None)
            path = f"{folder}/frame-{now:06d}.zst"
            return pa.RecordBatch.from_pydict({"frame": [now], "frame_size": [stored + len(rest)], "decompressed_size": [total], "path": [path], "start": [0]}, schema=kind)

        for batch in batches:
            for frame, checksum, content in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if frame != now:
                    if now is not None:
                        yield finish()
                    now, last, total, stored = frame, None, 0, 0
                    out, z = Writer(f"{folder}/frame-{frame:06d}.zst"), compressor(level, most).compressobj()
                if checksum == last:
                    continue
                last, data = checksum, unpack(content.as_py())
                if hashlib.sha1(data).hexdigest() != checksum:
                    raise CorruptPack(f"object {checksum} is damaged")
                some = z.compress(data)
                out.write(some)
                total, stored = total + len(data), stored + len(some)
        if now is not None:
            yield finish()

    n = max(1, objects.sparkSession.sparkContext.defaultParallelism)
    return sized.repartition(n, "frame").sortWithinPartitions("frame", "offset", "checksum").mapInArrow(write, FRAMES)


def skippable(data: bytes) -> bytes:
    """A zstd frame that decoders skip."""
    return struct.pack("<II", SKIPPABLE_MAGIC, len(data)) + data


def join_frames(frames: list[tuple[str, int, int]], to: str) -> int:
    """One pack file: a header in a skippable frame, then the frames (path, size, decompressed size). Streams; returns its size."""
    head = skippable(json.dumps({"format": "snaplake-pack-1", "frames": [[s, d] for _, s, d in frames]}).encode())
    n = len(head)
    with Writer(to) as w:
        w.write(head)
        for path, size, _ in frames:
            where, name = file_system(path)
            with where.open_input_stream(name, compression=None) as f:
                while data := f.read(1 << 20):
                    w.write(data)
            n += size
    return n
