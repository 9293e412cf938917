"""Token files: concatenated ids with Elias-Fano encoded document boundaries.

A file holds ascending documents. Header (little-endian): magic, id width, rows, rows with a null doc_id,
smallest doc_id; then the Elias-Fano sequences of the document ends and of the doc_ids (less the
smallest), then the ids. An Elias-Fano sequence of n non-decreasing values below u takes about
n * (2 + log2(u / n)) bits: the low bits of each packed, the high bits in unary, and a sample of the
positions of every 256th one, so that `select` reads one short stretch. No 64-bit offsets are stored or made;
readers go from stretch to stretch; a file's first id has a place in the whole given by the prefix sum over the manifest (one row a file).

Defined results: a null text is empty, so a document of the end id alone; a null doc_id sorts first;
repeated rows are documents of their own, side by side; a table without rows has no files and gives no
rows; very long texts make a file of their own size, other files hold about `roll` ids; other columns are
never read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..files import get, put
from .common import new_path, running_over_parts, shuffles, tidied, written
from .tokens import encoder, slices

MAGIC = b"SLTK0001"
HEAD = struct.Struct("<8sBQQq")
EF_HEAD = struct.Struct("<QQB")
SAMPLE = 256


class EliasFano:
    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.high, self.samples = n, top, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, top, bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        parts = [EF_HEAD.pack(self.n, self.top, self.low_bits)]
        for x in (self.low, self.high, self.samples):
            parts += [struct.pack("<Q", x.nbytes), x.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, top, bits = EF_HEAD.unpack_from(raw, at)
        at, got = at + EF_HEAD.size, []
        for kind in ("u1", "u1", "<u4"):
            (size,) = struct.unpack_from("<Q", raw, at)
            got.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
            at += 8 + size
        return cls(n, top, bits, *got), at

    def _lows(self, a: int, b: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(b - a, np.int64)
        first, last = a * self.low_bits, b * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : -(-last // 8)], bitorder="little")[first % 8 :][: last - first]
        return bits.reshape(b - a, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.low_bits) | self._lows(0, self.n)

    def stretch(self, k: int) -> np.ndarray:
        """The values of ranks k * SAMPLE and on, SAMPLE of them or what is left: from the sample's place, reading on until they are found."""
        a, b = k * SAMPLE, min((k + 1) * SAMPLE, self.n)
        at = int(self.samples[k])
        # the next sample ends the search, where there is one
        end = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[at // 8 : -(-end // 8)], bitorder="little")[at % 8 :]
        ones = np.flatnonzero(bits)[: b - a] + at
        return ((ones - np.arange(a, b)) << self.low_bits) | self._lows(a, b)

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it on."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, seen = at // 8, 0
        skip = at % 8
        while True:
            bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            bits[:skip] = 0
            ones = np.flatnonzero(bits)
            if seen + len(ones) > left:
                return ((byte * 8 + int(ones[left - seen]) - i) << self.low_bits) | int(self._lows(i, i + 1)[0])
            seen, byte, skip = seen + len(ones), byte + 64, 0


def pack(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> list[bytes]:
    nulls = sum(d is None for d in doc_ids)
    there = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    least = int(there[0]) if len(there) else 0
    ends = np.cumsum([len(x) for x in ids])
    return [HEAD.pack(MAGIC, width, len(ids), nulls, least), EliasFano.of(ends).to_bytes(), EliasFano.of((there - least).astype(np.uint64)).to_bytes(), np.concatenate(ids).astype(f"<u{width}").tobytes()]


class TokenFile:
    """A file as it was written: its boundaries and doc_ids stay encoded and are found by select."""

    def __init__(self, raw: bytes):
        magic, width, self.rows, self.nulls, self.least = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends, at = EliasFano.from_bytes(raw, HEAD.size)
        self.keys, at = EliasFano.from_bytes(raw, at)
        self.ids = np.frombuffer(raw, f"<u{width}", offset=at)

    def document(self, i: int) -> tuple[int | None, int, int]:
        """doc_id, start and end of the i-th document."""
        key = None if i < self.nulls else self.keys.select(i - self.nulls) + self.least
        return key, self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def stretches(self):
        """(doc_ids, starts, ends) of all documents, a stretch of the sampled ranks at a time: no table of all offsets is made."""
        last, keys, k = 0, [None] * self.nulls, 0
        for j in range(-(-self.rows // SAMPLE)):
            ends = self.ends.stretch(j)
            while len(keys) < len(ends):
                keys += (self.keys.stretch(k) + self.least).tolist()
                k += 1
            starts = np.concatenate([[last], ends[:-1]])
            yield keys[: len(ends)], starts, ends
            last, keys = int(ends[-1]), keys[len(ends) :]


def write_files(docs: DataFrame, tokenizer: str, end_id: int | None = 2, roll: int = 4 << 20) -> DataFrame:
    """Writes all documents in ascending doc_id order. The manifest: path, part, seq, rows, ids, base (ids before the file)."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-files")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(shuffles(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def write(batches):
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        keys, ids, n = [], [], 0

        def flush():
            path = f"{folder}/part-{part:06d}-{seq:06d}.tok"
            put(path, b"".join(pack(keys, ids, enc.width)))
            return pa.RecordBatch.from_pydict({"path": [path], "part": [part], "seq": [seq], "rows": [len(keys)], "ids": [n]}, schema=kind)

        kind = pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("rows", pa.int64()), ("ids", pa.int64())])
        for some in slices(batches):
            for (d, _), x in zip(some, enc.ids([t for _, t in some], end_id), strict=True):
                keys.append(d)
                ids.append(x)
                n += len(x)
                if n >= roll:
                    yield flush()
                    keys, ids, n, seq = [], [], 0, seq + 1
        if keys:
            yield flush()

    files = written(rows.mapInArrow(tidied(write), "path string, part int, seq int, rows long, ids long"), "token-manifest")
    return running_over_parts(files, "part", ["seq"], {"base": "ids"})


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""

    def read(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file = TokenFile(get(path))
                for keys, starts, ends in file.stretches():
                    at = int(starts[0])
                    wide = memoryview(file.ids[at : int(ends[-1])].astype("<u4")).cast("B")
                    crc = [zlib.crc32(wide[4 * (a - at) : 4 * (e - at)]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("path", "base").repartition(shuffles(manifest.sparkSession), "path")
    return spread.mapInArrow(tidied(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
