"""Media columns: signature sniffing, validated types and carved embedded media.

One Aho-Corasick automaton finds the magic bytes of all formats in a single pass over the bytes; a format's
validator then walks its structure from there (chunk lengths, checksums, end marks) and gives the length
of the medium, or nothing. The valid medium at offset 0 is the true type, whatever was declared; those
further on are embedded and can be carved by offset and length.

`store` keeps a payload losslessly as the samples of 8-bit mono PCM WAV, and `payload_of` reads it back
from the stored bytes through the sniffer.

Defined results: null content is empty; an empty or unknown medium has type application/octet-stream; of
equal offsets the longer match wins; media of another format inside containers (PDF, ZIP, OGG, WAV) are reported beside them, those inside
images not; a very long text is one medium (a WAV file holds less than 4 GiB: beyond that an error); for a table of
documents, a null text is an empty payload, padded to 64 zero bytes; a null doc_id stays null; repeated
rows give repeated rows; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied, written
from .tokens import slices

UNKNOWN = "application/octet-stream"


class Scan:
    """Content under validation. What one validator has found out is kept for the next: marks that are searched for again and
    again, and places from which a walk is known to fail; so many signatures without a medium behind them cost one pass, not one each."""

    def __init__(self, content: bytes | memoryview):
        self.raw = bytes(content)
        self.b = memoryview(self.raw)
        self.marks: dict[bytes, tuple[int, int]] = {}
        self.dead: set[tuple[str, int]] = set()

    def find(self, mark: bytes, at: int) -> int:
        """The first place of mark at or after `at`, -1 if there is none."""
        since, place = self.marks.get(mark, (0, -2))
        if place == -2 or at < since or -1 < place < at:
            place = self.raw.find(mark, at)
            self.marks[mark] = (at, place)
        return place

    def fails(self, kind: str, places: list[int]) -> None:
        """Notes that walks of this kind fail from these places on."""
        self.dead.update((kind, p) for p in places)


def _riff(scan: Scan, at: int) -> tuple[str, int] | None:
    b = scan.b
    if len(b) - at < 20:
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end = at + 8 + size
    if end > len(b) or form not in (b"WAVE", b"WEBP"):
        return None
    chunks, p = [], at + 12
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, p)
        chunks.append(name)
        p += 8 + n + n % 2
    if p not in (end, end + 1):
        return None
    if form == b"WAVE" and chunks[:1] == [b"fmt "] and b"data" in chunks:
        return "audio/wav", end - at
    if form == b"WEBP" and chunks and chunks[0] in (b"VP8 ", b"VP8L", b"VP8X"):
        return "image/webp", end - at
    return None


def _png(scan: Scan, at: int) -> tuple[str, int] | None:
    b, p, passed = scan.b, at + 8, []
    while p + 12 <= len(b) and ("png", p) not in scan.dead:
        n, name = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or (not passed) != (name == b"IHDR" and n == 13):
            break
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            break
        passed.append(p)
        p += 12 + n
        if name == b"IEND":
            return "image/png", p - at
    scan.fails("png", [*passed[1:], p] if passed else [])
    return None


def _gif(scan: Scan, at: int) -> tuple[str, int] | None:
    b = scan.b
    if len(b) - at < 14 or bytes(b[at + 3 : at + 6]) not in (b"87a", b"89a"):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    passed = []

    def blocks(p: int) -> int:
        """Past the sub-blocks that start at p; past the end where they lead to a failure."""
        while p < len(b) and b[p]:
            if ("gif", p) in scan.dead:
                return len(b)
            passed.append(p)
            p += 1 + b[p]
        return p + 1

    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return "image/gif", p + 1 - at
        if kind == 0x21:
            p = blocks(p + 2)
        elif kind == 0x2C and p + 10 < len(b):
            own = b[p + 9]
            p = blocks(p + 10 + (3 << (own & 7) + 1 if own & 0x80 else 0) + 1)
        else:
            break
    scan.fails("gif", passed)
    return None


def _jpeg(scan: Scan, at: int) -> tuple[str, int] | None:
    b, p, passed = scan.b, at + 2, []
    while p + 4 <= len(b) and b[p] == 0xFF and ("jpeg", p) not in scan.dead:
        mark, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or mark in (0x00, 0xFF, 0xD8, 0xD9):
            break
        passed.append(p)
        p += 2 + n
        if mark == 0xDA:
            end = scan.find(b"\xff\xd9", p)
            return ("image/jpeg", end + 2 - at) if end >= 0 else None
    scan.fails("jpeg", passed)
    return None


def _bmp(scan: Scan, at: int) -> tuple[str, int] | None:
    b = scan.b
    if len(b) - at < 26:
        return None
    size, _, _, pixels, header = struct.unpack_from("<IHHII", b, at + 2)
    if header not in (12, 40, 52, 56, 64, 108, 124) or not 14 + header <= pixels <= size or at + size > len(b):
        return None
    return "image/bmp", size


def _pdf(scan: Scan, at: int) -> tuple[str, int] | None:
    end = scan.find(b"%%EOF", at)
    return ("application/pdf", end + 5 - at) if end >= 0 and 0x30 <= scan.b[at + 5] <= 0x39 else None


def _gzip(scan: Scan, at: int) -> tuple[str, int] | None:
    b, d, p = scan.b, zlib.decompressobj(31), at
    try:
        while p < len(b) and not d.eof:
            d.decompress(b[p : p + 65536], 1 << 20)
            while d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 20)
            p += 65536
    except zlib.error:
        return None
    return ("application/gzip", min(p, len(b)) - len(d.unused_data) - at) if d.eof else None


def _zip(scan: Scan, at: int) -> tuple[str, int] | None:
    b, p = scan.b, scan.find(b"PK\x05\x06", at)
    if p < 0 or p + 22 > len(b):
        return None
    size, start, note = struct.unpack_from("<IIH", b, p + 12)
    if start + size != p - at or p + 22 + note > len(b) or (size and b[at + start : at + start + 4] != b"PK\x01\x02"):
        return None
    return "application/zip", p + 22 + note - at


def _ogg(scan: Scan, at: int) -> tuple[str, int] | None:
    b, p, passed = scan.b, at, []
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS" and b[p + 4] == 0 and ("ogg", p) not in scan.dead:
        n = b[p + 26]
        if p + 27 + n > len(b):
            break
        passed.append(p)
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
    else:
        if passed and p <= len(b) and ("ogg", p) not in scan.dead:
            return "application/ogg", p - at
    scan.fails("ogg", passed)
    return None


#: The magic bytes of the formats, as published.
MAGIC = {
    b"RIFF": _riff,
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF8": _gif,
    b"\xff\xd8\xff": _jpeg,
    b"BM": _bmp,
    b"%PDF-": _pdf,
    b"\x1f\x8b\x08": _gzip,
    b"PK\x03\x04": _zip,
    b"OggS": _ogg,
}


@lru_cache(None)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, check in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic), check))
    a.make_automaton()
    return a


#: Types whose inside is searched too; what an image holds (a thumbnail) is part of it.
CONTAINERS = ("application/pdf", "application/zip", "application/ogg", "audio/wav")


def sniff(content: bytes | memoryview) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the valid media in content, in order of offset: those of other types inside a container too, those inside other media not."""
    scan = Scan(content)
    found, past, ends = [], 0, {}  # ends: of the last container that each validator found
    for last, (n, check) in _automaton().iter(scan.raw.decode("latin-1")):
        at = last - n + 1
        if at >= past and at >= ends.get(check, 0) and (got := check(scan, at)):
            found.append((at, got[1], got[0]))
            if got[0] in CONTAINERS:
                ends[check] = at + got[1]
            else:
                past = at + got[1]
    return found


def true_type(content: bytes) -> str:
    found = sniff(content)
    return found[0][2] if found and found[0][0] == 0 else UNKNOWN


def described(content: bytes, declared: str | None) -> tuple[str, bool, list[tuple[int, int, str]]]:
    """The true type, whether it is the declared one, and the embedded media (offset, length, type)."""
    found = sniff(content)
    kind = found[0][2] if found and found[0][0] == 0 else UNKNOWN
    return kind, kind == declared, [f for f in found if f[0]]


SNIFFED = "id long, declared string, type string, agrees boolean, embedded array<struct<offset:long,length:long,type:string>>"


def sniff_column(df: DataFrame, id_col: str, content_col: str, declared_col: str) -> DataFrame:
    """id, declared, type (the true one), agrees, embedded media (offset, length, type) of a column of media."""

    def run(batches):
        for batch in batches:
            rows = []
            for d, c, t in zip(*[batch.column(i) for i in range(3)], strict=True):
                kind, agrees, inner = described(c.as_py() or b"", t.as_py())
                embedded = [{"offset": o, "length": n, "type": k} for o, n, k in inner]
                rows.append({"id": d.as_py(), "declared": t.as_py(), "type": kind, "agrees": agrees, "embedded": embedded})
            one = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("declared", pa.string()), ("type", pa.string()), ("agrees", pa.bool_()), ("embedded", pa.list_(one))]))

    return df.select(F.col(id_col).cast("long"), F.col(content_col).cast("binary"), F.col(declared_col).cast("string")).mapInArrow(tidied(run), SNIFFED)


def carve(content: bytes) -> list[bytes]:
    """The bytes of the embedded media, those in containers included."""
    return [bytes(content[o : o + n]) for o, n, _ in sniff(content) if o]


RATE = 8000
DECLARED = "audio/wav"


def store(payload: bytes) -> bytes:
    """Payload, padded with zero bytes to a positive multiple of 64, as the samples of 8-bit mono PCM WAV."""
    n = max(64, -(-len(payload) // 64) * 64)
    if n + 36 >= 1 << 32:
        raise ValueError("a WAV file holds less than 4 GiB")
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", n + 36, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)
    return head + payload + bytes(n - len(payload))


def payload_of(media: bytes) -> memoryview:
    """The samples of a stored medium, found through its signature and structure."""
    b = memoryview(media)
    got = _riff(Scan(media), 0) if bytes(b[:4]) == b"RIFF" else None
    if not got or got[0] != "audio/wav":
        raise ValueError("not a stored payload")
    p = 12
    while True:
        name, n = struct.unpack_from("<4sI", b, p)
        if name == b"data":
            return b[p + 8 : p + 8 + n]
        p += 8 + n + n % 2


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, type string, agrees boolean"


def features(docs: DataFrame) -> DataFrame:
    """Stores every whole text as a medium of a declared type in a table in the shared folder, reads it back, checks the type by the bytes, and computes features."""

    def put(batches):
        for some in slices(batches):
            raw = [t.encode() for _, t in some]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array([DECLARED] * len(some)), pa.array([store(r) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    stored = written(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidied(put), "doc_id long, n_bytes long, declared string, media binary"), "media")

    def read(batches):
        for batch in batches:
            rows = []
            for d, n, t, m in zip(*batch.columns, strict=True):
                media = m.as_py()
                kind, agrees, inner = described(media, t.as_py())
                payload = payload_of(media)
                x = np.frombuffer(payload, np.uint8)
                level = int(x.sum(dtype=np.int64)) // len(x)
                turns = int(np.count_nonzero(np.diff(x >= 128)))
                text = f"{kind};rate={RATE};samples={len(x)};level={level};turns={turns};embedded={len(inner)}"
                rows.append((d.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), text, kind, agrees))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            cols = list(zip(*rows, strict=True)) or [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return stored.mapInArrow(tidied(read), FEATURES)
