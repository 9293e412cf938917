import gzip
import hashlib
import io
import random
import struct
import time
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from snaplake.llm import media
from snaplake.llm.queries import QUERIES


def png():
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + bytes(8) + b"\x00" + b"\x02\x02\x44\x01\x00" + b";"


def bmp():
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 58, 0, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)


def jpeg():
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"JF" + b"\xff\xda" + struct.pack(">H", 3) + b"\x01" + b"data" + b"\xff\xd9"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "hello")
    return out.getvalue()


def webp():
    body = b"VP8L" + struct.pack("<I", 4) + b"abcd"
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


KNOWN = {"image/png": png(), "image/gif": gif(), "image/bmp": bmp(), "image/jpeg": jpeg(), "application/zip": zipped(), "application/gzip": gzip.compress(b"x" * 100), "image/webp": webp(), "audio/wav": media.store(b"hi"), "application/pdf": b"%PDF-1.4\n...\n%%EOF", "application/ogg": b"OggS\0" + bytes(21) + b"\x01\x03abc"}


@pytest.mark.parametrize("kind", sorted(KNOWN))
def test_types(kind):
    data = KNOWN[kind]
    assert media.sniff(data) == [(0, len(data), kind)] and media.true_type(data) == kind
    inside = b"junk BM GIF8 RIFF" + data + b" tail"
    assert media.sniff(inside) == [(17, len(data), kind)] and media.carve(inside) == [data]
    assert media.true_type(inside) == media.UNKNOWN
    if kind not in ("application/pdf", "image/jpeg"):
        assert media.sniff(data[: len(data) - 2]) == []


@pytest.mark.parametrize("text", [b"%PDF-1 ", b"PK\x03\x04", b"\xff\xd8\xff\xe0\0\4ab", b"OggS" + bytes(22) + b"\x01\x00", b"GIF89a" + bytes(7) + b"\x21\xfe\x01a", png()[:33]])
def test_many_signatures_without_a_medium_take_one_pass(text):
    began = time.process_time()
    found = media.sniff(text * (10_000_000 // len(text)) + (b"OggS" + bytes(22) + b"\xff" if text[:1] == b"O" else b""))
    assert time.process_time() - began < 20 and not found


def test_media_in_containers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.png", png())
        z.writestr("b.gif", gif())
    pdf = b"%PDF-1.4\nstream\n" + jpeg() + b"\nendstream\n%%EOF"
    assert [t for _, _, t in media.sniff(out.getvalue())] == ["application/zip", "image/png", "image/gif"] and media.carve(out.getvalue()) == [png(), gif()]
    assert media.carve(b"x" + pdf) == [pdf, jpeg()] and media.carve(pdf) == [jpeg()] and media.true_type(pdf) == "application/pdf"


def test_damage_is_no_medium():
    bad = bytearray(png())
    bad[30] ^= 1
    assert media.sniff(bytes(bad)) == [] and media.sniff(b"") == []


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.sampled_from(sorted(KNOWN)))
def test_anything_goes(data, kind):
    media.sniff(data)
    media.sniff(KNOWN[kind][: len(data)] + data)
    assert bytes(media.payload_of(media.store(data))).rstrip(b"\0") == data.rstrip(b"\0")


def test_column(spark):
    rows = [(1, bytearray(png()), "image/jpeg"), (2, bytearray(b"RIFF" + png() + gif()), None), (3, None, "x"), (4, bytearray(b""), media.UNKNOWN)]
    got = {r.id: r for r in media.sniff_column(spark.createDataFrame(rows, "k long, c binary, t string"), "k", "c", "t").collect()}
    assert (got[1].type, got[1].agrees, got[1].embedded) == ("image/png", False, [])
    assert [(e.offset, e.type) for e in got[2].embedded] == [(4, "image/png"), (4 + len(png()), "image/gif")]
    assert got[3].type == media.UNKNOWN and got[4].agrees


def reference(text):
    raw = (text or "").encode()
    return raw, raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def test_features(spark):
    texts = [None, "", "a", "x" * 64, "x" * 65, "é" * 1000, "RIFF BM GIF89a \x00", "a", "".join(random.Random(1).choices("abc \n", k=50000))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "n", 1)], "doc_id long, text string, media int")
    got = {r.doc_id: r for r in media.features(df).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        raw, padded = reference(t)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_bytes == len(padded) + 44 and r.feature.startswith("audio/wav;") and r.type == "audio/wav" and r.agrees
    assert got[0][1:] == got[1][1:] and got[2][1:] == got[7][1:]
    assert media.features(df.limit(0)).count() == 0


def test_feature_is_what_the_samples_say(spark):
    texts = ["abc", "é~" * 40, "RIFF" + "x" * 100, "GIF89a" + "\0" * 7 + ";"]
    got = {r.doc_id: r.feature for r in media.features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        x = reference(t)[1]
        turns = sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:], strict=False))
        assert got[i] == f"audio/wav;rate=8000;samples={len(x)};level={sum(x) // len(x)};turns={turns};embedded={int(t[:3] == 'GIF')}"


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["op5_media_columns"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.payload_sha256 for r in got} == {d: hashlib.sha256(reference(t)[1]).hexdigest() for d, t in docs.items()}
