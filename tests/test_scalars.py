import datetime
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snaplake.functions import scalars as S


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("text,ok", [("nightly", True), ("R2D2", True), ("_x_", True), ("-", True), ("week-07_b", True), ("a/b", True), ("", True), ("a b", False), ("naïve", False), ("a.b", False), ("a:b", False)])
def test_id_valid(spark, text, ok):
    assert one(spark, S.id_valid(F.lit(text))) is ok


@pytest.mark.parametrize("text,want", [("p:t", ("p", "t")), ("a/b:t\n", ("a/b", "t")), ("a:b:c", None), ("p:", None), (":t", None), ("pt", None), ("p:t.x", ("p", "t.x"))])
def test_snapshot_id(spark, text, want):
    got = one(spark, S.snapshot_id(F.lit(text)))
    assert (got and (got.pack, got.tag)) == want


def test_sizes(spark):
    sizes = [0, 1, 999, 1023, 1024, 1025, 1536, 1048575, 1048576, 5 << 20, 123456789, 1 << 30, 3 << 40, 1023 << 40]

    def ref(n):
        for k, u in enumerate("BKMGT"):
            if n < 1024 ** (k + 1) or u == "T":
                return f"{round(n / 1024**k, 3):.3f}".rstrip("0").rstrip(".") + u

    df = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", S.format_size(F.col("n")).alias("t"))
    assert {r.n: r.t for r in df.collect()} == {n: ref(n) for n in sizes}


def test_loose_paths(spark):
    h = hashlib.sha1(b"x").hexdigest()
    assert one(spark, S.loose_path(F.lit(h))) == f"{h[:2]}/{h[2:4]}/{h[4:]}"
    assert one(spark, S.loose_checksum(F.lit(f"loose/{h[:2]}/{h[2:4]}/{h[4:]}"))) == h
    assert one(spark, S.loose_checksum(F.lit("loose/ab/cd/ef"))) is None
    assert one(spark, S.loose_checksum(F.lit("ef"))) is None


def test_replacement_is_sequential(spark):
    assert one(spark, S.formatted("%s|%t", [("%s", F.lit("a%t")), ("%t", F.lit("z"))])) == "az|z"


def test_dates(spark):
    assert one(spark, S.http_date(F.timestamp_seconds(F.lit(0)))) == "Thu, 01 Jan 1970 00:00:00 GMT"
    early, late = datetime.datetime(2020, 1, 1), datetime.datetime(2021, 1, 1)
    assert one(spark, S.last_modified(F.lit(early), F.lit(late))) == late
    assert one(spark, S.last_modified(F.lit(None).cast("timestamp"), F.lit(early))) == early


@pytest.mark.parametrize("total,n", [(0, 0), (1, 1), (512 << 20, 1), ((512 << 20) + 1, 2)])
def test_frame_hint(spark, total, n):
    assert one(spark, S.frame_hint(F.lit(total).cast("long"))) == n


def test_names(spark):
    assert one(spark, S.pack_file_name(F.lit("http://h/a/b.pack"))) == "b.pack"
    assert one(spark, S.without_version(F.lit("clang++-14"))) == "clang++"
    assert one(spark, S.function_safe(F.lit("a/b.c+d"))) == "a_b_c+d"


@settings(max_examples=15, deadline=None)
@given(st.binary(max_size=40))
def test_hashes(spark, data):
    assert one(spark, S.object_checksum(F.lit(bytearray(data)))) == hashlib.sha1(data).hexdigest()
