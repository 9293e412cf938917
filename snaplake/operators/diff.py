"""Differences between states, plans to extract, and checksums of snapshots."""

from __future__ import annotations

import bisect
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import hexed

ROW = ["path", "checksum", "mode"]


def snapshot_checksum(files: DataFrame, keys: list[str]) -> DataFrame:
    """One SHA-1 a snapshot over its rows in order of (checksum, path): path bytes, 20 checksum bytes, mode as 4 big-endian bytes.

    checksum is lower hex here. The hash is defined over all rows of a snapshot in order, so one task sees them all, but as a
    sorted stream (sorting spills): what it holds is one batch of rows and one hash.
    """
    path = F.col("path").cast("binary")
    row = F.concat(path, F.unhex("checksum"), F.unhex(F.lpad(F.hex("mode"), 8, "0")))
    rows = files.select(*keys, F.col("checksum").alias("__checksum"), path.alias("__path"), row.alias("__row"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "__checksum", "__path").select(*keys, "__row")
    kinds = rows.select(*keys).schema

    def digest(batches):
        now, hash_, made = None, None, []

        def told():
            out = pa.RecordBatch.from_arrays([pa.array([m[0][i] for m in made], k) for i, k in enumerate(types)] + [pa.array([m[1] for m in made])], names=[*keys, "fingerprint"])
            made.clear()
            return out

        types = None
        for b in batches:
            types = [c.type for c in b.columns[:-1]]
            of = list(zip(*[c.to_pylist() for c in b.columns[:-1]], strict=True))
            at = 0
            while at < len(of):
                # keys are sorted: the rows of one snapshot end where its key ends
                to = bisect.bisect_right(range(len(of)), False, at, key=lambda i, first=of[at]: of[i] != first)
                if of[at] != now:
                    if hash_:
                        made.append((now, hash_.hexdigest()))
                    now, hash_ = of[at], hashlib.sha1()
                hash_.update(b"".join(b.column(len(keys)).slice(at, to - at).to_pylist()))
                at = to
            if made:
                yield told()
        if hash_:
            made.append((now, hash_.hexdigest()))
            yield told()

    return rows.mapInArrow(digest, T.StructType([*kinds.fields, T.StructField("fingerprint", T.StringType())]))


def entry_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows in one state only: change 'removed' or 'added'. Equal rows count once."""
    a, b = old.select(*ROW).distinct(), new.select(*ROW).distinct()
    return a.join(b, ROW, "left_anti").withColumn("change", F.lit("removed")).union(b.join(a, ROW, "left_anti").withColumn("change", F.lit("added")))


def extract_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and kind: A (to add), M (to replace), D (to delete)."""
    diff = entry_diff(old, new).groupBy("path").agg(F.max((F.col("change") == "added").cast("int")).alias("a"), F.max((F.col("change") == "removed").cast("int")).alias("r"))
    kind = F.when((F.col("a") == 1) & (F.col("r") == 1), "M").when(F.col("a") == 1, "A").otherwise("D")
    return diff.select("path", kind.alias("kind"))


def extract_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("kind").agg(F.count(F.lit(1)).alias("files"))


def equal_snapshots(fingerprints: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all snapshots of a group have one content."""
    return fingerprints.groupBy(*keys).agg((F.count_distinct("fingerprint") == 1).alias("equal"))


def dirty(old: DataFrame, plan: DataFrame, worktree: DataFrame, head_time: Column) -> DataFrame:
    """Paths about to be changed that are missing from the work tree, or newer than HEAD."""
    mine = old.join(plan.filter("kind <> 'A'").select("path"), "path", "left_semi").select("path").distinct()
    seen = worktree.select("path", "last_modified")
    held = mine.join(seen, "path", "left")
    return held.filter(F.col("last_modified").isNull() | (F.col("last_modified") > head_time)).select("path", F.when(F.col("last_modified").isNull(), "missing").otherwise("touched").alias("reason"))


def empty_dirs(removed: DataFrame, kept: DataFrame) -> DataFrame:
    """Directories that hold nothing once `removed` paths are gone, deepest first by depth."""

    def above(paths: DataFrame) -> DataFrame:
        # by bytes: names need not be UTF-8
        text = F.col("path").cast("string")
        deep = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("/"), F.lit("")))
        ups = paths.filter(deep > 0).select(text.alias("__p"), F.explode(F.sequence(F.lit(1), deep)).alias("depth"))
        return ups.select(F.expr("substring_index(__p, '/', depth)").alias("dir"), F.col("depth").cast("int").alias("depth")).distinct()

    return above(removed).join(above(kept), "dir", "left_anti")


def verify(objects: DataFrame) -> DataFrame:
    """checksum, content: whether the content has the checksum (missing content: no)."""
    return objects.withColumn("ok", F.coalesce(F.sha1("content").eqNullSafe(hexed(F.col("checksum"))) & F.col("content").isNotNull(), F.lit(False)))
