"""Listing, searching, resolving and collecting garbage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import format_size, formatted, hexed, is_loose, octal_mode

AMBIGUOUS = "AMBIGUOUS"


def snapshot_lines(per: DataFrame, template: str = "%s") -> DataFrame:
    """per: pack, tag, files, bytes. One line a snapshot."""
    fields = [("%s", F.concat_ws(":", "pack", "tag")), ("%t", F.col("tag")), ("%h", format_size(F.col("bytes"))), ("%b", F.col("bytes")), ("%n", F.col("files"))]
    return per.select(formatted(template, fields).alias("line"))


def list_snapshots(files: DataFrame, template: str = "%s") -> DataFrame:
    """The same from the snapshots' files: pack, seq, tag, size."""
    return snapshot_lines(files.groupBy("pack", "seq", "tag").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")), template)


def list_packs(snapshots: DataFrame, pack_sizes: DataFrame, template: str = "%p") -> DataFrame:
    """One line a pack; a pack without a file (a loose one) has size 0."""
    per = snapshots.groupBy("pack").agg(F.count(F.lit(1)).alias("n")).join(pack_sizes, "pack", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    fields = [("%p", F.col("pack")), ("%c", F.col("n")), ("%b", F.col("bytes")), ("%h", format_size(F.col("bytes")))]
    return per.select(formatted(template, fields).alias("line"))


def list_files(files: DataFrame, template: str = "%o %b %f") -> DataFrame:
    fields = [("%o", F.col("checksum")), ("%f", F.col("path")), ("%h", format_size(F.col("size"))), ("%b", F.col("size")), ("%p", octal_mode(F.col("mode")))]
    return files.select(formatted(template, fields).alias("line"))


def find_snapshots(snapshots: DataFrame, term: str = "") -> DataFrame:
    """Tags that contain term, taken literally; in pack order, then as stored."""
    return snapshots.filter(F.contains("tag", F.lit(term))).select("tag", "pack", "seq")


def duplicate_snapshots(fingerprints: DataFrame) -> DataFrame:
    """Snapshots grouped by content."""
    return fingerprints.groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.concat_ws(":", "pack", "tag"))).alias("snapshots"), F.count(F.lit(1)).alias("n"))


def redundant_loose(fingerprints: DataFrame) -> DataFrame:
    """Loose snapshots whose content some pack holds too. Counted first, then joined back: a popular content is no hot window."""
    per = fingerprints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.max(~is_loose(F.col("pack"))).alias("packed")).filter("n > 1 and packed")
    return fingerprints.filter(is_loose(F.col("pack"))).join(per, "fingerprint", "left_semi").select("pack", "tag")


def redundant_same_tag(fingerprints: DataFrame) -> DataFrame:
    """As redundant_loose, but the pack must hold the content under the same tag, so that no tag is lost."""
    packed = fingerprints.filter(~is_loose(F.col("pack"))).select("fingerprint", "tag").distinct()
    return fingerprints.filter(is_loose(F.col("pack"))).join(packed, ["fingerprint", "tag"], "left_semi").select("pack", "tag")


def resolve_tags(fingerprints: DataFrame) -> DataFrame:
    """The pack that a bare tag means: a loose one first, then by name; AMBIGUOUS if contents differ."""
    key = F.struct((~is_loose(F.col("pack"))).alias("packed"), F.col("pack"))
    per = fingerprints.groupBy("tag").agg(F.count_distinct("fingerprint").alias("contents"), F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
    return per.select("tag", F.when(F.col("contents") > 1, AMBIGUOUS).otherwise(F.col("first.pack")).alias("pack"), "n")


def unreferenced(loose_objects: DataFrame, files: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Loose objects that no remaining loose snapshot names. removed: (pack, tag) that go first."""
    roots = files.filter(is_loose(F.col("pack")))
    if removed is not None:
        roots = roots.join(removed, ["pack", "tag"], "left_anti")
    return loose_objects.join(roots.select("checksum").distinct(), "checksum", "left_anti")


def first_remote(packs: DataFrame, remote_packs: DataFrame, from_url) -> DataFrame:
    """For each wanted pack the remote entry whose URL ends in its file name: the first by (remote, line)."""
    entries = remote_packs.withColumn("pack", F.regexp_replace(from_url, r"\.pack$", ""))
    met = packs.select("pack").join(entries, "pack")
    order = Window.partitionBy("pack").orderBy("remote", "line")
    return met.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def stale_indexes(remote_packs: DataFrame, local: DataFrame) -> DataFrame:
    """Remote entries whose index is absent here or has another checksum."""
    have = local.select(F.col("pack"), F.col("index_checksum").alias("__have"))
    return remote_packs.join(have, "pack", "left").filter(~F.col("index_checksum").eqNullSafe(F.col("__have"))).drop("__have")


def commit_prefix(commits: DataFrame, prefixes: DataFrame, least: int = 6) -> DataFrame:
    """For each prefix: how many distinct commits start with it, and the only one. Prefixes of one length meet commits cut to that length, so the join is by equality."""
    p = prefixes.select("prefix").distinct().withColumn("__len", F.length("prefix"))
    lengths = p.select("__len").distinct()
    cut = commits.select("commit").distinct().withColumn("__len", F.explode(F.sequence(F.lit(least), F.length("commit"))))
    cut = cut.withColumn("prefix", F.expr("substring(commit, 1, __len)")).join(lengths, "__len", "left_semi")
    met = p.join(cut, ["prefix", "__len"], "left").groupBy("prefix").agg(F.count("commit").alias("n"), F.min("commit").alias("one"))
    return met.select("prefix", "n", F.when(F.col("n") == 1, F.col("one")).alias("commit"))


def served(files: DataFrame, binary: str, link_dest: str) -> DataFrame:
    """Files that are shipped for a requested binary: for clang* its namesakes in bin and the resource headers, else the binary and what it links to."""
    name = F.regexp_extract("path", "^bin/([^/]+)$", 1)
    if binary.startswith("clang"):
        return files.filter((name != "") & (F.startswith(name, F.lit("clang")) | (name == link_dest)) | F.startswith(F.col("path"), F.lit("lib/clang/")))
    return files.filter(name.isin(binary, link_dest) & (name != ""))


def hex_checksum(objects: DataFrame) -> DataFrame:
    return objects.withColumn("checksum", hexed(F.col("checksum")))
