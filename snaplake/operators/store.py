"""Relations behind storing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import NO_OBJECT


def hashed(tree: DataFrame) -> DataFrame:
    """path, content, readable (and other columns) with checksum (lower hex) and size. An unreadable file has no bytes and the all-zero checksum, unlike an empty one."""
    content = F.when(F.col("readable"), F.coalesce("content", F.lit("").cast("binary")))
    return tree.withColumn("checksum", F.when(F.col("readable"), F.sha1(content)).otherwise(NO_OBJECT)).withColumn("size", F.coalesce(F.octet_length(content), F.lit(0)).cast("long"))


def new_objects(contents: DataFrame, have: DataFrame) -> DataFrame:
    """checksum, size, content of each object (checksum, size, content) that the store lacks, once. Only checksums meet the store; contents of known objects are not moved."""
    rows = contents.select("checksum", "size", "content")
    return rows.join(have.select("checksum"), "checksum", "left_anti").dropDuplicates(["checksum"])


def union_packs(snapshots: DataFrame, order: DataFrame) -> DataFrame:
    """Snapshots of the packs in order (pack, place), numbered through: few rows, one a snapshot."""
    met = snapshots.join(order, "pack")
    return met.select("pack", F.col("seq").alias("old_seq"), (F.row_number().over(Window.orderBy("place", "seq")) - 1).cast("int").alias("seq"), "tag")


def duplicate_tags(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("tag").count().filter("count > 1").select("tag")
