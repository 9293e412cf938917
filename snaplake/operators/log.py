"""The change log: encoding, replay, time travel.

Within a pack, seq runs 0, 1, 2, ... and a log row says that (path, checksum, mode) is added at, or removed
from, a snapshot against the one before. A well-formed log keeps each row's running count at 0 or 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .layout import with_prefix

ROW = ["path", "checksum", "mode"]
CORRUPT = "corrupt log: "


def _sign():
    return F.when(F.col("op") == "A", F.lit(1)).otherwise(F.lit(-1)).cast("long")


def delta_encode(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """files (pack, seq, path, checksum, mode, size) as a change log. One shuffle: gaps in a row's own series of seqs are its changes."""
    row = Window.partitionBy("pack", *ROW).orderBy("seq")
    ends = snapshots.groupBy("pack").agg(F.max("seq").alias("__last"))
    seen = files.select("pack", "seq", *ROW, "size").dropDuplicates(["pack", "seq", *ROW])
    seen = seen.withColumn("__before", F.lag("seq").over(row)).withColumn("__after", F.lead("seq").over(row)).join(ends, "pack")
    added = F.when(F.col("__before").isNull() | (F.col("__before") < F.col("seq") - 1), F.struct(F.col("seq").alias("seq"), F.lit("A").alias("op")))
    gone = F.when((F.col("seq") < F.col("__last")) & (F.col("__after").isNull() | (F.col("__after") > F.col("seq") + 1)), F.struct((F.col("seq") + 1).alias("seq"), F.lit("R").alias("op")))
    out = seen.withColumn("__c", F.explode(F.filter(F.array(added, gone), lambda x: x.isNotNull())))
    return out.select("pack", F.col("__c.seq").alias("seq"), F.col("__c.op").alias("op"), *ROW, "size")


def running_rows(changes: DataFrame) -> DataFrame:
    """Each log row with its row's running count; removals of a snapshot come before its additions."""
    row = Window.partitionBy("pack", *ROW).orderBy("seq", F.col("op") == "A").rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("running", F.sum(_sign()).over(row))


def violations(changes: DataFrame) -> DataFrame:
    """Log rows that remove what is absent or add what is present."""
    return running_rows(changes).filter(~F.col("running").isin(0, 1))


def _stop(what: str, *cols: str):
    """An error where a log is corrupt: it removes what is absent or adds what is present."""
    return F.raise_error(F.concat(F.lit(CORRUPT + what), *[x for c in cols for x in (F.lit(" "), F.coalesce(F.col(c).cast("string"), F.lit("-")))]))


def resolve(changes: DataFrame, seq) -> DataFrame:
    """The files (pack and row) as of seq: a number, or a column of snapshots joined to the log. The cut reaches the scan. A log whose rows add up to anything but 0 or 1 is an error."""
    upto = changes.filter(F.col("seq") <= F.lit(seq))
    per = upto.groupBy("pack", *ROW).agg(F.max("size").alias("size"), F.sum(_sign()).alias("__n"))
    there = F.when(F.col("__n").isin(0, 1), F.col("__n") == 1).otherwise(_stop("unbalanced row", "pack", "checksum").cast("boolean"))
    return per.filter(there).drop("__n")


def intervals(changes: DataFrame) -> DataFrame:
    """Validity of each row, seq_from to seq_to (excluded; null while it lasts): a checkpoint table for time travel by one range filter. A row added twice, or removed while it is absent, is an error."""
    row = Window.partitionBy("pack", *ROW).orderBy("seq", F.col("op") == "A")
    out = changes.withColumns({"seq_to": F.lead("seq").over(row), "__next": F.lead("op").over(row), "__last": F.lag("op").over(row)})
    good = F.when(F.col("op") == "A", F.coalesce(F.col("__next") == "R", F.lit(True))).otherwise(F.coalesce(F.col("__last") == "A", F.lit(False)))
    out = out.filter(F.when(good, F.col("op") == "A").otherwise(_stop("unbalanced row", "pack", "checksum").cast("boolean")))
    return out.select("pack", F.col("seq").alias("seq_from"), "seq_to", *ROW, "size")


def as_of(valid: DataFrame, seq: int) -> DataFrame:
    return valid.filter((F.col("seq_from") <= seq) & (F.col("seq_to").isNull() | (F.col("seq_to") > seq))).drop("seq_from", "seq_to")


def materialise_all(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every snapshot's full state. Intervals are unrolled to their seqs, so the join with snapshots is by equality."""
    ends = snapshots.groupBy("pack").agg(F.max("seq").alias("__last"))
    valid = intervals(changes).join(ends, "pack")
    seqs = F.sequence(F.col("seq_from"), F.coalesce(F.col("seq_to") - 1, F.col("__last")))
    return valid.withColumn("seq", F.explode(seqs)).join(snapshots.select("pack", "seq", "tag"), ["pack", "seq"]).select("pack", "seq", "tag", *ROW, "size")


def running_file_count(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Files of each snapshot, from the log's counts alone."""
    per = changes.groupBy("pack", "seq").agg(F.sum(_sign()).alias("__n"))
    run = Window.partitionBy("pack").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return snapshots.join(per, ["pack", "seq"], "left").withColumn("files", F.sum(F.coalesce("__n", F.lit(0).cast("long"))).over(run)).select("pack", "seq", "tag", "files")


def running_totals(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Files and bytes of each snapshot, as running signed sums of the log: no snapshot is unrolled."""
    per = changes.groupBy("pack", "seq").agg(F.sum(_sign()).alias("__n"), F.sum(_sign() * F.col("size")).alias("__b"))
    run = Window.partitionBy("pack").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    met = snapshots.join(per, ["pack", "seq"], "left")
    none = F.lit(0).cast("long")
    return met.select("pack", "seq", "tag", F.sum(F.coalesce("__n", none)).over(run).alias("files"), F.sum(F.coalesce("__b", none)).over(run).alias("bytes"))


def push_snapshot(files: DataFrame, snapshots: DataFrame, new: DataFrame, pack: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """(log rows, snapshot row) that append new (path, checksum, mode, size) to the pack whose last state is files."""
    last = snapshots.filter(F.col("pack") == pack).agg(F.max("seq").alias("seq"), F.max((F.col("tag") == tag).cast("int")).alias("there")).first()
    if last.there:
        from ..model import SnapshotAlreadyExists

        raise SnapshotAlreadyExists(f"{pack}:{tag}")
    seq = -1 if last.seq is None else last.seq
    old = files.filter((F.col("pack") == pack) & (F.col("seq") == seq)).select(*ROW, "size")
    added = new.select(*ROW, "size").dropDuplicates(ROW).join(old, ROW, "left_anti").withColumn("op", F.lit("A"))
    removed = old.join(new, ROW, "left_anti").withColumn("op", F.lit("R"))
    rows = added.union(removed).select(F.lit(pack).alias("pack"), F.lit(seq + 1).alias("seq"), "op", *ROW, "size")
    return rows, snapshots.sparkSession.createDataFrame([(pack, seq + 1, tag)], "pack string, seq int, tag string")


def intern(rows: DataFrame, value: str, order: list[str], pack: str = "pack") -> DataFrame:
    """A dictionary: each value's handle is its rank by first appearance, ties by value. Values are reduced to one row each before they are ranked,
    and ranks are added up over first appearances and ever longer beginnings of the value, so no task sees all values of a pack."""
    first = rows.groupBy(pack, value).agg(F.min(F.struct(*order)).alias("__first")).withColumn("__one", F.lit(1).cast("long"))
    grains = [F.col("__first"), *[F.substring(F.col(value), 1, n) for n in (4, 16, 64)]]
    out = with_prefix(first, [pack], ["__first", value], "__one", "handle", *grains)
    return out.select(pack, "handle", value)


def encode(rows: DataFrame, pool: DataFrame, value: str, handle: str, pack: str = "pack") -> DataFrame:
    return rows.join(pool.withColumnRenamed("handle", handle), [pack, value])


def undecodable(rows: DataFrame, pool: DataFrame, handle: str, pack: str = "pack") -> DataFrame:
    """Rows whose handle is in no dictionary; must be none."""
    return rows.join(pool.select(pack, F.col("handle").alias(handle)), [pack, handle], "left_anti")


def object_metadata(entries: DataFrame, order: str) -> DataFrame:
    """Of each object the metadata written last."""
    return entries.groupBy("pack", "checksum").agg(F.max_by(F.struct("offset", "size"), order).alias("__m")).select("pack", "checksum", "__m.offset", "__m.size")
