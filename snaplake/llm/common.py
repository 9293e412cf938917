"""What the corpus operators share: the shared folder, tables written there, two-level ranks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Hex digits of a seeded md5 that name a bucket: 4,096 buckets for each group that is ranked.
RANK_HEX = 3

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests on one machine)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = sc._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        named = "file://" + tempfile.mkdtemp(prefix="snaplake-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends."""
    if not _written:
        atexit.register(_clean)
    path = f"{shared_dir(spark).rstrip('/')}/snaplake/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _clean() -> None:
    """Deletes what is left at the end: through Spark while the session lives, else through the file system alone."""
    from ..files import delete

    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session is gone
            try:
                delete(path)
            except Exception:  # noqa: BLE001  a store that only Spark reaches
                continue


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `written` once all that was made of them is itself written."""
    for t in tables:
        remove(t.sparkSession, t._written_at)


def tidied(run):
    """run, for mapInArrow, giving free memory back to the system at a task's end: idle workers share the executor's memory with those that come after."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidy


#: Rows of a table of a few numbers that may be broadcast: a few MB at most.
FEW = 100_000


def small_or_merged(table: DataFrame, most: int = FEW) -> DataFrame:
    """A written table of a few numbers a row, to be joined: broadcast if its rows are few by count, else merged. The join gives the same rows."""
    return F.broadcast(table) if table.count() <= most else table.hint("merge")


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def seeded(seed: int, *cols: Column) -> Column:
    """A hex string that orders rows at random but the same in each run (and in other SQL engines): md5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).cast("binary"))


def with_running(df: DataFrame, group: list[str], bucket: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Exclusive running sums within each group in the given order, without one task for a large group.

    bucket must be non-decreasing in the order. Sums are taken for each (group, bucket), their prefix
    sums form a small table, and only rows of one (group, bucket) meet in a window. df is read twice.
    """
    df = df.withColumn("__bucket", bucket)
    keys = [*group, "__bucket"]
    small = df.groupBy(*keys).agg(*[F.sum(c).alias(f"__of_{k}") for k, c in sums.items()])
    over = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    small = small.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(f"__of_{k}").over(over), F.lit(0)).alias(f"__base_{k}") for k in sums])
    match = None
    for i, k in enumerate(keys):
        one = df[k].eqNullSafe(small[f"__k{i}"])
        match = one if match is None else match & one
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(small, match).drop(*[f"__k{i}" for i in range(len(keys))])
    for k, c in sums.items():
        df = df.withColumn(k, F.col(f"__base_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return df.drop("__bucket", *[f"__base_{k}" for k in sums])


def running_over_parts(df: DataFrame, part: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums over all rows in the order of (part, *order): windows within each part, and one over a row a part.

    sums: new column by summed column. df is read twice; parts are what tasks have written, so a part's rows are one task's.
    """
    per = df.groupBy(part).agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col(part).alias("__part"), *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(per, df[part] == per["__part"])
    out = out.withColumns({k: F.col(f"__{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
    return out.drop("__part", *[f"__{k}" for k in sums])
