"""Work trees and lists of files as tables."""

from __future__ import annotations

import datetime
import os
import stat
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import WORKTREE


#: Parts that a tree is cut into for reading, about.
PARTS = 64


class Subtree(InputPartition):
    def __init__(self, path: bytes, deep: bool):
        super().__init__(path)
        self.deep = deep


def _row(path: bytes, top: bytes, content: bool) -> Iterator[tuple]:
    """The file at path as a row of WORKTREE; none if it is no regular file or has gone. A file that cannot be read and has no bytes is told as unreadable."""
    try:
        info = os.stat(path)
    except OSError:
        return
    if not stat.S_ISREG(info.st_mode):
        return
    data, readable = None, True
    if content:
        try:
            with open(path, "rb") as f:
                data = f.read()
        except OSError:
            if info.st_size:
                raise
            readable = False
    changed = datetime.datetime.fromtimestamp(max(info.st_mtime, getattr(info, "st_birthtime", 0)), datetime.UTC)
    yield os.path.relpath(path, top), data, info.st_size if data is None else len(data), info.st_mode, changed, readable


class WorktreeReader(DataSourceReader):
    """Partitions are directories with all below them, and the files of directories above those: the tree is opened level by level until there are about PARTS."""

    def __init__(self, options):
        self.top = os.fsencode(os.path.realpath(options["path"]))
        skip = options.get("exclude")
        self.skip = os.fsencode(os.path.realpath(skip)) if skip else None
        self.content = str(options.get("content", "true")).lower() == "true"
        self.parts = int(options.get("parts", PARTS))

    def _below(self, folder: bytes) -> list[bytes]:
        above = self._above(folder) | {os.path.realpath(folder)}
        with os.scandir(folder) as entries:
            return [e.path for e in sorted(entries, key=lambda e: e.name) if e.is_dir() and os.path.realpath(e.path) not in above | {self.skip}]

    def _above(self, folder: bytes) -> set[bytes]:
        """The directories that lead to folder: a link back to one of them is not followed."""
        found, at = set(), folder
        while at != self.top:
            at = os.path.dirname(at)
            found.add(os.path.realpath(at))
        return found

    def partitions(self) -> list[Subtree]:
        shallow, deep = [], [self.top]
        while deep and len(shallow) + len(deep) < self.parts:
            shallow += deep
            deep = [d for folder in deep for d in self._below(folder)]
        return [Subtree(d, False) for d in shallow] + [Subtree(d, True) for d in deep]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        seen = self._above(partition.value)
        for here, dirs, names in os.walk(partition.value, followlinks=True):
            real = os.path.realpath(here)
            if real in seen or real == self.skip:
                dirs[:] = []
                continue
            seen.add(real)
            if not partition.deep:
                dirs[:] = []
            for name in sorted(names):
                yield from _row(os.path.join(here, name), self.top, self.content)


class Worktree(DataSource):
    """format('worktree'), options path, exclude, content (false: files are not opened) and parts: every regular file, hidden, empty and non-UTF-8 ones included."""

    @classmethod
    def name(cls) -> str:
        return "worktree"

    def schema(self):
        return WORKTREE

    def reader(self, schema) -> WorktreeReader:
        return WorktreeReader(self.options)


def worktree(spark: SparkSession, path: str, exclude: str | None = None, content: bool = True) -> DataFrame:
    spark.dataSource.register(Worktree)
    reader = spark.read.format("worktree").option("path", path).option("content", str(content).lower())
    return (reader.option("exclude", exclude) if exclude else reader).load()


def listed_files(names: DataFrame, top: str, parts: int | None = None) -> DataFrame:
    """The files that names (path, relative to top) lists, as worktree gives them; nothing else is opened."""
    base = os.fsencode(os.path.realpath(top))

    def read(batches):
        for b in batches:
            rows = [r for p in b.column(0).to_pylist() for r in _row(os.path.join(base, p), base, True)]
            for i in range(0, len(rows), 64):
                cols = list(zip(*rows[i : i + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_()), strict=True)], names=WORKTREE.names)

    spread = names.select(F.col("path").cast("binary").alias("path")).distinct()
    spread = spread.repartition(parts or max(1, names.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(read, WORKTREE)


def file_list(spark: SparkSession, path: str, nul: bool = False) -> DataFrame:
    """The names in a list, one a line or ended by NUL; empty ones dropped."""
    return spark.read.option("lineSep", "\0" if nul else "\n").text(path).filter(F.length("value") > 0).withColumnRenamed("value", "path")


def clean_file_list(names: DataFrame, repo: str, data_dir: str) -> DataFrame:
    """Names under repo, relative to it, without those in data_dir. An absolute or a missing name is an error."""
    top, data = os.path.realpath(repo), os.path.realpath(data_dir)
    base = os.fsencode(top)

    @F.pandas_udf("binary")
    def resolved(path: pd.Series) -> pd.Series:
        full = [os.path.join(base, p) for p in path]
        return pd.Series([os.path.relpath(os.path.realpath(p), base) if os.path.lexists(p) else None for p in full], dtype=object)

    def stop(bad: Column, what: str) -> Column:
        return F.when(bad, F.raise_error(F.concat(F.lit(what), F.col("path"))).cast("string"))

    out = names.select(F.coalesce(stop(F.startswith("path", F.lit("/")), "absolute path: "), F.col("path")).alias("path"))
    out = out.select("path", resolved(F.col("path").cast("binary")).cast("string").alias("real"))
    out = out.select(F.coalesce(stop(F.col("real").isNull(), "no such file: "), F.col("real")).alias("path"))
    inside = os.path.relpath(data, top)
    return out.filter(~(F.startswith("path", F.lit(inside + "/")) | (F.col("path") == inside)))

