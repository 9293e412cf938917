"""Writing files of a state into a directory, by the executors."""

from __future__ import annotations

import errno
import os
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_file(path: bytes, data: bytes, mode: int) -> None:
    """Whole, with its mode, parents made on demand; a file in a parent's place gives way."""
    top = os.path.dirname(path)
    try:
        os.makedirs(top, exist_ok=True)
    except (FileExistsError, NotADirectoryError):
        at = top
        while at and not os.path.isdir(at):
            if os.path.lexists(at):
                os.unlink(at)
                break
            at = os.path.dirname(at)
        os.makedirs(top, exist_ok=True)
    fd, own = tempfile.mkstemp(dir=os.fsdecode(top), prefix=".snaplake-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        os.chmod(own, mode & 0o7777)
        os.replace(own, path)
    except BaseException:
        os.unlink(own)
        raise


def write_tree(entries: DataFrame, to: str) -> int:
    """entries: path (any bytes), content, mode. Returns the number of files written."""
    top = os.fsencode(os.path.abspath(to))

    def write(batches):
        n = 0
        for b in batches:
            for path, content, mode in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                write_file(os.path.join(top, path.as_py()), content.as_py() or b"", mode)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return sum(r.n for r in entries.select(F.col("path").cast("binary").alias("path"), "content", "mode").mapInArrow(write, "n long").collect())


def remove_paths(paths: DataFrame, dirs: DataFrame, to: str) -> None:
    """Deletes files (path), then the directories (dir, depth) they leave empty, deepest first, by the executors: a task takes all directories below one at the top."""
    top = os.fsencode(os.path.abspath(to))

    def drop(remove):
        def run(batches):
            for b in batches:
                for p in b.column(0).to_pylist():
                    try:
                        remove(os.path.join(top, p))
                    except OSError as e:
                        if e.errno not in (errno.ENOENT, errno.ENOTDIR, errno.EISDIR, errno.ENOTEMPTY, errno.EEXIST):
                            raise
            yield pa.RecordBatch.from_pydict({"n": pa.array([0], pa.int64())})

        return run

    n = max(1, paths.sparkSession.sparkContext.defaultParallelism)
    files = paths.select(F.col("path").cast("binary").alias("path")).repartition(n, "path")
    files.mapInArrow(drop(os.unlink), "n long").count()
    first = F.substring_index(F.col("dir").cast("string"), "/", 1)
    deep = dirs.select(F.col("dir").cast("binary").alias("dir"), "depth", first.alias("first")).repartition(n, "first").sortWithinPartitions(F.col("depth").desc())
    deep.select("dir").mapInArrow(drop(os.rmdir), "n long").count()
