"""Token counts from flat token files that have no index: a separator scan.

Files are cut into blocks of ids. Each block is searched for the end-of-document id with one vectorised
comparison. A block knows its length and the places of its first and last separators; a prefix scan over
one small row a block gives the ids and documents before it and the last separator before it, which
stitches documents that cross blocks and files. The scan has two levels, blocks within a part and parts, so one
task sees a row a part (a part is what one writing task wrote) and no more.

Defined results: ids after the last separator are one more document, not closed; empty files and blocks
add nothing; two separators side by side enclose a document of no ids; a document may fill many blocks and
files; blocks of equal place and offset do not occur, as a file has one place. For a table of documents, a null
text is a document of no ids, repeated rows are documents of their own, a null doc_id stays null, an
empty table gives no rows, other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..files import get, put
from .common import new_path, running_over_parts, shuffles, tidied, written
from .tokens import encoder, slices


def scan(files: DataFrame, end_id: int, width: int = 2, block: int = 1 << 20) -> DataFrame:
    """files: path, place (orders them; its upper 32 bits name a part), ids. Per document: ordinal, start, n_tokens (without the separator), closed."""
    dtype = np.dtype(f"<u{width}")
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("ids") - 1, F.lit(0)), F.lit(block).cast("long"))
    blocks = files.filter("ids > 0").select("path", "place", "ids", F.explode(steps).alias("at"))
    blocks = blocks.select("path", "place", "at", F.least(F.col("ids") - F.col("at"), F.lit(block)).alias("n"))

    def find(batches):
        for b in batches:
            for path, place, at, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                ends = np.flatnonzero(np.frombuffer(get(path, at * width, n * width), dtype) == end_id).astype("<u4")
                yield pa.RecordBatch.from_pydict({"place": [place], "at": [at], "n": [n], "found": [len(ends)], "last": [int(ends[-1]) if len(ends) else None], "ends": [ends.tobytes()]}, schema=kind)

    kind = pa.schema([("place", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("found", pa.int64()), ("last", pa.int64()), ("ends", pa.binary())])
    made = blocks.repartition(shuffles(files.sparkSession), "path", "at").mapInArrow(tidied(find), "place long, at long, n long, found long, last long, ends binary")
    made = written(made, "token-blocks")

    small = made.select("place", "at", "n", "found", "last", F.shiftright("place", 32).alias("part"))
    small = running_over_parts(small, "part", ["place", "at"], {"base": "n", "docs": "found"})
    small = small.withColumn("after", F.col("base") + F.col("last") + 1)
    # the last separator before a block: in its part, or in the parts before
    per = small.groupBy(F.col("part").alias("__part")).agg(F.max("after").alias("__open"), F.max(F.struct("place", "at")).alias("__end"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__part", "__end", F.coalesce(F.max("__open").over(before), F.lit(0)).alias("__open"), F.lead("__part").over(Window.orderBy("__part")).isNull().alias("__final"))
    inside = Window.partitionBy("part").orderBy("place", "at").rowsBetween(Window.unboundedPreceding, -1)
    small = small.join(per, small["part"] == per["__part"]).withColumn("open", F.coalesce(F.max("after").over(inside), F.col("__open")))
    final = F.col("__final") & (F.struct("place", "at") == F.col("__end"))
    small = small.select("place", "at", "base", "docs", "open", final.alias("final"))

    def tell(batches):
        for b in batches:
            for n, raw, base, docs, start, final in zip(*[c.to_pylist() for c in b.columns], strict=True):
                ends = np.frombuffer(raw, "<u4").astype(np.int64) + base
                starts = np.concatenate([[start], ends + 1])
                closed = np.ones(len(ends), bool)
                if final and starts[-1] < base + n:
                    ends, closed = np.append(ends, base + n), np.append(closed, False)
                starts = starts[: len(ends)]
                yield pa.RecordBatch.from_arrays([pa.array(docs + np.arange(len(ends))), pa.array(starts), pa.array(ends - starts), pa.array(closed)], names=["ordinal", "start", "n_tokens", "closed"])

    joined = made.select("place", "at", "n", "ends").join(small, ["place", "at"]).select("n", "ends", "base", "docs", "open", "final")
    return joined.mapInArrow(tidied(tell), "ordinal long, start long, n_tokens long, closed boolean")


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, roll: int = 8 << 20) -> tuple[DataFrame, DataFrame, int]:
    """Flat files of all documents in the order they are read: (files for `scan`, ordinal and doc_id, id width). Documents cross files; nothing is shuffled."""
    spark = docs.sparkSession
    folder = new_path(spark, "flat-tokens")
    width = encoder(tokenizer).width
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("path", pa.string()), ("ids", pa.int64())])

    def write(batches):
        enc, part, seq, row = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        held = b""

        def flush(raw):
            path = f"{folder}/part-{part:06d}-{seq:06d}.ids"
            put(path, raw)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "doc_id": [None], "path": [path], "ids": [len(raw) // enc.width]}, schema=kind)

        for some in slices(batches):
            held += b"".join(x.tobytes() for x in enc.ids([t for _, t in some], end_id))
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), pa.array([d for d, _ in some], pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], schema=kind)
            row += n
            while len(held) >= roll * enc.width:
                yield flush(held[: roll * enc.width])
                held, seq = held[roll * enc.width :], seq + 1
        if held:
            yield flush(held)

    made = written(rows.mapInArrow(tidied(write), "part int, seq long, doc_id long, path string, ids long"), "flat-manifest")
    files = made.filter("path is not null").select("path", (F.col("part").cast("long") * (1 << 32) + F.col("seq")).alias("place"), "ids")
    keys = made.filter("path is null")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = keys.groupBy("part").agg(F.count(F.lit(1)).alias("__n")).select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    keys = keys.join(per, "part").select((F.col("__base") + F.col("seq")).alias("ordinal"), "doc_id")
    return files, keys, width


def count_documents(docs: DataFrame, tokenizer: str, end_id: int = 50256) -> DataFrame:
    """doc_id, start, n_tokens (without the separator) of every document, found in the flat files."""
    files, keys, width = write_flat(docs, tokenizer, end_id)
    return scan(files, end_id, width).join(keys, "ordinal").select("doc_id", "start", "n_tokens")
