"""Sharding by proportional stratified interleaving.

Rows are ranked within their source in a seeded order; sorting all rows by fractional rank,
(rank + 0.5) / (rows of the source), interleaves the sources in proportion, so that each contiguous cut has
the mixture of the whole. Cuts are by row count, at most one apart (law `rows`). Both ranks are two-level
(see common.with_running), so that neither a hot source nor the whole table meets in one task.

Defined results: a null text has no bytes, so size 1 and crc32 0; a null source is a source of its own;
rows with a null doc_id are sharded like any other; equal rows are interchangeable and each gets its own
slot; a very long text counts as one row; an empty table gives an empty table; other columns are never read. Groups of equal texts are not
kept together: the law is about rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RANK_HEX, seeded, with_running, written


def interleave(docs: DataFrame, shards: int = 8, seed: int = 11) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot."""
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", "source", (F.octet_length(bytes_).cast("long") + 1).alias("size"), F.crc32(bytes_).alias("text_crc32"))
    rows = written(rows.withColumn("__h", seeded(seed, F.col("doc_id"), F.col("text_crc32"))), "shard-rows")
    tie = [F.col("__h"), F.col("doc_id"), F.col("size")]
    ranked = with_running(rows, ["source"], F.substring("__h", 1, RANK_HEX), tie, {"__rank": F.lit(1)})
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed("source", "__source")
    per = per.withColumn("__total", F.sum("__n").over(Window.partitionBy()))
    ranked = ranked.join(per, ranked["source"].eqNullSafe(per["__source"])).drop("__source")
    ranked = written(ranked.withColumn("__part", (F.col("__rank") + 0.5) / F.col("__n")), "shard-ranks")
    cuts = 16**RANK_HEX
    placed = with_running(ranked, [], F.floor(F.col("__part") * cuts), [F.col("__part"), F.col("source").asc_nulls_last(), *tie], {"__at": F.lit(1)})
    placed = placed.withColumn("shard", F.expr(f"int((__at * {shards}) div __total)"))
    slot = F.expr(f"__at - (shard * __total + {shards - 1}) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))
