"""Streaming ingest: change rows that arrive as files are appended to a log, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.log import ROW

CHANGES = "pack string, seq int, op string, path string, checksum string, mode long, size long"


def changes_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(CHANGES).parquet(folder)


def append_changes(stream: DataFrame, log_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each batch replaces its own folder, so a batch that runs again after a failure adds nothing twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["pack", "seq", "op", *ROW]).write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def churn(stream: DataFrame) -> DataFrame:
    """Rows and bytes added and removed by each snapshot, as they come in."""
    return stream.groupBy("pack", "seq", "op").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
