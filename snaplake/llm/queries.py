"""The queries over the driver's tables and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import media, mixing, packing, passages, quality_model, quality_rules, sharding, simhash, token_counts, token_files
from .tokens import default_tokenizer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    return token_counts.count_documents(table(spark, sf_dir, "documents"), default_tokenizer())


def op2_mixing(spark, sf_dir):
    return mixing.takes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def op3_quality_model(spark, sf_dir):
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_media_columns(spark, sf_dir):
    return media.features(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark, sf_dir):
    return passages.occurrences(table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    out = simhash.linked(table(spark, sf_dir, "documents"), distance=2, size=3)
    return out.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op8_token_files(spark, sf_dir):
    return token_files.read_files(token_files.write_files(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=2))


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), default_tokenizer(), capacity=1024, end_id=0)


def op10_sharding(spark, sf_dir):
    out = sharding.interleave(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_mixing, op3_quality_model, op4_quality_rules, op5_media_columns, op6_substring_dedup, op7_simhash, op8_token_files, op9_packing, op10_sharding)}

ORACLE_SQL = {
    "op2_mixing": r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT source, source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w,
         CAST(source_size * 2 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS pot
  FROM per
), levels AS (
  SELECT *, (pot - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here
  FROM weighed
), level AS (
  SELECT max(CASE WHEN here <= cap / w THEN here END) AS top FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN top IS NULL OR cap / w < top THEN cap ELSE w * top END AS target FROM levels, level
), ordered AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY md5('7:' || coalesce(CAST(r.doc_id AS VARCHAR), '')), r.doc_id, r.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, CAST(whole + CASE WHEN before + size / 2.0 <= target - whole * source_size AND whole < 2 AND size > 0 THEN 1 ELSE 0 END AS BIGINT) AS repeats
  FROM ordered
)
SELECT doc_id, size, source_size, target, CAST(size * repeats AS BIGINT) AS taken, source, repeats FROM counted
""",
    # CRC-32 byte by byte over a table made from its polynomial
    "op10_sharding": r"""
WITH step AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t
), raw AS (
  SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), summed AS (
  SELECT doc_id, source, CAST(n + 1 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT))),
                         lambda x, b: xor(x // 256, t[(xor(x, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM raw, step
), keyed AS (
  SELECT *, md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32) AS h FROM summed
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size) - 1 + CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY source) AS part FROM keyed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY part, source ASC NULLS LAST, h, doc_id, size) - 1 AS g, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(g * 8 // total AS INTEGER) AS shard,
       CAST(g - ((g * 8 // total) * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM placed
""",
}
