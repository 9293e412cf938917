"""A fixture repository derived from the table `documents`: six snapshots with churn, content versions and mode flips, in several packs.

Both engines can compute it: `FILES_SQL` is the same in DuckDB's SQL, as common table expressions that
queries go on from (`snaps`, `files`, `multi`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DEFAULT_MODE

SNAPSHOTS = 6
BASE = "main"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def snapshots(spark: SparkSession) -> DataFrame:
    """pack, seq, tag of the base pack."""
    return spark.range(SNAPSHOTS, numPartitions=1).select(F.lit(BASE).alias("pack"), F.col("id").cast("int").alias("seq"), F.concat(F.lit("snap-"), F.col("id").cast("string")).alias("tag"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack, seq, tag, path, mode, content of every file of every snapshot of the base pack. A document's row is unrolled to its snapshots in place."""
    seqs = F.explode(F.sequence(F.lit(0), F.lit(SNAPSHOTS - 1))).alias("seq")
    d = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), seqs)
    d = d.filter((F.col("doc_id") * 3 + F.col("seq")) % 5 != 0)
    version = (F.col("doc_id") + F.col("seq")) % 7 == 0
    content = F.when(version, F.concat("text", F.lit("#"), F.col("seq").cast("string"))).otherwise(F.col("text"))
    mode = F.when((F.col("doc_id") + F.col("seq")) % 11 == 0, F.lit(0o100775)).otherwise(F.lit(DEFAULT_MODE)).cast("long")
    return d.select(F.lit(BASE).alias("pack"), "seq", F.concat(F.lit("snap-"), F.col("seq").cast("string")).alias("tag"), "path", mode.alias("mode"), content.alias("content"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contents(spark, sf_dir)
    raw = F.col("content").cast("binary")
    return c.select("pack", "seq", "tag", "path", F.sha1(raw).alias("checksum"), F.octet_length(raw).cast("long").alias("size"), "mode")


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files under several packs: p0 has snapshots 0 to 3, p1 repeats 2 and 3, three loose ones, and p2 has the rows of 5 under the tag snap-1."""
    f = files(spark, sf_dir)
    loose = F.concat(F.lit("loose/"), F.col("tag"))
    packs = F.array_compact(
        F.array(
            F.when(F.col("seq") <= 3, F.struct(F.lit("p0").alias("pack"), F.col("seq").alias("seq"), F.col("tag").alias("tag"))),
            F.when(F.col("seq").isin(2, 3), F.struct(F.lit("p1").alias("pack"), (F.col("seq") - 2).alias("seq"), F.col("tag").alias("tag"))),
            F.when(F.col("seq") >= 3, F.struct(loose.alias("pack"), F.lit(0).alias("seq"), F.col("tag").alias("tag"))),
            F.when(F.col("seq") == 5, F.struct(F.lit("p2").alias("pack"), F.lit(0).alias("seq"), F.lit("snap-1").alias("tag"))),
        )
    )
    return f.withColumn("p", F.explode(packs)).select("p.pack", "p.seq", "p.tag", "path", "checksum", "size", "mode")


#: The letters of names in random trees.
LETTERS = "abcd1234"


def random_tree(spark: SparkSession, seed: int, files: int = 64) -> DataFrame:
    """path, content, mode of a tree of short names in one or two levels, so that names clash: of equal paths the last one stays, and a directory wins over a file. The same for a seed in any engine."""
    digit = lambda k: F.conv(F.substring("h", k, 1), 16, 10).cast("int")
    letter = lambda k: F.substring(F.lit(LETTERS), digit(k) % 8 + 1, F.lit(1))
    rows = spark.range(files).select("id", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")).alias("h"))
    folder = F.when(digit(1) % 2 == 0, letter(2)).otherwise(F.concat(letter(2), F.lit("/"), letter(3), letter(4)))
    rows = rows.select("id", "h", folder.alias("dir"), F.concat(folder, F.lit("/"), letter(5), letter(6)).alias("path"), digit(7).alias("n"))
    last = rows.groupBy("path").agg(F.max_by("h", "id").alias("h"), F.max_by("n", "id").alias("n"))
    last = last.join(rows.select(F.col("dir").alias("path")).distinct(), "path", "left_anti")
    return last.select("path", F.repeat(F.col("h"), F.col("n") + 1).cast("binary").alias("content"), F.lit(DEFAULT_MODE).alias("mode"))


FILES_SQL = """
WITH snaps AS (SELECT 'main' AS pack, CAST(range AS INTEGER) AS seq, 'snap-' || range AS tag FROM range(6)),
files AS (
  SELECT s.pack, s.seq, s.tag, d.source || '/' || d.lang || '/' || d.doc_id || '.txt' AS path, d.doc_id,
         sha1(CASE WHEN (d.doc_id + s.seq) % 7 = 0 THEN coalesce(d.text, '') || '#' || s.seq ELSE coalesce(d.text, '') END) AS checksum,
         CAST(octet_length(encode(CASE WHEN (d.doc_id + s.seq) % 7 = 0 THEN coalesce(d.text, '') || '#' || s.seq ELSE coalesce(d.text, '') END)) AS BIGINT) AS size,
         CAST(CASE WHEN (d.doc_id + s.seq) % 11 = 0 THEN 33277 ELSE 33204 END AS BIGINT) AS mode
  FROM documents d CROSS JOIN snaps s WHERE (d.doc_id * 3 + s.seq) % 5 <> 0
),
multi AS (
  SELECT 'p0' AS pack, seq, tag, path, checksum, size, mode FROM files WHERE seq <= 3
  UNION ALL SELECT 'p1', seq - 2, tag, path, checksum, size, mode FROM files WHERE seq IN (2, 3)
  UNION ALL SELECT 'loose/' || tag, 0, tag, path, checksum, size, mode FROM files WHERE seq >= 3
  UNION ALL SELECT 'p2', 0, 'snap-1', path, checksum, size, mode FROM files WHERE seq = 5
),
objects AS (SELECT pack, checksum, max(size) AS size FROM files GROUP BY pack, checksum),
layout AS (
  SELECT pack, checksum, size, CAST(coalesce(sum(size) OVER (PARTITION BY pack ORDER BY size, checksum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM objects
),
changes AS (
  SELECT f.pack, f.seq, 'A' AS op, f.path, f.checksum, f.mode, f.size FROM files f
  WHERE NOT EXISTS (SELECT 1 FROM files g WHERE g.seq = f.seq - 1 AND g.path = f.path AND g.checksum = f.checksum AND g.mode = f.mode)
  UNION ALL
  SELECT f.pack, f.seq + 1, 'R', f.path, f.checksum, f.mode, f.size FROM files f
  WHERE f.seq < 5 AND NOT EXISTS (SELECT 1 FROM files g WHERE g.seq = f.seq + 1 AND g.path = f.path AND g.checksum = f.checksum AND g.mode = f.mode)
),
prints AS (
  SELECT pack, seq, tag, sha1(unhex(string_agg(hex(encode(path)) || checksum || lpad(hex(mode), 8, '0'), '' ORDER BY checksum, hex(encode(path))))) AS fingerprint
  FROM multi GROUP BY pack, seq, tag
),
frames AS (
  SELECT pack, CAST(tile AS INTEGER) AS frame, CAST(sum(size) AS BIGINT) AS decompressed_size, CAST(sum(size) // 3 AS BIGINT) AS frame_size
  FROM (SELECT *, ntile(4) OVER (PARTITION BY pack ORDER BY size, checksum) - 1 AS tile FROM layout) GROUP BY pack, tile
),
starts AS (
  SELECT *, CAST(coalesce(sum(frame_size) OVER w, 0) AS BIGINT) AS frame_start, CAST(coalesce(sum(decompressed_size) OVER w, 0) AS BIGINT) AS data_start
  FROM frames WINDOW w AS (PARTITION BY pack ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
placed AS (
  SELECT l.pack, l.checksum, l.size, l."offset", max_by(s.frame, s.data_start * 1000 + s.frame) AS frame, l."offset" - max(s.data_start) AS local_offset
  FROM layout l JOIN starts s ON l.pack = s.pack AND s.data_start <= l."offset" GROUP BY l.pack, l.checksum, l.size, l."offset"
)
"""
