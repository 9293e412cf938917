"""From raw documents to packed training sequences: each stage is one corpus operator, written as Parquet and read again.

Defined results: a null text is empty wherever it is scored, compared, counted or packed; an empty text is kept or not by its
score alone, is a copy of every other empty one, takes no part in the mix (size 0) and so is not packed; a very long text is
used whole in every stage; of equal and near-equal documents the one with the smallest doc_id stays, of those without any
doc_id one; equal rows are copies of one another; a null doc_id or source is kept as it is, and a null source is a source
of its own; an empty table gives an empty table in every stage; other columns are kept up to the mix, whatever their names
are, and packing does not read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snaplake.llm import mixing, packing, passages, quality_model, simhash
from snaplake.llm.common import new_path
from snaplake.llm.tokens import default_tokenizer
from snaplake.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from all of documents' labels, whatever docs holds."""
    ship(spark)
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_model.keep_good(docs, quality_model.fit(labelled, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays: the one with the smallest doc_id."""
    ship(spark)
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A passage of 50 words or more that repeats across documents stays in the first of them."""
    ship(spark)
    return passages.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows are repeated, or left out, as the mix takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 token ids: one row a piece."""
    ship(spark)
    return packing.pack(docs, default_tokenizer())


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing", mixture), ("packing", packed)]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
