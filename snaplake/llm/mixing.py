"""Mixing sources to target weights by capped water-filling.

Each source has a weight and may be repeated a bounded number of epochs. The budget is poured over the
sources by weight; a source that would exceed its cap is clamped, and its excess is poured over the rest,
until none is above. The level has a closed form over the sources sorted by cap / weight, so it is a pair
of window sums over one row per source. A source's target is then met by whole repetitions of all its
documents, and one more repetition of the first documents of a seeded order, until the target is nearest.

Defined results: a null text has size 0; a very long text is one document of its size, which bounds how near a target can be met and takes 0 words; a null source is a source of its own, last in
order; repeated rows are rows of their own, and rows alike in doc_id, source and size share their fate; an empty table gives an empty table; other columns are kept by `mix` and
never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RANK_HEX, WORD, discard, seeded, with_running, written


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """sizes: one row per source (source, source_size). Adds target (double)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everywhere = Window.partitionBy()
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("__w", F.element_at(kinds, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("__cap", (F.col("source_size") * epochs).cast("double")).withColumn("__at", F.col("__cap") / F.col("__w"))
    s = s.withColumn("__all", F.sum("source_size").over(everywhere) * F.lit(float(share)))
    rising = Window.orderBy("__at", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("__cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("__level", (F.col("__all") - before) / rest)
    # the level rises along the sorted sources while they are clamped, and falls after that
    level = F.max(F.when(F.col("__level") <= F.col("__at"), F.col("__level"))).over(everywhere)
    s = s.withColumn("__level", level)
    target = F.when(F.col("__level").isNull() | (F.col("__at") < F.col("__level")), F.col("__cap")).otherwise(F.col("__w") * F.col("__level"))
    return s.withColumn("target", target).drop("__w", "__cap", "__at", "__all", "__level")


def _order(seed: int):
    """What puts a source's rows in their seeded order."""
    return F.struct(seeded(seed, F.col("doc_id")).alias("h"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), words(F.col("text")).alias("size"))


def sized(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, place in the seeded order (which holds the size) and size of each document, written: words are counted once."""
    rows = docs.select("doc_id", "source", _order(seed).alias("__o"))
    return written(rows.select("doc_id", "source", "__o", F.col("__o.size").alias("size")), "mix-sizes")


def plan(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """rows: sized's. One row a source: source, source_size, target, whole (repetitions of all its documents), last (the last document of the seeded order that is repeated once more).

    A document is repeated once more if the middle of its words lies within what is left of the target; that
    holds for the first documents of the order and for none after them, so one place says it all.
    """
    per = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per = per.withColumn("whole", whole)
    run = with_running(rows, ["source"], F.substring("__o.h", 1, RANK_HEX), [F.col("__o")], {"__before": F.col("size")})
    left = per.select(F.col("source").alias("__source"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("__left"))
    run = run.join(left, run["source"].eqNullSafe(left["__source"])).filter((F.col("size") > 0) & (F.col("__before") + F.col("size") / 2 <= F.col("__left")))
    last = run.groupBy(F.col("source").alias("__source")).agg(F.max("__o").alias("last"))
    out = per.join(last, per["source"].eqNullSafe(last["__source"]), "left").drop("__source")
    return written(out.select("source", F.col("source_size").cast("long").alias("source_size"), "target", "whole", "last"), "mix-plan")


def takes(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, the columns named in keep, size, source_size, target, repeats (copies of the document in the mix), taken (words). Texts are not moved: the plan comes to them."""
    keep = [c for c in (keep or []) if c not in ("doc_id", "source")]
    rows = sized(docs, seed)
    per = plan(rows, weights, share, epochs).withColumnRenamed("source", "__source")
    if keep:  # rows with their columns: counting words again costs less than bringing rows and sizes together
        discard(rows)
        rows = docs.select("doc_id", "source", *[F.col(c).alias(f"__keep_{c}") for c in keep], _order(seed).alias("__o"))
    rows = rows.join(per, rows["source"].eqNullSafe(per["__source"]))
    once_more = F.coalesce(F.col("__o") <= F.col("last"), F.lit(False)) & (F.col("__o.size") > 0)
    rows = rows.withColumn("repeats", F.least(F.col("whole") + once_more.cast("long"), F.lit(epochs)).cast("long"))
    return rows.select("doc_id", "source", *[F.col(f"__keep_{c}").alias(c) for c in keep], F.col("__o.size").alias("size"), "source_size", "target", "repeats", (F.col("__o.size") * F.col("repeats")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with docs' columns."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("__row"))  # one column, so that no name clashes
    taken = takes(rows, weights, share, epochs, seed, keep=["__row"])
    taken = taken.filter("repeats > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int"))))
    return taken.select("__row.*")
