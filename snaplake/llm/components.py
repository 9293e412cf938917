"""Connected components of a graph given as a table of links, by alternating large and small stars.

Each round replaces every node's links by links to its least neighbour; the number of links never grows and
components flatten to stars in a logarithmic number of rounds. Minima are grouped with partial sums, so
a hub costs one row a task, and the join of links with minima may be split by Spark where a hub is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_dir, small_or_merged, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: a, b (bigint, not null). node and component (its least reachable node) of every node that has a link to another."""
    shared_dir(links.sparkSession)
    now = written(_down(links.select("a", "b")).distinct(), "links")
    for _ in range(rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that a hub's links are dealt out by their rows alone and can be split
        least = written(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")), "least")
        # large star: neighbours above a node go to its minimum
        large = both.filter("b > a").join(small_or_merged(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _down(large).distinct()
        # small star: a node and its lower neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = written(_down(small).distinct(), "links")
        # done when every node hangs on one node that hangs on none
        tops = after.groupBy("a").count().filter("count > 1").select("a").union(after.select("b").join(after.select(F.col("a").alias("b")), "b", "left_semi")).limit(1)
        done = not tops.take(1)
        discard(now, least)
        now = after
        if done:
            break
    else:
        raise RuntimeError(f"links have not settled in {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component")))


def _down(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
