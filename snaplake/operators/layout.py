"""Pack layout: order, offsets, frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_prefix(df: DataFrame, group: list[str], order: list[str], value: str, name: str, *grains: Column) -> DataFrame:
    """Exclusive prefix sums of `value` in the order, in steps, so that no task sees all rows of a group.

    grains are ever finer keys: each one is constant or rises where the order rises and the grains before it stand still.
    Sums of the finest grains are added up grain by grain; only rows of one finest grain meet in a window.
    """
    names = [f"__g{i}" for i in range(len(grains))]
    df = df.withColumns(dict(zip(names, grains, strict=True)))
    per = df.groupBy(*group, *names).agg(F.sum(value).alias("__sum"))
    base = None
    for i, g in enumerate(names):
        coarse = per if i == len(names) - 1 else per.groupBy(*group, *names[: i + 1]).agg(F.sum("__sum").alias("__sum"))
        over = Window.partitionBy(*group, *names[:i]).orderBy(g).rowsBetween(Window.unboundedPreceding, -1)
        mine = coarse.withColumn("__before", F.coalesce(F.sum("__sum").over(over), F.lit(0))).drop("__sum")
        if base is not None:
            mine = mine.join(base, [*group, *names[:i]]).withColumn("__before", F.col("__before") + F.col("__base")).drop("__base")
        base = mine.withColumnRenamed("__before", "__base")
    inside = Window.partitionBy(*group, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(base, [*group, *names])
    return out.withColumn(name, (F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")).drop(*names, "__base")


def size_grain(size: Column) -> Column:
    """A key of at most about 14,000 values that never falls where size rises: the bits of a size's magnitude and the eight after the first."""
    magnitude = F.when(size < 1, 0).otherwise(F.length(F.conv(size.cast("string"), 10, 2)))
    rest = F.when(magnitude <= 9, size).otherwise(F.expr("1").cast("long") * F.floor(size / F.pow(F.lit(2.0), magnitude - 9)))
    return magnitude.cast("long") * 1024 + rest.cast("long")


def object_layout(objects: DataFrame) -> DataFrame:
    """Offset of each object (pack, checksum, size): smaller ones first, ties by checksum. A pack's sums are added up over magnitudes, then sizes, then the first hex digits of checksums."""
    grains = size_grain(F.col("size")), F.col("size"), F.substring("checksum", 1, 3)
    return with_prefix(objects, ["pack"], ["size", "checksum"], "size", "offset", *grains)


def greedy_partition(sizes: Column, n) -> Column:
    """Group number of each item of an array: at most n runs of neighbours, each but the last at most total div n; an item above that bound goes to the last run."""
    count = F.greatest(F.least(F.lit(n), F.size(sizes)), F.lit(1))
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    # what stays the same is told once, and of the runs only where they start: a step costs the same however long the array is
    start = F.struct(
        F.lit(0).cast("long").alias("load"), F.lit(0).alias("part"), F.lit(0).alias("at"), F.floor(total / count).cast("long").alias("bound"), (count - 1).alias("last"), F.array().cast("array<int>").alias("starts")
    )

    def step(s, x):
        stays = (s["part"] >= s["last"]) | (s["load"] + x <= s["bound"])
        part = F.when(stays, s["part"]).when(x <= s["bound"], s["part"] + 1).otherwise(s["last"])
        load = F.when(stays, s["load"] + x).otherwise(x)
        starts = F.when(stays | (s["at"] == 0), s["starts"]).otherwise(F.concat(s["starts"], F.array(s["at"])))
        return F.struct(load.alias("load"), part.cast("int").alias("part"), (s["at"] + 1).alias("at"), s["bound"].alias("bound"), s["last"].alias("last"), starts.alias("starts"))

    def parts(starts):
        runs = F.arrays_zip(F.concat(F.array(F.lit(0)), starts).alias("a"), F.concat(starts, F.array(F.size(sizes))).alias("b"))
        return F.flatten(F.transform(runs, lambda r, k: F.array_repeat(k, r["b"] - r["a"])))

    return F.transform(F.array(F.aggregate(sizes, start, step)["starts"]), parts)[0]


def run_starts(sizes: np.ndarray, counts: np.ndarray, n: int, unknown: int = 0) -> list[int]:
    """Places of the items that start a run of the partition, from a histogram of ascending sizes; items of unknown size come after all others and go to the last run."""
    ends, places = np.cumsum(sizes * counts), np.cumsum(counts)
    known, total = (int(places[-1]), int(ends[-1])) if len(ends) else (0, 0)
    parts = max(min(n, known + unknown), 1)
    bound, starts, load = total // parts, [0], 0
    while len(starts) < parts:
        j = int(np.searchsorted(ends, load + bound, side="right"))
        if j == len(ends):
            starts += [known] * bool(known and unknown)
            break
        before, place = (int(ends[j - 1]), int(places[j - 1])) if j else (0, 0)
        more = (load + bound - before) // int(sizes[j])
        if place + more <= starts[-1]:
            break  # the next item is above the bound: the rest is one run
        starts.append(place + more)
        load = before + more * int(sizes[j])
    return starts


#: Items that one row of item_runs' runs stands for, at most.
RUN_ROWS = 1 << 16


def item_runs(items: DataFrame, group: str, size: str, n: int) -> DataFrame:
    """group, i, part: the partition of each group's items, smaller ones first and those of unknown size last; i is an item's place, from 1.

    Places and runs depend on how many items have each size and on nothing else: that histogram is walked in one task a group
    (its rows are distinct sizes), and each item's row is made from the runs, a stretch of RUN_ROWS at a time.
    """
    sizes = items.groupBy(group, F.col(size).cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))

    def walk(h: pd.DataFrame) -> pd.DataFrame:
        told = h[h["size"].notna()].sort_values("size")
        starts = run_starts(told["size"].to_numpy(np.int64), told["n"].to_numpy(np.int64), n, int(h["n"].sum() - told["n"].sum()))
        ends = [*starts[1:], int(h["n"].sum())]
        rows = [(h[group].iloc[0], k, at + 1, min(at + RUN_ROWS, b)) for k, (a, b) in enumerate(zip(starts, ends, strict=True)) for at in range(a, b, RUN_ROWS)]
        return pd.DataFrame(rows, columns=[group, "part", "first", "last"])

    runs = sizes.groupBy(group).applyInPandas(walk, f"`{group}` {items.schema[group].dataType.simpleString()}, part int, first int, last int")
    return runs.repartition(group, "first").select(group, F.explode(F.sequence("first", "last")).alias("i"), "part")


def run_ends(sizes: np.ndarray, counts: np.ndarray, n: int) -> list[int]:
    """Where the runs of the partition start: from a histogram of ascending sizes instead of the objects themselves."""
    ends = np.cumsum(sizes * counts)
    total, parts = int(ends[-1]), max(min(n, int(counts.sum())), 1)
    bound, starts = total // parts, [0]
    while len(starts) < parts:
        limit = starts[-1] + bound
        j = int(np.searchsorted(ends, limit, side="right"))  # sizes before the j-th end within the limit, of the j-th some objects
        if j == len(ends):
            break
        before = int(ends[j - 1]) if j else 0
        to = before + (limit - before) // int(sizes[j]) * int(sizes[j]) if sizes[j] else before
        if to <= starts[-1]:
            break  # the next object is above the bound: the rest is one run
        starts.append(to)
    return starts


def frames_by_boundaries(objects: DataFrame, n: int) -> DataFrame:
    """The same partition for a table with offsets (object_layout's), pack by pack.

    As sizes ascend along the layout, the runs depend on how many objects have each size and on nothing else. That histogram
    has at most sqrt(2 * bytes) rows a pack (distinct sizes add up to no more than the bytes: 14 million rows for
    100 TB), is made with partial sums in one job whatever n is, and is walked in one task a pack.
    """
    sizes = objects.groupBy("pack", "size").agg(F.count(F.lit(1)).alias("n"))

    def walk(h: pd.DataFrame) -> pd.DataFrame:
        h = h.sort_values("size")
        starts = run_ends(h["size"].to_numpy(np.int64), h["n"].to_numpy(np.int64), n)
        return pd.DataFrame({"pack": h["pack"].iloc[0], "data_start": starts, "frame": np.arange(len(starts), dtype=np.int32)})

    starts = sizes.groupBy("pack").applyInPandas(walk, "pack string, data_start long, frame int")
    return _within(objects, starts).drop("local_offset")


def frame_offsets(frames: DataFrame) -> DataFrame:
    """Start of each frame in the pack file and in the decompressed stream: exclusive prefix sums over a few rows."""
    before = Window.partitionBy("pack").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    out = frames
    for size, start in (("frame_size", "frame_start"), ("decompressed_size", "data_start")):
        out = out.withColumn(start, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))
    return out


def _within(entries: DataFrame, starts: DataFrame) -> DataFrame:
    """entries (pack, offset) with frame and local_offset of the last of starts (pack, frame, data_start) at or before their offset, of equal starts the last.

    A pack is cut into as many stretches as it has frames. A frame is told to each stretch that it reaches, an entry asks in
    its own: the join is by equality of (pack, stretch), so neither a pack nor a long list of frames meets in one task.
    """
    following = Window.partitionBy("pack").orderBy("data_start", "frame")
    all_ = Window.partitionBy("pack")
    per = starts.select("pack", "frame", "data_start", F.lead("data_start").over(following).alias("__end"), (F.expr("max(data_start) OVER (PARTITION BY pack)")).alias("__top"), F.count(F.lit(1)).over(all_).alias("__n"))
    per = per.withColumn("__width", F.greatest(F.expr("__top div __n"), F.lit(1)))
    widths = per.groupBy("pack").agg(F.first("__width").alias("__width"), F.first("__top").alias("__top"))
    # a frame ends where the next one starts; the last one goes on
    per = per.filter("__end is null or __end > data_start")
    reach = F.sequence(F.expr("data_start div __width"), F.expr("coalesce(__end - 1, __top) div __width"))
    per = per.select("pack", "frame", "data_start", "__end", F.explode(reach).alias("__at"))
    # one row a pack
    asked = entries.join(widths, "pack").withColumn("__at", F.expr("least(offset, __top) div __width")).drop("__width", "__top")
    met = asked.join(per, ["pack", "__at"]).filter((F.col("data_start") <= F.col("offset")) & (F.col("__end").isNull() | (F.col("offset") < F.col("__end"))))
    return met.withColumn("local_offset", F.col("offset") - F.col("data_start")).drop("__at", "__end", "data_start")


def assign_frames(entries: DataFrame, frames: DataFrame) -> DataFrame:
    """As-of join of entries (pack, offset) with the last frame that starts at or before the offset, of equal starts the last; adds frame and local_offset."""
    return _within(entries.drop("frame"), frame_offsets(frames).select("pack", "frame", "data_start"))


def decompress_extent(entries: DataFrame) -> DataFrame:
    """Bytes of each frame that must be decompressed to reach its last wanted byte."""
    return entries.groupBy("pack", "frame").agg(F.max(F.col("local_offset") + F.col("size")).alias("extent"))


def seek_gaps(entries: DataFrame) -> DataFrame:
    """Bytes skipped before each distinct object, reading a frame forward."""
    once = entries.select("pack", "frame", "local_offset", "size").distinct()
    order = Window.partitionBy("pack", "frame").orderBy("local_offset", "size")
    return once.withColumn("gap", F.col("local_offset") - F.coalesce(F.lag(F.col("local_offset") + F.col("size")).over(order), F.lit(0)))
