"""SimHash fingerprints, and links between fingerprints that differ in few bits.

Pigeonhole: 64 bits are split into `parts` blocks; two fingerprints within `distance` bits agree on at least
`parts - distance` blocks. For each choice of that many blocks (a table) fingerprints meet that agree on
them, and meeting pairs are verified by their Hamming distance. Only distinct fingerprints take part, so
exact copies cost nothing. A bucket of more than `tile` fingerprints is split at random into tiles, and each
pair of tiles is a group of its own, so a group's size is bounded and no pair is left out. A group sends a
spanning set of its verified pairs, not all of them.

`near_copies` starts from the same fingerprints: texts whose fingerprints are in one component of links meet, and pairs are
verified by the similarity of their sets of shingles. Where an edit moves more bits than that (no distance of fingerprints
stands for a similarity of shingles where a block of words is added) texts meet in bands of min-hashes, too. Texts of a component or a band of up to `tile` meet one another. In a larger one they meet the first text, tile by tile, and then
only those that this leaves unconnected meet all others, so a group of near copies costs in proportion to its texts.

Defined results: a null text has no words; a very long text is hashed shingle by shingle, whole; a bit set in exactly half of
the hashes is 0; a text without words has fingerprint 0 and links like any other;
a null doc_id takes part, as the component's least id only if all its ids are null; repeated rows share
their fingerprint and component; an empty table gives no rows; other columns are never read, or kept by
`keep_one`.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import discard, small_or_merged, tidied, written
from .components import components
from .tokens import slices
from .words import Words, mixed, shingles

TILE = 2048
SETS = 512  # shingle sets of a tile
BANDS, ROWS = 20, 4
_MIX = np.random.default_rng(7).integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str, size: int = 3, distinct: bool = False) -> int:
    """Bit i is 1 if set in over half of the XXH64 hashes (seed 42) of the shingles: repeats included, unless distinct."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    line = b" ".join(words)
    if n == 1:
        some = [line]
    elif size == 1:
        some = words
    else:
        ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
        starts = [0, *[e + 1 for e in ends[: n - 1]]]
        some = [line[a:b] for a, b in zip(starts, ends[size - 1 :], strict=True)]
    if distinct:
        some = list(set(some))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in some], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = 3, distinct: bool = False) -> DataFrame:
    """doc_id and fp (the 64 bits as a bigint)."""

    def run(batches):
        for some in slices(batches):
            got = [signed(fingerprint(t, size, distinct)) for _, t in some]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.int64()), pa.array(got, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, fp long")


def masks(distance: int, n: int) -> list[int]:
    """The tables' masks: the fewest tables whose keys have at least log2(n) bits, less two (a few chance meetings a fingerprint)."""
    need = min(max(log2(max(n, 2)) - 2, 8), 64 - 2 * distance)
    parts = min((p for p in range(distance + 1, 33) if (p - distance) * (64 // p) >= need), key=lambda p: comb(p, distance))
    cuts = [64 * i // parts for i in range(parts + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, parts - distance)]


def spanning(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Verified pairs (positions) that connect all that verified pairs connect: of each fingerprint with the nearest one before it, and more where that leaves parts apart."""
    n = len(fps)
    root = list(range(n))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(1, n):
        d = np.bitwise_count(fps[:i] ^ fps[i])
        near = np.flatnonzero(d <= distance)
        if len(near):
            for j in near[np.argsort(d[near], kind="stable")].tolist():
                a, b = top(i), top(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((j, i))
    return out


def _tiled(met: DataFrame, bucket: list[str], item: str, tile: int) -> GroupedData:
    """Rows of buckets grouped so that the items of a bucket of up to `tile` rows meet in one group, and any two of a larger one in some group of about two tiles.

    Only counts of the buckets (partial sums) tell which are large; their rows are parted before they are brought together.
    """
    large = written(met.groupBy(*bucket).count().filter(F.col("count") > tile).select(*[F.col(c).alias(f"__{c}") for c in bucket], F.ceil(F.col("count") / tile).cast("int").alias("__tiles")), "large-buckets")
    if large.take(1):
        few = small_or_merged(large)
        on = [met[c] == few[f"__{c}"] for c in bucket]
        met = met.join(few, on, "left").select(*met.columns, F.coalesce("__tiles", F.lit(1)).alias("__tiles"))
        met = met.withColumn("__mine", F.pmod(F.xxhash64(item), F.col("__tiles")).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)))
        met = met.select(*bucket, item, F.least("__mine", "__other").alias("__lo"), F.greatest("__mine", "__other").alias("__hi"))
    else:
        met = met.select(*bucket, item, F.lit(0).alias("__lo"), F.lit(0).alias("__hi"))
    return met.groupBy(*bucket, "__lo", "__hi")


def links(distinct_fps: DataFrame, distance: int, tile: int = TILE) -> DataFrame:
    """distinct_fps: fp. Links a, b between fingerprints within distance, enough to connect all that are linked."""
    spark = distinct_fps.sparkSession
    tables = masks(distance, distinct_fps.count())
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(tables)])).alias("k")
    met = distinct_fps.select("fp", keys).select("fp", "k.t", "k.key")
    met = _tiled(met, ["t", "key"], "fp", tile).agg(F.collect_list("fp").alias("fps")).select("fps")

    def verify(batches):
        for b in batches:
            a, z = [], []
            for row in b.column(0):
                if len(row.values) < 2:
                    continue
                fps = np.sort(row.values.to_numpy(zero_copy_only=False))
                for i, j in spanning(fps.view(np.uint64), distance):
                    a.append(int(fps[i]))
                    z.append(int(fps[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return met.mapInArrow(tidied(verify), "a long, b long").distinct()


def _named(once: DataFrame, distance: int, tile: int) -> DataFrame:
    """once (fp and other columns, a row a fingerprint) with component, the least fingerprint reachable over links."""
    parts = components(links(once.select("fp"), distance, tile))
    # what no link reaches is a component of its own
    return once.join(parts, once["fp"] == parts["node"], "left").select(*once.columns, F.coalesce("component", "fp").alias("component"))


def linked(docs: DataFrame, distance: int = 2, size: int = 3, tile: int = TILE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every document."""
    prints = written(fingerprints(docs, size), "fingerprints")
    once = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    named = _named(once, distance, tile)
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(named, prints["fp"] == named["__fp"]).select("doc_id", "fp", "component_id")


def hexed(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def banded(v: np.ndarray) -> np.ndarray:
    """One hash a band: of ROWS min-hashes of the shingles v. Texts without a shingle share all bands."""
    least = np.full(len(_MIX), 2**64 - 1, np.uint64)
    for i in range(0, len(v), 4096):
        least = np.minimum(least, ((v[i : i + 4096] ^ _MIX[:, :1]) * _MIX[:, 1:]).min(axis=1))
    return mixed((mixed(least) * _MIX[:, 0]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs (positions) of at least this Jaccard similarity that connect all that such pairs connect: what is reached is compared with all that is not."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, names, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    some = counts[names] > 1  # what only one set holds is in no intersection
    names, owner = names[some], owner[some]
    own, at = names, np.searchsorted(owner, np.arange(n + 1))
    mark = np.zeros(len(counts), bool)
    waiting, out = np.ones(n, bool), []
    for s in range(n):
        if not waiting[s]:
            continue
        waiting[s] = False
        queue = [s]
        while queue and waiting.any():
            i = queue.pop()
            mine = own[at[i] : at[i + 1]]
            mark[mine] = True
            shared = np.bincount(owner[mark[names]], minlength=n)
            mark[mine] = False
            near = np.flatnonzero(waiting & (shared >= similarity * (sizes + sizes[i] - shared)))
            if len(near):
                out += [(i, j) for j in near.tolist()]
                queue += near.tolist()
                waiting[near] = False
                left = waiting[owner]
                names, owner = names[left], owner[left]
    return out


def _verified(groups: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """groups: g, key. texts: key, shingles. Links a, b that connect, group by group, all that pairs of enough similarity connect."""
    both = groups.hint("merge").join(texts, "key").select("g", "key", "shingles").repartition("g").sortWithinPartitions("g")

    def verify(batches):
        def links(keys, sets):
            found = alike([np.frombuffer(s, "<u4") for s in sets], similarity) if len(keys) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([keys[p[k]] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        now, keys, held = None, [], []
        for batch in batches:
            g = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(g)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)], strict=True):
                if e > s and g[s] != now:
                    if keys:
                        yield links(keys, held)
                    now, keys, held = g[s], [], []
                keys += batch.column(1)[s:e].to_pylist()
                held += batch.column(2)[s:e].to_pylist()
        if keys:
            yield links(keys, held)

    return both.mapInArrow(tidied(verify), "a long, b long")


def _with_first(crowd: DataFrame, tile: int) -> DataFrame:
    """crowd: band, key, n, rep (the first key of the band). g, key: tiles of a large band's texts, each with the first text in it, so the work is in proportion to the band."""
    star = crowd.filter("key <> rep").select("rep", "key").distinct()
    per = written(star.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts")), "near-first")
    parts = small_or_merged(per)
    mine = star.join(parts, "rep").select(F.xxhash64("rep", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).alias("g"), "key")
    first = per.select("rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return mine.union(first.select(F.xxhash64("rep", "part").alias("g"), F.col("rep").alias("key")))


def _with_rest(crowd: DataFrame, parts: DataFrame, tile: int) -> DataFrame:
    """g, key: what is not connected to the first text of its large band meets all texts of that band, tile by tile. Those that are connected need not meet: a component is all that is asked for."""
    named = parts.select(F.col("node").alias("key"), F.col("component").alias("mine"))
    of_first = parts.select(F.col("node").alias("rep"), F.col("component").alias("its"))
    of_first = small_or_merged(written(crowd.select("rep").distinct().join(of_first, "rep", "left"), "near-first-parts"))
    met = crowd.join(of_first, "rep").join(named, "key", "left")
    met = met.select("band", "key", "n", (F.coalesce("mine", "key") != F.coalesce("its", "rep")).alias("apart"))
    left = written(met.filter("apart").select("band", "key", "n"), "near-apart")
    per = written(left.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("some"), F.ceil(F.max("n") / tile).cast("int").alias("all")), "near-apart-bands")
    few = small_or_merged(per)

    def tiles(rows, own, other):
        """Each row in its tile of `own` ones, against each tile of `other` ones."""
        out = rows.join(few, "band").withColumn("__own", F.pmod(F.xxhash64("key"), F.col(own)).cast("int"))
        return out.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    one = tiles(left.select("band", "key"), "some", "all").select(F.xxhash64("band", "__own", "__other").alias("g"), "key")
    two = tiles(crowd.select("band", "key"), "all", "some").select(F.xxhash64("band", "__other", "__own").alias("g"), "key")
    return one.union(two).distinct()


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, tile: int = SETS, distance: int = 2, size: int = 3) -> DataFrame:
    """text_key (xxhash64 of the text) and keep (the doc_id that stays) for every text that is not the only one of its group.

    Candidates: texts whose SimHash fingerprints (as in `linked`) are in one component of links, and, for what fingerprints keep apart, texts
    that agree on all min-hashes of one of BANDS bands over their 5-word shingles; two texts of Jaccard similarity J meet in none with probability (1 - J^ROWS)^BANDS, whatever the edits are. Verification: by
    the exact Jaccard similarity of the shingles, until what pairs of a band's texts connect is connected.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))

    def shingle_sets(texts):
        for i in range(0, len(texts), 256):
            words = Words([t.as_py().encode().lower() for t in texts[i : i + 256]])
            for f, t in zip(words.from_.tolist(), words.to.tolist(), strict=True):
                yield shingles(words.hashes[f:t], shingle)

    def run(batches):
        for b in batches:
            got = [banded(v).view(np.int64) for v in shingle_sets(b.column(2))]
            fps = [signed(fingerprint(t.as_py(), size)) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(got, pa.list_(pa.int64()))], names=["doc_id", "key", "fp", "bands"])

    rows = written(keyed.mapInArrow(tidied(run), "doc_id long, key long, fp long, bands array<long>"), "near-prints")
    nodes = written(rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "near-nodes")
    prints = written(_named(written(nodes.select("fp").distinct(), "near-fingerprints"), distance, TILE).select(F.col("fp").alias("__fp"), "component"), "near-components")
    kin = nodes.join(prints.hint("merge"), nodes["fp"] == prints["__fp"]).select("key", F.xxhash64(F.lit("simhash"), "component").alias("band"))
    # a component of fingerprints is one more group in which texts meet
    met = meetings = written(kin.union(nodes.select("key", F.explode("bands").alias("band"))), "near-meetings")
    large = written(met.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("rep")).filter(F.col("n") > tile), "large-bands")
    hot = bool(large.take(1))
    if hot:
        few = small_or_merged(large)
        crowd = written(met.join(few, "band").select("band", "key", "n", "rep"), "near-crowds")
        met = met.join(few, "band", "left_anti")
    met = met.groupBy("band").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    # the same texts meet in many bands: once is enough
    met = met.select("keys").filter(F.size("keys") > 1).distinct()
    met = met.select(F.xxhash64("keys").alias("g"), F.explode("keys").alias("key"))
    if hot:
        met = met.union(_with_first(crowd, tile))
    met = written(met, "near-tiles")
    ids = written(met.select("key").distinct().join(nodes.select("key", "first"), "key").withColumnRenamed("key", "__key"), "near-ids")
    texts = keyed.join(ids.hint("merge"), (keyed["key"] == ids["__key"]) & keyed["doc_id"].eqNullSafe(ids["first"]), "left_semi")

    def sets(batches):
        for b in batches:
            out = [np.unique((v >> np.uint64(32)).astype("<u4")).tobytes() for v in shingle_sets(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.binary())], names=["key", "shingles"])

    texts = texts.mapInArrow(tidied(sets), "key long, shingles binary")
    texts = written(texts.dropDuplicates(["key"]), "near-shingles")
    found = written(_verified(met, texts, similarity), "near-links")
    parts = components(found)
    if hot:
        rest = written(_with_rest(crowd, parts, tile), "near-rest")
        if rest.take(1):
            parts = components(found.union(_verified(rest, texts, similarity)))
    named = nodes.join(parts, nodes["key"] == parts["node"], "left").select("key", "first", "n", F.coalesce("component", "key").alias("part"))
    least = named.groupBy("part").agg(F.min("first").alias("keep"), F.sum("n").alias("all"))
    groups = written(named.join(least, "part").filter("all > 1").select(F.col("key").alias("text_key"), "keep"), "near-groups")
    discard(rows, nodes, prints, meetings, met, ids, texts, found)
    return groups


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs, all columns, with one document (the smallest doc_id) of each group of exact and near copies."""
    columns = docs.columns
    groups = near_copies(docs, **how).select(F.col("text_key").alias("__key"), F.col("keep").alias("__keep"))
    held = docs.withColumn("__text_key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    held = held.join(groups.hint("merge"), held["__text_key"] == groups["__key"], "left")
    held = held.filter(F.col("__key").isNull() | F.col("doc_id").eqNullSafe(F.col("__keep")))
    # the same row several times is a group of copies too; only such rows are brought together
    ids = docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__again"))
    ids = written(ids, "repeated-ids")
    if not ids.take(1):
        return held.select(*columns)
    mark = held.join(ids.withColumn("__twice", F.lit(True)), held["doc_id"].eqNullSafe(ids["__again"]), "left")
    return mark.filter("__twice is null").select(*columns).union(mark.filter("__twice").dropDuplicates(["doc_id", "__text_key"]).select(*columns))
