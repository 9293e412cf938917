"""Substring dedup: passages that repeat across documents, found by compact windows.

A document is a sequence of 5-word shingles (A-Z lower-cased). Under one hash function, a compact window
(l, c, r) stands for all subsequences within [l, r] that contain c, where c has the least hash: they all have the
same min-hash. The windows at least as wide as the shortest passage are the upper nodes of the Cartesian
tree of the hashes, about 2n / width of n positions. Windows of different documents that share a min-hash meet
under that key; a passage that repeats word for word shares it under every hash function, a similar one
under most. Within a document the intervals of its shared windows are joined: only stretches that enough
hash functions cover are candidates, each against the first documents that have the same window key and surroundings.
Candidates are verified word for word from the two anchors on: equal runs are chained over words put in, left
out or changed, and a stretch counts if it is long enough and its shingles have a Jaccard similarity of at least `similarity`.

A repeated passage reaches at least half its width to the left or to the right of its anchor, so a shared
window counts only if the 16 shingles on one side of the anchor are the same too (their hashes travel with
it); this drops chance meetings, such as those on common lines, before any text is moved.

The windows of a key that have the same surroundings (`_surroundings`) are compared with the first of them, so a
passage in m documents costs a few m rows, and an earlier window of other surroundings hides none; keys with very many windows are taken out of the shuffle by key.

An earlier document may hold those surroundings and still not the passage, and so hide it from later ones. So a second round
follows: where a document and a first one part, the runs of a passage's width (and of half of it) that reach over the end of what
they share are told by their hashes (`edge_grams`), and each meets the first document that told the same run. A run is whole in a document or is not, so
this hides no passage that repeats word for word.

Defined results: a null text has no words; a very long text is scanned in segments and compared whole; equal minima
make the middle one an anchor; texts shorter than a passage have none; a null doc_id neither
gives nor loses passages; rows that share a doc_id are one document, and repeats within one document do
not count; of equal passages the one in the smallest doc_id stays; an empty table gives no rows; other
columns are never read, or kept by `without_repeats`, which drops documents it leaves without a word.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_or_merged, tidied, written
from .tokens import slices
from .words import Words, grams, mixed

SHINGLE = 5
HASHES = 3
ENOUGH = 1  # functions under which a stretch must share its minimum: a candidate is verified word by word
CONTEXT = 16  # shingles
FAR = 2 * CONTEXT
GAP = 32  # shingles: how far runs may part at least
HOT = 32_000  # windows of a key
HUB = 256  # pairs with one document whose text travels with them as one group
PASSAGE = 50  # words
SIMILARITY = 0.8
_MIX = np.random.default_rng(6).integers(1, 1 << 63, (HASHES, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingled(texts: list[str]) -> list[np.ndarray]:
    words = Words([t.encode().lower() for t in texts])
    return [grams(words.hashes[a:b], SHINGLE) for a, b in zip(words.from_.tolist(), words.to.tolist(), strict=True)]


def compact_windows(v: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(l, c, r), ends included, of all nodes of v's Cartesian tree that span at least width positions."""
    out, todo = [], [(0, len(v))]
    while todo:
        a, b = todo.pop()
        if b - a < width:
            continue
        part = v[a:b]
        c = int(part.argmin())
        if b - a > 512:  # of many equal minima the middle one, so that repetitive texts make flat trees
            same = np.flatnonzero(part == part[c])
            c = int(same[len(same) // 2])
        c += a
        out.append((a, c, b - 1))
        if c - a >= width:
            todo.append((a, c))
        if b - c - 1 >= width:
            todo.append((c + 1, b))
    return out


def _sliding(v: np.ndarray, width: int, least_or_most) -> np.ndarray:
    """The least (or most) of each `width` values in a row, by ever wider pieces."""
    size = 1
    while 2 * size <= width:
        v, size = least_or_most(v[:-size], v[size:]), 2 * size
    return least_or_most(v[: len(v) - (width - size)], v[width - size :]) if size < width else v


def compact_windows_of_all(v: np.ndarray, from_: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Which part, and (l, c, r) within it, of the compact windows of all parts of v, which start at from_: v is zero at both ends and between parts, and only there.

    The windows' anchors are the least values of `width` in a row; each reaches to the nearest lower ones, which are anchors too. Of equal values the first one
    parts a stretch, as in `compact_windows`; stretches where that would take a middle one go through it.
    """
    if len(v) < width:
        return (np.zeros(0, np.int64),) * 4
    none = np.zeros(width - 1, v.dtype)
    at = np.flatnonzero(_sliding(np.concatenate([none, _sliding(v, width, np.minimum), none]), width, np.maximum) == v)
    w, mine = v[at], np.flatnonzero(v[at])
    left, right = np.arange(len(at)) - 1, np.arange(len(at)) + 1
    for side in (left, right):
        todo = mine
        while len(todo := todo[w[side[todo]] >= w[todo]]):
            side[todo] = side[side[todo]]
    # equal values with the same lower one before them stand in one stretch
    order = mine[np.argsort(left[mine], kind="stable")]
    same = np.flatnonzero((left[order[1:]] == left[order[:-1]]) & (w[order[1:]] == w[order[:-1]]))
    tied = order[same + 1]
    wide = tied[at[right[tied]] - at[left[tied]] - 1 > 512]
    inside, again, end = np.zeros(len(at) + 1, np.int8), [], 0
    for a, b in sorted({(a, -b) for a, b in zip(left[wide].tolist(), right[wide].tolist(), strict=True)}):
        if a >= end:  # in no stretch that is done already
            end = -b
            again.append((a, end))
            inside[a + 1] += 1
            inside[end] -= 1
    left[tied] = order[same]
    l, r = left[mine], right[mine]
    keep = (at[r] - at[l] - 1 >= width) & (np.cumsum(inside[:-1])[mine] == 0)
    out = [(at[l[keep]] + 1, at[mine[keep]], at[r[keep]] - 1)]
    for a, b in again:
        found = np.array(compact_windows(v[at[a] + 1 : at[b]], width), np.int64).reshape(-1, 3)
        out.append(tuple(found.T + at[a] + 1))
    l, c, r = (np.concatenate(x) for x in zip(*out, strict=True))
    which = np.searchsorted(from_, c, side="right") - 1
    return which, l - from_[which], c - from_[which], r - from_[which]


def _around(h: np.ndarray, at: np.ndarray, from_: np.ndarray, to: np.ndarray) -> list[np.ndarray]:
    """Of places `at` in parts h[from_:to], for CONTEXT and for FAR: 16 bits of a hash of that many shingles from it on, and 16 of those up to it; 0: none on that side."""
    run, size = h, 1
    while size < CONTEXT:  # CONTEXT is a power of two
        run, size = run[:-size] * _MIX.flat[size.bit_length()] + run[size:], 2 * size
    near = mixed(run)
    out = []
    for run, size in ((near, CONTEXT), (mixed(near[:-CONTEXT] * np.uint64(3) + near[CONTEXT:]), FAR)):
        side = np.append((run & np.uint64(0xFFFF)).astype(np.uint32) | np.uint32(1), np.uint32(0))
        ahead, back = (side[np.where(has, place, len(side) - 1)] for has, place in ((at + size <= to, at), (at - size + 1 >= from_, at - size + 1)))
        out.append(ahead << np.uint32(16) | back)
    return out


def windows(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """doc_id, key (its two lowest bits name the hash function), ctx and far (hashes of the anchor's right and left contexts of 16 and of 32 shingles), l, c, r."""
    width = passage - SHINGLE + 1

    def run(batches):
        for some in slices(batches):
            some = [(doc, t) for doc, t in some if doc is not None]
            words = Words([t.encode().lower() for _, t in some])
            # the places of all texts in one row: runs of words that reach into the next text are zeros between them
            h = np.pad(grams(words.hashes, SHINGLE), 1)
            from_, to = words.from_ + 1, np.maximum(words.from_, words.to - SHINGLE + 1) + 1
            inside = np.zeros(len(h) + SHINGLE, np.int8)
            np.add.at(inside, from_, 1)
            np.add.at(inside, to, -1)
            between = np.cumsum(inside[: len(h)]) == 0
            docs_ = np.array([doc for doc, _ in some], dtype=np.int64)
            cols = []
            for i in range(HASHES):
                v = np.maximum((h ^ _MIX[i, 0]) * _MIX[i, 1], np.uint64(1))
                v[between] = 0
                which, l, c, r = compact_windows_of_all(v, from_, width)
                at = c + from_[which]
                key = (v[at] & np.uint64(2**64 - 4)) | np.uint64(i)
                ctx, far = _around(h, at, from_[which], to[which]) if len(at) else (np.zeros(0, np.uint32),) * 2
                cols.append([docs_[which], key.view(np.int64), ctx.view(np.int32), far.view(np.int32), *[x.astype(np.int32) for x in (l, c, r)]])
            yield from _batches([np.concatenate(c) for c in zip(*cols, strict=True)])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, key long, ctx int, far int, l int, c int, r int")


def _surroundings() -> list[Column]:
    """What a window's first one must share: 16 shingles on one side of the anchor, 32 on one side, 16 on both; null where the text has fewer.

    A repeated passage of 46 shingles shares one of the last three kinds, 31 shingles or more, wherever its anchor is.
    """
    part = lambda c, shift: F.shiftrightunsigned(c, shift).bitwiseAND(0xFFFF)
    sides = [F.nullif(part(c, shift), F.lit(0)) for c in ("ctx", "far") for shift in (16, 0)]
    return [*sides, F.when(sides[0].isNotNull() & sides[1].isNotNull(), F.col("ctx"))]


def _firsts(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (doc_id, key, ctx, far, l, c, r; in order of whole keys) with b, bc as of `with_first`."""
    starts = np.flatnonzero(np.concatenate([[True], cols[1][1:] != cols[1][:-1]]))
    n = np.diff(np.append(starts, len(cols[1])))
    # most keys are of one document
    keep = np.repeat(np.minimum.reduceat(cols[0], starts) < np.maximum.reduceat(cols[0], starts), n)
    group = np.repeat(np.arange(len(starts), dtype=np.uint64), n)[keep] << np.uint64(32)
    cols = [v[keep] for v in cols]
    order = np.lexsort((cols[5], cols[0]))
    cols, group = [v[order] for v in cols], group[order]
    doc, _, ctx, far, _, c, _ = cols
    place = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (c[1:] != c[:-1])])[: len(doc)])  # equal for equal (doc_id, c)
    ctx, far = ctx.view(np.uint32), far.view(np.uint32)
    low, both = np.uint32(0xFFFF), (ctx >> np.uint32(16) > 0) & (ctx & np.uint32(0xFFFF) > 0)
    met = []
    for kind in (ctx >> np.uint32(16), ctx & low, far >> np.uint32(16), far & low, np.where(both, ctx, np.uint32(0))):
        rows = np.flatnonzero(kind)
        _, first, of = np.unique(group[rows] | kind[rows], return_index=True, return_inverse=True)
        first = rows[first][of]
        later = doc[first] < doc[rows]
        met.append((rows[later] << 32) | place[first[later]])
    met = np.unique(np.concatenate(met))
    first = np.searchsorted(place, met & 0xFFFFFFFF)
    return [*(v[met >> 32] for v in cols), doc[first], c[first]]


def _with_firsts(batches):
    """`_firsts` of batches in order of their keys; a key's rows wait for its end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if held[0].column(1)[0] == batch.column(1)[batch.num_rows - 1]:
            continue
        cols = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(7)]
        end = int(np.searchsorted(cols[1], cols[1][-1]))
        yield from _batches(_firsts([v[:end] for v in cols]))
        held = [pa.RecordBatch.from_arrays([pa.array(v[end:]) for v in cols], names=batch.schema.names)]
    if held:
        yield from _batches(_firsts([np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(7)]))


def _batches(cols: list[np.ndarray]):
    for at in range(0, len(cols[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 50_000]) for v in cols], names=["doc_id", "key", "ctx", "far", "l", "c", "r", "b", "bc"][: len(cols)])


def with_first(found: DataFrame, hot: int = HOT) -> DataFrame:
    """found with b, bc: the first windows (by document) of each window's key that have the same surroundings, a row for each, for those of later documents.

    Rows of a key meet in one task, sorted by key. Keys of more than about `hot` rows, told by counting the windows
    of one document in 64 (which only chooses the plan), do not: the first windows of their surroundings are
    found by partial sums, written, and joined back, by broadcast if they are few and else by a join that Spark may split.
    """
    seen = found.filter(F.pmod(F.xxhash64("doc_id"), F.lit(64)) == 0).groupBy("key").count().filter(F.col("count") > hot // 64)
    seen = written(seen.select("key"), "hot-keys")
    first = F.struct("doc_id", "c")
    any_hot = bool(seen.take(1))
    seen = small_or_merged(seen)
    cold = found.join(seen, "key", "left_anti") if any_hot else found
    cold = cold.select("doc_id", "key", "ctx", "far", "l", "c", "r").repartition("key").sortWithinPartitions("key")
    cold = cold.mapInArrow(tidied(_with_firsts), "doc_id long, key long, ctx int, far int, l int, c int, r int, b long, bc int")
    if any_hot:
        some = found.join(seen, "key", "left_semi")
        some = some.withColumn("__s", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), v.alias("v")) for i, v in enumerate(_surroundings())]))).filter("__s.v is not null")
        some = some.select(*found.columns, F.col("__s.kind").alias("__kind"), F.col("__s.v").alias("__v"))
        few = some.groupBy("key", "__kind", "__v").agg(F.min(first).alias("__f"), F.max("doc_id").alias("__hi")).filter("__f.doc_id < __hi").drop("__hi")
        # written, so that what is joined is dealt out by its rows alone and a hot group can be split
        few = small_or_merged(written(few, "hot-firsts"))
        some = some.join(few, ["key", "__kind", "__v"]).filter("doc_id > __f.doc_id")
        cold = cold.union(some.select("doc_id", "key", "ctx", "far", "l", "c", "r", F.col("__f.doc_id"), F.col("__f.c")))
    return cold


def candidates(found: DataFrame, passage: int = PASSAGE, enough: int = ENOUGH, hot: int = HOT) -> DataFrame:
    """a, b (the earlier document), anchors: places in a and b that should align."""
    width = passage - SHINGLE + 1
    met = with_first(found, hot)
    met = met.groupBy(F.col("doc_id").alias("a")).agg(F.collect_list(F.struct(F.col("key").bitwiseAND(3).cast("int").alias("j"), "l", "c", "r", "b", "bc")).alias("w"))

    def join_intervals(batches):
        for batch in batches:
            a, b, anchors = [], [], []
            for doc, w in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                j, l, c, r, other, bc = (w.values.field(i).to_numpy(zero_copy_only=False) for i in range(6))
                top = int(r.max()) + 2
                cover = np.zeros(top, np.int32)
                for i in range(HASHES):
                    edge = np.zeros(top, np.int32)
                    np.add.at(edge, l[j == i], 1)
                    np.add.at(edge, r[j == i] + 1, -1)
                    cover += np.cumsum(edge) > 0
                good = np.concatenate([[0], np.cumsum(cover >= enough)])
                # a window counts if enough functions cover a passage's width of it
                edges = np.flatnonzero(np.diff((cover >= enough).astype(np.int8), prepend=0, append=0))
                wide = np.zeros(top + 1, bool)
                for s, e in edges.reshape(-1, 2):
                    wide[s:e] = e - s >= width
                share = np.concatenate([[0], np.cumsum(wide[:top])])
                keep = (share[r + 1] - share[l] >= width) & (good[r + 1] - good[l] >= width)
                pairs: dict[int, dict[int, tuple[int, int]]] = {}
                for o, x, y in zip(other[keep].tolist(), c[keep].tolist(), bc[keep].tolist(), strict=True):
                    pairs.setdefault(o, {}).setdefault(x - y, (x, y))
                for o, p in pairs.items():
                    a.append(doc)
                    b.append(o)
                    anchors.append([v for q in p.values() for v in q])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(anchors, pa.list_(pa.int32()))], names=["a", "b", "anchors"])

    return met.mapInArrow(tidied(join_intervals), "a long, b long, anchors array<int>")


def joined(runs: list[tuple[int, int, int]], width: int, similarity: float) -> list[tuple[int, int, int]]:
    """Stretches (from and to in x, from in y) of equal runs (place in x, place in y, length; in order) that are wide and similar enough: the widest one, then the widest before and after it.

    Equal shingles count for a stretch, those between its runs against it, so that a stretch is similar enough where its sum is not
    negative; the widest such stretch is found in one pass over the sums before and after each run.
    """
    if not runs or runs[-1][0] + runs[-1][2] - runs[0][0] < width:
        return []
    least = 2 * similarity / (1 + similarity)  # of both sides' shingles, for this Jaccard similarity
    # a stretch has `width` shingles of x and at least its equal ones of y
    if (2 - least) * sum(n for _, _, n in runs) < least * width - 1e-6:
        return []
    before, after, total = [], [], 0.0
    for k, (s, t, n) in enumerate(runs):
        if k:
            i, j, m = runs[k - 1]
            total -= least * (s - i - m + t - j - m)
        before.append(total)
        total += (2 - 2 * least) * n
        after.append(total)
    out, todo = [], [(0, len(runs))]
    while todo:
        a, b = todo.pop()
        if a >= b or runs[b - 1][0] + runs[b - 1][2] - runs[a][0] < width:
            continue
        opens: list[int] = []  # where a stretch may start: the sum before it is lower than before all earlier ones
        for i in range(a, b):
            if not opens or before[i] < before[opens[-1]]:
                opens.append(i)
        best = (0, a, a)
        for j in range(b - 1, a - 1, -1):
            while opens and (opens[-1] > j or after[j] >= before[opens[-1]] - 1e-9):
                i = opens.pop()
                if i <= j:
                    best = max(best, (runs[j][0] + runs[j][2] - runs[i][0], i, j))
        if best[0] >= width:
            _, i, j = best
            out.append((runs[i][0], runs[j][0] + runs[j][2], runs[i][1]))
            todo += [(a, i), (j + 1, b)]
    return sorted(out)


def aligned(x: np.ndarray, y: np.ndarray, at: int, to: int, least: int = 1) -> list[tuple[int, int, int]]:
    """Equal runs along the diagonal through x[at], y[to]; none where they are fewer than `least` shingles in all."""
    lead = min(at, to)
    n = lead + min(len(x) - at, len(y) - to)
    same = x[at - lead : at - lead + n] == y[to - lead : to - lead + n]
    if np.count_nonzero(same) < least:
        return []
    edge = np.flatnonzero(same[1:] != same[:-1]) + 1
    edges = [*([0] if same[0] else []), *edge.tolist(), *([n] if same[-1] else [])]
    return [(s + at - lead, s + to - lead, e - s) for s, e in zip(edges[::2], edges[1::2], strict=True)]


def _meeting(p: np.ndarray, q: np.ndarray) -> tuple[int, int] | None:
    """The nearest places in p and q (by the further one, then that in p) that hold one value."""
    if len(q) > 128:
        values, first = np.unique(q, return_index=True)
        at = np.minimum(np.searchsorted(values, p), len(values) - 1)
        far = np.where(values[at] == p, np.maximum(first[at], np.arange(len(p))), len(q) + len(p))
        k = int(far.argmin())
        return (k, int(first[at[k]])) if values[at[k]] == p[k] else None
    same = p[:, None] == q
    if not same.any():
        return None
    i, j = np.nonzero(same)
    k = int(np.maximum(i, j).argmin())
    return int(i[k]), int(j[k])


def _onward(x: np.ndarray, y: np.ndarray, got: int = 0) -> list[tuple[int, int, int]]:
    """Equal runs from the starts of x and y on; where they part, the nearest place where they meet again, on any diagonal within reach or ever on this one."""
    out, i, j = [], 0, 0
    while (m := min(len(x) - i, len(y) - j)) > 0:
        same = x[i : i + m] == y[j : j + m]
        n = int(same.argmin())
        n = m if same[n] else n
        if n:
            out.append((i, j, n))
            i, j, got = i + n, j + n, got + n
        if n == m:
            break
        skip = int(same[n:].argmax())
        skip = skip if same[n + skip] else 0
        reach = max(GAP, got // 4)
        to = min(reach, skip or reach)
        near = _meeting(x[i : i + to], y[j : j + to])
        if near:
            i, j = i + near[0], j + near[1]
        elif skip:
            i, j = i + skip, j + skip
        else:
            break
    return out


def chained(x: np.ndarray, y: np.ndarray, at: int, to: int) -> list[tuple[int, int, int]]:
    """Equal runs through x[at], y[to] both ways, over words put in or left out."""
    right = [(at + i, to + j, n) for i, j, n in _onward(x[at:], y[to:])]
    left = _onward(x[:at][::-1], y[:to][::-1], sum(n for _, _, n in right))
    return [(at - i - n, to - j - n, n) for i, j, n in reversed(left)] + right


def verified(x: np.ndarray, y: np.ndarray, anchors: list[tuple[int, int]], width: int, similarity: float, equal: list | None = None) -> list[tuple[int, int, int]]:
    """The stretches of x (from and to, and from where in y) that hold an anchor and stand in y. The equal runs met on the way are added to `equal`.

    Anchors in stretches already found add nothing; repetitive texts have thousands of them. So those that lie in none yet come first,
    and the others after them, if something around them is still untold.
    """
    told, out, waiting = np.zeros(len(x), bool), [], []
    ran: dict[int, list[tuple[int, int]]] = {}  # runs of chains, by diagonal: an anchor in one of them has the same chain
    anchors = [(i, j) for i, j in anchors if i < len(x) and j < len(y)]
    for again, some in ((False, anchors), (True, waiting)):
        for i, j in some:
            if told[i] and not again:
                waiting.append((i, j))
            elif not told[max(0, i - width) : i + width].all():
                chain = [] if any(s <= i < e for s, e in ran.get(i - j, ())) else chained(x, y, i, j)
                for s, t, n in chain:
                    ran.setdefault(s - t, []).append((s, s + n))
                for runs in (chain, aligned(x, y, i, j, width // 2)):
                    if equal is not None:
                        equal += [(s, n) for s, _, n in runs if n >= CONTEXT]
                    for s, e, t in joined(runs, width, similarity):
                        if not told[s:e].all():
                            out.append((s, e, t))
                            told[s:e] = True
    return out


def edge_grams(x: np.ndarray, equal: list[tuple[int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of `size` shingles of x that share CONTEXT or more with an equal run (place, length) and lie within none."""
    places = max(len(x) - size + 1, 0)
    near, within = np.zeros(places, bool), np.zeros(places, bool)
    for s, n in set(equal):
        near[max(0, s + CONTEXT - size) : max(0, s + n - CONTEXT + 1)] = True
        within[s : max(s, s + n - size + 1)] = True
    at = np.flatnonzero(near & ~within)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    # a run's sum of hashes by powers of an odd number, from the sums of all beginnings of x
    factor = int(_MIX[0, 1])
    powers, back = (np.cumprod(np.full(len(x), f, np.uint64)) for f in (factor, pow(factor, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(x) * powers)])
    return at, mixed((sums[at + size] - sums[at]) * back[at] * powers[0])


def edge_bundles(x: np.ndarray, equal: list[tuple[int, int]], spans: list[tuple[int, int, int]], size: int) -> tuple[np.ndarray, ...]:
    """The runs of `edge_grams` in bundles: first place, number of runs, key, and whether one of `spans` holds them; and the hashes of all runs.

    A bundle's runs lie side by side and have the same least shingle, by which its key is told. So equal runs are in bundles of one key, whatever else is in these.
    """
    at, hashes = edge_grams(x, equal, size)
    if not len(at):
        return at, at, hashes, at > 0, hashes
    inside = np.zeros(len(x), bool)
    for s, e, _ in spans:
        inside[s : max(s, e - size + 1)] = True
    held, least = inside[at], _sliding(mixed(x), size, np.minimum)[at]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (held[1:] != held[:-1])]))
    return at[new], np.diff(np.append(new, len(at))), mixed(least[new] + np.uint64(size)), held[new], hashes


def _with_texts(pairs: DataFrame, texts: DataFrame, hub: int = HUB) -> DataFrame:
    """pairs with at and bt, the texts of a and b. Where more than `hub` pairs name one document its text is sent once for each `hub` of them or so, and they part."""
    out = pairs
    for end in ("a", "b"):
        n = pairs.groupBy(F.col(end).alias("__id")).count().withColumn("__parts", F.ceil(F.col("count") / hub).cast("int"))
        hubs = written(n.filter("__parts > 1").select("__id", "__parts"), "passage-hubs")
        if hubs.take(1):
            hubs = small_or_merged(hubs)
            out = out.join(hubs, out[end] == hubs["__id"], "left").drop("__id").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
            mine = texts.join(hubs, texts["id"] == hubs["__id"], "left").select("id", "text", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)).alias("__part"))
        else:
            out, mine = out.withColumn("__parts", F.lit(1)), texts.withColumn("__part", F.lit(0))
        other = "b" if end == "a" else "a"
        out = out.withColumn("__part", F.pmod(F.xxhash64(other), F.col("__parts")).cast("int")).drop("__parts")
        mine = mine.select(F.col("id").alias(end), "__part", F.col("text").alias(end + "t"))
        # merge joins at every size: what small tables would broadcast, large ones shuffle
        out = out.hint("merge").join(mine, [end, "__part"]).drop("__part")
    return out


SPANS = "doc_id long, start int, n_words int, source_doc_id long, source_start int"


def _verify(pairs: DataFrame, texts: DataFrame, width: int, similarity: float, edges: bool) -> DataFrame:
    """SPANS of pairs (a, b, anchors) whose texts (id, text) agree; with edges also `edge`, null in these rows, and a row for each of `edge_bundles` (start: its first place, edge: its key, runs: their hashes, held)."""
    both = _with_texts(pairs, texts)
    schema = SPANS + ", edge long, runs array<long>, held boolean" * edges
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    names = [x.split()[0] for x in schema.split(", ")]

    def verify(batches):
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part, rows, told = batch.slice(i, 64), [], []
                a, b, anchors, at, bt = (part.column(k).to_pylist() for k in range(5))
                # pairs come sorted by one of their documents: a text that is in many of them is hashed once
                texts = dict.fromkeys(t or "" for t in [*at, *bt])
                new = [t for t in texts if t not in known]
                known = {t: known[t] for t in texts if t in known} | dict(zip(new, shingled(new), strict=True))
                for d, o, p, t, u in zip(a, b, anchors, at, bt, strict=True):
                    x, y, equal = known[t or ""], known[u or ""], [] if edges else None
                    spans = verified(x, y, list(zip(p[::2], p[1::2], strict=True)), width, similarity, equal)
                    rows += [(d, s, e - s + SHINGLE - 1, o, t) for s, e, t in spans]
                    if equal:
                        told += [(d, size, *edge_bundles(x, equal, spans, size)) for size in (width, width // 2 + 1)]
                cols = [pa.array(list(c), k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)]
                more = [pa.nulls(len(rows), k) for k in (pa.int64(), pa.list_(pa.int64()), pa.bool_())]
                yield pa.RecordBatch.from_arrays([*cols, *(more if edges else [])], names=names)
                if told:
                    n = [len(t[2]) for t in told]
                    doc, words = (np.repeat(np.array([t[k] for t in told], np.int64), n) for k in (0, 1))
                    place, many, edge, held, runs = (np.concatenate([t[k] for t in told]) for k in (2, 3, 4, 5, 6))
                    ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                    cols = [pa.array(doc), pa.array(place.astype(np.int32)), pa.array((words + SHINGLE - 1).astype(np.int32)), pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.int32())]
                    more = [pa.array(edge.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(runs.view(np.int64))), pa.array(held)]
                    yield pa.RecordBatch.from_arrays([*cols, *more], names=names)

    return both.select("a", "b", "anchors", "at", "bt").mapInArrow(tidied(verify), schema)


def hidden(edges: DataFrame, spans: DataFrame) -> DataFrame:
    """a, b, anchors as of `candidates`: runs that no span of their document holds, each with the first document that told the same one.

    edges: `edge_bundles` (doc_id, start, n_words, edge, runs, held). Runs leave their bundles only where a run that is not held shares its key with an earlier document.
    """

    def with_first(told):
        first = told.groupBy("edge").agg(F.min("doc_id").alias("__lo"), F.max(F.when(~F.col("held"), F.col("doc_id"))).alias("__hi"))
        # written, so that what is joined is dealt out by its rows alone and a common run can be split
        return small_or_merged(written(first.filter("__lo < __hi").select(F.col("edge").alias("__edge"), "__lo"), "shared-edges"))

    keys = with_first(edges)
    runs = edges.join(keys, edges["edge"] == keys["__edge"], "left_semi").select("doc_id", "start", "n_words", "held", F.posexplode("runs").alias("__i", "edge"))
    runs = written(runs.select("doc_id", (F.col("start") + F.col("__i")).alias("start"), "n_words", "held", "edge"), "edge-runs")
    shared = with_first(runs)
    met = runs.join(shared, runs["edge"] == shared["__edge"]).filter("doc_id = __lo or not held")
    met = written(met.select("doc_id", "start", "n_words", "edge", F.col("__lo").alias("lo")), "edges-met")
    discard(runs)
    told = spans.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("start", "n_words")).alias("__told"))
    later = met.filter("doc_id > lo").hint("merge").join(told, F.col("doc_id") == told["__id"], "left")
    later = later.filter("__told is null or not exists(__told, t -> t.start <= start and start + n_words <= t.start + t.n_words)").select("doc_id", "start", "edge", "lo")
    first = met.filter("doc_id = lo").groupBy(F.col("edge").alias("__edge")).agg(F.min("start").alias("to"))
    later = later.hint("merge").join(first, F.col("edge") == first["__edge"])
    # one anchor a diagonal: verification goes along it
    later = later.groupBy(F.col("doc_id").alias("a"), F.col("lo").alias("b"), (F.col("start") - F.col("to")).alias("__d")).agg(F.min("start").alias("start"))
    return later.groupBy("a", "b").agg(F.flatten(F.sort_array(F.collect_list(F.array(F.col("start"), (F.col("start") - F.col("__d")).cast("int"))))).alias("anchors"))


def repeats(docs: DataFrame, passage: int = PASSAGE, similarity: float = SIMILARITY, enough: int = ENOUGH) -> DataFrame:
    """Verified passages: doc_id, start (word), n_words, source_doc_id and source_start of the earlier occurrence."""
    width = passage - SHINGLE + 1
    found = written(windows(docs, passage), "windows")
    pairs = written(candidates(found, passage, enough), "passage-candidates")
    discard(found)
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "candidate-ids")
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(ids.hint("merge"), "id", "left_semi")
    texts = written(texts, "candidate-texts")
    some = written(_verify(pairs, texts, width, similarity, edges=True), "passages-and-edges")
    spans = some.filter("edge is null").drop("edge", "runs", "held")
    more = written(hidden(some.filter("edge is not null"), spans), "hidden-candidates")
    if more.take(1):
        spans = spans.union(_verify(more, texts, width, similarity, edges=False))
    # of several earlier occurrences the first one names the passage
    spans = spans.groupBy("doc_id", "start", "n_words").agg(F.min(F.struct("source_doc_id", "source_start")).alias("s"))
    spans = written(spans.select("doc_id", "start", "n_words", "s.source_doc_id", "s.source_start"), "passages")
    discard(pairs, ids, texts, some, more)
    return spans


def occurrences(docs: DataFrame, **how) -> DataFrame:
    """One row for each occurrence of a repeated passage, the first one included: doc_id, start, n_words, first_doc_id, first_start (the passage's class)."""
    spans = repeats(docs, **how)
    later = spans.select("doc_id", "start", "n_words", F.col("source_doc_id").alias("first_doc_id"), F.col("source_start").alias("first_start"))
    first = spans.groupBy("source_doc_id", "source_start").agg(F.max("n_words").alias("n_words"))
    first = first.select(F.col("source_doc_id").alias("doc_id"), F.col("source_start").alias("start"), "n_words", F.col("source_doc_id").alias("first_doc_id"), F.col("source_start").alias("first_start"))
    return later.union(first)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str | None:
    """text without the words of spans (start, n_words) and the white space before them; None if no word is left."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    gone = np.zeros(len(at) + 1, bool)
    for s, n in spans:
        gone[s : s + n] = True
    if not (~gone[:-1]).any():
        return None
    out, last = [], 0
    for s, e in np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist():
        out.append(raw[last : at[s - 1][1] if s else 0])
        last = at[e - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """docs, all columns, with each repeated passage left in its first document only. n_chars, if there, follows the text."""
    spans = repeats(docs, **how)
    per = spans.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("start", "n_words")).alias("__spans"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, [(x["start"], x["n_words"]) for x in f]) for t, f in zip(text, found, strict=True)], dtype=object)

    columns = docs.columns
    held = docs.join(per.hint("merge"), docs["doc_id"] == per["__id"], "left")
    clean = held.filter("__spans is null").select(*columns)
    dirty = held.filter("__spans is not null and text is not null").withColumn("text", cut(F.col("text").cast("string"), F.col("__spans"))).filter("text is not null")
    if "n_chars" in columns:
        dirty = dirty.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.union(dirty.select(*columns))
