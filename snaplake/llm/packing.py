"""Packing into windows of bounded length by multiway differencing (Karmarkar-Karp).

A document's ids fill whole windows first. What is left is cut into pieces of at most `piece` ids, and
pieces are balanced over windows in bounded batches: each piece starts as a partial partition of k window
loads; the two partitions with the largest imbalances merge, the heaviest load of one with the lightest of
the other, until one is left. k starts at the least that the ids need and rises whenever a load exceeds
the capacity. Merging keeps only the two permutations; pieces learn their windows on the way back.

Nothing is shuffled: a task packs the rows it reads, and numbers its windows below its partition's number.

Defined results: a null text is empty, so one piece of the end id alone; a null doc_id stays null; repeated
rows are packed as documents of their own; an empty table gives no rows; a very long text is cut into as
many windows as it needs; other columns are never read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied
from .tokens import encoder, slices


def difference(sizes: list[int], k: int) -> tuple[np.ndarray, int]:
    """The window of each piece among k, and the largest load."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64), sum(sizes)
    loads: list[np.ndarray] = []
    for s in sizes:
        one = np.zeros(k, np.int64)
        one[-1] = s
        loads.append(one)
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = loads[a] + loads[b][::-1]
        order = np.argsort(both, kind="stable")
        both = both[order]
        merges.append((a, b, order))
        loads.append(both)
        heapq.heappush(heap, (int(both[0] - both[-1]), len(loads) - 1))
    window: list[np.ndarray | None] = [None] * len(loads)
    window[-1] = np.arange(k)
    for c in range(len(merges) - 1, -1, -1):
        a, b, order = merges[c]
        of, mine, other = window[n + c], np.empty(k, np.int64), np.empty(k, np.int64)
        mine[order] = of
        other[k - 1 - order] = of
        window[a], window[b], window[n + c] = mine, other, None
    return np.array([window[i][-1] for i in range(n)]), int(loads[-1].max())


def balance(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """The window of each piece and the number of windows, none above capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window, most = difference(sizes, k)
        if most <= capacity:
            return window, k
        k += 1


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, piece: int = 256, batch: int = 64) -> DataFrame:
    """One row a piece: its document, place, ids' crc32, window (sequence_id) and offset there. batch: windows balanced together, about."""
    kind = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches):
        enc, number = encoder(tokenizer), TaskContext.get().partitionId() << 33
        rows, held, load = [], [], 0

        def settle():
            nonlocal number, held, load
            if held:
                window, k = balance([h[2] for h in held], capacity)
                used = [0] * k
                for h, w in zip(held, window.tolist(), strict=True):
                    rows.append((*h, number + w, used[w]))
                    used[w] += h[2]
                number += k
                held, load = [], 0

        def told():
            nonlocal rows
            out = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], schema=kind)
            rows = []
            return out

        for some in slices(batches):
            for (d, _), ids in zip(some, enc.ids([t for _, t in some], end_id), strict=True):
                ids = ids.astype("<u4")
                n, wide = len(ids), memoryview(ids).cast("B")
                full = n // capacity * capacity
                for a in range(0, full, capacity):
                    rows.append((d, a, capacity, zlib.crc32(wide[4 * a : 4 * (a + capacity)]), n, number, 0))
                    number += 1
                cuts = np.linspace(full, n, max(1, -(-(n - full) // piece)) + 1).astype(int).tolist() if n > full else []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    held.append((d, a, b - a, zlib.crc32(wide[4 * a : 4 * b]), n))
                load += n - full
                if load >= batch * capacity:
                    settle()
            if len(rows) >= 10_000:
                yield told()
        settle()
        if rows:
            yield told()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), SCHEMA)
