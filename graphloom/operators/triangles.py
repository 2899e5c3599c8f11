"""Triangles by colours of vertices: a vertex has one of k colours, a task has all edges among three colours (with repeats), and finds the triangles of just these.

Each edge goes to k tasks, packed; the pairs of a vertex's neighbours, of which there are far more than edges, are formed in a task and never travel.
Edges point from the smaller (degree, id) to the larger, so hubs start few pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations_with_replacement, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import degrees
from graphloom.plans.in_order import packed, unpacked
from graphloom.plans.iterate import numbered
from graphloom.session import materialise, ship

#: Edges that a task shall have at most; from so many on there are at least three colours; pairs formed at once; edges packed at once.
TASK_EDGES, SEVERAL, PAIRS, CHUNK_ROWS = 8_000_000, 100_000, 1 << 21, 4_000_000

_PACKED = pa.schema([("task", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_LOW = np.uint64((1 << 32) - 1)


def _tasks(k: int) -> list[tuple[int, int, int]]:
    return list(combinations_with_replacement(range(k), 3))


def _dealt(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b), a < b, packed by the colours of their ends, for each task that has both."""
    takers: dict[int, list[int]] = {}
    for t, three in enumerate(_tasks(k)):
        for i in set(three):
            for j in set(three):
                if i != j or three.count(i) > 1:
                    takers.setdefault(i * k + j, []).append(t)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate(x) for x in zip(*held))
        kind = (a % k) * k + b % k
        order = np.lexsort((b, a, kind))
        a, b, kind = a[order], b[order], kind[order]
        for x in np.unique(kind).tolist():
            lo, hi = np.searchsorted(kind, [x, x + 1])
            # what does not vary is taken out: differences of starts, and ends without their colour
            blob = packed(np.diff(a[lo:hi], prepend=0), b[lo:hi] // k)
            own = takers.get(x, [])
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([x] * len(own), pa.int32()), pa.array([blob] * len(own), pa.binary())], schema=_PACKED)

    held, rows = [], 0
    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in range(2)))
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield from flush(held)
            held, rows = [], 0
    if rows:
        yield from flush(held)


def _closed(edges: dict[int, np.ndarray], k: int, i: int, j: int, l: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """a, b, c of triangles whose least vertex a has colour i, the others j and l. edges: by colours of start and end, start << 32 | end, ascending."""
    none = np.zeros(0, dtype=np.uint64)
    left, right = edges.get(i * k + j, none), edges.get(i * k + l, none)
    far = edges.get(j * k + l, none)
    if j != l:  # of either direction, that of colour j first
        back = edges.get(l * k + j, none)
        far = np.sort(np.concatenate([far, (back & _LOW) << np.uint64(32) | back >> np.uint64(32)]))
    if not len(left) or not len(right) or not len(far):
        return
    bits = max(16, min(28, int(len(far) * 16).bit_length()))
    shift = np.uint64(64 - bits)
    hashed = lambda key: (key * np.uint64(0x9E3779B97F4A7C15)) >> shift
    present = np.zeros(1 << bits, dtype=bool)
    present[hashed(far)] = True
    starts = right >> np.uint64(32)
    a = left >> np.uint64(32)
    hi = np.searchsorted(starts, a, "right")
    lo = np.arange(1, len(left) + 1) if j == l else np.searchsorted(starts, a, "left")
    counts = hi - lo
    ends = np.cumsum(counts)
    at = 0
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = counts[at:stop]
        place = np.repeat(hi[at:stop] - np.cumsum(n), n) + np.arange(n.sum())
        key = np.repeat((left[at:stop] & _LOW) << np.uint64(32), n) | (right[place] & _LOW)
        maybe = np.flatnonzero(present[hashed(key)])
        found = np.minimum(np.searchsorted(far, key[maybe]), len(far) - 1)
        maybe = maybe[far[found] == key[maybe]]
        if len(maybe):
            yield right[place[maybe]] >> np.uint64(32), key[maybe] >> np.uint64(32), key[maybe] & _LOW
        at = stop


def _found(batches: Iterator[pa.RecordBatch], k: int, result: str) -> Iterator[pa.RecordBatch]:
    """result: rows (a, b, c each triangle), vertices (a and how many triangles of the task have it), count (a: how many triangles)."""
    names = {"rows": ["a", "b", "c"], "vertices": ["a", "cnt"], "count": ["cnt"]}[result]

    def batch(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.int64)) for c in columns], names=names)

    stream = ((t, x, p.as_py()) for b in batches for t, x, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
    for task, own in groupby(stream, key=lambda r: r[0]):
        parts: dict[int, list[np.ndarray]] = {}
        for _, x, blob in own:
            a, b = unpacked(blob, np.int64, np.int64)
            parts.setdefault(x, []).append(np.cumsum(a).astype(np.uint64) << np.uint64(32) | (b * k + x % k).astype(np.uint64))
        edges = {x: np.sort(np.concatenate(p)) for x, p in parts.items()}
        parts.clear()
        three, total = _tasks(k)[task], 0
        ids, sums = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for i in sorted(set(three)):
            rest = list(three)
            rest.remove(i)
            for abc in _closed(edges, k, i, *rest):
                total += len(abc[0])
                if result == "rows":
                    yield batch(*abc)
                elif result == "vertices":
                    more, n = np.unique(np.concatenate(abc), return_counts=True)
                    both, at = np.unique(np.concatenate([ids, more]), return_inverse=True)
                    ids, sums = both, np.bincount(at, np.concatenate([sums, n]), len(both)).astype(np.int64)
        if result == "vertices":
            yield batch(ids, sums)
        elif result == "count":
            yield batch([total])


def by_colors(edges: DataFrame, result: str) -> tuple[DataFrame, DataFrame]:
    """The tasks' rows, with vertices as ranks by (degree, id), and the ranks (id, rank)."""
    spark = ship(edges.sparkSession)
    ranks = materialise(numbered(degrees(edges).select("id", "deg"), "deg", "id", name="rank").select("id", "rank"), "ranks")
    if ranks.count() >= 1 << 32:
        raise ValueError("ranks of vertices have 32 bits")
    a, b = ranks.select(F.col("id").alias("src"), F.col("rank").alias("x")), ranks.select(F.col("id").alias("dst"), F.col("rank").alias("y"))
    half = materialise(edges.where("src < dst").join(a, "src").join(b, "dst").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "by-rank")
    m = half.count()
    k = max(3 if m > SEVERAL else 1, math.ceil(math.sqrt(6 * m / TASK_EDGES)))
    dealt = half.mapInArrow(partial(_dealt, k=k), "task int, kind int, payload binary")
    dealt = dealt.repartitionById(len(_tasks(k)), "task").sortWithinPartitions("task")
    ddl = {"rows": "a long, b long, c long", "vertices": "a long, cnt long", "count": "cnt long"}[result]
    return dealt.mapInArrow(partial(_found, k=k, result=result), ddl), ranks
