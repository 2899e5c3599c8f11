"""Operator 10: best-fit packing of token sequences by linear grouping.

Only the counts of the at most `size` lengths reach the driver. There, large lengths are split into groups of equal cardinality and rounded
up to their group's largest; the configurations of these few sizes (some tens) come from a linear programme, solved by column generation and
rounded down, and a subset-sum search covers what rounding leaves; then actual lengths take the places of the rounded ones, and small lengths
fill what is left by best fit, the largest first. Plans with several bounds of what is small are made, and that of fewest sequences is taken.
A plan is a list of runs (so many sequences of one configuration), whose number depends on the lengths alone, never on the documents. Pieces
are numbered within their lengths in parallel, and each looks its place up in the plan.

Defined results: null and empty texts are the end token alone; repeated rows are packed each; a null doc_id stays null.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import keyed, longs_of, real_id, row_batch, shuffle_partitions
from graphloom.llm.tokenizer import default_path, load
from graphloom.session import materialise

#: Tokens in a sequence; the id after each document; groups of the large lengths; pivots of the linear programme.
SEQUENCE_TOKENS, END_ID, GROUPS, MOST_PIVOTS = 2048, 0, 64, 4000
#: Lengths up to one of these shares of a sequence are small: a plan is made with each, and the one of fewest sequences is taken.
SMALL_SHARES = (1 / 8, 1 / 4, 3 / 8, 1 / 2)

_PIECE = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECE_DDL = "id long, piece int, start long, length long, ids_crc32 long"
_PLACED = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])
_END = np.array([END_ID], dtype="<u4").tobytes()


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for b in batches:
        ids, texts = longs_of(b, "id").tolist(), b.column(b.schema.get_field_index("text")).to_pylist()
        for at in range(0, len(texts), 256):
            rows = []
            for i, tokens in zip(ids[at : at + 256], model.ids(texts[at : at + 256])):
                tokens += _END
                n = len(tokens) // 4
                begin, piece = 0, 0
                while begin < n:
                    stop = begin + ((n - begin - 1) % size + 1)  # only the first piece may be short
                    rows.append((i, piece, begin, stop - begin, zlib.crc32(tokens[4 * begin : 4 * stop])))
                    begin, piece = stop, piece + 1
            yield row_batch(_PIECE, *zip(*rows))


def _fill(counts: dict[int, int], room: int) -> list[int]:
    """Sizes, each no more often than counted, whose sum is as near below room as can be; larger sizes are preferred."""
    sizes = sorted((s for s, c in counts.items() if c and s <= room), reverse=True)
    if not sizes:
        return []
    # sums[k]: bit v is set if v is a sum of sizes[k:] within their counts
    mask, sums = (1 << (room + 1)) - 1, [0] * len(sizes) + [1]
    for k in range(len(sizes) - 1, -1, -1):
        reach = step = sums[k + 1]
        for _ in range(min(counts[sizes[k]], room // sizes[k])):
            step = (step << sizes[k]) & mask
            if not step:
                break
            reach |= step
        sums[k] = reach
        if reach >> room & 1:  # full already without the larger ones; these are tried from here on
            sizes, sums = sizes[k:], sums[k:]
            break
    left, chosen = sums[0].bit_length() - 1, []
    for k, s in enumerate(sizes):
        used = 0
        while not sums[k + 1] >> left & 1:
            left -= s
            used += 1
        chosen += [s] * used
    return chosen


def best_configuration(sizes: list[int], values: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The configuration of the greatest value (how often each size is in it): an unbounded knapsack over the tokens of a sequence."""
    best, stages = np.zeros(size + 1), []
    for s, v in zip(sizes, values.tolist()):
        stages.append(best)
        best = best.copy()
        for _ in range(size // s if v > 1e-12 else 0):
            better = best[:-s] + v
            if not (better > best[s:] + 1e-12).any():
                break
            np.maximum(best[s:], better, out=best[s:])
    used, room = np.zeros(len(sizes), dtype=np.int64), size
    for k in range(len(sizes) - 1, -1, -1):
        above = best if k == len(sizes) - 1 else stages[k + 1]
        while used[k] * sizes[k] + sizes[k] <= size and room >= sizes[k] and above[room] > stages[k][room] + 1e-12:
            room -= sizes[k]
            used[k] += 1
    return float(used @ values), used


def optimal_configurations(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(how often, sizes) by column generation: the linear programme of least sequences, whose columns are found by their dual values, rounded
    down. Each column of the final basis is one configuration, so there are at most as many as sizes; what rounding leaves is not covered."""
    sizes = sorted(counts, reverse=True)
    columns = [np.eye(len(sizes), dtype=np.int64)[k] * (size // s) for k, s in enumerate(sizes)]
    inverse = np.diag([1 / (size // s) for s in sizes])
    used = np.array([counts[s] / (size // s) for s in sizes])
    for _ in range(MOST_PIVOTS):
        value, column = best_configuration(sizes, inverse.sum(axis=0), size)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        rises = step > 1e-9
        ratio = np.where(rises, used / np.where(rises, step, 1), np.inf)
        out = int(np.argmin(ratio))
        used = np.maximum(used - ratio[out] * step, 0)
        used[out] = ratio[out]
        columns[out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    left, out = dict(counts), []
    for times, column in zip(used.tolist(), columns):
        own = {s: int(n) for s, n in zip(sizes, column) if n}
        whole = min([int(times + 1e-6), *(left[s] // n for s, n in own.items())])
        if whole > 0 and own:
            out.append((whole, [s for s, n in own.items() for _ in range(n)]))
            for s, n in own.items():
                left[s] -= whole * n
    return out


def configurations(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(how often, sizes) so that each size is placed as often as it is counted: the optimal ones, then for the rest ones opened by the largest size left."""
    out = optimal_configurations(counts, size) if counts else []
    left = dict(counts)
    for times, sizes in out:
        for s in sizes:
            left[s] -= times
    left = {s: n for s, n in left.items() if n}
    while left:
        top = max(left)
        left[top] -= 1
        rest = _fill(left, size - top)
        left[top] += 1
        used = Counter([top, *rest])
        times = min(left[s] // n for s, n in used.items())
        out.append((times, [top, *rest]))
        for s, n in used.items():
            left[s] -= times * n
            if not left[s]:
                del left[s]
    return out


def plan_runs(counts: dict[int, int], size: int, small: int, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """(sequences, actual lengths in each) covering every counted length."""
    large = sorted(((s, c) for s, c in counts.items() if small < s < size and c), reverse=True)
    runs: list[tuple[int, list[int]]] = [(counts[size], [size])] if counts.get(size) else []
    # linear grouping: equal cardinality, rounded up to the group's largest; a length's count may be split between groups
    total = sum(c for _, c in large)
    each = max(1, -(-total // groups))
    rounded: dict[int, int] = {}
    actual: dict[int, list[list[int]]] = {}
    head, room = 0, 0
    for s, c in large:
        while c:
            if not room:
                head, room = s, each
            n = min(c, room)
            rounded[head] = rounded.get(head, 0) + n
            actual.setdefault(head, []).append([s, n])
            c, room = c - n, room - n
    # substitution: the group's documents take its places, the largest first
    for times, sizes in configurations(rounded, size):
        slots = sorted(sizes, reverse=True)
        while times:
            need = Counter(slots)
            n = min([times, *(actual[h][0][1] // k for h, k in need.items() if actual[h][0][1] >= k)])
            one, taken = [], []
            if all(actual[h][0][1] >= k for h, k in need.items()):
                for h in slots:
                    one.append(actual[h][0][0])
                taken = [(h, k * n) for h, k in need.items()]
            else:  # a length runs out within one sequence
                n = 1
                for h in slots:
                    one.append(actual[h][0][0])
                    actual[h][0][1] -= 1
                    if not actual[h][0][1]:
                        actual[h].pop(0)
            for h, k in taken:
                actual[h][0][1] -= k
                if not actual[h][0][1]:
                    actual[h].pop(0)
            runs.append((n, one))
            times -= n
    # best fit of the small lengths, the largest first: the tightest gap takes as many as fit
    gaps = sorted((size - sum(lengths), k) for k, (_, lengths) in enumerate(runs) if sum(lengths) < size)
    for s in sorted((s for s in counts if s <= min(small, size - 1)), reverse=True):
        c = counts[s]
        while c:
            at = bisect.bisect_left(gaps, (s, -1))
            if at == len(gaps):
                runs.append((c // (size // s), [s] * (size // s)))
                if size % s and runs[-1][0]:
                    bisect.insort(gaps, (size % s, len(runs) - 1))
                if c % (size // s):
                    runs.append((1, [s] * (c % (size // s))))
                    bisect.insort(gaps, (size - s * (c % (size // s)), len(runs) - 1))
                c = 0
                break
            gap, k = gaps.pop(at)
            n, lengths = runs[k]
            fit = min(gap // s, c)
            deep = min(n, c // fit)
            if deep < n:  # only some of the run's sequences take them
                runs[k] = (n - deep, lengths)
                bisect.insort(gaps, (gap, k))
                runs.append((deep, lengths + [s] * fit))
                k = len(runs) - 1
            else:
                runs[k] = (n, lengths + [s] * fit)
            c -= deep * fit
            if gap - s * fit:
                bisect.insort(gaps, (gap - s * fit, k))
    return [(n, lengths) for n, lengths in runs if n]


def place_table(runs: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Arrays sorted by (length, first rank): the pieces from a rank on lie in consecutive sequences, at one offset."""
    next_rank: Counter = Counter()
    rows, base = [], 0
    for n, lengths in runs:
        offset = 0
        for s in lengths:
            rows.append((s, next_rank[s], base, offset))
            next_rank[s] += n
            offset += s
        base += n
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"key": a[:, 0] << 44 | a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def _place(batches: Iterator[pa.RecordBatch], places: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        length, rank = longs_of(b, "length"), longs_of(b, "rank")
        at = np.searchsorted(places["key"], length << 44 | rank, "right") - 1
        yield row_batch(_PLACED, *(b.column(b.schema.get_field_index(f.name)) for f in _PIECE), places["sequence"][at] + rank - places["rank"][at], places["offset"][at])


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, size: int = SEQUENCE_TOKENS, small: int | None = None, groups: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each row of docs."""
    spark = docs.sparkSession
    path = tokenizer_path or default_path()
    pieces = materialise(keyed(docs).mapInArrow(partial(_pieces, path=path, size=size), _PIECE_DDL), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    plans = [plan_runs(counts, size, own, groups) for own in ([int(size * x) for x in SMALL_SHARES] if small is None else [small])]
    places = place_table(min(plans, key=lambda runs: sum(n for n, _ in runs)))
    # frequent lengths are numbered in several parts; there are at most `size` + 8 * partitions parts
    part_rows = max(1, sum(counts.values()) // (8 * shuffle_partitions(spark)))
    parts = spark.createDataFrame([(s, -(-c // part_rows)) for s, c in counts.items()], "length long, parts int")
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    before: Counter = Counter()
    firsts = []
    for s, part, n in sorted(map(tuple, dealt.groupBy("length", "part").count().collect())):
        firsts.append((s, part, before[s]))
        before[s] += n
    own = Window.partitionBy("length", "part").orderBy("id", "piece")
    ranked = dealt.withColumn("nth", F.row_number().over(own)).join(F.broadcast(spark.createDataFrame(firsts, "length long, part long, first long")), ["length", "part"])
    numbered = ranked.select(*_PIECE.names, (F.col("first") + F.col("nth") - 1).alias("rank"))
    placed = numbered.mapInArrow(partial(_place, places=places), f"{_PIECE_DDL}, sequence_id long, offset long")
    return placed.select(real_id().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
