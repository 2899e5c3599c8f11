"""Bisection: cut, gains, sweeps, moves, initial partitions. A partition is id, part (0 or 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.iterate import numbered, numbered_within, running_sum
from graphloom.session import materialise, ship

#: Most moves without gain in a row, the share by which a cut may worsen while a partition is out of balance, and the least tolerance.
STALL, WORSE, LEAST_TARGET = 500, 1.05, 20
#: Vertices and edges (both directions) that greedy growing takes at most.
MOST_GROWN = 5000, 2_000_000


def _ends(edges: DataFrame, part: DataFrame) -> DataFrame:
    a, b = part.select(F.col("id").alias("src"), F.col("part").alias("ps")), part.select(F.col("id").alias("dst"), F.col("part").alias("pd"))
    return edges.join(a, "src").join(b, "dst")


def edge_cut(edges: DataFrame, part: DataFrame) -> DataFrame:
    """One row: the weight of edges between parts, each once."""
    return _ends(edges.where("src < dst"), part).where("ps <> pd").agg(F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("cut"))


def imbalance(vertices: DataFrame, part: DataFrame) -> DataFrame:
    """One row: weight of part 0 less that of part 1."""
    return vertices.join(part, "id").agg(F.sum(F.when(F.col("part") == 0, F.col("vw")).otherwise(-F.col("vw"))).cast("long").alias("imb"))


def gains(edges: DataFrame, part: DataFrame) -> DataFrame:
    """id, gain: what the cut loses if the vertex moves (weight to the other part less weight to its own)."""
    return _ends(edges, part).groupBy(F.col("src").alias("id")).agg(F.sum(F.when(F.col("ps") != F.col("pd"), F.col("w")).otherwise(-F.col("w"))).cast("long").alias("gain"))


def split_by_order(values: DataFrame, value: str = "x", vertices: DataFrame | None = None, imb: float = 0.0) -> DataFrame:
    """id, part: vertices by (value, id); the first half (with weights: while the weight before is under half) is part 0."""
    if vertices is None:
        own = numbered(values.select("id", value), value, "id", name="nr")
        n = own.agg(F.count("*").alias("n"))  # one row
        first = F.col("n") - F.floor(F.ceil(F.col("n") / 2) * (1 + imb / 100))
        return own.crossJoin(F.broadcast(n)).select("id", F.when(F.col("nr") < first, 0).otherwise(1).alias("part"))
    own = running_sum(values.join(vertices, "id").select("id", value, "vw"), "vw", value, "id", name="before", exclusive=True)
    total = vertices.agg(F.sum("vw").alias("total"))  # one row
    return own.crossJoin(F.broadcast(total)).select("id", F.when(F.col("before") * 2 < F.col("total"), 0).otherwise(1).alias("part"))


def _by_value(edges: DataFrame, values: DataFrame, value: str) -> tuple[DataFrame, DataFrame, int]:
    """id, pos in (value, id) order; a, b: each undirected edge by the positions of its ends, a < b; the number of vertices."""
    order = materialise(numbered(values.select("id", value), value, "id", name="pos").select("id", "pos", value), "by-value")
    a, b = order.select(F.col("id").alias("src"), F.col("pos").alias("x")), order.select(F.col("id").alias("dst"), F.col("pos").alias("y"))
    ends = edges.where("src < dst").join(a, "src").join(b, "dst").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return order, ends, order.count()


def window_of(n: int, imb: float) -> tuple[int, int]:
    """First and last split that an imbalance of imb percent allows: the smaller part has at least `left` of n vertices, the larger at most `right`."""
    right = math.floor(math.ceil(n / 2) * (1 + imb / 100))
    return n - right, right


def split_cuts(edges: DataFrame, values: DataFrame, value: str = "x", imb: float = 1.0) -> DataFrame:
    """split, cut: the number of edges between the first `split` vertices by (value, id) and the others, for each split with left < split <= right.

    An edge is cut by the splits after its first end up to its second, so cuts are running sums of edges that begin and end: no loop, no moves.
    """
    order, ends, n = _by_value(edges, values, value)
    left, right = window_of(n, imb)
    steps = ends.select(F.explode(F.array(F.struct((F.col("a") + 1).alias("split"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("split"), F.lit(-1).alias("d")))).alias("s")).select("s.*")
    steps = steps.groupBy("split").agg(F.sum("d").alias("d"))
    every = order.select((F.col("pos") + 1).alias("split")).join(steps, "split", "left").select("split", F.coalesce("d", F.lit(0)).alias("d"))
    cuts = running_sum(every, "d", "split", name="cut")
    return cuts.where((F.col("split") > left) & (F.col("split") <= right)).select(F.col("split").cast("long"), F.col("cut").cast("long"))


def best_split(edges: DataFrame, values: DataFrame, value: str = "x", imb: float = 1.0) -> DataFrame:
    """One row: vertices in the larger part, cut of the split with the smallest cut in the window (of equal ones the last)."""
    n = values.count()
    top = split_cuts(edges, values, value, imb).agg(F.min(F.struct("cut", (-F.col("split")).alias("s"))).alias("m"))
    return top.select(F.greatest(-F.col("m.s"), n + F.col("m.s")).cast("long").alias("larger"), F.col("m.cut").alias("cut"))


def median_cut(edges: DataFrame, values: DataFrame, value: str = "x") -> DataFrame:
    """One row: the cut in edges if vertices under the median are part 0, and the parts' ratio (part 1 to part 0; null if that is empty)."""
    median = values.agg(F.median(value).alias("med"))  # one row
    part = materialise(values.crossJoin(F.broadcast(median)).select("id", F.when(F.col(value) < F.col("med"), 0).otherwise(1).alias("part")), "part")
    cut = _ends(edges.where("src < dst"), part).agg(F.count_if(F.col("ps") != F.col("pd")).alias("cut"))
    return cut.crossJoin(part.agg((F.sum("part") / F.nullif(F.sum(1 - F.col("part")), F.lit(0))).alias("balance")))


def swept_partition(edges: DataFrame, values: DataFrame, value: str = "x", imb: float = 0.0) -> DataFrame:
    """id, part: the first vertices by (value, id) are part 0, up to the window's left end; then each one of the window in turn joins them if the cut
    (in edges, both directions) that has been counted so far does not exceed the best so far. A rejected vertex stays, yet its change stays counted.

    The decisions depend on one another in order, so one task makes them; it gets one row for each vertex of the window (imb percent of all):
    how its edges to others fall, and its neighbours before it in the window.
    """
    order, ends, n = _by_value(edges, values, value)
    left, right = window_of(n, imb)
    start = ends.agg(F.count_if((F.col("a") < left) & (F.col("b") >= left)).alias("c")).first()["c"] * 2
    both = ends.select(F.col("a").alias("pos"), F.col("b").alias("other")).unionByName(ends.select(F.col("b").alias("pos"), F.col("a").alias("other")))
    own = both.where((F.col("pos") >= left) & (F.col("pos") < right)).groupBy("pos")
    earlier = F.col("other").between(left, F.col("pos") - 1)
    own = own.agg(F.sum(F.when(F.col("other") < left, -1).otherwise(1)).cast("long").alias("gain"), F.collect_list(F.when(earlier, F.col("other"))).alias("near"))
    rows = order.where((F.col("pos") >= left) & (F.col("pos") < right)).select("pos").join(own, "pos", "left")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = best = start
        moved: set[int] = set()
        for b in batches:
            for pos, gain, near in zip(*(b.column(k).to_pylist() for k in range(3))):
                now += 2 * ((gain or 0) - 2 * sum(p in moved for p in near or ()))
                if now <= best:
                    best = now
                    moved.add(pos)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(moved), pa.int64())], names=["pos"])

    ship(edges.sparkSession)
    moved = rows.select("pos", "gain", "near").repartition(1).sortWithinPartitions("pos").mapInArrow(decide, "pos long").withColumn("moved", F.lit(True))
    return order.join(moved, "pos", "left").select("id", F.when((F.col("pos") < left) | F.col("moved"), 0).otherwise(1).alias("part"))


def interleaved(first: DataFrame, second: DataFrame, offset: int = 0) -> DataFrame:
    """id, pos: two ordered lists (id, pos) as one: `offset` entries of the first list, then one of the second and one of the first in turn, then the rest."""
    both = first.select("id", F.col("pos").alias("turn"), F.lit(1).alias("list")).unionByName(second.select("id", (F.col("pos") + offset).alias("turn"), F.lit(0).alias("list")))
    return numbered(both, "turn", "list", name="pos").select("id", F.col("pos").cast("long").alias("pos"))


def interleaved_for_balance(order: DataFrame, vertices: DataFrame, part: DataFrame) -> DataFrame:
    """id, pos: movers (order: id, pos) of both parts in turn, each part's in their order; first so many of the heavier part as bring the imbalance
    to a tenth (or LEAST_TARGET)."""
    imb = imbalance(vertices, part).first()["imb"] or 0
    heavy = 0 if imb > 0 else 1
    own = materialise(numbered_within(order.join(part, "id").join(vertices, "id"), "part", "pos", name="nr").select("id", "part", "vw", F.col("nr").alias("pos")), "movers")
    sides = [own.where(F.col("part") == p) for p in (heavy, 1 - heavy)]
    goal, offset = abs(imb) - max(LEAST_TARGET, abs(imb) // 10), 0
    if goal > 0:
        before = running_sum(sides[0], "vw", "pos", name="before", exclusive=True)
        found = before.where(2 * F.col("before") >= goal).agg(F.min("pos")).first()[0]
        offset = sides[0].count() if found is None else found
    return interleaved(sides[0], sides[1], offset)


def ordered_gains(edges: DataFrame, part: DataFrame, order: DataFrame) -> DataFrame:
    """id, pos, gain: gains if the vertices of order (id, pos) move one after the other. Others stay; an earlier mover counts as moved."""
    pos = order.select("id", "pos")
    both = _ends(edges, part).join(pos.select(F.col("id").alias("src"), F.col("pos").alias("s")), "src").join(pos.select(F.col("id").alias("dst"), F.col("pos").alias("d")), "dst", "left")
    apart = F.when(F.coalesce(F.col("d") < F.col("s"), F.lit(False)), F.col("ps") == F.col("pd")).otherwise(F.col("ps") != F.col("pd"))
    got = both.groupBy(F.col("src").alias("id")).agg(F.sum(F.when(apart, F.col("w")).otherwise(-F.col("w"))).cast("long").alias("gain"))
    return pos.join(got, "id", "left").select("id", "pos", F.coalesce("gain", F.lit(0)).cast("long").alias("gain"))


def cut_scan(edges: DataFrame, vertices: DataFrame, part: DataFrame, order: DataFrame) -> DataFrame:
    """prefix, id, cut, imb: after each move of the order, by running sums."""
    cut, imb = edge_cut(edges, part), imbalance(vertices, part)
    moves = ordered_gains(edges, part, order).join(part, "id").join(vertices, "id")
    moves = moves.withColumn("shift", F.when(F.col("part") == 0, -2 * F.col("vw")).otherwise(2 * F.col("vw")))
    run = running_sum(running_sum(moves, "gain", "pos", name="gained"), "shift", "pos", name="shifted")
    own = run.crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(imb))
    return own.select((F.col("pos") + 1).cast("long").alias("prefix"), "id", (F.col("cut") - F.col("gained")).cast("long").alias("cut"), (F.col("imb") + F.col("shifted")).cast("long").alias("imb"))


def best_prefix(scan: DataFrame, target: int) -> DataFrame:
    """One row: the prefix that is best by (how far out of balance beyond the target, cut, length)."""
    rank = F.struct(F.when(F.abs("imb") <= target, F.lit(0)).otherwise(F.abs("imb")).cast("long").alias("off"), "cut", "prefix")
    return scan.agg(F.min(rank).alias("m")).select("m.prefix", "m.cut", F.lit(target).alias("target"))


def refine_in_batches(edges: DataFrame, vertices: DataFrame, part: DataFrame, rounds: int = 5) -> DataFrame:
    """Distributed refinement: vertices of positive gain, best first and sides interleaved, move up to the best prefix; while the balance or the cut gets
    better. While the parts are out of balance, all vertices of the heavier one may move."""
    part = materialise(part, "part")
    for _ in range(rounds):
        start = edge_cut(edges, part).first()["cut"]
        imb = imbalance(vertices, part).first()["imb"] or 0
        target = max(LEAST_TARGET, abs(imb) // 10)
        heavy = F.lit(abs(imb) > target) & (F.col("part") == (0 if imb > 0 else 1))
        movers = gains(edges, part).join(part, "id").where((F.col("gain") > 0) | heavy)
        ranked = numbered(movers, F.desc("gain"), "id", name="pos").select("id", "pos")
        order = materialise(interleaved_for_balance(ranked, vertices, part), "movers")
        if order.isEmpty():
            return part
        scan = materialise(cut_scan(edges, vertices, part, order), "scan")
        best = scan.join(best_prefix(scan, target).select("prefix"), "prefix").first()
        off, off_before = (abs(x) if abs(x) > target else 0 for x in (best["imb"], imb))
        if (off, best["cut"]) >= (off_before, start):
            return part
        moved = order.where(F.col("pos") < best["prefix"]).select("id", F.lit(True).alias("moved"))
        part = materialise(part.join(moved, "id", "left").select("id", F.when(F.col("moved"), 1 - F.col("part")).otherwise(F.col("part")).cast("int").alias("part")), "part")
    return part


def _rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, weights, offsets, neighbours, edge weights, labels of a small graph that comes as rows of kind v and e."""
    v = pdf[pdf["kind"] == "v"].sort_values("a")
    e = pdf[pdf["kind"] == "e"].sort_values(["a", "b"])
    ids = v["a"].to_numpy()
    src, dst = np.searchsorted(ids, e["a"].to_numpy()), np.searchsorted(ids, e["b"].to_numpy())
    return ids, v["w"].to_numpy(), np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(ids)))]).astype(np.int64), dst, e["w"].to_numpy(), v["b"].to_numpy()


def _as_rows(edges: DataFrame, vertices: DataFrame, part: DataFrame | None = None) -> DataFrame:
    v = vertices.select(F.lit("v").alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("vw").alias("w"))
    if part is not None:
        v = vertices.join(part, "id").select(F.lit("v").alias("kind"), F.col("id").alias("a"), F.col("part").cast("long").alias("b"), F.col("vw").alias("w"))
    return v.unionByName(edges.select(F.lit("e").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "w"))


def greedy_growing(edges: DataFrame, vertices: DataFrame, most_vertices: int | None = None, most_edges: int | None = None) -> DataFrame:
    """seed, cut, and the ids grown from it, for each seed: part 1 takes the vertex that raises the cut least (then the least id) until it has half of the weight, rounded down.

    For coarse graphs only (at most most_vertices, and most_edges in both directions; by default MOST_GROWN): the graph is broadcast, the seeds are dealt to all tasks.
    """
    most_vertices, most_edges = most_vertices or MOST_GROWN[0], most_edges or MOST_GROWN[1]
    spark = ship(edges.sparkSession)
    n, m = vertices.count(), edges.count()
    if n > most_vertices or m > most_edges:
        raise ValueError(f"{n} vertices and {m} edges; growing is for coarse graphs of at most {most_vertices} and {most_edges}")
    graph = spark.sparkContext.broadcast(_rows(_as_rows(edges, vertices).toPandas()))

    def grow(start: int) -> tuple[int, int, list[int]]:
        ids, vw, off, dst, w, _ = graph.value
        seed = int(np.searchsorted(ids, start))
        inside = np.zeros(len(ids), dtype=bool)
        degree = np.add.reduceat(np.append(w, 0), off[:-1]) * (np.diff(off) > 0)
        rise = degree.astype(np.int64)
        cut, held, take = 0, 0, seed
        while True:
            inside[take] = True
            cut += int(rise[take])
            held += int(vw[take])
            near = slice(off[take], off[take + 1])
            np.subtract.at(rise, dst[near], 2 * w[near])
            if held >= int(vw.sum()) // 2 or inside.all():
                break
            take = int(np.where(inside, np.iinfo(np.int64).max, rise).argmin())
        return int(ids[seed]), cut, ids[inside].tolist()

    def all_grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([grow(s) for s in b["seed"]], columns=["seed", "cut", "ids"])

    return vertices.select(F.col("id").alias("seed")).repartition("seed").mapInPandas(all_grown, "seed long, cut long, ids array<long>")


def growing_partition(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, part of the seed with the smallest cut (then id)."""
    best = greedy_growing(edges, vertices).orderBy("cut", "seed").limit(1)
    return vertices.select("id").join(best.select(F.explode("ids").alias("id")).withColumn("one", F.lit(1)), "id", "left").select("id", F.coalesce("one", F.lit(0)).cast("int").alias("part"))


def move_refine(off: np.ndarray, dst: np.ndarray, w: np.ndarray, vw: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, int]:
    """Single-vertex moves of one small graph: best gain on the heavier side, each vertex once; keeps the best prefix; repeats while the cut falls."""
    src = np.repeat(np.arange(len(vw)), np.diff(off))
    part = part.copy()
    cut = int(w[part[src] != part[dst]].sum()) // 2
    while True:
        gain = np.zeros(len(vw), dtype=np.int64)
        np.add.at(gain, src, np.where(part[src] != part[dst], w, -w))
        imb = int(vw[part == 0].sum() - vw[part == 1].sum())
        target = max(LEAST_TARGET, abs(imb) // 10)
        free = np.ones(len(vw), dtype=bool)
        now, best, best_at, moves, stall = cut, (0 if abs(imb) <= target else abs(imb), cut), 0, [], 0
        trial = part.copy()
        while free.any() and stall < STALL:
            side = 0 if imb > 0 else 1
            open_ = free & (trial == side) if abs(imb) > target else free
            if not open_.any():
                break
            u = int(np.where(open_, gain, np.iinfo(np.int64).min).argmax())
            now -= int(gain[u])
            imb += int(-2 * vw[u] if trial[u] == 0 else 2 * vw[u])
            near = slice(off[u], off[u + 1])
            same = trial[dst[near]] == trial[u]
            np.add.at(gain, dst[near], np.where(same, 2 * w[near], -2 * w[near]))
            gain[u] = -gain[u]
            trial[u] = 1 - trial[u]
            free[u] = False
            moves.append(u)
            rank = (0 if abs(imb) <= target else abs(imb), now)
            if rank < best and (rank[0] == 0 or now <= WORSE * cut):
                best, best_at, stall = rank, len(moves), 0
            else:
                stall += 1
        part[moves[:best_at]] = 1 - part[moves[:best_at]]
        if best[1] >= cut:
            return part, best[1]
        cut = best[1]


def refine_small(edges: DataFrame, vertices: DataFrame, part: DataFrame) -> DataFrame:
    """Single-vertex moves of a coarse graph, as one group. Larger graphs take refine_in_batches()."""
    ship(edges.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, vw, off, dst, w, own = _rows(pdf)
        got, _ = move_refine(off, dst, w, vw, own)
        return pd.DataFrame({"id": ids, "part": got.astype(np.int32)})

    return _as_rows(edges, vertices, part).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "id long, part int")


def edit_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how far two bisections are apart, with or without swapped labels, halved (integer division)."""
    both = a.join(b.select("id", F.col("part").alias("other")), "id")
    return both.agg(F.expr("least(count_if(part <> other), count_if(part = other)) div 2").alias("diff"))


def split_graph(edges: DataFrame, part: DataFrame) -> DataFrame:
    """part, src, dst, w: the induced graphs, with ids renumbered in order within each part."""
    ids = materialise(numbered_within(part.select("id", "part"), "part", "id", name="nr"), "renumbered")
    a = ids.select(F.col("id").alias("src"), "part", F.col("nr").alias("a"))
    b = ids.select(F.col("id").alias("dst"), F.col("part").alias("other"), F.col("nr").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("part = other").select("part", F.col("a").alias("src"), F.col("b").alias("dst"), "w")
