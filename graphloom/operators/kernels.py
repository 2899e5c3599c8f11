"""Colouring and triangles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.priority import SALT, priority
from graphloom.operators.graph import vertices_of
from graphloom.operators.triangles import by_colors
from graphloom.plans.in_order import in_order, least_free_color, least_free_color_of_groups
from graphloom.plans.iterate import fixpoint
from graphloom.session import materialise, ship

#: Rounds of a colouring before its rest, if it has at most so many pairs, goes to one task that colours in order.
ROUNDS_FIRST, SMALL_PAIRS = 12, 2_000_000


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Colours of uncoloured vertices one by one in (p, id): what the rounds would give. Rows: id, p, dst, color (dst null: the vertex; color null: dst has none yet)."""
    priority_of, near, used = {}, {}, {}
    for b in batches:
        for i, p, d, c in zip(*(b.column(k).to_pylist() for k in range(4))):
            if d is None:
                priority_of[i] = p
            elif c is None:
                near.setdefault(i, []).append(d)
            else:
                used.setdefault(i, set()).add(c)
    colors = {}
    for i in sorted(priority_of, key=lambda k: (priority_of[k], k)):
        taken = used.get(i, set()) | {colors[d] for d in near.get(i, ()) if d in colors}
        colors[i] = next(c for c in range(len(taken) + 1) if c not in taken)
    yield pa.RecordBatch.from_arrays([pa.array(list(colors), pa.int64()), pa.array(list(colors.values()), pa.int32())], names=["id", "new"])


def coloring(edges: DataFrame, vertices: DataFrame | None = None, salt: str = SALT) -> DataFrame:
    """id, color (from 0): in the order of (priority, id) each vertex takes the least colour that no neighbour has. In one task that streams the graph; in
    rounds, which decide vertices before all uncoloured neighbours, where it has too many vertices for that."""
    rows = edges.select(F.col("src").alias("id"), F.col("dst").alias("via"))
    if vertices is not None:
        own = vertices.select("id").distinct()
        rows = rows.join(own, "id", "left_semi").join(own.select(F.col("id").alias("via")), "via", "left_semi").select("id", "via").unionByName(own.select("id", F.lit(None).cast("long").alias("via")))
    done = in_order(rows, least_free_color, salt)
    return coloring_by_rounds(edges, vertices, salt) if done is None else done.withColumnRenamed("value", "color")


def coloring_by_rounds(edges: DataFrame, vertices: DataFrame | None = None, salt: str = SALT) -> DataFrame:
    """The same: in each round, uncoloured vertices before all uncoloured neighbours in (priority, id) take the least colour that no neighbour has."""
    ids = (vertices_of(edges) if vertices is None else vertices).select("id")
    pairs = materialise(edges.select("src", "dst"), "pairs")

    def step(state: DataFrame) -> DataFrame:
        near = pairs.join(state.where("color is null").select(F.col("id").alias("src")), "src").join(state.select(F.col("id").alias("dst"), F.col("p").alias("dp"), "color"), "dst")
        seen = near.groupBy(F.col("src").alias("id")).agg(F.min(F.when(F.col("color").isNull(), F.struct(F.col("dp").alias("p"), F.col("dst").alias("id")))).alias("first"), F.collect_set("color").alias("used"))
        used = F.coalesce("used", F.array().cast("array<int>"))
        least = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(used)), used))
        ready = F.col("first").isNull() | (F.struct("p", "id") < F.col("first"))
        return state.join(seen, "id", "left").select("id", "p", F.when(F.col("color").isNotNull(), F.col("color")).when(ready, least).alias("color"))

    def finish(state: DataFrame, rounds: int) -> DataFrame | None:
        if rounds < ROUNDS_FIRST:
            return None
        rest = state.where("color is null").select("id", "p")
        near = pairs.join(rest.select(F.col("id").alias("src"), "p"), "src").join(state.select(F.col("id").alias("dst"), "color"), "dst")
        rows = materialise(rest.select("id", "p", F.lit(None).cast("long").alias("dst"), F.lit(None).cast("int").alias("color")).unionByName(
            near.select(F.col("src").alias("id"), "p", F.when(F.col("color").isNotNull(), F.lit(-1)).otherwise(F.col("dst")).alias("dst"), "color").distinct()), "rest")
        if rows.count() > SMALL_PAIRS:
            return None
        ship(rows.sparkSession)
        new = rows.coalesce(1).mapInArrow(_in_order, "id long, new int")
        return state.join(new, "id", "left").select("id", "p", F.coalesce("color", "new").alias("color"))

    start = ids.select("id", priority("id", salt).alias("p"), F.lit(None).cast("int").alias("color"))
    return fixpoint(start, step, F.col("color").isNull(), "coloring", finish).select("id", "color")


def two_hop(edges: DataFrame) -> DataFrame:
    """Pairs at distance one or two."""
    one = edges.select("src", "dst")
    two = one.join(one.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").where("src <> far").select("src", F.col("far").alias("dst"))
    return one.unionByName(two).distinct().withColumn("w", F.lit(1).cast("long"))


def coloring2(edges: DataFrame, salt: str = SALT) -> DataFrame:
    """A distance-2 colouring: vertices that share a closed neighbourhood differ. Pairs within two steps are formed only for rounds."""
    done = in_order(edges.select(F.col("src").alias("id"), F.col("dst").alias("via")), partial(least_free_color_of_groups, closed=True), salt)
    if done is not None:
        return done.withColumnRenamed("value", "color")
    return coloring_by_rounds(materialise(two_hop(edges), "two-hop"), vertices_of(edges), salt)


def coloring_bipartite(entries: DataFrame, rows: bool = True, salt: str = SALT) -> DataFrame:
    """Colours of a matrix's rows (or columns) so that none that share a column (row) are alike."""
    a, via = ("i", "j") if rows else ("j", "i")
    own = entries.select(F.col(a).alias("src"), F.col(via).alias("via"))
    done = in_order(own.withColumnRenamed("src", "id"), least_free_color_of_groups, salt, own_groups=False)
    if done is not None:
        return done.withColumnRenamed("value", "color")
    near = own.join(own.select(F.col("src").alias("dst"), "via"), "via").where("src <> dst").select("src", "dst").distinct().withColumn("w", F.lit(1).cast("long"))
    return coloring_by_rounds(near, own.select(F.col("src").alias("id")).distinct(), salt)


def conflicts(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """One row: edges whose ends are alike."""
    a, b = colors.select(F.col("id").alias("src"), F.col("color").alias("a")), colors.select(F.col("id").alias("dst"), F.col("color").alias("b"))
    return edges.join(a, "src").join(b, "dst").agg(F.count_if(F.col("a") == F.col("b")).alias("conflicts"))


def triangles(edges: DataFrame) -> DataFrame:
    """a, b, c of each triangle once, by (degree, id)."""
    found, ranks = by_colors(edges, "rows")
    for c in "abc":
        found = found.withColumnRenamed(c, "rank").join(ranks.withColumnRenamed("id", c), "rank").drop("rank")
    return found.select("a", "b", "c")


def triangle_count(edges: DataFrame) -> DataFrame:
    return by_colors(edges, "count")[0].agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("cnt"))


def triangles_per_vertex(edges: DataFrame) -> DataFrame:
    found, ranks = by_colors(edges, "vertices")
    return found.groupBy(F.col("a").alias("rank")).agg(F.sum("cnt").cast("long").alias("cnt")).join(ranks, "rank").select("id", "cnt")
