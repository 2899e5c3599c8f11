"""Graph hygiene, degrees, triangles of a matrix, traversal. A graph is edges (src, dst, w), both directions stored, without loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import star_components
from graphloom.plans.iterate import numbered
from graphloom.session import materialise


def mirrored(half: DataFrame) -> DataFrame:
    """Both directions of edges that are stored once. The narrow rows are not shuffled."""
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def symmetrised(pairs: DataFrame) -> DataFrame:
    """Any (src, dst) pairs as a clean graph of unit weights: no loops, both directions, no repeats. Distinct on one direction, then mirrored."""
    half = pairs.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return mirrored(half.withColumn("w", F.lit(1).cast("long")))


def merged(edges: DataFrame) -> DataFrame:
    """Parallel edges as one with their summed weight (sort, merge and hash deduplication are one aggregate here)."""
    return edges.groupBy("src", "dst").agg(F.sum("w").cast("long").alias("w"))


def vertices_of(edges: DataFrame, weight: int = 1) -> DataFrame:
    return edges.select(F.col("src").alias("id")).distinct().withColumn("vw", F.lit(weight).cast("long"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, deg, wdeg."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"), F.sum("w").cast("long").alias("wdeg"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """Largest, total and average (integer division) degree, and the largest weighted one."""
    return degrees(edges).agg(F.max("deg").alias("max_deg"), F.sum("deg").alias("total"), F.expr("sum(deg) div count(*)").alias("avg_deg"), F.max("wdeg").alias("max_wdeg"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("cnt"))


def degree_order(edges: DataFrame, descending: bool = False) -> DataFrame:
    """id, rnk: vertices by degree, then id."""
    deg = degrees(edges).select("id", "deg")
    return numbered(deg, F.col("deg").desc() if descending else F.col("deg"), "id", name="rnk").select("id", "rnk")


def row_offsets(edges: DataFrame) -> DataFrame:
    """id, row_start: the exclusive prefix sum of degrees in id order (the offsets of a compressed row storage)."""
    from graphloom.plans.iterate import running_sum

    return running_sum(degrees(edges).select("id", "deg"), "deg", "id", name="row_start", exclusive=True).select("id", F.col("row_start").cast("long"))


def lower_triangle(edges: DataFrame) -> DataFrame:
    return edges.where("src > dst").select("src", "dst")


def incidence(edges: DataFrame) -> DataFrame:
    """edge_id, vertex: two rows for each undirected edge, edges numbered in (src, dst) order of their lower triangle."""
    own = numbered(lower_triangle(edges), "src", "dst", name="edge_id")
    return own.select("edge_id", F.explode(F.array("src", "dst")).alias("vertex"))


def largest_component(edges: DataFrame) -> DataFrame:
    """old_id, new_id: the vertices of the largest component (of equal ones that of the smallest id), numbered in id order."""
    labels = materialise(star_components(edges), "labels")
    top = labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1)  # one row
    own = labels.join(F.broadcast(top.select("label")), "label").select(F.col("id").alias("old_id"))
    return numbered(own, "old_id", name="new_id")


def relabelled(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges among ids (old_id, new_id), under the new ids."""
    a, b = ids.select(F.col("old_id").alias("src"), F.col("new_id").alias("a")), ids.select(F.col("old_id").alias("dst"), F.col("new_id").alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")


def bfs_levels(edges: DataFrame, sources: DataFrame, most_levels: int = 1_000_000) -> DataFrame:
    """id, lvl: steps from the nearest source. Only the frontier is joined in each round."""
    seen = frontier = materialise(sources.select("id", F.lit(0).cast("long").alias("lvl")).distinct(), "frontier")
    pairs = edges.select("src", "dst")
    for level in range(1, most_levels + 1):
        reached = pairs.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = materialise(reached.join(seen, "id", "left_anti").withColumn("lvl", F.lit(level).cast("long")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def rcm_order(edges: DataFrame) -> DataFrame:
    """id, rnk: reverse Cuthill-McKee by levels, from the vertex of least degree of each component: (component, level, degree, id), reversed."""
    deg = degrees(edges).select("id", "deg")
    labels = materialise(star_components(edges).join(deg, "id"), "labels")
    roots = labels.groupBy("label").agg(F.min(F.struct("deg", "id")).alias("m")).select(F.col("m.id").alias("id"))
    levels = bfs_levels(edges, roots)
    return numbered(labels.join(levels, "id"), F.desc("label"), F.desc("lvl"), F.desc("deg"), F.desc("id"), name="rnk").select("id", "rnk")


def order_clusters(order: DataFrame, size: int) -> DataFrame:
    """id, cid: consecutive runs of an order as clusters."""
    return order.select("id", F.expr(f"rnk div {size}").alias("cid"))


def balloon_clusters(edges: DataFrame, clusters: int, salt: str = "42") -> DataFrame:
    """id, cid: clusters grown at once from hashed roots; in each round a free vertex joins the adjacent cluster that is smallest so far."""
    from graphloom.functions.priority import priority

    ids = vertices_of(edges).select("id")
    roots = ids.orderBy(priority("id", salt), "id").limit(clusters).withColumn("cid", F.col("id"))
    state = materialise(ids.join(roots, "id", "left"), "balloon")
    while True:
        sizes = state.where("cid is not null").groupBy("cid").agg(F.count("*").alias("size"))
        taken = state.where("cid is not null").join(sizes, "cid").select(F.col("id").alias("dst"), "cid", "size")
        free = state.where("cid is null").select(F.col("id").alias("src"))
        offers = edges.select("src", "dst").join(free, "src").join(taken, "dst").groupBy(F.col("src").alias("id")).agg(F.min(F.struct("size", "cid")).alias("m"))
        new = materialise(offers.select("id", F.col("m.cid").alias("got")), "balloon-offers")
        if new.isEmpty():
            break
        state = materialise(state.join(new, "id", "left").select("id", F.coalesce("cid", "got").alias("cid")), "balloon")
    return state.select("id", F.coalesce("cid", "id").alias("cid"))
