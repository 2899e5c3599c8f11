"""Connected components by alternating star contractions: few rounds, joins and aggregates only, no group is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialise, release


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, label) for each end of an edge; label is the smallest id reachable. Loops and repeated edges are harmless.

    Each round hangs every larger neighbour on the least of its neighbourhood (large star), then every smaller one (small star), until
    nothing changes; the number of rounds is logarithmic. Edges live in a written table between rounds.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    first = materialise(ends, "ends")  # read once: edges may be dear to compute
    e, before, written = first.where("u <> v"), None, None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = materialise(small.distinct(), "edges")
        release(large, written)
        written = e
    loops = first.where("u = v").select(F.col("u").alias("id"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)
    return stars.unionByName(loops.join(stars, "id", "left_anti").select("id", F.col("id").alias("label")))
