"""Triangles by colours against brute force."""

from itertools import combinations

from pyspark.sql import functions as F

from graphloom.operators import kernels, triangles
from graphloom.session import materialise
from graphloom.sources import tables


def test_several_colors(spark, sf, monkeypatch):
    edges = materialise(tables.copurchase(spark, sf).where("(src + dst) % 3 = 0 or src < 40 and dst < 40"), "some")
    monkeypatch.setattr(triangles, "SEVERAL", 0)
    monkeypatch.setattr(triangles, "TASK_EDGES", 3000)
    monkeypatch.setattr(triangles, "PAIRS", 50)
    monkeypatch.setattr(triangles, "CHUNK_ROWS", 500)
    near = {}
    for r in edges.collect():
        near.setdefault(r["src"], set()).add(r["dst"])
    want = sorted((a, b, c) for a in near for b, c in combinations(sorted(x for x in near[a] if x > a), 2) if c in near[b])
    assert sorted(tuple(sorted(r)) for r in kernels.triangles(edges).collect()) == want and want
    assert kernels.triangle_count(edges).first()[0] == len(want)
    each = {v: sum(v in t for t in want) for v in near}
    assert {r["id"]: r["cnt"] for r in kernels.triangles_per_vertex(edges).collect()} == {v: n for v, n in each.items() if n}


def test_what_travels_does_not_follow_pairs(spark):
    """A complete graph of 200: 1.3 million triangles, whose pairs of neighbours were rows of a join; now each task's rows are its blocks of edges."""
    ids = spark.range(200)
    edges = materialise(ids.select(F.col("id").alias("src")).crossJoin(ids.select(F.col("id").alias("dst"))).where("src <> dst").withColumn("w", F.lit(1).cast("long")), "complete")
    count = kernels.triangle_count(edges)
    assert count.first()[0] == 200 * 199 * 198 // 6
    assert "Join" not in count._jdf.queryExecution().executedPlan().toString()


def test_without_triangles(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "src long, dst long, w long")
    assert kernels.triangle_count(edges).first()[0] == 0 and kernels.triangles_per_vertex(edges).count() == 0
    assert kernels.triangle_count(edges.limit(0)).first()[0] == 0
