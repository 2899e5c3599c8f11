"""Loops that need more rounds than any fixed bound."""

import pytest
from pyspark.sql import functions as F

from graphloom import session
from graphloom.operators import kernels
from graphloom.plans import iterate
from graphloom.sources import tables
from graphloom.session import materialise


def test_coloring_of_a_large_clique(spark):
    ids = spark.range(230)
    edges = ids.select(F.col("id").alias("src")).crossJoin(ids.select(F.col("id").alias("dst"))).where("src <> dst").withColumn("w", F.lit(1).cast("long"))
    assert sorted(r["color"] for r in kernels.coloring(materialise(edges, "clique")).collect()) == list(range(230))


def test_the_rest_is_coloured_as_by_rounds(spark, sf, monkeypatch):
    edges = materialise(tables.user_sequence(spark, sf), "edges")
    monkeypatch.setattr(kernels, "ROUNDS_FIRST", 2)
    early = {(r["id"], r["color"]) for r in kernels.coloring(edges).collect()}
    monkeypatch.setattr(kernels, "ROUNDS_FIRST", 10**6)
    assert early == {(r["id"], r["color"]) for r in kernels.coloring(edges).collect()}


def test_a_loop_without_progress_ends(spark, monkeypatch):
    monkeypatch.setattr(iterate, "STALLED_ROUNDS", 3)
    with pytest.raises(RuntimeError):
        iterate.fixpoint(spark.range(2), lambda s: s, F.lit(True), "endless")


def test_a_balloon_reaches_the_end_of_a_long_path(spark):
    from graphloom.operators import graph

    up = spark.range(210).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    path = materialise(up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("w", F.lit(1).cast("long")), "path")
    assert graph.balloon_clusters(path, 1).select("cid").distinct().count() == 1


def test_released_tables_are_deleted(spark):
    df = session.materialise(spark.range(3), "three")
    path = df._graphloom_path
    assert df.count() == 3 and not session.path_is_empty(spark, path)
    session.release(df, None)
    assert session.path_is_empty(spark, path)
    session.release(df)  # once more does nothing


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Conf:
        get = staticmethod(lambda name, other=None: other)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError):
        session.shared_path(Session, "any")


def graph_of(spark, pairs):
    half = spark.createDataFrame(pairs, "src long, dst long, w long")
    return materialise(half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "graph")


@pytest.mark.parametrize("kind", ["hub", "apart"])
def test_bisection_of_a_graph_whose_coarsening_stops(spark, monkeypatch, kind):
    """A hub takes all vertices at once, so that the next level is dropped; edges apart leave as many clusters, none of which shrink. Neither could be grown on."""
    from graphloom.operators import partition
    from graphloom.plans import multilevel

    monkeypatch.setattr(partition, "MOST_GROWN", (60, 10**6))
    pairs = [(0, k, 9) for k in range(1, 150)] + [(k, k + 1, 1) for k in range(1, 149)] if kind == "hub" else [(2 * k, 2 * k + 1, 1) for k in range(140)]
    n = 150 if kind == "hub" else 280
    part = {r["id"]: r["part"] for r in multilevel.bisect(graph_of(spark, pairs)).collect()}
    assert len(part) == n and abs(2 * sum(part.values()) - n) <= 40
