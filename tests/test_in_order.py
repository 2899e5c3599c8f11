"""Decisions in one task against the rounds, and graphs that rounds were too slow for."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import coarsen, kernels
from graphloom.plans import in_order
from graphloom.sources import tables
from graphloom.session import materialise


def both(monkeypatch, run):
    """What one task gives and what rounds give, which the bound on groups brings about."""
    own = {tuple(r) for r in run().collect()}
    monkeypatch.setattr(in_order, "MOST_GROUPS", 0)
    assert own == {tuple(r) for r in run().collect()} and own


@pytest.fixture(scope="module")
def few(spark, sf):
    return materialise(tables.order_part(spark, sf).where("pmod(src, 2) = pmod(dst + 1, 2) and least(src, dst) % 7 < 3"), "few")


def test_colors_as_by_rounds(spark, few, monkeypatch):
    both(monkeypatch, lambda: kernels.coloring(few))


def test_distance_two_colors_as_by_rounds(spark, few, monkeypatch):
    both(monkeypatch, lambda: kernels.coloring2(few))


def test_bipartite_colors_as_by_rounds(spark, few, monkeypatch):
    both(monkeypatch, lambda: kernels.coloring_bipartite(few.where("src % 2 = 0").select(F.col("src").alias("i"), F.col("dst").alias("j"))))


def test_independent_set_as_by_rounds(spark, few, monkeypatch):
    both(monkeypatch, lambda: coarsen.mis2(few))


def test_vertices_in_pieces(spark, few, monkeypatch):
    """Vertices whose rows are packed apart, isolated ones, and an order by all of the priority where 64 bits are equal."""
    want = {tuple(r) for r in kernels.coloring(few, few.select(F.col("src").alias("id")).distinct().unionByName(spark.range(-5, 0))).collect()}
    monkeypatch.setattr(in_order, "CHUNK_ROWS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {tuple(r) for r in kernels.coloring(few, few.select(F.col("src").alias("id")).distinct().unionByName(spark.range(-5, 0))).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and {(k, 0) for k in range(-5, 0)} <= got


def test_no_pairs_within_two_steps_are_formed(spark, monkeypatch):
    """A star of 3,000 leaves has nine million pairs within two steps; each vertex has a colour of its own."""
    monkeypatch.setattr(kernels, "two_hop", lambda edges: pytest.fail("pairs formed"))
    up = spark.range(1, 3001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1).cast("long").alias("w"))
    star = materialise(up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "star")
    assert sorted(r["color"] for r in kernels.coloring2(star).collect()) == list(range(3001))
