"""Graphs and matrices from the warehouse tables. Edges are symmetric, without loops or repeats: src, dst, w."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import mirrored
from graphloom.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share orders; w counts the orders. Only one direction is joined and aggregated, then mirrored."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    other = own.select("o", F.col("p").alias("q"))
    return mirrored(own.join(other, "o").where("p < q").groupBy(F.col("p").alias("src"), F.col("q").alias("dst")).agg(F.count("*").alias("w")))


def part_supplier(spark: SparkSession, sf_dir: str, least_quantity: float = 0.0) -> DataFrame:
    """Bipartite: parts keep their keys, suppliers follow after the parts; w counts line items of at least the quantity."""
    parts = table(spark, sf_dir, "part").agg((F.max("p_partkey") + 1).alias("n"))  # one row
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= least_quantity).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("w"))
    return mirrored(rows.crossJoin(F.broadcast(parts)).select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + F.col("n")).alias("dst"), "w"))


def user_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events follow each other within a day; w counts how often, in either direction.

    Events are dealt by ranges of time, whatever their day; the last event of a range is followed by the first one of the next range.
    """
    rows = table(spark, sf_dir, "events").select("ts", "event_id", F.struct(F.to_date("ts").alias("day"), F.col("user_id").alias("user")).alias("own"))
    ranged = materialise(rows.repartitionByRange("ts", "event_id").withColumn("_range", F.spark_partition_id()), "events-by-time")
    firsts = ranged.groupBy("_range").agg(F.min_by("own", F.struct("ts", "event_id")).alias("first"))  # one row for each partition
    after = firsts.select("_range", F.lead("first").over(Window.orderBy("_range")).alias("after"))
    following = F.lead("own").over(Window.partitionBy("_range").orderBy("ts", "event_id"))
    both = ranged.withColumn("next", following).join(F.broadcast(after), "_range").select("own", F.coalesce("next", "after").alias("next"))
    steps = both.where("own.day = next.day and own.user <> next.user").select(F.col("own.user").alias("user_id"), F.col("next.user").alias("next"))
    half = steps.groupBy(F.least("user_id", "next").alias("src"), F.greatest("user_id", "next").alias("dst")).agg(F.count("*").alias("w"))
    return mirrored(half)


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite: orders (even ids) and parts (odd ids) of all line items."""
    rows = table(spark, sf_dir, "lineitem")
    pairs = rows.select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()
    return mirrored(pairs.withColumn("w", F.lit(1).cast("long")))


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix entries i (customer nation), j (supplier nation), v (line items)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("i"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("j"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey")
    return rows.groupBy("i", "j").agg(F.count("*").alias("v"))


def part_supplier_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix entries i (part), j (supplier), v (quantity ordered)."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"))
    return rows.agg(F.sum("l_quantity").cast("long").alias("v"))
