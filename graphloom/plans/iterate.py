"""Rounds of a driver loop over DataFrames, and numbering that needs no single task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialise

#: Rounds in a row that decide no row, after which a loop counts as endless.
STALLED_ROUNDS = 64


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], pending: Column, name: str, finish: Callable[[DataFrame, int], DataFrame | None] | None = None) -> DataFrame:
    """step() applied until no row of the state is pending; each state is a written table, so that lineage stays short and losses are cheap.

    There is no bound on rounds that decide rows. finish(state, rounds) may decide all that is left at once; None goes on with rounds.
    """
    state = materialise(state, name)
    rounds, least, stalled = 0, None, 0
    while left := state.where(pending).count():
        stalled = 0 if least is None or left < least else stalled + 1
        least = left if least is None else min(least, left)
        if stalled >= STALLED_ROUNDS:
            raise RuntimeError(f"{name}: {left} rows still pending, none decided in {stalled} rounds")
        done = finish(state, rounds) if finish else None
        if done is not None:
            return materialise(done, name)
        state = materialise(step(state), name)
        rounds += 1
    return state


def numbered(df: DataFrame, *order: Column | str, name: str = "nr") -> DataFrame:
    """df with 0-based positions in a total order: rows are dealt by range, numbered within their range, and moved up by the ranges before."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = materialise(df.repartitionByRange(*columns).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").count()  # one row for each partition
    before = sizes.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    local = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*columns)) - 1)
    return local.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_own", "_before")


def numbered_within(df: DataFrame, group: str, *order: Column | str, name: str = "nr") -> DataFrame:
    """0-based positions within each group, without gathering a group in one task."""
    ranked = numbered(df, group, *order, name="_at")
    first = ranked.groupBy(group).agg(F.min("_at").alias("_first"))
    return ranked.join(first, group).withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first")


def running_sum(df: DataFrame, value: str, *order: Column | str, name: str = "running", exclusive: bool = False) -> DataFrame:
    """df with the running sum of a column in a total order, by ranges as numbered() does it."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = materialise(df.repartitionByRange(*columns).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_own_", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_own_") - (F.col(value) if exclusive else F.lit(0))).drop("_range", "_own_", "_before")
