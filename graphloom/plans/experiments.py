"""Statistics over partitioning experiments: rows are runs (graph, method, run, figures, coarse levels)."""

from __future__ import annotations

import json
import subprocess
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL = "struct<`refine-iterations`: bigint, `iteration-max-reached`: bigint, `number-vertices`: bigint, `unrefined-edge-cut`: bigint>"


def five(column: str) -> dict[str, Column]:
    """min, max, mean, median and sample deviation (null for a single run)."""
    return {"min": F.min(column), "max": F.max(column), "mean": F.avg(column), "median": F.median(column), "stdev": F.stddev_samp(column)}


def run_stats(runs: DataFrame, figures: list[str], by: list[str] = ["graph", "method"]) -> DataFrame:  # noqa: B006
    """by, figure, min, max, mean, median, stdev: figures are unpivoted, then one aggregate."""
    long = runs.unpivot(by, figures, "figure", "value") if figures else runs
    return long.groupBy(*by, "figure").agg(*[c.alias(n) for n, c in five("value").items()])


def level_stats(runs: DataFrame, by: list[str] = ["graph", "method"]) -> DataFrame:  # noqa: B006
    """by, level, runs and the statistics of the levels' vertices; runs with fewer levels are missing from the deeper ones."""
    own = runs.select(*by, F.posexplode("coarse-levels").alias("level", "at")).select(*by, "level", F.col("at.number-vertices").alias("value"))
    return own.groupBy(*by, "level").agg(F.count("*").alias("runs"), *[c.alias(n) for n, c in five("value").items()])


def transposed(runs: DataFrame, by: list[str], figures: list[str]) -> DataFrame:
    """Each figure's values of all runs, in run order, as one array (runs of one experiment are few)."""
    lists = runs.groupBy(*by).agg(*[F.sort_array(F.collect_list(F.struct("run", f))).alias(f) for f in figures])
    return lists.select(*by, *[F.col(f)[f].alias(f) for f in figures])


def method_ratios(runs: DataFrame, figure: str, base: str) -> DataFrame:
    """graph, method, ratio of medians to the base method; null where either is missing."""
    medians = runs.groupBy("graph", "method").agg(F.median(figure).alias("m"))
    names = medians.select("graph").distinct().crossJoin(medians.select("method").distinct())  # a few names each
    own = names.join(medians, ["graph", "method"], "left").join(medians.where(F.col("method") == base).select("graph", F.col("m").alias("b")), "graph", "left")
    return own.select("graph", "method", (F.col("m") / F.col("b")).alias("ratio"))


def shown(ratio: Column) -> Column:
    """A ratio with two decimals, or the mark of a run that is missing."""
    return F.coalesce(F.format_number(ratio, 2), F.lit("{OOM}"))


def geometric_mean(ratios: DataFrame, by: str = "method", value: str = "ratio") -> DataFrame:
    return ratios.where(f"{value} > 0").groupBy(by).agg(F.exp(F.avg(F.log(value))).alias("geomean"))


def coarsening_rates(runs: DataFrame) -> DataFrame:
    """graph, method, run, levels, rate: (last / first)^(1 / (levels - 1)) of the levels' vertices."""
    levels = F.col("coarse-levels")
    first, last = levels[0]["number-vertices"], F.element_at(levels, -1)["number-vertices"]
    rate = F.when(F.size(levels) > 1, F.pow(last / first, 1 / (F.size(levels) - 1)))
    return runs.select("graph", "method", "run", F.size(levels).alias("levels"), rate.alias("rate"))


def variation(runs: DataFrame, figure: str) -> DataFrame:
    """graph, method, cv: sample deviation over mean."""
    return runs.groupBy("graph", "method").agg((F.stddev_samp(figure) / F.avg(figure)).alias("cv"))


def method_table(runs: DataFrame, figure: str, methods: list[str]) -> DataFrame:
    """graph and one column of medians for each method."""
    return runs.groupBy("graph").pivot("method", methods).agg(F.median(figure))


def normalised(rows: DataFrame, group: str, value: str) -> DataFrame:
    """rows with value over its group's least (for plots)."""
    least = rows.groupBy(group).agg(F.min(value).alias("_least"))
    return rows.join(least, group).withColumn("normal", F.col(value) / F.col("_least")).drop("_least")


def rounded(column: str, digits: int) -> Column:
    """A number rounded in binary, as SQL engines do it: scaled, rounded to a whole number, scaled back. Spark's own rounding takes the shortest decimal form, which
    makes a tie of what lies just below one."""
    scale = F.lit(float(10**digits))
    return F.round(F.col(column) * scale, 0) / scale


def run_experiments(commands: dict[str, list[str]], logs: str, timeout: int = 3600) -> dict[str, str]:
    """Runs each command whose log is missing; `done`, `kept`, `failed` or `timeout` by name."""
    out = {}
    for name, command in commands.items():
        log = Path(logs) / f"{name}.json"
        if log.exists():
            out[name] = "kept"
            continue
        try:
            got = subprocess.run(command, timeout=timeout, capture_output=True, text=True)
        except subprocess.TimeoutExpired:
            out[name] = "timeout"
            continue
        if got.returncode:
            out[name] = "failed"
            print(got.stderr[-500:], file=sys.stderr)
        else:
            log.write_text(got.stdout if got.stdout.strip().startswith(("[", "{")) else json.dumps({"output": got.stdout}))
            out[name] = "done"
    return out


def tolerance_sweep(run: Callable[[float], dict], tolerances: list[float], repeats: int) -> list[dict]:
    """Figures of each run, with its tolerance, for run_stats(by=["tolerance"])."""
    return [run(t) | {"tolerance": t, "run": k} for t in tolerances for k in range(repeats)]
