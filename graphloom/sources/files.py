"""Graph and matrix files: text and binary forms, each read and written by Spark tasks. Numbering lines of one file keeps their order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import degrees, symmetrised
from graphloom.plans.iterate import numbered, running_sum
from graphloom.session import materialise, ship


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """at, value: the lines of a text file, or of a folder of them by name; at sorts in the order of lines (splits of a file are read in order)."""
    return spark.read.text(path).select("value", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line")).alias("at"))


def _header(spark: SparkSession, path: str) -> list[str]:
    """form, field, symmetry of a MatrixMarket file."""
    found = spark.read.text(path).where(F.lower("value").startswith("%%matrixmarket")).first()
    head = found["value"].lower().split() if found else []
    if len(head) < 5 or head[2] not in ("coordinate", "array"):
        raise ValueError(f"{path}: no MatrixMarket header")
    return head[2:5]


def read_matrix_market(spark: SparkSession, path: str, symmetrize: bool = False, remove_diagonal: bool = False, transpose: bool = False) -> DataFrame:
    """i, j, v (from 0) of a MatrixMarket file: coordinate or array; pattern entries are 1; symmetric, skew and hermitian forms are expanded.

    symmetrize adds the mirrored entries and keeps the first of each place. Complex values keep their real part.
    """
    form, field, shape = _header(spark, path)
    body = materialise(_lines(spark, path).where(~F.col("value").startswith("%") & (F.trim("value") != "")), "mtx")
    size = body.agg(F.min(F.struct("at", "value")).alias("m")).first()["m"]
    parts = F.split(F.trim("value"), r"\s+")
    rows = int(size["value"].split()[0])
    own = body.where((F.col("at.file") != size["at"]["file"]) | (F.col("at.line") != size["at"]["line"]))
    if form == "coordinate":
        v = F.lit(1.0) if field == "pattern" else parts[2].cast("double")
        a = own.select((parts[0].cast("long") - 1).alias("i"), (parts[1].cast("long") - 1).alias("j"), v.alias("v"), "at")
    else:  # column by column; of symmetric ones the lower triangle
        a = numbered(own.select(parts[0].cast("double").alias("v"), "at"), "at", name="k")
        if shape == "general":
            a = a.select((F.col("k") % rows).alias("i"), F.expr(f"k div {rows}").alias("j"), "v", "at")
        else:
            skip = 1 if shape.startswith("skew") else 0
            firsts = spark.range(rows).select(F.col("id").alias("j"), (F.col("id") * (rows - skip) - F.expr("id * (id - 1) div 2")).alias("first"))
            nexts = firsts.withColumn("last", F.col("first") + rows - F.col("j") - 1 - skip)
            a = a.join(nexts, (F.col("k") >= F.col("first")) & (F.col("k") <= F.col("last"))).select((F.col("k") - F.col("first") + F.col("j") + skip).alias("i"), "j", "v", "at")
    if shape != "general":
        sign = -1.0 if shape.startswith("skew") else 1.0
        a = a.unionByName(a.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * sign).alias("v"), "at"))
    if symmetrize:
        both = a.unionByName(a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v", "at"))
        a = both.groupBy("i", "j").agg(F.min_by("v", "at").alias("v"), F.min("at").alias("at"))
    if remove_diagonal:
        a = a.where("i <> j")
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v") if transpose else a.select("i", "j", "v")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """A clean graph of a coordinate MatrixMarket file: square ones are symmetrised without loops; of rectangular ones, rows follow after the columns."""
    form, _, shape = _header(spark, path)
    if form != "coordinate":
        raise ValueError(f"{path}: only coordinate files make graphs")
    parts = F.split(F.trim("value"), r"\s+")
    body = _lines(spark, path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = body.agg(F.min(F.struct("at", "value")).alias("m")).first()["m"]
    n, m = map(int, size["value"].split()[:2])
    first = F.struct(F.lit(size["at"]["file"]).alias("file"), F.lit(size["at"]["line"]).alias("line"))
    pairs = body.where(F.col("at") != first).select((parts[0].cast("long") - 1).alias("src"), (parts[1].cast("long") - 1).alias("dst"))
    if n != m and shape == "general":
        pairs = pairs.select((F.col("src") + m).alias("src"), "dst")
    return symmetrised(pairs)


def write_matrix_market(a: DataFrame, path: str, rows: int, columns: int, symmetric: bool = False, pattern: bool = False) -> None:
    """A folder of text files whose concatenation in order is one MatrixMarket file. symmetric writes the lower triangle."""
    spark = a.sparkSession
    own = a.where("i >= j") if symmetric else a
    own = materialise(own, "mtx-entries")
    head = [f"%%MatrixMarket matrix coordinate {'pattern' if pattern else 'real'} {'symmetric' if symmetric else 'general'}", f"{rows} {columns} {own.count()}"]
    fields = [(F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), *([] if pattern else [F.col("v").cast("string")])]
    spark.createDataFrame([(x,) for x in head], "value string").coalesce(1).write.mode("overwrite").text(path + "/part=0")
    own.sortWithinPartitions("i", "j").select(F.concat_ws(" ", *fields).alias("value")).write.mode("overwrite").text(path + "/part=1")


def write_graph(edges: DataFrame, path: str, n: int) -> None:
    """The lower triangle as `pattern symmetric`."""
    write_matrix_market(edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w"), path, n, n, symmetric=True, pattern=True)


def write_binary_graph(edges: DataFrame, path: str, n: int, wide: bool = False) -> None:
    """Compressed rows as one binary record: six 64-bit numbers (n, directed m, 1, 0, 1, 0), offsets, neighbours; these of 32 bits, or of 64 if wide.

    The record is written in ranges: rows (part, nr, data) whose data, in that order, are the record.
    """
    ship(edges.sparkSession)
    m = edges.count()
    if not wide and max(n, m) >= 1 << 32:
        raise ValueError(f"{n} vertices and {m} edges do not fit 32 bits; write a wide record")
    kind = "<u8" if wide else "<u4"
    counts = edges.sparkSession.range(n).join(degrees(edges).select("id", "deg"), "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))
    ends = running_sum(counts, "deg", "id", name="end")
    rows = ends.select(F.lit(0).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("end").cast("long").alias("v")).unionByName(
        edges.select(F.lit(1).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dst").alias("v"))
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for nr, b in enumerate(batches):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "nr": [nr], "data": [b["v"].to_numpy().astype(kind).tobytes()]})

    head = np.array([n, m, 1, 0, 1, 0], dtype="<i8").tobytes() + np.zeros(1, dtype=kind).tobytes()
    body = rows.repartitionByRange("k", "a", "b").sortWithinPartitions("k", "a", "b").mapInPandas(encode, "part int, nr int, data binary")
    body.unionByName(edges.sparkSession.createDataFrame([(-1, 0, bytearray(head))], "part int, nr int, data binary")).write.mode("overwrite").parquet(path)


def save_binary_graph(spark: SparkSession, path: str, file: str) -> None:
    """The record written by write_binary_graph as a file of the driver, range by range."""
    with open(file, "wb") as out:
        for r in spark.read.parquet(path).orderBy("part", "nr").toLocalIterator():
            out.write(r["data"])


def publish_binary_graph(spark: SparkSession, path: str, file: str) -> None:
    """The same as a file of the shared folder, through Hadoop's file system, a range of the record at a time."""
    target = spark._jvm.org.apache.hadoop.fs.Path(file)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        for r in spark.read.parquet(path).orderBy("part", "nr").toLocalIterator():
            out.write(r["data"])
    finally:
        out.close()


def binary_graph_bytes(spark: SparkSession, path: str) -> bytes:
    """The record written by write_binary_graph, for a small graph."""
    return b"".join(bytes(r["data"]) for r in spark.read.parquet(path).orderBy("part", "nr").toLocalIterator())


def read_binary_graph(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """src, dst of a file of that format. The file is read in splits as numbers of fixed size, so no task holds more than a split."""
    ship(spark)
    size, kind = (8, "<u8") if wide else (4, "<u4")
    first = 48 // size
    records = spark.sparkContext.binaryRecords(path, size)
    n, m = (int(x) for x in np.frombuffer(b"".join(records.take(first))[:16], "<i8"))

    def numbers(rows: Iterator[tuple[bytes, int]]) -> Iterator[tuple[int, int]]:
        while chunk := list(islice(rows, 65_536)):
            yield from zip((i for _, i in chunk), np.frombuffer(b"".join([r for r, _ in chunk]), kind).tolist())

    own = materialise(spark.createDataFrame(records.zipWithIndex().mapPartitions(numbers), "at long, value long").where(F.col("at") >= first), "binary-graph")
    last = own.where(F.col("at") == first + n).first()
    if last is None or last["value"] != m or own.count() != n + 1 + m:
        raise ValueError("the offsets do not end at the number of edges")
    offsets = own.where(F.col("at") < first + n).select((F.col("at") - first).alias("src"), F.col("value").alias("at"))
    near = own.where(F.col("at") > first + n).select((F.col("at") - first - n - 1).alias("at"), F.col("value").alias("dst"))
    return _with_rows(offsets, near)


def _with_rows(offsets: DataFrame, near: DataFrame) -> DataFrame:
    """src, dst: the neighbours (at, dst) with the rows that own them, by the rows' offsets (src, at)."""
    starts = offsets.groupBy("at").agg(F.max("src").alias("src"))  # empty rows share an offset; the last owns what follows
    marked = near.join(starts, "at", "left")
    # the owner of a place is that of the last offset before it: carried on by a running maximum over ranges
    ranged = materialise(marked.repartitionByRange("at").withColumn("_r", F.spark_partition_id()), "crs-rows")
    most = ranged.groupBy("_r").agg(F.max("src").alias("m"))
    before = most.select("_r", F.max("m").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)).alias("b"))
    own_max = F.max("src").over(Window.partitionBy("_r").orderBy("at"))
    return ranged.withColumn("s", own_max).join(F.broadcast(before), "_r").select(F.greatest("s", "b").alias("src"), "dst")


def write_edge_list(edges: DataFrame, path: str, binary: bool = False) -> None:
    """Text `src dst w`, or 64-bit triples in Parquet's binary cells."""
    if not binary:
        edges.select(F.concat_ws(" ", "src", "dst", "w").alias("value")).write.mode("overwrite").text(path)
    else:
        edges.select("src", "dst", "w").write.mode("overwrite").parquet(path)


def read_edge_list(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    if binary:
        return spark.read.parquet(path)
    p = F.split("value", r"\s+")
    return spark.read.text(path).select(p[0].cast("long").alias("src"), p[1].cast("long").alias("dst"), p[2].cast("long").alias("w"))


def write_compressed_rows(edges: DataFrame, path: str, n: int, adjacency_head: bool = False) -> None:
    """Text of compressed rows: sizes, offsets, neighbours, one a line; adjacency_head puts `AdjacencyGraph` first and leaves the end offset out."""
    spark = edges.sparkSession
    m = edges.count()
    counts = spark.range(n).join(degrees(edges).select("id", "deg"), "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))
    offsets = running_sum(counts, "deg", "id", name="first", exclusive=True)
    head = (["AdjacencyGraph"] if adjacency_head else []) + [str(n), str(m)]
    start = spark.createDataFrame([(0, k, 0, x) for k, x in enumerate(head)], "k int, a long, b long, value string")
    rows = start.unionByName(offsets.select(F.lit(1).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("first").cast("string").alias("value")))
    if not adjacency_head:
        rows = rows.unionByName(spark.createDataFrame([(1, n, 0, str(m))], "k int, a long, b long, value string"))
    rows = rows.unionByName(edges.select(F.lit(2).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dst").cast("string").alias("value")))
    rows.repartitionByRange("k", "a", "b").sortWithinPartitions("k", "a", "b").select("value").write.mode("overwrite").text(path)


def read_compressed_rows(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of such a text, with either head."""
    own = numbered(_lines(spark, path), "at", name="nr")
    own = materialise(own.select("nr", "value"), "crs")
    skip = 1 if own.where("nr = 0").first()["value"] == "AdjacencyGraph" else 0
    n = int(own.where(F.col("nr") == skip).first()["value"])
    first = skip + 2
    offsets = own.where((F.col("nr") >= first) & (F.col("nr") < first + n)).select((F.col("nr") - first).alias("src"), F.col("value").cast("long").alias("at"))
    near = own.where(F.col("nr") >= first + n + (1 - skip)).select((F.col("nr") - first - n - (1 - skip)).alias("at"), F.col("value").cast("long").alias("dst"))
    return _with_rows(offsets, near)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """By the file's extension: .mtx and .mm, .bin, .crs; i, j, v."""
    end = path.rsplit(".", 1)[-1]
    if end in ("mtx", "mm"):
        return read_matrix_market(spark, path)
    if end in ("bin", "crs"):
        pairs = read_binary_graph(spark, path) if end == "bin" else read_compressed_rows(spark, path)
        return pairs.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("v"))
    raise ValueError(f"{path}: unknown extension")


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """id, part: one label a line, the line's position is the vertex."""
    return numbered(_lines(spark, path), "at", name="id").select("id", F.trim("value").cast("int").alias("part"))


def write_partition(part: DataFrame, path: str) -> None:
    part.repartitionByRange("id").sortWithinPartitions("id").select(F.col("part").cast("string").alias("value")).write.mode("overwrite").text(path)


def write_coordinates(xy: DataFrame, path: str) -> None:
    """`u2,u3` a line, in id order."""
    xy.repartitionByRange("id").sortWithinPartitions("id").select("u2", "u3").write.mode("overwrite").csv(path)


def write_sorted_vector(x: DataFrame, path: str) -> None:
    """`id value` a line, by value."""
    x.repartitionByRange("x", "id").sortWithinPartitions("x", "id").select(F.concat_ws(" ", "id", "x").alias("value")).write.mode("overwrite").text(path)


@dataclass(frozen=True)
class Config:
    """Six positional settings of an experiment; a seventh line is not read."""

    coarsening: int = 4
    refinement: int = 0
    local_search: int = 0
    partitions: int = 2
    iterations: int = 10
    tolerance: float = 1e-10


def read_config(text: str) -> Config:
    kinds = (int, int, int, int, int, float)
    names = ("coarsening", "refinement", "local_search", "partitions", "iterations", "tolerance")
    values = {n: k(v) for n, k, v in zip(names, kinds, text.split())}
    config = replace(Config(), **values)
    if config.partitions not in (2, 4):
        raise ValueError("partitions must be 2 or 4")
    return config


def write_metrics(runs: DataFrame, path: str) -> None:
    """One JSON object for each run; columns keep their names, coarse-levels is an array of structs."""
    runs.write.mode("append").json(path)


def random_matrix(spark: SparkSession, rows: int, columns: int, per_row: int, band: int, salt: str = "13721", diagonal: float | None = None, triangular: bool = False) -> DataFrame:
    """i, j, v: hashed values in [-50, 50), per_row places of each row drawn in a band around the diagonal, with wrap-around; repeats merge.

    triangular keeps j <= i; diagonal sets a_ii to that times the row's absolute sum (at least one).
    """
    from graphloom.functions.priority import unit_double

    own = spark.range(rows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))).alias("k"))
    key = F.col("i") * per_row + F.col("k")
    at = F.pmod((F.col("i") * columns / rows).cast("long") + F.floor((unit_double(key, salt) - 0.5) * band).cast("long"), F.lit(columns))
    a = own.select("i", at.alias("j"), (100 * unit_double(key, salt + "v") - 50).alias("v")).groupBy("i", "j").agg(F.max("v").alias("v"))
    if triangular:
        a = a.where("j <= i")
    if diagonal is not None:
        a = a.where("i <> j")
        sums = a.groupBy("i").agg(F.sum(F.abs("v")).alias("s"))
        a = a.unionByName(spark.range(rows).select(F.col("id").alias("i")).join(sums, "i", "left").select("i", F.col("i").alias("j"), F.greatest(F.lit(1.0), diagonal * F.coalesce("s", F.lit(0.0))).alias("v")))
    return a


def random_graph(spark: SparkSession, n: int, per_vertex: int, salt: str = "13721") -> DataFrame:
    """src, dst, w = 1: a clean undirected graph from per_vertex hashed neighbours of each vertex; loops and repeats go."""
    return symmetrised(random_matrix(spark, n, n, per_vertex, n, salt).select(F.col("i").alias("src"), F.col("j").alias("dst")))
