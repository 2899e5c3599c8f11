"""The engine's queries over the warehouse tables: one for each operator that has something to compute there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import small_dense
from graphloom.functions.priority import priority
from graphloom.functions.reducers import reducers
from graphloom.operators import coarsen, contract, kernels, partition, sparse, spectral
from graphloom.operators import graph as g
from graphloom.plans import experiments, multilevel
from graphloom.plans.iterate import numbered, running_sum
from graphloom.sources import files, tables
from graphloom.session import materialise, shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _long(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.col(n).cast("long"))
    return df


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The co-purchase graph, written once for a query that reads it more than once."""
    return materialise(tables.copurchase(spark, sf_dir), "edges")


def _parity(edges: DataFrame) -> DataFrame:
    """A fixed bisection of a graph: part = id mod 2."""
    return materialise(g.vertices_of(edges).select("id", (F.col("id") % 2).cast("int").alias("part")), "parity")


def _price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of integers: prices in cents."""
    return tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.round(F.col("p_retailprice") * 100).cast("long").alias("v"))


def _size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("long").alias("v"))


def _matrix(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("v"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' trade as a graph: weights of both directions summed."""
    half = tables.nation_trade(spark, sf_dir).where("i <> j").groupBy(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(F.sum("v").cast("long").alias("w"))
    return materialise(g.mirrored(half), "nations")


def _ids_mod(edges: DataFrame, n: int, ones: int) -> DataFrame:
    """A vector with many ties: x = id * ones mod n."""
    return materialise(g.vertices_of(edges).select("id", (F.col("id") * ones % n).cast("long").alias("x")), "vector")


# --- sources ---------------------------------------------------------------------------------------------------------------------------


@query
def copurchase_edges(spark, sf_dir):
    return tables.copurchase(spark, sf_dir)


@query
def part_supplier_bipartite(spark, sf_dir):
    return tables.part_supplier(spark, sf_dir)


@query
def user_sequence_graph(spark, sf_dir):
    return tables.user_sequence(spark, sf_dir)


@query
def order_part_graph(spark, sf_dir):
    return tables.order_part(spark, sf_dir)


@query
def symmetrised_pairs(spark, sf_dir):
    """Clean unit graph of raw pairs (customer and supplier nations) with loops and repeats."""
    return g.symmetrised(tables.nation_trade(spark, sf_dir).select(F.col("i").alias("src"), F.col("j").alias("dst")))


@query
def merged_parallel_edges(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").cast("long").alias("w"))
    return g.merged(rows)


@query
def matrix_market_round_trip(spark, sf_dir):
    """The user graph written as a symmetric pattern file and read back as a clean graph."""
    path = shared_path(spark, "mtx")
    edges = tables.user_sequence(spark, sf_dir)
    n = edges.agg(F.max("src")).first()[0] + 1
    files.write_graph(edges, path, n)
    return files.read_graph(spark, path)


@query
def matrix_market_values(spark, sf_dir):
    """A general real matrix written and read with its values."""
    path = shared_path(spark, "mtx")
    files.write_matrix_market(tables.nation_trade(spark, sf_dir), path, 25, 25)
    return files.read_matrix_market(spark, path, remove_diagonal=True).select("i", "j", F.col("v").cast("long").alias("v"))


@query
def compressed_rows_round_trip(spark, sf_dir):
    path = shared_path(spark, "crs")
    edges = tables.order_part(spark, sf_dir)
    ids = materialise(numbered(g.vertices_of(edges).select(F.col("id").alias("old_id")), "old_id", name="new_id"), "ids")
    files.write_compressed_rows(g.relabelled(edges, ids), path, ids.count())
    return files.read_compressed_rows(spark, path)


@query
def edge_list_round_trip(spark, sf_dir):
    path = shared_path(spark, "edge-list")
    files.write_edge_list(tables.user_sequence(spark, sf_dir), path)
    return files.read_edge_list(spark, path)


@query
def partition_file_round_trip(spark, sf_dir):
    path = shared_path(spark, "part")
    files.write_partition(tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2).alias("part")), path)
    return files.read_partition(spark, path)


@query
def banded_matrix(spark, sf_dir):
    """Generated: a diagonally dominant banded matrix."""
    return files.random_matrix(spark, 200, 200, 5, 20, diagonal=1.5).select("i", "j", F.round("v", 6).alias("v"))


@query
def triangular_matrix(spark, sf_dir):
    """Generated: a lower triangular matrix, its diagonal one and a half times the rest of the row."""
    return files.random_matrix(spark, 200, 200, 5, 20, diagonal=1.5, triangular=True).select("i", "j", F.round("v", 6).alias("v"))


@query
def random_graph(spark, sf_dir):
    return files.random_graph(spark, 300, 4)


# --- degrees, scans, orders --------------------------------------------------------------------------------------------------------------


@query
def degree_stats(spark, sf_dir):
    return g.degree_stats(tables.copurchase(spark, sf_dir))


@query
def degree_histogram(spark, sf_dir):
    return g.histogram(g.degrees(tables.copurchase(spark, sf_dir)), "deg")


@query
def degree_order(spark, sf_dir):
    return g.degree_order(tables.copurchase(spark, sf_dir))


@query
def csr_offsets(spark, sf_dir):
    return g.row_offsets(tables.copurchase(spark, sf_dir))


@query
def lower_triangle(spark, sf_dir):
    return g.lower_triangle(tables.user_sequence(spark, sf_dir))


@query
def incidence(spark, sf_dir):
    return g.incidence(tables.user_sequence(spark, sf_dir))


@query
def running_price(spark, sf_dir):
    """Inclusive prefix sums over all parts in key order."""
    return running_sum(_price(spark, sf_dir), "v", "i", name="run").select("i", F.col("run").cast("long").alias("run"))


@query
def first_above(spark, sf_dir):
    """The first part at which the running price passes half of the total."""
    run = running_sum(_price(spark, sf_dir), "v", "i", name="run")
    total = _price(spark, sf_dir).agg(F.sum("v").alias("t"))
    return run.crossJoin(F.broadcast(total)).where("2 * run >= t").agg(F.min("i").alias("i"))


@query
def stable_split(spark, sf_dir):
    """Parts split by the parity of their size, in key order within each side."""
    from graphloom.plans.iterate import numbered_within

    rows = _size(spark, sf_dir).select("i", (F.col("v") % 2).alias("side"))
    return numbered_within(rows, "side", "i", name="pos").select("i", "side", "pos")


@query
def permuted_vector(spark, sf_dir):
    """Prices moved to the places of a hashed permutation."""
    x = _price(spark, sf_dir)
    perm = numbered(x.select("i", priority("i").alias("p_")), "p_", "i", name="p").select("i", "p")
    return sparse.permuted(x, perm)


@query
def members_by_color(spark, sf_dir):
    """The reverse map, as counts and extremes of each value's members."""
    own = sparse.members(_size(spark, sf_dir).select(F.col("i").alias("id"), "v"), "v")
    return own.groupBy("v").agg(F.count("*").alias("n"), F.min_by("id", "nr").alias("first"), F.max_by("id", "nr").alias("last"))


# --- components, traversal ---------------------------------------------------------------------------------------------------------------


@query
def connected_components(spark, sf_dir):
    return g.star_components(tables.order_part(spark, sf_dir))


@query
def largest_component(spark, sf_dir):
    return g.largest_component(tables.order_part(spark, sf_dir))


@query
def bfs_levels(spark, sf_dir):
    edges = tables.order_part(spark, sf_dir)
    return g.bfs_levels(edges, edges.agg(F.min("src").alias("id")))


@query
def rcm_clusters(spark, sf_dir):
    """Runs of eight of the reverse Cuthill-McKee order; rows only."""
    return g.order_clusters(g.rcm_order(tables.order_part(spark, sf_dir)), 8)


@query
def rcm_order(spark, sf_dir):
    return g.rcm_order(tables.order_part(spark, sf_dir))


@query
def balloon_clusters(spark, sf_dir):
    """Grown clusters: the cluster of each vertex."""
    return g.balloon_clusters(materialise(tables.user_sequence(spark, sf_dir), "edges"), 16)


# --- sparse algebra ----------------------------------------------------------------------------------------------------------------------


@query
def transpose_matrix(spark, sf_dir):
    return sparse.transpose(tables.part_supplier_matrix(spark, sf_dir))


@query
def spmv_weighted(spark, sf_dir):
    return _long(sparse.spmv(_matrix(tables.copurchase(spark, sf_dir)), _size(spark, sf_dir)), "v").select(F.col("i").alias("id"), F.col("v").alias("y"))


@query
def spmv_transposed(spark, sf_dir):
    """y = 2 A' x + 3 y0 of the part by supplier matrix."""
    y = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("long").alias("v"))
    return _long(sparse.spmv(tables.part_supplier_matrix(spark, sf_dir), _size(spark, sf_dir), 2, y, 3, "T"), "v")


@query
def spmv_columns(spark, sf_dir):
    """Two vectors at once."""
    x = _size(spark, sf_dir).select("i", F.lit(0).alias("c"), "v").unionByName(_price(spark, sf_dir).select("i", F.lit(1).alias("c"), "v"))
    return _long(sparse.spmm(_matrix(tables.copurchase(spark, sf_dir)), x), "c", "v")


@query
def spgemm_two_hop(spark, sf_dir):
    a = _matrix(tables.user_sequence(spark, sf_dir))
    return _long(sparse.spgemm(a, a), "v")


@query
def spadd(spark, sf_dir):
    a = tables.nation_trade(spark, sf_dir)
    return _long(sparse.spadd(2, a, -1, sparse.transpose(a)), "v")


@query
def spgemm_jacobi(spark, sf_dir):
    a = tables.nation_trade(spark, sf_dir)
    return sparse.spgemm_jacobi(0.5, a, a).select("i", "j", F.round("v", 4).alias("v"))


@query
def diag_copy(spark, sf_dir):
    return sparse.diagonal(tables.nation_trade(spark, sf_dir))


@query
def sum_into(spark, sf_dir):
    a = tables.nation_trade(spark, sf_dir)
    return _long(sparse.replace_values(a, a.where("(i + j) % 3 = 0").select("i", "j", F.lit(1000).alias("v")), add=True), "v")


@query
def replace_values(spark, sf_dir):
    a = tables.nation_trade(spark, sf_dir)
    return _long(sparse.replace_values(a, a.where("(i + j) % 3 = 0").select("i", "j", F.lit(1000).alias("v"))), "v")


@query
def block_round_trip(spark, sf_dir):
    """Blocks of five by five and back."""
    return _long(sparse.from_blocks(sparse.to_blocks(tables.nation_trade(spark, sf_dir), 5), 5), "v")


@query
def gemm(spark, sf_dir):
    """2 A A' + 3 A, dense."""
    a = tables.nation_trade(spark, sf_dir)
    return _long(sparse.gemm(2, a, a, 3, a, trans_b=True), "v")


@query
def trmm(spark, sf_dir):
    a = tables.nation_trade(spark, sf_dir)
    return _long(sparse.trmm(1, a, a), "v")


@query
def blas1_summary(spark, sf_dir):
    own = sparse.norms(_price(spark, sf_dir)).crossJoin(sparse.dot(_price(spark, sf_dir), _size(spark, sf_dir)))
    return _long(own, "nrm1", "nrm2sq", "nrminf", "iamax", "total", "dot")


@query
def blas1_vectors(spark, sf_dir):
    """update, scal, mult, abs and axpby on one frame: 2x + 3y - x*y, and its absolute value."""
    x, y = _price(spark, sf_dir), _size(spark, sf_dir)
    out = sparse.mult(1, sparse.axpby(2, x, 3, y), -1, x, y)
    return _long(out.join(sparse.each(out, F.abs).withColumnRenamed("v", "a"), "i"), "v", "a")


@query
def weighted_norm(spark, sf_dir):
    return sparse.nrm2w_squared(_price(spark, sf_dir), sparse.each(_size(spark, sf_dir), lambda v: v + 1)).select(F.round("nrm2wsq", 2).alias("nrm2wsq"))


@query
def greatest_difference(spark, sf_dir):
    return sparse.greatest_difference(_price(spark, sf_dir), sparse.scal(1, _size(spark, sf_dir)))


@query
def gs_sweep(spark, sf_dir):
    """A symmetric sweep on the trade matrix made dominant; it is dense, so each row is a colour."""
    t = tables.nation_trade(spark, sf_dir)
    off = t.where("i <> j").select("i", "j", F.col("v").cast("double"))
    a = materialise(off.unionByName(off.groupBy("i").agg((F.sum("v") * 2).alias("v")).select("i", F.col("i").alias("j"), "v")), "trade")
    b = materialise(t.groupBy("i").agg(F.sum("v").cast("double").alias("v")), "trade-sums")
    x = sparse.gauss_seidel(a, b, b.select("i", F.lit(0.0).alias("v")), b.select("i", F.col("i").alias("color")), direction="symmetric")
    return x.select("i", F.round("v", 6).alias("v"))


@query
def triangular_solve(spark, sf_dir):
    """L x = b: the whole lower triangle of the trade matrix, with a dominant diagonal (one more than the row's sum)."""
    low = _lower(spark, sf_dir)
    x = sparse.triangular_solve(low, sparse.diagonal(low).select("i", (F.col("i") % 5 * 100.0 + 100).alias("v")))
    return x.select("i", F.round("v", 6).alias("v"))


def _lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade matrix's lower triangle with a dominant diagonal for every nation."""
    low = materialise(tables.nation_trade(spark, sf_dir).where("i > j").select("i", "j", F.col("v").cast("double")), "trade")
    rows = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i"))
    diagonal = rows.join(low.groupBy("i").agg(F.sum("v").alias("s")), "i", "left").select("i", F.col("i").alias("j"), (F.coalesce("s", F.lit(0.0)) + 1).alias("v"))
    return materialise(low.unionByName(diagonal), "lower")


@query
def trsm(spark, sf_dir):
    """L X = 2 B with B = (i + 1) (j + 2) for three columns."""
    low = _lower(spark, sf_dir)
    b = sparse.diagonal(low).select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("j")).withColumn("v", (F.col("i") + 1.0) * (F.col("j") + 2))
    return sparse.trsm(2.0, low, b).select("i", "j", F.round("v", 6).alias("v"))


@query
def trtri(spark, sf_dir):
    """L times its inverse, to six places: the unit matrix."""
    low = _lower(spark, sf_dir)
    return sparse.spgemm(low, sparse.trtri(low)).select("i", "j", (F.round("v", 6) + 0.0).alias("v")).where("abs(v) > 0")


@query
def two_stage_sweep(spark, sf_dir):
    """Two forward sweeps with two inner steps on the trade matrix made dominant."""
    t = tables.nation_trade(spark, sf_dir)
    off = t.where("i <> j").select("i", "j", F.col("v").cast("double"))
    a = materialise(off.unionByName(off.groupBy("i").agg((F.sum("v") * 2).alias("v")).select("i", F.col("i").alias("j"), "v")), "trade")
    b = materialise(t.groupBy("i").agg(F.sum("v").cast("double").alias("v")), "trade-sums")
    return sparse.two_stage_gauss_seidel(a, b, b.select("i", F.lit(0.0).alias("v")), inner=2, sweeps=2).select("i", F.round("v", 6).alias("v"))


@query
def spmv_stencil(spark, sf_dir):
    """The five-point stencil on the parts' sizes, laid out in rows of 25."""
    x = _size(spark, sf_dir)
    n = x.agg(F.max("i")).first()[0] // 25 + 1
    stencil = {(0, 0): 4.0, (-1, 0): -1.0, (1, 0): -1.0, (0, -1): -1.0, (0, 1): -1.0}
    return _long(sparse.spmv_stencil(x, (n, 25), stencil), "v")


@query
def incomplete_lu(spark, sf_dir):
    """Factors of the trade matrix (its pattern is full, so nothing is dropped): the entries of their product, rounded."""
    t = tables.nation_trade(spark, sf_dir).select(F.lit(0).cast("long").alias("g"), "i", "j", F.when(F.col("i") == F.col("j"), 4.0 * F.col("v") + 100).otherwise(F.col("v").cast("double")).alias("v"))
    t = materialise(t, "trade")
    f = materialise(sparse.incomplete_lu(t), "ilu")
    product = sparse.spgemm(f.where("part = 'L'").select("i", "j", "v"), f.where("part = 'U'").select("i", "j", "v"))
    return product.select("i", "j", F.round("v").cast("long").alias("v"))


@query
def batched_small_dense(spark, sf_dir):
    """One 2x2 system for each part: LU, solve, and the residual's size; products and determinants from the factors."""
    p = small_dense.ready(tables.table(spark, sf_dir, "part"))
    own = p.select("p_partkey", F.array(F.col("p_size") + 2.0, F.lit(1.0), F.lit(1.0), F.lit(3.0)).alias("a"), F.array(F.col("p_size") * 1.0, F.lit(1.0)).alias("b"))
    solved = own.select("p_partkey", "a", small_dense.lu(2)("a").alias("f"), "b").select("p_partkey", "f", small_dense.solve_lu(2)("f", "b").alias("x"))
    return solved.select("p_partkey", F.round(F.col("x")[0], 6).alias("x0"), F.round(F.col("x")[1], 6).alias("x1"), F.round(F.col("f")[0] * F.col("f")[3], 6).alias("det"))


@query
def array_algebra(spark, sf_dir):
    """Lane-wise functions that need no Python: dot, norm, shifted diagonal."""
    p = tables.table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size") * 1.0, F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("a"))
    moved = small_dense.shifted_diagonal(F.col("a"), 2, 10.0)
    return p.select("p_partkey", small_dense.dot(F.col("a"), moved).alias("dot"), small_dense.dot(small_dense.axpby(2.0, F.col("a"), 1.0, small_dense.identity(2)), small_dense.filled(4, 1.0)).alias("total"))


@query
def all_reducers(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") + 3).cast("long").alias("v"))
    return rows.agg(*[c.alias(n) for n, c in reducers("v", "id").items()])


# --- mappings and contraction ------------------------------------------------------------------------------------------------------------


@query
def heavy_neighbor(spark, sf_dir):
    return coarsen.heavy_neighbour(tables.copurchase(spark, sf_dir))


@query
def hec3_map(spark, sf_dir):
    return coarsen.hec3(tables.copurchase(spark, sf_dir))


@query
def hec3_coarse_edges(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return contract.contract_edges(edges, coarsen.hec3(edges))


@query
def hec3_coarse_vertices(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return contract.contract_vertices(g.vertices_of(edges), coarsen.hec3(edges))


@query
def contract_ptap(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return contract.contract_by_products(edges, materialise(coarsen.hec3(edges), "mapping"))


@query
def hec_map(spark, sf_dir):
    return coarsen.hec_serial(_edges(spark, sf_dir))


@query
def hec2_map(spark, sf_dir):
    return coarsen.hec2(_edges(spark, sf_dir))


@query
def matching_pairs(spark, sf_dir):
    return coarsen.matching_pairs(tables.user_sequence(spark, sf_dir))


@query
def leaf_pairs(spark, sf_dir):
    return coarsen.leaf_pairs(tables.order_part(spark, sf_dir))


@query
def twin_pairs(spark, sf_dir):
    return coarsen.twin_pairs(tables.order_part(spark, sf_dir))


@query
def relative_round(spark, sf_dir):
    """Even ids (orders) are free, parts are the hubs."""
    edges = tables.order_part(spark, sf_dir)
    return coarsen.relative_round(edges, g.vertices_of(edges).where("id % 2 = 0").select("id"))


@query
def two_hop_matching_sizes(spark, sf_dir):
    """The composite matching: clusters by size; rows only."""
    own = coarsen.two_hop_matching(tables.order_part(spark, sf_dir)).groupBy("cid").agg(F.count("*").alias("size"))
    return own.groupBy("size").agg(F.count("*").alias("cnt"))


@query
def mis2_set(spark, sf_dir):
    return coarsen.mis2(tables.order_part(spark, sf_dir)).where("state = 1").select("id")


@query
def mis2_map(spark, sf_dir):
    return coarsen.mis2_aggregation(tables.order_part(spark, sf_dir))


@query
def gosh_map(spark, sf_dir):
    return coarsen.gosh(tables.user_sequence(spark, sf_dir))


@query
def gosh2_seeds(spark, sf_dir):
    return coarsen.gosh2_seeds(tables.copurchase(spark, sf_dir))


@query
def gosh2_stage1(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return coarsen.gosh2_stage(edges, coarsen.gosh2_seeds(edges).withColumn("root", F.col("id")), "w")


@query
def gosh2_map(spark, sf_dir):
    """All stages: every vertex has a cluster; rows only."""
    return coarsen.gosh2(_edges(spark, sf_dir))


@query
def weighted_aggregation(spark, sf_dir):
    """The interpolation weights of each vertex."""
    own = coarsen.weighted_aggregation(materialise(tables.user_sequence(spark, sf_dir), "edges"))
    return own.select("id", "rep", F.round("v", 9).alias("v"))


@query
def recoarsen_map(spark, sf_dir):
    """Clusters of the users' graph within 20 parts, some of which have vertices without a neighbour of their part."""
    edges = materialise(tables.user_sequence(spark, sf_dir), "edges")
    return coarsen.recoarsen_hec(edges, materialise(g.vertices_of(edges).select("id", (F.col("id") % 20).alias("part")), "part"))


@query
def recoarsen_matching_map(spark, sf_dir):
    part = g.vertices_of(tables.user_sequence(spark, sf_dir)).select("id", (F.col("id") % 2).cast("int").alias("part"))
    own = coarsen.recoarsen_matching(tables.user_sequence(spark, sf_dir), part).join(part, "id").groupBy("cid").agg(F.count_distinct("part").alias("parts"), F.count("*").alias("n"))
    return own.agg(F.sum("n").alias("vertices"), F.max("parts").alias("parts"))


@query
def coarsen_summary(spark, sf_dir):
    """Three levels of heavy-edge clustering: lvl, n, m, w."""
    levels = multilevel.hierarchy(tables.copurchase(spark, sf_dir), method="hec3", most_levels=2)
    return spark.createDataFrame(multilevel.level_summary(levels), "lvl long, n long, m long, w long")


@query
def prolong(spark, sf_dir):
    mapping = coarsen.hec3(_edges(spark, sf_dir))
    coarse = mapping.select(F.col("cid").alias("id"), (F.col("cid") * 3 + 1).alias("x")).distinct()
    return contract.prolong(mapping, coarse)


@query
def restrict(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return _long(contract.restrict_partition(coarsen.hec3(edges), g.vertices_of(edges), _parity(edges)), "part")


# --- partitions --------------------------------------------------------------------------------------------------------------------------


@query
def edge_cut(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return partition.edge_cut(edges, _parity(edges))


@query
def gains(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return partition.gains(edges, _parity(edges))


@query
def imbalance(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return partition.imbalance(g.vertices_of(edges), _parity(edges))


@query
def median_bisection(spark, sf_dir):
    x = materialise(g.degrees(tables.copurchase(spark, sf_dir)), "degrees").select("id", F.col("wdeg").alias("x"))
    return _long(partition.split_by_order(x), "part")


@query
def weighted_bisection(spark, sf_dir):
    """By weighted degree, part 0 up to half of the vertices' weight (here their degree)."""
    deg = materialise(g.degrees(tables.copurchase(spark, sf_dir)), "degrees")
    return _long(partition.split_by_order(deg.select("id", F.col("wdeg").alias("x")), "x", deg.select("id", F.col("deg").alias("vw"))), "part")


def _scan(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    part = _parity(edges)
    order = numbered(partition.gains(edges, part).where("gain > 0"), F.desc("gain"), "id", name="pos").select("id", "pos")
    return partition.cut_scan(edges, g.vertices_of(edges), part, order)


@query
def cut_scan(spark, sf_dir):
    return _scan(spark, sf_dir)


@query
def cut_scan_best_prefix(spark, sf_dir):
    return _long(partition.best_prefix(_scan(spark, sf_dir), 20), "target")


@query
def partition_edit_distance(spark, sf_dir):
    a = _parity(tables.copurchase(spark, sf_dir))
    return partition.edit_distance(a, a.select("id", (F.col("id") % 3 % 2).cast("int").alias("part")))


@query
def split_subgraphs(spark, sf_dir):
    return _long(partition.split_graph(tables.user_sequence(spark, sf_dir), g.vertices_of(tables.user_sequence(spark, sf_dir)).select("id", (F.col("id") % 2).cast("int").alias("part"))), "part")


@query
def gggp_cuts(spark, sf_dir):
    """Grown partitions of the nations' trade graph: the cut and the size of each seed."""
    edges = _nations(spark, sf_dir)
    return partition.greedy_growing(edges, g.vertices_of(edges)).select("seed", "cut", F.size("ids").cast("long").alias("n"))


@query
def gggp_best_cut(spark, sf_dir):
    """The grown partition of the smallest cut."""
    edges = _nations(spark, sf_dir)
    return partition.edge_cut(edges, materialise(partition.growing_partition(edges, g.vertices_of(edges)), "grown"))


@query
def split_cuts(spark, sf_dir):
    """The co-purchase graph in the order of a vector: the cut of each split that an imbalance of one percent allows."""
    edges = _edges(spark, sf_dir)
    return partition.split_cuts(edges, _ids_mod(edges, 97, 31), imb=1.0)


@query
def best_split(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return partition.best_split(edges, _ids_mod(edges, 97, 31), imb=1.0)


@query
def median_cut(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return partition.median_cut(edges, _ids_mod(edges, 97, 31)).select(F.col("cut").cast("long"), F.round("balance", 6).alias("balance"))


@query
def swept_partition(spark, sf_dir):
    """A vector made a bisection, with the vertices of the window of one percent taken over one by one."""
    edges = _edges(spark, sf_dir)
    return _long(partition.swept_partition(edges, _ids_mod(edges, 97, 31), imb=1.0), "part")


@query
def interleaved_order(spark, sf_dir):
    """Movers of the co-purchase graph, best first, both parts in turn; parts of three to one, so the heavier one begins alone."""
    edges = _edges(spark, sf_dir)
    part = materialise(g.vertices_of(edges).select("id", F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("part")), "part")
    order = materialise(numbered(partition.gains(edges, part).where("gain > 0"), F.desc("gain"), "id", name="pos").select("id", "pos"), "order")
    return partition.interleaved_for_balance(order, g.vertices_of(edges), part)


@query
def fourway_cut(spark, sf_dir):
    """Recursive bisection of the users' graph into four parts: sizes, and the total cut against that of id mod 4 (below one is better)."""
    edges = materialise(tables.user_sequence(spark, sf_dir), "edges")
    part = materialise(multilevel.recursive_partition(edges, 2, steps=5), "fourway")
    base = g.vertices_of(edges).select("id", (F.col("id") % 4).alias("part"))
    cut = partition.edge_cut(edges, part).crossJoin(partition.edge_cut(edges, base).withColumnRenamed("cut", "plain"))
    return cut.crossJoin(part.groupBy("part").agg(F.count("*").alias("n")).agg(F.count("*").alias("parts"), F.sum("n").alias("n"))).select("n", "parts", (F.col("cut") < F.col("plain")).alias("better"))


@query
def recoarsening_cycles(spark, sf_dir):
    """Two more cycles of coarsening within the parts never make the cut of the nations' graph worse."""
    edges = _nations(spark, sf_dir)
    one, more = multilevel.bisect(edges), multilevel.bisect(edges, cycles=2)
    both = partition.edge_cut(edges, one).crossJoin(partition.edge_cut(edges, more).withColumnRenamed("cut", "after"))
    return both.select((F.col("after") <= F.col("cut")).alias("no_worse"))


@query
def binary_graph_round_trip(spark, sf_dir):
    """The users' graph as a record of 64-bit numbers, written and read."""
    return _through_binary(spark, sf_dir, True)


@query
def binary_graph_round_trip_32(spark, sf_dir):
    return _through_binary(spark, sf_dir, False)


def _through_binary(spark: SparkSession, sf_dir: str, wide: bool) -> DataFrame:
    """Written by ranges, joined by the driver in the shared folder (a local one in tests), read by splits."""
    edges = materialise(tables.user_sequence(spark, sf_dir), "edges")
    path = shared_path(spark, "binary")
    n = edges.agg(F.max("src")).first()[0] + 1
    files.write_binary_graph(edges, path, n, wide)
    files.publish_binary_graph(spark, path, path + ".bin")
    return files.read_binary_graph(spark, path + ".bin", wide)


@query
def fm_improves(spark, sf_dir):
    """Moves on the nations' graph never raise the cut and keep the balance within the tolerance."""
    half = tables.nation_trade(spark, sf_dir).where("i <> j").groupBy(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(F.sum("v").cast("long").alias("w"))
    edges = materialise(g.mirrored(half), "edges")
    v = g.vertices_of(edges)
    part = v.select("id", (F.col("id") % 2).cast("int").alias("part"))
    new = materialise(partition.refine_small(edges, v, part), "refined")
    own = partition.edge_cut(edges, part).crossJoin(partition.edge_cut(edges, new).withColumnRenamed("cut", "after")).crossJoin(partition.imbalance(v, new))
    return own.select((F.col("after") <= F.col("cut")).alias("no_worse"), (F.abs("imb") <= 20).alias("balanced"))


@query
def batch_refinement(spark, sf_dir):
    """Distributed moves from the parity split of the users' graph: the cut falls."""
    edges = materialise(tables.user_sequence(spark, sf_dir), "edges")
    v = g.vertices_of(edges)
    part = v.select("id", (F.col("id") % 2).cast("int").alias("part"))
    new = partition.refine_in_batches(edges, v, part, rounds=2)
    own = partition.edge_cut(edges, part).crossJoin(partition.edge_cut(edges, new).withColumnRenamed("cut", "after"))
    return own.select((F.col("after") < F.col("cut")).alias("better"))


def _quality(edges, part, base):
    own = partition.edge_cut(edges, part).crossJoin(partition.edge_cut(edges, base).withColumnRenamed("cut", "before")).crossJoin(part.agg(F.count("*").alias("n"), F.sum("part").alias("ones")))
    return own.select("n", (F.col("cut") < F.col("before")).alias("better"), (F.abs(2 * F.col("ones") - F.col("n")) <= F.greatest(F.lit(40), F.col("n") / 10)).alias("balanced"))


@query
def bisect_quality(spark, sf_dir):
    """Multilevel bisection of the co-purchase graph against the parity split."""
    edges = _edges(spark, sf_dir)
    return _quality(edges, multilevel.bisect(edges), _parity(edges))


@query
def spectral_bisection(spark, sf_dir):
    """Multilevel spectral bisection of the sparse graph's largest component; rows only."""
    edges = tables.user_sequence(spark, sf_dir)
    part = multilevel.bisect(edges, refine="spectral", steps=5)
    return part.groupBy("part").agg(F.count("*").alias("n"))


# --- spectral ----------------------------------------------------------------------------------------------------------------------------


@query
def vec_project(spark, sf_dir):
    """Sizes less their mean, normalised."""
    x = _size(spark, sf_dir).select(F.col("i").alias("id"), F.col("v").cast("double").alias("x"))
    return spectral.normalised(spectral.orthogonalised(x)).select("id", F.round("x", 6).alias("x"))


@query
def power_iter_10(spark, sf_dir):
    """Ten steps on the nations' trade graph from the vector of ids."""
    half = tables.nation_trade(spark, sf_dir).where("i <> j").groupBy(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(F.sum("v").cast("long").alias("w"))
    edges = materialise(g.mirrored(half), "edges")
    x = g.vertices_of(edges).select("id", F.col("id").cast("double").alias("x"))
    return spectral.power_iteration(edges, x, 10).select("id", F.round("x", 5).alias("x"))


@query
def rayleigh(spark, sf_dir):
    edges = tables.user_sequence(spark, sf_dir)
    x = g.vertices_of(edges).select("id", (F.col("id") % 7).cast("double").alias("x"))
    return spectral.rayleigh(edges, x).select(F.round("quotient", 6).alias("quotient"), F.round("norm", 4).alias("norm"), F.round("bound", 4).alias("bound"))


@query
def drawing_coordinates(spark, sf_dir):
    """Second and third vectors of the nations' graph after four steps of the walk, the third kept apart from the second."""
    half = tables.nation_trade(spark, sf_dir).where("i <> j").groupBy(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(F.sum("v").cast("long").alias("w"))
    edges = materialise(g.mirrored(half), "edges")
    v = g.vertices_of(edges)
    xy = spectral.coordinates(edges, spectral.start_vector(v, "a"), spectral.start_vector(v, "b"), 4)
    return xy.select("id", F.round("u2", 6).alias("u2"), F.round("u3", 6).alias("u3"))


# --- kernels -----------------------------------------------------------------------------------------------------------------------------


@query
def triangle_count(spark, sf_dir):
    return kernels.triangle_count(_edges(spark, sf_dir))


@query
def triangles_per_vertex(spark, sf_dir):
    return kernels.triangles_per_vertex(_edges(spark, sf_dir))


@query
def coloring_colors(spark, sf_dir):
    return _long(kernels.coloring(materialise(tables.user_sequence(spark, sf_dir), "edges")), "color")


@query
def coloring_conflicts(spark, sf_dir):
    edges = materialise(tables.user_sequence(spark, sf_dir), "edges")
    return kernels.conflicts(edges, materialise(kernels.coloring(edges), "colors"))


@query
def d2_coloring_colors(spark, sf_dir):
    return _long(kernels.coloring2(materialise(tables.order_part(spark, sf_dir), "edges")), "color")


@query
def bipartite_coloring(spark, sf_dir):
    """The colours of the rows (orders) of the order by part matrix: none that share a column (part) are alike."""
    a = tables.order_part(spark, sf_dir).where("src % 2 = 0").select(F.col("src").alias("i"), F.col("dst").alias("j"))
    return _long(kernels.coloring_bipartite(a), "color")


# --- experiments -------------------------------------------------------------------------------------------------------------------------


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs made of the tables: graphs are regions, methods are order priorities, figures are sums over months of orders."""
    o = tables.table(spark, sf_dir, "orders").join(tables.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    own = o.groupBy(F.col("c_mktsegment").alias("graph"), F.substring("o_orderpriority", 1, 1).alias("method"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("run"))
    rows = own.agg(F.count("*").alias("cut"), F.round(F.sum("o_totalprice")).cast("long").alias("time"))
    levels = F.transform(F.sequence(F.lit(0), (F.col("run") % 3).cast("int")), lambda k: F.struct((F.col("cut") * 8 / F.pow(F.lit(2), k)).cast("long").alias("number-vertices")))
    return rows.withColumn("coarse-levels", levels)


@query
def experiment_stats(spark, sf_dir):
    own = experiments.run_stats(_runs(spark, sf_dir), ["cut", "time"])
    return own.select("graph", "method", "figure", "min", "max", *[F.round(c, 4).alias(c) for c in ("mean", "median", "stdev")])


@query
def experiment_level_stats(spark, sf_dir):
    own = experiments.level_stats(_runs(spark, sf_dir))
    return _long(own.select("graph", "method", "level", "runs", "min", "max", *[F.round(c, 4).alias(c) for c in ("mean", "median")]), "level")


@query
def method_ratios(spark, sf_dir):
    return experiments.method_ratios(_runs(spark, sf_dir), "time", "1").select("graph", "method", F.round("ratio", 6).alias("ratio"))


@query
def geomean(spark, sf_dir):
    return experiments.geometric_mean(experiments.method_ratios(_runs(spark, sf_dir), "time", "1")).select("method", F.round("geomean", 6).alias("geomean"))


@query
def coarsen_rate(spark, sf_dir):
    return _long(experiments.coarsening_rates(_runs(spark, sf_dir)), "levels").select("graph", "method", "run", "levels", F.round("rate", 6).alias("rate"))


@query
def cut_variation(spark, sf_dir):
    return experiments.variation(_runs(spark, sf_dir), "cut").select("graph", "method", F.round("cv", 6).alias("cv"))


@query
def method_table(spark, sf_dir):
    own = experiments.method_table(_runs(spark, sf_dir), "time", ["1", "2", "3"])
    return own.select("graph", *[F.round(c, 2).alias(f"m{c}") for c in ("1", "2", "3")])


@query
def normalised_times(spark, sf_dir):
    return experiments.normalised(_runs(spark, sf_dir).select("graph", "method", "run", "time"), "graph", "time").select("graph", "method", "run", "time", experiments.rounded("normal", 6).alias("normal"))


@query
def figures_by_run(spark, sf_dir):
    """Lists of figures in run order, as text."""
    own = experiments.transposed(_runs(spark, sf_dir), ["graph", "method"], ["cut"])
    return own.select("graph", "method", F.array_join(F.transform("cut", lambda x: x.cast("string")), ",").alias("cuts"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)
