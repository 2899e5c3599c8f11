"""Files of every form, the settings reader, small dense functions and statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import small_dense
from graphloom.operators import graph as g
from graphloom.plans import experiments
from graphloom.sources import files


def write(path, text):
    path.write_text(text)
    return str(path)


def entries(df):
    return sorted((r["i"], r["j"], r["v"]) for r in df.collect())


def test_matrix_market_forms(spark, tmp_path):
    head = "%%MatrixMarket matrix coordinate "
    a = write(tmp_path / "a.mtx", head + "real general\n% note\n3 3 3\n1 1 2.5\n3 1 -1\n1 2 4\n")
    assert entries(files.read_matrix_market(spark, a)) == [(0, 0, 2.5), (0, 1, 4.0), (2, 0, -1.0)]
    assert entries(files.read_matrix_market(spark, a, remove_diagonal=True, transpose=True)) == [(0, 2, -1.0), (1, 0, 4.0)]
    assert entries(files.read_matrix_market(spark, a, symmetrize=True)) == [(0, 0, 2.5), (0, 1, 4.0), (0, 2, -1.0), (1, 0, 4.0), (2, 0, -1.0)]
    b = write(tmp_path / "b.mtx", head + "pattern symmetric\n3 3 2\n2 1\n3 3\n")
    assert entries(files.read_matrix_market(spark, b)) == [(0, 1, 1.0), (1, 0, 1.0), (2, 2, 1.0)]
    c = write(tmp_path / "c.mtx", head + "integer skew-symmetric\n3 3 1\n3 1 7\n")
    assert entries(files.read_matrix_market(spark, c)) == [(0, 2, -7.0), (2, 0, 7.0)]
    d = write(tmp_path / "d.mtx", "%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n")
    assert entries(files.read_matrix(spark, d)) == [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]
    e = write(tmp_path / "e.mtx", "%%MatrixMarket matrix array real symmetric\n2 2\n1\n2\n3\n")
    assert entries(files.read_matrix_market(spark, e)) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 3.0)]
    with pytest.raises(ValueError):
        files.read_matrix_market(spark, write(tmp_path / "f.mtx", "1 2 3\n"))


def test_graphs_of_square_and_rectangular_files(spark, tmp_path):
    head = "%%MatrixMarket matrix coordinate pattern general\n"
    pairs = lambda df: sorted((r["src"], r["dst"]) for r in df.collect())
    square = write(tmp_path / "s.mtx", head + "3 3 4\n1 2\n2 1\n3 3\n2 3\n")
    assert pairs(files.read_graph(spark, square)) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    wide = write(tmp_path / "w.mtx", head + "2 3 2\n1 1\n2 3\n")
    assert pairs(files.read_graph(spark, wide)) == [(0, 3), (2, 4), (3, 0), (4, 2)]


def test_binary_and_text_round_trips(spark, tmp_path):
    edges = g.symmetrised(spark.createDataFrame([(0, 1), (1, 3), (3, 4), (0, 4)], "src long, dst long"))
    want = sorted((r["src"], r["dst"]) for r in edges.collect())
    files.write_binary_graph(edges, str(tmp_path / "bin"), 6)
    (tmp_path / "g.bin").write_bytes(files.binary_graph_bytes(spark, str(tmp_path / "bin")))
    assert len((tmp_path / "g.bin").read_bytes()) == 48 + 4 * 7 + 4 * len(want)
    assert sorted(map(tuple, files.read_binary_graph(spark, str(tmp_path / "g.bin")).collect())) == want
    for head in (False, True):
        path = str(tmp_path / f"crs{head}")
        files.write_compressed_rows(edges, path, 6, head)
        assert sorted(map(tuple, files.read_compressed_rows(spark, path).collect())) == want
    files.write_edge_list(edges, str(tmp_path / "el"), binary=True)
    assert files.read_edge_list(spark, str(tmp_path / "el"), binary=True).count() == len(want)
    part = spark.createDataFrame([(k, k % 2) for k in range(7)], "id long, part int")
    files.write_partition(part, str(tmp_path / "part"))
    assert sorted(map(tuple, files.read_partition(spark, str(tmp_path / "part")).collect())) == [(k, k % 2) for k in range(7)]
    files.write_coordinates(spark.createDataFrame([(1, 0.5, 2.0), (0, 1.5, 3.0)], "id long, u2 double, u3 double"), str(tmp_path / "xy"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "xy")).collect()] == ["1.5,3.0", "0.5,2.0"]
    files.write_sorted_vector(spark.createDataFrame([(1, 0.5), (0, 1.5)], "id long, x double"), str(tmp_path / "vec"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "vec")).collect()] == ["1 0.5", "0 1.5"]


def test_settings_and_metrics(spark, tmp_path):
    assert files.read_config("2\n0\n0\n2\n10\n1e-10\nnone\n") == files.Config(2, 0, 0, 2, 10, 1e-10)
    with pytest.raises(ValueError):
        files.read_config("2 0 0 3 10 1e-10")
    runs = spark.createDataFrame([("g", "m", 0, 10, [(40,), (10,)]), ("g", "m", 1, 20, [(40,)])], f"graph string, method string, run int, cut long, `coarse-levels` array<struct<`number-vertices`: long>>")
    files.write_metrics(runs, str(tmp_path / "runs"))
    back = spark.read.json(str(tmp_path / "runs"))
    assert back.count() == 2
    rates = {r["run"]: r["rate"] for r in experiments.coarsening_rates(runs).collect()}
    assert rates == {0: 0.25, 1: None}
    stats = experiments.run_stats(runs, ["cut"]).first()
    assert (stats["min"], stats["max"], stats["mean"], stats["median"]) == (10, 20, 15, 15)
    levels = {r["level"]: r["runs"] for r in experiments.level_stats(runs).collect()}
    assert levels == {0: 2, 1: 1}
    sweep = experiments.tolerance_sweep(lambda t: {"cut": t * 10}, [0.1, 0.2], 2)
    assert len(sweep) == 4 and sweep[0]["tolerance"] == 0.1


def test_small_dense(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((5, 3, 3)) + 3 * np.eye(3), rng.random((5, 3))
    df = small_dense.ready(spark.createDataFrame([(k, a[k].ravel().tolist(), b[k].tolist()) for k in range(5)], "k int, a array<double>, b array<double>"))
    rows = df.select("k", small_dense.lu(3)("a").alias("f"), "a", "b").select(
        "k", small_dense.solve_lu(3)("f", "b").alias("x"), small_dense.inverse_lu(3)("f").alias("inv"), small_dense.solve(3)("a", "b").alias("y"),
        small_dense.gemm(3, 3, 3)("a", "a").alias("aa"), small_dense.gemv(3, 3)("a", "b").alias("ab"), small_dense.trtri(3)("a").alias("t"), small_dense.trsm(3)("a", "b").alias("s"),
        small_dense.householder_vectors(3)("b").alias("h"), "b", small_dense.eigenvalues(3)("a").alias("e"),
    ).select("*", small_dense.apply_householder(3)("h", "b").alias("hb")).orderBy("k").collect()
    for k, r in enumerate(rows):
        assert np.allclose(r["x"], np.linalg.solve(a[k], b[k])) and np.allclose(r["x"], r["y"])
        assert np.allclose(np.reshape(r["inv"], (3, 3)), np.linalg.inv(a[k])) and np.allclose(np.reshape(r["aa"], (3, 3)), a[k] @ a[k])
        assert np.allclose(r["ab"], a[k] @ b[k]) and np.allclose(np.reshape(r["t"], (3, 3)) @ np.tril(a[k]), np.eye(3))
        assert np.allclose(np.tril(a[k]) @ r["s"], b[k]) and np.allclose(np.abs(r["hb"]), [np.linalg.norm(b[k]), 0, 0])
        assert np.allclose(np.sort_complex(np.linalg.eigvals(a[k])).real, r["e"][:3])
    own = spark.range(1).select(small_dense.identity(2).alias("i"), small_dense.shifted_diagonal(small_dense.filled(4, 1.0), 2, 5.0).alias("s"), small_dense.nrm2(small_dense.scaled(small_dense.filled(4, 1.0), 2.0)).alias("n"), small_dense.elementwise(small_dense.filled(2, 3.0), small_dense.filled(2, 2.0), lambda x, y: F.when(x > y, x - y).otherwise(0.0)).alias("l")).first()
    assert (own["i"], own["s"], own["n"], own["l"]) == ([1, 0, 0, 1], [6, 1, 1, 6], 4.0, [1.0, 1.0])
