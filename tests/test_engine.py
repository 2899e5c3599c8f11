"""Operators against plain Python on small graphs, and laws that hold for any graph."""

import itertools
import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import coarsen, contract, kernels, partition, sparse
from graphloom.operators import graph as g
from graphloom.operators.components import star_components
from graphloom.plans import multilevel
from graphloom.plans.iterate import numbered, numbered_within, running_sum


def frame(spark, half):
    rows = [(a, b, w) for a, b, w in half] + [(b, a, w) for a, b, w in half]
    return spark.createDataFrame(rows, "src long, dst long, w long")


def random_half(seed, n, m, most=9):
    rng = random.Random(seed)
    pairs = rng.sample(list(itertools.combinations(range(n), 2)), m)
    return [(a, b, rng.randint(1, most)) for a, b in pairs]


def near(half):
    out = {}
    for a, b, w in half:
        out.setdefault(a, {})[b] = w
        out.setdefault(b, {})[a] = w
    return out


def prio(x, salt="42"):
    return md5(f"{x}-{salt}".encode()).hexdigest()


def as_map(df):
    return {r["id"]: r["cid"] for r in df.collect()}


def clusters(mapping):
    out = {}
    for k, c in mapping.items():
        out.setdefault(c, set()).add(k)
    return sorted(map(sorted, out.values()))


def test_bucket_of_parallel_edges(spark):
    dst, w = [0, 2, 4, 3, 2, 4, 2, 0, 3, 1], range(15, 25)
    got = g.merged(spark.createDataFrame([(7, d, x) for d, x in zip(dst, w)], "src long, dst long, w long"))
    assert {r["dst"]: r["w"] for r in got.collect()} == {0: 37, 1: 24, 2: 56, 3: 41, 4: 37}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    half = random_half(seed, 60, 40)
    label = {x: x for e in half for x in e[:2]}
    for _ in range(60):
        for a, b, _w in half:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["id"]: r["label"] for r in star_components(frame(spark, half)).collect()} == label
    top = min(set(label.values()), key=lambda x: (-list(label.values()).count(x), x))
    got = g.largest_component(frame(spark, half)).collect()
    assert {r["old_id"]: r["new_id"] for r in got} == {x: k for k, x in enumerate(sorted(i for i, c in label.items() if c == top))}


def test_components_of_nothing_and_loops(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert star_components(none).collect() == []
    loop = spark.createDataFrame([(5, 5), (1, 2), (2, 1)], "src long, dst long")
    assert {r["id"]: r["label"] for r in star_components(loop).collect()} == {1: 1, 2: 1, 5: 5}


def hn_of(half):
    return {u: max(ns, key=lambda v: (ns[v], prio(v), v)) for u, ns in near(half).items()}


@pytest.mark.parametrize("seed", [3, 4])
def test_heavy_edge_clustering_in_visiting_order(spark, seed):
    half = random_half(seed, 40, 80, 4)
    hn, root = hn_of(half), {}
    for u in sorted(hn, key=lambda x: (prio(x), x)):
        if u not in root:
            root.setdefault(hn[u], hn[u])
            root[u] = root[hn[u]]
    assert clusters(as_map(coarsen.hec_serial(frame(spark, half)))) == clusters(root)


@pytest.mark.parametrize("seed", [5, 6])
def test_heavy_edge_clustering_closed_form(spark, seed):
    half = random_half(seed, 40, 70, 4)
    hn = hn_of(half)
    root = {u: min(u, v) if hn[v] == u else u if u in hn.values() else None for u, v in hn.items()}
    root = {u: r if r is not None else root[hn[u]] for u, r in root.items()}
    got = as_map(coarsen.hec3(frame(spark, half)))
    assert clusters(got) == clusters(root) and sorted(set(got.values())) == list(range(len(set(got.values()))))


def test_every_mapping_covers_the_graph_and_keeps_weights(spark):
    half = random_half(7, 50, 90)
    edges = frame(spark, half)
    v = g.vertices_of(edges)
    for name, f in multilevel.MAPPINGS.items():
        mapping = f(edges, v)
        m = as_map(mapping)
        assert set(m) == set(near(half)), name
        assert contract.contract_vertices(v, mapping).agg(F.sum("vw")).first()[0] == len(m)
        want = {}
        for a, b, w in half:
            if m[a] != m[b]:
                for x, y in ((m[a], m[b]), (m[b], m[a])):
                    want[x, y] = want.get((x, y), 0) + w
        assert {(r["src"], r["dst"]): r["w"] for r in contract.contract_edges(edges, mapping).collect()} == want, name


def test_contraction_equals_matrix_products(spark):
    edges = frame(spark, random_half(8, 40, 90))
    mapping = coarsen.hec3(edges)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(contract.contract_edges(edges, mapping)) == rows(contract.contract_by_products(edges, mapping))


def test_matching_is_maximal_and_locally_heaviest(spark):
    half = random_half(9, 40, 70)
    pairs = [(r["a"], r["b"]) for r in coarsen.matching_pairs(frame(spark, half)).collect()]
    used = [x for p in pairs for x in p]
    assert len(used) == len(set(used))
    assert all(a in used or b in used for a, b, _ in half)
    greedy, taken = set(), set()
    rank = lambda e: (e[2], md5(f"{min(e[:2])}-{max(e[:2])}-42".encode()).hexdigest())
    for a, b, _ in sorted(half, key=rank, reverse=True):
        if not {a, b} & taken:
            greedy.add((min(a, b), max(a, b)))
            taken |= {a, b}
    assert set(pairs) == greedy


def test_leaves_twins_and_relatives(spark):
    star = frame(spark, [(0, k, 1) for k in range(1, 6)])
    assert sorted(map(tuple, coarsen.leaf_pairs(star).collect())) == [(1, 2), (3, 4)]
    bipartite = frame(spark, [(a, b, 1) for a in (0, 1) for b in (2, 3, 4)])
    assert sorted(map(tuple, coarsen.twin_pairs(bipartite).collect())) == [(0, 1), (2, 3)]
    free = spark.createDataFrame([(2,), (3,), (4,)], "id long")
    assert [tuple(r) for r in coarsen.relative_round(bipartite, free).collect()] == [(2, 3)]


@pytest.mark.parametrize("seed", [10, 11])
def test_mis2_is_greedy(spark, seed):
    half = random_half(seed, 40, 50)
    ns = near(half)
    two = {u: {x for v in ns[u] for x in (v, *ns[v])} - {u} for u in ns}
    want, out = set(), set()
    for u in sorted(ns, key=lambda x: (prio(x), x), reverse=True):
        if u not in out:
            want.add(u)
            out |= two[u] | {u}
    assert {r["id"] for r in coarsen.mis2(frame(spark, half)).where("state = 1").collect()} == want


def test_parts_are_kept_when_coarsening_again(spark):
    half = random_half(12, 40, 60)
    edges = frame(spark, half)
    part = g.vertices_of(edges).select("id", (F.col("id") % 2).cast("int").alias("part"))
    for f in (coarsen.recoarsen_hec, coarsen.recoarsen_matching):
        assert all(len({x % 2 for x in c}) == 1 for c in clusters(as_map(f(edges, part))))


def test_interpolation_weights(spark):
    rows = coarsen.weighted_aggregation(frame(spark, random_half(13, 30, 60))).collect()
    sums = {}
    for r in rows:
        sums[r["id"]] = sums.get(r["id"], 0) + r["v"]
    assert all(abs(s - 1) < 1e-9 for s in sums.values()) and len(sums) == len(near(random_half(13, 30, 60)))


def test_cut_gains_and_scan_agree(spark):
    half = random_half(14, 30, 60)
    edges = frame(spark, half)
    v = g.vertices_of(edges)
    part = {x: x % 2 for x in near(half)}
    cut = lambda p: sum(w for a, b, w in half if p[a] != p[b])
    pdf = spark.createDataFrame(list(part.items()), "id long, part int")
    assert partition.edge_cut(edges, pdf).first()["cut"] == cut(part)
    gains = {r["id"]: r["gain"] for r in partition.gains(edges, pdf).collect()}
    for x in part:
        assert gains[x] == cut(part) - cut(part | {x: 1 - part[x]})
    order = sorted(part, key=lambda x: (prio(x), x))
    odf = spark.createDataFrame([(x, k) for k, x in enumerate(order)], "id long, pos long")
    scan = {r["prefix"]: (r["cut"], r["imb"]) for r in partition.cut_scan(edges, v, pdf, odf).collect()}
    now = dict(part)
    for k, x in enumerate(order):
        now[x] = 1 - now[x]
        assert scan[k + 1] == (cut(now), sum(1 if p == 0 else -1 for p in now.values()))


def test_refinement_never_worsens(spark):
    half = random_half(15, 60, 200)
    edges = frame(spark, half)
    v = g.vertices_of(edges)
    part = v.select("id", (F.col("id") % 2).cast("int").alias("part"))
    before = partition.edge_cut(edges, part).first()["cut"]
    for new in (partition.refine_small(edges, v, part), partition.refine_in_batches(edges, v, part)):
        assert partition.edge_cut(edges, new).first()["cut"] <= before
        assert new.count() == v.count()


def test_two_cliques_are_told_apart(spark):
    half = [(a, b, 5) for s in (0, 20) for a, b in itertools.combinations(range(s, s + 20), 2)] + [(0, 20, 1)]
    edges = frame(spark, half)
    for options in ({}, {"refine": "spectral", "steps": 10}):
        part = {r["id"]: r["part"] for r in multilevel.bisect(edges, **options).collect()}
        assert len({part[x] for x in range(20)}) == 1 and part[0] != part[20]
    again = multilevel.bisect(edges, cycles=1)
    assert partition.edge_cut(edges, again).first()["cut"] == 1
    assert multilevel.best_of(edges, ["1", "2"])[1] == 1


def test_four_parts(spark):
    half = [(a, b, 5) for s in (0, 15, 30, 45) for a, b in itertools.combinations(range(s, s + 15), 2)] + [(0, 15, 1), (15, 30, 1), (30, 45, 1)]
    part = {r["id"]: r["part"] for r in multilevel.recursive_partition(frame(spark, half), 2).collect()}
    assert len(part) == 60 and set(part.values()) == {0, 1, 2, 3}


COLOUR = "0-1 0-4 1-2 1-5 2-3 2-6 3-7 4-5 4-8 5-6 5-9 6-7 6-10 6-12 7-17 8-9 8-13 9-10 9-14 10-11 10-15 11-12 11-16 12-17 13-14 14-15 15-16 16-17"


def test_colours(spark):
    half = [(*map(int, p.split("-")), 1) for p in COLOUR.split()]
    edges = frame(spark, half)
    colors = kernels.coloring(edges)
    assert kernels.conflicts(edges, colors).first()[0] == 0 and kernels.triangle_count(edges).first()[0] == 0
    two = kernels.coloring2(edges)
    assert kernels.conflicts(kernels.two_hop(edges), two).first()[0] == 0


def test_triangles(spark):
    half = random_half(16, 30, 120)
    ns = near(half)
    want = [t for t in itertools.combinations(sorted(ns), 3) if t[1] in ns[t[0]] and t[2] in ns[t[0]] and t[2] in ns[t[1]]]
    assert sorted(tuple(sorted(r)) for r in kernels.triangles(frame(spark, half)).collect()) == want


def dense(df, n, m):
    out = np.zeros((n, m))
    for r in df.collect():
        out[r["i"], r["j"]] += r["v"]
    return out


def test_sparse_products_and_solvers(spark):
    rng = np.random.default_rng(5)
    a = np.where(rng.random((12, 12)) < 0.4, rng.integers(-5, 6, (12, 12)), 0).astype(float)
    np.fill_diagonal(a, 40)
    x = rng.random(12)
    mat = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i long, j long, v double")
    vec = lambda v: spark.createDataFrame([(k, float(q)) for k, q in enumerate(v)], "i long, v double")
    got = lambda d: np.array([r["v"] for r in d.orderBy("i").collect()])
    assert np.allclose(got(sparse.spmv(mat(a), vec(x))), a @ x)
    assert np.allclose(got(sparse.spmv(mat(a), vec(x), 2, vec(x), 3, "T")), 2 * a.T @ x + 3 * x)
    assert np.allclose(dense(sparse.spgemm(mat(a), mat(a)), 12, 12), a @ a)
    assert np.allclose(dense(sparse.spadd(2, mat(a), -1, sparse.transpose(mat(a))), 12, 12), 2 * a - a.T)
    d = np.diag(1 / np.diag(a))
    assert np.allclose(dense(sparse.spgemm_jacobi(0.7, mat(a), mat(a)), 12, 12), a - 0.7 * d @ a @ a)
    low = np.tril(a)
    assert np.allclose(got(sparse.triangular_solve(mat(low), vec(x))), np.linalg.solve(low, x))
    colors = spark.createDataFrame([(k, k) for k in range(12)], "i long, color int")
    sweep = x * 0
    for i in [*range(12), *range(11, -1, -1)]:
        sweep[i] = (x[i] - a[i] @ sweep + a[i, i] * sweep[i]) / a[i, i]
    assert np.allclose(got(sparse.gauss_seidel(mat(a), vec(x), vec(x * 0), colors, direction="symmetric")), sweep)
    f = sparse.incomplete_lu(mat(a).withColumn("g", F.lit(0).cast("long")), fill=20)
    low, up = (dense(f.where(F.col("part") == p), 12, 12) for p in "LU")
    assert np.allclose(low @ up, a)
    assert np.allclose(dense(sparse.from_blocks(sparse.to_blocks(mat(a), 4), 4), 12, 12), a)
    assert sparse.spgemm(mat(a * 0), mat(a)).count() == 0


def test_numbering_and_running_sums(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 5), rng.randint(-9, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, k int, v long").repartition(7)
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r["id"]: r["nr"] for r in numbered(df, "k", "id").collect()} == want
    inside = {r["id"]: r["nr"] for r in numbered_within(df, "k", "id").collect()}
    assert all(inside[r[0]] == sum(1 for q in rows if q[1] == r[1] and q[0] < r[0]) for r in rows)
    total, sums = 0, {}
    for r in sorted(rows):
        sums[r[0]] = total
        total += r[2]
    assert {r["id"]: r["running"] for r in running_sum(df, "v", "id", exclusive=True).collect()} == sums
    assert numbered(df.limit(0), "id").count() == 0
