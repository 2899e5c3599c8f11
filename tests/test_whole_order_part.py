"""The queries on all orders and parts against brute force."""

from collections import deque

import pytest

from graphloom import queries


@pytest.fixture(scope="module")
def near(spark, sf):
    out = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        o, p = r["l_orderkey"] * 2, r["l_partkey"] * 2 + 1
        out.setdefault(o, set()).add(p)
        out.setdefault(p, set()).add(o)
    return out


def rows(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


def test_all_pairs(spark, sf, near):
    got = [(r["src"], r["dst"], r["w"]) for r in rows(spark, sf, "order_part_graph")]
    assert sorted(got) == sorted((a, b, 1) for a in near for b in near[a])


def test_levels(spark, sf, near):
    first = min(near)
    level, todo = {first: 0}, deque([first])
    while todo:
        a = todo.popleft()
        for b in near[a] - level.keys():
            level[b] = level[a] + 1
            todo.append(b)
    assert {r["id"]: r["lvl"] for r in rows(spark, sf, "bfs_levels")} == level


def test_independent_at_distance_two(spark, sf, near):
    chosen = {r["id"] for r in rows(spark, sf, "mis2_set")}
    reach = {a: (near[a] | {c for b in near[a] for c in near[b]}) - {a} for a in near}
    assert all(not reach[a] & chosen for a in chosen) and all(a in chosen or reach[a] & chosen for a in near)


def test_order_of_all_vertices(spark, sf, near):
    assert queries.QUERIES["rcm_order"](spark, sf).count() == len(near)
