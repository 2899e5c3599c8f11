"""The solver queries against dense numpy solutions of the whole trade matrix."""

import numpy as np
import pytest

from graphloom import queries
from graphloom.operators import sparse
from graphloom.sources import tables


@pytest.fixture(scope="module", name="sf")
def whole_sf(sf):
    """The smallest tables whose trade matrix has no empty entry."""
    return sf.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def trade(spark, sf):
    t = np.zeros((25, 25))
    for r in tables.nation_trade(spark, sf).collect():
        t[r["i"], r["j"]] = r["v"]
    return t


def solved(df):
    return [r["v"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_gauss_seidel(spark, sf, trade):
    a = trade - np.diag(np.diag(trade))
    np.fill_diagonal(a, 2 * a.sum(axis=1))
    b = trade.sum(axis=1)
    x = np.linalg.solve(np.triu(a), b - np.tril(a, -1) @ np.linalg.solve(np.tril(a), b))
    assert np.allclose(solved(queries.QUERIES["gs_sweep"](spark, sf)), x, atol=2e-6)


def test_triangular_solve(spark, sf, trade):
    low = np.tril(trade, -1)
    low += np.diag(low.sum(axis=1) + 1)
    assert np.allclose(solved(queries.QUERIES["triangular_solve"](spark, sf)), np.linalg.solve(low, np.arange(25) % 5 * 100.0 + 100), atol=2e-6)


def test_incomplete_lu_factors_all_entries(spark, sf, trade, monkeypatch):
    seen, own = [], sparse.incomplete_lu
    monkeypatch.setattr(sparse, "incomplete_lu", lambda a: seen.append({(r["i"], r["j"]) for r in a.collect()}) or own(a))
    whole = trade + np.diag(3 * np.diag(trade) + 100)
    got = np.zeros((25, 25))
    for r in queries.QUERIES["incomplete_lu"](spark, sf).collect():
        got[r["i"], r["j"]] = r["v"]
    assert (got == whole).all()
    assert seen == [set(zip(*(x.tolist() for x in np.nonzero(trade))))]
