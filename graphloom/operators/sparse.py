"""Sparse and dense linear algebra on coordinate frames: vectors (i, v), matrices (i, j, v)."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.iterate import numbered_within
from graphloom.session import materialise, ship


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def spmv(a: DataFrame, x: DataFrame, alpha: float = 1, y: DataFrame | None = None, beta: float = 0, mode: str = "N") -> DataFrame:
    """y = alpha op(A) x + beta y, with op by mode N or T (for real entries C and H are N and T). Rows without entries appear if y has them."""
    own = transpose(a) if mode in ("T", "H") else a
    out = own.join(x.select(F.col("i").alias("j"), F.col("v").alias("xv")), "j").groupBy("i").agg((F.sum(F.col("v") * F.col("xv")) * alpha).alias("v"))
    return out if y is None else axpby(1, out, beta, y)


def spmm(a: DataFrame, x: DataFrame) -> DataFrame:
    """Several vectors at once: x (i, c, v) gives (i, c, v)."""
    return a.join(x.select(F.col("i").alias("j"), "c", F.col("v").alias("xv")), "j").groupBy("i", "c").agg(F.sum(F.col("v") * F.col("xv")).alias("v"))


def spgemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """C = A B: one join on the inner index and one aggregate, combined before the shuffle."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("v").alias("bv"))
    return a.select("i", F.col("j").alias("k"), "v").join(right, "k").groupBy("i", F.col("c").alias("j")).agg(F.sum(F.col("v") * F.col("bv")).alias("v"))


def spadd(alpha: float, a: DataFrame, beta: float, b: DataFrame) -> DataFrame:
    """alpha A + beta B: union and aggregate."""
    return a.select("i", "j", (F.col("v") * alpha).alias("v")).unionByName(b.select("i", "j", (F.col("v") * beta).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("i = j").select("i", "v")


def spgemm_jacobi(omega: float, a: DataFrame, b: DataFrame) -> DataFrame:
    """C = (I - omega D^-1 A) B = B - omega D^-1 (A B)."""
    scaled = spgemm(a, b).join(diagonal(a).select("i", F.col("v").alias("d")), "i").select("i", "j", (F.col("v") / F.col("d")).alias("v"))
    return spadd(1.0, b, -omega, scaled)


def replace_values(a: DataFrame, new: DataFrame, add: bool = False) -> DataFrame:
    """Existing entries set to (or raised by) those of new; entries that A lacks stay out."""
    own = a.join(new.select("i", "j", F.col("v").alias("nv")), ["i", "j"], "left")
    return own.select("i", "j", (F.col("v") + F.coalesce("nv", F.lit(0)) if add else F.coalesce("nv", "v")).alias("v"))


def to_blocks(a: DataFrame, size: int) -> DataFrame:
    """Point entries as blocks: bi, bj, block (row-major array of size * size)."""
    at = ((F.col("i") % size) * size + F.col("j") % size).cast("int")
    filled = F.map_from_entries(F.collect_list(F.struct(at.alias("at"), F.col("v").cast("double").alias("v"))))
    block = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit(0.0)))
    return a.groupBy(F.expr(f"i div {size}").alias("bi"), F.expr(f"j div {size}").alias("bj")).agg(filled.alias("m")).select("bi", "bj", block.alias("block"))


def from_blocks(blocks: DataFrame, size: int) -> DataFrame:
    own = blocks.select("bi", "bj", F.posexplode("block").alias("at", "v")).where("v <> 0")
    return own.select((F.col("bi") * size + F.expr(f"at div {size}")).alias("i"), (F.col("bj") * size + F.col("at") % size).alias("j"), "v")


# --- vectors ---------------------------------------------------------------------------------------------------------------------------


def axpby(a: float, x: DataFrame, b: float, y: DataFrame) -> DataFrame:
    """a x + b y; an entry that one of them lacks is zero. Union and aggregate: no null handling, no skewed join."""
    return x.select("i", (F.col("v") * a).alias("v")).unionByName(y.select("i", (F.col("v") * b).alias("v"))).groupBy("i").agg(F.sum("v").alias("v"))


def update(a: float, x: DataFrame, b: float, y: DataFrame, g: float, z: DataFrame) -> DataFrame:
    return axpby(1, axpby(a, x, b, y), g, z)


def scal(a: float, x: DataFrame) -> DataFrame:
    return x.select("i", (F.col("v") * a).alias("v"))


def each(x: DataFrame, f) -> DataFrame:
    """An elementwise function: abs, reciprocal, fill (of a constant) and the like."""
    return x.select("i", f(F.col("v")).alias("v"))


def mult(g: float, y: DataFrame, a: float, x: DataFrame, z: DataFrame) -> DataFrame:
    """g y + a (x * z), entry by entry."""
    both = x.join(z.select("i", F.col("v").alias("zv")), "i").select("i", (F.col("v") * F.col("zv")).alias("v"))
    return axpby(g, y, a, both)


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.select("i", F.col("v").alias("yv")), "i").agg(F.sum(F.col("v") * F.col("yv")).alias("dot"))


def norms(x: DataFrame) -> DataFrame:
    """One row: nrm1, nrm2sq, nrminf, iamax (the first of the largest), total."""
    return x.agg(
        F.sum(F.abs("v")).alias("nrm1"), F.sum(F.col("v") * F.col("v")).alias("nrm2sq"), F.max(F.abs("v")).alias("nrminf"), F.expr("max_by(i, struct(abs(v), -i))").alias("iamax"), F.sum("v").alias("total")
    )


def nrm2w_squared(x: DataFrame, w: DataFrame) -> DataFrame:
    both = x.join(w.select("i", F.col("v").alias("wv")), "i")
    return both.agg(F.sum(F.pow(F.abs("v") / F.abs("wv"), 2)).alias("nrm2wsq"))


def permuted(x: DataFrame, perm: DataFrame) -> DataFrame:
    """out[p[i]] = x[i]; perm: i, p."""
    return x.join(perm, "i").select(F.col("p").alias("i"), "v")


def members(values: DataFrame, key: str, ident: str = "id") -> DataFrame:
    """The reverse map: (value, nr, id), the ids of each value numbered in order. No value's ids are gathered in one row or task."""
    return numbered_within(values.select(key, ident), key, ident, name="nr").select(key, "nr", ident)


def greatest_difference(x: DataFrame, y: DataFrame) -> DataFrame:
    both = x.select("i", F.col("v").cast("double").alias("v")).join(y.select("i", F.col("v").cast("double").alias("yv")), "i", "full")
    return both.agg(F.coalesce(F.max(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("yv", F.lit(0.0)))), F.lit(0.0)).alias("diff"))




def gemm(alpha: float, a: DataFrame, b: DataFrame, beta: float, c: DataFrame, trans_a: bool = False, trans_b: bool = False) -> DataFrame:
    return spadd(alpha, spgemm(transpose(a) if trans_a else a, transpose(b) if trans_b else b), beta, c)


def triangle(a: DataFrame, upper: bool = False, strict: bool = False) -> DataFrame:
    op = (">" if not upper else "<") + ("" if strict else "=")
    return a.where(f"i {op} j")


def trmm(alpha: float, a: DataFrame, b: DataFrame, upper: bool = False, right: bool = False) -> DataFrame:
    tri = triangle(a, upper)
    return spgemm(b, tri).withColumn("v", F.col("v") * alpha) if right else spgemm(tri, b).withColumn("v", F.col("v") * alpha)


# --- solvers ---------------------------------------------------------------------------------------------------------------------------


def gauss_seidel(a: DataFrame, b: DataFrame, x: DataFrame, colors: DataFrame, omega: float = 1.0, sweeps: int = 1, direction: str = "forward") -> DataFrame:
    """Coloured sweeps of x_i = (1 - omega) x_i + omega (b_i - sum of a_ij x_j, j <> i) / a_ii; colors: i, color (no two adjacent alike).

    One join and one aggregate for each colour; direction forward, backward or symmetric.
    """
    order = [r["color"] for r in colors.select("color").distinct().orderBy("color").collect()]  # a few
    order = {"forward": order, "backward": order[::-1], "symmetric": order + order[::-1]}[direction]
    off = a.where("i <> j").join(colors, "i")
    base = b.select("i", F.col("v").alias("b")).join(diagonal(a).select("i", F.col("v").alias("d")), "i").join(colors, "i")
    x = materialise(x.select("i", F.col("v").cast("double")), "sweep")
    for _ in range(sweeps):
        for color in order:
            sums = off.where(F.col("color") == color).join(x.select(F.col("i").alias("j"), F.col("v").alias("xv")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("xv")).alias("s"))
            new = base.where(F.col("color") == color).join(sums, "i", "left").select("i", ((F.col("b") - F.coalesce("s", F.lit(0.0))) / F.col("d")).alias("n"))
            x = materialise(x.join(new, "i", "left").select("i", F.when(F.col("n").isNull(), F.col("v")).otherwise((1 - omega) * F.col("v") + omega * F.col("n")).alias("v")), "sweep")
    return x


def two_stage_gauss_seidel(a: DataFrame, b: DataFrame, x: DataFrame, inner: int = 1, sweeps: int = 1, direction: str = "forward") -> DataFrame:
    """Sweeps x += z, where z solves (D + L) z = b - A x (backward: D + U) by `inner` Jacobi steps from z = r / D. No colours: each step is one join and one sum."""
    d = materialise(diagonal(a).select("i", F.col("v").alias("d")), "diagonal")
    x = materialise(b.select("i").join(x.select("i", F.col("v").cast("double")), "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v")), "sweep")
    for _ in range(sweeps):
        for upper in {"forward": (False,), "backward": (True,), "symmetric": (False, True)}[direction]:
            r = materialise(axpby(1.0, b, -1.0, spmv(a, x)), "residual")
            side = triangle(a, upper, strict=True)
            z = materialise(r.join(d, "i").select("i", (F.col("v") / F.col("d")).alias("v")), "inner")
            for _ in range(inner):
                new = axpby(1.0, r, -1.0, spmv(side, z)).join(d, "i").select("i", (F.col("v") / F.col("d")).alias("v"))
                z = materialise(new, "inner")
            x = materialise(axpby(1.0, x, 1.0, z), "sweep")
    return x


def spmv_stencil(x: DataFrame, shape: tuple[int, ...], stencil: dict[tuple[int, ...], float]) -> DataFrame:
    """y of a matrix that a stencil on a grid defines (row-major places, the last axis runs fastest): y at p is the sum of weight * x at p + offset,
    where that is on the grid. The matrix is never made: each entry of x goes to the places that its offsets name, one sum."""
    strides = [math.prod(shape[k + 1 :]) for k in range(len(shape))]
    moves = []
    for offset, weight in stencil.items():
        at = [F.floor(F.col("i") / s).cast("long") % n - o for s, n, o in zip(strides, shape, offset)]
        inside = functools.reduce(lambda p, q: p & q, [(c >= 0) & (c < n) for c, n in zip(at, shape)])
        place = functools.reduce(lambda p, q: p + q, [c * s for c, s in zip(at, strides)])
        moves.append(F.when(inside, F.struct(place.alias("i"), (F.col("v") * F.lit(weight)).alias("v"))))
    own = x.select(F.explode(F.array(*moves)).alias("m")).where("m is not null")
    return own.groupBy(F.col("m.i").alias("i")).agg(F.sum("m.v").alias("v"))


def level_sets(a: DataFrame, upper: bool = False, most_levels: int = 10_000) -> DataFrame:
    """i, lvl: rows of a triangular matrix by the longest chain of rows that they wait for."""
    need = triangle(a, upper, strict=True).select("i", "j")
    rows = a.select("i").unionByName(a.select(F.col("j").alias("i"))).distinct()
    state = materialise(rows.withColumn("lvl", F.lit(None).cast("long")), "levels")
    for level in range(most_levels):
        open_rows = state.where("lvl is null").select("i")
        if open_rows.isEmpty():
            return state
        blocked = need.join(open_rows.select(F.col("i").alias("j")), "j").select("i").distinct().withColumn("wait", F.lit(True))
        state = materialise(state.join(blocked, "i", "left").select("i", F.when(F.col("lvl").isNull() & F.col("wait").isNull(), F.lit(level)).otherwise(F.col("lvl")).alias("lvl")), "levels")
    raise RuntimeError("the matrix has a cycle or more levels than allowed")


def triangular_solve(a: DataFrame, b: DataFrame, upper: bool = False) -> DataFrame:
    """x of L x = b (or U x = b): one join and one aggregate for each level set."""
    levels = materialise(level_sets(a, upper), "levels")
    deepest = levels.agg(F.max("lvl")).first()[0]
    off, base = triangle(a, upper, strict=True), b.select("i", F.col("v").alias("b")).join(diagonal(a).select("i", F.col("v").alias("d")), "i").join(levels, "i")
    x = materialise(base.where("lvl = 0").select("i", (F.col("b") / F.col("d")).cast("double").alias("v")), "solved")
    for level in range(1, (deepest or 0) + 1):
        own = base.where(F.col("lvl") == level)
        sums = off.join(own.select("i"), "i").join(x.select(F.col("i").alias("j"), F.col("v").alias("xv")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("xv")).alias("s"))
        new = own.join(sums, "i", "left").select("i", ((F.col("b") - F.coalesce("s", F.lit(0.0))) / F.col("d")).alias("v"))
        x = materialise(x.unionByName(new), "solved")
    return x


def trsm(alpha: float, a: DataFrame, b: DataFrame, upper: bool = False) -> DataFrame:
    """X of A X = alpha B for a triangular A: (i, j, v), all columns at once, one join and one aggregate for each level set."""
    levels = materialise(level_sets(a, upper), "levels")
    deepest = levels.agg(F.max("lvl")).first()[0]
    off, d = triangle(a, upper, strict=True).select("i", F.col("j").alias("k"), F.col("v").alias("av")), diagonal(a).select("i", F.col("v").alias("d"))
    known = b.select("i", "j", (F.col("v") * alpha).cast("double").alias("b"))
    x = None
    for level in range((deepest or 0) + 1):
        own = levels.where(F.col("lvl") == level).select("i")
        rest = known.join(own, "i")
        if x is not None:
            rest = rest.unionByName(off.join(own, "i").join(x.select(F.col("i").alias("k"), "j", "v"), "k").select("i", "j", (-F.col("av") * F.col("v")).alias("b")))
        new = rest.groupBy("i", "j").agg(F.sum("b").alias("s")).join(d, "i").select("i", "j", (F.col("s") / F.col("d")).alias("v"))
        x = materialise(new if x is None else x.unionByName(new), "solved")
    return x


def trtri(a: DataFrame, upper: bool = False) -> DataFrame:
    """The inverse of a triangular matrix: (i, j, v), without entries that are zero by the pattern."""
    return trsm(1.0, a, diagonal(a).select("i", F.col("i").alias("j"), F.lit(1.0).alias("v")), upper)


def _dense(pdf: pd.DataFrame) -> np.ndarray:
    n = int(max(pdf["i"].max(), pdf["j"].max())) + 1
    out = np.zeros((n, n))
    out[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["v"].to_numpy()
    return out


def incomplete_lu(a: DataFrame, fill: int = 0, group: str = "g") -> DataFrame:
    """Factors of each group's matrix with fill level `fill`: g, part (L or U), i, j, v. A group's matrix is small by contract."""
    ship(a.sparkSession)

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _dense(pdf)
        n = len(m)
        level = np.where(m != 0, 0, 1 << 20)
        np.fill_diagonal(level, 0)
        for i in range(1, n):
            for k in range(i):
                if level[i, k] <= fill:
                    m[i, k] /= m[k, k]
                    through = level[i, k] + level[k, k + 1 :] + 1
                    level[i, k + 1 :] = np.minimum(level[i, k + 1 :], through)
                    m[i, k + 1 :] -= np.where(level[i, k + 1 :] <= fill, m[i, k] * m[k, k + 1 :], 0)
            m[i, level[i] > fill] = 0
        low, up = np.tril(m, -1) + np.eye(n), np.triu(m)
        rows = [(pdf[group].iloc[0], name, int(i), int(j), float(f[i, j])) for name, f in (("L", low), ("U", up)) for i, j in zip(*np.nonzero(f))]
        return pd.DataFrame(rows, columns=[group, "part", "i", "j", "v"])

    return a.groupBy(group).applyInPandas(factor, f"{group} long, part string, i long, j long, v double")
