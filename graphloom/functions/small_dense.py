"""Dense linear algebra on many small matrices, one in each row: arrays in row-major order, worked on in Arrow batches by stacked numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import ship

_ARRAY = "array<double>"


def _stack(s: pd.Series, *shape: int) -> np.ndarray:
    return np.stack(s.to_numpy()).reshape(len(s), *shape) if len(s) else np.zeros((0, *shape))


def _flat(a: np.ndarray) -> pd.Series:
    return pd.Series(list(a.reshape(len(a), -1)))


def batched(f: Callable[..., np.ndarray], *shapes: tuple[int, ...]) -> Callable[..., Column]:
    """A function of stacked matrices as a column function of arrays."""

    def run(*columns: pd.Series) -> pd.Series:
        return _flat(f(*(_stack(c, *s) for c, s in zip(columns, shapes))))

    if len(shapes) == 1:
        return F.pandas_udf(lambda a: run(a), _ARRAY, F.PandasUDFType.SCALAR)
    if len(shapes) == 2:
        return F.pandas_udf(lambda a, b: run(a, b), _ARRAY, F.PandasUDFType.SCALAR)
    return F.pandas_udf(lambda a, b, c: run(a, b, c), _ARRAY, F.PandasUDFType.SCALAR)


def gemm(m: int, k: int, n: int):
    return batched(np.matmul, (m, k), (k, n))


def gemv(m: int, n: int):
    return batched(lambda a, x: np.matmul(a, x), (m, n), (n, 1))


def lu_factors(a: np.ndarray) -> np.ndarray:
    """L (below, unit diagonal) and U of each matrix in one, without pivoting."""
    a = a.copy()
    for k in range(a.shape[1] - 1):
        a[:, k + 1 :, k] /= a[:, k, k][:, None]
        a[:, k + 1 :, k + 1 :] -= a[:, k + 1 :, k, None] * a[:, None, k, k + 1 :]
    return a


def lu(n: int):
    return batched(lu_factors, (n, n))


def _lower_upper(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.tril(f, -1) + np.eye(f.shape[1]), np.triu(f)


def solve_lu(n: int, columns: int = 1):
    def run(f: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, up = _lower_upper(f)
        return np.linalg.solve(up, np.linalg.solve(low, b))

    return batched(run, (n, n), (n, columns))


def inverse_lu(n: int):
    def run(f: np.ndarray) -> np.ndarray:
        low, up = _lower_upper(f)
        return np.linalg.inv(np.matmul(low, up))

    return batched(run, (n, n))


def solve(n: int, columns: int = 1):
    """gesv: A X = B with pivoting."""
    return batched(np.linalg.solve, (n, n), (n, columns))


def trsm(n: int, columns: int = 1, upper: bool = False):
    return batched(lambda a, b: np.linalg.solve(np.triu(a) if upper else np.tril(a), b), (n, n), (n, columns))


def trtri(n: int, upper: bool = False):
    return batched(lambda a: np.linalg.inv(np.triu(a) if upper else np.tril(a)), (n, n))


def householder(x: np.ndarray) -> np.ndarray:
    """Unit vectors v so that (I - 2 v v') x lies along the first axis."""
    v = x.reshape(len(x), -1).astype(float).copy()
    norm = np.linalg.norm(v, axis=1)
    v[:, 0] += np.where(v[:, 0] >= 0, norm, -norm)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def householder_vectors(n: int):
    return batched(householder, (n,))


def apply_householder(n: int, columns: int = 1):
    return batched(lambda v, a: a - 2 * v * np.matmul(np.swapaxes(v, 1, 2), a), (n, 1), (n, columns))


def eigenvalues(n: int):
    """Real and imaginary parts of each matrix's eigenvalues, sorted."""

    def run(a: np.ndarray) -> np.ndarray:
        e = np.sort_complex(np.linalg.eigvals(a))
        return np.concatenate([e.real, e.imag], axis=1)

    return batched(run, (n, n))


# What needs no matrix product stays in Spark's own expressions.


def filled(n: int, value: float) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def identity(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.when(k % (n + 1) == 0, 1.0).otherwise(0.0))


def scaled(a: Column, c: float) -> Column:
    return F.transform(a, lambda x: x * c)


def shifted_diagonal(a: Column, n: int, by: float) -> Column:
    return F.transform(a, lambda x, k: F.when(k % (n + 1) == 0, x + by).otherwise(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nrm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def axpby(a: float, x: Column, b: float, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: p * a + q * b)


def elementwise(x: Column, y: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Arithmetic, comparison, logic or mathematics lane by lane."""
    return F.zip_with(x, y, op)


def ready(df: DataFrame) -> DataFrame:
    """Sends the package to the executors before these functions run."""
    ship(df.sparkSession)
    return df
