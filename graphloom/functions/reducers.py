"""Named reductions: each is one aggregate with partial and final steps, so any of them can share one pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reducers(value: str, ident: str) -> dict[str, Column]:
    """Sum, product (of signs), extremes with and without places, logical and bitwise ones. Ties go to the smaller id."""
    v, i = F.col(value), F.col(ident)
    return {
        "total": F.sum(v), "least": F.min(v), "most": F.max(v), "least_at": F.min(F.struct(v, i))[ident], "most_at": F.max(F.struct(v, (-i).alias("at")))["at"] * -1,
        "sign": F.product(F.signum(v.cast("double"))), "all_positive": F.bool_and(v > 0), "any_odd": F.bool_or(v % 2 == 1), "band": F.bit_and(v), "bor": F.bit_or(v),
    }
