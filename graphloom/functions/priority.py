"""Deterministic stand-ins for random choices: hash priorities that any SQL engine can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SALT = "42"


def priority(ident: Column | str, salt: str = SALT) -> Column:
    """md5 of the id and a salt; compared as text, with the id as the last tie-break."""
    own = F.col(ident) if isinstance(ident, str) else ident
    return F.md5(F.concat(own.cast("string"), F.lit(f"-{salt}")))


def edge_priority(a: Column | str, b: Column | str, salt: str = SALT) -> Column:
    """The same for both directions of an edge."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.md5(F.concat_ws("-", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"), F.lit(salt)))


def unit_double(ident: Column | str, salt: str = SALT) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of the priority."""
    return F.conv(F.substring(priority(ident, salt), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
