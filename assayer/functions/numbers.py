"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """`x` as a double, with NaN and infinities made null; missing scores are null everywhere else."""
    x = x.cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def rounded(x: Column, digits: int = 9) -> Column:
    """A double that two engines agree on: the last digits of sums depend on their order. No negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def draw(n: Column, *parts: Column) -> Column:
    """A reproducible pick from 0 to n - 1: the first 8 hex digits of the MD5 of the parts joined by colons, modulo n."""
    key = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), n.cast("long"))
