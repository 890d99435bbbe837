"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def pairs(n: Column) -> Column:
    """n choose 2."""
    return (n * (n - 1) / 2).cast("long")


def scrubbed(x: Column) -> Column:
    """Null for what is not finite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
