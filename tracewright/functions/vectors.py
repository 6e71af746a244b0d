"""Dense vectors as ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def normalize(a: Column) -> Column:
    """Unit length; a vector of nearly no length stays as it is."""
    n = l2(a)
    return F.transform(a, lambda x: x / F.when(n < 1e-8, F.lit(1.0)).otherwise(n))
