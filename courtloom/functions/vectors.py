"""Embedding arithmetic on array<double> columns with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-8))


def l2_normalise(a: Column) -> Column:
    """The norm is bound once; named inside the inner lambda it would be computed again for each component."""
    n = norm(a) + F.lit(1e-8)
    return F.transform(F.array(n), lambda m: F.transform(a, lambda x: x / m))[0]
