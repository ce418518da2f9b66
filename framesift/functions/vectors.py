"""Column builders over float vectors; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_TOLERANCE = 2e-5  # absolute plus relative 1e-5 at norm 1
EPSILON_NORM = 1e-6


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    n = norm(v)
    return F.transform(as_double(v), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def finite(v: Column) -> Column:
    return F.forall(as_double(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def is_valid(v: Column, dimension: int, allow_zero: bool = True) -> Column:
    """Right length, finite, and of norm 1 (or 0 where allowed)."""
    unit = F.abs(norm(v) - 1) <= NORM_TOLERANCE
    return F.coalesce((F.size(v) == dimension) & finite(v) & ((norm(v) == 0) | unit if allow_zero else unit), F.lit(False))


def zero_at_index(v: Column) -> Column:
    return norm(v) == 0


def zero_at_evaluation(v: Column) -> Column:
    return norm(v) < EPSILON_NORM


def zero_at_query(v: Column) -> Column:
    return ~F.exists(as_double(v), lambda x: x != 0)
