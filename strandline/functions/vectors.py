"""Vector and progress arithmetic as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; NULL if either vector is."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL if a vector is missing or has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def progress_bin(position: Column, length: Column, bins: int = 20) -> Column:
    """Bin 1..bins of a relative position, halves rounded to even."""
    return F.greatest(F.lit(1), F.least(F.lit(bins), F.rint(position / length * bins))).cast("int")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
