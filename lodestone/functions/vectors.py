"""Vector functions on array<double> columns; rules for empty, unequal and zero vectors are part of each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 where the lengths differ."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))).otherwise(0.0)


def magnitude(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for different lengths, empty or zero vectors."""
    n = magnitude(a) * magnitude(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot(a, b) / F.nullif(n, F.lit(0.0))).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    """Distance; the largest double where the lengths differ."""
    d = F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(1.7976931348623157e308))


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    m = magnitude(a)
    return F.when(m > 0, F.transform(a, lambda x: x.cast("double") / m)).otherwise(F.transform(a, lambda x: x.cast("double")))


def add(a: Column, b: Column) -> Column:
    """Sum; null where the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double")))


def scale(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x.cast("double") * F.lit(float(k)))
