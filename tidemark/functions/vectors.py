"""Vector expressions on ``array<double>`` columns, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    """Doubles before any arithmetic: sums in single precision drift."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; arrays of different sizes are an error, as ``zip_with`` would pad with null."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in size")).cast("double")).otherwise(total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector is similar to nothing: 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.when(F.size(a) == F.size(b), 0.0)).otherwise(dot(a, b) / size)


def cosine_distance(a: Column, b: Column, digits: int = 6) -> Column:
    """1 - cosine, rounded, never negative zero: ranks must not hang on the last bits of a sum."""
    return F.round(1 - cosine(a, b), digits) + F.lit(0.0)


def unit(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays."""
    size = norm(a)
    return F.when(size == 0, a).otherwise(F.transform(a, lambda x: x / size))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])
