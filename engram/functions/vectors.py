"""Vector expressions: all in double, all within the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Similarity; null for a null or zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def relevance(similarity: Column, quality: Column, importance: Column, created_at: Column, as_of: str) -> Column:
    """.65 similarity + .15 quality + .10 importance + .10 freshness, whose half-life is about 180 days."""
    age = (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(created_at)) / 86400.0
    return 0.65 * similarity + 0.15 * F.coalesce(quality, F.lit(0.5)) + 0.10 * F.coalesce(importance, F.lit(0.5)) + 0.10 * F.exp(-0.00385 * age)
