"""Dense vector functions on array columns, evaluated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    """One minus the cosine distance; null when either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalize_vector(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = norm(v)
    scaled = F.zip_with(
        v, F.array_repeat(size, F.size(v)), lambda x, s: F.try_divide(x.cast("double"), s)
    )
    return F.when(size == 0, v.cast("array<double>")).otherwise(scaled)


def valid_embedding(v: Column, dim: int) -> Column:
    """Present and of the expected dimension (a failed embedding is empty)."""
    return F.coalesce(F.size(v) == dim, F.lit(False))
