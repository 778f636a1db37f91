"""Column functions over ``array<float|double>`` vectors, in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NORM_FLOOR = 1e-8


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(as_double(vector), F.lit(0.0), lambda acc, x: acc + x * x)
    )


def l2_normalize(vector: Column, length: Column | None = None) -> Column:
    """``v / max(|v|, 1e-8)``; pass a precomputed length to avoid repeating it."""
    size = F.greatest(norm(vector) if length is None else length, F.lit(NORM_FLOOR))
    return F.transform(as_double(vector), lambda x: x / size)


def all_finite(vector: Column) -> Column:
    return F.forall(
        as_double(vector),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
