"""Column functions over ``[start, end)`` intervals in media seconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def overlaps(start_a, end_a, start_b, end_b) -> Column:
    """Strict overlap: touching intervals do not count."""
    return (_c(end_a) > _c(start_b)) & (_c(start_a) < _c(end_b))


def intersection_s(start_a, end_a, start_b, end_b) -> Column:
    return F.greatest(
        F.lit(0.0), F.least(_c(end_a), _c(end_b)) - F.greatest(_c(start_a), _c(start_b))
    )


def interval_iou(start_a, end_a, start_b, end_b) -> Column:
    """Intersection over the hull of both intervals, 0 for an empty hull."""
    hull = F.greatest(_c(end_a), _c(end_b)) - F.least(_c(start_a), _c(start_b))
    return F.when(
        hull > 0, intersection_s(start_a, end_a, start_b, end_b) / hull
    ).otherwise(F.lit(0.0))


def boundary_error(start_a, end_a, start_b, end_b) -> Column:
    return (F.abs(_c(start_a) - _c(start_b)) + F.abs(_c(end_a) - _c(end_b))) / 2


def normalized_boundary_error(start_a, end_a, start_b, end_b, duration) -> Column:
    """Boundary error as a share of the duration; null unless it is positive."""
    return F.when(
        _c(duration) > 0, boundary_error(start_a, end_a, start_b, end_b) / _c(duration)
    )


def clamp(value, low, high) -> Column:
    return F.greatest(_c(low), F.least(_c(value), _c(high)))


def context_start(start, padding=2.0) -> Column:
    return F.greatest(F.lit(0.0), _c(start) - _c(padding))


def context_end(start, end, duration, padding=2.0) -> Column:
    padded = F.least(_c(duration), _c(end) + _c(padding))
    return F.greatest(context_start(start, padding), padded)


def window_timestamps(start, end, count) -> Column:
    """``count`` centre timestamps of an interval, rounded to microseconds."""
    n = _c(count).cast("int")
    step = (_c(end) - _c(start)) / n
    return F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.round(_c(start) + (i + F.lit(0.5)) * step, 6)
    )
