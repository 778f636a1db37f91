"""Running aggregates whose key may hold any share of the rows.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task.  Here each key
is cut into consecutive buckets of the ordering column: buckets are reduced in
parallel, only one row per bucket meets in the key-wide window, and its carry is
joined back to the rows of the bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidex.operators.joins import grown

_FUNCTIONS = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Running:
    """``name`` = ``how`` of ``value`` over the rows up to (or before) each row."""

    name: str
    how: str
    value: Column
    inclusive: bool = True


def _combine(how: str, carry: Column, local: Column) -> Column:
    if how == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    return (F.greatest if how == "max" else F.least)(carry, local)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column,
    scans: list[Running],
    reverse: bool = False,
) -> DataFrame:
    """Add running aggregates; ``bucket`` must never fall along ``order``
    (never rise when ``reverse``)."""
    rows = df.withColumn("_bucket", bucket.cast("long"))
    parts = [*keys, "_bucket"]
    totals = rows.groupBy(*parts).agg(
        *[_FUNCTIONS[s.how](s.value).alias(f"_t{i}") for i, s in enumerate(scans)]
    )
    direction = F.col("_bucket").desc() if reverse else F.col("_bucket").asc()
    before = (
        Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = totals.select(
        *parts,
        *[_FUNCTIONS[s.how](f"_t{i}").over(before).alias(f"_c{i}") for i, s in enumerate(scans)],
    )
    inside = Window.partitionBy(*parts).orderBy(*order)
    joined = grown(rows).join(grown(carries), parts)
    for i, s in enumerate(scans):
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
        local = _FUNCTIONS[s.how](s.value).over(frame)
        joined = joined.withColumn(s.name, _combine(s.how, F.col(f"_c{i}"), local))
    return grown(joined.drop("_bucket", *[f"_c{i}" for i in range(len(scans))]))


def islands(
    df: DataFrame, keys: list[str], start: str, end: str, order: list[Column], gap: float, width: float
) -> DataFrame:
    """Number the groups of intervals that start at most ``gap`` after the
    furthest end seen so far (column ``island``, counted from 1 per key)."""
    bucket = F.floor(F.col(start) / width)
    reach = running(
        df, keys, order, bucket, [Running("_reach", "max", F.col(end), inclusive=False)]
    )
    opens = F.when(
        F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap), 1
    ).otherwise(0)
    marked = reach.withColumn("_opens", opens)
    return running(
        marked, keys, order, bucket, [Running("island", "sum", F.col("_opens"))]
    ).drop("_reach", "_opens")


def ordinal(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "ordinal") -> DataFrame:
    """0-based position of each row within its key."""
    counted = running(
        df, keys, order, bucket, [Running(name, "sum", F.lit(1).cast("long"), inclusive=False)]
    )
    return counted
