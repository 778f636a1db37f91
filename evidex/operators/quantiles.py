"""Exact quantiles without holding a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidex.operators.scan import Running, running
from evidex.session import cut_lineage


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], width: float) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per key (columns named by ``probs``).

    Equal values are counted first (with map-side combine), so a value that most rows share is one
    row.  Distinct values are then summed up bucket by bucket of size ``width``; each knows the
    places it covers, and only those that cover a wanted place travel on.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if not keys:
        known, keys = known.withColumn("_all", F.lit(0)), ["_all"]
    counts = cut_lineage(known.groupBy(*keys, "_v").agg(F.count("*").alias("_c")), "values")
    ends = running(counts, keys, [F.col("_v")], F.floor(F.col("_v") / width), [Running("_end", "sum", F.col("_c"))])
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    placed = ends.join(sizes, keys)

    def covers(place):
        return (F.col("_end") - F.col("_c") <= place) & (place < F.col("_end"))

    spots = {name: F.lit(p) * (F.col("_n") - 1) for name, p in probs.items()}
    wanted = F.lit(False)
    picks = []
    for name, spot in spots.items():
        low, high = covers(F.floor(spot)), covers(F.ceil(spot))
        wanted = wanted | low | high
        picks.append(F.max(F.when(low, F.col("_v"))).alias(f"_lo_{name}"))
        picks.append(F.max(F.when(high, F.col("_v"))).alias(f"_hi_{name}"))
        picks.append(F.max(spot - F.floor(spot)).alias(f"_at_{name}"))
    picked = placed.filter(wanted).groupBy(*keys).agg(*picks)
    made = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_at_{n}")).alias(n) for n in probs
    ]
    return picked.select(*[k for k in keys if k != "_all"], *made)
