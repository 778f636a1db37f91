"""Training targets of windows and decoding of model outputs to intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidex.functions.intervals import clamp, intersection_s
from evidex.operators.joins import grown


def action_targets(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """Multi-hot vector per window over the sorted distinct ``labels.action_id``.

    The vocabulary is one row: a set of label names, whatever the data size.
    """
    vocabulary = labels.filter(F.coalesce("action_id", F.lit("")) != "").agg(
        F.array_sort(F.collect_set("action_id"))
    )
    ids = F.transform("actions", lambda a: a["action_id"])
    return windows.withColumn("vocabulary", vocabulary.scalar()).withColumn(
        "action_targets",
        F.transform("vocabulary", lambda v: F.when(F.array_contains(ids, v), 1.0).otherwise(0.0)),
    )


def boundary_targets(windows: DataFrame, overlapping: DataFrame) -> DataFrame:
    """The action with the largest positive overlap (the earliest on a tie) as
    clamped fractions of the window; ``has_target`` is the mask."""
    overlap = intersection_s("start_s", "end_s", "window_start_s", "window_end_s")
    chosen = (
        overlapping.withColumn("_overlap", overlap)
        .filter(F.col("_overlap") > 0)
        .groupBy("window_id")
        .agg(
            F.max_by(
                F.struct(F.col("start_s").alias("action_start_s"), F.col("end_s").alias("action_end_s"), "action_id"),
                F.struct("_overlap", (-F.col("pos")).alias("_p")),
            ).alias("_a")
        )
        .select("window_id", "_a.*")
    )
    length = F.greatest(F.col("end_s") - F.col("start_s"), F.lit(1e-6))
    share = lambda t: clamp((t - F.col("start_s")) / length, F.lit(0.0), F.lit(1.0))
    return grown(windows).join(chosen, "window_id", "left").select(
        *windows.columns,
        "action_id", "action_start_s", "action_end_s",
        F.coalesce(share(F.col("action_start_s")), F.lit(0.0)).alias("boundary_start"),
        F.coalesce(share(F.col("action_end_s")), F.lit(0.0)).alias("boundary_end"),
        F.col("action_start_s").isNotNull().alias("has_target"),
    )


def frame_targets(targets: DataFrame) -> DataFrame:
    """Per frame time of the chosen action: inside it, nearest to its start, nearest
    to its end (the first of equals)."""

    def nearest(point: Column) -> Column:
        gaps = F.transform("timestamps_s", lambda t: F.abs(t - point))
        return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")

    inside = F.transform(
        "timestamps_s",
        lambda t: F.coalesce(((t >= F.col("action_start_s")) & (t <= F.col("action_end_s"))).cast("int"), F.lit(0)),
    )
    return (
        targets.withColumn("inside", inside)
        .withColumn("start_frame", nearest(F.col("action_start_s")))
        .withColumn("end_frame", nearest(F.col("action_end_s")))
    )


def decode_boundaries(windows: DataFrame, names: Column | None = None) -> DataFrame:
    """Boundary scores to absolute seconds; label scores to a map.

    Reads ``start_s, end_s, boundary array<double>`` and, with ``names``, ``action_scores``.
    """
    length = F.col("end_s") - F.col("start_s")
    at = lambda i: F.round(F.col("start_s") + F.element_at("boundary", i) * length, 4)
    decoded = windows.withColumn("predicted_start_s", at(1)).withColumn("predicted_end_s", at(2))
    if names is None:
        return decoded
    rounded = F.transform("action_scores", lambda s: F.round(s, 5))
    return decoded.withColumn("predicted_action_scores", F.map_from_arrays(names, rounded))


def decode_refinement(windows: DataFrame) -> DataFrame:
    """Frame scores to refined seconds: times weighted by score and relevance, kept
    inside the window; an empty interval falls back to the boundary decoding.

    Reads ``timestamps_s, relevance, start_scores, end_scores`` of equal length and
    the columns of :func:`decode_boundaries`.
    """
    weighted = lambda name: F.zip_with(name, "relevance", lambda s, r: s * (F.lit(0.25) + F.lit(0.75) * r))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)

    def centre(name: str) -> Column:
        moment = total(F.zip_with("timestamps_s", name, lambda t, w: t * w))
        return clamp(moment / F.greatest(total(F.col(name)), F.lit(1e-8)), F.col("start_s"), F.col("end_s"))

    larger = lambda x, y: F.greatest(x, y)
    peak = total(F.zip_with(F.zip_with("relevance", "_s", larger), "_e", larger))
    empty = F.col("_to") <= F.col("_from")
    return (
        windows.withColumn("_s", weighted("start_scores"))
        .withColumn("_e", weighted("end_scores"))
        .withColumn("_from", centre("_s"))
        .withColumn("_to", centre("_e"))
        .withColumn("refined_start_s", F.round(F.when(empty, F.col("predicted_start_s")).otherwise(F.col("_from")), 4))
        .withColumn("refined_end_s", F.round(F.when(empty, F.col("predicted_end_s")).otherwise(F.col("_to")), 4))
        .withColumn("refinement_confidence", F.round(peak / F.size("timestamps_s"), 5))
        .drop("_s", "_e", "_from", "_to")
    )
