"""Post-processing of ranked rows: diversity, events, moments, places.

The folds read at most the over-fetched rows of one query, so they run as array
expressions inside the JVM rather than in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidex.functions.intervals import clamp, context_end, context_start, interval_iou
from evidex.session import cut_lineage

MAX_PER_VIDEO, OVERLAP = 2, 0.25
SEARCH_CANDIDATES, SEARCH_K = 100, 10
MIN_STEPS_APART = 20
MAX_MOMENT_TIMES = 32


def _empty(items: Column) -> Column:
    return F.filter(items, lambda _: F.lit(False))


def _same_video(a: Column, b: Column) -> Column:
    return a["video_id"] == b["video_id"]


def _iou(a: Column, b: Column) -> Column:
    return interval_iou(a["start_s"], a["end_s"], b["start_s"], b["end_s"])


def diversify_by_interval(
    ranked: DataFrame, k: int, max_per_video: int = MAX_PER_VIDEO, overlap: float = OVERLAP
) -> DataFrame:
    """In rank order keep a row unless its recording already has enough rows or
    one that overlaps it; then the first ``k``.  ``rank`` is renumbered."""
    columns = ranked.columns
    items = F.sort_array(F.collect_list(F.struct("rank", *[c for c in columns if c not in ("rank", "query_id")])))
    grouped = ranked.groupBy("query_id").agg(items.alias("_items"))

    def step(kept: Column, row: Column) -> Column:
        mine = F.filter(kept, lambda o: _same_video(o, row))
        clash = F.exists(mine, lambda o: _iou(row, o) >= overlap)
        return F.when((F.size(mine) >= max_per_video) | clash, kept).otherwise(F.concat(kept, F.array(row)))

    kept = F.slice(F.aggregate("_items", _empty(F.col("_items")), step), 1, k)
    return grouped.select("query_id", F.posexplode(kept).alias("_i", "_r")).select(
        *[F.col("query_id") if c == "query_id" else (F.col("_i") + 1).alias("rank") if c == "rank" else F.col(f"_r.{c}").alias(c) for c in columns]
    )


def merge_events(ranked: DataFrame, k: int = 3, overlap: float = OVERLAP) -> DataFrame:
    """Ranked windows to distinct events of a recording.

    ``ranked``: ``query_id, rank, window_id, video_id, start_s, end_s,
    predicted_start_s, predicted_end_s, score, actions, objects``.  A window joins
    the first event it overlaps by ``overlap`` or shares an action id with.
    """
    predicted = F.coalesce(F.col("predicted_end_s") > F.col("predicted_start_s"), F.lit(False))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("actions", lambda a: a["action_id"]), lambda x: x.isNotNull())))
    event = F.struct(
        F.col("rank").alias("first_rank"),
        F.col("video_id"),
        F.when(predicted, F.col("predicted_start_s")).otherwise(F.col("start_s")).alias("start_s"),
        F.when(predicted, F.col("predicted_end_s")).otherwise(F.col("end_s")).alias("end_s"),
        F.col("start_s").alias("context_start_s"),
        F.col("end_s").alias("context_end_s"),
        F.col("score"),
        F.array("window_id").alias("evidence_window_ids"),
        ids.alias("action_ids"),
        F.col("actions"),
        F.array_sort(F.array_distinct("objects")).alias("objects"),
        F.col("window_id").alias("anchor_window_id"),
        F.col("predicted_start_s"),
        F.col("predicted_end_s"),
    )
    names = [
        "first_rank", "video_id", "start_s", "end_s", "context_start_s", "context_end_s", "score",
        "evidence_window_ids", "action_ids", "actions", "objects", "anchor_window_id",
        "predicted_start_s", "predicted_end_s",
    ]
    grouped = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(event)).alias("_items"))
    same_action = lambda a, b: (a["action_id"] == b["action_id"]) & (a["name"] == b["name"])

    def merged(g: Column, e: Column) -> Column:
        fresh = F.filter(
            e["actions"],
            lambda a, i: ~F.exists(g["actions"], lambda b: same_action(a, b))
            & ~F.exists(F.slice(e["actions"], F.lit(1), i), lambda b: same_action(a, b)),
        )
        made = {
            "start_s": F.least(g["start_s"], e["start_s"]),
            "end_s": F.greatest(g["end_s"], e["end_s"]),
            "context_start_s": F.least(g["context_start_s"], e["context_start_s"]),
            "context_end_s": F.greatest(g["context_end_s"], e["context_end_s"]),
            "score": F.greatest(g["score"], e["score"]),
            "evidence_window_ids": F.array_union(g["evidence_window_ids"], e["evidence_window_ids"]),
            "action_ids": F.array_union(g["action_ids"], e["action_ids"]),
            "actions": F.concat(g["actions"], fresh),
            "objects": F.array_sort(F.array_union(g["objects"], e["objects"])),
        }
        return F.struct(*[made.get(n, g[n]).alias(n) for n in names])

    def step(events: Column, e: Column) -> Column:
        matches = F.transform(
            events,
            lambda g: _same_video(g, e)
            & ((_iou(e, g) >= overlap) | F.arrays_overlap(g["action_ids"], e["action_ids"])),
        )
        place = F.array_position(matches, F.lit(True))
        return F.when(place == 0, F.concat(events, F.array(e))).otherwise(
            F.transform(events, lambda g, i: F.when(i + 1 == place, merged(g, e)).otherwise(g))
        )

    folded = grouped.select(
        "query_id", F.explode(F.aggregate("_items", _empty(F.col("_items")), step)).alias("e")
    ).select("query_id", "e.*")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("first_rank"))
    return (
        folded.withColumn("event_id", F.format_string("%s:%.3f-%.3f", "video_id", "start_s", "end_s"))
        .withColumn("event_rank", F.row_number().over(order))
        .filter(F.col("event_rank") <= k)
    )


def merge_moments(ranked: DataFrame, adjacency_s: float = 0.25) -> DataFrame:
    """Overlapping or adjacent retrieved windows of a query to one moment.

    Works on the retrieved rows only, so a query's rows are at most its ``k``.
    """
    order = Window.partitionBy("query_id").orderBy("start_s", F.col("score").desc(), "rank")
    reach = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = (
        ranked.withColumn("_reach", reach)
        .withColumn("_place", F.row_number().over(order))
        .withColumn("_opens", F.when(F.col("_reach").isNull() | (F.col("start_s") > F.col("_reach") + adjacency_s), 1).otherwise(0))
        .withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    best = F.struct(F.col("score"), (-F.col("_place")).alias("p"))
    moments = placed.groupBy("query_id", "video_id", "_island").agg(
        F.min("start_s").alias("start_s"),
        F.max("end_s").alias("end_s"),
        F.min("context_start_s").alias("context_start_s"),
        F.max("context_end_s").alias("context_end_s"),
        F.max("score").alias("score"),
        F.max_by("window_id", best).alias("window_id"),
        F.max_by("start_s", best).alias("retrieved_start_s"),
        F.max_by("end_s", best).alias("retrieved_end_s"),
        F.count("*").alias("window_count"),
        F.transform(F.sort_array(F.collect_list(F.struct("_place", "window_id"))), lambda r: r["window_id"]).alias("evidence_window_ids"),
        F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("frame_timestamps_s")), lambda t: F.round(t, 3)))).alias("_times"),
    )
    last = F.size("_times") - 1
    picked = F.transform(
        F.sequence(F.lit(0), F.lit(MAX_MOMENT_TIMES - 1)),
        lambda i: F.element_at("_times", (F.floor(i * last / (MAX_MOMENT_TIMES - 1)) + 1).cast("int")),
    )
    times = F.when(F.size("_times") > MAX_MOMENT_TIMES, picked).otherwise(F.col("_times"))
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "_island")
    return (
        moments.withColumn("frame_timestamps_s", times)
        .withColumn("moment_rank", F.row_number().over(by_score))
        .drop("_times", "_island")
    )


def diversify_by_sequence(ranked: DataFrame, limit: int = SEARCH_K) -> DataFrame:
    """From a query's candidates: first views of two well separated steps per
    sequence, then any second view, then the rest; each row gets its kind."""
    by_rank = Window.partitionBy("query_id", "sequence_id").orderBy("rank")
    whole = Window.partitionBy("query_id", "sequence_id")
    tagged = (
        ranked.filter(F.col("rank") <= SEARCH_CANDIDATES)
        .withColumn("_place", F.row_number().over(by_rank))
        .withColumn("_first", F.first("step").over(by_rank))
        .withColumn("_apart", F.coalesce(F.abs(F.col("step") - F.col("_first")) >= MIN_STEPS_APART, F.lit(True)))
        .withColumn("_far", F.when((F.col("_place") > 1) & F.col("_apart"), F.col("rank")))
        .withColumn("_second", F.min("_far").over(whole))
    )
    first_pass = (F.col("_place") == 1) | F.coalesce(F.col("rank") == F.col("_second"), F.lit(False))
    relaxed = F.col("_second").isNull() & (F.col("_place") == 2)
    tagged = tagged.withColumn("pass", F.when(first_pass, 1).when(relaxed, 2).otherwise(3))
    chosen = Window.partitionBy("query_id").orderBy("pass", "rank")
    top = tagged.withColumn("display_rank", F.row_number().over(chosen)).filter(F.col("display_rank") <= limit)
    lead = F.first("sequence_id").over(chosen)
    kind = (
        F.when(F.col("display_rank") == 1, "best visual match")
        .when(F.col("sequence_id") != F.col("_lead"), "same area, another traversal")
        .when(F.col("pass") == 1, "related office view")
        .otherwise("additional view")
    )
    return top.withColumn("_lead", lead).withColumn("kind", kind).drop("_lead", "_place", "_first", "_apart", "_far", "_second")


def majority_zone(evidence: DataFrame) -> DataFrame:
    """Most frequent zone of a query's evidence ``(query_id, rank, zone)``; on a
    tie the one met first."""
    counts = evidence.filter(F.col("zone").isNotNull()).groupBy("query_id", "zone").agg(
        F.count("*").alias("support_count"), F.min("rank").alias("_first")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("support_count").desc(), "_first")
    top = Window.partitionBy("query_id")
    ranked = (
        counts.withColumn("_max", F.max("support_count").over(top))
        .withColumn("_winners", F.sum((F.col("support_count") == F.col("_max")).cast("int")).over(top))
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") == 1)
    )
    strength = (
        F.when(F.col("support_count") >= 7, "strong")
        .when((F.col("support_count") >= 4) & (F.col("_winners") == 1), "moderate")
        .otherwise("mixed")
    )
    return ranked.select("query_id", "zone", "support_count", strength.alias("strength"))


def diverse_search(queries: DataFrame, memory: DataFrame, display_k: int = SEARCH_K, exclude_self: bool = False) -> DataFrame:
    """Candidates, diversified views and the likely place of each query.

    ``memory`` carries ``sequence_id, step, zone`` beside ``ord, vector``.
    """
    from evidex.operators.search import cosine_topk

    if display_k not in (3, 5, 10):
        raise ValueError("display_k must be 3, 5 or 10")
    found = cosine_topk(queries, memory, SEARCH_CANDIDATES, exclude_self=exclude_self)
    shown = cut_lineage(diversify_by_sequence(found), "shown")  # ten rows per query, read twice
    place = majority_zone(shown.select("query_id", F.col("display_rank").alias("rank"), "zone"))
    place = place.select(
        "query_id", F.col("zone").alias("likely_zone"), F.col("support_count").alias("likely_support"),
        F.col("strength").alias("likely_strength"),
    )
    return shown.filter(F.col("display_rank") <= display_k).join(place, "query_id", "left")


def present_events(events: DataFrame, matched: DataFrame, durations: DataFrame) -> DataFrame:
    """Primary action, context actions and the three intervals of each event.

    ``matched``: ``query_id, matched_actions``; ``durations``: ``video_id, duration_s``.
    """
    named = F.filter("actions", lambda a: F.trim(F.coalesce(a["name"], F.lit(""))) != "")
    rows = (
        events.join(matched, "query_id", "left")
        .withColumn("_wanted", F.coalesce("matched_actions", F.array().cast("array<string>")))
        .join(durations, "video_id")
        .withColumn("_named", named)
        .withColumn("_hit", F.filter("_named", lambda a: F.array_contains(F.col("_wanted"), a["name"])))
        .withColumn("_primary", F.coalesce(F.get("_hit", F.lit(0)), F.get("_named", F.lit(0))))
    )
    name = F.coalesce(F.col("_primary.name"), F.get("_wanted", F.lit(0)), F.lit("Relevant event"))
    length = F.col("duration_s")
    noted_start = clamp(F.coalesce(F.col("_primary.start_s"), F.col("start_s")), F.lit(0.0), length)
    noted_end = F.greatest(F.col("annotation_start_s"), F.least(F.coalesce(F.col("_primary.end_s"), F.col("end_s")), length))
    refined = F.col("predicted_start_s").isNotNull() & F.col("predicted_end_s").isNotNull()
    rows = (
        rows.withColumn("primary_action", name)
        .withColumn(
            "context_actions",
            F.array_distinct(F.filter(F.transform("_named", lambda a: a["name"]), lambda n: n != F.col("primary_action"))),
        )
        .withColumn("annotation_start_s", noted_start)
        .withColumn("annotation_end_s", noted_end)
        .withColumn("interval_source", F.when(refined, "temporal_refinement").otherwise("dataset_annotation"))
        .withColumn("evidence_start_s", F.col("context_start_s"))
        .withColumn("evidence_end_s", F.col("context_end_s"))
        .withColumn("action_start_s", clamp(F.when(refined, F.col("predicted_start_s")).otherwise(F.col("annotation_start_s")), F.lit(0.0), length))
        .withColumn("action_end_s", F.greatest(F.col("action_start_s"), F.least(F.when(refined, F.col("predicted_end_s")).otherwise(F.col("annotation_end_s")), length)))
        .withColumn("context_start_s", context_start("action_start_s"))
        .withColumn("context_end_s", context_end("action_start_s", "action_end_s", "duration_s"))
    )
    return rows.drop("_named", "_hit", "_primary", "_wanted")
