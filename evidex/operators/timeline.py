"""Catalogues, timelines and answers over annotated windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidex.functions.text import PROMPT_STOPWORDS, WORD_EDGES, LABEL_EDGES, strings, strip_edges
from evidex.operators.joins import grown, interval_join
from evidex.operators.scan import Running, islands, ordinal, running
from evidex.session import cut_lineage

TIMELINE_GAP_S = 0.5
BUCKET_S = 256.0
# Texts that clients show.
LOCAL_DESCRIPTION = "Local video; annotations are not available."
ANSWER_PREFIX = "The selected evidence contains: "
EVENT_CONFIDENCE = "dataset annotation"
EVENT_LIMITATION = "The action interval is an annotation reference, not a VLM judgment."
NO_ANSWER = "The selected evidence does not contain an annotated action that answers this question."


def enrich_from_manifest(windows: DataFrame, manifest: DataFrame, fields: list[str]) -> DataFrame:
    """Fill null or empty recording-level fields of windows from the manifest."""
    source = manifest.select("video_id", *[F.col(f).alias(f"_m_{f}") for f in fields])
    joined = windows.join(source, "video_id", "left")
    for field in fields:
        kind = joined.schema[field].dataType.typeName()
        value = F.col(field)
        empty = F.size(value) == 0 if kind == "array" else value == 0 if kind in ("double", "long", "integer") else value == ""
        fill = F.when(value.isNull() | empty, F.coalesce(F.col(f"_m_{field}"), value)).otherwise(value)
        joined = joined.withColumn(field, fill)
    return joined.drop(*[f"_m_{f}" for f in fields])


def video_actions(actions: DataFrame) -> DataFrame:
    """Distinct named actions per recording."""
    named = F.trim(F.coalesce("name", F.lit(""))) != ""
    return actions.filter(named).select("video_id", "action_id", "name", "start_s", "end_s").distinct()


def video_catalog(windows: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per recording; ``ord`` is the source order of the windows."""

    def first_filled(name: str) -> Column:
        filled = F.col(name) != ""
        return F.coalesce(F.min_by(F.when(filled, F.col(name)), F.when(filled, F.col("ord"))), F.lit(""))

    seen = windows.groupBy("video_id").agg(
        F.greatest(F.max(F.coalesce("duration_s", "end_s")), F.lit(0.0)).alias("duration_s"),
        F.min_by("description", "ord").alias("description"),
        *[first_filled(n).alias(n) for n in ("script", "scene", "subject")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("objects")))).alias("objects"),
    )
    known = video_actions(actions).groupBy("video_id").agg(
        F.count("*").alias("action_count"), F.array_sort(F.collect_set("name")).alias("action_names")
    )
    return grown(seen).join(known, "video_id", "left").withColumn(
        "action_count", F.coalesce("action_count", F.lit(0).cast("long"))
    )


def catalog_union(prepared: DataFrame, uploads: DataFrame) -> DataFrame:
    """Uploaded recordings beside prepared ones; they have no actions or objects."""
    added = uploads.select(
        "video_id", "duration_s", F.lit(LOCAL_DESCRIPTION).alias("description"),
        F.array().cast("array<string>").alias("objects"), F.lit(0).cast("long").alias("action_count"),
        F.lit("local_upload").alias("source"),
    )
    return prepared.withColumn("source", F.lit("prepared")).unionByName(added, allowMissingColumns=True)


def window_positions(windows: DataFrame) -> DataFrame:
    """The order of every recording's windows, as a 0-based position."""
    order = [F.col("start_s"), F.col("end_s")]
    return ordinal(windows, ["video_id"], order, F.floor(F.col("start_s") / BUCKET_S), "position")


def overlap_groups(actions: DataFrame) -> DataFrame:
    """Distinct sorted name sets of actions that overlap at least one other.

    Actions of one name are first merged to stretches, and each action meets the
    stretches it overlaps: the work follows actions and names, not pairs.
    An action of its own name counts when an earlier one still runs or a later one
    starts before it ends.  Exact repeats of an action are one action.
    """
    actions = cut_lineage(
        actions.groupBy("video_id", "action_id", "name", "start_s", "end_s").agg(F.min("pos").alias("pos")), "actions"
    )
    key, bucket = ["video_id", "name"], F.floor(F.col("start_s") / BUCKET_S)
    up = [F.col("start_s"), F.col("end_s"), F.col("pos")]
    down = [F.col(c).desc() for c in ("start_s", "end_s", "pos")]
    rows = running(actions, key, up, bucket, [Running("_reach", "max", F.col("end_s"), inclusive=False)])
    rows = running(rows, key, down, bucket, [Running("_next", "min", F.col("start_s"), inclusive=False)], reverse=True)
    own = F.coalesce(F.col("_reach") > F.col("start_s"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("end_s"), F.lit(False))
    rows = cut_lineage(rows.withColumn("_own", own), "own-overlaps")
    stretches = (
        islands(actions, key, "start_s", "end_s", up, 0.0, BUCKET_S)
        .groupBy("video_id", F.col("name").alias("other"), "island")
        .agg(F.min("start_s").alias("from_s"), F.max("end_s").alias("to_s"))
    )
    stretches = cut_lineage(stretches, "stretches")
    met = interval_join(
        rows.select("video_id", "pos", "name", "start_s", "end_s"), stretches, "video_id",
        ("start_s", "end_s"), ("from_s", "to_s"), BUCKET_S,
    ).filter(F.col("name") != F.col("other"))
    others = met.groupBy("video_id", "pos").agg(F.collect_set("other").alias("_others"))
    grouped = (
        rows.select("video_id", "pos", "name", "_own").join(others, ["video_id", "pos"], "left")
        .filter(F.col("_own") | F.col("_others").isNotNull())
    )
    names = F.array_sort(F.array_union(F.array("name"), F.coalesce("_others", F.array().cast("array<string>"))))
    return grouped.select("video_id", names.alias("names")).distinct()


def timeline_events(overlapping: DataFrame) -> DataFrame:
    """Distinct ``(name, start, end)`` of a recording; the last window is the evidence."""
    return (
        overlapping.filter((F.trim("name") != "") & (F.col("end_s") > F.col("start_s")))
        .groupBy("video_id", F.trim("name").alias("label"), "start_s", "end_s")
        .agg(
            F.max_by("window_id", F.struct("window_start_s", "window_end_s")).alias("evidence_window_id"),
            F.min("pos").alias("pos"),
        )
    )


def timeline(overlapping: DataFrame, gap_s: float = TIMELINE_GAP_S) -> DataFrame:
    """Events merged while the next starts within ``gap_s`` of the running end;
    labels in the order first seen."""
    order = [F.col("start_s"), F.col("end_s"), F.col("pos")]
    events = cut_lineage(timeline_events(overlapping), "events")  # the islands read it several times
    marked = islands(events, ["video_id"], "start_s", "end_s", order, gap_s, BUCKET_S)
    by_label = marked.groupBy("video_id", "island", "label").agg(
        F.min(F.struct("start_s", "end_s", "pos")).alias("first"),
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n"),
    )
    return by_label.groupBy("video_id", "island").agg(
        F.min("start_s").alias("start_s"),
        F.max("end_s").alias("end_s"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("first", "label"))), lambda x: x["label"]), " · "
        ).alias("label"),
        F.sum("n").alias("event_count"),
    )


def timeline_sources(overlapping: DataFrame, gap_s: float = TIMELINE_GAP_S) -> DataFrame:
    """The events behind a timeline: island, label, ends, evidence window and where they come from."""
    order = [F.col("start_s"), F.col("end_s"), F.col("pos")]
    events = cut_lineage(timeline_events(overlapping), "events")
    marked = islands(events, ["video_id"], "start_s", "end_s", order, gap_s, BUCKET_S)
    return marked.select(
        "video_id", "island", "label", "start_s", "end_s", "evidence_window_id", F.lit(EVENT_CONFIDENCE).alias("confidence"),
        F.array(F.lit(EVENT_LIMITATION)).alias("limitations"),
    )


def timeline_summary(windows: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per recording: overview and objects of its first window, numbers of groups and events.

    The overview is the description up to its first semicolon; one all in capitals is written as a
    sentence.  ``windows``: ``video_id, start_s, end_s, description, objects``; ``sources`` as of
    ``timeline_sources``."""
    first = windows.groupBy("video_id").agg(
        F.min_by(F.struct("description", "objects"), F.struct("start_s", "end_s", "window_id")).alias("_w")
    )
    text = F.trim(F.substring_index(F.coalesce("_w.description", F.lit("")), ";", 1))
    shouted = (text == F.upper(text)) & (text != F.lower(text))
    calm = F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))
    counts = sources.groupBy("video_id").agg(F.count_distinct("island").alias("group_count"), F.count("*").alias("event_count"))
    zero = F.lit(0).cast("long")
    return first.select(
        "video_id", F.when(shouted, calm).otherwise(text).alias("overview"), F.coalesce("_w.objects", F.array().cast("array<string>")).alias("objects")
    ).join(grown(counts), "video_id", "left").withColumn("group_count", F.coalesce("group_count", zero)).withColumn("event_count", F.coalesce("event_count", zero))


def interval_answer(requests: DataFrame, overlapping: DataFrame, windows: DataFrame) -> DataFrame:
    """Actions and windows that overlap a chosen interval of a recording.

    ``requests``: ``query_id, video_id, from_s, to_s``.
    """
    actions = overlapping.groupBy("video_id", "action_id", "name", "start_s", "end_s").agg(F.min("pos").alias("pos"))
    actions = cut_lineage(actions, "asked-actions")  # the interval join reads it twice
    ends = ("from_s", "to_s")
    hit = interval_join(requests, actions, "video_id", ends, ("start_s", "end_s"), BUCKET_S)
    named = hit.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("start_s", "pos", "name"))), lambda a: a["name"]).alias("_names")
    )
    spans = windows.select("video_id", "window_id", F.col("start_s").alias("w_start"), F.col("end_s").alias("w_end"))
    seen = interval_join(requests, spans, "video_id", ends, ("w_start", "w_end"), BUCKET_S)
    evidence = seen.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("w_start", "w_end", "window_id"))), lambda w: w["window_id"]).alias("evidence_window_ids")
    )
    text = F.when(
        F.col("_names").isNotNull(),
        F.concat(F.lit(ANSWER_PREFIX), F.array_join("_names", ", "), F.lit(".")),
    ).otherwise(NO_ANSWER)
    return (
        requests.join(grown(named), "query_id", "left").join(grown(evidence), "query_id", "left")
        .withColumn("answer", text)
        .withColumn("supported", F.col("_names").isNotNull())
        .drop("_names")
    )


def evidence_select(requests: DataFrame, windows: DataFrame, overlapping: DataFrame) -> DataFrame:
    """Windows a request lists; when none exists, those that overlap its interval.

    ``requests``: ``query_id, video_id, window_ids, from_s, to_s``.
    """
    listed = requests.select("query_id", "video_id", F.explode("window_ids").alias("window_id")).distinct()
    spans = windows.select(
        "video_id", "window_id", "objects", F.col("start_s").alias("w_start"), F.col("end_s").alias("w_end")
    )
    chosen = grown(grown(listed).join(grown(spans), ["video_id", "window_id"]))
    rest = requests.select("query_id", "video_id", "from_s", "to_s").join(
        chosen.select("query_id").distinct(), "query_id", "left_anti"
    )
    near = interval_join(rest, spans, "video_id", ("from_s", "to_s"), ("w_start", "w_end"), BUCKET_S)
    evidence = chosen.unionByName(near.select(*chosen.columns))
    names = (
        evidence.select("query_id", "window_id")
        .join(overlapping.select("window_id", "name").filter(F.col("name") != ""), "window_id")
        .groupBy("query_id").agg(F.array_sort(F.collect_set("name")).alias("action_names"))
    )
    return (
        evidence.groupBy("query_id")
        .agg(
            F.transform(F.sort_array(F.collect_list(F.struct("w_start", "window_id"))), lambda w: w["window_id"]).alias("window_ids"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("objects")))).alias("object_names"),
        )
        .join(grown(names), "query_id", "left")
    )


def prompt_terms(prompts: Column, objects: Column, question: Column) -> Column:
    """Object terms to look for: the requested ones, recorded objects the question
    touches, and its own longer words."""
    words = F.filter(
        F.transform(F.split(F.trim(question), r"\s+"), lambda w: strip_edges(w, WORD_EDGES)), lambda w: F.length(w) >= 4
    )
    lowered = F.transform(words, lambda w: F.lower(w))
    asked = F.transform(prompts, lambda p: F.lower(strip_edges(p, LABEL_EDGES)))
    touched = F.filter(
        objects,
        lambda o: F.exists(lowered, lambda t: F.contains(F.lower(o), t))
        | ((F.size(lowered) > 0) & F.contains(F.lower(question), F.lower(o))),
    )
    own = F.array_except(lowered, strings(PROMPT_STOPWORDS))
    return F.array_sort(F.filter(F.array_distinct(F.concat(asked, touched, own)), lambda t: t != ""))


def finding_payload(df: DataFrame) -> DataFrame:
    """Typed finding rows with defaults for the optional fields."""
    none = F.array().cast("array<string>")
    return df.select(
        "video_id", "question", F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"),
        "answer", F.coalesce("evidence_window_ids", none).alias("evidence_window_ids"),
        F.coalesce("status", F.lit("unclear")).alias("status"), F.coalesce("note", F.lit("")).alias("note"),
        F.coalesce("limitations", none).alias("limitations"), F.coalesce("source", F.lit("annotations")).alias("source"),
    )
