"""Annotated recordings to windows, frame times, samples and as-of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidex.functions.intervals import context_end, context_start, overlaps, window_timestamps
from evidex.functions.text import window_text
from evidex.operators.joins import dyadic_cover, dyadic_path, fresh, grown, levels_used
from evidex.operators.scan import Running, ordinal, running
from evidex.session import cut_lineage, shuffle_partitions

WINDOW_S, STRIDE_S = 4.0, 2.0
# Fixed value: one annotated action, "<id> <start> <end>".
ACTION_PATTERN = r"(c\d+)\s+(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)"
ACTION_FIELDS = ("action_id", "name", "start_s", "end_s")
MODALITIES = ("rgb", "audio", "depth", "pose")


def parse_actions(df: DataFrame, key: str, text: str, classes: DataFrame) -> DataFrame:
    """Replace an action text by ``actions array<struct>`` in source order; a name
    missing from ``classes(action_id, name)`` falls back to the id."""
    packed = action_rows(df, [key], text, classes).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("pos", *ACTION_FIELDS))).alias("_a")
    )
    return df.drop(text).join(packed, key, "left").withColumn("actions", _strip_pos("_a")).drop("_a")


def action_rows(df: DataFrame, keys: list[str], text: str, classes: DataFrame) -> DataFrame:
    """The same parse as one row per action, which needs no regrouping."""
    part = lambda i: F.regexp_extract_all(F.col(text), F.lit(ACTION_PATTERN), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("a"), part(2).alias("s"), part(3).alias("e"))
    rows = df.select(*keys, F.posexplode(zipped).alias("pos", "_f")).select(
        *keys, "pos",
        F.col("_f.a").alias("action_id"),
        F.col("_f.s").cast("double").alias("start_s"),
        F.col("_f.e").cast("double").alias("end_s"),
    )
    return rows.join(classes, "action_id", "left").withColumn("name", F.coalesce("name", "action_id"))


def hash_sample(df: DataFrame, key: str, split: str, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """First ``limit`` rows per split by sha-256 of ``seed:key``; ``limits`` maps a
    split to ``(limit, seed)``.  Each task passes on ``limit`` rows at most."""
    seed, limit = F.lit(None).cast("long"), F.lit(0)
    for name, (count, number) in limits.items():
        seed = F.when(F.col(split) == name, F.lit(number)).otherwise(seed)
        limit = F.when(F.col(split) == name, F.lit(count)).otherwise(limit)
    hashed = df.filter(F.col(split).isin(*limits)).withColumn(
        "_hash", F.sha2(F.concat_ws(":", seed.cast("string"), F.col(key)), 256)
    )
    largest = max(count for count, _ in limits.values())
    place = F.row_number().over(Window.partitionBy(split).orderBy("_hash", key))
    ranked = hashed.withColumn("sample_rank", place).filter(F.col("sample_rank") <= largest)
    return ranked.filter(F.col("sample_rank") <= limit).drop("_hash")


def _window_id(video: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%.2f-%.2f", video, start, end)


WINDOWS_PER_BLOCK = 4096


def _explode_windows(recordings: DataFrame, count: Column) -> DataFrame:
    """One row per window number below ``count``.

    Recordings are small rows that grow by orders of magnitude here, so they are cut
    into blocks of windows first and the blocks are spread over the cluster: a
    recording of any length is shared by many tasks.
    """
    blocks = recordings.withColumn("_count", count).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_count") - 1) / WINDOWS_PER_BLOCK)))
    )
    if not recordings.isStreaming:
        blocks = blocks.repartition(shuffle_partitions(recordings.sparkSession), "video_id", "_block")
    first = F.col("_block") * WINDOWS_PER_BLOCK
    numbers = F.sequence(first, F.least(F.col("_count"), first + WINDOWS_PER_BLOCK) - 1)
    made = blocks.withColumn("window_no", F.explode(numbers)).drop("_count", "_block")
    return made if recordings.isStreaming else grown(made)


def sliding_windows(
    recordings: DataFrame, window_s: float = WINDOW_S, stride_s: float = STRIDE_S
) -> DataFrame:
    """Windows every ``stride_s`` up to the first that touches the end.

    The count is closed-form, so no loop over a recording is needed.
    """
    length = F.col("length_s")
    count = F.least(
        F.greatest(F.lit(1).cast("long"), F.ceil((length - window_s) / stride_s) + 1),
        F.ceil(length / stride_s),
    )
    start = F.col("window_no") * F.lit(stride_s)
    return (
        _explode_windows(recordings.filter(length > 0), count)
        .withColumn("start_s", F.round(start, 3))
        .withColumn("end_s", F.round(F.least(start + window_s, length), 3))
        .withColumn("window_id", _window_id(F.col("video_id"), F.col("start_s"), F.col("end_s")))
        .withColumnRenamed("length_s", "duration_s")
    )


def windows_keep_tail(
    recordings: DataFrame, window_s: float = WINDOW_S, stride_s: float = STRIDE_S, context_s: float = 1.0, frames: int = 16
) -> DataFrame:
    """Windows of an upload: every start below the end, so a short tail stays."""
    length = F.col("length_s")
    count = F.greatest(F.lit(1).cast("long"), F.ceil((length - 1e-6) / stride_s))
    start = F.col("window_no") * F.lit(stride_s)
    return (
        _explode_windows(recordings, count)
        .withColumn("start_s", start)
        .withColumn("end_s", F.least(start + window_s, length))
        .withColumn("context_start_s", context_start("start_s", context_s))
        .withColumn("context_end_s", F.least(length, F.col("end_s") + context_s))
        .withColumn("window_id", _window_id(F.col("video_id"), F.col("start_s"), F.col("end_s")))
        .withColumn("frame_timestamps_s", window_timestamps("start_s", "end_s", frames))
        .withColumnRenamed("length_s", "duration_s")
    )


SHORT_ACTION = 32  # window numbers up to which an action is one row each


def _touched_span(window_s: float, stride_s: float) -> tuple[Column, Column]:
    """The first and last window number an action may overlap."""
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("start_s") - window_s) / stride_s))
    return first, F.greatest(first, F.ceil(F.col("end_s") / stride_s))


def _touched(actions: DataFrame, window_s: float, stride_s: float) -> DataFrame:
    """One row per action and window number it may overlap.  Actions of many windows are cut into
    blocks of numbers and the blocks spread before they grow, so that no task makes all rows of one."""
    first, last = _touched_span(window_s, stride_s)
    spans = actions.select("video_id", "pos", *ACTION_FIELDS, first.alias("_first"), last.alias("_last"))
    grown = ["video_id", "pos", *ACTION_FIELDS]
    few = spans.where(last_below(WINDOWS_PER_BLOCK)).select(*grown, F.explode(F.sequence("_first", "_last")).alias("window_no"))
    blocks = fresh(spans).where(~last_below(WINDOWS_PER_BLOCK)).withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("_first") / WINDOWS_PER_BLOCK), F.floor(F.col("_last") / WINDOWS_PER_BLOCK)))
    )
    low = F.greatest(F.col("_first"), F.col("_block") * WINDOWS_PER_BLOCK)
    high = F.least(F.col("_last"), (F.col("_block") + 1) * WINDOWS_PER_BLOCK - 1)
    spread = blocks.repartition(shuffle_partitions(actions.sparkSession), "video_id", "_block", "pos")
    return few.unionByName(spread.select(*grown, F.explode(F.sequence(low, high)).alias("window_no")))


def last_below(count: int) -> Column:
    return F.col("_last") - F.col("_first") < count


def action_nodes(actions: DataFrame, window_s: float = WINDOW_S, stride_s: float = STRIDE_S) -> DataFrame:
    """Actions of more than ``SHORT_ACTION`` windows on dyadic blocks of the window numbers they may
    overlap, as ``_level, _node``."""
    first, last = _touched_span(window_s, stride_s)
    return actions.where(last - first >= SHORT_ACTION).select("video_id", "pos", *ACTION_FIELDS, F.explode(dyadic_cover(first, last)).alias("_at")).select(
        "video_id", "pos", *ACTION_FIELDS, F.col("_at.level").alias("_level"), F.col("_at.node").alias("_node")
    )


def window_action_overlap(
    windows: DataFrame, actions: DataFrame, window_s: float = WINDOW_S, stride_s: float = STRIDE_S
) -> DataFrame:
    """One row per window and action that overlap.

    An action knows which window numbers it can touch.  A short one meets its windows on ``(video_id,
    window_no)``; a longer one is placed on dyadic blocks of numbers, a few rows however long it is, and
    meets the windows of such recordings on ``(video_id, level, block)``: no range join, and a long
    recording spreads over the tasks.  The exact test stays as a residual filter.
    """
    sides = windows.select(
        *[c for c in windows.columns if c not in ("start_s", "end_s")],
        F.col("start_s").alias("window_start_s"), F.col("end_s").alias("window_end_s"),
    )
    first, last = _touched_span(window_s, stride_s)
    short = actions.where(last - first < SHORT_ACTION).select(
        "video_id", "pos", *ACTION_FIELDS, F.explode(F.sequence(first, last)).alias("window_no")
    )
    met = grown(sides).join(grown(short), ["video_id", "window_no"])
    used = fresh(actions).where(last - first >= SHORT_ACTION).groupBy("video_id").agg(
        F.bit_or(levels_used(dyadic_cover(first, last))).alias("_used")
    )
    placed = grown(fresh(sides)).join(used, "video_id").select(*sides.columns, F.explode(dyadic_path(F.col("window_no"), F.col("_used"))).alias("_at"))
    placed = placed.select(*sides.columns, F.col("_at.level").alias("_level"), F.col("_at.node").alias("_node"))
    far = grown(placed).join(grown(action_nodes(fresh(actions), window_s, stride_s)), ["video_id", "_level", "_node"]).drop("_level", "_node")
    return grown(met.unionByName(far).filter(overlaps("start_s", "end_s", "window_start_s", "window_end_s")))


def _strip_pos(packed: str) -> Column:
    """Ordered action structs without their position; empty instead of null."""
    strip = lambda a: F.struct(*[a[f].alias(f) for f in ACTION_FIELDS])
    empty = F.array().cast("array<struct<action_id:string,name:string,start_s:double,end_s:double>>")
    return F.coalesce(F.transform(packed, strip), empty)


def attach_actions(
    windows: DataFrame, actions: DataFrame, window_s: float = WINDOW_S, stride_s: float = STRIDE_S
) -> DataFrame:
    """Windows with their overlapping ``actions array<struct>`` in source order.

    Actions are packed by the window numbers they may touch and the exact test runs
    inside the row, so the windows are read once.
    """
    packed = _touched(actions, window_s, stride_s).groupBy("video_id", "window_no").agg(
        F.sort_array(F.collect_list(F.struct("pos", *ACTION_FIELDS))).alias("_a")
    )
    joined = grown(windows).join(grown(packed), ["video_id", "window_no"], "left")
    exact = F.filter("_a", lambda a: overlaps(a["start_s"], a["end_s"], F.col("start_s"), F.col("end_s")))
    return grown(joined.withColumn("_a", exact).withColumn("actions", _strip_pos("_a")).drop("_a"))


def frame_manifest(windows: DataFrame, frames: int = 16) -> DataFrame:
    """Frame times and caption per window; other columns are pruned."""
    names = F.transform("actions", lambda a: a["name"])
    return windows.select(
        "window_id", "video_id", "split", "start_s", "end_s",
        window_timestamps("start_s", "end_s", frames).alias("timestamps_s"),
        window_text(names, F.col("description"), F.col("objects")).alias("text"),
        "actions", "objects", "description",
    )


def even_sample(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, count: int) -> DataFrame:
    """``count`` evenly spaced rows per key: positions ``rint(linspace(0, n-1, k))``."""
    placed = ordinal(df, keys, order, bucket, "_place")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    kept = F.least(F.col("_n"), F.lit(count).cast("long"))
    step = F.when(kept > 1, (F.col("_n") - 1) / (kept - 1)).otherwise(F.lit(0.0))
    wanted = sizes.select(
        *keys,
        F.explode(
            F.array_distinct(
                F.transform(F.sequence(F.lit(0).cast("long"), kept - 1), lambda i: F.rint(i * step).cast("long"))
            )
        ).alias("_place"),
    )
    return placed.join(wanted, [*keys, "_place"]).withColumnRenamed("_place", "position")


def nearest_frame(targets: DataFrame, frames: DataFrame, key: str, width: float = 64.0) -> DataFrame:
    """For each ``(key, target_s)`` the nearest ``frame_s``; the earlier one on a tie.

    An as-of match in both directions as two running aggregates over the union, so
    a recording of any size is spread over time buckets.
    """
    both = targets.select(key, F.col("target_s").alias("t"), F.lit(None).cast("double").alias("f")).unionByName(
        frames.select(key, F.col("frame_s").alias("t"), F.col("frame_s").alias("f"))
    )
    both = cut_lineage(both, "times")  # both directions read it
    bucket = F.floor(F.col("t") / width)
    ahead = F.when(F.col("f").isNull(), 1).otherwise(0)
    back = running(both, [key], [F.col("t"), ahead], bucket, [Running("before_s", "max", F.col("f"))])
    full = running(
        back, [key], [F.col("t").desc(), ahead], bucket, [Running("after_s", "min", F.col("f"))], reverse=True
    )
    closer = F.when(F.col("after_s").isNull(), F.col("before_s")).when(
        F.col("before_s").isNull() | (F.col("after_s") - F.col("t") < F.col("t") - F.col("before_s")), F.col("after_s")
    ).otherwise(F.col("before_s"))
    return full.filter(F.col("f").isNull()).select(
        key, F.col("t").alias("target_s"), closer.alias("frame_s"), F.col("after_s").isNull().alias("past_end")
    )


def forward_frame(targets: DataFrame, frames: DataFrame, key: str, width: float = 64.0) -> DataFrame:
    """The first frame at or after each target; past the last one, the last frame."""
    both = targets.select(key, F.col("target_s").alias("t"), F.lit(None).cast("double").alias("f")).unionByName(
        frames.select(key, F.col("frame_s").alias("t"), F.col("frame_s").alias("f"))
    )
    bucket = F.floor(F.col("t") / width)
    is_target = F.when(F.col("f").isNull(), 1).otherwise(0)
    full = running(
        both, [key], [F.col("t").desc(), is_target], bucket, [Running("after_s", "min", F.col("f"))], reverse=True
    )
    last = frames.groupBy(key).agg(F.max("frame_s").alias("_last"))
    return (
        full.filter(F.col("f").isNull())
        .join(last, key, "left")
        .select(key, F.col("t").alias("target_s"), F.coalesce("after_s", "_last").alias("frame_s"), F.col("after_s").isNull().alias("padded"))
    )


def spread_targets(df: DataFrame, start: str, end: str, count: int) -> DataFrame:
    """The centres of ``count`` equal parts of an interval as rows."""
    length = F.col(end) - F.col(start)
    centres = F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.col(start) + (i + F.lit(0.5)) * length / count
    )
    return df.withColumn("target_s", F.explode(centres))


def select_split(df: DataFrame, split: str = "all") -> DataFrame:
    """One split, or everything; a stored table prunes its partitions by it."""
    return df if split == "all" else df.filter(F.col("split") == split)


def modality_mask(paths: Column) -> Column:
    """Map of the four modalities to whether a non-blank path is present."""
    names = F.array(*[F.lit(m) for m in MODALITIES])
    present = F.transform(names, lambda m: F.coalesce(F.element_at(paths, m) != "", F.lit(False)))
    return F.map_from_arrays(names, present)


def manifest_audit(records: DataFrame) -> DataFrame:
    """``(metric, key, value)`` counts over multimodal records."""
    masked = records.withColumn("_mask", modality_mask(F.col("paths")))
    has = [F.element_at("_mask", F.lit(m)) for m in MODALITIES]
    all_four = has[0] & has[1] & has[2] & has[3]
    totals = masked.agg(
        F.count("*").cast("double").alias("record_count"),
        *[F.sum(h.cast("double")).alias(f"modality_{m}") for h, m in zip(has, MODALITIES)],
        F.sum(all_four.cast("double")).alias("all_modalities_count"),
        F.sum(F.size("annotations").cast("double")).alias("annotation_count"),
        F.round(F.sum("duration_s"), 3).alias("total_duration_s"),
    )
    names = totals.columns
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    flat = totals.selectExpr(f"stack({len(names)}, {pairs}) as (metric, value)")
    flat = flat.select("metric", F.lit("").alias("key"), "value")
    splits = masked.groupBy("split").agg(F.count("*").cast("double").alias("value")).select(
        F.lit("split_count").alias("metric"), F.col("split").alias("key"), "value"
    )
    labels = (
        masked.select(F.explode("annotations").alias("a")).select(F.col("a.label").alias("label")).distinct()
        .agg(F.count("*").cast("double").alias("value"))
        .select(F.lit("label_count").alias("metric"), F.lit("").alias("key"), "value")
    )
    return flat.unionByName(splits).unionByName(labels)
