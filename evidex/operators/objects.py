"""Detections, masks, geometry and cross-visit association."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidex.functions.boxes import (
    area, association_status, box_iou, canonical_class, clamp_box, evidence_quality, mask_warnings, movement_status,
    normalized_box, visibility_status,
)
from evidex.functions.text import normalise_label
from evidex.functions.vectors import l2_normalize
from evidex.operators.joins import fresh
from evidex.operators.quantiles import exact_quantiles
from evidex.operators.scan import Running, ordinal, running
from evidex.session import cut_lineage

NMS_IOU, MAX_PER_FRAME = 0.50, 20
FOLD_ROWS = 512  # best boxes of one frame and class folded per round
TOP_PER_GROUP = 200
MASK_SAMPLE = 2048
HIGH_CONFIDENCE = 0.35


def candidates(raw: DataFrame, width: int, height: int) -> DataFrame:
    """Raw detections with a known class and a box left inside the image."""
    return (
        raw.withColumn("canonical_class", canonical_class(F.col("phrase")))
        .withColumn("box", clamp_box(F.col("box"), F.lit(width), F.lit(height)))
        .filter(F.col("canonical_class").isNotNull() & F.col("box").isNotNull())
    )


def _fold_best(rows: DataFrame, keys: list[str], overlap: float) -> DataFrame:
    """Greedy suppression inside arrays of at most ``FOLD_ROWS`` detections."""
    rest = [c for c in rows.columns if c not in (*keys, "place")]
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", *rest))).alias("_items"))

    def step(kept: Column, row: Column) -> Column:
        clash = F.exists(kept, lambda k: box_iou(row["box"], k["box"]) > overlap)
        return F.when(clash | (F.size(kept) >= MAX_PER_FRAME), kept).otherwise(F.concat(kept, F.array(row)))

    nothing = F.filter("_items", lambda _: F.lit(False))
    return packed.select(*keys, F.aggregate("_items", nothing, step).alias("kept"))


def class_nms(
    detections: DataFrame, frame: str, order: list[Column], overlap: float = NMS_IOU, fold_rows: int = FOLD_ROWS
) -> DataFrame:
    """Keep the best boxes per frame: none may overlap a better kept one of its
    class, and at most twenty stay per frame in score order.

    A frame of at most ``fold_rows`` boxes, as ordinary tables have them, is sorted once and folded
    whole.  Larger ones go class by class (``_fold_classes``).  The result is a stored table.
    """
    folded = cut_lineage(_fold_frames(detections, frame, order, overlap, fold_rows), "nms-frames")
    large = folded.filter(F.col("_n") > fold_rows).select(frame).distinct()
    if large.isEmpty():
        return folded.drop("_n")
    small = folded.filter(F.col("_n") <= fold_rows).drop("_n")
    whole = _fold_classes(detections.join(fresh(large), frame, "left_semi"), frame, order, overlap, fold_rows)
    return cut_lineage(small.unionByName(whole), "nms-frames")


def _fold_frames(detections: DataFrame, frame: str, order: list[Column], overlap: float, fold_rows: int) -> DataFrame:
    """All classes of a frame in one fold of its best ``fold_rows`` boxes; ``_n`` is how many it has.  Boxes
    come in score order, so the first twenty kept are the twenty to keep and their places the ranks."""
    rest = [c for c in detections.columns if c != frame]
    placed = detections.withColumn("place", F.row_number().over(Window.partitionBy(frame).orderBy(*order)))
    best = F.when(F.col("place") <= fold_rows, F.struct("place", *rest))
    packed = placed.groupBy(frame).agg(F.sort_array(F.collect_list(best)).alias("_items"), F.count("*").alias("_n"))

    def step(kept: Column, row: Column) -> Column:
        clash = F.exists(kept, lambda k: k["canonical_class"].eqNullSafe(row["canonical_class"]) & (box_iou(row["box"], k["box"]) > overlap))
        return F.when((F.size(kept) >= MAX_PER_FRAME) | clash, kept).otherwise(F.concat(kept, F.array(row)))

    nothing = F.filter("_items", lambda _: F.lit(False))
    kept = packed.select(frame, "_n", F.posexplode(F.aggregate("_items", nothing, step)).alias("_at", "_k"))
    return kept.select(frame, *[F.col(f"_k.{c}").alias(c) for c in rest], (F.col("_at") + 1).alias("rank"), "_n")


def _fold_classes(detections: DataFrame, frame: str, order: list[Column], overlap: float, fold_rows: int) -> DataFrame:
    """Suppression looks at one class of a frame.  A round folds the best
    ``fold_rows`` boxes of it; what remains in a larger one and clashes with
    nothing kept yet goes to the next round, unless twenty are kept already, since
    those alone fill the frame."""
    keys = [frame, "canonical_class"]
    by_score = Window.partitionBy(*keys).orderBy(*order)
    best = detections.withColumn("place", F.row_number().over(by_score).cast("long")).filter(F.col("place") <= fold_rows)
    kept = _fold_best(best, keys, overlap)
    large = detections.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > fold_rows).select(*keys)
    if not large.isEmpty():
        kept = _fold_large(detections, cut_lineage(kept, "nms"), large, keys, order, overlap, fold_rows)
    survivors = kept.select(*keys, F.explode("kept").alias("_k")).select(*keys, "_k.*").drop("place")
    rank = F.row_number().over(Window.partitionBy(frame).orderBy(*order))
    return survivors.withColumn("rank", rank).filter(F.col("rank") <= MAX_PER_FRAME)


def _fold_large(
    detections: DataFrame, kept: DataFrame, large: DataFrame, keys: list[str], order: list[Column], overlap: float, fold_rows: int
) -> DataFrame:
    """Further rounds for the frames and classes with more than ``fold_rows`` boxes."""
    # Scores fall along the order, so their negated steps are rising buckets.
    placed = ordinal(detections.join(large, keys, "left_semi"), keys, order, F.floor(F.col("score") * -4096), "place")
    rest = cut_lineage(placed.filter(F.col("place") >= fold_rows), "nms_rest")
    while True:
        clash = F.exists("kept", lambda k: box_iou(F.col("box"), k["box"]) > overlap)
        still = rest.join(kept, keys).filter((F.size("kept") < MAX_PER_FRAME) & ~clash).drop("kept")
        rest = cut_lineage(still, "nms_rest")
        if rest.isEmpty():
            return kept
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
        batch = cut_lineage(rest.withColumn("_turn", turn).filter(F.col("_turn") <= fold_rows).drop("_turn"), "nms_batch")
        ordered = batch.select(*keys, "place", *[c for c in detections.columns if c not in keys])
        more = _fold_best(ordered, keys, overlap).withColumnRenamed("kept", "_more")
        joined = F.when(F.col("_more").isNull(), F.col("kept")).otherwise(
            F.slice(F.concat("kept", F.col("_more")), 1, MAX_PER_FRAME)
        )
        kept = cut_lineage(kept.join(more, keys, "left").withColumn("kept", joined).drop("_more"), "nms")
        done = batch.groupBy(*keys).agg(F.max("place").alias("_done"))
        rest = rest.join(done, keys, "left").filter(F.col("place") > F.coalesce("_done", F.lit(-1))).drop("_done")


def rejected_counts(raw: DataFrame, kept: DataFrame, frame: str) -> DataFrame:
    """Raw, kept and rejected detections per frame."""
    left = raw.groupBy(frame).agg(F.count("*").alias("raw_count"))
    right = kept.groupBy(frame).agg(F.count("*").alias("kept_count"))
    return (
        left.join(right, frame, "left").withColumn("kept_count", F.coalesce("kept_count", F.lit(0).cast("long")))
        .withColumn("rejected_count", F.col("raw_count") - F.col("kept_count"))
    )


def detection_ids(kept: DataFrame, width: int, height: int) -> DataFrame:
    """``frame:det-NN`` ids by rank and boxes as shares of the image."""
    return kept.withColumn("detection_id", F.format_string("%s:det-%02d", "frame_id", "rank")).withColumn(
        "box_normalized", normalized_box(F.col("box"), F.lit(width), F.lit(height))
    )


def mask_stats(pixels: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """Area share of each mask and its size warnings; a pixel counts once."""
    return (
        pixels.select(key, "px", "py").distinct().groupBy(key).agg((F.count("*") / (width * height)).alias("mask_area_fraction"))
        .withColumn("warnings", mask_warnings(F.col("mask_area_fraction")))
    )


def localization_summary(frames: DataFrame, detections: DataFrame, rejected: DataFrame) -> DataFrame:
    """``(metric, key, value)`` totals of a detection run."""
    per_frame = detections.groupBy("frame_id").agg(F.count("*").alias("_n"))
    joined = frames.join(per_frame, "frame_id", "left")
    row = lambda name, key, value: F.struct(F.lit(name).alias("metric"), key.alias("key"), value.cast("long").alias("value"))
    none = F.lit("")
    totals = joined.agg(
        F.count("*").alias("f"), F.count("_n").alias("d"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n")
    ).select(F.explode(F.array(
        row("frame_count", none, F.col("f")), row("frames_with_detections", none, F.col("d")),
        row("empty_frame_count", none, F.col("f") - F.col("d")), row("detection_count", none, F.col("n")),
    )).alias("r")).select("r.*")
    visits = frames.groupBy(F.col("observation").cast("string").alias("key")).agg(F.count("*").alias("value"))
    classes = detections.groupBy(F.col("canonical_class").alias("key")).agg(F.count("*").alias("value"))
    dropped = rejected.agg(F.coalesce(F.sum("rejected_count"), F.lit(0)).alias("value"))
    named = lambda df, name: df.select(F.lit(name).alias("metric"), F.col("key") if "key" in df.columns else none.alias("key"), F.col("value").cast("long").alias("value"))
    return (
        totals.unionByName(named(visits, "frames_per_observation")).unionByName(named(classes, "class_count"))
        .unionByName(named(dropped, "rejected_detection_count"))
    )


def audit_reduce(judgments: DataFrame, detections: DataFrame, missed: DataFrame) -> DataFrame:
    """Counts ``(metric, key, verdict, value)`` of reviewed detections and the
    support rate of the confident ones (null when none is decided)."""
    rows = judgments.join(detections.select("detection_id", "canonical_class", "score"), "detection_id")
    counts = rows.groupingSets(
        [[F.col("verdict")], [F.col("mask_quality")], [F.col("canonical_class"), F.col("verdict")]],
        F.col("verdict"), F.col("mask_quality"), F.col("canonical_class"),
    ).agg(F.count("*").cast("double").alias("value"))
    metric = (
        F.when(F.col("mask_quality").isNotNull(), "mask_quality").when(F.col("canonical_class").isNotNull(), "class_verdict").otherwise("verdict")
    )
    made = counts.select(metric.alias("metric"), F.coalesce("mask_quality", "canonical_class", F.lit("")).alias("key"), F.coalesce("verdict", F.lit("")).alias("verdict"), "value")
    high = rows.filter(F.col("score") >= HIGH_CONFIDENCE)
    decided = lambda *v: F.sum(F.col("verdict").isin(*v).cast("double"))
    rate = high.agg(F.try_divide(decided("supported"), decided("supported", "unsupported")).alias("value")).select(
        F.lit("support_rate").alias("metric"), F.lit("").alias("key"), F.lit("").alias("verdict"), "value"
    )
    lost = missed.groupBy(F.col("missed_class").alias("key")).agg(F.count("*").cast("double").alias("value")).select(
        F.lit("missed").alias("metric"), "key", F.lit("").alias("verdict"), "value"
    )
    return made.unionByName(rate).unionByName(lost)


def audited_detections(detections: DataFrame, judgments: DataFrame) -> DataFrame:
    """Detections with their verdict, or ``unreviewed``."""
    verdicts = judgments.select("detection_id", F.col("verdict").alias("audit_status"))
    return detections.join(verdicts, "detection_id", "left").withColumn(
        "audit_status", F.coalesce("audit_status", F.lit("unreviewed"))
    )


def frame_gallery(frames: DataFrame, audited: DataFrame, frame_audits: DataFrame) -> DataFrame:
    """Frames with nested detections (twenty at most) and their review state."""
    item = F.struct("rank", "detection_id", "canonical_class", "score", "audit_status")
    packed = audited.groupBy("frame_id").agg(F.sort_array(F.collect_list(item)).alias("detections"))
    shape = packed.schema["detections"].dataType.simpleString()
    reviewed = frame_audits.select("frame_id", "missed_visible_classes", F.lit("reviewed").alias("review"))
    return (
        frames.join(packed, "frame_id", "left").join(reviewed, "frame_id", "left")
        .withColumn("detections", F.coalesce("detections", F.array().cast(shape)))
        .withColumn("review", F.coalesce("review", F.lit("unreviewed")))
        .withColumn("missed_visible_classes", F.coalesce("missed_visible_classes", F.array().cast("array<string>")))
    )


def gallery_filter(
    gallery: DataFrame, minimum_score: float = 0.0, object_class: str = "all", audit_status: str = "all", visit: int | None = None
) -> DataFrame:
    """Frames to show and, in ``shown``, their detections that pass."""
    scored = lambda d: d["score"] >= minimum_score

    def passes(d: Column) -> Column:
        keep = scored(d)
        if object_class != "all":
            keep = keep & (d["canonical_class"] == object_class)
        return keep & (d["audit_status"] == audit_status) if audit_status != "all" else keep

    rows = gallery if visit is None else gallery.filter(F.col("observation") == visit)
    rows = rows.withColumn("shown", F.filter("detections", passes))
    if object_class != "all" or audit_status != "all":
        return rows.filter(F.size("shown") > 0)
    return rows.filter(F.exists("detections", scored) | (F.size("detections") == 0))


def failure_frames(gallery: DataFrame) -> DataFrame:
    doubtful = F.exists("detections", lambda d: d["audit_status"].isin("unsupported", "uncertain"))
    return gallery.filter((F.size("missed_visible_classes") > 0) | doubtful)


def _colour_bin(r: Column, g: Column, b: Column) -> Column:
    level = lambda c: F.least(F.floor((c + 8) / 16), F.lit(15))
    return level(r) * 256 + level(g) * 16 + level(b)


def color_bin_link(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """Points of a frame whose 16-level colour occurs among a mask's sampled pixels.

    Pixels are strided to about 2048 in ``px_order`` and reduced to distinct bins
    before they meet the points on ``(frame, bin)``.
    """
    place = Running("_place", "sum", F.lit(1).cast("long"), inclusive=False)
    placed = running(pixels, ["detection_no"], [F.col("px_order")], F.floor(F.col("px_order") / 65536), [place])
    sizes = pixels.groupBy("detection_no").agg(F.count("*").alias("_n"))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") / MASK_SAMPLE))
    bins = (
        placed.join(sizes, "detection_no").filter(F.col("_place") % step == 0)
        .select("detection_no", "frame_no", _colour_bin(F.col("r"), F.col("g"), F.col("b")).alias("bin")).distinct()
    )
    coloured = points.withColumn("bin", _colour_bin(F.col("r"), F.col("g"), F.col("b")))
    return coloured.join(bins, ["frame_no", "bin"])


def robust_extent(linked: DataFrame, detections: DataFrame, key: str) -> DataFrame:
    """Point count, median centre and 5-95 % extent per detection, null without points."""
    linked = cut_lineage(linked.select(key, "x", "y", "z"), "linked")
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in "xyz"]))
    long = linked.select(key, axes.alias("_a")).select(key, F.col("_a.axis").alias("axis"), F.col("_a.v").alias("v"))
    stats = exact_quantiles(long, [key, "axis"], "v", {"low": 0.05, "mid": 0.5, "high": 0.95}, 1.0)
    at = lambda axis, name: F.max(F.when(F.col("axis") == axis, F.col(name)))
    wide = stats.groupBy(key).agg(
        *[at(a, n).alias(f"{label}_{a}") for a in "xyz" for n, label in (("low", "min"), ("mid", "centre"), ("high", "max"))]
    )
    counts = linked.groupBy(key).agg(F.count("*").alias("point_count"))
    return detections.join(counts, key, "left").join(wide, key, "left").withColumn(
        "point_count", F.coalesce("point_count", F.lit(0).cast("long"))
    )


def rgbd_summary(frames: DataFrame, detections: DataFrame, evidence: DataFrame) -> DataFrame:
    made = evidence.agg(
        F.count("*").alias("evidence_count"), F.sum((F.col("point_count") > 0).cast("long")).alias("nonempty_evidence_count")
    )
    size = lambda df: df.agg(F.count("*")).scalar()
    return made.withColumn("frame_count", size(frames)).withColumn("detection_count", size(detections))


def visit_comparison(evidence: DataFrame) -> DataFrame:
    """Per class and pair of visits the row with most points on each side.

    Each visit and class is reduced to its best row first (the earliest of equals).
    """
    best = evidence.groupBy("observation", "object_class").agg(
        F.max_by(F.struct("detection_id", "point_count"), F.struct("point_count", (-F.col("ord")).alias("o"))).alias("b")
    )
    side = lambda p: best.select(
        "object_class", F.col("observation").alias(f"{p}_observation"), F.col("b.detection_id").alias(f"{p}_detection_id"), F.col("b.point_count").alias(f"{p}_point_count")
    )
    return side("earlier").join(side("later"), "object_class").filter(F.col("earlier_observation") < F.col("later_observation"))


def with_quality(evidence: DataFrame) -> DataFrame:
    return evidence.withColumn("quality", evidence_quality(F.col("score"), F.col("mask_score"), F.col("point_count")))


def pair_score(a: str, b: str, appearance: Column) -> dict[str, Column]:
    """Score parts of two evidence rows with columns prefixed ``a`` and ``b``."""
    c = lambda side, name: F.col(f"{side}_{name}")
    size = lambda side: F.greatest(F.coalesce(c(side, "mask_area_fraction"), F.lit(0.001)), F.lit(0.001))
    shape = F.exp(-F.abs(F.ln(size(a) / size(b))))
    evidence = F.least(F.lit(1.0), (c(a, "quality") + c(b, "quality")) / 2)
    square = sum(((c(a, n) - c(b, n)) * (c(a, n) - c(b, n)) for n in ("cx", "cy", "cz")), F.lit(0.0))
    distance = F.sqrt(square)
    position = F.when(distance.isNull(), F.lit(0.5)).otherwise(F.exp(-distance / 2))
    look = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (appearance + 1) / 2))
    total = F.lit(0.55) * look + F.lit(0.15) * shape + F.lit(0.15) * evidence + F.lit(0.15) * position
    return {
        "appearance_similarity": appearance, "shape_score": shape, "evidence_score": evidence, "position_score": position,
        "association_score": total, "centroid_distance_m": distance,
    }


_PAIR_COLUMNS = ("appearance_similarity", "shape_score", "evidence_score", "position_score", "association_score", "centroid_distance_m")


def _score_block(a: pd.DataFrame, b: pd.DataFrame) -> dict[str, np.ndarray]:
    """All scores of two small blocks as matrices."""
    stack = lambda col: np.stack([np.asarray(v, dtype=np.float64) for v in col])
    look = stack(a["vector"]) @ stack(b["vector"]).T
    sizes = [np.maximum(s["mask_area_fraction"].fillna(0.001).to_numpy(float), 0.001) for s in (a, b)]
    shape = np.exp(-np.abs(np.log(sizes[0][:, None] / sizes[1][None, :])))
    evidence = np.minimum(1.0, (a["quality"].to_numpy()[:, None] + b["quality"].to_numpy()[None, :]) / 2)
    square = np.zeros(look.shape)
    for axis in ("cx", "cy", "cz"):
        square += (a[axis].to_numpy(float)[:, None] - b[axis].to_numpy(float)[None, :]) ** 2
    distance = np.sqrt(square)
    position = np.where(np.isnan(distance), 0.5, np.exp(-distance / 2))
    total = 0.55 * np.clip((look + 1) / 2, 0, 1) + 0.15 * shape + 0.15 * evidence + 0.15 * position
    return dict(zip(_PAIR_COLUMNS, (look, shape, evidence, position, np.round(total, 9), distance)))


_PAIR_SCHEMA = (
    "object_class string, earlier_observation long, later_observation long, earlier_ord long, later_ord long, "
    "earlier_detection_id string, later_detection_id string, pair_count long, score_sum double, "
    + ", ".join(f"{n} double" for n in _PAIR_COLUMNS)
)


def associate(evidence: DataFrame, top: int = TOP_PER_GROUP, block_rows: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Best pairs and pair totals per (earlier visit, later visit, class).

    ``evidence``: ``detection_id, ord, observation, object_class, vector, quality,
    mask_area_fraction, cx, cy, cz``.  Returns ``(pairs, totals)``.

    Every visit and class is cut into blocks by a hash of the row, so a class that
    holds most rows is many blocks.  Two blocks meet as matrices in one task, which
    passes on its best ``top`` pairs and the totals; pairs are never rows.
    """
    unit = evidence.withColumn("vector", l2_normalize(F.col("vector")))
    groups = unit.groupBy("object_class", "observation").agg(F.count("*").alias("_n"))
    blocks = groups.withColumn("_blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_n") / block_rows))).drop("_n")
    rows = unit.join(blocks, ["object_class", "observation"]).withColumn(
        "_block", F.pmod(F.xxhash64("ord"), F.col("_blocks"))
    )
    others = lambda p, n: blocks.select("object_class", F.col("observation").alias(f"{p}_observation"), F.col("_blocks").alias(n))
    keys = ["object_class", "earlier_observation", "later_observation", "eb", "lb"]
    fan = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    payload = ["ord", "detection_id", "vector", "quality", "mask_area_fraction", "cx", "cy", "cz"]
    left = (
        rows.withColumnRenamed("observation", "earlier_observation").withColumnRenamed("_block", "eb")
        .join(others("later", "_later"), "object_class").filter(F.col("earlier_observation") < F.col("later_observation"))
        .withColumn("lb", fan("_later")).select(*keys, *payload)
    )
    right = (
        rows.withColumnRenamed("observation", "later_observation").withColumnRenamed("_block", "lb")
        .join(others("earlier", "_earlier"), "object_class").filter(F.col("earlier_observation") < F.col("later_observation"))
        .withColumn("eb", fan("_earlier")).select(*keys, *payload)
    )

    def meet(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [part.split(" ")[0] for part in _PAIR_SCHEMA.split(", ")]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        scores = _score_block(a, b)
        total = scores["association_score"]
        flat = total.ravel()
        if len(flat) > top:
            cut = np.partition(flat, len(flat) - top)[len(flat) - top]
            picked = np.flatnonzero(flat >= cut)
        else:
            picked = np.arange(len(flat))
        i, j = np.divmod(picked, len(b))
        made = {name: values[i, j] for name, values in scores.items()}
        made |= {
            "earlier_ord": a["ord"].to_numpy()[i], "later_ord": b["ord"].to_numpy()[j],
            "earlier_detection_id": a["detection_id"].to_numpy()[i], "later_detection_id": b["detection_id"].to_numpy()[j],
        }
        pairs = pd.DataFrame(made).sort_values(["association_score", "earlier_ord", "later_ord"], ascending=[False, True, True]).head(top)
        totals = pd.DataFrame({"pair_count": [total.size], "score_sum": [total.sum()], "association_score": [total.max()]})
        out = pd.concat([pairs, totals], ignore_index=True)
        out["object_class"], out["earlier_observation"], out["later_observation"] = key[0], key[1], key[2]
        out = out.reindex(columns=names)
        for name in ("earlier_ord", "later_ord", "pair_count"):
            out[name] = out[name].astype("Int64")
        return out

    scored = left.groupBy(*keys).cogroup(fresh(right).groupBy(*keys)).applyInPandas(meet, _PAIR_SCHEMA)
    scored = cut_lineage(scored, "pairs")  # read for the pairs and for the totals
    group = ["earlier_observation", "later_observation", "object_class"]
    order = Window.partitionBy(*group).orderBy(F.col("association_score").desc(), "earlier_ord", "later_ord")
    pairs = (
        scored.filter(F.col("pair_count").isNull()).drop("pair_count", "score_sum")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        .withColumn("pair_id", F.concat_ws("__", "earlier_detection_id", "later_detection_id"))
        .withColumn("association_status", association_status(F.col("association_score")))
        .withColumn("movement_status", movement_status(F.col("association_score"), F.col("centroid_distance_m")))
    )
    totals = scored.filter(F.col("pair_count").isNotNull()).groupBy(*group).agg(
        F.sum("pair_count").alias("pair_count"), F.max("association_score").alias("best_score"), (F.sum("score_sum") / F.sum("pair_count")).alias("mean_score")
    )
    return pairs, totals


def pair_review(pairs: DataFrame, detections: DataFrame, judgments: DataFrame, object_class: str | None = None) -> DataFrame:
    """Pairs with both detections and the optional judgment."""
    rows = pairs if object_class is None else pairs.filter(F.col("object_class") == object_class)
    side = lambda p: detections.select(
        F.col("detection_id").alias(f"{p}_detection_id"), F.col("score").alias(f"{p}_score"), F.col("mask_score").alias(f"{p}_mask_score")
    )
    return rows.join(side("earlier"), "earlier_detection_id").join(side("later"), "later_detection_id").join(
        judgments.select("pair_id", F.col("verdict").alias("vlm_verdict")), "pair_id", "left"
    )


def best_per_label(detections: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Highest-score detection per key; the first of equals in the numeric ``order``.  A key
    ``label`` is normalised first."""
    if "label" in keys:
        detections = detections.withColumn("label", normalise_label(F.col("label")))
    columns = [c for c in detections.columns if c not in keys]
    first = F.struct("score", *[(-c).alias(f"o{i}") for i, c in enumerate(order)])
    best = detections.groupBy(*keys).agg(F.max_by(F.struct(*columns), first).alias("_b"))
    return best.select(*keys, "_b.*")


def substrings(text: Column) -> Column:
    """All distinct substrings of a short name."""
    size = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(starts, lambda a: F.transform(F.sequence(a, F.greatest(size, a)), lambda z: F.substring(text, a, z - a + 1)))))


def visibility(prompts: DataFrame, detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Per prompt: frames that show a matching label, best score and status.

    Labels and prompts are normalised and reduced to distinct values.  One holds the other when it
    is a substring of it, so each side is joined by equality with the other's substrings.
    """
    detections = detections.withColumn("label", normalise_label(F.col("label")))
    prompts = prompts.select(normalise_label(F.col("prompt")).alias("prompt")).distinct()
    labels = detections.select("label").distinct()
    inside = prompts.join(labels.select("label", F.explode(substrings(F.col("label"))).alias("prompt")), "prompt")
    around = prompts.select("prompt", F.explode(substrings(F.col("prompt"))).alias("label")).join(labels, "label")
    linked = inside.select("prompt", "label").unionByName(around.select("prompt", "label")).distinct()
    seen = detections.join(linked, "label").groupBy("prompt", "frame_id").agg(F.max("score").alias("s"))
    seen = seen.groupBy("prompt").agg(F.count("*").alias("frames_visible"), F.max("s").alias("max_score"))
    return (
        prompts.join(seen, "prompt", "left").withColumn("frame_count", frames.agg(F.count("*")).scalar())
        .withColumn("frames_visible", F.coalesce("frames_visible", F.lit(0).cast("long")))
        .withColumn("max_score", F.coalesce("max_score", F.lit(0.0)))
        .withColumn("status", visibility_status(F.col("frame_count"), F.col("frames_visible")))
    )


def frame_tracks(detections: DataFrame, group: list[str], threshold: float = 0.25) -> DataFrame:
    """Same label in the frame just before with enough overlap continues a track.

    ``detections``: one row per ``group, label, frame_no``.  The frame before is an
    equality on ``frame_no``; track numbers are a running sum over frame buckets.
    """
    keys = [*group, "label"]
    before = detections.select(*keys, (F.col("frame_no") + 1).alias("frame_no"), F.col("box").alias("_before"))
    opened = detections.join(before, [*keys, "frame_no"], "left").withColumn(
        "_new", F.when(F.col("_before").isNotNull() & (box_iou(F.col("box"), F.col("_before")) > threshold), 0).otherwise(1)
    )
    numbered = running(opened, keys, [F.col("frame_no")], F.floor(F.col("frame_no") / 4096), [Running("_track", "sum", F.col("_new"))])
    return numbered.withColumn("track_id", F.concat_ws("-", "label", F.col("_track").cast("string"))).drop("_before", "_new", "_track")


def tighten_boxes(detections: DataFrame, pixels: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """Replace a normalised box by its mask's when that is below 95 % of its area."""
    tight = pixels.groupBy(key).agg(
        F.array(F.min("px") / width, F.min("py") / height, (F.max("px") + 1) / width, (F.max("py") + 1) / height).alias("_tight")
    )
    joined = detections.join(tight, key, "left")
    smaller = F.col("_tight").isNotNull() & (area(F.col("_tight")) > 0) & (area(F.col("_tight")) < area(F.col("box_normalized")) * 0.95)
    return joined.withColumn("tightened", smaller).withColumn(
        "box_normalized", F.when(smaller, F.col("_tight")).otherwise(F.col("box_normalized"))
    ).drop("_tight")
