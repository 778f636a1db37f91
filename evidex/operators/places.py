"""Camera poses, keyframes and place labels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidex.functions.poses import (
    flatten_rotation, is_camera_pose, quaternion_angle_rad, rotation_error_deg, translation_error_m, translation_of,
)
from evidex.operators.joins import BLOCK_ROWS, fresh, grid_neighbours, grown
from evidex.operators.scan import ordinal
from evidex.session import cut_lineage

STRICT, RELAXED = (0.25, 30.0), (0.50, 30.0)
UNASSIGNED = "unassigned"
ZONE_MEMBERS_SHOWN = 12


def pose_columns(df: DataFrame, pose: str = "camera_pose") -> DataFrame:
    """Flat ``rotation`` and ``translation`` of a pose struct; both null and
    ``pose_ok`` false when it is not a finite camera_to_world 4x4 matrix."""
    matrix = F.col(f"{pose}.matrix")
    ok = is_camera_pose(F.col(f"{pose}.convention"), matrix)
    return (
        df.withColumn("pose_ok", ok)
        .withColumn("rotation", F.when(F.col("pose_ok"), flatten_rotation(matrix)))
        .withColumn("translation", F.when(F.col("pose_ok"), translation_of(matrix)))
    )


def with_pose_errors(df: DataFrame, a: str, b: str) -> DataFrame:
    """Errors between the poses ``{a}_rotation, {a}_translation`` and those of ``b``."""
    return df.withColumn(
        "translation_error_m", translation_error_m(F.col(f"{a}_translation"), F.col(f"{b}_translation"))
    ).withColumn("rotation_error_deg", rotation_error_deg(F.col(f"{a}_rotation"), F.col(f"{b}_rotation")))


def _side(df: DataFrame, prefix: str, extra: list[str]) -> DataFrame:
    return df.select(
        F.col("observation_id").alias(f"{prefix}_id"), F.col("translation").alias(f"{prefix}_translation"),
        F.col("rotation").alias(f"{prefix}_rotation"), *[F.col(c).alias(f"{prefix}_{c}") for c in extra],
    )


def pose_join(
    queries: DataFrame, memory: DataFrame, metres: float, degrees: float, memory_columns: list[str] | None = None,
    copied: str = "left", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pairs within both limits, found through grid cells of the distance limit; ``copied``: the side
    (left: queries) that is copied to the cells around, the one of fewer rows."""
    near = grid_neighbours(
        _side(queries, "q", []), _side(memory, "m", memory_columns or []), "q_translation", "m_translation", metres, copied, block_rows
    )
    # A plain sum first, which drops most candidates for a fraction of the exact test's cost.
    gap = lambda at: F.element_at("q_translation", at).cast("double") - F.element_at("m_translation", at).cast("double")
    square = gap(1) * gap(1) + gap(2) * gap(2) + gap(3) * gap(3)
    errors = with_pose_errors(near.filter(square <= metres * metres * (1 + 1e-9)), "q", "m")
    return errors.filter((F.col("translation_error_m") <= metres) & (F.col("rotation_error_deg") <= degrees)).drop(
        "q_translation", "q_rotation", "m_translation", "m_rotation"
    )


def _pose_gap(t0, r0, t1, r1) -> tuple[float, float]:
    distance = math.sqrt(sum((x - y) ** 2 for x, y in zip(t0, t1)))
    cosine = (sum(x * y for x, y in zip(r0, r1)) - 1.0) / 2.0
    return distance, math.degrees(math.acos(max(-1.0, min(1.0, cosine))))


def keyframes_by_motion(
    df: DataFrame, sequence: str, step: str, metres: float = 0.5, degrees: float = 30.0, chunk_steps: int = 100_000
) -> DataFrame:
    """First row of each sequence, then each row far enough from the last kept one.

    The rule is a chain, so a sequence is cut into chunks of ``chunk_steps`` that
    run in parallel.  Each starts from the last row kept before it; chunks whose
    start changed run again until none does.  The first chunk is right at once and
    a right chunk fixes the next, so the loop ends, as a rule after two rounds
    because chains that keep one common row agree from there on.  A table without
    long sequences takes one lazy pass.
    """
    columns = [sequence, step, "translation", "rotation"]
    rows = df.select(*columns, F.floor(F.col(step) / chunk_steps).cast("long").alias("_chunk"))
    chunks = rows.select(sequence, "_chunk").distinct()
    pose = f"{step} long, translation array<double>, rotation array<double>"
    id_type = df.schema[sequence].dataType.simpleString()
    schema = f"{sequence} {id_type}, _chunk long, {pose}, kept boolean"

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(step, kind="stable")
        kept, last = [], None
        first = part.iloc[0]
        if first["_t"] is not None:
            last = (first["_t"], first["_r"])
        for t, r in zip(part["translation"], part["rotation"]):
            keep = last is None
            if not keep:
                distance, angle = _pose_gap(last[0], last[1], t, r)
                keep = distance >= metres or angle >= degrees
            kept.append(keep)
            if keep:
                last = (t, r)
        out = part[[sequence, "_chunk", step, "translation", "rotation"]].assign(kept=kept)
        return out[out["kept"]]

    def run(entries: DataFrame) -> DataFrame:
        started = rows.join(entries, [sequence, "_chunk"])
        return started.groupBy(sequence, "_chunk").applyInPandas(fold, schema)

    nothing = F.lit(None).cast("array<double>")
    entries = chunks.select(sequence, "_chunk", nothing.alias("_t"), nothing.alias("_r"))
    long_ones = chunks.groupBy(sequence).count().filter(F.col("count") > 1)
    if long_ones.isEmpty():
        return run(entries).select(sequence, step)

    previous = Window.partitionBy(sequence).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    result = cut_lineage(run(entries), "keyframes")
    while True:
        exits = result.groupBy(sequence, "_chunk").agg(
            F.max_by(F.struct("translation", "rotation", step), F.col(step)).alias("_exit")
        )
        carried = chunks.join(exits, [sequence, "_chunk"], "left").select(
            sequence, "_chunk", F.last("_exit", ignorenulls=True).over(previous).alias("_in")
        )
        wanted = cut_lineage(
            carried.select(sequence, "_chunk", F.col("_in.translation").alias("_t"), F.col("_in.rotation").alias("_r")), "entries"
        )
        known = entries.select(sequence, "_chunk", F.struct("_t", "_r").alias("_old"))
        changed = wanted.join(known, [sequence, "_chunk"]).filter(~F.col("_old").eqNullSafe(F.struct("_t", "_r"))).drop("_old")
        if changed.isEmpty():
            return result.select(sequence, step)
        untouched = result.join(changed.select(sequence, "_chunk"), [sequence, "_chunk"], "left_anti")
        result = cut_lineage(untouched.unionByName(run(changed)), "keyframes")
        entries = wanted


def keyframes_by_window(df: DataFrame, group: str, index: str, count: int) -> DataFrame:
    """One pose-diverse row per equal index window: the middle of the first window,
    then the row farthest from the previous pick (the lower index on a tie).

    One aggregate per window over all groups, so that all tasks share a window's rows.
    A group of at most ``count`` rows gives all of them.
    """
    order = [F.col(index)]
    placed = ordinal(df, [group], order, F.floor(F.col(index) / 65536), "_place")
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    # The boundaries are whole parts of w*n/count, so the last w at or below a place is its window.
    window_no = F.floor(((F.col("_place") + 1) * count - 1) / F.col("_n"))
    rows = cut_lineage(
        placed.join(sizes, group).withColumn("_window", window_no)
        .select(group, index, "_place", "_n", "_window", "translation_m", "quaternion_xyzw"),
        "windows",
    )
    few = rows.filter(F.col("_n") <= count).select(group, index, F.col("_place").alias("window_no"))
    return few.unionByName(_pick_large(rows.filter(F.col("_n") > count), group, index, count))


def _pick_large(rows: DataFrame, group: str, index: str, count: int) -> DataFrame:
    """Keyframes of large groups, one window of all of them at a time."""
    pose = F.struct(F.col(index).alias("i"), F.col("translation_m").alias("t"), F.col("quaternion_xyzw").alias("q"))
    middle = F.floor(F.floor(F.col("_n") / count) / 2)
    last = cut_lineage(
        rows.filter((F.col("_window") == 0) & (F.col("_place") == middle)).select(group, pose.alias("_last")), "pick"
    )
    picks = last.select(group, F.col("_last.i").alias(index), F.lit(0).cast("long").alias("window_no"))
    for window in range(1, count):
        gap = F.greatest(
            translation_error_m(F.col("translation_m"), F.col("_last.t")) / 0.10,
            quaternion_angle_rad(F.col("quaternion_xyzw"), F.col("_last.q")) / math.radians(10),
        )
        ranked = rows.filter(F.col("_window") == window).join(last, group)
        last = cut_lineage(
            ranked.groupBy(group).agg(F.max_by(pose, F.struct(gap.alias("g"), (-F.col("_place")).alias("p"))).alias("_last")), "pick"
        )
        picks = picks.unionByName(last.select(group, F.col("_last.i").alias(index), F.lit(window).cast("long").alias("window_no")))
    return picks


_ORDERS = 10**20  # above every shifted order of a representative
FEW_REPRESENTATIVES = 4096  # up to which records meet them at the whole distance at once


def _shares(representatives: int) -> list[float]:
    """The shares of the limits at which records meet so many representatives, doubled up to one.  At the
    first a record meets about as many whatever their number, if they fill a space of poses."""
    halvings = round(math.log2(representatives) / 4) - 1 if representatives > FEW_REPRESENTATIVES else 0
    return [0.5**i for i in range(halvings, -1, -1)]


def propagate_labels(
    records: DataFrame, representatives: DataFrame, metres: float = 0.5, degrees: float = 45.0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Label of the qualifying representative with the least joint cost, the first of equal ones.

    ``representatives``: ``observation_id, translation, rotation, label, rep_order``.  Cost (at nine
    digits) and order are packed into one number, whose running minimum per record is kept while pairs are
    made; only that is shuffled.  Many representatives are met in rounds of growing distance: within a share
    of both limits lie all whose cost is below its square, so a record that finds such a one is done, and
    the next round has the others only.  The side of fewer rows is copied to the cells around.
    """
    labelled = representatives.filter(F.coalesce("label", F.lit(UNASSIGNED)) != UNASSIGNED)
    # Every round reads the representatives.
    labelled = cut_lineage(labelled.select("translation", "rotation", "label", "rep_order"), "representatives")
    held = labelled.select(F.col("rep_order").alias("observation_id"), "translation", "rotation")
    left = records.select("observation_id", "translation", "rotation").filter(F.col("observation_id").isNotNull())
    wide = lambda c: c.cast("decimal(38,0)")
    orders, shift = wide(F.lit(str(_ORDERS))), wide(F.lit(2**63 - 1))
    cost = F.pow(F.col("translation_error_m") / metres, 2) + F.pow(F.col("rotation_error_deg") / degrees, 2)
    packed = wide(F.round(cost * 1e9).cast("long")) * orders + wide(F.col("m_id").cast("long")) + shift
    many, found, copied = labelled.count(), None, "right"
    for share in _shares(many):
        near = pose_join(left, fresh(held), metres * share, degrees * share, None, copied, block_rows)
        best = near.groupBy(F.col("q_id").alias("observation_id")).agg(F.min(packed).alias("_best"))
        if share < 1:
            # Those left out cost more than the share's square: a smaller cost is the least.
            sure = wide(F.lit(str(int(share * share * 1e9) - 10))) * orders
            best = cut_lineage(best.filter(F.col("_best") < sure), "labelled")
            left = cut_lineage(grown(left).join(fresh(best).select("observation_id"), "observation_id", "left_anti"), "unlabelled")
            copied = "left" if left.count() < many else "right"
        found = best if found is None else found.unionByName(best)
    best = found.select("observation_id", (F.col("_best") % orders - shift).cast("long").alias("rep_order"))
    labels = labelled.groupBy(F.col("rep_order").cast("long").alias("rep_order")).agg(F.min("label").alias("label"))
    found = grown(best).join(labels, "rep_order").select("observation_id", "label")
    return grown(records.select("observation_id")).join(found, "observation_id", "left").withColumn(
        "label", F.coalesce("label", F.lit(UNASSIGNED))
    )


def gate_labels(judgments: DataFrame) -> DataFrame:
    """Low-confidence judgments count as unassigned."""
    return judgments.withColumn(
        "zone_slug", F.when(F.col("confidence") == "low", UNASSIGNED).otherwise(F.col("zone_slug"))
    )


def unknown_labels(gated: DataFrame, zones: DataFrame) -> DataFrame:
    known = zones.select(F.col("slug").alias("zone_slug"))
    return gated.filter(F.col("zone_slug") != UNASSIGNED).join(known, "zone_slug", "left_anti")


def id_mismatches(requested: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    """Ids missing from, unknown to or repeated in a response, in one shuffle."""
    sides = requested.select(*keys).distinct().withColumn("_asked", F.lit(1)).withColumn("_got", F.lit(0)).unionByName(
        returned.select(*keys).withColumn("_asked", F.lit(0)).withColumn("_got", F.lit(1))
    )
    problem = (
        F.when(F.col("_got") == 0, "missing").when(F.col("_asked") == 0, "unexpected").when(F.col("_got") > 1, "duplicate")
    )
    return (
        sides.groupBy(*keys).agg(F.max("_asked").alias("_asked"), F.sum("_got").alias("_got"))
        .withColumn("problem", problem).filter(F.col("problem").isNotNull()).drop("_asked", "_got")
    )


def assignment_counts(assignments: DataFrame) -> DataFrame:
    """Rows and share per label."""
    counts = assignments.groupBy("label").agg(F.count("*").alias("frames"))
    total = assignments.agg(F.count("*")).scalar()
    return counts.withColumn("share", F.col("frames") / total)


def used_zones(zones: DataFrame, assignments: DataFrame) -> DataFrame:
    used = assignments.filter(F.col("label") != UNASSIGNED).select(F.col("label").alias("slug")).distinct()
    return zones.join(used, "slug", "left_semi")


def zone_list(zones: DataFrame, assignments: DataFrame) -> DataFrame:
    counts = assignments.groupBy(F.col("label").alias("slug")).agg(F.count("*").alias("assigned_frame_count"))
    return zones.join(counts, "slug", "left").withColumn(
        "assigned_frame_count", F.coalesce("assigned_frame_count", F.lit(0).cast("long"))
    )


def zone_members(assignments: DataFrame, order: Column, shown: int = ZONE_MEMBERS_SHOWN) -> DataFrame:
    """The first members of every zone in source order."""
    place = F.row_number().over(Window.partitionBy("label").orderBy(order))
    return assignments.withColumn("place", place).filter(F.col("place") <= shown)
