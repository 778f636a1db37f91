"""Pose and place-label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions.poses import quaternion_angle_rad
from evidex.operators import places as pl
from evidex.operators.joins import grown
from evidex.plans.registry import query
from evidex.plans.relations import observations
from evidex.session import cut_lineage

_TRACE = "(2 * (cos({a}.yaw) * cos({b}.yaw) + sin({a}.yaw) * sin({b}.yaw)) + 1)"


def angle_sql(a: str, b: str) -> str:
    return f"degrees(acos(greatest(-1.0, least(1.0, ({_TRACE.format(a=a, b=b)} - 1) / 2))))"


def distance_sql(a: str, b: str) -> str:
    return f"sqrt(({a}.tx-{b}.tx)*({a}.tx-{b}.tx) + ({a}.ty-{b}.ty)*({a}.ty-{b}.ty) + ({a}.tz-{b}.tz)*({a}.tz-{b}.tz))"


def _pairs(spark, sf):
    """Each frame beside the next one."""
    rows = observations(spark, sf)
    left = rows.select("step", F.col("translation").alias("a_translation"), F.col("rotation").alias("a_rotation"), F.col("yaw").alias("a_yaw"))
    right = rows.select(
        (F.col("step") - 1).alias("step"), F.col("translation").alias("b_translation"), F.col("rotation").alias("b_rotation"), F.col("yaw").alias("b_yaw")
    )
    return left.join(right, "step")


@query(
    "f01_pose_columns",
    """
select observation_id, step % 17 <> 0 and step % 19 <> 0 as pose_ok, case when step % 17 <> 0 and step % 19 <> 0 then round(2 * cos(yaw) + 1, 6) end as trace,
  case when step % 17 <> 0 and step % 19 <> 0 then tx end as tx, case when step % 17 <> 0 and step % 19 <> 0 then tz end as tz from observations
""",
    "observations",
)
def f01(spark, sf):
    rows = observations(spark, sf)
    r, t = (lambda i: F.element_at("rotation", i)), (lambda i: F.element_at("translation", i))
    bad = F.when(F.col("step") % 19 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0))
    matrix = F.array(
        F.array(r(1), r(2), r(3), t(1)), F.array(r(4), r(5), r(6), t(2)), F.array(r(7), r(8), r(9), t(3)),
        F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), bad),
    )
    convention = F.when(F.col("step") % 17 == 0, "world_to_camera").otherwise("camera_to_world")
    posed = rows.select("observation_id", F.struct(convention.alias("convention"), matrix.alias("matrix")).alias("camera_pose"))
    made = pl.pose_columns(posed)
    trace = F.element_at("rotation", 1) + F.element_at("rotation", 5) + F.element_at("rotation", 9)
    return made.select(
        "observation_id", "pose_ok", F.round(trace, 6).alias("trace"), F.element_at("translation", 1).alias("tx"), F.element_at("translation", 3).alias("tz")
    )


@query(
    "f02_rotation_error",
    f"select a.step, round({angle_sql('a', 'b')}, 4) as rotation_error_deg from observations a join observations b on b.step = a.step + 1",
    "observations",
)
def f02(spark, sf):
    return pl.with_pose_errors(_pairs(spark, sf), "a", "b").select("step", F.round("rotation_error_deg", 4).alias("rotation_error_deg"))


@query(
    "f03_translation_error",
    f"select a.step, round({distance_sql('a', 'b')}, 7) as translation_error_m from observations a join observations b on b.step = a.step + 1",
    "observations",
)
def f03(spark, sf):
    return pl.with_pose_errors(_pairs(spark, sf), "a", "b").select("step", F.round("translation_error_m", 7).alias("translation_error_m"))


@query(
    "f04_pose_join",
    f"""
with p as (select q.observation_id as q_id, m.observation_id as m_id, {distance_sql('q', 'm')} as d, {angle_sql('q', 'm')} as a
  from observations q join observations m on q.split = 'query' and m.split = 'memory')
select q_id, m_id, round(d, 7) as translation_error_m, round(a, 4) as rotation_error_deg, d <= 0.25 as strict from p where d <= 0.5 and a <= 30
""",
    "observations",
)
def f04(spark, sf):
    rows = observations(spark, sf)
    pairs = pl.pose_join(rows.filter(F.col("split") == "query"), rows.filter(F.col("split") == "memory"), *pl.RELAXED)
    strict = F.col("translation_error_m") <= pl.STRICT[0]
    return pairs.select(
        "q_id", "m_id", strict.alias("strict"), F.round("translation_error_m", 7).alias("translation_error_m"), F.round("rotation_error_deg", 4).alias("rotation_error_deg")
    )


_KEYFRAMES = f"""
o as (select *, row_number() over (partition by sequence_id order by step) as rn from observations),
k as (select sequence_id, rn, step, tx, ty, tz, yaw, true as kept from o where rn = 1
  union all select b.sequence_id, b.rn, b.step, case when f then b.tx else a.tx end, case when f then b.ty else a.ty end, case when f then b.tz else a.tz end, case when f then b.yaw else a.yaw end, f
  from (select a.sequence_id as s, a.rn as r, {distance_sql('a', 'b')} >= {{m}} or {angle_sql('a', 'b')} >= 30 as f from k a join o b on b.sequence_id = a.sequence_id and b.rn = a.rn + 1) x
  join k a on a.sequence_id = x.s and a.rn = x.r join o b on b.sequence_id = x.s and b.rn = x.r + 1)"""


@query(
    "f05_keyframes_by_motion",
    f"with recursive {_KEYFRAMES.format(m=0.5)} select sequence_id, step from k where kept",
    "observations",
)
def f05(spark, sf):
    return pl.keyframes_by_motion(observations(spark, sf).select("sequence_id", "step", "translation", "rotation"), "sequence_id", "step")


@query(
    "f06_keyframes_by_window",
    f"""
with recursive o as (select *, row_number() over (partition by sequence_id order by step) - 1 as i, count(*) over (partition by sequence_id) as n from observations),
b as (select distinct sequence_id, n, unnest(range(12)) as w from o),
r as (select o.*, w from o join b on b.sequence_id = o.sequence_id and o.i >= (w * o.n) // 12 and o.i < ((w + 1) * o.n) // 12),
pick as (select sequence_id, w, step, tx, ty, tz, yaw from r where w = 0 and i = (n // 12) // 2
  union all select sequence_id, w, step, tx, ty, tz, yaw from
  (select m.*, row_number() over (partition by m.sequence_id order by greatest({distance_sql('p', 'm')} / 0.10,
      2 * acos(least(1.0, abs(cos(p.yaw/2) * cos(m.yaw/2) + sin(p.yaw/2) * sin(m.yaw/2)))) / radians(10)) desc, m.i) as rk
   from pick p join r m on m.sequence_id = p.sequence_id and m.w = p.w + 1) where rk = 1)
select sequence_id, step, w as window_no from pick
""",
    "observations",
)
def f06(spark, sf):
    zero = F.lit(0.0)
    rows = observations(spark, sf).select(
        "sequence_id", "step", F.col("translation").alias("translation_m"),
        F.array(zero, zero, F.sin(F.col("yaw") / 2), F.cos(F.col("yaw") / 2)).alias("quaternion_xyzw"),
    )
    return pl.keyframes_by_window(rows, "sequence_id", "step", 12)


@query(
    "f07_quaternion_angle",
    "select a.step, round(2 * acos(least(1.0, abs(cos(a.yaw/2) * cos(b.yaw/2) + sin(a.yaw/2) * sin(b.yaw/2)))), 6) as angle_rad from observations a join observations b on b.step = a.step + 1",
    "observations",
)
def f07(spark, sf):
    quaternion = lambda yaw: F.array(F.lit(0.0), F.lit(0.0), F.sin(F.col(yaw) / 2), F.cos(F.col(yaw) / 2))
    return _pairs(spark, sf).select("step", F.round(quaternion_angle_rad(quaternion("a_yaw"), quaternion("b_yaw")), 6).alias("angle_rad"))


_ZONED = f"""
{_KEYFRAMES.format(m=0.5)},
rep as (select o.observation_id, o.tx, o.ty, o.tz, o.yaw, o.step as rep_order, case when o.step % 3 = 0 then 'unassigned' else concat('zone-', o.sequence_no % 7) end as label
  from k join observations o using (step) where kept),
near as (select q.observation_id, m.label, m.rep_order, {distance_sql('q', 'm')} as d, {angle_sql('q', 'm')} as a from observations q join rep m on m.label <> 'unassigned'),
best as (select observation_id, label from (select *, row_number() over (partition by observation_id order by round((d/0.5)*(d/0.5) + (a/45)*(a/45), 9), rep_order) as rk from near where d <= 0.5 and a <= 45) where rk = 1),
zoned as (select o.observation_id, o.step, coalesce(b.label, 'unassigned') as label from observations o left join best b using (observation_id))"""


def zoned(spark, sf):
    """Every frame with the label of its nearest verified representative."""
    rows = observations(spark, sf)
    kept = pl.keyframes_by_motion(rows.select("sequence_id", "step", "translation", "rotation"), "sequence_id", "step").select("step")
    label = F.when(F.col("step") % 3 == 0, pl.UNASSIGNED).otherwise(F.col("zone"))
    reps = rows.join(kept, "step").select("observation_id", "translation", "rotation", label.alias("label"), F.col("step").alias("rep_order"))
    return pl.propagate_labels(rows, reps)


@query("f08_propagate_labels", f"with recursive {_ZONED} select observation_id, label from zoned", "observations")
def f08(spark, sf):
    return zoned(spark, sf)


def _judgments(spark, sf):
    slug = F.when(F.col("step") % 23 == 0, "zone-x").otherwise(F.col("zone"))
    confidence = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("step") % 3 + 1).cast("int"))
    return observations(spark, sf).select("observation_id", slug.alias("zone_slug"), confidence.alias("confidence"))


def zones(spark, sf):
    return observations(spark, sf).select(F.col("zone").alias("slug")).distinct()


@query(
    "f09_label_gate",
    """
with j as (select observation_id, case when step % 3 = 2 then 'unassigned' when step % 23 = 0 then 'zone-x' else concat('zone-', sequence_no % 7) end as zone_slug from observations)
select observation_id, zone_slug, zone_slug = 'zone-x' as unknown from j
""",
    "observations",
)
def f09(spark, sf):
    gated = pl.gate_labels(_judgments(spark, sf))
    unknown = pl.unknown_labels(gated, zones(spark, sf)).select("observation_id", F.lit(True).alias("unknown"))
    return gated.join(unknown, "observation_id", "left").select("observation_id", "zone_slug", F.coalesce("unknown", F.lit(False)).alias("unknown"))


@query(
    "f10_exact_id_check",
    """
with asked as (select sequence_id, observation_id from observations),
 got as (select sequence_id, observation_id from observations where step % 9 <> 0 union all select sequence_id, observation_id from observations where step % 13 = 0
   union all select sequence_id, concat(observation_id, '?') from observations where step % 31 = 0),
 c as (select sequence_id, observation_id, max(a) as a, sum(g) as g from (select *, 1 as a, 0 as g from asked union all select *, 0, 1 from got) group by 1, 2)
select sequence_id, observation_id, case when g = 0 then 'missing' when a = 0 then 'unexpected' else 'duplicate' end as problem from c where g <> 1 or a = 0
""",
    "observations",
)
def f10(spark, sf):
    keys = ["sequence_id", "observation_id"]
    rows = observations(spark, sf).select(*keys, "step")
    returned = (
        rows.filter(F.col("step") % 9 != 0)
        .unionByName(rows.filter(F.col("step") % 13 == 0))
        .unionByName(rows.filter(F.col("step") % 31 == 0).withColumn("observation_id", F.concat("observation_id", F.lit("?"))))
    )
    return pl.id_mismatches(rows, returned, keys)


@query(
    "f11_assignment_counts",
    f"""with recursive {_ZONED} select label, count(*) as frames, round(count(*) / (select count(*) from zoned)::double, 6) as share, label <> 'unassigned' as used from zoned group by 1""",
    "observations",
)
def f11(spark, sf):
    labels = cut_lineage(zoned(spark, sf), "zoned")  # read three times
    used = pl.used_zones(zones(spark, sf), labels).select(F.col("slug").alias("label"), F.lit(True).alias("used"))
    counts = pl.assignment_counts(labels).join(used, "label", "left")
    return counts.select("label", "frames", F.round("share", 6).alias("share"), F.coalesce("used", F.lit(False)).alias("used"))


@query(
    "f12_zone_views",
    f"""with recursive {_ZONED},
zl as (select concat('zone-', z) as slug from (select distinct sequence_no % 7 as z from observations)),
c as (select slug, count(z.label) as assigned_frame_count from zl left join zoned z on z.label = zl.slug group by 1),
m as (select label as slug, string_agg(observation_id, ',' order by step) as members from (select *, row_number() over (partition by label order by step) as p from zoned) where p <= 12 group by 1)
select slug, assigned_frame_count, members from c left join m using (slug)""",
    "observations",
)
def f12(spark, sf):
    steps = observations(spark, sf).select("observation_id", "step")
    labels = cut_lineage(grown(zoned(spark, sf)).join(steps, "observation_id"), "zoned")  # read twice
    members = pl.zone_members(labels, F.col("step")).groupBy(F.col("label").alias("slug")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "observation_id"))), lambda m: m["observation_id"]), ",").alias("members")
    )
    return pl.zone_list(zones(spark, sf), labels).join(members, "slug", "left")
