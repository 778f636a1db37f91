"""Object-evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import boxes as bx
from evidex.functions.vectors import dot, l2_normalize
from evidex.operators import objects as ob
from evidex.plans.registry import query
from evidex.plans.relations import raw_detections, relation, table

WIDTH, HEIGHT = 60, 40

_CANON = """c as (select *, case when contains(phrase, 'chair') then 'chair' when contains(phrase, 'bin') then 'waste_bin' when contains(phrase, 'box') then 'box' end as canonical_class,
  least(greatest(x1, 0), 60) as bx1, least(greatest(y1, 0), 40) as by1, least(greatest(x2, 0), 60) as bx2, least(greatest(y2, 0), 40) as by2,
  concat_ws(':', src_order, l_partkey, l_suppkey) as row_id from raw_detections)"""


def _iou(a: str, b: str, names: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> str:
    x1, y1, x2, y2 = names
    inter = f"(greatest(0, least({a}.{x2}, {b}.{x2}) - greatest({a}.{x1}, {b}.{x1})) * greatest(0, least({a}.{y2}, {b}.{y2}) - greatest({a}.{y1}, {b}.{y1})))"
    area = lambda t: f"(greatest(0, {t}.{x2} - {t}.{x1}) * greatest(0, {t}.{y2} - {t}.{y1}))"
    return f"(case when {area(a)} + {area(b)} - {inter} > 0 then {inter} / ({area(a)} + {area(b)} - {inter}) else 0 end)"


@query("h01_canonical_class", f"with {_CANON} select frame_id, row_id, canonical_class from c", "raw_detections")
def h01(spark, sf):
    return raw_detections(spark, sf).select(
        "frame_id", F.concat_ws(":", "src_order", "l_partkey", "l_suppkey").alias("row_id"), bx.canonical_class(F.col("phrase")).alias("canonical_class")
    )


@query(
    "h02_clamp_box",
    f"with {_CANON} select frame_id, row_id, bx1, by1, bx2, by2 from c where bx2 > bx1 and by2 > by1",
    "raw_detections",
)
def h02(spark, sf):
    box = bx.clamp_box(F.col("box"), F.lit(WIDTH), F.lit(HEIGHT))
    made = raw_detections(spark, sf).select("frame_id", F.concat_ws(":", "src_order", "l_partkey", "l_suppkey").alias("row_id"), box.alias("b")).filter(F.col("b").isNotNull())
    return made.select("frame_id", "row_id", *[F.element_at("b", i + 1).alias(n) for i, n in enumerate(("bx1", "by1", "bx2", "by2"))])


@query(
    "h03_box_iou",
    f"""with d as (select *, row_number() over (partition by frame_no order by src_order, l_partkey, l_suppkey, score, x1) as n from raw_detections)
select a.frame_id, a.n, round({_iou('a', 'b')}, 6) as iou from d a join d b on b.frame_no = a.frame_no and b.n = a.n + 1""",
    "raw_detections",
)
def h03(spark, sf):
    """Each detection beside the next one of its frame."""
    from pyspark.sql import Window

    order = Window.partitionBy("frame_no").orderBy("src_order", "l_partkey", "l_suppkey", "score", "x1")
    rows = raw_detections(spark, sf).withColumn("n", F.row_number().over(order)).withColumn("next_box", F.lead("box").over(order))
    return rows.filter(F.col("next_box").isNotNull()).select("frame_id", "n", F.round(bx.box_iou(F.col("box"), F.col("next_box")), 6).alias("iou"))


_NMS = f"""{_CANON},
k as (select *, row_number() over (partition by frame_id, canonical_class order by score desc, src_order, l_partkey, l_suppkey) as place from c where canonical_class is not null and bx2 > bx1 and by2 > by1),
fold as (select distinct frame_id, canonical_class, 0::bigint as step, []::struct(r bigint, x1 double, y1 double, x2 double, y2 double)[] as kept from k
  union all select f.frame_id, f.canonical_class, f.step + 1, case when len(list_filter(f.kept, lambda g: {_iou('g', 'k').replace('k.x1', 'k.bx1').replace('k.y1', 'k.by1').replace('k.x2', 'k.bx2').replace('k.y2', 'k.by2')} > 0.5)) > 0 then f.kept
     else list_append(f.kept, {{'r': k.place, 'x1': k.bx1, 'y1': k.by1, 'x2': k.bx2, 'y2': k.by2}}) end
  from fold f join k on k.frame_id = f.frame_id and k.canonical_class = f.canonical_class and k.place = f.step + 1),
last_ as (select frame_id, canonical_class, arg_max(kept, step) as kept from fold group by 1, 2),
sel as (select frame_id, canonical_class, unnest(list_transform(kept, lambda g: g.r)) as place from last_),
nms as (select * from (select k.*, row_number() over (partition by k.frame_id order by k.score desc, k.src_order, k.l_partkey, k.l_suppkey) as rank from k join sel using (frame_id, canonical_class, place)) where rank <= 20),
det as (select *, concat(frame_id, ':det-', lpad(rank::varchar, 2, '0')) as detection_id from nms)"""


def detections(spark, sf):
    """Kept detections with ids and normalised boxes."""
    found = ob.candidates(raw_detections(spark, sf), WIDTH, HEIGHT).select(
        "frame_id", "canonical_class", "score", "box", "src_order", "l_partkey", "l_suppkey"
    )
    order = [F.col("score").desc(), F.col("src_order"), F.col("l_partkey"), F.col("l_suppkey")]
    kept = ob.class_nms(found, "frame_id", order)
    row_id = F.concat_ws(":", "src_order", "l_partkey", "l_suppkey")
    return ob.detection_ids(kept, WIDTH, HEIGHT).withColumn("row_id", row_id)


@query(
    "h04_class_nms",
    f"""with recursive {_NMS}, r as (select frame_id, count(*) as raw_count from raw_detections group by 1), n as (select frame_id, count(*) as kept_count, string_agg(row_id, ',' order by rank) as kept from nms group by 1)
select frame_id, raw_count, coalesce(kept_count, 0) as kept_count, raw_count - coalesce(kept_count, 0) as rejected_count, kept from r left join n using (frame_id)""",
    "raw_detections",
)
def h04(spark, sf):
    raw, kept = raw_detections(spark, sf), detections(spark, sf)
    order = F.transform(F.sort_array(F.collect_list(F.struct("rank", "row_id"))), lambda r: r["row_id"])
    names = kept.groupBy("frame_id").agg(F.array_join(order, ",").alias("kept"))
    return ob.rejected_counts(raw, kept, "frame_id").join(names, "frame_id", "left")


@query(
    "h05_detection_ids",
    f"with recursive {_NMS} select detection_id, canonical_class, score, round(bx1 / 60, 6) as nx1, round(by2 / 40, 6) as ny2 from det",
    "raw_detections",
)
def h05(spark, sf):
    at = lambda i: F.round(F.element_at("box_normalized", i), 6)
    return detections(spark, sf).select("detection_id", "canonical_class", "score", at(1).alias("nx1"), at(4).alias("ny2"))


@query(
    "h06_mask_stats",
    """with s as (select detection_no, count(*) / 2400.0::double as f from (select distinct detection_no, px, py from mask_pixels) group by 1)
select detection_no, round(f, 7) as mask_area_fraction, concat_ws(',', case when f < 0.001 then 'tiny_mask' end, case when f > 0.6 then 'large_mask' end) as warnings from s""",
    "mask_pixels",
)
def h06(spark, sf):
    made = ob.mask_stats(relation(spark, sf, "mask_pixels"), "detection_no", WIDTH, HEIGHT)
    return made.select("detection_no", F.round("mask_area_fraction", 7).alias("mask_area_fraction"), F.array_join("warnings", ",").alias("warnings"))


def frames(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("frame_id"), F.col("o_orderkey").alias("frame_no"), (F.col("o_orderkey") % 4).alias("observation")
    )


@query(
    "h07_localization_summary",
    f"""with recursive {_NMS}, fr as (select concat('f', o_orderkey) as frame_id, o_orderkey % 4 as observation from orders), n as (select frame_id, count(*) as n from nms group by 1), j as (select * from fr left join n using (frame_id))
select 'frame_count' as metric, '' as key, count(*) as value from j union all select 'frames_with_detections', '', count(n) from j union all select 'empty_frame_count', '', count(*) - count(n) from j
union all select 'detection_count', '', sum(n) from j union all select 'frames_per_observation', observation::varchar, count(*) from fr group by observation
union all select 'class_count', canonical_class, count(*) from nms group by canonical_class
union all select 'rejected_detection_count', '', (select count(*) from raw_detections) - (select count(*) from nms)""",
    "raw_detections",
)
def h07(spark, sf):
    kept = detections(spark, sf)
    return ob.localization_summary(frames(spark, sf), kept, ob.rejected_counts(raw_detections(spark, sf), kept, "frame_id"))


_AUDIT = f"""{_NMS},
j as (select *, ['supported', 'uncertain', 'unsupported'][(l_partkey + l_suppkey) % 3 + 1] as verdict, ['good', 'partial', 'excessive', 'uncertain'][l_partkey % 4 + 1] as mask_quality from det where l_suppkey % 2 = 0),
fr as (select concat('f', o_orderkey) as frame_id, o_orderkey % 4 as observation, o_orderkey % 3 <> 0 as reviewed, o_custkey % 5 = 0 as missed, ['chair', 'waste_bin', 'box'][o_custkey % 3 + 1] as missed_class from orders),
ad as (select d.*, coalesce(j.verdict, 'unreviewed') as audit_status from det d left join j using (detection_id)),
gal as (select fr.frame_id, observation, case when reviewed then 'reviewed' else 'unreviewed' end as review, case when reviewed and missed then missed_class else '' end as missed from fr)"""


def judgments(kept):
    """Reviews of every second supplier's detections."""
    verdict = F.element_at(F.array(F.lit("supported"), F.lit("uncertain"), F.lit("unsupported")), ((F.col("l_partkey") + F.col("l_suppkey")) % 3 + 1).cast("int"))
    quality = F.element_at(F.array(F.lit("good"), F.lit("partial"), F.lit("excessive"), F.lit("uncertain")), (F.col("l_partkey") % 4 + 1).cast("int"))
    return kept.filter(F.col("l_suppkey") % 2 == 0).select("detection_id", verdict.alias("verdict"), quality.alias("mask_quality"))


def frame_audits(spark, sf):
    orders = table(spark, sf, "orders")
    kind = F.element_at(F.array(F.lit("chair"), F.lit("waste_bin"), F.lit("box")), (F.col("o_custkey") % 3 + 1).cast("int"))
    missed = F.when(F.col("o_custkey") % 5 == 0, F.array(kind)).otherwise(F.array().cast("array<string>"))
    return orders.filter(F.col("o_orderkey") % 3 != 0).select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("frame_id"), missed.alias("missed_visible_classes"))


@query(
    "h08_audit_reduce",
    f"""with recursive {_AUDIT} select 'verdict' as metric, '' as key, verdict, count(*)::double as value from j group by verdict union all select 'mask_quality', mask_quality, '', count(*) from j group by mask_quality
union all select 'class_verdict', canonical_class, verdict, count(*) from j group by canonical_class, verdict union all select 'missed', missed, '', count(*) from gal where missed <> '' group by missed
union all select 'support_rate', '', '', round(sum((verdict = 'supported')::int)::double / sum((verdict <> 'uncertain')::int), 6) from j where score >= 0.35""",
    "raw_detections",
)
def h08(spark, sf):
    kept = detections(spark, sf)
    missed = frame_audits(spark, sf).select(F.explode("missed_visible_classes").alias("missed_class"))
    return ob.audit_reduce(judgments(kept), kept, missed).withColumn("value", F.round("value", 6))


def gallery(spark, sf):
    kept = detections(spark, sf)
    audited = ob.audited_detections(kept, judgments(kept))
    return ob.frame_gallery(frames(spark, sf).drop("frame_no"), audited, frame_audits(spark, sf))


_SHOW = lambda name: F.array_join(F.transform(name, lambda d: F.concat_ws(":", d["rank"].cast("string"), d["canonical_class"], d["audit_status"])), ",")


@query(
    "h09_frame_gallery",
    f"""with recursive {_AUDIT}, n as (select frame_id, string_agg(concat_ws(':', rank, canonical_class, audit_status), ',' order by rank) as detections from ad group by 1)
select frame_id, observation, review, missed, coalesce(detections, '') as detections from gal left join n using (frame_id)""",
    "raw_detections",
)
def h09(spark, sf):
    return gallery(spark, sf).select("frame_id", "observation", "review", F.array_join("missed_visible_classes", ",").alias("missed"), _SHOW("detections").alias("detections"))


@query(
    "h10_detection_filter",
    f"""with recursive {_AUDIT} select g.frame_id, string_agg(concat_ws(':', rank, canonical_class, audit_status), ',' order by rank) as shown from gal g join ad using (frame_id)
 where score >= 0.35 and canonical_class = 'chair' and audit_status = 'supported' and g.observation = 2 group by 1""",
    "raw_detections",
)
def h10(spark, sf):
    made = ob.gallery_filter(gallery(spark, sf), 0.35, "chair", "supported", 2)
    return made.select("frame_id", _SHOW("shown").alias("shown"))


@query(
    "h11_failure_frames",
    f"""with recursive {_AUDIT}, b as (select distinct frame_id from ad where audit_status in ('unsupported', 'uncertain')) select g.frame_id from gal g left join b using (frame_id) where g.missed <> '' or b.frame_id is not null""",
    "raw_detections",
)
def h11(spark, sf):
    return ob.failure_frames(gallery(spark, sf)).select("frame_id")


_BIN = "(least((r + 8) // 16, 15) * 256 + least((g + 8) // 16, 15) * 16 + least((b + 8) // 16, 15))"
_LINK = f"""mp as (select *, row_number() over (partition by detection_no order by px_order) - 1 as place, count(*) over (partition by detection_no) as n from mask_pixels),
mb as (select distinct detection_no, frame_no, {_BIN} as bin from mp where place % greatest(1, n // 2048) = 0),
ln as (select m.detection_no, p.* from points p join mb m on m.frame_no = p.frame_no and m.bin = least((p.r + 8) // 16, 15) * 256 + least((p.g + 8) // 16, 15) * 16 + least((p.b + 8) // 16, 15))"""


def linked(spark, sf):
    return ob.color_bin_link(relation(spark, sf, "mask_pixels"), relation(spark, sf, "points"))


@query("h12_color_bin_link", f"with {_LINK} select detection_no, frame_no, l_orderkey, l_linenumber, l_partkey, l_suppkey from ln", "mask_pixels points")
def h12(spark, sf):
    return linked(spark, sf).select("detection_no", "frame_no", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "h13_robust_extent",
    f"""with {_LINK}, e as (select detection_no, count(*) as n, {', '.join(f"quantile_cont({a}, 0.05) as min_{a}, quantile_cont({a}, 0.5) as centre_{a}, quantile_cont({a}, 0.95) as max_{a}" for a in 'xyz')} from ln group by 1),
d as (select distinct detection_no from mask_pixels)
select d.detection_no, coalesce(n, 0) as point_count, {', '.join(f"round({s}_{a}, 5) as {s}_{a}" for a in 'xyz' for s in ('min', 'centre', 'max'))} from d left join e using (detection_no)""",
    "mask_pixels points",
)
def h13(spark, sf):
    known = relation(spark, sf, "mask_pixels").select("detection_no").distinct()
    made = ob.robust_extent(linked(spark, sf), known, "detection_no")
    return made.select("detection_no", "point_count", *[F.round(f"{s}_{a}", 5).alias(f"{s}_{a}") for a in "xyz" for s in ("min", "centre", "max")])


@query(
    "h14_rgbd_summary",
    f"""with {_LINK}, d as (select distinct detection_no from mask_pixels) select (select count(distinct frame_no) from points) as frame_count, (select count(*) from d) as detection_count, (select count(*) from d) as evidence_count,
  (select count(distinct detection_no) from ln) as nonempty_evidence_count""",
    "mask_pixels points",
)
def h14(spark, sf):
    known = relation(spark, sf, "mask_pixels").select("detection_no").distinct()
    counts = linked(spark, sf).groupBy("detection_no").agg(F.count("*").alias("point_count"))
    evidence = known.join(counts, "detection_no", "left")
    return ob.rgbd_summary(relation(spark, sf, "points").select("frame_no").distinct(), known, evidence)


def sightings(spark, sf):
    """Object evidence rows; a lost one has no centroid."""
    rows = relation(spark, sf, "sightings")
    gone = lambda n: F.when(~F.col("lost"), F.col(n)).alias(n)
    keep = [c for c in rows.columns if c not in ("cx", "cy", "cz", "lost", "embedding")]
    return ob.with_quality(rows.select(*keep, gone("cx"), gone("cy"), gone("cz"), F.col("embedding").alias("vector")))


@query(
    "h15_visit_comparison",
    """with b as (select observation, object_class, arg_max(detection_id, {'p': point_count, 'o': -ord}) as d, max(point_count) as p from sightings group by 1, 2)
select a.object_class, a.observation as earlier_observation, b.observation as later_observation, a.d as earlier_detection_id, a.p as earlier_point_count, b.d as later_detection_id, b.p as later_point_count
from b a join b on a.object_class = b.object_class and a.observation < b.observation""",
    "sightings",
)
def h15(spark, sf):
    return ob.visit_comparison(sightings(spark, sf))


_QUALITY = "score * mask_score * (0.5 + 0.5 * least(1.0, ln(1 + point_count) / ln(501)))"


@query("h16_quality_score", f"select detection_id, round({_QUALITY}, 6) as quality from sightings", "sightings")
def h16(spark, sf):
    return sightings(spark, sf).select("detection_id", F.round("quality", 6).alias("quality"))


_PAIR = f"""s as (select *, {_QUALITY} as quality, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as u from sightings),
pr as (select a.object_class, a.observation as eo, b.observation as lo, a.ord as ea, b.ord as la, a.detection_id as ed, b.detection_id as ld, list_dot_product(a.u, b.u) as app,
   exp(-abs(ln(greatest(a.mask_area_fraction, 0.001) / greatest(b.mask_area_fraction, 0.001)))) as shp, least(1.0, (a.quality + b.quality) / 2) as evi,
   case when a.lost or b.lost then null else sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) + (a.cz-b.cz)*(a.cz-b.cz)) end as dist from s a join s b on {{on}}),
sp as (select *, coalesce(exp(-dist / 2), 0.5) as pos, 0.55 * greatest(0, least(1, (app + 1) / 2)) + 0.15 * shp + 0.15 * evi + 0.15 * coalesce(exp(-dist / 2), 0.5) as total from pr)"""
_ALL_PAIRS = _PAIR.format(on="a.object_class = b.object_class and a.observation < b.observation")


@query(
    "h17_pair_score",
    f"with {_PAIR.format(on='b.ord = a.ord + 1')} select ed, ld, round(app, 6) as appearance, round(shp, 6) as shape, round(evi, 6) as evidence, round(pos, 6) as position, round(total, 6) as score, round(dist, 6) as distance from sp",
    "sightings",
)
def h17(spark, sf):
    """Each sighting beside the next one."""
    rows = sightings(spark, sf).withColumn("vector", l2_normalize(F.col("vector")))
    side = lambda p, shift: rows.select((F.col("ord") + shift).alias("n"), *[F.col(c).alias(f"{p}_{c}") for c in rows.columns])
    both = side("a", 1).join(side("b", 0), "n")
    parts = ob.pair_score("a", "b", dot(F.col("a_vector"), F.col("b_vector")))
    names = dict(zip(parts, ("appearance", "shape", "evidence", "position", "score", "distance")))
    return both.select(F.col("a_detection_id").alias("ed"), F.col("b_detection_id").alias("ld"), *[F.round(v, 6).alias(names[k]) for k, v in parts.items()])


@query(
    "h18_candidate_pairs",
    f"with {_ALL_PAIRS} select eo as earlier_observation, lo as later_observation, object_class, count(*) as pair_count, round(max(total), 6) as best_score, round(avg(total), 6) as mean_score from sp group by 1, 2, 3",
    "sightings",
)
def h18(spark, sf):
    """Every candidate pair is scored; groups report their totals, not pair rows."""
    _, totals = ob.associate(sightings(spark, sf))
    return totals.withColumn("best_score", F.round("best_score", 6)).withColumn("mean_score", F.round("mean_score", 6))


_TOP = f"""{_ALL_PAIRS}, top as (select * from (select *, row_number() over (partition by eo, lo, object_class order by round(total, 9) desc, ea, la) as rank from sp) where rank <= 200)"""


@query("h19_topk_per_group", f"with {_TOP} select eo as earlier_observation, lo as later_observation, object_class, rank, ed as earlier_detection_id, ld as later_detection_id, round(round(total, 9), 6) as association_score from top", "sightings")
def h19(spark, sf):
    pairs, _ = ob.associate(sightings(spark, sf))
    return pairs.select(
        "earlier_observation", "later_observation", "object_class", "rank", "earlier_detection_id", "later_detection_id", F.round("association_score", 6).alias("association_score")
    )


_STATUS = "case when total >= 0.7 then 'likely_same' when total >= 0.5 then 'possible_match' else 'uncertain' end"
_MOVED = "case when total >= 0.7 and dist is not null and dist > 0.5 then 'possible_movement' else 'not_established' end"


@query("h20_pair_status", f"with {_TOP} select concat(ed, '__', ld) as pair_id, {_STATUS} as association_status, {_MOVED} as movement_status from top", "sightings")
def h20(spark, sf):
    pairs, _ = ob.associate(sightings(spark, sf))
    return pairs.select("pair_id", "association_status", "movement_status")


@query(
    "h21_pair_review",
    f"""with {_TOP} select concat(ed, '__', ld) as pair_id, object_class, a.score as earlier_score, b.mask_score as later_mask_score, case when (ea + la) % 4 <> 0 then ['same', 'different', 'unclear'][(ea + la) % 3 + 1] end as vlm_verdict
 from top join (select detection_id, score from sightings) a on a.detection_id = ed join (select detection_id, mask_score from sightings) b on b.detection_id = ld where object_class = 'chair'""",
    "sightings",
)
def h21(spark, sf):
    rows = sightings(spark, sf)
    pairs, _ = ob.associate(rows)
    number = F.col("earlier_ord") + F.col("later_ord")
    verdict = F.element_at(F.array(F.lit("same"), F.lit("different"), F.lit("unclear")), (number % 3 + 1).cast("int"))
    judged = pairs.filter(number % 4 != 0).select("pair_id", verdict.alias("verdict"))
    return ob.pair_review(pairs, rows, judged, "chair").select("pair_id", "object_class", "earlier_score", "later_mask_score", "vlm_verdict")


@query(
    "h22_crop_box",
    """select frame_id, concat_ws(':', src_order, l_partkey, l_suppkey) as row_id, greatest(0, trunc(x1 - (x2 - x1) * 0.08)::int) as cx1, greatest(0, trunc(y1 - (y2 - y1) * 0.08)::int) as cy1,
  least(60, trunc(x2 + (x2 - x1) * 0.08)::int) as cx2, least(40, trunc(y2 + (y2 - y1) * 0.08)::int) as cy2 from raw_detections""",
    "raw_detections",
)
def h22(spark, sf):
    made = raw_detections(spark, sf).select(
        "frame_id", F.concat_ws(":", "src_order", "l_partkey", "l_suppkey").alias("row_id"), bx.crop_box(F.col("box"), F.lit(WIDTH), F.lit(HEIGHT)).alias("b")
    )
    return made.select("frame_id", "row_id", *[F.element_at("b", i + 1).alias(n) for i, n in enumerate(("cx1", "cy1", "cx2", "cy2"))])


_BEST = "best as (select * from (select *, phrase as label, row_number() over (partition by frame_id, phrase order by score desc, src_order, l_partkey, l_suppkey) as rn from raw_detections) where rn = 1)"


def best(spark, sf):
    rows = raw_detections(spark, sf).withColumn("label", F.col("phrase"))
    rows = rows.select("frame_id", "frame_no", "label", "score", "box", "src_order", "l_partkey", "l_suppkey")
    return ob.best_per_label(rows, ["frame_id", "label"], [F.col("src_order"), F.col("l_partkey"), F.col("l_suppkey")])


@query("h23_best_per_label", f"with {_BEST} select frame_id, label, score, src_order, l_partkey from best", "raw_detections")
def h23(spark, sf):
    return best(spark, sf).select("frame_id", "label", "score", "src_order", "l_partkey")


@query(
    "h24_visibility_status",
    f"""with {_BEST}, pm as (select distinct unnest(string_split(phrase, ' ')) as prompt from raw_detections union select distinct lower(c_mktsegment) from customer),
s as (select prompt, count(distinct frame_id) as v, max(score) as m from pm join best b on contains(b.label, pm.prompt) or contains(pm.prompt, b.label) group by 1), t as (select count(*) as n from orders)
select prompt, coalesce(v, 0) as frames_visible, n as frame_count, coalesce(m, 0) as max_score, case when coalesce(v, 0) = 0 then 'not_visibly_confirmed' when v = n then 'supported' when v >= greatest(1, n // 2) then 'partially_visible' else 'unclear' end as status
from pm left join s using (prompt), t""",
    "raw_detections",
)
def h24(spark, sf):
    words = raw_detections(spark, sf).select(F.explode(F.split("phrase", " ")).alias("prompt"))
    others = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("prompt"))
    return ob.visibility(words.unionByName(others).distinct(), best(spark, sf), frames(spark, sf))


@query(
    "h25_frame_tracks",
    f"""with {_BEST}, l as (select *, lag(frame_no) over w as pf, lag(struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2)) over w as p from best window w as (partition by label order by frame_no)),
n as (select *, case when pf = frame_no - 1 and {_iou('l', 'p')} > 0.25 then 0 else 1 end as opens from l)
select frame_id, label, concat(label, '-', sum(opens) over (partition by label order by frame_no)) as track_id from n""",
    "raw_detections",
)
def h25(spark, sf):
    return ob.frame_tracks(best(spark, sf), []).select("frame_id", "label", "track_id")


@query(
    "h26_mask_tight_box",
    """with d as (select c_custkey as detection_no, (c_custkey % 10) / 60.0::double as x1, (c_custkey % 8) / 40.0::double as y1, 0.5 + (c_custkey % 30) / 60.0::double as x2, 0.6 + (c_custkey % 16) / 40.0::double as y2 from customer),
t as (select detection_no, min(px) / 60.0::double as a, min(py) / 40.0::double as b, (max(px) + 1) / 60.0::double as c, (max(py) + 1) / 40.0::double as e from mask_pixels group by 1),
j as (select *, coalesce((c - a) * (e - b) > 0 and (c - a) * (e - b) < (x2 - x1) * (y2 - y1) * 0.95, false) as tightened from d left join t using (detection_no))
select detection_no, tightened, round(case when tightened then a else x1 end, 6) as x1, round(case when tightened then e else y2 end, 6) as y2 from j""",
    "mask_pixels",
)
def h26(spark, sf):
    c = F.col("c_custkey")
    box = F.array(c % 10 / 60, c % 8 / 40, F.lit(0.5) + c % 30 / 60, F.lit(0.6) + c % 16 / 40)
    rows = table(spark, sf, "customer").select(c.alias("detection_no"), box.alias("box_normalized"))
    made = ob.tighten_boxes(rows, relation(spark, sf, "mask_pixels"), "detection_no", WIDTH, HEIGHT)
    at = lambda i: F.round(F.element_at("box_normalized", i), 6)
    return made.select("detection_no", F.coalesce("tightened", F.lit(False)).alias("tightened"), at(1).alias("x1"), at(4).alias("y2"))
