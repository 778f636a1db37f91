"""Window, sampling, interval and target queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import intervals as iv
from evidex.operators import targets as tg, windows as win
from evidex.plans.registry import query
from evidex.plans.relations import (
    annotated_windows, recordings, relation, table, window_actions, windows, with_vectors,
)

ACTION_TEXT = """
select event_id, concat('c', lpad(cast(user_id % 30 as varchar(3)), 3, '0'), ' ', cast(value as varchar(20)), ' ', cast(event_id as varchar(20)),
   case when event_type = 'view' then '' when event_type = 'error' then ';broken 1 2' else
   concat(';c', lpad(cast(event_id % 31 as varchar(3)), 3, '0'), ' ', cast(event_id % 97 as varchar(20)), '.50 ', cast(event_id as varchar(20)), '.75') end) as text
from {events}"""


@query(
    "c01_parse_actions",
    f"""
with t as ({ACTION_TEXT.replace('{events}', 'events')}),
c as (select concat('c', lpad(cast(n_nationkey as varchar(3)), 3, '0')) as action_id, lower(n_name) as name from nation),
f as (select event_id, unnest(regexp_extract_all(text, '(c\\d+)\\s+(\\d+(?:\\.\\d+)?)\\s+(\\d+(?:\\.\\d+)?)', 1)) as action_id,
   unnest(range(len(regexp_extract_all(text, '(c\\d+)\\s+(\\d+(?:\\.\\d+)?)\\s+(\\d+(?:\\.\\d+)?)', 1)))) as pos,
   unnest(regexp_extract_all(text, '(c\\d+)\\s+(\\d+(?:\\.\\d+)?)\\s+(\\d+(?:\\.\\d+)?)', 2))::double as start_s,
   unnest(regexp_extract_all(text, '(c\\d+)\\s+(\\d+(?:\\.\\d+)?)\\s+(\\d+(?:\\.\\d+)?)', 3))::double as end_s from t)
select event_id, pos, action_id, coalesce(name, action_id) as name, start_s, end_s from f left join c using (action_id)
""",
)
def c01(spark, sf):
    text = spark.sql(ACTION_TEXT.replace("{events}", f"parquet.`{sf}/events.parquet`"))
    classes = table(spark, sf, "nation").select(
        F.format_string("c%03d", "n_nationkey").alias("action_id"), F.lower("n_name").alias("name")
    )
    parsed = win.parse_actions(text, "event_id", "text", classes)
    return parsed.select("event_id", F.posexplode("actions").alias("pos", "a")).select(
        "event_id", F.col("pos").cast("long").alias("pos"), "a.*"
    )


@query(
    "c02_hash_sample",
    """
select video_id, split, rank as sample_rank from (
  select *, row_number() over (partition by split order by sha256(concat(case split when 'train' then 42 else 43 end, ':', video_id)), video_id) as rank
  from recordings) where rank <= case split when 'train' then 300 else 100 end
""",
    "recordings",
)
def c02(spark, sf):
    limits = {"train": (300, 42), "test": (100, 43)}
    return win.hash_sample(recordings(spark, sf), "video_id", "split", limits).select("video_id", "split", "sample_rank")


@query(
    "c03_sliding_windows",
    "select window_id, video_id, split, window_no, start_s, end_s, duration_s from windows",
    "windows",
)
def c03(spark, sf):
    made = win.sliding_windows(recordings(spark, sf))
    return made.select("window_id", "video_id", "split", "window_no", "start_s", "end_s", F.col("duration_s").cast("double").alias("duration_s"))


@query(
    "c04_window_action_overlap",
    "select window_id, pos, action_id, start_s, end_s from window_actions",
    "window_actions",
)
def c04(spark, sf):
    return window_actions(spark, sf).select("window_id", "pos", "action_id", "start_s", "end_s")


@query(
    "c05_windows_keep_tail",
    """
with w as (select *, 2.0::double * window_no as start_s, least(2.0::double * window_no + 4, length_s) as end_s from
  (select *, unnest(range(greatest(1, ceil((length_s - 1e-6) / 2))::bigint)) as window_no from recordings))
select printf('%s:%.2f-%.2f', video_id, start_s, end_s) as window_id, start_s, end_s, greatest(0, start_s - 1) as context_start_s,
  least(length_s, end_s + 1) as context_end_s, round(start_s + 0.5 * (end_s - start_s) / 16, 5) as first_frame_s, 16 as frames from w
""",
    "recordings",
)
def c05(spark, sf):
    made = win.windows_keep_tail(recordings(spark, sf))
    return made.select(
        "window_id", "start_s", F.col("end_s").cast("double").alias("end_s"), "context_start_s",
        F.col("context_end_s").cast("double").alias("context_end_s"),
        F.round(F.element_at("frame_timestamps_s", 1), 5).alias("first_frame_s"), F.size("frame_timestamps_s").alias("frames"),
    )


@query(
    "c06_window_timestamps",
    """
select window_id, round(start_s + 0.5 * (end_s - start_s) / 8, 6) as first_s, round(start_s + 7.5 * (end_s - start_s) / 8, 6) as last_s,
  round(8 * (start_s + end_s) / 2, 4) as total_s from windows
""",
    "windows",
)
def c06(spark, sf):
    times = windows(spark, sf).select("window_id", iv.window_timestamps("start_s", "end_s", 8).alias("t"))
    return times.select(
        "window_id", F.element_at("t", 1).alias("first_s"), F.element_at("t", -1).alias("last_s"),
        F.round(F.aggregate("t", F.lit(0.0), lambda a, x: a + x), 4).alias("total_s"),
    )


@query(
    "c07_even_sample",
    """
with p as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as place, count(*) over (partition by user_id) as n from events),
     w as (select distinct user_id, round_even(i * case when k > 1 then (n - 1)::double / (k - 1) else 0 end, 0)::bigint as place from
        (select user_id, n, least(n, 6) as k, unnest(range(least(n, 6))) as i from (select distinct user_id, n from p)))
select user_id, event_id, place as position from p join w using (user_id, place)
""",
)
def c07(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id")
    bucket = F.floor(F.col("event_id") / 65536)
    return win.even_sample(rows, ["user_id"], [F.col("event_id")], bucket, 6)


WINDOW_TEXT_SQL = """
texts as (select w.window_id, coalesce('A person is ' || string_agg(lower(trim(a.name)), ' and ' order by a.pos) || '.', any_value(w.description)) as text,
   count(a.pos) as actions from windows w left join window_actions a using (window_id) group by 1)"""


@query("c08_window_text", f"with {WINDOW_TEXT_SQL} select window_id, text from texts", "windows window_actions")
def c08(spark, sf):
    return win.frame_manifest(annotated_windows(spark, sf)).select("window_id", "text")


@query(
    "c09_frame_manifest",
    f"""with {WINDOW_TEXT_SQL} select window_id, split, start_s, end_s, text, actions, round(start_s + 0.5 * (end_s - start_s) / 16, 5) as first_s, description,
    concat(object_a, ';', object_b) as objects from windows join texts using (window_id)""",
    "windows window_actions",
)
def c09(spark, sf):
    made = win.frame_manifest(annotated_windows(spark, sf))
    return made.select(
        "window_id", "split", "start_s", "end_s", "text", F.size("actions").alias("actions"),
        F.round(F.element_at("timestamps_s", 1), 5).alias("first_s"), "description", F.array_join("objects", ";").alias("objects"),
    )


def _timed_actions(spark, sf):
    lengths = recordings(spark, sf).select("video_id", "length_s")
    return relation(spark, sf, "actions").join(lengths, "video_id")


@query(
    "c10_context_interval",
    """select a.pos, greatest(0, start_s - 2) as context_start_s,
    greatest(greatest(0, start_s - 2), least(length_s, end_s + 2)) as context_end_s from actions a join recordings using (video_id)""",
    "actions recordings",
)
def c10(spark, sf):
    return _timed_actions(spark, sf).select(
        "pos", iv.context_start("start_s").alias("context_start_s"), iv.context_end("start_s", "end_s", "length_s").alias("context_end_s")
    )


@query(
    "c11_interval_iou",
    """select window_id, pos, round(case when greatest(end_s, window_end_s) > least(start_s, window_start_s)
   then greatest(0, least(end_s, window_end_s) - greatest(start_s, window_start_s)) / (greatest(end_s, window_end_s) - least(start_s, window_start_s))
   else 0 end, 6) as iou from window_actions""",
    "window_actions",
)
def c11(spark, sf):
    return window_actions(spark, sf).select(
        "window_id", "pos", F.round(iv.interval_iou("start_s", "end_s", "window_start_s", "window_end_s"), 6).alias("iou")
    )


@query(
    "c12_boundary_error",
    """select window_id, pos, round((abs(start_s - window_start_s) + abs(end_s - window_end_s)) / 2, 7) as error_s,
   round((abs(start_s - window_start_s) + abs(end_s - window_end_s)) / 2 / duration_s, 8) as normalized from window_actions""",
    "window_actions",
)
def c12(spark, sf):
    ends = ("start_s", "end_s", "window_start_s", "window_end_s")
    return window_actions(spark, sf).select(
        "window_id", "pos", F.round(iv.boundary_error(*ends), 7).alias("error_s"),
        F.round(iv.normalized_boundary_error(*ends, "duration_s"), 8).alias("normalized"),
    )


def _frames(spark, sf):
    """Irregular decoded frame times: the action starts."""
    return relation(spark, sf, "actions").select("video_id", F.col("start_s").alias("frame_s")).distinct()


@query(
    "c13_nearest_frame_asof",
    """
with f as (select distinct video_id, start_s as t from actions), g as (select window_id, video_id, start_s + 1 as t from windows),
b as (select g.*, f.t as before_s from g asof left join f on g.video_id = f.video_id and g.t >= f.t),
e as (select b.*, f.t as after_s from b asof left join f on b.video_id = f.video_id and b.t <= f.t)
select video_id, t as target_s, case when after_s is null then before_s when before_s is null or after_s - t < t - before_s then after_s else before_s end as frame_s,
  after_s is null as past_end from e
""",
    "windows actions",
)
def c13(spark, sf):
    targets = windows(spark, sf).select("video_id", (F.col("start_s") + 1).alias("target_s"))
    return win.nearest_frame(targets, _frames(spark, sf), "video_id")


@query(
    "c14_forward_frame_asof",
    """
with f as (select distinct video_id, start_s as t from actions), l as (select video_id, max(t) as last_s from f group by 1),
g as (select video_id, unnest(list_transform(range(8), lambda i: length_s * ((i + 0.5::double) / 8))) as t from recordings),
e as (select g.*, f.t as after_s from g asof left join f on g.video_id = f.video_id and g.t <= f.t)
select video_id, t as target_s, coalesce(after_s, last_s) as frame_s, after_s is null as padded from e join l using (video_id)
""",
    "recordings actions",
)
def c14(spark, sf):
    spans = recordings(spark, sf).select("video_id", F.lit(0.0).alias("start_s"), F.col("length_s").cast("double").alias("end_s"))
    targets = win.spread_targets(spans, "start_s", "end_s", 8).select("video_id", "target_s")
    return win.forward_frame(targets, _frames(spark, sf), "video_id")


@query(
    "c15_action_targets",
    """
with v as (select list_sort(list(distinct action_id)) as vocab from actions),
s as (select w.window_id, list(a.action_id) as ids from windows w left join window_actions a using (window_id) group by 1)
select window_id, array_to_string(list_transform(vocab, lambda x: case when list_contains(ids, x) then 1 else 0 end), '') as targets from s, v
""",
    "windows window_actions actions",
)
def c15(spark, sf):
    made = tg.action_targets(annotated_windows(spark, sf), relation(spark, sf, "actions").select("action_id"))
    return made.select("window_id", F.array_join(F.transform("action_targets", lambda x: x.cast("int").cast("string")), "").alias("targets"))


BOUNDARY_SQL = """
o as (select *, greatest(0, least(end_s, window_end_s) - greatest(start_s, window_start_s)) as ov from window_actions),
best as (select * from (select *, row_number() over (partition by window_id order by ov desc, pos) as rn from o where ov > 0) where rn = 1)"""


@query(
    "c16_boundary_targets",
    f"""with {BOUNDARY_SQL}
select w.window_id, b.action_id, round(coalesce(greatest(0, least(1, (b.start_s - w.start_s) / greatest(w.end_s - w.start_s, 1e-6))), 0), 6) as boundary_start,
  round(coalesce(greatest(0, least(1, (b.end_s - w.start_s) / greatest(w.end_s - w.start_s, 1e-6))), 0), 6) as boundary_end, b.pos is not null as has_target
from windows w left join best b using (window_id)""",
    "windows window_actions",
)
def c16(spark, sf):
    made = tg.boundary_targets(windows(spark, sf), window_actions(spark, sf))
    return made.select(
        "window_id", "action_id", F.round("boundary_start", 6).alias("boundary_start"), F.round("boundary_end", 6).alias("boundary_end"), "has_target"
    )


@query(
    "c17_frame_targets",
    f"""with {BOUNDARY_SQL},
t as (select w.window_id, b.pos, b.start_s as a, b.end_s as e, list_transform(range(8), lambda i: round(w.start_s + (i + 0.5::double) * ((w.end_s - w.start_s) / 8), 6)) as ts from windows w left join best b using (window_id)),
g as (select *, list_transform(ts, lambda x: abs(x - a)) as ga, list_transform(ts, lambda x: abs(x - e)) as ge from t)
select window_id, array_to_string(list_transform(ts, lambda x: case when pos is not null and x >= a and x <= e then 1 else 0 end), '') as inside,
  case when pos is not null then list_position(ga, list_min(ga)) - 1 end as start_frame, case when pos is not null then list_position(ge, list_min(ge)) - 1 end as end_frame from g
""",
    "windows window_actions",
)
def c17(spark, sf):
    targets = tg.boundary_targets(windows(spark, sf), window_actions(spark, sf)).withColumn(
        "timestamps_s", iv.window_timestamps("start_s", "end_s", 8)
    )
    made = tg.frame_targets(targets)
    return made.select("window_id", F.array_join(F.col("inside").cast("array<string>"), "").alias("inside"), "start_frame", "end_frame")


LABELS = ("click", "error", "purchase", "signup", "view")


def model_outputs(spark, sf):
    """Windows with head outputs read off their vector, all within [0, 1]."""
    scored = with_vectors(windows(spark, sf), spark, sf)
    part = lambda low, n: F.transform(F.slice("vector", low, n), lambda x: F.abs(x.cast("double")))
    return (
        scored.withColumn("boundary", F.array(F.abs(F.element_at("vector", 12).cast("double")), 1 - F.abs(F.element_at("vector", 13).cast("double"))))
        .withColumn("action_scores", part(20, 5))
        .withColumn("timestamps_s", iv.window_timestamps("start_s", "end_s", 8))
        .withColumn("relevance", part(1, 8))
        .withColumn("start_scores", part(9, 8))
        .withColumn("end_scores", part(17, 8))
        .drop("vector")
    )


@query(
    "c18_decode_boundaries",
    """
select window_id, round(start_s + abs(embedding[12]::double) * (end_s - start_s), 4) as predicted_start_s,
  round(start_s + (1 - abs(embedding[13]::double)) * (end_s - start_s), 4) as predicted_end_s, round(abs(embedding[20]::double), 5) as click_score,
  round(abs(embedding[24]::double), 5) as view_score from windows join embeddings using (vec_id)
""",
    "windows",
)
def c18(spark, sf):
    made = tg.decode_boundaries(model_outputs(spark, sf), F.array(*[F.lit(n) for n in LABELS]))
    score = lambda n: F.element_at("predicted_action_scores", F.lit(n))
    return made.select("window_id", "predicted_start_s", "predicted_end_s", score("click").alias("click_score"), score("view").alias("view_score"))


@query(
    "c19_decode_refinement",
    """
with x as (select window_id, start_s, end_s, round(start_s + abs(embedding[12]::double) * (end_s - start_s), 4) as ps,
    round(start_s + (1 - abs(embedding[13]::double)) * (end_s - start_s), 4) as pe, unnest(range(8)) as i,
    unnest(list_transform(embedding[1:8], lambda v: abs(v::double))) as r, unnest(list_transform(embedding[9:16], lambda v: abs(v::double))) as s0,
    unnest(list_transform(embedding[17:24], lambda v: abs(v::double))) as e0 from windows join embeddings using (vec_id)),
y as (select *, round(start_s + (i + 0.5::double) * ((end_s - start_s) / 8), 6) as t, s0 * (0.25 + 0.75 * r) as s, e0 * (0.25 + 0.75 * r) as e from x),
z as (select window_id, any_value(ps) as ps, any_value(pe) as pe, greatest(any_value(start_s), least(sum(t * s) / greatest(sum(s), 1e-8), any_value(end_s))) as f,
    greatest(any_value(start_s), least(sum(t * e) / greatest(sum(e), 1e-8), any_value(end_s))) as g, avg(greatest(r, s, e)) as c from y group by 1)
select window_id, round(case when g <= f then ps else f end, 4) as refined_start_s, round(case when g <= f then pe else g end, 4) as refined_end_s,
  round(c, 5) as refinement_confidence from z
""",
    "windows",
)
def c19(spark, sf):
    made = tg.decode_refinement(tg.decode_boundaries(model_outputs(spark, sf)))
    return made.select("window_id", "refined_start_s", "refined_end_s", "refinement_confidence")


@query("c20_split_filter", "select window_id, split from windows where split = 'test'", "windows")
def c20(spark, sf):
    return win.select_split(windows(spark, sf), "test").select("window_id", "split")


def multimodal(spark, sf):
    """Multimodal records from documents: paths by text length, one or two annotations."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    path = lambda name, d: F.when(F.col("n_chars") % d != 0, F.concat(F.lit(f"{name}/"), F.col("doc_id").cast("string"))).otherwise("")
    paths = F.create_map(*[p for m, d in zip(win.MODALITIES, (2, 3, 5, 7)) for p in (F.lit(m), path(m, d))])
    note = lambda label, end: F.struct(F.lit(0.0).alias("start_s"), end.alias("end_s"), label.alias("label"))
    length = F.col("n_chars").cast("double")
    first = F.array(note(F.col("lang"), length / 2))
    return rows.select(
        F.col("doc_id").cast("string").alias("video_id"), length.alias("duration_s"), F.col("lang").alias("split"), paths.alias("paths"),
        F.when(F.col("quality") == 1, F.concat(first, F.array(note(F.col("source"), length)))).otherwise(first).alias("annotations"),
    )


@query(
    "c21_modality_mask",
    "select doc_id::varchar as video_id, n_chars % 2 <> 0 as rgb, n_chars % 3 <> 0 as audio, n_chars % 5 <> 0 as depth, n_chars % 7 <> 0 as pose from documents",
)
def c21(spark, sf):
    made = multimodal(spark, sf).select("video_id", win.modality_mask(F.col("paths")).alias("m"))
    return made.select("video_id", *[F.element_at("m", F.lit(n)).alias(n) for n in win.MODALITIES])


@query(
    "c22_manifest_audit",
    """
with d as (select d.*, l.quality from documents d left join labels l using (doc_id))
select 'record_count' as metric, '' as key, count(*)::double as value from d
union all select 'modality_rgb', '', sum((n_chars % 2 <> 0)::int)::double from d union all select 'modality_audio', '', sum((n_chars % 3 <> 0)::int)::double from d
union all select 'modality_depth', '', sum((n_chars % 5 <> 0)::int)::double from d union all select 'modality_pose', '', sum((n_chars % 7 <> 0)::int)::double from d
union all select 'all_modalities_count', '', sum((n_chars % 2 <> 0 and n_chars % 3 <> 0 and n_chars % 5 <> 0 and n_chars % 7 <> 0)::int)::double from d
union all select 'annotation_count', '', sum(1 + (quality is not null and quality = 1)::int)::double from d
union all select 'total_duration_s', '', sum(n_chars)::double from d
union all select 'split_count', lang, count(*)::double from d group by lang
union all select 'label_count', '', count(*)::double from (select lang from d union select source from d where quality = 1)
""",
)
def c22(spark, sf):
    return win.manifest_audit(multimodal(spark, sf))
