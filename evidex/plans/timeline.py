"""Catalogue, timeline and answer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions.text import LABEL_EDGES, PROMPT_STOPWORDS, WORD_EDGES
from evidex.operators import timeline as tl
from evidex.plans.registry import query
from evidex.plans.relations import recordings, relation, table, window_actions, windows

_CATALOG = """
cat as (select video_id, max(duration_s) as duration_s, arg_min(description, ord) as description, coalesce(arg_min(script, ord) filter (where script <> ''), '') as script,
  coalesce(arg_min(scene, ord) filter (where scene <> ''), '') as scene, coalesce(arg_min(subject, ord) filter (where subject <> ''), '') as subject,
  array_to_string(list_sort(list_distinct([any_value(object_a), any_value(object_b)])), ',') as objects from windows group by 1),
act as (select video_id, count(*) as action_count, string_agg(distinct name, ',' order by name) as action_names from
  (select distinct video_id, action_id, name, start_s, end_s from window_actions) group by 1),
full_cat as (select cat.*, coalesce(action_count, 0) as action_count, action_names from cat left join act using (video_id))"""


def _catalog(spark, sf):
    return tl.video_catalog(windows(spark, sf), window_actions(spark, sf))


@query("e01_video_catalog", f"with {_CATALOG} select * from full_cat", "windows window_actions")
def e01(spark, sf):
    return _catalog(spark, sf).select(
        "video_id", "duration_s", "description", "script", "scene", "subject",
        F.array_join("objects", ",").alias("objects"), "action_count", F.array_join("action_names", ",").alias("action_names"),
    )


@query(
    "e08_catalog_union",
    f"""with {_CATALOG} select video_id, duration_s::double as duration_s, description, script, objects, action_count, 'prepared' as source from full_cat
union all select concat('local-', conv_id), max(turn) + 1.0, 'Local video; annotations are not available.', null, '', 0, 'local_upload' from conversations group by conv_id""",
    "windows window_actions",
)
def e08(spark, sf):
    uploads = table(spark, sf, "conversations").groupBy(F.concat(F.lit("local-"), F.col("conv_id").cast("string")).alias("video_id")).agg(
        (F.max("turn") + 1.0).alias("duration_s")
    )
    both = tl.catalog_union(_catalog(spark, sf), uploads)
    return both.select(
        "video_id", F.col("duration_s").cast("double").alias("duration_s"), "description", "script", F.array_join("objects", ",").alias("objects"), "action_count", "source"
    )


@query(
    "e09_windows_of_video",
    "select video_id, window_id, row_number() over (partition by video_id order by start_s, end_s) - 1 as position from windows",
    "windows",
)
def e09(spark, sf):
    return tl.window_positions(windows(spark, sf).select("video_id", "window_id", "start_s", "end_s")).select("video_id", "window_id", "position")


@query(
    "e02_overlap_groups",
    """with once as (select video_id, action_id, name, start_s, end_s, min(pos) as pos from actions group by all)
select distinct video_id, names from (select a.video_id, a.pos, array_to_string(list_sort(list_distinct(list_append(list(b.name), any_value(a.name)))), ',') as names
 from once a join once b on a.video_id = b.video_id and a.pos <> b.pos and b.start_s < a.end_s and b.end_s > a.start_s group by 1, 2)""",
    "actions",
)
def e02(spark, sf):
    return tl.overlap_groups(relation(spark, sf, "actions")).select("video_id", F.array_join("names", ",").alias("names"))


@query(
    "e03_timeline",
    """
with ev as (select video_id, trim(name) as label, start_s, end_s, min(pos) as pos from window_actions group by 1, 2, 3, 4),
r as (select *, max(end_s) over (partition by video_id order by start_s, end_s, pos rows between unbounded preceding and 1 preceding) as reach from ev),
i as (select *, sum(case when reach is null or start_s > reach + 0.5 then 1 else 0 end) over (partition by video_id order by start_s, end_s, pos) as island from r),
f as (select *, row_number() over (partition by video_id, island, label order by start_s, end_s, pos) as nth from i)
select video_id, island::bigint as island, min(start_s) as start_s, max(end_s) as end_s,
  string_agg(label, ' · ' order by start_s, end_s, pos) filter (where nth = 1) as label, count(*) as event_count from f group by 1, 2
""",
    "window_actions",
)
def e03(spark, sf):
    return tl.timeline(window_actions(spark, sf))


_ISLANDS = """
ev as (select video_id, trim(name) as label, start_s, end_s, min(pos) as pos, arg_max(window_id, window_start_s * 1e6 + window_end_s) as evidence_window_id
  from window_actions where trim(name) <> '' and end_s > start_s group by 1, 2, 3, 4),
r as (select *, max(end_s) over (partition by video_id order by start_s, end_s, pos rows between unbounded preceding and 1 preceding) as reach from ev),
i as (select *, sum(case when reach is null or start_s > reach + 0.5 then 1 else 0 end) over (partition by video_id order by start_s, end_s, pos)::bigint as island from r)"""


@query(
    "e03_source_events",
    f"with {_ISLANDS} select video_id, island, label, start_s, end_s, evidence_window_id, 'dataset annotation' as confidence from i",
    "window_actions",
)
def e03_sources(spark, sf):
    return tl.timeline_sources(window_actions(spark, sf)).drop("limitations")


@query(
    "e03_timeline_summary",
    f"""with {_ISLANDS},
d as (select video_id, case when video_no % 3 = 0 then upper(description) when video_no % 3 = 1 then null else description end as description, object_a, object_b, start_s from windows),
f as (select video_id, trim(split_part(coalesce(arg_min(coalesce(description, ''), start_s), ''), ';', 1)) as t, any_value(concat(object_a, ',', object_b)) as objects from d group by 1),
c as (select video_id, count(distinct island) as group_count, count(*) as event_count from i group by 1)
select video_id, case when t = upper(t) and t <> lower(t) then concat(upper(t[1]), lower(t[2:])) else t end as overview, objects,
  coalesce(group_count, 0) as group_count, coalesce(event_count, 0) as event_count from f left join c using (video_id)""",
    "windows window_actions",
)
def e03_summary(spark, sf):
    number = F.col("video_no") % 3
    shown = F.when(number == 0, F.upper("description")).when(number == 2, F.col("description"))
    rows = windows(spark, sf).withColumn("description", shown)
    made = tl.timeline_summary(rows, tl.timeline_sources(window_actions(spark, sf)))
    return made.withColumn("objects", F.array_join("objects", ","))


def _requests(spark, sf):
    third = F.floor(F.col("length_s") / 3)
    return recordings(spark, sf).select(
        F.concat(F.lit("ask-"), "video_id").alias("query_id"), "video_id", third.cast("double").alias("from_s"), (third + F.col("video_no") % 30 + 1).cast("double").alias("to_s")
    )


_REQ = """req as (select concat('ask-', video_id) as query_id, video_id, video_no, floor(length_s / 3) as from_s, floor(length_s / 3) + video_no % 30 + 1 as to_s from recordings)"""


@query(
    "e04_interval_answer",
    f"""with {_REQ},
a as (select q.query_id, name, start_s, min(pos) as pos from req q join actions a on a.video_id = q.video_id and a.end_s > q.from_s and a.start_s < q.to_s group by 1, 2, 3, action_id, end_s),
n as (select query_id, string_agg(name, ', ' order by start_s, pos) as names from a group by 1),
w as (select q.query_id, string_agg(window_id, ',' order by start_s, end_s) as evidence from req q join windows w on w.video_id = q.video_id and w.end_s > q.from_s and w.start_s < q.to_s group by 1)
select query_id, case when names is not null then concat('The selected evidence contains: ', names, '.') else 'The selected evidence does not contain an annotated action that answers this question.' end as answer,
 names is not null as supported, evidence from req left join n using (query_id) left join w using (query_id)""",
    "recordings windows actions",
)
def e04(spark, sf):
    made = tl.interval_answer(_requests(spark, sf), window_actions(spark, sf), windows(spark, sf))
    return made.select("query_id", "answer", "supported", F.array_join("evidence_window_ids", ",").alias("evidence"))


@query(
    "e05_evidence_select",
    f"""with {_REQ},
w as (select q.query_id, w.window_id, w.start_s, w.object_a, w.object_b from req q join windows w on w.video_id = q.video_id and
   (case when q.video_no % 2 = 0 then w.window_no in (0, 3) else w.end_s > q.from_s and w.start_s < q.to_s end)),
n as (select query_id, string_agg(distinct a.name, ',' order by a.name) as action_names from w join window_actions a using (window_id) group by 1)
select query_id, string_agg(window_id, ',' order by start_s) as window_ids, array_to_string(list_sort(list_distinct(list_concat(list(object_a), list(object_b)))), ',') as object_names, any_value(action_names) as action_names
from w left join n using (query_id) group by 1""",
    "recordings windows window_actions",
)
def e05(spark, sf):
    span = lambda n: F.format_string("%s:%.2f-%.2f", "video_id", F.lit(2.0 * n), F.lit(2.0 * n + 4))
    listed = F.when(F.substring("video_id", 2, 20).cast("long") % 2 == 0, F.array(span(3), span(0))).otherwise(F.array(F.lit("missing")))
    made = tl.evidence_select(_requests(spark, sf).withColumn("window_ids", listed), windows(spark, sf), window_actions(spark, sf))
    return made.select(
        "query_id", F.array_join("window_ids", ",").alias("window_ids"), F.array_join("object_names", ",").alias("object_names"),
        F.array_join("action_names", ",").alias("action_names"),
    )


_EDGES = WORD_EDGES
_LABEL_EDGES_SQL = LABEL_EDGES.replace("'", "''")


@query(
    "e06_prompt_terms",
    f"""
with q as (select video_id, concat('Where is the (', object_a, ') near ', scene, ', or holding a Cup?') as question, [' Chair. ', scene, 'Waste Bin!'] as prompts, [object_a, object_b, 'cup'] as objects from recordings),
w as (select *, list_filter(list_transform(regexp_split_to_array(trim(question), '\\s+'), lambda t: lower(trim(t, '{_EDGES}'))), lambda t: length(t) >= 4) as words from q),
t as (select video_id, list_concat(list_concat(list_transform(prompts, lambda p: lower(trim(p, '{_LABEL_EDGES_SQL}'))),
   list_filter(objects, lambda o: len(list_filter(words, lambda x: contains(lower(o), x))) > 0 or (len(words) > 0 and contains(lower(question), lower(o))))),
   list_filter(words, lambda x: not list_contains({list(PROMPT_STOPWORDS)!r}, x))) as terms from w)
select video_id, array_to_string(list_sort(list_filter(list_distinct(terms), lambda x: x <> '')), ',') as terms from t
""",
    "recordings",
)
def e06(spark, sf):
    rows = recordings(spark, sf)
    question = F.concat(F.lit("Where is the ("), "object_a", F.lit(") near "), "scene", F.lit(", or holding a Cup?"))
    prompts = F.array(F.lit(" Chair. "), F.col("scene"), F.lit("Waste Bin!"))
    objects = F.array(F.col("object_a"), F.col("object_b"), F.lit("cup"))
    return rows.select("video_id", F.array_join(tl.prompt_terms(prompts, objects, question), ",").alias("terms"))


@query(
    "e07_finding_payload",
    """select concat('c', conv_id) as video_id, text as question, turn::double as start_s, turn + 1.5 as end_s, role as answer, 0 as evidence, case when role = 'user' then 'confirmed' else 'unclear' end as status,
  case when turn = 0 then 'opening' else '' end as note, 0 as limitations, 'annotations' as source from conversations""",
)
def e07(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("video_id"), F.col("text").alias("question"), F.col("turn").alias("start_s"),
        (F.col("turn") + 1.5).alias("end_s"), F.col("role").alias("answer"), F.lit(None).cast("array<string>").alias("evidence_window_ids"),
        F.when(F.col("role") == "user", "confirmed").alias("status"), F.when(F.col("turn") == 0, "opening").alias("note"),
        F.lit(None).cast("array<string>").alias("limitations"), F.lit(None).cast("string").alias("source"),
    )
    made = tl.finding_payload(rows)
    return made.withColumn("evidence", F.size("evidence_window_ids")).withColumn("limitations", F.size("limitations")).drop("evidence_window_ids")
