"""Review-record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.operators import objects as ob, records as rec
from evidex.operators.timeline import finding_payload
from evidex.plans.objects import _TOP, sightings
from evidex.plans.registry import query
from evidex.plans.relations import relation, table, vector_count
from evidex.session import scratch_path

_REQUESTS = """
req as (select concat('insp-', conv_id) as inspection_id, timestamp '2024-01-01' + to_hours(conv_id::integer) as created_at,
   list_filter(list(case when role = 'user' then concat('obs-', (conv_id * 7 + turn * (conv_id % 3)) % (select count(*) + count(*) // 5 + 1 from embeddings)) end order by turn), lambda x: x is not null) as ids, max(case when turn = 0 then text end) as question from conversations group by conv_id),
ev as (select inspection_id, unnest(ids) as observation_id, unnest(range(1, len(ids) + 1)) as rank from req),
mem as (select concat('obs-', vec_id) as observation_id from embeddings),
bad as (select distinct inspection_id from (select inspection_id from ev group by inspection_id, observation_id having count(*) > 1 union all select inspection_id from ev where observation_id not in (select observation_id from mem)))"""


def requests(spark, sf):
    """One inspection request per conversation; user turns name the evidence."""
    vectors = vector_count(spark, sf)  # one number in six names no vector
    number = (F.col("conv_id") * 7 + F.col("turn") * (F.col("conv_id") % 3)) % (vectors + F.floor(vectors / 5) + 1)
    item = F.when(F.col("role") == "user", F.struct("turn", F.concat(F.lit("obs-"), F.col("number").cast("string")).alias("id")))
    grouped = table(spark, sf, "conversations").withColumn("number", number).groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(item)), lambda i: i["id"]).alias("evidence_ids"),
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("question"),
    )
    created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), 0, 0)")
    return grouped.select(
        F.concat(F.lit("insp-"), F.col("conv_id").cast("string")).alias("inspection_id"), F.lit("Inspection").alias("title"), "question", created.alias("created_at"), "evidence_ids"
    )


def memory_ids(spark, sf):
    return table(spark, sf, "embeddings").select(F.concat(F.lit("obs-"), F.col("vec_id").cast("string")).alias("observation_id"))


def stored(spark, sf):
    """Append the valid requests to a new store and read it back."""
    inspections, evidence = rec.new_inspections(requests(spark, sf), memory_ids(spark, sf))
    root = scratch_path(spark, "inspections")
    rec.append(inspections, f"{root}/inspections")
    rec.append(evidence, f"{root}/evidence")
    return spark.read.parquet(f"{root}/inspections"), spark.read.parquet(f"{root}/evidence")


@query(
    "i01_inspection_append",
    f"""with {_REQUESTS} select inspection_id, case when len(ids) > 0 then 'supported_with_limits' else 'insufficient_evidence' end as status, len(ids) as evidence_count, question
 from req where inspection_id not in (select inspection_id from bad)""",
)
def i01(spark, sf):
    inspections, evidence = stored(spark, sf)
    counts = evidence.groupBy("inspection_id").agg(F.count("*").alias("evidence_count"))
    return inspections.join(counts, "inspection_id", "left").select(
        "inspection_id", "status", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), "question"
    )


@query(
    "i02_inspection_latest",
    """select conv_id, arg_max(role, turn) as status, arg_max(text, turn) filter (where turn % 2 = 0) as result_text, arg_max(text, turn) filter (where role = 'assistant') as summary from conversations group by 1""",
)
def i02(spark, sf):
    c = F.col
    log = table(spark, sf, "conversations").select(
        "conv_id", "turn", c("role").alias("status"), F.when(c("turn") % 2 == 0, c("text")).alias("result_text"), F.when(c("role") == "assistant", c("text")).alias("summary")
    )
    return rec.latest(log, "conv_id", "turn", ["status", "result_text", "summary"])


@query(
    "i03_inspection_list",
    f"""with {_REQUESTS}, e as (select inspection_id, string_agg(observation_id, ',' order by rank) as evidence from ev group by 1)
select inspection_id, created_at::varchar as created_at, evidence from req left join e using (inspection_id) where inspection_id not in (select inspection_id from bad)""",
)
def i03(spark, sf):
    listed = rec.inspection_list(rec.inspection_detail(*stored(spark, sf)))
    return listed.select(
        "inspection_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.array_join(F.transform("evidence", lambda e: e["observation_id"]), ",").alias("evidence"),
    )


@query(
    "i04_findings",
    """select doc_id::varchar as answer, concat('u', doc_id % m) as video_id, (n_chars % 50)::double as start_s, (n_chars % 70)::double as end_s, 'unclear' as status, 'annotations' as source from documents, (select max(user_id) + max(user_id) // 5 + 1 as m from events)
 where n_chars % 70 > n_chars % 50 and doc_id % m in (select user_id from events)""",
)
def i04(spark, sf):
    none = F.lit(None).cast("string")
    users = table(spark, sf, "events").agg((F.max("user_id") + F.floor(F.max("user_id") / 5) + 1).alias("m")).scalar()
    found = table(spark, sf, "documents").select(
        F.concat(F.lit("u"), (F.col("doc_id") % users).cast("string")).alias("video_id"), F.lit("What happens?").alias("question"),
        (F.col("n_chars") % 50).alias("start_s"), (F.col("n_chars") % 70).alias("end_s"), F.col("doc_id").cast("string").alias("answer"),
        F.lit(None).cast("array<string>").alias("evidence_window_ids"), none.alias("status"), none.alias("note"),
        F.lit(None).cast("array<string>").alias("limitations"), none.alias("source"),
    )
    path = scratch_path(spark, "findings")
    rec.append(rec.valid_findings(finding_payload(found), relation(spark, sf, "recordings")), path)
    return spark.read.parquet(path).select("answer", "video_id", "start_s", "end_s", "status", "source")


@query(
    "i05_comparison_support",
    f"""with {_TOP}, b as (select observation, object_class, max(point_count) as p from sightings group by 1, 2),
items as (select eo, 'association' as kind, concat(ed, '__', ld) as item_id, struct_pack(a := lo::bigint, b := list_position(['chair', 'waste_bin', 'box'], object_class)::bigint, c := rank::bigint) as item_order from top
  union all select a.observation, 'geometry', concat(a.observation, '-to-', b.observation, '-', a.object_class), struct_pack(a := b.observation::bigint, b := list_position(['chair', 'waste_bin', 'box'], a.object_class)::bigint, c := 0::bigint) from b a join b on a.object_class = b.object_class and a.observation < b.observation),
f as (select *, row_number() over (partition by eo, kind order by item_order) as place from items)
select concat('insp-', r.eo) as inspection_id, kind, place, item_id from (select distinct observation as eo from sightings) r join f using (eo) where place <= 10""",
    "sightings",
)
def i05(spark, sf):
    rows = sightings(spark, sf)
    pairs, _ = ob.associate(rows)
    pairs = pairs.select(
        "earlier_observation", F.col("pair_id").alias("item_id"),
        rec.support_order(F.col("later_observation"), F.col("object_class"), F.col("rank")).alias("item_order"),
    )
    compared = ob.visit_comparison(rows).select(
        "earlier_observation", F.format_string("%d-to-%d-%s", "earlier_observation", "later_observation", "object_class").alias("item_id"),
        rec.support_order(F.col("later_observation"), F.col("object_class"), F.lit(0)).alias("item_order"),
    )
    asked = rows.select(F.col("observation").alias("earlier_observation")).distinct().withColumn(
        "inspection_id", F.concat(F.lit("insp-"), F.col("earlier_observation").cast("string"))
    )
    return rec.comparison_support(asked, pairs, compared).select("inspection_id", "kind", "place", "item_id")


_KEY = "sha256(concat_ws('|', concat_ws(':', length('model-a'), 'model-a'), concat_ws(':', length('v1'), 'v1'), concat_ws(':', length(text), text), concat_ws(':', length(sha256(source)), sha256(source))))"


@query(
    "i06_response_cache",
    f"""with k as (select doc_id, {_KEY} as cache_key from documents), c as (select distinct {_KEY} as cache_key from documents join labels using (doc_id))
select doc_id, cache_key, cache_key in (select cache_key from c) as hit from k""",
)
def i06(spark, sf):
    asked = table(spark, sf, "documents").select(
        "doc_id", rec.content_key(F.lit("model-a"), F.lit("v1"), F.col("text"), F.sha2("source", 256)).alias("cache_key")
    )
    answered = asked.join(table(spark, sf, "labels").select("doc_id"), "doc_id").select("cache_key").distinct()
    hits, todo = rec.cache_split(asked, answered)
    return hits.withColumn("hit", F.lit(True)).unionByName(todo.withColumn("hit", F.lit(False))).select("doc_id", "cache_key", "hit")


@query(
    "i07_citation_check",
    """select doc_id as answer_id, case when toxic = 1 then 'unknown: elsewhere' else 'uncited' end as problem from documents join labels using (doc_id) where toxic = 1 or (quality = 1 and n_chars % 5 = 0)""",
)
def i07(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    cited = F.when(F.col("toxic") == 1, F.array(F.col("source"), F.lit("elsewhere"))).when(
        F.col("n_chars") % 5 == 0, F.array().cast("array<string>")
    ).otherwise(F.array("source"))
    return rec.citation_problems(
        rows.select(F.col("doc_id").alias("answer_id"), cited.alias("cited"), F.array("source", "lang").alias("supplied"), (F.col("quality") == 1).alias("supported"))
    )


@query(
    "i08_label_whitelist",
    """with v as (select list(distinct x) as v from (select source as x from documents union select lang from documents d join labels using (doc_id) where toxic = 1)),
 r as (select doc_id, list_sort(list_filter(list_distinct([lang, case when n_chars % 2 = 0 then 'src1' else 'xx' end]), lambda x: list_contains(v, x))) as m from documents, v)
select doc_id, array_to_string(m, ',') as matched, len(m) = 0 as unsupported from r""",
)
def i08(spark, sf):
    docs = table(spark, sf, "documents")
    toxic = docs.join(table(spark, sf, "labels").filter(F.col("toxic") == 1), "doc_id").select(F.col("lang").alias("x"))
    vocabulary = docs.select(F.col("source").alias("x")).unionByName(toxic).agg(F.collect_set("x")).scalar()
    returned = F.array(F.col("lang"), F.when(F.col("n_chars") % 2 == 0, "src1").otherwise("xx"))
    rows = docs.select("doc_id", returned.alias("labels")).withColumn("vocabulary", vocabulary)
    made = rec.whitelist_labels(rows, "labels", "vocabulary")
    return made.select("doc_id", F.array_join("matched", ",").alias("matched"), "unsupported")
