"""Embedding-table queries."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from evidex.functions.vectors import norm
from evidex.operators import drift, embeddings as emb, search
from evidex.plans.registry import query
from evidex.plans.relations import documents, relation, table, vector_count, vectors, with_vectors
from evidex.session import cut_lineage, scratch_path

DIM = 64


@query(
    "b01_validate_embeddings",
    """
with v as (select vec_id, case when label = 0 then list_transform(embedding::double[], lambda x: x*1.5)
                               when label = 1 then (embedding::double[])[1:63]
                               when label = 2 then list_append((embedding::double[])[1:63], 'nan'::double)
                               else embedding::double[] end as v from embeddings),
     r as (select vec_id, v, len(list_filter(v, lambda x: isnan(x))) = 0 as fin from v)
select vec_id as id, 'dimension' as rule from r where len(v) <> 64
union all select vec_id, 'finite' from r where not fin
union all select vec_id, 'unit' from r where fin and abs(sqrt(list_dot_product(v, v)) - 1) > 1e-5
""",
)
def b01(spark, sf):
    v = F.col("embedding").cast("array<double>")
    broken = (
        F.when(F.col("label") == 0, F.transform(v, lambda x: x * 1.5))
        .when(F.col("label") == 1, F.slice(v, 1, 63))
        .when(F.col("label") == 2, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan")))))
        .otherwise(v)
    )
    return emb.validate_embeddings(
        table(spark, sf, "embeddings").select("vec_id", broken.alias("vector")), "vec_id", "vector", DIM
    )


@query(
    "b02_l2_normalize",
    """
with v as (select vec_id, list_transform(embedding::double[], lambda x: x * (1 + vec_id % 3)) as v from embeddings),
     n as (select vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-8)) as u from v)
select vec_id, round(u[1], 6) as first, round(u[64], 6) as last, round(sqrt(list_dot_product(u, u)), 6) as length from n
""",
)
def b02(spark, sf):
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("vec_id") % 3))
    unit = emb.normalize(table(spark, sf, "embeddings").select("vec_id", scaled.alias("u")), "u", strict=True)
    return unit.select(
        "vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"),
        F.round(norm(F.col("u")), 6).alias("length"),
    )


@query(
    "b03_unique_ids",
    "select l_orderkey, l_linenumber, count(*) as rows from lineitem group by 1, 2 having count(*) > 1",
)
def b03(spark, sf):
    return emb.duplicate_ids(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "b04_count_contract",
    """
with d as (select label, (select count(*) from embeddings) // 10 as declared from (select distinct label from embeddings)),
     a as (select label, count(*) as actual from embeddings group by 1)
select label, declared, actual from d join a using (label) where declared <> actual
""",
)
def b04(spark, sf):
    rows = table(spark, sf, "embeddings")
    total = rows.agg(F.floor(F.count("*") / 10)).scalar()
    declared = rows.select("label").distinct().withColumn("declared", total)
    return emb.count_contract(declared, rows, ["label"])


@query(
    "b05_corpus_fingerprint",
    """
with recursive leaf as (select sha256(doc_id::varchar) as place,
                     sha256(concat(length(doc_id::varchar), ':', doc_id, ':', sha256(text))) as digest from documents),
-- sixteen-fold levels until a leaf holds about 64 digests
d as (select greatest(0, ceil(log(greatest(count(*), 1) / 64.0) / log(16.0) - 1e-9))::bigint as depth from documents),
up as (select depth as level, substr(place, 1, depth) as place, sha256(string_agg(digest, '' order by place, digest)) as digest from leaf, d group by depth, substr(place, 1, depth)
  union all
  select distinct level - 1, substr(place, 1, level - 1), sha256(string_agg(digest, '') over (partition by substr(place, 1, level - 1) order by place rows between unbounded preceding and unbounded following)) from up where level > 0)
select digest as fingerprint from up where level = 0
""",
)
def b05(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("label"), "text")
    return emb.fingerprint(docs, "label", "text", depth=emb.fingerprint_depth(docs.count()))


@query(
    "b06_drift_check",
    """
with s as (select doc_id, lang, source from documents),
     i as (select doc_id, lang, source from documents d join labels l using (doc_id)
           union all select doc_id, lang, 'moved' from documents d join labels l using (doc_id) where l.toxic = 1)
select doc_id, lang, source, side, count(*) as copies from (
  (select *, 'index_only' as side from (select * from i except all select * from s))
  union all (select *, 'source_only' from (select * from s except all select * from i))) group by all
""",
)
def b06(spark, sf):
    columns = ["doc_id", "lang", "source"]
    source = table(spark, sf, "documents").select(*columns)
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    known = source.join(labels, "doc_id")
    moved = known.filter(F.col("toxic") == 1).withColumn("source", F.lit("moved"))
    return emb.row_drift(known.unionByName(moved), source, columns)


_CHANGED = """
was as (select doc_id::varchar as label, case when doc_id % 97 = 5 then concat(text, '!') else text end as text from documents where doc_id % 101 <> 7
  union all select concat('gone-', doc_id), text from documents where doc_id % 211 = 3),
one as (select label, sha256(label) as place, sha256(concat(length(label), ':', label, ':', sha256(text))) as digest from was),
two as (select doc_id::varchar as label, sha256(doc_id::varchar) as place, sha256(concat(length(doc_id::varchar), ':', doc_id, ':', sha256(text))) as digest from documents),
d as (select greatest(0, ceil(log(greatest(count(*), 1) / 64.0) / log(16.0) - 1e-9))::bigint as depth from was)"""


@query(
    "b06_fingerprint_drift",
    f"""with {_CHANGED}
select coalesce(one.label, two.label) as label, substr(coalesce(one.place, two.place), 1, depth) as leaf,
  case when one.label is null then 'source_only' when two.label is null then 'index_only' else 'changed' end as problem
from one full join two on one.label = two.label cross join d where one.digest is distinct from two.digest""",
)
def b06_fingerprint(spark, sf):
    """An index of the documents as they were: some had another text, some are new, some have gone."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("label"), "text")
    text = F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    gone = docs.where("doc_id % 211 = 3").select(F.concat(F.lit("gone-"), "label").alias("label"), "text")
    was = docs.where("doc_id % 101 <> 7").select("label", text.alias("text")).unionByName(gone)
    path = scratch_path(spark, "fingerprint")
    drift.store_fingerprint(was, "label", F.col("text"), path)
    return drift.content_drift(spark, path, docs, "label", F.col("text"))


def _memory(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label")
    )


_UNIT = """unit as (select vec_id as ord, label, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as q, embedding::double[] as v from embeddings),
scored as (select q.ord as q_ord, m.ord, q.label as q_label, m.label, round(list_dot_product(q.q, m.v), 9) as s from unit q join unit m on true)"""


@query(
    "b07_cosine_topk",
    f"""
with {_UNIT}
select q_ord::varchar as query_id, ord, label::bigint as label, round(least(1, greatest(-1, s)), 6) as score, rank from
 (select *, row_number() over (partition by q_ord order by s desc, ord) as rank from scored) where rank <= 10
""",
)
def b07(spark, sf):
    memory = _memory(spark, sf)
    queries = memory.select(F.col("ord").cast("string").alias("query_id"), "vector")
    return search.cosine_topk(queries, memory, 10).withColumn("score", F.round("score", 6))


@query(
    "b08_filtered_search",
    f"""
with {_UNIT}
select q_ord::varchar as query_id, ord, label::bigint as label, round(s, 6) as score, rank from
 (select *, row_number() over (partition by q_ord order by s desc, ord) as rank from scored
  where label = q_label and ord <> q_ord) where rank <= 5
""",
)
def b08(spark, sf):
    memory = _memory(spark, sf)
    queries = memory.select(
        F.col("ord").cast("string").alias("query_id"), F.col("ord").alias("q_ord"), F.col("label").alias("q_scope"), "vector"
    )
    found = search.cosine_topk(
        queries, memory.withColumn("scope", F.col("label")), 5, exclude_self=True, scoped=True
    )
    return found.withColumn("score", F.round("score", 6))


@query(
    "b09_query_by_row",
    f"""
with {_UNIT}
select q_ord::varchar as query_id, ord, label::bigint as label, round(s, 6) as score, rank from
 (select *, row_number() over (partition by q_ord order by s desc, ord) as rank from scored where ord <> q_ord) where rank <= 5
""",
)
def b09(spark, sf):
    return search.query_by_row(_memory(spark, sf), 5).withColumn("score", F.round("score", 6))


@query(
    "b10_neighbour_context",
    """
select a.conv_id, a.turn, string_agg(concat(b.turn, ':', coalesce(b.role, '')), ',' order by b.turn) as nearby
from conversations a join conversations b on b.conv_id = a.conv_id and b.turn between a.turn - 1 and a.turn + 1
group by 1, 2
""",
)
def b10(spark, sf):
    found = emb.neighbour_context(table(spark, sf, "conversations"), "conv_id", "turn", "role")
    text = F.transform("nearby", lambda n: F.concat_ws(":", n["step"].cast("string"), F.coalesce(n["action"], F.lit(""))))
    return found.select("conv_id", "turn", F.array_join(text, ",").alias("nearby"))


@query(
    "b11_model_guard",
    """
with m as (select distinct lang as model_id, source as model_revision, 'memory' as side from documents),
     q as (select distinct lang, source, 'query' from documents join labels using (doc_id) where quality = 0),
     g as (select model_id, model_revision, string_agg(distinct side, ',' order by side) as sides
           from (from m union all from q) group by 1, 2)
select * from g where (select count(*) from g) > 1
""",
)
def b11(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("model_id"), F.col("source").alias("model_revision")
    )
    poor = table(spark, sf, "labels").filter(F.col("quality") == 0).select("doc_id")
    return emb.model_guard(docs, docs.join(poor, "doc_id"))


def hashed_token_encoder(dim: int = 16):
    """A deterministic stand-in for a text model: token counts by hash bucket."""

    def encode(texts: list[str]) -> np.ndarray:
        made = np.zeros((len(texts), dim))
        places: dict[str, int] = {}
        for row, text in enumerate(texts):
            for token in re.findall(r"[a-z0-9]+", text):
                place = places.get(token)
                if place is None:
                    place = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim
                    places[token] = place
                made[row, place] += 1
        return made

    return encode


@query(
    "b12_batch_encode",
    """
with t as (select doc_id, unnest(regexp_extract_all(text, '[a-z0-9]+')) as tok from documents),
     b as (select doc_id, (('0x' || substr(md5(tok), 1, 8))::bigint % 16) as dim, count(*)::double as c from t group by 1, 2),
     n as (select doc_id, sqrt(sum(c*c)) as n from b group by 1)
select d.doc_id, round(coalesce(max(case when dim = 0 then c / n end), 0), 4) as first,
       round(coalesce(max(case when dim = 15 then c / n end), 0), 4) as last
from documents d left join b using (doc_id) left join n using (doc_id) group by 1
""",
)
def b12(spark, sf):
    encoded = emb.batch_encode(documents(spark, sf).select("doc_id", "text"), "text", hashed_token_encoder)
    pick = lambda i: F.round(F.element_at("vector", i).cast("double"), 4)
    return encoded.select("doc_id", pick(1).alias("first"), pick(16).alias("last"))


@query(
    "b13_rgb_histogram_descriptor",
    """
with p as (select detection_no, unnest([0, 1, 2]) as ch, unnest([r, g, b]) as v from mask_pixels),
     s as (select detection_no, count(*) as n, avg((r + g + b) / 3.0::double / 255) as gm, stddev_pop((r + g + b) / 3.0::double / 255) as gs from mask_pixels group by 1),
     h as (select detection_no, ch * 16 + least(v * 16 // 255, 15) as pos, count(*) as c from p group by 1, 2),
     d as (select detection_no, pos, c * 16.0::double / n as x from h join s using (detection_no)
           union all select detection_no, 48, gm from s union all select detection_no, 49, gs from s),
     l as (select detection_no, greatest(sqrt(sum(x * x)), 1e-8) as len from d group by 1)
select detection_no, pos::bigint as pos, round(x / len, 6) as value from d join l using (detection_no) where x <> 0
""",
    "mask_pixels",
)
def b13(spark, sf):
    made = emb.rgb_histogram(relation(spark, sf, "mask_pixels"), ["detection_no"])
    return (
        made.select("detection_no", F.posexplode("descriptor").alias("pos", "value"))
        .filter(F.col("value") != 0)
        .select("detection_no", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))
    )


@query(
    "b14_mean_pool",
    """
with x as (select label, unnest(range(64)) as dim, unnest(embedding::double[]) as x from embeddings),
     m as (select label, dim, avg(x) as x from x group by 1, 2),
     n as (select label, sqrt(sum(x*x)) as n from m group by 1)
select label, dim, round(x / n, 6) as value from m join n using (label)
""",
)
def b14(spark, sf):
    pooled = emb.mean_pool(table(spark, sf, "embeddings"), ["label"], "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "value")).select(
        "label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value")
    )


def window_questions(spark, sf):
    """One question per recording: a vector and two action names."""
    names = ["click", "view", "purchase", "signup", "error"]
    pick = lambda shift: F.concat(
        F.lit("Doing "), F.element_at(F.array(*[F.lit(n) for n in names]), ((F.col("video_no") + shift) % 5 + 1).cast("int"))
    )
    asked = relation(spark, sf, "recordings").select(
        "video_id", "video_no", ((F.col("video_no") * 7) % vector_count(spark, sf)).alias("vec_id")
    )
    return with_vectors(asked, spark, sf).select(
        F.concat(F.lit("ask-"), "video_id").alias("query_id"), "video_id", F.col("vector").alias("q_vector"),
        F.array(pick(0), pick(2)).alias("action_names"),
    )


def named_windows(spark, sf):
    """Windows with the names of their actions and the id of their vector."""
    from evidex.plans.relations import annotated_windows

    return annotated_windows(spark, sf).withColumn("action_names", F.transform("actions", lambda a: a["name"]))


B15_SQL = """
ask as (select concat('ask-', video_id) as query_id, video_id, (video_no * 7) % (select count(*) from embeddings) as q_vec,
          concat('Doing ', ['click','view','purchase','signup','error'][video_no % 5 + 1]) as n1,
          concat('Doing ', ['click','view','purchase','signup','error'][(video_no + 2) % 5 + 1]) as n2 from recordings),
vu as (select vec_id, embedding::double[] as v, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as q from embeddings),
hit as (select distinct a.query_id, w.window_id from ask a join window_actions w on w.video_id = a.video_id and w.name in (a.n1, a.n2)),
sc as (select a.query_id, w.window_id, w.video_id, w.start_s, w.end_s, w.ord, round(list_dot_product(m.v, q.q), 9) as s
       from ask a join hit h using (query_id) join windows w on w.window_id = h.window_id
       join vu m on m.vec_id = w.vec_id join vu q on q.vec_id = a.q_vec),
fetched as (select *, round(s, 4) as score from (select *, row_number() over (partition by query_id order by s desc, ord) as rank from sc) where rank <= 32),
lead as (select *, first(start_s) over w as fs, first(end_s) over w as fe, row_number() over w as n from fetched window w as (partition by query_id, video_id order by rank)),
far as (select *, case when n > 1 and (case when greatest(end_s, fe) - least(start_s, fs) > 0
            then greatest(0, least(end_s, fe) - greatest(start_s, fs)) / (greatest(end_s, fe) - least(start_s, fs)) else 0 end) < 0.25 then rank end as fr from lead),
kept as (select *, row_number() over (partition by query_id order by rank) as place from
   (select *, min(fr) over (partition by query_id, video_id) as second from far) where n = 1 or rank = second)
"""


@query(
    "b15_scoped_window_search",
    f"with {B15_SQL} select query_id, window_id, place as rank, score from kept where place <= 8",
    "windows window_actions",
)
def b15(spark, sf):
    rows = named_windows(spark, sf).select("video_id", "ord", "vec_id", "window_id", "start_s", "end_s", "action_names")
    found = search.scoped_window_search(window_questions(spark, sf), rows, 8, vectors=vectors(spark, sf))
    return found.select("query_id", "window_id", "rank", "score")


OPEN_SQL = (
    B15_SQL.replace("n2 from recordings)", "n2, video_no % 2 = 0 as named from recordings)")
    .replace(
        "join window_actions w on w.video_id = a.video_id and w.name in (a.n1, a.n2))",
        "join window_actions w on w.name in (a.n1, a.n2) where a.named union all select a.query_id, w.window_id from ask a join windows w on not a.named)",
    )
)


@query(
    "b15_open_search",
    f"with {OPEN_SQL} select query_id, window_id, place as rank, score from kept where place <= 8",
    "windows window_actions",
)
def b15_open(spark, sf):
    """Every recording's question over all recordings; every second one names two actions."""
    numbers = relation(spark, sf, "recordings").select("video_id", "video_no")
    asked = window_questions(spark, sf).join(numbers, "video_id").withColumn(
        "action_names", F.when(F.col("video_no") % 2 == 0, F.col("action_names"))
    )
    rows = named_windows(spark, sf).select("ord", "vec_id", "window_id", "video_id", "start_s", "end_s", "action_names")
    found = search.open_window_search(asked, cut_lineage(rows, "windows"), 8, vectors=vectors(spark, sf))
    return found.select("query_id", "window_id", "rank", "score")


@query(
    "b16_record_lookup",
    "select d.doc_id, l.quality, l.toxic, l.doc_id is not null as found from documents d left join labels l using (doc_id)",
)
def b16(spark, sf):
    return emb.lookup(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")
