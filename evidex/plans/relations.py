"""Relations of the evidence model derived from the given tables.

``SHARED`` holds SQL both engines read; ``<<i>>`` stands for list access and
``{table}`` for a table.  Windows are built by the library on the Spark side and
by ``WINDOW_SQL`` on the other, so the two sides check each other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidex.operators.joins import grown

SHARED: dict[str, str] = {
    # one "second" of a recording is one hour of the event's timestamp
    "actions": """
select concat('u', cast(user_id as varchar(20))) as video_id, user_id as video_no, event_id as pos,
       event_type as action_id, concat('Doing ', event_type) as name,
       round((cast(extract(day from ts) as double)-1)*24 + cast(extract(hour from ts) as double)
             + cast(extract(minute from ts) as double)/cast(60 as double), 3) as start_s,
       round(round((cast(extract(day from ts) as double)-1)*24 + cast(extract(hour from ts) as double)
             + cast(extract(minute from ts) as double)/cast(60 as double), 3) + 1 + value/100, 4) as end_s
from {events}""",
    "recordings": """
select concat('u', cast(e.user_id as varchar(20))) as video_id, e.user_id as video_no,
       case when e.user_id % 4 = 0 then 'test' else 'train' end as split, e.length_s,
       concat(c.c_name, '; ', lower(c.c_mktsegment)) as description,
       case when c.c_nationkey % 3 = 0 then '' else concat('script of ', c.c_name) end as script,
       coalesce(n.n_name, '') as scene, case when c.c_nationkey % 5 = 0 then ' ' else c.c_name end as subject,
       lower(c.c_mktsegment) as object_a, lower(coalesce(n.n_name, 'none')) as object_b
from (select user_id, max(ceil((cast(extract(day from ts) as double)-1)*24 + cast(extract(hour from ts) as double)
           + cast(extract(minute from ts) as double)/cast(60 as double) + 1 + value/100)) as length_s
      from {events} group by user_id) e
left join {customer} c on c.c_custkey = e.user_id
left join {nation} n on n.n_nationkey = c.c_nationkey""",
    "observations": """
select concat('office:seq-', cast(label as varchar(20)), ':', cast(vec_id as varchar(20))) as observation_id,
       concat('seq-', cast(label as varchar(20))) as sequence_id, label as sequence_no, vec_id as step,
       case when vec_id % 5 = 0 then 'query' else 'memory' end as split,
       round(2*cast(<<1>> as double),6) as tx, round(2*cast(<<2>> as double),6) as ty,
       round(2*cast(<<3>> as double),6) as tz,
       round(atan2(cast(<<5>> as double), cast(<<4>> as double)),6) as yaw, embedding
from {embeddings}""",
    # 60 x 40 images
    "raw_detections": """
select concat('f', cast(l_orderkey as varchar(20))) as frame_id, l_orderkey as frame_no,
       l_orderkey % 4 as observation, l_linenumber as src_order, l_partkey, l_suppkey,
       case l_returnflag when 'R' then 'office chair' when 'N' then 'trash bin'
            else case l_linestatus when 'O' then 'storage box' else 'lamp' end end as phrase,
       round(0.25 + l_discount*5,6) as score, l_quantity as x1, round(l_tax*500,6) as y1,
       l_quantity + 10 + l_partkey % 8 as x2, round(l_tax*500 + 10 + l_suppkey % 8,6) as y2
from {lineitem}""",
    "points": """
select cast(floor(l_orderkey / 40.0) as bigint) as frame_no, l_quantity as x, round(l_tax*100,6) as y, round(l_discount*100,6) as z,
       l_partkey % 256 as r, (l_partkey*7) % 256 as g, (l_partkey*13) % 256 as b,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
from {lineitem}""",
    "mask_pixels": """
select o_custkey as detection_no, o_custkey as frame_no, o_orderkey as px_order,
       o_orderkey % 60 as px, (o_orderkey * 7) % 40 as py,
       o_orderkey % 256 as r, (o_orderkey*7) % 256 as g, (o_orderkey*13) % 256 as b
from {orders}""",
    # visits of an office: one object evidence row per vector
    "sightings": """
select concat('v', cast(vec_id % 4 as varchar(20)), ':det-', cast(vec_id as varchar(20))) as detection_id,
       vec_id as ord, vec_id % 4 as observation,
       case label % 3 when 0 then 'chair' when 1 then 'waste_bin' else 'box' end as object_class,
       round(0.3 + 0.5*abs(cast(<<6>> as double)),6) as score,
       round(0.5 + 0.4*abs(cast(<<7>> as double)),6) as mask_score,
       round(0.0005 + abs(cast(<<8>> as double)),6) as mask_area_fraction,
       (vec_id * 37) % 700 as point_count,
       round(4*cast(<<9>> as double),6) as cx, round(4*cast(<<10>> as double),6) as cy,
       round(4*cast(<<11>> as double),6) as cz, vec_id % 11 = 0 as lost, embedding
from {embeddings}""",
    "questions": """
select concat('q', cast(item_id as varchar(20))) as question_id, item_id, text as question,
       case item_id % 4 when 0 then 'locate' when 1 then 'change' when 2 then 'object' else 'boundary' end as category,
       case when item_id % 6 = 5 then 'object-visits' else 'posed-frames' end as dataset,
       case item_id % 5 when 0 then 'supported' when 1 then 'supported_with_limits'
            when 2 then 'requires_manual_review' when 3 then 'supported' else 'unsupported' end as answerability,
       item_id % (select count(*) from {embeddings}) as source_ord,
       case when item_id % 3 = 0 then concat('zone-', cast(item_id % 7 as varchar(20))) end as expected_zone,
       case when item_id % 3 = 1 then concat('seq-', cast(item_id % 10 as varchar(20))) end as expected_visit,
       case when item_id % 6 = 5 then 'chair' end as expected_object_class,
       case when item_id % 12 = 5 then 'detection' end as expected_artifact,
       (item_id * 7) % (select count(*) from {embeddings}) as expected_ord
from {benchmark}""",
}

WINDOW_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    # a recording's windows of 4 s every 2 s; the last one is the first to touch the end
    "windows": (
        """
select printf('%s:%.2f-%.2f', video_id, start_s, end_s) as window_id, video_id, video_no, window_no, split,
       start_s, end_s, length_s as duration_s, video_no * 4294967296 + window_no as ord,
       (video_no * 361 + window_no) % (select count(*) from embeddings) as vec_id,
       description, script, scene, subject, object_a, object_b
from (select *, 2.0::double * window_no as start_s, least(2.0::double * window_no + 4, length_s) as end_s
      from (select *, unnest(range(least(greatest(1, ceil((length_s-4)/2)+1), ceil(length_s/2))::bigint)) as window_no
            from recordings where length_s > 0))""",
        ("recordings",),
    ),
    "window_actions": (
        """
select w.window_id, w.video_id, w.video_no, w.window_no, w.split, w.ord, w.vec_id,
       w.start_s as window_start_s, w.end_s as window_end_s, w.duration_s,
       a.pos, a.action_id, a.name, a.start_s, a.end_s
from windows w join actions a on a.video_id = w.video_id and a.end_s > w.start_s and a.start_s < w.end_s""",
        ("windows", "actions"),
    ),
    "window_labels": (
        """
select window_id, string_agg(distinct action_id, ',' order by action_id) as action_ids,
       string_agg(distinct name, ',' order by name) as names from window_actions group by window_id""",
        ("window_actions",),
    ),
}
_TABLE = re.compile(r"\{(\w+)\}")


def _for_duckdb(name: str) -> str:
    text = _TABLE.sub(r"\1", SHARED[name])
    return re.sub(r"<<(\d+)>>", r"embedding[\1]", text)


def _collect(name: str, ordered: list[str]) -> None:
    for needed in WINDOW_SQL.get(name, ("", ()))[1]:
        _collect(needed, ordered)
    if name not in ordered:
        ordered.append(name)


def with_relations(sql: str, names: list[str]) -> str:
    """``sql`` with the named relations in front of it as common tables."""
    ordered: list[str] = []
    for name in names:
        _collect(name, ordered)
    bodies = [
        f"{n} as ({_for_duckdb(n) if n in SHARED else WINDOW_SQL[n][0]})" for n in ordered
    ]
    text = sql.strip()
    if not bodies:
        return text
    head = "with recursive " + ",\n".join(bodies)
    if text.lower().startswith("with recursive "):
        return f"{head},\n{text[15:]}"
    if text.lower().startswith("with "):
        return f"{head},\n{text[5:]}"
    return f"{head}\n{text}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared relation as a lazy DataFrame over the parquet tables."""
    text = re.sub(r"<<(\d+)>>", r"element_at(embedding,\1)", SHARED[name])
    tables = {t: table(spark, sf_dir, t) for t in set(_TABLE.findall(text))}
    if "customer" in tables:  # its files are far smaller than its rows
        tables["customer"] = grown(tables["customer"])
    return spark.sql(text, **tables)


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "recordings").withColumn("objects", F.array("object_a", "object_b"))


def vector_count(spark: SparkSession, sf_dir: str) -> Column:
    """The number of vectors as a scalar subquery."""
    return table(spark, sf_dir, "embeddings").agg(F.count("*")).scalar()


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with their ordinal and the id of their vector, without actions."""
    from evidex.operators.windows import sliding_windows

    made = sliding_windows(recordings(spark, sf_dir))
    return made.withColumn("ord", F.col("video_no") * (1 << 32) + F.col("window_no")).withColumn(
        "vec_id", (F.col("video_no") * 361 + F.col("window_no")) % vector_count(spark, sf_dir)
    )


def window_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidex.operators.windows import window_action_overlap

    return window_action_overlap(windows(spark, sf_dir), relation(spark, sf_dir, "actions"))


def annotated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with their overlapping actions as an array in source order."""
    from evidex.operators.windows import attach_actions

    return attach_actions(windows(spark, sf_dir), relation(spark, sf_dir, "actions"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


def with_vectors(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return grown(grown(df).join(vectors(spark, sf_dir), "vec_id"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posed frames: translation, flat rotation, vector, zone."""
    from evidex.functions.poses import yaw_rotation

    return (
        relation(spark, sf_dir, "observations")
        .withColumn("translation", F.array("tx", "ty", "tz"))
        .withColumn("rotation", yaw_rotation(F.col("yaw")))
        .withColumn("zone", F.concat(F.lit("zone-"), (F.col("sequence_no") % 7).cast("string")))
        .withColumnRenamed("embedding", "vector")
    )


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector output with its box; the part and supplier make the order total."""
    return relation(spark, sf_dir, "raw_detections").withColumn(
        "box", F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    )
