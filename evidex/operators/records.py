"""Review records: inspections, findings, caches and response checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SUPPORT_SHOWN = 10


def evidence_rows(requests: DataFrame) -> DataFrame:
    """Ranked evidence of inspection requests with ``evidence_ids array<string>``."""
    return requests.select(
        "inspection_id", F.posexplode("evidence_ids").alias("_p", "observation_id")
    ).select(
        "inspection_id", "observation_id", F.lit("memory").alias("collection"), (F.col("_p") + 1).alias("rank"),
        F.lit(None).cast("double").alias("score"), F.lit("supporting").alias("role"),
    )


def evidence_problems(evidence: DataFrame, memory: DataFrame) -> DataFrame:
    """Repeated or unknown evidence ids of a request."""
    repeated = (
        evidence.groupBy("inspection_id", "observation_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
        .select("inspection_id", "observation_id", F.lit("repeated").alias("problem"))
    )
    unknown = (
        evidence.select("inspection_id", "observation_id").distinct()
        .join(memory.select("observation_id"), "observation_id", "left_anti")
        .select("inspection_id", "observation_id", F.lit("unknown").alias("problem"))
    )
    return repeated.unionByName(unknown)


def new_inspections(requests: DataFrame, memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inspection and evidence rows of the requests without a problem."""
    evidence = evidence_rows(requests)
    bad = evidence_problems(evidence, memory).select("inspection_id").distinct()
    good = requests.join(bad, "inspection_id", "left_anti")
    some = F.size("evidence_ids") > 0
    inspections = good.select(
        "inspection_id", "title", "question", "created_at",
        F.when(some, "supported_with_limits").otherwise("insufficient_evidence").alias("status"),
        F.when(some, "Stored with the evidence chosen.")
        .otherwise("Stored; choose evidence first.").alias("result_text"),
        F.array(F.lit("The evidence shows neither lasting identity nor motion of an object.")).alias("limitations"),
    )
    return inspections, evidence.join(bad, "inspection_id", "left_anti")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest(events: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Current value of each field: the last one that was set."""
    return events.groupBy(key).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    )


def inspection_list(inspections: DataFrame) -> DataFrame:
    return inspections.orderBy(F.col("created_at").desc(), "inspection_id")


def inspection_detail(inspections: DataFrame, evidence: DataFrame) -> DataFrame:
    """Inspections with their evidence by rank."""
    packed = evidence.groupBy("inspection_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "observation_id"))).alias("evidence")
    )
    return inspections.join(packed, "inspection_id", "left")


def valid_findings(findings: DataFrame, videos: DataFrame) -> DataFrame:
    """Findings of a known recording whose interval is not empty."""
    return findings.filter(F.col("end_s") > F.col("start_s")).join(
        videos.select("video_id"), "video_id", "left_semi"
    )


# The classes in the order in which visits are compared.
COMPARED_CLASSES = ("chair", "waste_bin", "box")


def support_order(visit: Column, object_class: Column, rank: Column) -> Column:
    """Place of a candidate: its visit by number, the class order, its rank."""
    place = F.array_position(F.array(*[F.lit(c) for c in COMPARED_CLASSES]), object_class)
    return F.struct(visit.cast("long").alias("a"), place.cast("long").alias("b"), rank.cast("long").alias("c"))


def comparison_support(requests: DataFrame, pairs: DataFrame, comparisons: DataFrame, shown: int = SUPPORT_SHOWN) -> DataFrame:
    """First supporting candidates of each kind for the earlier visit of a request.

    ``requests``: ``inspection_id, earlier_observation``; the others: ``earlier_observation,
    item_id, item_order``.
    """
    both = pairs.select("earlier_observation", "item_id", "item_order", F.lit("association").alias("kind")).unionByName(
        comparisons.select("earlier_observation", "item_id", "item_order", F.lit("geometry").alias("kind"))
    )
    place = F.row_number().over(Window.partitionBy("earlier_observation", "kind").orderBy("item_order"))
    first = both.withColumn("place", place).filter(F.col("place") <= shown)
    return requests.join(first, "earlier_observation")


def content_key(*parts: Column) -> Column:
    """sha-256 over length-prefixed parts; arrays are joined first."""
    framed = [F.concat_ws(":", F.length(p).cast("string"), p) for p in parts]
    return F.sha2(F.concat_ws("|", *framed), 256)


def cache_split(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answered requests and those still to do, by ``cache_key``."""
    return requests.join(cache, "cache_key"), requests.join(cache, "cache_key", "left_anti")


def citation_problems(answers: DataFrame) -> DataFrame:
    """Cited ids that were not supplied, and supported answers without citation.

    ``answers``: ``answer_id, cited array, supplied array, supported boolean``.
    """
    unknown = F.array_except("cited", "supplied")
    problem = (
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(unknown), ",")))
        .when(F.col("supported") & (F.size("cited") == 0), "uncited")
    )
    return answers.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("answer_id", "problem")


def whitelist_labels(responses: DataFrame, labels: str, vocabulary: str) -> DataFrame:
    """Keep the returned labels that exist; unsupported when none is left."""
    kept = F.array_sort(F.array_intersect(labels, vocabulary))
    return responses.withColumn("matched", kept).withColumn("unsupported", F.size("matched") == 0)
