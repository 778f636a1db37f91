"""Retrieval evaluation against poses, places and annotated intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidex.functions.intervals import boundary_error, interval_iou
from evidex.operators import blocks
from evidex.operators.blocks import ScanSpec, best_rows, scan_blocks
from evidex.operators.embeddings import normalize
from evidex.operators.places import RELAXED, STRICT, with_pose_errors
from evidex.operators.joins import grown
from evidex.operators.quantiles import exact_quantiles
from evidex.operators.sampling import distinct_ordinals
from evidex.operators.scan import ordinal
from evidex.session import cut_lineage

CUTS = (1, 5, 10)
LEVELS = ("strict", "relaxed")
THRESHOLDS = (("strict", *STRICT), ("relaxed", *RELAXED))


def _relevant(level: str) -> Column:
    metres, degrees = STRICT if level == "strict" else RELAXED
    return (F.col("translation_error_m") <= metres) & (F.col("rotation_error_deg") <= degrees)


def _query_side(queries: DataFrame) -> DataFrame:
    return normalize(queries, "vector", strict=True).select(
        F.col("observation_id").alias("query_id"), F.col("ord").alias("q_ord"), F.col("vector").alias("q_vector"),
        F.col("translation").alias("q_translation"), F.col("rotation").alias("q_rotation"),
    )


def pose_retrievals(
    queries: DataFrame, memory: DataFrame, per_target: bool = False, max_broadcast_rows: int = blocks.MAX_BROADCAST_ROWS
) -> DataFrame:
    """Top ten rows per query (and target sequence) with pose errors, and on each
    row the query's totals: relevant counts and nearest pose over all of memory.

    Both sides: ``observation_id, ord, vector, translation, rotation, sequence_id``.
    One pass over memory scores vectors and poses block by block; its result, ten
    rows per query, is stored since rows, details and quantiles all read it.
    """
    spec = ScanSpec(
        k=max(CUTS), payload=(("observation_id", "string"),), poses=True, thresholds=THRESHOLDS,
        group="target_sequence_id" if per_target else None,
    )
    rows = memory.select(
        "observation_id", "ord", "vector", "translation", "rotation", F.col("sequence_id").alias("target_sequence_id")
    )
    partial = scan_blocks(_query_side(queries), rows, spec, max_broadcast_rows)
    keys = ["query_id"] + (["target_sequence_id"] if per_target else [])
    whole = Window.partitionBy(*keys)
    order = Window.partitionBy(*keys).orderBy(F.col("ord").isNull(), F.col("score").desc(), "ord")
    ranked = (
        partial.withColumn("nearest_pose_translation_m", F.min("nearest_pose_m").over(whole))
        .withColumn("strict_relevant_count", F.sum("strict_count").over(whole))
        .withColumn("relaxed_relevant_count", F.sum("relaxed_count").over(whole))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("ord").isNotNull() & (F.col("rank") <= max(CUTS)))
        .drop("nearest_pose_m", "strict_count", "relaxed_count", "ord")
    )
    return cut_lineage(ranked, "retrievals")


def random_retrievals(queries: DataFrame, memory: DataFrame, seed: int = 42, pairs: DataFrame | None = None) -> DataFrame:
    """Ten seeded pseudo-random rows per query without replacement, in random order, with pose errors.

    ``pairs`` (query_id, target_sequence_id), as of ``pose_retrievals`` per target: ten rows of each of
    these targets instead.  Ordinals are drawn by arithmetic and meet the numbered rows of memory in
    one equality join of ten rows per query; no other pair is made."""
    keys = [] if pairs is None else ["target_sequence_id"]
    rows = memory.select("observation_id", "ord", "translation", "rotation", F.col("sequence_id").alias("target_sequence_id"))
    placed = ordinal(rows, keys, [F.col("ord")], F.floor(F.col("ord") / 65536), "_ordinal")
    asked = queries.select(
        F.col("observation_id").alias("query_id"), F.col("ord").alias("_key"),
        F.col("translation").alias("q_translation"), F.col("rotation").alias("q_rotation"),
    )
    if pairs is None:
        sized = asked.withColumn("_n", rows.agg(F.count("*")).scalar())
    else:
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
        sized = asked.join(pairs.select("query_id", *keys).distinct(), "query_id").join(sizes, keys)
    drawn = sized.select(
        "query_id", *keys, "q_translation", "q_rotation",
        F.posexplode(distinct_ordinals(F.col("_key"), F.col("_n"), max(CUTS), seed)).alias("_at", "_d"),
    ).select(
        "query_id", *keys, "q_translation", "q_rotation", (F.col("_at") + 1).alias("rank"), F.col("_d.draw").alias("draw"),
        F.col("_d.ordinal").alias("_ordinal"),
    )
    names = {"translation": "m_translation", "rotation": "m_rotation"}
    picked = drawn.join(placed.withColumnsRenamed(names).drop(*({"target_sequence_id"} - set(keys))), [*keys, "_ordinal"])
    return with_pose_errors(picked, "q", "m").drop("_ordinal", "q_translation", "q_rotation", "m_translation", "m_rotation")


def _hits(prefix: str = "") -> list[Column]:
    return [
        F.max((F.col("rank") <= k) & _relevant(level)).alias(f"{prefix}{level}_hit_at_{k}") for level in LEVELS for k in CUTS
    ]


def random_hits(picks: DataFrame, keys: list[str]) -> DataFrame:
    return picks.groupBy(*keys).agg(*_hits("random_"))


def pose_rows(queries: DataFrame, retrievals: DataFrame, picks: DataFrame, per_target: bool = False) -> DataFrame:
    """One evaluation row per query (and target)."""
    keys = ["query_id"] + (["target_sequence_id"] if per_target else [])
    top = lambda name: F.min_by(name, "rank")
    rows = retrievals.groupBy(*keys).agg(
        top("translation_error_m").alias("top1_translation_error_m"),
        top("rotation_error_deg").alias("top1_rotation_error_deg"),
        F.max("nearest_pose_translation_m").alias("nearest_pose_translation_m"),
        *[F.max(f"{level}_relevant_count").alias(f"{level}_relevant_count") for level in LEVELS],
        *_hits(),
    )
    source = queries.select(
        F.col("observation_id").alias("query_id"), F.col("sequence_id").alias("source_sequence_id" if per_target else "sequence_id"), "step"
    )
    eligible = [(F.col(f"{level}_relevant_count") > 0).alias(f"{level}_eligible") for level in LEVELS]
    return source.join(rows.select("*", *eligible), "query_id").join(random_hits(picks, keys), keys)


def nest_retrievals(rows: DataFrame, retrievals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their ten retrievals as an array, for a document sink."""
    item = F.struct("rank", "observation_id", "score", "translation_error_m", "rotation_error_deg")
    packed = retrievals.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("retrievals"))
    return rows.join(packed, keys)


def rate_metrics(rows: DataFrame, sets: list[list[str]] | None = None) -> DataFrame:
    """Coverage and hit rates, long by ``(level, source, k)``.

    With ``sets`` the same numbers per grouping set in one pass; a covered rate
    counts hits of eligible rows only and is 0 without any.
    """
    columns = []
    for level in LEVELS:
        eligible = F.col(f"{level}_eligible").cast("long")
        columns += [F.avg(eligible.cast("double")).alias(f"{level}_coverage"), F.sum(eligible).alias(f"{level}_eligible_n")]
        for source in ("", "random_"):
            for k in CUTS:
                hit = F.col(f"{source}{level}_hit_at_{k}")
                columns.append(F.sum((hit & F.col(f"{level}_eligible")).cast("long")).alias(f"{source}{level}_covered_{k}"))
                columns.append(F.avg(hit.cast("double")).alias(f"{source}{level}_all_{k}"))
    keys = sorted({c for group in sets or [] for c in group})
    if sets:
        grouped = rows.groupingSets([[F.col(c) for c in group] for group in sets], *[F.col(c) for c in keys]).agg(
            F.count("*").alias("rows"), F.grouping_id().alias("grouping"), *columns
        )
    else:
        grouped = rows.agg(F.count("*").alias("rows"), *columns)
    parts = []
    for level in LEVELS:
        for source in ("", "random_"):
            for k in CUTS:
                share = F.col(f"{source}{level}_covered_{k}") / F.col(f"{level}_eligible_n")
                parts.append(
                    F.struct(
                        F.lit(level).alias("level"), F.lit("random" if source else "model").alias("source"), F.lit(k).alias("k"),
                        F.col(f"{level}_coverage").alias("coverage"), F.col(f"{level}_eligible_n").alias("eligible"),
                        F.when(F.col(f"{level}_eligible_n") > 0, share).otherwise(F.lit(0.0)).alias("covered_rate"),
                        F.col(f"{source}{level}_all_{k}").alias("all_rate"),
                    )
                )
    extra = ["grouping"] if sets else []
    return grouped.select(*keys, *extra, "rows", F.explode(F.array(*parts)).alias("m")).select(*keys, *extra, "rows", "m.*")


def error_quantiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Median and p90 of both top-1 errors per key."""
    probs = {"median": 0.5, "p90": 0.9}
    rows = cut_lineage(rows.select(*keys, "top1_translation_error_m", "top1_rotation_error_deg"), "errors")
    metres = exact_quantiles(rows, keys, "top1_translation_error_m", probs, 0.01)
    degrees = exact_quantiles(rows, keys, "top1_rotation_error_deg", probs, 0.5)
    return metres.withColumn("error", F.lit("translation_m")).unionByName(degrees.withColumn("error", F.lit("rotation_deg")))


def per_sequence(rows: DataFrame) -> DataFrame:
    rate = lambda name: F.avg(F.col(name).cast("double"))
    return rows.groupBy("sequence_id").agg(
        F.count("*").alias("query_count"), rate("strict_eligible").alias("strict_coverage"),
        rate("strict_hit_at_1").alias("strict_hit_at_1"), rate("strict_hit_at_5").alias("strict_hit_at_5"),
    )


def stride_subset(rows: DataFrame, stride: int = 10) -> DataFrame:
    return rows.filter(F.col("step") % stride == 0)


def macro_pair(pair_metrics: DataFrame) -> DataFrame:
    """Mean over source-target pairs; covered rates only over pairs with eligible rows."""
    covered = F.avg(F.when(F.col("eligible") > 0, F.col("covered_rate")))
    return pair_metrics.groupBy("level", "source", "k").agg(
        F.avg("coverage").alias("coverage"), F.coalesce(covered, F.lit(0.0)).alias("covered_rate"), F.avg("all_rate").alias("all_rate")
    )


def disjoint_check(memory: DataFrame, queries: DataFrame) -> DataFrame:
    """Violations ``(observation_id, problem)`` before a traversal evaluation.

    Where both sides name ``model_id`` and ``model_revision``, they must share one model; if they do
    not, every model is listed as ``id@revision``.
    """
    from evidex.operators.embeddings import model_guard

    ids = memory.select("observation_id").join(queries.select("observation_id"), "observation_id", "left_semi").distinct()
    both = memory.select("observation_id", "sequence_id", "pose_ok").unionByName(queries.select("observation_id", "sequence_id", "pose_ok"))
    blank = F.trim(F.coalesce("sequence_id", F.lit(""))) == ""
    problems = F.array(F.when(blank, "no_sequence"), F.when(~F.coalesce("pose_ok", F.lit(False)), "bad_pose"))
    bad = both.select("observation_id", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem")).distinct()
    found = ids.withColumn("problem", F.lit("shared_id")).unionByName(bad)
    if not {"model_id", "model_revision"} <= set(memory.columns) & set(queries.columns):
        return found
    models = model_guard(memory, queries).select(F.concat_ws("@", "model_id", "model_revision").alias("observation_id"))
    return found.unionByName(models.withColumn("problem", F.lit("model_mismatch")))


def zone_prompt_rows(prompts: DataFrame, memory: DataFrame) -> DataFrame:
    """Hits and precision of place prompts ``(query_id, zone, style, vector)`` over
    ``memory(ord, vector, zone)``."""
    from evidex.operators.search import cosine_topk

    found = cosine_topk(prompts.select("query_id", "vector"), memory, max(CUTS)).withColumnRenamed("zone", "m_zone")
    sizes = memory.filter(F.col("zone").isNotNull()).groupBy("zone").agg(F.count("*").alias("relevant_frame_count"))
    relevant = F.coalesce(F.col("m_zone") == F.col("zone"), F.lit(False))
    judged = found.join(prompts.select("query_id", "zone", "style"), "query_id").withColumn("_ok", relevant)
    within = lambda k: F.when(F.col("rank") <= k, F.col("_ok").cast("double"))
    rows = judged.groupBy("query_id", "zone", "style").agg(
        *[(F.max(within(k)) == 1.0).alias(f"hit_at_{k}") for k in CUTS], *[F.avg(within(k)).alias(f"precision_at_{k}") for k in CUTS]
    )
    return rows.join(sizes, "zone", "left").withColumn(
        "relevant_frame_count",
        F.coalesce("relevant_frame_count", F.raise_error(F.concat(F.lit("no assigned frames in "), "zone"))),
    )


def zone_macro(rows: DataFrame) -> DataFrame:
    """Macro means over all prompts (null zone) and per zone, in one rollup."""
    return rows.rollup("zone").agg(
        F.count("*").alias("prompt_count"),
        *[F.avg(F.col(f"hit_at_{k}").cast("double")).alias(f"macro_hit_at_{k}") for k in CUTS],
        *[F.avg(f"precision_at_{k}").alias(f"macro_precision_at_{k}") for k in CUTS],
    )


def exact_mean(name: str) -> Column:
    """The mean of doubles below 1e15, to twelve places.  Summed as decimals: a sum of doubles follows the
    order of its rows, and the mean of short numbers often lies just between two roundings."""
    return F.sum(F.col(name).cast("decimal(28,12)")) / F.count(name)


def assignment_coverage(records: DataFrame, unassigned: str = "unassigned") -> DataFrame:
    """Zones, assigned and unassigned frames and their share; ``records``: ``observation_id, zone``."""
    given = F.coalesce(F.col("zone") != unassigned, F.lit(False))
    counts = records.agg(
        F.count_distinct(F.when(given, F.col("zone"))).alias("zone_count"),
        F.coalesce(F.sum(given.cast("long")), F.lit(0)).alias("assigned_frame_count"),
        F.coalesce(F.sum((~given).cast("long")), F.lit(0)).alias("unassigned_frame_count"),
    )
    total = F.col("assigned_frame_count") + F.col("unassigned_frame_count")
    return counts.withColumn("assignment_coverage", F.try_divide("assigned_frame_count", total))


def temporal_results(query_vectors: DataFrame, index: DataFrame, k: int = 10, vectors: DataFrame | None = None) -> DataFrame:
    """Diversified top ``k`` windows per distinct query vector.

    Questions that share a text share a vector, so the search runs once per
    distinct vector (``query_id, vector``) and not once per question.  With ``vectors``
    (``vec_id, vector``) windows name a ``vec_id`` instead of holding a vector, and none is sent per window.
    """
    from evidex.operators.ranking import diversify_by_interval
    from evidex.operators.search import cosine_topk, vector_search

    columns = ["ord", "window_id", "video_id", "start_s", "end_s"]
    if vectors is not None:
        fetched = vector_search(query_vectors, index.select("vec_id", *columns), vectors, 4 * k)
    else:
        fetched = cosine_topk(query_vectors, index.select("vector", *columns), 4 * k)
    return diversify_by_interval(fetched, k)


def temporal_rows(queries: DataFrame, results: DataFrame, labels: DataFrame) -> DataFrame:
    """Judge each query window by its first relevant result.

    ``queries``: ``window_id, end_s, vector_key, actions``; ``results``: ``query_id``
    (= vector key), ``rank, window_id, start_s, end_s``; ``labels``: ``window_id,
    action_ids``.  A result is relevant when it shares an action id and overlaps
    any action interval of the query.
    """
    found = (
        results.select(F.col("query_id").alias("vector_key"), "rank", F.col("window_id").alias("r_id"), F.col("start_s").alias("r_start"), F.col("end_s").alias("r_end"))
        .join(grown(labels).select(F.col("window_id").alias("r_id"), F.col("action_ids").alias("r_actions")), "r_id", "left")
        .withColumn("r_actions", F.coalesce("r_actions", F.array().cast("array<string>")))
    )
    # At most ten results per vector: they travel as one array.
    item = F.struct("rank", "r_id", "r_start", "r_end", "r_actions")
    packed = found.groupBy("vector_key").agg(F.sort_array(F.collect_list(item)).alias("_results"))
    spans = F.filter("actions", lambda a: a["end_s"] > a["start_s"])
    ids = F.array_distinct(F.transform("actions", lambda a: a["action_id"]))

    def judge(r: Column) -> Column:
        ious = F.transform("_spans", lambda a: interval_iou(r["r_start"], r["r_end"], a["start_s"], a["end_s"]))
        errors = F.transform("_spans", lambda a: boundary_error(r["r_start"], r["r_end"], a["start_s"], a["end_s"]))
        iou = F.coalesce(F.array_max(ious), F.lit(0.0))
        good = F.arrays_overlap("_ids", r["r_actions"]) & (iou > 0)
        return F.struct(r["rank"].alias("rank"), iou.alias("iou"), F.array_min(errors).alias("error"), F.coalesce(good, F.lit(False)).alias("good"))

    judged = (
        grown(queries).join(packed, "vector_key", "left")
        .withColumn("_spans", spans).withColumn("_ids", ids)
        .withColumn("_judged", F.transform("_results", judge))
        .withColumn("_first", F.get(F.filter("_judged", lambda j: j["good"]), F.lit(0)))
    )
    lead = F.get("_results", F.lit(0))
    repeats = F.size(
        F.filter(F.slice("_results", F.lit(2), F.greatest(F.size("_results"), F.lit(0))), lambda r: interval_iou(lead["r_start"], lead["r_end"], r["r_start"], r["r_end"]) > 0)
    ) / F.greatest(F.lit(1), F.size("_results") - 1)
    hit = F.col("_first").isNotNull()
    return judged.select(
        "window_id", F.col("_first.rank").alias("first_rank"), F.col("_first.iou").alias("iou"), F.col("_first.error").alias("error_s"),
        F.when(hit & (F.col("end_s") > 0), F.col("_first.error") / F.col("end_s")).alias("normalized_error"),
        F.when(hit, repeats).alias("duplicate_rate"),
        F.transform("_results", lambda r: r["r_id"]).alias("top_results"),
    )


def recall_summary(rows: DataFrame) -> DataFrame:
    """Recall at the cuts, interval quality and misses over all queries.

    The rows are read for the means and again for each median, so they are stored.
    """
    rows = cut_lineage(rows.drop("top_results"), "judged")
    means = rows.agg(
        F.count("*").alias("query_count"),
        *[F.avg(F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("double")).alias(f"recall_at_{k}") for k in CUTS],
        F.coalesce(F.avg("iou"), F.lit(0.0)).alias("iou_mean"), F.avg("error_s").alias("error_mean_s"),
        F.avg("normalized_error").alias("normalized_error_mean"),
        F.coalesce(F.avg("duplicate_rate"), F.lit(0.0)).alias("duplicate_rate_mean"),
        F.sum(F.col("first_rank").isNull().cast("long")).alias("miss_count"),
    )
    for name, width in (("iou", 0.01), ("error_s", 0.05), ("normalized_error", 0.001)):
        median = exact_quantiles(rows, [], name, {"median": 0.5}, width)
        means = means.withColumn(f"{name}_median", median.scalar())
    return means


def misses(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("first_rank").isNull()).select("window_id", "top_results")


def failure_tags() -> Column:
    """Tags of an evaluation row; the hit tags exclude each other."""
    c = F.col
    hit = (
        F.when(c("strict_hit_at_1"), "strict-top1").when(c("strict_hit_at_5"), "strict-rescued-at5")
        .when(c("strict_hit_at_10"), "strict-rescued-at10").when(c("strict_eligible"), "strict-miss-at10")
    )
    tags = F.array(
        F.when(~c("strict_eligible"), "uncovered"), hit,
        F.when(c("relaxed_hit_at_1") & ~c("strict_hit_at_1"), "relaxed-only-top1"),
        F.when(c("top1_translation_error_m") > 0.5, "large-translation"), F.when(c("top1_rotation_error_deg") > 30.0, "large-rotation"),
    )
    return F.filter(tags, lambda t: t.isNotNull())


def query_page(rows: DataFrame, order: str, offset: int, limit: int, sequence: str | None = None, tag: str | None = None) -> DataFrame:
    """One page of evaluation rows with their tags and the total of the filter."""
    tagged = rows.withColumn("tags", failure_tags())
    if sequence:
        tagged = tagged.filter(F.col("sequence_id") == sequence)
    if tag:
        tagged = tagged.filter(F.array_contains("tags", tag))
    total = tagged.agg(F.count("*")).scalar()
    return tagged.orderBy(order).offset(offset).limit(limit).withColumn("total", total)


def artifact_lookup(questions: DataFrame, artifacts: dict[str, DataFrame]) -> DataFrame:
    """Artifact rows ``(observation_id, object_class)`` of the question's source frame."""
    union = None
    for name, rows in artifacts.items():
        part = rows.select("observation_id", "object_class", F.lit(name).alias("artifact"))
        union = part if union is None else union.unionByName(part)
    asked = questions.select("question_id", F.col("source_observation_id").alias("observation_id"))
    return asked.join(union, "observation_id").withColumn("rank", F.lit(1))


def question_rows(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Evidence flags per question.

    ``questions``: expectation columns (null when not expected) and
    ``expected_ids array<string>``; ``results``: ``question_id, rank,
    observation_id, zone_slug, visit_id, object_class, artifact``.
    """
    c = F.col
    joined = questions.join(results, "question_id", "left")
    same = lambda a, b: F.coalesce(c(a) == c(b), F.lit(False))
    found = F.coalesce(F.array_contains("expected_ids", c("observation_id")), F.lit(False))
    kind_ok = c("expected_object_class").isNull() | same("expected_object_class", "object_class")
    keys = [
        "question_id", "category", "dataset", "answerability", "expected_ids", "expected_zone", "expected_visit",
        "expected_object_class", "expected_artifact",
    ]
    rows = joined.groupBy(*keys).agg(
        F.max(found).alias("_id_hit"), F.max(same("expected_zone", "zone_slug")).alias("zone_hit"),
        F.max(same("expected_visit", "visit_id")).alias("visit_hit"), F.max(same("expected_object_class", "object_class")).alias("object_hit"),
        F.max(same("expected_artifact", "artifact") & kind_ok).alias("artifact_hit"), F.min(F.when(found, c("rank"))).alias("_rank"),
    )
    expects = (F.size("expected_ids") > 0) | F.coalesce("expected_zone", "expected_visit", "expected_object_class", "expected_artifact").isNotNull()
    any_hit = c("_id_hit") | c("zone_hit") | c("visit_hit") | c("object_hit") | c("artifact_hit")
    reciprocal = F.when(F.size("expected_ids") > 0, F.coalesce(F.lit(1.0) / c("_rank"), F.lit(0.0)))
    return (
        rows.withColumn("evidence_hit", F.when(expects, any_hit))
        .withColumn("reciprocal_rank", reciprocal)
        .withColumn("artifact_available", (c("dataset") == "posed-frames") | c("artifact_hit"))
        .withColumn("safe_boundary_case", c("answerability").isin("requires_manual_review", "unsupported"))
        .drop("_id_hit", "_rank")
    )


def question_summary(rows: DataFrame) -> DataFrame:
    """Totals (null category) and per-category counts in one pass.

    The overall recall leaves boundary cases out, the category recall keeps them.
    """
    c = F.col
    known, boundary = c("evidence_hit").isNotNull(), c("safe_boundary_case")
    overall = F.grouping("category") == 1
    scored = F.sum((known & ~boundary).cast("long"))
    hits = F.sum((c("evidence_hit") & ~boundary).cast("long"))
    ranks = F.sum(F.when(known & ~boundary, F.coalesce("reciprocal_rank", F.lit(0.0))))
    return rows.rollup("category").agg(
        F.count("*").alias("question_count"),
        F.when(overall, scored).otherwise(F.sum(known.cast("long"))).alias("scored_question_count"),
        F.when(overall, F.try_divide(hits, scored)).otherwise(F.avg(c("evidence_hit").cast("double"))).alias("evidence_recall"),
        F.when(overall, F.try_divide(ranks, scored)).alias("mean_reciprocal_rank"),
        F.when(overall, F.sum(boundary.cast("long"))).alias("boundary_question_count"),
        F.when(overall, F.sum(c("artifact_available").cast("long"))).alias("artifact_available_count"),
    )
