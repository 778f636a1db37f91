"""Scans of the file formats recordings and artifacts come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from evidex.operators.windows import MODALITIES

# The official sequences of the posed-frame dataset.
TRAIN_SEQUENCES = (1, 3, 4, 5, 8, 10)
TEST_SEQUENCES = (2, 6, 7, 9)
# Allowed answerability of a benchmark question.
ANSWERABILITY = ("supported", "supported_with_limits", "requires_manual_review", "unsupported")
# Fields a question must have; prompt styles of a zone.
QUESTION_FIELDS = ("question_id", "question", "category", "dataset", "answerability", "source_observation_id")
PROMPT_STYLES = ("name", "landmarks", "technician_question")
# Vertex properties a mesh must have.
MESH_PROPERTIES = ("x", "y", "z", "red", "green", "blue", "normal_x", "normal_y", "normal_z")

POSE_ROW_TOLERANCE, ROTATION_TOLERANCE = 1e-4, 2e-3

ANNOTATION_SCHEMA = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("id", "subject", "scene", "script", "descriptions", "objects", "actions", "length")
])
_TEXT, _DOUBLE = T.StringType(), T.DoubleType()
MULTIMODAL_SCHEMA = T.StructType([
    T.StructField("video_id", _TEXT),
    T.StructField("duration_s", _DOUBLE),
    T.StructField("paths", T.MapType(_TEXT, _TEXT)),
    T.StructField("annotations", T.ArrayType(T.StructType([
        T.StructField("start_s", _DOUBLE), T.StructField("end_s", _DOUBLE), T.StructField("label", _TEXT),
        T.StructField("objects", T.ArrayType(_TEXT)), T.StructField("source", _TEXT),
    ]))),
    T.StructField("split", _TEXT),
    T.StructField("summary", _TEXT),
    T.StructField("_corrupt", _TEXT),
])
QUESTION_SCHEMA = T.StructType([
    *[T.StructField(n, _TEXT) for n in QUESTION_FIELDS],
    T.StructField("expected_evidence_ids", T.ArrayType(_TEXT)),
    *[T.StructField(n, _TEXT) for n in ("expected_zone", "expected_visit", "expected_object_class", "expected_artifact", "rationale")],
    T.StructField("_corrupt", _TEXT),
])
ZONE_SCHEMA = T.StructType([
    T.StructField("zones", T.ArrayType(T.StructType([
        T.StructField("slug", _TEXT), T.StructField("name", _TEXT), T.StructField("description", _TEXT),
        T.StructField("prompts", T.MapType(_TEXT, _TEXT)),
    ]))),
    T.StructField("assignments", T.MapType(_TEXT, _TEXT)),
])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema; a malformed line or an empty table fails."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if rows.isEmpty():
        raise ValueError(f"no records in {path}")
    return rows


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The one JSON object of ``path`` as one row; its fields serve as scalar subqueries.

    None or several objects are an error."""
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if len(found.take(2)) != 1:
        raise ValueError(f"{path} does not hold exactly one object")
    return found


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes below a folder; contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return files.load(path).select("path", "length")


def read_annotations(spark: SparkSession, paths: dict[str, str], present: DataFrame) -> DataFrame:
    """Annotation CSVs by split, limited to recordings that have a file.

    ``present``: ``video_id`` of the files found.
    """
    rows = None
    for split, path in paths.items():
        part = spark.read.schema(ANNOTATION_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        part = part.withColumn("split", F.lit(split))
        rows = part if rows is None else rows.unionByName(part)
    text = lambda name: F.coalesce(name, F.lit(""))
    things = F.filter(F.split(text("objects"), ";"), lambda x: x != "")
    return rows.join(present.select(F.col("video_id").alias("id")), "id", "left_semi").select(
        F.col("id").alias("video_id"), "split", text("subject").alias("subject"), text("scene").alias("scene"),
        text("descriptions").alias("description"), text("script").alias("script"), things.alias("objects"),
        F.when(text("length") == "", F.lit(0.0)).otherwise(F.col("length").cast("double")).alias("length_s"),
        text("actions").alias("action_text"),
    )


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """``<id> <name...>`` lines to a dictionary."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).filter(F.trim("value") != "").select(
        parts[0].alias("action_id"), parts[1].alias("name")
    )


def parse_poses(df: DataFrame, text: str) -> DataFrame:
    """Check 4x4 text matrices: ``rotation``, ``translation`` and broken ``rules``."""
    lines = F.filter(F.split(F.col(text), r"\r?\n"), lambda line: F.trim(line) != "")
    matrix = F.transform(
        lines, lambda line: F.transform(F.split(F.trim(line), r"\s+"), lambda x: x.try_cast("double"))
    )
    cell = lambda r, c: F.element_at(F.element_at("_m", r), c)
    column = lambda c: [cell(r, c) for r in (1, 2, 3)]
    inner = lambda a, b: sum((x * y for x, y in zip(column(a), column(b))), F.lit(0.0))
    cross = (
        cell(1, 1) * (cell(2, 2) * cell(3, 3) - cell(2, 3) * cell(3, 2))
        - cell(1, 2) * (cell(2, 1) * cell(3, 3) - cell(2, 3) * cell(3, 1))
        + cell(1, 3) * (cell(2, 1) * cell(3, 2) - cell(2, 2) * cell(3, 1))
    )
    square = (F.size("_m") == 4) & F.forall("_m", lambda row: F.size(row) == 4)
    finite = F.forall(F.flatten("_m"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    last = F.lit(True)
    for c, wanted in enumerate((0.0, 0.0, 0.0, 1.0), start=1):
        last = last & (F.abs(cell(4, c) - wanted) <= POSE_ROW_TOLERANCE)
    unit = F.lit(True)
    for a in (1, 2, 3):
        for b in (1, 2, 3):
            unit = unit & (F.abs(inner(a, b) - (1.0 if a == b else 0.0)) <= ROTATION_TOLERANCE)
    rule = (
        F.when(~square, "shape").when(~finite, "finite").when(~last, "homogeneous_row")
        .when(~(unit & (F.abs(cross - 1.0) <= ROTATION_TOLERANCE)), "rotation")
    )
    parsed = df.withColumn("_m", matrix).withColumn("rule", rule)
    good = F.col("rule").isNull()
    flat = F.array(*[cell(r, c) for r in (1, 2, 3) for c in (1, 2, 3)])
    return (
        parsed.withColumn("rotation", F.when(good, flat))
        .withColumn("translation", F.when(good, F.array(*[cell(r, 4) for r in (1, 2, 3)])))
        .drop("_m", text)
    )


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """One pose per text file, with its path (and partition columns)."""
    files = spark.read.text(path, wholetext=True)
    return parse_poses(files.withColumn("path", F.input_file_name()), "value")


POSE_END = "\x1e"


def write_pose_packs(poses: DataFrame, path: str) -> None:
    """``name, value``: pose texts, many to a file.  A file per pose is a name that the driver must hold."""
    poses.select(F.concat_ws("\n", F.col("name").cast("string"), F.coalesce("value", F.lit("")))).write.option("lineSep", POSE_END).text(path)


def read_pose_packs(spark: SparkSession, path: str) -> DataFrame:
    """``name`` and what ``parse_poses`` makes of files by ``write_pose_packs``; they are read in splits."""
    parts = F.split("value", "\n", 2)
    packs = spark.read.option("lineSep", POSE_END).text(path)
    return parse_poses(packs.select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("value")), "value")


_FRAME_FILE = r"(seq-\d+)/frame-(\d+)\.(color|pose|depth)\.(?:png|txt)$"


def frame_files(listing: DataFrame) -> DataFrame:
    """Sequence, frame number and kind of the frame files in a listing."""
    part = lambda i: F.regexp_extract("path", _FRAME_FILE, i)
    return listing.select("path", part(1).alias("sequence_id"), part(2).alias("_frame"), part(3).alias("kind")).filter(
        F.col("sequence_id") != ""
    ).withColumn("step", F.col("_frame").cast("long")).drop("_frame")


def sequence_inventory(listing: DataFrame, expected_frames: int) -> DataFrame:
    """Files per sequence and kind; ``complete`` needs exactly the expected number
    of colour images and poses."""
    counts = frame_files(listing).groupBy("sequence_id").pivot("kind", ["color", "pose", "depth"]).count().na.fill(0)
    wanted = F.lit(expected_frames)
    return counts.withColumn("complete", (F.col("color") == wanted) & (F.col("pose") == wanted))


def observation_rows(listing: DataFrame) -> DataFrame:
    """Frames by number with both files, and what is missing otherwise."""
    files = frame_files(listing)
    side = lambda kind: files.filter(F.col("kind") == kind).select("sequence_id", "step", F.col("path").alias(f"{kind}_path"))
    both = side("color").join(side("pose"), ["sequence_id", "step"], "full")
    missing = F.when(F.col("color_path").isNull(), "color").when(F.col("pose_path").isNull(), "pose")
    return both.withColumn("missing", missing).withColumn(
        "observation_id", F.format_string("office:%s:%06d", "sequence_id", "step")
    )


def image_problems(images: DataFrame, manifest: DataFrame) -> DataFrame:
    """Images that are not RGB of the declared positive size.

    ``images``: the ``image`` source (struct ``image``); ``manifest``: one row ``width, height``.
    """
    i = F.col("image")
    declared = images.withColumn("_w", manifest.select("width").scalar()).withColumn("_h", manifest.select("height").scalar())
    problem = (
        F.when((F.col("_w") < 1) | (F.col("_h") < 1), "contract").when(i["nChannels"] != 3, "mode")
        .when((i["width"] != F.col("_w")) | (i["height"] != F.col("_h")), "size")
    )
    return declared.select(i["origin"].alias("origin"), problem.alias("problem")).filter(F.col("problem").isNotNull())


def assign_split(df: DataFrame, sequence_number: str) -> DataFrame:
    """Official split of each sequence; other sequences are left out."""
    number = F.col(sequence_number)
    split = F.when(number.isin(*TRAIN_SEQUENCES), "train").when(number.isin(*TEST_SEQUENCES), "test")
    return df.withColumn("split", split).filter(F.col("split").isNotNull())


def _first_rule(rules: list[tuple[str, Column]]) -> Column:
    found = None
    for name, broken in rules:
        bad = F.coalesce(broken, F.lit(True))
        found = F.when(bad, name) if found is None else found.when(bad, name)
    return found


def parse_multimodal(lines: DataFrame) -> DataFrame:
    """JSON text lines (``value``) to records; ``rule`` names the first broken one."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = lines.filter(F.trim("value") != "").withColumn("r", F.from_json("value", MULTIMODAL_SCHEMA, options))
    notes = F.coalesce("r.annotations", F.filter("r.annotations", lambda _: F.lit(False)), F.array().cast(MULTIMODAL_SCHEMA["annotations"].dataType))
    known = F.array(*[F.lit(m) for m in MODALITIES])
    paths = F.coalesce("r.paths", F.create_map().cast("map<string,string>"))
    used = F.map_keys(F.map_filter(paths, lambda k, v: F.coalesce(v != "", F.lit(False))))
    rule = _first_rule([
        ("json", F.col("r").isNull() | F.col("r._corrupt").isNotNull()),
        ("video_id", F.trim(F.coalesce("r.video_id", F.lit(""))) == ""),
        ("duration", F.coalesce(F.col("r.duration_s") <= 0, F.lit(True))),
        ("modality", F.size(F.array_except(used, known)) > 0),
        ("interval", F.exists(notes, lambda a: F.coalesce((a["start_s"] < 0) | (a["end_s"] <= a["start_s"]), F.lit(True)))),
        ("label", F.exists(notes, lambda a: F.trim(F.coalesce(a["label"], F.lit(""))) == "")),
        ("beyond_end", F.exists(notes, lambda a: a["end_s"] > F.col("r.duration_s") + 1e-6)),
    ])
    extra = [c for c in lines.columns if c != "value"]
    return rows.select(*extra, "r.video_id", "r.duration_s", paths.alias("paths"), notes.alias("annotations"), F.coalesce("r.split", F.lit("unspecified")).alias("split"), rule.alias("rule"))


def read_multimodal(spark: SparkSession, path: str) -> DataFrame:
    """Splittable scan of many files; a broken line is known by file and content."""
    return parse_multimodal(spark.read.text(path).withColumn("path", F.input_file_name()))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1), value of every line of text files of any size.

    Files are read in splits.  The lines of each split are counted in a first pass, a running sum over
    the split offsets of a file says how many lines come before, and a line's place in its split follows
    from the order in which the split is read; both passes plan the same splits."""
    lines = spark.read.text(path).select(
        F.input_file_name().alias("path"), F.expr("input_file_block_start()").alias("_start"), F.monotonically_increasing_id().alias("_seq"), "value"
    )
    splits = lines.groupBy("path", "_start").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    earlier = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return lines.join(splits, ["path", "_start"]).select(
        "path", (F.col("_before") + F.col("_seq") - F.col("_first") + 1).alias("line_no"), "value"
    )


def ordered_lines(numbered: DataFrame) -> DataFrame:
    """Add ``line``: the number of a line over all files in the order of their paths."""
    files = numbered.groupBy("path").agg(F.max("line_no").alias("_lines"))
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.select("path", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    return numbered.join(files, "path").withColumn("line", F.col("_before") + F.col("line_no")).drop("_before")


def parse_questions(lines: DataFrame) -> DataFrame:
    """Benchmark questions with the first broken rule; ids must be unique."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = lines.filter(F.trim("value") != "").select(F.from_json("value", QUESTION_SCHEMA, options).alias("r")).select("r.*")
    filled = lambda n: F.coalesce(n, F.lit("")) != ""
    expects = F.coalesce(F.size("expected_evidence_ids") > 0, F.lit(False))
    for name in ("expected_zone", "expected_visit", "expected_object_class", "expected_artifact"):
        expects = expects | filled(name)
    missing = F.lit(False)
    for name in QUESTION_FIELDS:
        missing = missing | F.col(name).isNull()
    repeated = rows.groupBy("question_id").agg(F.count("*").alias("_n"))
    joined = rows.join(repeated, "question_id", "left")
    rule = _first_rule([
        ("json", F.col("_corrupt").isNotNull()), ("missing_field", missing), ("duplicate", F.col("_n") > 1),
        ("answerability", ~F.col("answerability").isin(*ANSWERABILITY)), ("no_evidence_rule", ~expects),
    ])
    return joined.withColumn("rule", rule).drop("_n", "_corrupt")


def read_zones(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Zone artifacts to ``zones`` and ``assignments`` relations."""
    rows = spark.read.schema(ZONE_SCHEMA).json(path)
    zones = rows.select(F.explode("zones").alias("z")).select("z.*").dropDuplicates(["slug"])
    assigned = rows.select(F.explode("assignments").alias("observation_id", "label"))
    return zones, assigned


ZONE_RULES = ("json", "parts", "no_zones", "slug", "prompts", "prompt", "frames")


def read_zone_documents(spark: SparkSession, path: str, prompts: bool = True) -> DataFrame:
    """Zone artifacts, one JSON document per file however it is laid out: path, zones, assignments,
    counts, rule.

    ``rule`` is the first of ``ZONE_RULES`` that the artifact breaks, null if none: it is not JSON; zones
    (a list), assignments or assignment_counts (objects) are missing; no zone has a text as its slug.
    With ``prompts``, as evaluation needs: every zone has a slug, has prompts, has a non-blank text of
    each style, and is assigned to a frame.  Zones without a slug are left out of ``zones``; a file of no
    bytes has no row."""
    # The parser stops at the end of the first value; as the one element of a list nothing may follow it.
    listed = F.try_parse_json(F.concat(F.lit("["), F.col("content").cast("string"), F.lit("]")))
    at = lambda value, where, kind: F.try_variant_get(value, where, kind)

    def text(value: Column, where: str) -> Column:
        is_text = F.schema_of_variant(at(value, where, "variant")) == "STRING"
        return F.when(is_text, at(value, where, "string"))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", listed.alias("_l"))
    only = F.when(at(F.col("_l"), "$[1]", "variant").isNull(), at(F.col("_l"), "$[0]", "variant"))
    parsed = files.select("path", only.alias("_v")).select(
        "path", "_v", at(F.col("_v"), "$.zones", "array<variant>").alias("_zones"),
        at(F.col("_v"), "$.assignments", "map<string,string>").alias("assignments"),
        at(F.col("_v"), "$.assignment_counts", "map<string,bigint>").alias("counts"),
    )
    zone = lambda z: F.struct(
        text(z, "$.slug").alias("slug"), text(z, "$.name").alias("name"), text(z, "$.description").alias("description"),
        at(z, "$.stable_landmarks", "array<string>").alias("stable_landmarks"),
        at(z, "$.prompts", "map<string,variant>").isNotNull().alias("has_prompts"),
        F.create_map(*[x for s in PROMPT_STYLES for x in (F.lit(s), text(z, f"$.prompts.{s}"))]).alias("prompts"),
    )
    rows = parsed.withColumn("_all", F.transform("_zones", zone)).withColumn("zones", F.filter("_all", lambda z: z["slug"].isNotNull()))
    blank = lambda z: F.exists(F.map_values(z["prompts"]), lambda p: F.trim(F.coalesce(p, F.lit(""))) == "")
    labels = F.map_values("assignments")
    strict = [
        ("slug", F.size("zones") < F.size("_all")), ("prompts", F.exists("zones", lambda z: ~z["has_prompts"])), ("prompt", F.exists("zones", blank)),
        ("frames", F.exists("zones", lambda z: ~F.array_contains(labels, z["slug"]))),
    ]
    rule = _first_rule([
        ("json", F.col("_v").isNull()),
        ("parts", F.col("_zones").isNull() | F.col("assignments").isNull() | F.col("counts").isNull()),
        ("no_zones", F.size("zones") == 0), *(strict if prompts else []),
    ])
    return rows.select("path", "zones", "assignments", "counts", rule.alias("rule"))


def require_zone_documents(documents: DataFrame) -> DataFrame:
    """The same artifacts; the first broken one, by path, is an error."""
    broken = documents.where(F.col("rule").isNotNull()).orderBy("path").select("path", "rule").first()
    if broken:
        raise ValueError(f"zone artifact {broken['path']} breaks rule {broken['rule']}")
    return documents


def zone_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """zones (slug, name, description, stable_landmarks, prompts), assignments (observation_id, label) and
    counts (slug, assigned) of artifacts that break no rule."""
    good = documents.where(F.col("rule").isNull())
    zones = good.select(F.explode("zones").alias("z")).select("z.*").drop("has_prompts").dropDuplicates(["slug"])
    assigned = good.select(F.explode("assignments").alias("observation_id", "label"))
    return zones, assigned, good.select(F.explode("counts").alias("slug", "assigned"))


def zone_prompts(zones: DataFrame) -> DataFrame:
    """One row per zone and prompt style; a missing prompt has a null text."""
    pairs = ", ".join(f"'{s}', element_at(prompts, '{s}')" for s in PROMPT_STYLES)
    return zones.selectExpr("slug", f"stack({len(PROMPT_STYLES)}, {pairs}) as (style, prompt)").withColumn(
        "prompt", F.when(F.trim("prompt") != "", F.col("prompt"))
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """name, value (as JSON) of a metrics document; no row if it is not an object with members."""
    files = spark.read.format("binaryFile").load(path)
    document = F.try_parse_json(F.concat(F.lit("["), F.col("content").cast("string"), F.lit("]")))
    members = F.when(F.try_variant_get(document, "$[1]", "variant").isNull(), F.try_variant_get(document, "$[0]", "map<string,variant>"))
    return files.select(F.explode(members).alias("name", "_v")).select("name", F.to_json("_v").alias("value"))


def evaluation_problems(metrics: DataFrame, rows: DataFrame) -> DataFrame:
    """rule, query_id: why a stored evaluation is refused; no row if it is not.  ``metrics`` or ``rows``
    is empty, a row has no ``query_id``, or an id occurs ``twice`` or more."""
    nothing = F.lit(None).cast("string")
    count = lambda df: df.agg(F.count("*").alias("n")).where("n = 0")
    ids = rows.groupBy(F.col("query_id").cast("string").alias("query_id")).agg(F.count("*").alias("n"))
    return (
        count(metrics).select(F.lit("metrics").alias("rule"), nothing.alias("query_id"))
        .unionByName(count(rows).select(F.lit("rows").alias("rule"), nothing.alias("query_id")))
        .unionByName(ids.where("query_id is null").select(F.lit("query_id").alias("rule"), "query_id"))
        .unionByName(ids.where("query_id is not null and n > 1").select(F.lit("twice").alias("rule"), "query_id"))
    )


def read_evaluation(spark: SparkSession, root: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Metrics and rows of the evaluation stored below ``root`` (metrics.json, per_query.jsonl), or an
    error that names its first problem."""
    metrics = read_metrics(spark, f"{root}/metrics.json")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{root}/per_query.jsonl")
    problem = evaluation_problems(metrics, rows).orderBy("rule", "query_id").first()
    if problem:
        raise ValueError(f"evaluation {root} is refused: {problem['rule']} {problem['query_id'] or ''}".strip())
    return metrics, rows


def topic_inventory(messages: DataFrame) -> DataFrame:
    """Messages per topic, and the span and total of each recording on the same row."""
    topics = messages.groupBy("observation", "topic").agg(
        F.count("*").alias("message_count"), F.min("ts_ns").alias("_first"), F.max("ts_ns").alias("_last")
    )
    spans = topics.groupBy("observation").agg(
        F.min("_first").alias("start_ns"), F.max("_last").alias("end_ns"), F.sum("message_count").alias("total_messages")
    )
    return topics.drop("_first", "_last").join(spans, "observation").withColumn("duration_ns", F.col("end_ns") - F.col("start_ns"))


def mesh_bounds(vertices: DataFrame, key: str) -> DataFrame:
    """Vertex count and bounds per mesh; every required property must be a column."""
    missing = [p for p in MESH_PROPERTIES if p not in vertices.columns]
    if missing:
        raise ValueError(f"mesh is missing properties: {', '.join(missing)}")
    return vertices.groupBy(key).agg(
        F.count("*").alias("vertex_count"), *[f(a).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    )


def association_rows(pairs: DataFrame) -> DataFrame:
    """Each pair once per side, keyed by the frame id of its detection."""
    sides = F.explode(F.array("earlier_detection_id", "later_detection_id"))
    rows = pairs.withColumn("_detection", sides).filter(F.coalesce("_detection", F.lit("")) != "")
    return rows.withColumn("frame_id", F.regexp_replace("_detection", ":[^:]*$", "")).drop("_detection")
