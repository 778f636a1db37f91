"""Small fixtures with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from evidex.functions import boxes as bx, intervals as iv, poses as ps, text as tx
from evidex.operators import (
    embeddings as emb, evaluation as ev, lexical as lx, objects as ob, places as pl, ranking as rk, search, targets as tg,
    timeline as tl, windows as win,
)
from evidex.sources import readers as rd, sinks as sk


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def floats(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_interval_measures(spark):
    row = one(
        spark,
        iv.interval_iou(F.lit(0.0), F.lit(4.0), F.lit(2.0), F.lit(6.0)), iv.boundary_error(F.lit(0.0), F.lit(4.0), F.lit(1.0), F.lit(5.0)),
        iv.normalized_boundary_error(F.lit(0.0), F.lit(4.0), F.lit(1.0), F.lit(5.0), F.lit(10.0)),
        iv.interval_iou(F.lit(0.0), F.lit(1.0), F.lit(5.0), F.lit(6.0)), iv.context_start(F.lit(1.0)), iv.context_end(F.lit(1.0), F.lit(9.0), F.lit(10.0)),
    )
    assert list(row) == [1 / 3, 1.0, 0.1, 0.0, 0.0, 10.0]


def test_window_times_and_text(spark):
    row = one(
        spark, iv.window_timestamps(F.lit(2.0), F.lit(6.0), 8).alias("t"),
        tx.window_text(F.array(F.lit(" Sitting on a chair ")), F.lit("x"), F.array(F.lit("y"))).alias("a"),
        tx.window_text(F.array().cast("array<string>"), F.lit("A person enters."), F.array(F.lit("y"))).alias("b"),
        tx.window_text(F.array().cast("array<string>"), F.lit(" "), F.array(F.lit("Door"), F.lit(""))).alias("c"),
        tx.window_text(F.array().cast("array<string>"), F.lit(None).cast("string"), F.array().cast("array<string>")).alias("d"),
    )
    assert row.t[0] == 2.25 and row.t[-1] == 5.75 and len(row.t) == 8
    assert row.a == "A person is sitting on a chair." and row.b == "A person enters."
    assert row.c == "A video showing door." and row.d == "A video showing an office activity."


def test_windows_count_and_actions(spark):
    recording = spark.createDataFrame([("rec-a", 5.0)], "video_id string, length_s double")
    made = win.sliding_windows(recording, 2.0, 1.0)
    actions = spark.createDataFrame(
        [("rec-a", 0, "c008", "Opening a door", 1.0, 2.0)], "video_id string, pos long, action_id string, name string, start_s double, end_s double"
    )
    rows = win.attach_actions(made, actions, 2.0, 1.0).orderBy("start_s").collect()
    assert [(r.start_s, r.end_s, len(r.actions)) for r in rows] == [(0.0, 2.0, 1), (1.0, 3.0, 1), (2.0, 4.0, 0), (3.0, 5.0, 0)]
    assert rows[0].window_id == "rec-a:0.00-2.00"
    tail = win.windows_keep_tail(recording).orderBy("start_s").collect()
    assert [(r.start_s, r.end_s) for r in tail] == [(0.0, 4.0), (2.0, 5.0), (4.0, 5.0)]


def test_parse_actions_falls_back_to_the_id(spark):
    df = spark.createDataFrame([(1, "c006 1.00 2.50;c009 3.00 4.00;junk"), (2, "")], "k int, t string")
    classes = spark.createDataFrame([("c006", "Closing a door")], "action_id string, name string")
    rows = {r.k: r.actions for r in win.parse_actions(df, "k", "t", classes).collect()}
    assert [(a.action_id, a.name, a.start_s, a.end_s) for a in rows[1]] == [("c006", "Closing a door", 1.0, 2.5), ("c009", "c009", 3.0, 4.0)]
    assert rows[2] == []


RANKED = "query_id string, rank int, window_id string, video_id string, start_s double, end_s double, score double"


def test_diversify_drops_overlapping_neighbours(spark):
    rows = spark.createDataFrame(
        [("q", 1, "a0", "a", 0.0, 4.0, 0.99), ("q", 2, "a1", "a", 2.0, 6.0, 0.98), ("q", 3, "b0", "b", 0.0, 4.0, 0.97)], RANKED
    )
    kept = rk.diversify_by_interval(rows, 2).orderBy("rank").collect()
    assert [(r.rank, r.window_id) for r in kept] == [(1, "a0"), (2, "b0")]


def test_events_merge_and_keep_their_evidence(spark):
    door, seat = ("a1", "Opening a door", 0.0, 3.0), ("a2", "Sitting down", 10.0, 14.0)
    schema = RANKED + ", predicted_start_s double, predicted_end_s double, actions array<struct<action_id:string,name:string,start_s:double,end_s:double>>, objects array<string>"
    rows = spark.createDataFrame(
        [
            ("q", 1, "v-0", "v", 0.0, 4.0, 0.99, None, None, [door], ["hallway"]),
            ("q", 2, "v-1", "v", 2.0, 6.0, 0.98, None, None, [door], ["door"]),
            ("q", 3, "v-2", "v", 10.0, 14.0, 0.90, None, None, [seat], ["chair"]),
        ],
        schema,
    )
    first, second = rk.merge_events(rows).orderBy("event_rank").collect()
    assert first.evidence_window_ids == ["v-0", "v-1"] and (first.start_s, first.end_s) == (0.0, 6.0)
    assert first.objects == ["door", "hallway"] and len(first.actions) == 1
    assert second.event_id == "v:10.000-14.000"


def test_moments_keep_at_most_32_times(spark):
    schema = RANKED + ", context_start_s double, context_end_s double, frame_timestamps_s array<double>"
    rows = [("q", i + 1, f"w{i}", "v", 2.0 * i, 2.0 * i + 4, 1.0 - i / 10, 0.0, 9.0, [float(i * 16 + j) for j in range(16)]) for i in range(3)]
    rows.append(("q", 4, "w9", "v", 50.0, 54.0, 0.1, 49.0, 55.0, [50.5]))
    near, far = rk.merge_moments(spark.createDataFrame(rows, schema)).orderBy("moment_rank").collect()
    assert near.evidence_window_ids == ["w0", "w1", "w2"] and near.window_id == "w0" and near.window_count == 3
    assert near.frame_timestamps_s == [float(int(i * 47 / 31)) for i in range(32)]
    assert far.frame_timestamps_s == [50.5]


def test_place_agreement(spark):
    zones = ["a"] * 7 + ["b"] * 3
    rows = [("strong", i + 1, z) for i, z in enumerate(zones)] + [("tie", i + 1, "ab"[i % 2]) for i in range(10)]
    rows += [("four", i + 1, z) for i, z in enumerate("aaaabbbcde")] + [("none", 1, None)]
    got = {r.query_id: (r.zone, r.support_count, r.strength) for r in rk.majority_zone(spark.createDataFrame(rows, "query_id string, rank int, zone string")).collect()}
    assert got == {"strong": ("a", 7, "strong"), "tie": ("a", 5, "mixed"), "four": ("a", 4, "moderate")}


def test_lexical_search(spark):
    windows = spark.createDataFrame(
        [
            ("rec-a:0-4", "rec-a", ["Opening a door"], ["door"], "A person opens a door."),
            ("rec-b:0-4", "rec-b", ["Sitting at a table"], ["table"], "A person sits."),
        ],
        "window_id string, video_id string, action_names array<string>, objects array<string>, description string",
    )
    asked = spark.createDataFrame(
        [("door", "When did the person open the door?"), ("sit", "When did the person sit down?"), ("caps", "WHEN DID IT")], "query_id string, question string"
    )
    got = {(r.query_id, r.video_id): r.score for r in lx.lexical_search(asked, windows, 2).collect()}
    # "hen" of "When" stays a term, so it dilutes every score
    assert got == {("door", "rec-a"): round((2 * 2 + 1 + 0.5) / 6, 4), ("sit", "rec-b"): round(2 / 6, 4)}


def test_search_contracts(spark):
    memory = spark.createDataFrame([(i, [1.0, 0.0] if i < 2 else [0.0, 1.0], "e0" if i % 2 else "e1") for i in range(4)], "ord long, vector array<double>, scope string")
    ask = lambda v, scope=None, own=None: spark.createDataFrame([("q", v, scope, own)], "query_id string, vector array<double>, q_scope string, q_ord long")
    found = search.cosine_topk(ask([2.0, 0.0]), memory, 2).orderBy("rank").collect()
    assert [(r.ord, r.score) for r in found] == [(0, 1.0), (1, 1.0)]
    found = search.cosine_topk(ask([1.0, 0.0], "e0", 1), memory, 9, exclude_self=True, scoped=True).collect()
    assert [r.ord for r in found] == [3]
    assert search.unknown_scopes(ask([1.0, 0.0], "e9"), memory).count() == 1
    with pytest.raises(Exception, match="non-zero"):
        search.cosine_topk(ask([0.0, 0.0]), memory, 1).collect()


def test_neighbour_steps(spark):
    rows = spark.createDataFrame([("e", 0, None), ("e", 1, "go"), ("e", 2, "turn"), ("e", 5, "stop")], "ep string, step long, action string")
    got = {r.step: [(n.step, n.action) for n in r.nearby] for r in emb.neighbour_context(rows, "ep", "step", "action").collect()}
    assert got == {0: [(0, None), (1, "go")], 1: [(0, None), (1, "go"), (2, "turn")], 2: [(1, "go"), (2, "turn")], 5: [(5, "stop")]}
    twice = spark.createDataFrame([("e", 0, "old", 1), ("e", 0, "new", 2), ("e", 1, "go", 3)], "ep string, step long, action string, n long")
    got = {r.step: [n.action for n in r.nearby] for r in emb.neighbour_context(twice, "ep", "step", "action", "n").collect()}
    assert got == {0: ["new", "go"], 1: ["new", "go"]}


def test_identical_vectors_are_a_violation(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "id long, v array<double>")
    assert [(r.id, r.rule) for r in emb.validate_embeddings(same, "id", "v", 2).collect()] == [(None, "identical")]


def test_rotation_and_boxes(spark):
    turn = floats(0, -1, 0, 1, 0, 0, 0, 0, 1)
    row = one(
        spark, ps.rotation_error_deg(floats(1, 0, 0, 0, 1, 0, 0, 0, 1), turn), bx.box_iou(floats(0, 0, 4, 4), floats(2, 0, 6, 4)),
        bx.canonical_class(F.lit("Trash_Bin")), bx.clamp_box(floats(-1, 1, 9, 9), F.lit(16), F.lit(10)), bx.clamp_box(floats(17, 1, 19, 9), F.lit(16), F.lit(10)),
    )
    assert abs(row[0] - 90.0) < 1e-9 and list(row)[1:] == [1 / 3, "waste_bin", [0.0, 1.0, 9.0, 9.0], None]


def test_nms_maps_clamps_and_rejects(spark):
    raw = spark.createDataFrame(
        [("f", 0, "office chair", 0.9, [-1.0, 1.0, 9.0, 9.0]), ("f", 1, "desk chair", 0.7, [0.0, 1.0, 9.0, 9.0]), ("f", 2, "trash bin", 0.8, [10.0, 2.0, 15.0, 8.0]), ("f", 3, "plant", 0.99, [1.0, 1.0, 3.0, 3.0])],
        "frame_id string, src int, phrase string, score double, box array<double>",
    )
    kept = ob.class_nms(ob.candidates(raw, 16, 10), "frame_id", [F.col("score").desc(), F.col("src")])
    rows = ob.detection_ids(kept, 16, 10).orderBy("rank").collect()
    assert [(r.canonical_class, r.detection_id) for r in rows] == [("chair", "f:det-01"), ("waste_bin", "f:det-02")]
    assert ob.rejected_counts(raw, kept, "frame_id").first().rejected_count == 2


def test_keyframes_by_window(spark):
    rows = spark.createDataFrame([("o", i, [float(i), 0.0, 0.0], [0.0, 0.0, 0.0, 1.0]) for i in range(12)] + [("p", i, [0.0] * 3, [0.0, 0.0, 0.0, 1.0]) for i in range(3)], "g string, i long, translation_m array<double>, quaternion_xyzw array<double>")
    got = {g: sorted(r.i for r in part) for g, part in _group(pl.keyframes_by_window(rows, "g", "i", 4).collect(), "g").items()}
    assert got == {"o": [1, 5, 8, 11], "p": [0, 1, 2]}


def _group(rows, name):
    out = {}
    for row in rows:
        out.setdefault(row[name], []).append(row)
    return out


POSED = "observation_id string, ord long, step long, sequence_id string, vector array<double>, translation array<double>, rotation array<double>"
EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def test_traversal_rates_keep_their_denominators(spark):
    row = lambda name, n, seq, x, v: (name, n, 0, seq, v, [x, 0.0, 0.0], EYE)
    memory = spark.createDataFrame([row("a-near", 0, "ta", 0.1, [1.0, 0.0]), row("a-far", 1, "ta", 2.0, [0.0, 1.0]), row("b-near", 2, "tb", 0.2, [0.0, 1.0]), row("b-far", 3, "tb", 3.0, [1.0, 0.0])], POSED)
    queries = spark.createDataFrame([row("near", 10, "sa", 0.0, [1.0, 0.0]), row("uncovered", 11, "sb", 10.0, [0.0, 1.0])], POSED)
    found = ev.pose_retrievals(queries, memory, True)
    rows = ev.pose_rows(queries, found, ev.random_retrievals(queries, memory, 7, found), True)
    strict = ev.rate_metrics(rows).filter("level = 'strict' and source = 'model' and k = 1").first()
    assert (strict.rows, strict.eligible, strict.coverage, strict.covered_rate, strict.all_rate) == (4, 2, 0.5, 0.5, 0.25)
    got = {(r.query_id, r.target_sequence_id): r for r in rows.collect()}
    assert got["near", "ta"].strict_hit_at_1 and not got["near", "tb"].strict_hit_at_1 and got["near", "tb"].strict_hit_at_5
    top = found.filter("query_id = 'near' and target_sequence_id = 'tb' and rank = 1").first()
    assert top.observation_id == "b-far"


def test_random_baseline_is_reproducible(spark):
    rows = spark.createDataFrame([(f"o{i}", i, 0, "s", [1.0, float(i)], [0.0] * 3, EYE) for i in range(40)], POSED)
    draw = lambda seed: sorted((r.query_id, r.rank, r.observation_id) for r in ev.random_retrievals(rows, rows, seed).collect())
    assert draw(1) == draw(1) != draw(2)
    assert len({(q, o) for q, _, o in draw(1)}) == 400


def test_random_draws_are_without_replacement_and_even(spark):
    from evidex.operators.sampling import distinct_ordinals

    keys = spark.range(4000).select(F.col("id"), F.lit(23).cast("long").alias("n"))
    drawn = [[x.ordinal for x in r.d] for r in keys.select(distinct_ordinals(F.col("id"), F.col("n"), 10, 5).alias("d")).collect()]
    assert all(len(set(d)) == 10 and min(d) >= 0 and max(d) < 23 for d in drawn)
    for seen, share in (([d[0] for d in drawn], 1 / 23), ([x for d in drawn for x in d], 10 / 23)):
        counts = [seen.count(i) for i in range(23)]
        expected = 4000 * share
        assert sum((c - expected) ** 2 / expected for c in counts) < 60  # chi-square of 22 degrees, p below 1e-4
    sizes = spark.createDataFrame([(1, 0), (2, 1), (3, 10), (4, 11), (5, 3 * 10**10)], "id long, n long")
    few = {r.n: r.d for r in sizes.select("n", distinct_ordinals(F.col("id"), F.col("n"), 10, 5).alias("d")).collect()}
    assert few[0] is None and [x.ordinal for x in few[1]] == [0] and sorted(x.ordinal for x in few[10]) == list(range(10))
    assert len({x.ordinal for x in few[11]}) == 10 and max(x.ordinal for x in few[3 * 10**10]) > 2**31


def test_failure_tags_in_order(spark):
    names = ["strict_eligible", "strict_hit_at_1", "strict_hit_at_5", "strict_hit_at_10", "relaxed_hit_at_1", "top1_translation_error_m", "top1_rotation_error_deg"]
    row = spark.createDataFrame([(True, False, True, True, True, 0.8, 31.0)], names).select(ev.failure_tags().alias("t")).first()
    assert row.t == ["strict-rescued-at5", "relaxed-only-top1", "large-translation", "large-rotation"]


def test_action_resolution_branches(spark):
    vocabulary = spark.createDataFrame([("v", "Holding a bag"), ("v", "Opening a door"), ("v", "Opening a window")], "video_id string, label string")
    vectors = spark.createDataFrame([("Holding a bag", [1.0, 0.0]), ("Opening a door", [0.0, 1.0]), ("Opening a window", [0.6, 0.8])], "label string, label_vector array<double>")
    asked = spark.createDataFrame(
        [("bag", "holding the bag", "v", [0.0, 1.0]), ("cup", "holding a cup", "v", [1.0, 0.0]), ("open", "opening", "v", [0.0, 1.0]), ("near", "when", "v", [1.0, 0.0]), ("empty", "bag", "w", [1.0, 0.0])],
        "query_id string, question string, video_id string, q_vector array<double>",
    )
    got = {r.query_id: r.matched_actions for r in lx.resolve_actions(asked, vocabulary, vectors).collect()}
    assert got == {"bag": ["Holding a bag"], "cup": [], "open": ["Opening a door", "Opening a window"], "near": ["Holding a bag"], "empty": []}


def test_refinement_falls_back_on_an_empty_interval(spark):
    row = spark.createDataFrame(
        [(0.0, 4.0, [0.25, 0.75], [1.0, 3.0], [0.0, 0.0], [0.0, 1.0], [1.0, 0.0])],
        "start_s double, end_s double, boundary array<double>, timestamps_s array<double>, relevance array<double>, start_scores array<double>, end_scores array<double>",
    )
    got = tg.decode_refinement(tg.decode_boundaries(row)).first()
    assert (got.refined_start_s, got.refined_end_s) == (1.0, 3.0)


def test_timeline_merges_across_short_gaps(spark):
    rows = spark.createDataFrame(
        [("v", "w0", 0.0, 4.0, 0, "a", "Walk", 0.0, 2.0), ("v", "w1", 2.0, 6.0, 0, "a", "Walk", 0.0, 2.0), ("v", "w1", 2.0, 6.0, 1, "b", "Sit", 2.5, 3.0), ("v", "w9", 8.0, 12.0, 2, "a", "Walk", 9.0, 10.0)],
        "video_id string, window_id string, window_start_s double, window_end_s double, pos long, action_id string, name string, start_s double, end_s double",
    )
    assert [(r.label, r.start_s, r.end_s, r.event_count) for r in tl.timeline(rows).orderBy("start_s").collect()] == [("Walk · Sit", 0.0, 3.0, 2), ("Walk", 9.0, 10.0, 1)]
    last = {r.start_s: r.evidence_window_id for r in tl.timeline_events(rows).collect()}
    assert last[0.0] == "w1"


def test_multimodal_lines_report_the_first_bad_one(spark, tmp_path):
    good = {"video_id": "x", "duration_s": 12.0, "paths": {"rgb": "a", "audio": "b", "depth": "c", "pose": "d"}, "annotations": [{"start_s": 1.0, "end_s": 4.0, "label": "open", "objects": ["cabinet"]}], "split": "test"}
    lines = [json.dumps(good), "", json.dumps({"video_id": "x"}), json.dumps({**good, "paths": {"thermal": "x"}}), "{"]
    (tmp_path / "m.jsonl").write_text("\n".join(lines) + "\n")
    rows = rd.parse_multimodal(rd.numbered_lines(spark, str(tmp_path / "m.jsonl")))
    assert {r.line_no: r.rule for r in rows.collect()} == {1: None, 3: "duration", 4: "modality", 5: "json"}
    audit = {(r.metric, r.key): r.value for r in win.manifest_audit(rows.filter("rule is null")).collect()}
    assert audit["all_modalities_count", ""] == 1 and audit["modality_audio", ""] == 1 and audit["annotation_count", ""] == 1


def test_image_source_contract(spark, tmp_path):
    import struct
    import zlib

    def png(path, width, height):
        raw = b"".join(b"\0" + b"\x40\x80\xc0" * width for _ in range(height))
        chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
        head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    for name, size in (("a", (4, 3)), ("b", (5, 3))):
        png(tmp_path / f"{name}.png", *size)
    images = spark.read.format("image").load(str(tmp_path))
    manifest = spark.createDataFrame([(4, 3)], "width int, height int")
    bad = rd.image_problems(images, manifest).collect()
    assert [(r.origin.rsplit("/", 1)[1], r.problem) for r in bad] == [("b.png", "size")]
    assert rd.list_files(spark, str(tmp_path), "*.png").count() == 2


def test_sinks_refuse_what_exists(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<double>")
    for write in (lambda p: sk.write_records(rows, p), lambda p: sk.write_index(rows, p, "m", "1")):
        path = str(tmp_path / str(id(write)))
        write(path)
        with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
            write(path)
    config = str(tmp_path / "cache")
    sk.check_config(spark, config, {"a": 1}, False)
    sk.check_config(spark, config, {"a": 1}, True)
    with pytest.raises(ValueError):
        sk.check_config(spark, config, {"a": 2}, True)
    with pytest.raises(FileExistsError):
        sk.check_config(spark, config, {"a": 1}, False)
    with pytest.raises(ValueError):
        rd.read_jsonl(spark, _empty(tmp_path), rows.schema)


def _empty(tmp_path):
    (tmp_path / "empty.jsonl").write_text("")
    return str(tmp_path / "empty.jsonl")


def test_robust_extent_and_colour_link(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 240, 16, 16)], "detection_no long, frame_no long, px_order long, r int, g int, b int")
    points = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 239, 17, 18), (0, 9.0, 9.0, 9.0, 16, 240, 16)], "frame_no long, x double, y double, z double, r int, g int, b int")
    assert [(p.x, p.y, p.z) for p in ob.color_bin_link(pixels, points).collect()] == [(1.0, 2.0, 3.0)]
    cloud = spark.createDataFrame([(1, 0.0, 0.0, 0.0)] * 20 + [(1, 100.0, 100.0, 100.0)], "detection_no long, x double, y double, z double")
    known = spark.createDataFrame([(1,), (2,)], "detection_no long")
    got = {r.detection_no: r for r in ob.robust_extent(cloud, known, "detection_no").collect()}
    assert got[1].max_x < 100.0 and got[1].min_x == 0.0 and got[1].point_count == 21
    assert got[2].point_count == 0 and got[2].centre_x is None


def test_tracks_and_visibility(spark):
    rows = spark.createDataFrame([("f0", 0, "laptop", 0.8, [1.0, 2.0, 8.0, 9.0]), ("f1", 1, "laptop", 0.7, [1.0, 2.0, 8.0, 9.0]), ("f3", 3, "laptop", 0.7, [1.0, 2.0, 8.0, 9.0])], "frame_id string, frame_no long, label string, score double, box array<double>")
    got = {r.frame_id: r.track_id for r in ob.frame_tracks(rows, []).collect()}
    assert got == {"f0": "laptop-1", "f1": "laptop-1", "f3": "laptop-2"}
    frames = spark.createDataFrame([("f0",), ("f1",), ("f3",)], "frame_id string")
    prompts = spark.createDataFrame([("laptop",), ("old laptop",), ("cup",)], "prompt string")
    seen = {r.prompt: (r.frames_visible, r.max_score, r.status) for r in ob.visibility(prompts, rows, frames).collect()}
    assert seen == {"laptop": (3, 0.8, "supported"), "old laptop": (3, 0.8, "supported"), "cup": (0, 0.0, "not_visibly_confirmed")}


def test_a_manifest_is_one_object(spark, tmp_path):
    from pyspark.sql import types as T

    from evidex.sources import readers

    schema = T.StructType([T.StructField("n", T.LongType())])
    (tmp_path / "a.json").write_text('{"n": 1}')
    assert [r.n for r in readers.read_manifest(spark, str(tmp_path), schema).collect()] == [1]
    (tmp_path / "b.json").write_text('{"n": 2}')
    with pytest.raises(ValueError):
        readers.read_manifest(spark, str(tmp_path), schema)


def test_a_retried_window_is_no_failure(spark):
    from evidex.sources import sinks

    cache = spark.createDataFrame(
        [("w1", "v", None, True), ("w1", "v", [[1.0], [2.0]], False), ("w2", "u", None, True)], sinks.CACHE_SCHEMA
    )
    row = sinks.cache_summary(cache).first()
    assert (row.window_count, row.video_count, row.failed_videos, row.frames_per_window) == (1, 2, 1, 2)


def test_repeats_of_an_action_do_not_overlap(spark):
    from evidex.operators import timeline

    rows = spark.createDataFrame([("v", 1, "c", "Walk", 0.0, 2.0), ("v", 2, "c", "Walk", 0.0, 2.0)], "video_id string, pos long, action_id string, name string, start_s double, end_s double")
    assert timeline.overlap_groups(rows).count() == 0


def test_labels_are_normalised(spark):
    from evidex.operators import objects

    found = spark.createDataFrame([("f1", " Office_Chair.", 0.5, 1), ("f1", "office chair", 0.9, 2)], "frame_id string, label string, score double, place int")
    best = objects.best_per_label(found, ["frame_id", "label"], [F.col("place")]).collect()
    assert [(r.label, r.score) for r in best] == [("office chair", 0.9)]
    prompts = spark.createDataFrame([("CHAIR",), ("sofa",)], "prompt string")
    frames = spark.createDataFrame([("f1",)], "frame_id string")
    seen = {r.prompt: r.frames_visible for r in objects.visibility(prompts, found, frames).collect()}
    assert seen == {"chair": 1, "sofa": 0}


def test_lexical_search_within_a_split(spark):
    from evidex.operators import lexical

    windows = spark.createDataFrame([("w1", "v", ["open door"], "", [], "a"), ("w2", "u", ["open door"], "", [], "b")], "window_id string, video_id string, action_names array<string>, description string, objects array<string>, split string")
    asked = spark.createDataFrame([("q", "open the door", "b")], "query_id string, question string, split string")
    assert [r.window_id for r in lexical.lexical_search(asked, windows, within="split").collect()] == ["w2"]


def test_supports_follow_visit_class_and_rank(spark):
    from evidex.operators import records

    rows = spark.createDataFrame([(10, "chair", 1), (2, "box", 1), (2, "chair", 2), (2, "chair", 1)], "v int, c string, r int")
    order = rows.orderBy(records.support_order(F.col("v"), F.col("c"), F.col("r"))).collect()
    assert [tuple(r) for r in order] == [(2, "chair", 1), (2, "chair", 2), (2, "box", 1), (10, "chair", 1)]


def test_quantiles_of_mostly_equal_values(spark):
    import numpy as np

    from evidex.operators.quantiles import exact_quantiles

    values = [1.5] * 900 + [float(i) / 7 for i in range(100)]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 2.0), ("b", None), ("b", 4.0)], "k string, v double")
    probs = {"p05": 0.05, "median": 0.5, "p97": 0.97}
    got = {r.k: r for r in exact_quantiles(rows, ["k"], "v", probs, 0.5).collect()}
    for name, p in probs.items():
        assert got["a"][name] == pytest.approx(np.quantile(values, p))
        assert got["b"][name] == pytest.approx(np.quantile([2.0, 4.0], p))


def test_windows_close_behind_the_watermark(spark, tmp_path):
    from evidex.streaming import jobs

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "kind string, ts timestamp"

    def arrive(*rows):
        made = spark.createDataFrame(rows, "kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        made.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.run_available(jobs.sliding_counts(stream, ["kind"], "4 hours", "4 hours", "1 hour"), "update", target)
        rows = jobs.last_update(jobs.stored_rows(spark, target), ["window_start", "window_end", "kind"])
        return sorted((r.window_start.hour, r.events) for r in rows.collect())

    assert arrive(("a", "2024-01-01 01:00:00"), ("a", "2024-01-01 09:00:00")) == [(0, 1), (8, 1)]
    # The first window is final, its state is gone, and a row for it is dropped; the open one counts on.
    assert arrive(("a", "2024-01-01 02:00:00"), ("a", "2024-01-01 10:00:00")) == [(0, 1), (8, 2)]
