"""Dyadic covers and the joins built on them, beside brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.operators import joins, places, timeline, windows


def covers(spark, spans):
    rows = spark.createDataFrame(spans, "low long, high long")
    return rows.select("low", "high", joins.dyadic_cover(F.col("low"), F.col("high")).alias("c")).collect()


def test_a_cover_is_exact_and_small(spark):
    rng = np.random.default_rng(3)
    spans = [(int(a), int(a + n)) for a, n in zip(rng.integers(-5000, 5000, 200), rng.integers(0, 3000, 200))]
    spans += [(0, 0), (-1, -1), (-8, 7), (0, (1 << 14) - 1), (5, 40_000), (1, 150_001)]
    for low, high, cover in covers(spark, spans):
        slots = sorted((n.node << n.level, (n.node + 1) << n.level) for n in cover)
        assert slots[0][0] == low and slots[-1][1] == high + 1
        assert all(a[1] == b[0] for a, b in zip(slots, slots[1:]))
        assert len(cover) <= 40
    assert covers(spark, [(5, 4)])[0].c is None


def test_a_path_meets_a_cover_once(spark):
    low, high = 37, 9_000
    cover = covers(spark, [(low, high)])[0].c
    bits = 0
    for n in cover:
        bits |= 1 << n.level
    nodes = {(n.level, n.node) for n in cover}
    points = spark.range(0, 10_000, 7).withColumn("p", joins.dyadic_path(F.col("id"), F.lit(bits)))
    for r in points.collect():
        assert sum((n.level, n.node) in nodes for n in r.p) == (low <= r.id <= high)


@pytest.mark.parametrize("width", [0.5, 16.0, 4096.0])
def test_interval_join(spark, width):
    rng = np.random.default_rng(int(width))

    def side(n, scale):
        start = np.round(rng.uniform(-50, 2000, n), 1)
        length = np.round(rng.exponential(scale, n), 1)
        length[:3] = (0, 2500, 100)
        length[3] = -5
        return [(("k", "l")[i % 2], i, float(s), float(s + x)) for i, (s, x) in enumerate(zip(start, length))]

    left, right = side(80, 30), side(120, 5)
    left += [("only left", 900, 0.0, 9.0), (None, 901, 0.0, 9.0), ("k", 902, None, 9.0)]
    made = joins.interval_join(
        spark.createDataFrame(left, "key string, a long, a0 double, a1 double"),
        spark.createDataFrame(right, "key string, b long, b0 double, b1 double"), "key", ("a0", "a1"), ("b0", "b1"), width,
    )
    want = sorted(
        (k, a, b) for k, a, a0, a1 in left if k and a0 is not None for m, b, b0, b1 in right if k == m and a1 > b0 and a0 < b1
    )
    assert sorted((r.key, r.a, r.b) for r in made.collect()) == want


def test_long_actions(spark):
    """One action runs through a recording of 100,000 windows, others are short."""
    recordings = spark.createDataFrame([("long", 200_000.0), ("short", 31.0)], "video_id string, length_s double")
    made = windows.sliding_windows(recordings)
    actions = [("long", 0, "c0", "all", 0.0, 200_000.0), ("long", 1, "c1", "part", 1_001.0, 90_003.5), ("long", 2, "c2", "blink", 77.0, 77.5),
               ("short", 0, "c1", "part", 3.0, 9.0), ("short", 1, "c2", "none", 40.0, 50.0)]
    frame = spark.createDataFrame(actions, "video_id string, pos long, action_id string, name string, start_s double, end_s double")
    nodes = windows.action_nodes(frame).groupBy("video_id", "pos").count().collect()
    assert max(r["count"] for r in nodes) <= 40
    found = windows.window_action_overlap(made, frame).groupBy("video_id", "pos").agg(F.count("*").alias("n"), F.count_distinct("window_no").alias("d")).collect()
    starts = {"long": [2.0 * i for i in range(99_999)], "short": [2.0 * i for i in range(15)]}
    length = {"long": 200_000.0, "short": 31.0}
    want = {(v, p): n for v, p, _, _, a, b in actions if (n := sum(b > s and a < min(s + 4, length[v]) for s in starts[v]))}
    assert {(r.video_id, r.pos): r.n for r in found} == want and all(r.n == r.d for r in found)
    packed = windows.attach_actions(made, frame).select(F.sum(F.size("actions"))).first()[0]
    assert packed == sum(want.values())


def test_overlap_groups_of_a_long_action(spark):
    rows = [("v", 0, "c0", "all day", 0.0, 100_000.0), ("v", 1, "c1", "a", 50.0, 60.0), ("v", 2, "c2", "b", 55.0, 56.0), ("v", 3, "c3", "c", 99_000.0, 99_001.0),
            ("w", 0, "c1", "a", 0.0, 1.0), ("w", 1, "c2", "b", 1.0, 2.0)]
    actions = spark.createDataFrame(rows, "video_id string, pos long, action_id string, name string, start_s double, end_s double")
    found = {(r.video_id, tuple(r.names)) for r in timeline.overlap_groups(actions).collect()}
    assert found == {("v", ("a", "all day", "b", "c")), ("v", ("a", "all day", "b")), ("v", ("all day", "c"))}


# --- crowded cells


@pytest.fixture(scope="module")
def still_camera(spark):
    """Poses of which nearly a third come from one spot."""
    rng = np.random.default_rng(11)
    points = np.vstack([rng.uniform(-4, 4, (420, 3)), [1.1, 1.1, 1.1] + rng.uniform(0, 0.05, (180, 3))])
    angle = rng.uniform(-3, 3, 600)
    rows = [
        (f"o{i}", [float(x) for x in p], [float(x) for x in (np.cos(a), -np.sin(a), 0, np.sin(a), np.cos(a), 0, 0, 0, 1)], i)
        for i, (p, a) in enumerate(zip(points, angle))
    ]
    return rows, spark.createDataFrame(rows, "observation_id string, translation array<double>, rotation array<double>, step long")


def gap(a, b):
    distance = float(np.linalg.norm(np.subtract(a[1], b[1])))
    cosine = (float(np.dot(a[2], b[2])) - 1) / 2
    return distance, float(np.degrees(np.arccos(np.clip(cosine, -1, 1))))


@pytest.mark.parametrize("copied, block_rows", [("left", 4096), ("left", 20), ("right", 20), ("right", 7)])
def test_pose_join_of_a_still_camera(spark, still_camera, copied, block_rows):
    rows, frame = still_camera
    queries, memory = [r for r in rows if r[3] % 5 == 0], [r for r in rows if r[3] % 5]
    made = places.pose_join(frame.where("step % 5 = 0"), frame.where("step % 5 <> 0"), 0.5, 30.0, copied=copied, block_rows=block_rows)
    want = {(q[0], m[0]) for q in queries for m in memory if (g := gap(q, m))[0] <= 0.5 and g[1] <= 30}
    found = [(r.q_id, r.m_id) for r in made.collect()]
    assert len(found) == len(want) and set(found) == want


def test_a_crowded_cell_fills_many_tasks(spark, still_camera):
    _, frame = still_camera
    side = lambda p, rows: rows.select(F.col("observation_id").alias(f"{p}_id"), F.col("translation").alias(f"{p}_point"), "step")
    spot = side("m", frame.where("step >= 420")).drop("step")
    other = side("q", frame.where("step >= 420")).drop("step")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put such small groups together
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for block_rows, tasks in ((4096, 1), (20, 6)):
            pairs = joins.grid_neighbours(other, spot, "q_point", "m_point", 0.5, block_rows=block_rows)
            sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert sum(sizes) == 180 * 180 and (len(sizes) == 1 if tasks == 1 else len(sizes) >= tasks and max(sizes) < sum(sizes) / 3)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("block_rows", [4096, 10])
def test_propagated_labels_of_a_still_camera(spark, still_camera, block_rows):
    rows, frame = still_camera
    reps = [(*r[:3], None if r[3] % 7 == 0 else "unassigned" if r[3] % 5 == 0 else f"zone-{r[3] % 3}", r[3] - 300) for r in rows if r[3] % 4 == 1]
    made = places.propagate_labels(
        frame, spark.createDataFrame(reps, "observation_id string, translation array<double>, rotation array<double>, label string, rep_order int"), block_rows=block_rows
    )
    want = {}
    for r in rows:
        near = [(round((d / 0.5) ** 2 + (a / 45) ** 2, 9), m[4], m[3]) for m in reps if m[3] not in (None, "unassigned") for d, a in [gap(r, m)] if d <= 0.5 and a <= 45]
        want[r[0]] = min(near)[2] if near else "unassigned"
    assert {r.observation_id: r.label for r in made.collect()} == want
