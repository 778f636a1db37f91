"""Ordinary frames are sorted and folded once; larger ones beside them give the same boxes."""

import random

from pyspark.sql import functions as F

from evidex.operators import objects as ob

BOXES = "frame_id string, src int, canonical_class string, score double, box array<double>"


def boxes(spark):
    rng, rows = random.Random(5), []
    for f in range(8):
        for i in range(90 if f < 2 else 10):
            x, y = float(rng.randrange(40)), float(rng.randrange(20))
            rows.append((f"f{f}", i, rng.choice(["chair", "box"]), rng.randrange(20) / 20, [x, y, x + 12.0, y + 12.0]))
    return spark.createDataFrame(rows, BOXES)


def test_large_and_ordinary_frames_side_by_side(spark):
    order = [F.col("score").desc(), F.col("src")]
    found = [
        sorted((r.frame_id, r["rank"], r.src) for r in ob.class_nms(boxes(spark), "frame_id", order, fold_rows=n).collect())
        for n in (512, 30, 4)
    ]
    assert found[0] == found[1] == found[2]
    assert len({f for f, _, _ in found[0]}) == 8 and max(r for _, r, _ in found[0]) <= 20


def test_an_ordinary_frame_is_shuffled_and_sorted_once(spark):
    folded = ob._fold_frames(boxes(spark), "frame_id", [F.col("score").desc(), F.col("src")], 0.5, 512)
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "WindowGroupLimit" not in plan
