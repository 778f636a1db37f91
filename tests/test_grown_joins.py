"""Rows made of few are joined by a shuffle of both sides, never sent whole through the driver."""

import pytest
from pyspark.sql import functions as F

from evidex.operators import targets, timeline, windows as win
from evidex.operators.joins import interval_join

@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """From files, whose small size Spark knows."""
    folder = str(tmp_path_factory.mktemp("grown"))
    spark.createDataFrame(
        [("a", 1, 40.0, "train", ["x"]), ("b", 2, 9.0, "test", ["y"])], "video_id string, video_no long, length_s double, split string, objects array<string>"
    ).write.parquet(f"{folder}/recordings")
    spark.createDataFrame(
        [("a", 1, "click", "Click", 1.0, 5.0), ("b", 2, "view", "View", 0.5, 90.0)],
        "video_id string, pos long, action_id string, name string, start_s double, end_s double",
    ).write.parquet(f"{folder}/actions")
    return win.sliding_windows(spark.read.parquet(f"{folder}/recordings")), spark.read.parquet(f"{folder}/actions")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["positions", "overlap", "attached", "targets", "intervals", "evidence"])
def test_no_grown_side_is_broadcast(spark, made, name):
    windows, actions = made
    met = win.window_action_overlap(windows, actions)
    if name == "positions":
        df = timeline.window_positions(windows)
    elif name == "overlap":
        df = met
    elif name == "attached":
        df = win.attach_actions(windows, actions)
    elif name == "targets":
        df = targets.boundary_targets(windows, met)
    else:
        asked = spark.createDataFrame([("q", "a", ["none"], 3.0, 9.0)], "query_id string, video_id string, window_ids array<string>, from_s double, to_s double")
        spans = windows.select("video_id", "window_id", "objects", F.col("start_s").alias("w_start"), F.col("end_s").alias("w_end"))
        df = interval_join(asked, spans, "video_id", ("from_s", "to_s"), ("w_start", "w_end"), 8.0)
        if name == "evidence":
            df = timeline.evidence_select(asked, windows, met)
            assert [r.window_ids for r in df.select("*").collect()] == [["a:0.00-4.00", "a:2.00-6.00", "a:4.00-8.00", "a:6.00-10.00", "a:8.00-12.00"]]
    assert "BroadcastHashJoin" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)
