"""Progress of uploads as a plain aggregate: late and foreign events change nothing, ended uploads leave the state."""

from datetime import datetime

from evidex.plans import streams
from evidex.session import scratch_path
from evidex.streaming import jobs, uploads

EVENT = "upload_id string, created_at timestamp, ts timestamp, done boolean, total int"
SF_DIR = "/root/testdata/sf0.001"


def at(day, hour):
    return datetime(2024, 1, day, hour)


def test_progress_of_three_triggers(spark):
    feeds = [
        [("a", at(1, 0), at(1, 1), True, 5), ("a", at(1, 0), at(1, 3), False, 7), ("b", at(1, 6), at(1, 7), True, 4), (None, at(1, 0), at(1, 1), True, 1), ("n", None, at(1, 1), True, 1)],
        [("c", at(3, 0), at(3, 1), True, -3)],
        # late by the watermark; past the end of its upload; a new one without numbers; past the end of its own life
        [("a", at(1, 0), at(1, 5), True, 9), ("b", at(1, 6), at(3, 3), True, 9), ("d", at(3, 0), at(3, 2), None, None), ("c", at(3, 0), at(4, 1), True, 9)],
    ]
    source, target, held = scratch_path(spark, "source"), scratch_path(spark, "progress"), []
    with uploads.keyed_state(spark):
        for feed in feeds:
            spark.createDataFrame(feed, EVENT).write.mode("append").parquet(source)
            jobs.run_available(uploads.job_progress(spark.readStream.schema(EVENT).parquet(source)), "update", target)
            state = spark.read.format("statestore").load(f"{target}/checkpoint")
            held.append({r.upload_id for r in state.select("key.upload_id").collect()})
    assert held == [{"a", "b"}, {"c"}, {"c", "d"}]
    last = jobs.last_update(jobs.stored_rows(spark, target), ["upload_id"]).collect()
    assert {r.upload_id: (r.windows_done, r.windows_total, round(r.progress, 6)) for r in last} == {
        "a": (1, 7, round(0.15 + 0.8 / 7, 6)), "b": (1, 4, 0.35), "c": (1, 0, 0.95), "d": (0, 0, 0.15)
    }


def test_progress_needs_no_python_per_upload(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(uploads, "tracked_jobs", lambda *a, **k: calls.append(a) or (_ for _ in ()).throw(AssertionError("a call per upload")))
    assert streams.s02(spark, SF_DIR).count() > 0 and not calls
