"""Streaming state over several triggers: expiry, late rows, open sessions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidex.session import scratch_path
from evidex.streaming import jobs, uploads

EVENT = "upload_id string, created_at timestamp, ts timestamp, status string, done boolean, total int"


def at(day, hour, minute=0):
    return datetime(2024, 1, day, hour, minute)


@pytest.fixture(scope="module")
def tracked(spark):
    """Three triggers: two uploads, a third two days later, then what comes too late."""
    feeds = [
        [("a", at(1, 0), at(1, 1), "x", True, 5), ("a", at(1, 0), at(1, 3), "y", False, 7), ("b", at(1, 6), at(1, 7), "x", True, 4),
         (None, at(1, 0), at(1, 1), "x", True, 1), ("n", None, at(1, 1), "x", True, 1)],
        [("c", at(3, 0), at(3, 1), "x", True, 1)],
        # late by the watermark; in time, but of an ended upload; a new one; past the end of its own life
        [("a", at(1, 0), at(1, 5), "late", True, 9), ("b", at(1, 6), at(3, 3), "late", True, 9), ("d", at(3, 0), at(3, 2), None, False, None),
         ("c", at(3, 0), at(4, 1), "late", True, 9)],
    ]
    source, target = scratch_path(spark, "source"), scratch_path(spark, "jobs")
    held = []
    with uploads.keyed_state(spark):
        for feed in feeds:
            spark.createDataFrame(feed, EVENT).write.mode("append").parquet(source)
            jobs.run_available(uploads.tracked_jobs(spark.readStream.schema(EVENT).parquet(source)), "update", target)
            held.append({r.upload_id for r in uploads.live_state(spark, target).collect()})
    return held, jobs.stored_rows(spark, target).collect()


def test_state_of_ended_uploads_is_dropped(tracked):
    held, _ = tracked
    # The event past c's life moved the watermark to 00:00 of the fourth day, where c and d end.
    assert held == [{"a", "b"}, {"c"}, set()]


def test_late_events_change_nothing(tracked):
    _, rows = tracked
    last = {}
    for r in sorted(rows, key=lambda r: r.batch):
        last[r.upload_id] = (r.status, r.event_count, r.windows_done, r.windows_total, round(r.progress, 6), r.updated_at, r.expired)
    assert last == {
        "a": ("y", 2, 1, 7, round(0.15 + 0.8 / 7, 6), at(1, 3), True),
        "b": ("x", 1, 1, 4, 0.35, at(1, 7), True),
        "c": ("x", 1, 1, 1, 0.95, at(3, 1), True),
        "d": (None, 1, 0, 0, 0.15, at(3, 2), True),
    }
    assert sum(r.expired for r in rows) == 4  # each ends once


def test_fold_does_not_depend_on_the_order():
    import pandas as pd

    rows = pd.DataFrame({"ts_us": [5, 9, 9, 1], "status": ["p", "q", "r", None], "done": [1, 0, 1, 1], "total": [3, 8, 2, 0]})
    want = (0, 9, "r", 4, 3, 8)
    for order in ([0, 1, 2, 3], [3, 2, 1, 0]):
        job = (0, -1, None, 0, 0, 0)
        for i in order:
            job = uploads.UploadTracker.fold(job, rows.iloc[[i]])
        assert job == want == uploads.UploadTracker.fold((0, -1, None, 0, 0, 0), rows.iloc[order])


def test_every_event_is_in_one_session(spark):
    start = at(1, 0)
    events = [("k" if i % 3 else "l", start + timedelta(minutes=97 * i * (1 + i % 4))) for i in range(60)]
    frame = spark.createDataFrame(events, "key string, ts timestamp")
    cut = start + timedelta(hours=120)
    slices = [frame.where(F.col("ts") < cut), frame.where(F.col("ts") >= cut)]
    target = jobs.replay(spark, slices, lambda s: jobs.gap_sessions(s, ["key"], "3 hours", "0 seconds"), "append", "sessions")
    found = jobs.every_session(spark, target, ["key"]).collect()
    assert sum(r.events for r in found) == 60 and {r.is_open for r in found} == {True, False}
    want = []
    for key in "kl":
        times = sorted(t for k, t in events if k == key)
        run = [times[0]]
        for t in [*times[1:], None]:
            if t is None or t >= run[-1] + timedelta(hours=3):
                want.append((key, run[0], run[-1] + timedelta(hours=3), len(run)))
                run = []
            run.append(t)
    assert sorted((r.key, r.session_start, r.session_end, r.events) for r in found) == sorted(want)
    newest = max(t for _, t in events)
    assert all(r.is_open == (r.session_end > newest) for r in found)


def test_upload_state_is_read_once_per_key_and_trigger():
    """Each call to the state store is a round trip, and most uploads have a row or two per trigger."""
    from pyspark.sql import Row

    class Store:
        def __init__(self):
            self.value, self.calls = None, []

        def __getattr__(self, name):
            def call(*values):
                self.calls.append(name)
                if name == "update":
                    self.value = values[0]
                return self.value is not None if name == "exists" else self.value

            return call

    class Clock:
        registerTimer = staticmethod(lambda end: None)
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    tracker = uploads.UploadTracker(86_400)
    tracker.handle, tracker.job = Clock, Store()
    event = lambda ts, status: Row(created_us=10, ts_us=ts, status=status, done=1, total=4)
    (made,) = tracker.handleInputRows(("a",), iter([event(20, "x"), event(30, None)]), Clock)
    assert (made.upload_id, made.status, made.event_count, made.windows_done, made.expired) == ("a", None, 2, 2, False)
    (made,) = tracker.handleInputRows(("a",), iter([event(30, "y")]), Clock)
    assert (made.status, made.event_count) == ("y", 3) and tracker.job.calls == ["get", "update"] * 2
