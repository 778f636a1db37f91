"""Upload jobs as keyed state with a time to live.

One state row per upload holds what its events have said so far.  A timer at ``created_at + ttl`` in
event time reports the job once more as expired and drops the row, so state is bounded by the uploads
of one ``ttl`` plus the watermark's delay, whatever arrives later.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evidex.streaming.jobs import START_PROGRESS, WINDOW_SHARE

TTL_S, DELAY = 86_400, "1 hour"
STATE = StructType([
    StructField("created_us", LongType()), StructField("updated_us", LongType()), StructField("status", StringType()),
    StructField("events", LongType()), StructField("done", LongType()), StructField("total", LongType()),
])
JOB_FIELDS = "status string, created_us long, updated_us long, event_count long, windows_done long, windows_total long, expired boolean"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class UploadTracker(StatefulProcessor):
    """Folds events into the job of their upload; the order within a trigger does not matter."""

    def __init__(self, ttl_s: int):
        self.ttl_us = ttl_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found, job, changed = list(rows), self.stored(), False
        if job is None:
            created = min(r.created_us for r in found)
            end_ms = (created + self.ttl_us) // 1000
            if end_ms <= timerValues.getCurrentWatermarkInMs():
                return  # its job ended before this event arrived
            self.handle.registerTimer(end_ms)
            job = (created, -1, None, 0, 0, 0)
        alive = [r for r in found if r.ts_us < job[0] + self.ttl_us]  # an ended job takes no updates
        if alive:
            job, changed = self.folded(job, [(r.ts_us, r.status, r.done, r.total) for r in alive]), True
        self.job.update(job)
        if changed:
            yield self.row(key, job, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job = self.stored()
        self.job.clear()
        if job is not None:
            yield self.row(key, job, True)

    def close(self) -> None:
        pass

    def stored(self) -> tuple | None:
        value = self.job.get()  # one call to the store; None if there is no job
        return None if value is None else tuple(value)

    @staticmethod
    def folded(job: tuple, events: list[tuple]) -> tuple:
        """``events``: (ts_us, status, done, total)."""
        created, updated, status, count, done, total = job
        latest = max(e[0] for e in events)
        said = [e[1] for e in events if e[0] == latest and e[1] is not None]
        if latest >= updated:
            said = max([*said, *([status] if latest == updated and status is not None else [])], default=None)
            updated, status = latest, said
        return created, updated, status, count + len(events), done + sum(e[2] for e in events), max(total, *(e[3] for e in events))

    @classmethod
    def fold(cls, job: tuple, rows: pd.DataFrame) -> tuple:
        """``folded`` of the rows of a frame."""
        plain = lambda v: None if pd.isna(v) else v
        return cls.folded(job, [(int(t), plain(s), int(d), int(n)) for t, s, d, n in zip(rows["ts_us"], rows["status"], rows["done"], rows["total"])])

    @staticmethod
    def row(key, job: tuple, expired: bool) -> Row:
        created, updated, status, events, done, total = job
        return Row(
            upload_id=key[0], status=status, created_us=created, updated_us=updated, event_count=events, windows_done=done, windows_total=total, expired=expired
        )


def tracked_jobs(events: DataFrame, ttl_s: int = TTL_S, delay: str = DELAY) -> DataFrame:
    """Current row per upload and trigger (update mode), and a last one when its time is up.

    ``events``: ``upload_id, created_at, ts`` and, if known, ``status, done, total``.  The job lives
    from the creation its first event names; events at or past its end, and events of a job that has
    ended, change nothing.  Rows without upload, creation or time are left out."""
    kind = events.schema["upload_id"].dataType
    given = lambda name, ddl: F.col(name).cast(ddl) if name in events.columns else F.lit(None).cast(ddl)
    rows = (
        events.where("upload_id is not null and created_at is not null and ts is not null")
        .withWatermark("ts", delay)
        .select(
            "upload_id", "ts", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), given("status", "string").alias("status"),
            F.coalesce(given("done", "long"), F.lit(0)).alias("done"), F.coalesce(given("total", "long"), F.lit(0)).alias("total"),
        )
    )
    schema = StructType([StructField("upload_id", kind), *StructType.fromDDL(JOB_FIELDS)])
    made = rows.groupBy("upload_id").transformWithState(UploadTracker(ttl_s), schema, "Update", "EventTime")
    share = F.col("windows_done") / F.greatest(F.col("windows_total"), F.lit(1))
    return made.select(
        "upload_id", "status", F.timestamp_micros("created_us").alias("created_at"), F.timestamp_micros("updated_us").alias("updated_at"),
        "event_count", "windows_done", "windows_total", (F.lit(START_PROGRESS) + F.lit(WINDOW_SHARE) * share).alias("progress"), "expired",
    )


def job_progress(events: DataFrame, ttl_s: int = TTL_S, delay_s: int = 3600) -> DataFrame:
    """windows_done, windows_total and progress per upload and trigger (update mode).

    ``events`` as for ``tracked_jobs``, those of one upload with one creation.  Sums and maxima need no timer
    of their own, so they are a plain aggregate that Spark keeps without Python: keyed by the job's end, whose
    watermark trails the latest creation by ``delay_s``.  What ends before it is dropped and takes no events."""
    given = lambda name: F.coalesce(F.col(name).cast("long"), F.lit(0)) if name in events.columns else F.lit(0).cast("long")
    ends = F.col("created_at").cast("timestamp") + F.make_dt_interval(secs=F.lit(ttl_s))
    rows = (
        events.where("upload_id is not null and created_at is not null and ts is not null")
        .select("upload_id", ends.alias("ends_at"), F.col("ts").cast("timestamp").alias("ts"), given("done").alias("done"), given("total").alias("total"))
        .where("ts < ends_at").withWatermark("ends_at", f"{ttl_s + delay_s} seconds")
    )
    made = rows.groupBy("upload_id", "ends_at").agg(F.sum("done").alias("windows_done"), F.greatest(F.max("total"), F.lit(0)).alias("windows_total"))
    share = F.col("windows_done") / F.greatest(F.col("windows_total"), F.lit(1))
    return made.select("upload_id", "windows_done", "windows_total", (F.lit(START_PROGRESS) + F.lit(WINDOW_SHARE) * share).alias("progress"))


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in the store that timers need."""
    before = spark.conf.get(PROVIDER_CONF, None)
    spark.conf.set(PROVIDER_CONF, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER_CONF) if before is None else spark.conf.set(PROVIDER_CONF, before)


def live_state(spark: SparkSession, target: str) -> DataFrame:
    """upload_id and job fields of what the state of a stopped query still holds."""
    state = spark.read.format("statestore").option("stateVarName", "job").load(f"{target}/checkpoint")
    return state.select(F.col("key.upload_id").alias("upload_id"), "value.*")
