"""Upload jobs and arriving recordings as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidex.operators.windows import windows_keep_tail
from evidex.session import scratch_path

START_PROGRESS, WINDOW_SHARE = 0.15, 0.80
TTL = "24 hours"


def expired_sessions(sessions: DataFrame, ttl: str = TTL) -> DataFrame:
    """Sessions as they pass their time to live (append mode).

    With a watermark that trails by the time to live, a group keyed by the creation
    time is final exactly when the session is that old: Spark emits it, drops its
    state and ignores rows that arrive later still.
    """
    return sessions.withWatermark("created_at", ttl).groupBy("upload_id", "created_at").agg(F.count("*").alias("rows"))


def live_sessions(sessions: DataFrame, now, ttl: str = TTL) -> DataFrame:
    """The batch view: sessions younger than the time to live at ``now``."""
    return sessions.filter(F.col("created_at") >= now - F.expr(f"interval {ttl}"))


def arriving_windows(recordings: DataFrame) -> DataFrame:
    """Windows of recordings as they arrive; stateless."""
    return windows_keep_tail(recordings)


def sliding_counts(events: DataFrame, keys: list[str], length: str, step: str, delay: str) -> DataFrame:
    """Events per sliding window and key, with state bounded by the watermark."""
    return (
        events.withWatermark("ts", delay).groupBy(F.window("ts", length, step), *keys)
        .agg(F.count("*").alias("events"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "events")
    )


def gap_sessions(events: DataFrame, keys: list[str], gap: str, delay: str) -> DataFrame:
    """Runs of events with no pause longer than ``gap``."""
    return (
        events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), *keys)
        .agg(F.count("*").alias("events"))
        .select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "events")
    )


def open_sessions(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Sessions that a stopped query has seen but not closed, from its state store."""
    state = spark.read.format("statestore").load(f"{target}/checkpoint").select("value.*")
    window = F.col("session_window")
    return state.select(
        window["start"].alias("session_start"), window["end"].alias("session_end"), *keys, F.col("count").alias("events")
    )


def every_session(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Closed sessions of the sink and open ones of the state: each event is in one of them."""
    names = ["session_start", "session_end", *keys, "events"]
    closed = stored_rows(spark, target).select(*names, F.lit(False).alias("is_open"))
    return closed.unionByName(open_sessions(spark, target, keys).withColumn("is_open", F.lit(True)))


def replay(spark: SparkSession, slices: list[DataFrame], build, mode: str, name: str) -> str:
    """Feed ``slices`` one after the other to the query ``build(stream)``, which is stopped after each
    and goes on from its checkpoint; returns its folder."""
    source, target = scratch_path(spark, f"{name}-source"), scratch_path(spark, name)
    for rows in slices:
        rows.write.mode("append").parquet(source)
        run_available(build(spark.readStream.schema(rows.schema).parquet(source)), mode, target)
    return target


def run_available(stream: DataFrame, mode: str, target: str) -> None:
    """Process what has arrived and stop; restarts continue from the checkpoint.

    Update-mode rows carry their batch number, so readers can take the last one.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True)

    def store(batch: DataFrame, number: int) -> None:
        # A batch that is repeated after a failure replaces its own folder.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/rows/part={number}")

    query = writer.foreachBatch(store).start()
    query.awaitTermination()


def stored_rows(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/rows").drop("part")


def last_update(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Current row per key of an update-mode sink."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")
