"""Sinks: records, indexes, resumable caches and reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_records(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """JSON lines; an existing target is refused."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_index(df: DataFrame, path: str, model_id: str, model_revision: str, vector: str = "vector") -> None:
    """Rows, vectors and model in one table; a count and dimension row beside it.

    Rows appear only when the write has committed, and the metadata row follows
    them, so a folder without metadata is an unfinished index.
    """
    rows = df.withColumn("model_id", F.lit(model_id)).withColumn("model_revision", F.lit(model_revision))
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    stored.agg(
        F.count("*").alias("count"), F.max(F.size(vector)).alias("embedding_dim"),
        F.lit(model_id).alias("model_id"), F.lit(model_revision).alias("model_revision"),
    ).write.mode("errorifexists").parquet(f"{path}/metadata")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows and metadata of a finished index; without metadata, or with another count, it fails."""
    if not _exists(spark, f"{path}/metadata"):
        raise FileNotFoundError(f"unfinished index: {path}")
    rows, metadata = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/metadata")
    if rows.count() != metadata.first()["count"]:
        raise ValueError(f"index rows do not match its metadata: {path}")
    return rows, metadata


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def check_config(spark: SparkSession, path: str, config: dict[str, object], resume: bool) -> None:
    """Store the cache's configuration, or compare it with the stored one."""
    text, place = json.dumps(config, sort_keys=True), f"{path}/config"
    if not _exists(spark, place):
        spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(place)
        return
    if not resume:
        raise FileExistsError(f"cache is not empty: {path}")
    if spark.read.text(place).first()["value"] != text:
        raise ValueError("resume configuration does not match the existing cache")


CACHE_SCHEMA = "window_id string, video_id string, frame_embeddings array<array<float>>, failed boolean"


def embed_windows(
    spark: SparkSession, windows: DataFrame, path: str, config: dict[str, object],
    make_encoder: Callable[[], Callable[[list[list[float]]], list[np.ndarray]]], shards: int = 64, resume: bool = False,
) -> DataFrame:
    """Encode the windows that are not cached yet and return the whole cache.

    ``windows``: ``window_id, video_id, timestamps_s``.  Work is spread by window, so
    a long recording is many tasks, and stored by a hash shard; a resumed run skips
    every stored window and tries failed ones again.  The encoder is made once per
    task; a window it raises ``ValueError`` on is stored as failed.
    """
    check_config(spark, path, config, resume)
    rows = f"{path}/rows"
    todo = windows.select("window_id", "video_id", "timestamps_s")
    if _exists(spark, rows):
        todo = todo.join(spark.read.parquet(rows).filter(~F.col("failed")).select("window_id"), "window_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            made, failed = [], []
            for times in batch["timestamps_s"]:
                try:
                    made.append([np.asarray(v, dtype=np.float32) for v in encoder(list(times))])
                    failed.append(False)
                except ValueError:
                    made.append(None)
                    failed.append(True)
            yield batch[["window_id", "video_id"]].assign(frame_embeddings=made, failed=failed)

    encoded = todo.mapInPandas(run, CACHE_SCHEMA).withColumn("shard", F.pmod(F.xxhash64("video_id"), F.lit(shards)))
    encoded.write.mode("append").partitionBy("shard").parquet(rows)
    return spark.read.parquet(rows)


def cache_summary(cache: DataFrame) -> DataFrame:
    """Windows stored, recordings, recordings with a failed window and frames per window.

    A retry is appended, so a window counts as failed only if no row of it succeeded."""
    latest = cache.groupBy("window_id", "video_id").agg(
        F.min(F.col("failed").cast("int")).alias("failed"), F.max(F.size("frame_embeddings")).alias("frames")
    )
    videos = latest.groupBy("video_id").agg(
        F.sum(1 - F.col("failed")).cast("long").alias("windows"), F.max("failed").alias("failed"), F.max("frames").alias("frames")
    )
    return videos.agg(
        F.sum("windows").alias("window_count"), F.count("*").alias("video_count"), F.sum("failed").cast("long").alias("failed_videos"),
        F.max("frames").alias("frames_per_window"),
    )


def report_lines(metrics: DataFrame, lines: list[tuple[str, Column, str]]) -> DataFrame:
    """Markdown bullets of a one-row table; a null value reads ``unavailable``."""
    made = [
        F.when(value.isNull(), F.lit(f"- {label}: unavailable")).otherwise(F.format_string(f"- {label}: {form}", value))
        for label, value, form in lines
    ]
    return metrics.select(F.explode(F.array(*made)).alias("value"))


def write_report(lines: DataFrame, path: str) -> None:
    lines.write.mode("errorifexists").text(path)
