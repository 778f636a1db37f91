"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark, with a shared folder of its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .appName("evidex")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a session whose executors are threads of the driver may name none; it gets one.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    created = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_CONF, created)
    return created


def ship_package(spark: SparkSession) -> str:
    """Send this package to the executors of a session that was started without it.

    Python functions travel by reference, so executors need the package; a zip of it is written
    to the driver's temporary folder and given to Spark, which sends it to every executor."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="evidex-"), "evidex"), "zip", root, "evidex")
    spark.sparkContext.addPyFile(packed)
    return packed


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/evidex/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The files outlive any executor, so a lost one costs a re-read only.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

