"""Contracts and small transforms of embedding tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from evidex.functions.vectors import all_finite, as_double, l2_normalize, norm

UNIT_TOLERANCE = 1e-5
IDENTICAL_TOLERANCE = 1e-7


def validate_embeddings(df: DataFrame, id_column: str, vector: str, dim: int) -> DataFrame:
    """Violations ``(id, rule)``: dimension, finite, unit; and one ``identical``
    row with a null id when every vector is the same."""
    v = F.col(vector)
    rules = F.array(
        F.when(F.coalesce(F.size(v), F.lit(-1)) != dim, "dimension"),
        F.when(~all_finite(v), "finite"),
        F.when(all_finite(v) & (F.abs(norm(v) - 1.0) > UNIT_TOLERANCE), "unit"),
    )
    per_row = df.select(
        F.col(id_column).alias("id"),
        F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"),
    )
    spread = (
        df.select(F.posexplode(as_double(v)).alias("dim", "x"))
        .groupBy("dim")
        .agg((F.max("x") - F.min("x")).alias("spread"), F.count("*").alias("n"))
        .agg(F.max("spread").alias("spread"), F.max("n").alias("n"))
        .filter((F.col("n") > 1) & (F.col("spread") <= IDENTICAL_TOLERANCE))
        .select(F.lit(None).cast(df.schema[id_column].dataType).alias("id"), F.lit("identical").alias("rule"))
    )
    return per_row.unionByName(spread)


def normalize(df: DataFrame, vector: str, strict: bool = False) -> DataFrame:
    """L2-normalise a column; ``strict`` refuses zero vectors."""
    length = F.col("_length")
    if strict:
        length = F.when(length == 0, F.raise_error(F.lit("query vector must have a non-zero norm"))).otherwise(length)
    return (
        df.withColumn("_length", norm(F.col(vector)))
        .withColumn(vector, l2_normalize(F.col(vector), length))
        .drop("_length")
    )


def duplicate_ids(df: DataFrame, *ids: str) -> DataFrame:
    """Null or repeated ids with their row count."""
    missing = F.lit(False)
    for name in ids:
        missing = missing | F.col(name).isNull()
    return df.groupBy(*ids).agg(F.count("*").alias("rows")).filter((F.col("rows") > 1) | missing)


def count_contract(declared: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose declared row count is not the counted one."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("actual"))
    both = declared.select(*keys, "declared").join(counted, keys, "full")
    return both.select(
        *keys, F.coalesce("declared", F.lit(0)).cast("long").alias("declared"),
        F.coalesce("actual", F.lit(0)).cast("long").alias("actual"),
    ).filter(F.col("declared") != F.col("actual"))


def fingerprint(df: DataFrame, label: str, content: str, depth: int = 4) -> DataFrame:
    """One sha-256 over all ``(label, content)`` rows, whatever their partitioning.

    A hash tree over the hex prefixes of the label digest: ``depth`` levels of
    fan-in 16 above leaves of about ``rows / 16**depth`` digests, so no group grows
    with the corpus when ``depth`` follows its size (see ``fingerprint_depth``).
    """
    level = df.select(F.sha2(F.col(label), 256).alias("place"), label_digest(label, content).alias("digest"))
    for size in range(depth, -1, -1):
        level = parent_level(level, size)
    return level.select(F.col("digest").alias("fingerprint"))


def label_digest(label: str, content: str) -> Column:
    """Digest of one row: its length-prefixed label and the digest of its content."""
    return F.sha2(F.concat_ws(":", F.length(label).cast("string"), F.col(label), F.sha2(F.col(content), 256)), 256)


def parent_level(level: DataFrame, size: int) -> DataFrame:
    """The nodes (place, digest) of ``size`` hex digits above those of ``level``."""
    return (
        level.groupBy(F.substring("place", 1, size).alias("prefix"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("parts"))
        .select(
            F.col("prefix").alias("place"),
            F.sha2(F.array_join(F.transform("parts", lambda p: p["digest"]), ""), 256).alias("digest"),
        )
    )


def fingerprint_depth(rows: int) -> int:
    """Levels that leave about 64 digests in a leaf."""
    depth = 0
    while rows > 64 * 16**depth:
        depth += 1
    return depth


def row_drift(index: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """Rows on one side only, as a multiset difference in a single shuffle."""
    sides = index.select(*columns, F.lit(1).alias("_n")).unionByName(
        source.select(*columns, F.lit(-1).alias("_n"))
    )
    return (
        sides.groupBy(*columns)
        .agg(F.sum("_n").alias("_n"))
        .filter(F.col("_n") != 0)
        .select(
            *columns,
            F.when(F.col("_n") > 0, "index_only").otherwise("source_only").alias("side"),
            F.abs("_n").cast("long").alias("copies"),
        )
    )


def model_guard(memory: DataFrame, queries: DataFrame) -> DataFrame:
    """Empty when both sides share one ``(model_id, model_revision)``, else all of them."""
    sides = (
        memory.select("model_id", "model_revision").distinct().withColumn("side", F.lit("memory"))
        .unionByName(queries.select("model_id", "model_revision").distinct().withColumn("side", F.lit("query")))
    )
    models = sides.groupBy("model_id", "model_revision").agg(
        F.array_join(F.sort_array(F.collect_set("side")), ",").alias("sides")
    )
    return models.filter(models.agg(F.count("*")).scalar() > 1)


Encoder = Callable[[list], np.ndarray]


def batch_encode(
    df: DataFrame, column: str, make_encoder: Callable[[], Encoder], batch_size: int = 32, out: str = "vector"
) -> DataFrame:
    """Encode a column in batches; the encoder is made once per task and its
    output is L2-normalised."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for part in parts:
            made = []
            for low in range(0, len(part), batch_size):
                rows = np.asarray(encoder(part.iloc[low : low + batch_size].tolist()), dtype=np.float64)
                size = np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-8)
                made.extend((rows / size).astype(np.float32))
            yield pd.Series(made, index=part.index, dtype=object)

    return df.withColumn(out, encode(F.col(column)))


def rgb_histogram(pixels: DataFrame, keys: list[str], bins: int = 16) -> DataFrame:
    """Colour descriptor per key from ``r, g, b`` pixels: three density
    histograms, grey mean and deviation, L2-normalised."""
    counts = [
        F.sum(
            (F.least(F.floor(F.col(c) * bins / 255), F.lit(bins - 1)) == b).cast("long")
        ).alias(f"_{c}{b}")
        for c in "rgb"
        for b in range(bins)
    ]
    grey = (F.col("r") + F.col("g") + F.col("b")) / 3 / 255
    grouped = pixels.groupBy(*keys).agg(
        *counts, F.count("*").alias("pixels"), F.avg(grey).alias("grey_mean"), F.stddev_pop(grey).alias("grey_std")
    )
    density = [F.col(f"_{c}{b}") * bins / F.col("pixels") for c in "rgb" for b in range(bins)]
    made = grouped.select(
        *keys, "pixels", F.array(*density, F.col("grey_mean"), F.col("grey_std")).alias("descriptor")
    )
    return normalize(made, "descriptor")


def mean_pool(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean vector per key, re-normalised; values meet as partial sums per dimension."""
    means = (
        df.select(*keys, F.posexplode(as_double(F.col(vector))).alias("dim", "x"))
        .groupBy(*keys, "dim")
        .agg(F.avg("x").alias("x"))
    )
    packed = means.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias(vector)
    )
    return normalize(packed, vector)


def neighbour_context(df: DataFrame, episode: str, step: str, action: str, order: str | None = None) -> DataFrame:
    """Actions at the steps before, at and after each row of the same episode.

    Every row is offered to its three target steps, so the work is keyed by
    ``(episode, step)`` and a long episode spreads over all tasks.  Where a step may
    occur more than once, ``order`` names the source order and the last row counts.
    """
    usable = df.filter(F.col(episode).isNotNull() & F.col(step).isNotNull())
    if order:
        usable = usable.groupBy(episode, step).agg(F.max_by(action, order).alias(action))
    offers = usable.select(
        episode, F.explode(F.sequence(F.col(step) - 1, F.col(step) + 1)).alias("_target"), step, action
    )
    return (
        offers.groupBy(episode, F.col("_target").alias("_step"))
        .agg(
            F.max((F.col(step) == F.col("_target")).cast("int")).alias("_present"),
            F.sort_array(F.collect_list(F.struct(F.col(step).alias("step"), F.col(action).alias("action")))).alias("nearby"),
        )
        .filter(F.col("_present") == 1)
        .select(episode, F.col("_step").alias(step), "nearby")
    )


def lookup(requests: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Requested records; ``found`` is false for an unknown id."""
    return requests.join(records.withColumn("found", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )
