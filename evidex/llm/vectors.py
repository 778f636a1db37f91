"""Blocks of vectors: what the two searches share.

Rows that take part are packed into shards (blocks of candidates, by the task that reads them) and
the stated queries into blocks; a shard meets every query block once, by an equi-join on the block
number, and a task holds one shard and one block.  Each pair gives at most k rows per query; they
are merged by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidex.session import cut_lineage

SHARD_ROWS, BLOCK_QUERIES = 8192, 512


def usable(vector: Column) -> Column:
    """Not null, not empty, and no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def as_matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as float64 rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def rows_of(table: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles, width) of the rows that can take part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("width", F.size("embedding"))


def pack_rows(rows: DataFrame, limit: int) -> DataFrame:
    """(width, n, ids, data): the rows of each task in blocks of at most ``limit`` of one width."""

    def run(batches):
        held: dict[int, list] = {}

        def out(width):
            ids = np.concatenate([i for i, _ in held[width]])
            data = np.concatenate([m for _, m in held[width]])
            held[width] = []
            for at in range(0, len(ids), limit):
                some = ids[at : at + limit], data[at : at + limit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([width], pa.int32()), pa.array([len(some[0])], pa.int32()), pa.array([some[0].tobytes()], pa.binary()), pa.array([some[1].tobytes()], pa.binary())],
                    ["width", "n", "ids", "data"],
                )

        for batch in batches:
            widths = batch.column(2).to_numpy()
            for width in np.unique(widths).tolist():
                some = batch.filter(pa.array(widths == width)) if (widths != width).any() else batch
                held.setdefault(width, []).append((some.column(0).to_numpy(), as_matrix(some.column(1))))
                if sum(len(i) for i, _ in held[width]) >= limit:
                    yield from out(width)
        for width in list(held):
            if held[width]:
                yield from out(width)

    return rows.select("vec_id", "embedding", "width").mapInArrow(run, "width int, n int, ids binary, data binary")


def unpack(n: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(n, -1)


def search(rows: DataFrame, every: int, k: int, start, score: str) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` of each row whose id is divisible by ``every``.

    ``start()`` gives, per task, a function from a shard (ids, matrix) and queries (ids, matrix)
    to arrays (query_id, vec_id, score) with at most ``k`` rows per query.  A repeated query id
    is asked once, with the smallest of its vectors; repeated candidates are rows of their own.
    Only vectors of one width meet."""
    spark = rows.sparkSession
    asked = cut_lineage(
        rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("width", F.size("embedding")),
        "queries",
    )
    count = asked.count()
    parts = max(1, -(-count // BLOCK_QUERIES))
    dealt = asked.repartition(parts, F.pmod(F.xxhash64("vec_id"), F.lit(parts))) if parts > 1 else asked.coalesce(1)
    packed = cut_lineage(pack_rows(dealt, BLOCK_QUERIES), "query-blocks")
    numbered = packed.select(
        F.monotonically_increasing_id().alias("block"), "width", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("data").alias("qdata")
    )
    numbered = cut_lineage(numbered, "query-blocks")
    # Block numbers only (one per 512 queries); each shard is sent once per block.
    blocks = numbered.groupBy("width").agg(F.collect_list("block").alias("blocks"))
    shards = pack_rows(rows, SHARD_ROWS)
    pairs = (
        shards.join(blocks, "width").withColumn("block", F.explode("blocks")).drop("blocks", "width")
        .repartition(F.xxhash64("block", F.xxhash64("ids")))
        .join(numbered.drop("width"), "block")
    )

    def run(batches):
        step = start()
        for batch in batches:
            for row in batch.to_pylist():
                got = step(unpack(row["n"], row["ids"], row["data"]), unpack(row["qn"], row["qids"], row["qdata"]))
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in got], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, f"query_id long, vec_id long, score {score}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
