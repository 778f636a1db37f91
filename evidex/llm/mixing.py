"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the least change (in relative entropy) from 1 that gives its source
its target number of words and keeps every rate at 3 or less.  The solution is an exponential tilt
by the document's size, rate = min(3, exp(lambda * size / largest size)), with one multiplier per
source.  The multipliers solve the convex dual by safeguarded Newton steps; the sums of a step are
grouped sums over (source, size, number of documents), so a hot source is added up by all tasks.
Rates become copies by a hash of the document: copies = floor(rate + hash in [0, 1) + shift), where
the shift of each source is searched so that the words taken meet its target.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from evidex.llm.common import score_texts
from evidex.session import cut_lineage, shuffle_partitions

WEIGHTS = (5, 2, 1)
MOST = 3  # copies, and target over size
FAN, ROUNDS = 16, 4  # points tried per round of the search for the shift
BROADCAST_SOURCES = 100_000  # rows of (source, numbers); a longer table is joined by shuffle


def with_size(docs: DataFrame) -> DataFrame:
    """Append ``size``: words of ``text`` (runs of characters other than ASCII white space)."""

    def start():
        return lambda texts: {"size": np.array([len(t.encode("utf-8", "surrogatepass").split()) if t else 0 for t in texts], np.int64)}

    return score_texts(docs, "size long", start)


def source_table(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, largest, weight, target: one row per source (null is one).

    Sources are ranked by code point, null last, in range partitions; only the number of sources
    in each partition comes to the driver."""
    spark = sized.sparkSession
    groups = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("largest"))
    order = [F.col("source").isNull(), F.col("source")]
    placed = cut_lineage(
        groups.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "sources",
    )
    before, total = {}, 0
    for row in sorted(placed.groupBy("part").count().collect()):
        before[row["part"]] = total
        total += row["count"]
    if not total:
        return placed.select("source", "source_size", "largest", F.lit(1).alias("weight"), F.lit(0.0).alias("target"))
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("part")]
    rank = F.col("at") + offset
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(rank % len(weights) == i, w).otherwise(weight)
    weighed = placed.withColumn("weight", weight)
    limit, level = F.col("source_size") * MOST, None
    all_words, all_weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, held = all_words / all_weights, -1
    while True:  # each round holds more sources at their limit
        over = F.col("weight") * F.lit(level) > limit
        n, taken, free = weighed.agg(
            F.sum(over.cast("int")), F.sum(F.when(over, limit).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))
        ).first()
        if n == held or not free:
            break
        held, level = n, (all_words - taken) / free
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(float(level)))
    return cut_lineage(weighed.select("source", "source_size", "largest", "weight", target.alias("target")), "targets")


def join_sources(rows: DataFrame, sources: DataFrame, *columns: str) -> DataFrame:
    """Add columns of the source table; broadcast only if its counted rows are few."""
    few = sources.select(F.col("source").alias("_s"), *columns)
    if len(sources.select(F.lit(1)).limit(BROADCAST_SOURCES + 1).collect()) <= BROADCAST_SOURCES:
        few = F.broadcast(few)
    return rows.join(few, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def rate(size: Column, largest: Column, tilt: Column) -> Column:
    return F.exp(F.least(F.lit(math.log(MOST)), tilt * size / F.greatest(largest, F.lit(1))))


def multipliers(sized: DataFrame, sources: DataFrame, most_steps: int = 80) -> DataFrame:
    """``sources`` with ``tilt``: safeguarded Newton steps of all sources at once."""
    sizes = cut_lineage(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    full = F.col("target") >= MOST * F.col("source_size")
    state = sources.withColumn("tilt", F.when(full, 1e15).otherwise(0.0)).withColumn("low", F.lit(float("-inf"))).withColumn(
        "high", F.lit(float("inf"))
    ).withColumn("done", full)
    for _ in range(most_steps):
        x = F.col("size") / F.greatest(F.col("largest"), F.lit(1))
        r = rate(F.col("size"), F.col("largest"), F.col("tilt"))
        words = F.col("n") * F.col("size")
        sums = join_sources(sizes, state.where("not done"), "largest", "tilt").groupBy("source").agg(
            F.sum(words * r).alias("g"), F.sum(F.when(r < MOST, words * x * r).otherwise(0.0)).alias("slope")
        )
        t, g = F.col("tilt"), F.col("g")
        short = g < F.col("target")
        close = F.abs(g - F.col("target")) <= 1e-7 * F.col("target") + 1e-9
        low, high = F.when(short, t).otherwise(F.col("low")), F.when(short, F.col("high")).otherwise(t)
        step = t + (F.col("target") - g) / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("low2")) & (step < F.col("high2"))
        split = F.when(F.col("high2") == float("inf"), 2 * F.abs(t) + 1).when(F.col("low2") == float("-inf"), -2 * F.abs(t) - 1).otherwise(
            (F.col("low2") + F.col("high2")) / 2
        )
        stuck = (F.col("high2") - F.col("low2")) <= 1e-12 * (F.abs(t) + 1)
        moved = (
            state.join(sums.withColumnRenamed("source", "_g"), F.col("source").eqNullSafe(F.col("_g")), "left").drop("_g")
            .withColumn("low2", low).withColumn("high2", high)
            .withColumn("stop", F.col("done") | g.isNull() | close | F.coalesce(stuck, F.lit(False)))
            .withColumn("tilt2", F.when(F.col("stop"), t).when(inside, step).otherwise(split))
        )
        state = cut_lineage(
            moved.select("source", "source_size", "largest", "weight", "target", F.col("tilt2").alias("tilt"), F.col("low2").alias("low"), F.col("high2").alias("high"), F.col("stop").alias("done")),
            "multipliers",
        )
        if state.where("not done").isEmpty():
            break
    # Rounded, so that the order of a sum never decides a copy.
    return state.select("source", "source_size", "largest", "target", F.round("tilt", 9).alias("tilt"))


def unit_hash(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def copies(shift: Column) -> Column:
    """Copies of a document from its rate, hash and its source's shift."""
    exact = rate(F.col("size"), F.col("largest"), F.col("tilt"))
    return F.least(F.lit(MOST), F.greatest(F.lit(0), F.floor(exact + unit_hash("doc_id", "size") + shift))).cast("long")


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, largest, target, tilt, shift: all that the copies of a document need.

    ``sized`` (doc_id, source, size) is read several times: pass a stored table."""
    params = multipliers(sized, source_table(sized, weights))
    state = params.withColumn("low", F.lit(-1.0)).withColumn("high", F.lit(1.0)).withColumn("below", F.lit(0.0)).withColumn("above", F.lit(0.0))
    for _ in range(ROUNDS):
        step = (F.col("high") - F.col("low")) / FAN
        totals = join_sources(sized, state, "largest", "tilt", "low", "high").groupBy("source").agg(
            F.array(*[F.sum(copies(F.col("low") + step * i) * F.col("size")) for i in range(FAN + 1)]).alias("totals")
        )
        joined = state.join(totals.withColumnRenamed("source", "_t"), F.col("source").eqNullSafe(F.col("_t"))).drop("_t")
        # The last point whose total does not pass the target.
        at = F.least(F.lit(FAN - 1), F.greatest(F.lit(0), F.size(F.filter("totals", lambda v: v <= F.col("target"))) - 1))
        state = cut_lineage(
            joined.withColumn("at", at).select(
                "source", "source_size", "largest", "target", "tilt",
                (F.col("low") + step * F.col("at")).alias("low"), (F.col("low") + step * (F.col("at") + 1)).alias("high"),
                F.element_at("totals", F.col("at") + 1).cast("double").alias("below"), F.element_at("totals", F.col("at") + 2).cast("double").alias("above"),
            ),
            "shifts",
        )
    nearer = F.abs(F.col("above") - F.col("target")) < F.abs(F.col("target") - F.col("below"))
    return state.select("source", "source_size", "largest", "target", "tilt", F.when(nearer, F.col("high")).otherwise(F.col("low")).alias("shift"))


def with_copies(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Append source_size, target and ``copies`` to rows with doc_id, source and size."""
    joined = join_sources(rows, planned, "source_size", "largest", "target", "tilt", "shift")
    return joined.withColumn("copies", copies(F.col("shift"))).drop("largest", "tilt", "shift")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``.

    A null text has size 0; null is a source of its own, the last."""
    sized = cut_lineage(with_size(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size"), "sized")
    found = with_copies(sized, plan(sized, weights))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Each row of ``docs`` as many times as the mix takes it (0 to 3)."""
    sized = with_size(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size")
    planned = plan(cut_lineage(sized, "sized"), weights)
    rows = with_copies(with_size(docs), planned)
    return rows.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)
