"""Connected components of a table of links, by alternating star contractions.

Links stay in tables; each round is a few grouped minima with map-side combine and two joins, and
its result is written to the shared folder, so lineage stays short and a lost executor costs a
re-read.  The joins shuffle both sides: stored links are a fraction of the size they have in memory.
Before the first round every task reduces its own links to a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidex.operators.joins import grown
from evidex.session import cut_lineage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) with the components of the links (a, b)."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        low = np.minimum(px, py)
        new = parent.copy()
        np.minimum.at(new, px, low)
        np.minimum.at(new, py, low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == parent).all():
            break
        parent = new
    keep = parent != np.arange(len(nodes))
    return nodes[keep], nodes[parent[keep]]


def local_forest(links: DataFrame) -> DataFrame:
    """Fewer links with the same components: the spanning forest of each block of rows."""

    def run(batches):
        for batch in batches:
            a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest reachable node of every node that has a link.

    ``links`` has two long columns.  Null ends are ignored; self links give no row."""
    a, b = links.columns
    edges = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    )
    edges = cut_lineage(local_forest(edges).distinct(), "links")
    last = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # Larger neighbours of a node now point to the smallest node it knows.
        large = grown(both.where("b > a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # And its smaller neighbours too (every link of ``large`` points down).
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = grown(large).join(least, "a")
        links_now = (
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        edges = cut_lineage(links_now, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
