"""Exact top-k search by MaxScore over quantised vectors.

A component is a term, its integer floor(256 x) the posting's value; the score is the integer inner
product.  A shard keeps, per term, the postings of its rows and their largest and smallest value,
so a query knows the most that each term can add.  Terms are split by these bounds: the terms whose
bounds together cannot lift a row over the current threshold are non-essential.  The postings of
the essential terms are traversed; the others are probed, in blocks of falling bounds, only for
rows that can still reach the threshold.  Shards are merged by query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from evidex.llm.vectors import rows_of, search, top_rows

PROBE = 8  # non-essential terms probed at a time
SEED_ROWS = 64  # rows scored in full for the first threshold


class Postings:
    """Term-major values of one shard with the bounds of every term."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids = ids
        self.lists = np.ascontiguousarray(matrix.T)
        self.high, self.low = self.lists.max(1), self.lists.min(1)


def search_shard(shard: Postings, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the shard's k best rows but the query's own."""
    allowed = shard.ids != query_id
    if not allowed.any():
        return np.empty(0, np.int64), np.empty(0)
    most = np.maximum(query * shard.high, query * shard.low)
    least = np.minimum(query * shard.high, query * shard.low)
    order = np.argsort(least - most, kind="stable")  # widest first
    spread = (most - least)[order]
    # First threshold: full scores of the rows that are best in the widest term.
    first = shard.lists[order[0]] * query[order[0]]
    some = np.argpartition(-first, min(SEED_ROWS, len(first) - 1))[: SEED_ROWS] if len(first) > SEED_ROWS else np.arange(len(first))
    some = some[allowed[some]]
    seeds = query @ shard.lists[:, some]
    threshold = np.sort(seeds)[-k] if len(seeds) >= k else -np.inf
    # What the terms from position i on can add over their least, and the split.
    rest = np.concatenate([np.cumsum(spread[::-1])[::-1], [0.0]])
    essential = int(np.argmax(least.sum() + rest < threshold)) if (least.sum() + rest < threshold).any() else len(order)
    essential = max(1, essential)
    left = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0.0]])
    partial = query[order[:essential]] @ shard.lists[order[:essential]]
    alive = np.flatnonzero(allowed & (partial + left[essential] >= threshold))
    partial = partial[alive]
    for at in range(essential, len(order), PROBE):
        terms = order[at : at + PROBE]
        partial = partial + query[terms] @ shard.lists[np.ix_(terms, alive)]
        if len(partial) > k:
            # A row is sure of its partial sum and the least of the rest.
            sure = np.partition(partial, len(partial) - k)[len(partial) - k] + least[order[at + PROBE :]].sum()
            threshold = max(threshold, sure)
        keep = partial + left[min(at + PROBE, len(order))] >= threshold
        alive, partial = alive[keep], partial[keep]
    best = top_rows(partial, shard.ids[alive], k)
    return alive[best], partial[best]


def top_k(table: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: exact largest integer inner products, ties to smaller ids.

    Vectors null, empty or holding null or non-finite components take no part, and rows without an
    id neither.  Sums of integers are exact in doubles up to 2**53."""
    rows = rows_of(table).withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")))

    def start():
        def step(shard, queries):
            lists = Postings(*shard)
            found = [[], [], []]
            for q, vector in zip(*queries):
                places, scores = search_shard(lists, q, vector, k)
                found[0].append(np.full(len(places), q))
                found[1].append(shard[0][places])
                found[2].append(scores.astype(np.int64))
            return [np.concatenate(f).astype(np.int64) if f else np.empty(0, np.int64) for f in found]

        return step

    return search(rows, every, k, start, "long")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
