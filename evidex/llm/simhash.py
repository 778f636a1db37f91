"""SimHash near-duplicates with pigeonring filtering.

A fingerprint of 64 bits is cut into ``4`` segments on a ring.  If two fingerprints differ in at
most 3 bits, then by the pigeonring principle there is a segment from which on every chain of l
consecutive segments differs in at most floor(3 l / 4) bits: 0, 1, 2, 3.  The chain of the first
two segments is the join key: one side gives its 32 bits, the other side its 32 bits with no or one
flipped bit in the second segment.  Longer chains are checked before the full distance.

Texts with one fingerprint are one row.  A key that holds more than ``block`` fingerprints is not
joined row by row: its fingerprints are dealt into hash blocks, each pair of blocks is compared by
one task in numpy, and only a spanning forest of the links found leaves it, so no group of near
copies is written out as pairs and none is collected.  Fingerprints meet by shuffles: their files are
far smaller than the rows that ``explode`` makes of them, so no join is left to Spark's size check but
that with the few hot keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from evidex.llm.common import score_texts
from evidex.llm.components import connected_components, forest
from evidex.operators.joins import grown
from evidex.session import cut_lineage

SEGMENTS, WIDTH, BITS = 4, 16, 3
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ROWS = 1 << 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; 0 without words.  As a signed
    64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return int(np.uint64(hashed(b" ".join(words), 42)).view(np.int64))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    count, n = np.zeros(64, np.int64), len(first)
    for at in range(0, n, ROWS):
        h = np.array([hashed(line[a:b], 42) for a, b in zip(first[at : at + ROWS], last[at : at + ROWS])], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    set_bits = np.packbits(2 * count > n, bitorder="little")
    return int(set_bits.view("<i8")[0])


def with_fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """Append ``fp`` (signed long) from ``text``; null texts count as empty."""

    def start():
        return lambda texts: {"fp": np.array([fingerprint(t, size) for t in texts], np.int64)}

    return score_texts(docs, "fp long", start)


def segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def chain_key(fp: Column, i: int, flip: Column | None = None) -> Column:
    """Ring position, segment i and the next one (with some bits flipped) as one long."""
    second = segment(fp, i + 1)
    if flip is not None:
        second = second.bitwiseXOR(flip)
    return F.lit(i << 2 * WIDTH).cast("long").bitwiseOR(F.shiftleft(segment(fp, i), WIDTH)).bitwiseOR(second)


def pigeonring(a: Column, b: Column) -> Column:
    """Some ring position whose chains of 1 to 4 segments stay within their budgets."""
    gap = [F.bit_count(segment(a, i).bitwiseXOR(segment(b, i))) for i in range(SEGMENTS)]
    holds = F.lit(False)
    for i in range(SEGMENTS):
        chain, total = F.lit(True), F.lit(0)
        for length in range(1, SEGMENTS + 1):
            total = total + gap[(i + length - 1) % SEGMENTS]
            chain = chain & (total <= BITS * length // SEGMENTS)
        holds = holds | chain
    return holds


def _compare(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two sets of (fp, node) rows."""
    found_a, found_b = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(left), 512):
        part = left[at : at + 512]
        gap = np.bitwise_count(part[:, None, 0].view(np.uint64) ^ right[None, :, 0].view(np.uint64))
        i, j = np.nonzero(gap <= BITS)
        found_a, found_b = forest(np.concatenate([found_a, part[i, 1]]), np.concatenate([found_b, right[j, 1]]))
    return found_a, found_b


def links(nodes: DataFrame, block: int = 256) -> DataFrame:
    """(a, b) links that connect all rows of ``nodes`` (fp, node; fp distinct) that are joined by
    chains of distances of at most 3 bits."""
    fp = F.col("fp")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(WIDTH)])
    exact = nodes.select("fp", "node", F.explode(F.array(*[chain_key(fp, i) for i in range(SEGMENTS)])).alias("key"))
    # One bit flipped in the second segment: xor on the key itself, which ends with that segment.
    near = exact.select("fp", "node", F.explode(F.transform(flips, lambda f: F.col("key").bitwiseXOR(f))).alias("key"))
    heavy = cut_lineage(exact.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "heavy-keys")
    small = exact.join(heavy.select("key"), "key", "left_anti") if heavy.take(1) else exact
    other = near.select(F.col("fp").alias("fp2"), F.col("node").alias("node2"), "key")
    plain = (
        grown(small).join(other, "key")
        .where((F.col("node") != F.col("node2")) & pigeonring(fp, F.col("fp2")))
        .where(F.bit_count(fp.bitwiseXOR(F.col("fp2"))) <= BITS)
        .select(F.col("node").alias("a"), F.col("node2").alias("b"))
    )
    if not heavy.take(1):
        return plain
    # Hot keys: blocks of both sides meet pairwise.
    blocks = F.ceil(F.col("n") / F.lit(8 * block)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    sides = []
    for side, rows in enumerate((exact, near)):
        spread = rows.join(heavy.withColumn("blocks", blocks), "key").withColumn("mine", mine)
        all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        at = ("mine", all_blocks) if side == 0 else (all_blocks, "mine")
        sides.append(spread.select("key", *[F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for c, n in zip(at, ("i", "j"))], F.lit(side).alias("side"), "fp", "node"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = rows[["fp", "node"]].to_numpy(np.int64)
        side = rows["side"].to_numpy()
        a, b = _compare(pairs[side == 0], pairs[side == 1])
        return pd.DataFrame({"a": a, "b": b})

    hot = sides[0].unionByName(sides[1]).groupBy("key", "i", "j").applyInPandas(meet, "a long, b long")
    return plain.unionByName(hot)


def components_of(fingerprints: DataFrame, block: int = 256) -> DataFrame:
    """Append ``component_id``, the smallest doc_id reachable over near fingerprints.

    ``fingerprints`` (doc_id, fp, ...) is read several times: pass a stored table.  Rows with one
    fingerprint form one node.  A fingerprint whose rows all lack an id has a null component."""
    nodes = fingerprints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    known = cut_lineage(nodes.where("node is not null"), "fingerprints")
    # Two fingerprints may share their smallest doc_id (a repeated id): they get a link as well.
    found = connected_components(links(known, block).select("a", "b"))
    comp = grown(known).join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(
        "fp", F.coalesce("component", "node").alias("component_id")
    )
    rest = [c for c in fingerprints.columns if c != "component_id"]
    return grown(fingerprints.select(*rest)).join(comp, "fp", "left").select(*rest, "component_id")


def fingerprint_table(docs: DataFrame, size: int = 3) -> DataFrame:
    return cut_lineage(with_fingerprints(docs.select("doc_id", "text"), size).select("doc_id", "fp"), "simhash")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``.

    Null and wordless texts have fingerprint 0 and are linked like any other."""
    found = components_of(fingerprint_table(docs))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


__all__ = ["components_of", "fingerprint", "fingerprint_table", "links", "near_copies", "pa", "pigeonring"]
