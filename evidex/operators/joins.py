"""Range joins as equi-joins on blocks of time and space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidex.functions.intervals import overlaps
from evidex.session import cut_lineage


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so a table can meet itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def grown(df: DataFrame) -> DataFrame:
    """Rows that ``explode`` or a join made of few: Spark takes them for as small as the files behind them
    and would send them whole through the driver to every task.  Their next join shuffles both sides."""
    return df.hint("merge")


TOP_LEVEL = 14  # nodes hold up to 2**14 slots; beyond, a longer interval has one node per 2**14


def _shift(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level)


def dyadic_cover(low: Column, high: Column) -> Column:
    """array<struct<level, node>>: disjoint aligned blocks of ``2**level`` slots, numbered ``slot >> level``,
    that together are the slots ``low`` to ``high``: at most two per level below the top one."""
    low, after = low.cast("long"), high.cast("long") + 1
    first = lambda level: -_shift(-low, level)  # the first block of the level that begins at or after low
    end = lambda level: _shift(after, level)
    node = lambda level, n: F.struct(level.cast("int").alias("level"), n.alias("node"))

    def ends(level: Column) -> Column:
        some = first(level) < end(level)
        return F.array(
            F.when(some & (first(level).bitwiseAND(F.lit(1)) == 1), node(level, first(level))),
            F.when(some & (end(level).bitwiseAND(F.lit(1)) == 1), node(level, end(level) - 1)),
        )

    deepest = F.least(F.lit(TOP_LEVEL - 1), F.length(F.bin(after - low)) - 1)
    below = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), deepest), ends)), lambda n: n.isNotNull())
    top = F.lit(TOP_LEVEL)
    whole = F.when(
        first(top) < end(top), F.transform(F.sequence(first(top), end(top) - 1), lambda n: node(top, n))
    ).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))
    return F.when(low < after, F.concat(below, whole))


def levels_used(cover: Column) -> Column:
    """The levels of a cover as bits."""
    return F.aggregate(cover, F.lit(0).cast("long"), lambda bits, n: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), n["level"])))


def dyadic_path(slot: Column, levels: Column) -> Column:
    """array<struct<level, node>>: the blocks that hold a slot, at the levels set in ``levels``."""
    used = F.filter(F.sequence(F.lit(0), F.lit(TOP_LEVEL)), lambda x: F.call_function("shiftright", levels, x).bitwiseAND(F.lit(1)) == 1)
    return F.transform(used, lambda x: F.struct(x.cast("int").alias("level"), _shift(slot.cast("long"), x).alias("node")))


def interval_join(
    left: DataFrame, right: DataFrame, key: str, left_ends: tuple[str, str], right_ends: tuple[str, str], width: float
) -> DataFrame:
    """Rows of equal ``key`` whose intervals strictly overlap, each pair once.

    Of two intervals that overlap, one holds the start of the other.  Each side is placed twice: as the
    dyadic blocks (in slots of ``width``) that cover it, and as the blocks of its start at the levels
    that covers of the other side use under the same key.  Covers meet starts on ``(key, level, block)``,
    so an interval is a few rows however long it is, and a start a few rows however many intervals hold
    it.  Both sides are read twice: store expensive ones first.  Column names other than ``key`` must
    differ between the sides; rows without key or ends meet nothing.
    """

    def slots(ends: tuple[str, str]) -> tuple[Column, Column]:
        low = F.floor(F.col(ends[0]) / width)
        return low, F.greatest(low, F.floor(F.col(ends[1]) / width))

    def levels(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        return df.groupBy(key).agg(F.bit_or(levels_used(dyadic_cover(*slots(ends)))).alias("_levels"))

    def placed(df: DataFrame, ends: tuple[str, str], other: DataFrame, held: int) -> DataFrame:
        """``held``: the side (0 left, 1 right) whose cover holds the start of the other."""
        low, high = slots(ends)
        tagged = lambda nodes, side: F.transform(nodes, lambda n: F.struct(F.lit(side).alias("side"), n["level"].alias("level"), n["node"].alias("node")))
        nodes = F.concat(tagged(dyadic_cover(low, high), held), tagged(dyadic_path(low, F.col("_levels")), 1 - held))
        known = [c for c in df.columns]
        return grown(df.join(grown(other), key).select(*known, F.explode(nodes).alias("_at")).select(
            *known, F.col("_at.side").alias("_side"), F.col("_at.level").alias("_level"), F.col("_at.node").alias("_node")
        ))

    both = placed(left, left_ends, levels(fresh(right), right_ends), 0).join(
        placed(right, right_ends, levels(fresh(left), left_ends), 1), [key, "_side", "_level", "_node"]
    )
    begins = F.when(F.col("_side") == 0, F.col(left_ends[0]) <= F.col(right_ends[0])).otherwise(F.col(left_ends[0]) > F.col(right_ends[0]))
    return grown(both.filter(overlaps(*left_ends, *right_ends) & begins).drop("_side", "_level", "_node"))


CELL = ["_cx", "_cy", "_cz"]
BLOCK_ROWS = 4096  # rows of a side that meet those of the other in one group


def _cells(df: DataFrame, point: str, radius: float) -> DataFrame:
    for at, name in enumerate(CELL, 1):
        df = df.withColumn(name, F.floor(F.element_at(point, at) / radius))
    return df


def _around(df: DataFrame) -> DataFrame:
    """Each row in the 27 cells around its own."""
    for name in CELL:
        df = df.withColumn(name, F.explode(F.sequence(F.col(name) - 1, F.col(name) + 1)))
    return df


def _heavy_cells(still: DataFrame, moved: DataFrame, block_rows: int) -> DataFrame:
    """``_still, _moved``: into how many blocks either side of a cell is dealt, where that is more than
    one.  At most a row per ``block_rows`` rows of a side."""
    own = still.groupBy(*CELL).agg(F.count("*").alias("_n"))
    near = _around(moved.groupBy(*CELL).agg(F.count("*").alias("_m"))).groupBy(*CELL).agg(F.sum("_m").alias("_m"))
    parts = lambda n: F.ceil(F.col(n) / block_rows).cast("int")
    both = own.join(near, CELL).select(*CELL, parts("_n").alias("_still"), parts("_m").alias("_moved"))
    return cut_lineage(both.where("_still > 1 or _moved > 1"), "heavy-cells")


def _dealt(df: DataFrame, heavy: DataFrame, own: str, other: str) -> DataFrame:
    """Rows in their block of the cell, once for every block of the other side."""
    columns = [c for c in df.columns]
    known = df.withColumn("_deal", F.xxhash64(*columns)).join(heavy, CELL, "left")
    block = F.coalesce(F.pmod(F.col("_deal"), F.col(own)).cast("int"), F.lit(0))
    blocks = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
    return known.select(*columns, block.alias(f"{own}_block"), F.explode(blocks).alias(f"{other}_block"))


def grid_neighbours(
    left: DataFrame, right: DataFrame, left_point: str, right_point: str, radius: float,
    copied: str = "left", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Candidate pairs of 3-d points at most one cell of side ``radius`` apart.

    Only one side (``copied``, the smaller one) is copied to the 27 cells around its own, so every pair
    appears once; the caller filters by the exact distance.  A cell that holds more than ``block_rows``
    rows of a side is cut: both sides are dealt into blocks by hash and every two blocks meet as a group
    of their own, so a crowded cell is shared by many tasks.  Both sides are read twice.
    """
    sides = (left, left_point), (right, right_point)
    (moved, moved_point), (still, still_point) = sides if copied == "left" else sides[::-1]
    heavy = _heavy_cells(
        _cells(fresh(still).select(still_point), still_point, radius), _cells(fresh(moved).select(moved_point), moved_point, radius), block_rows
    )
    near = _dealt(_around(_cells(moved, moved_point, radius)), heavy, "_moved", "_still")
    own = _dealt(_cells(still, still_point, radius), heavy, "_still", "_moved")
    blocks = ["_moved_block", "_still_block"]
    return grown(near).join(own, [*CELL, *blocks]).drop(*CELL, *blocks)
