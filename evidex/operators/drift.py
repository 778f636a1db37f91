"""Drift between an index and its source, found by descending a stored hash tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidex.operators.embeddings import fingerprint_depth, label_digest, parent_level, row_drift
from evidex.session import cut_lineage

BRANCH = 2  # hex digits of a row's place that name its folder: 256 folders


def digest_rows(df: DataFrame, label: str, content: Column) -> DataFrame:
    """label, place (hex digest of the label), digest (of label and content) of every row; a null label
    or content counts as the empty one."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = df.select(text(F.col(label)).alias("label"), text(content).alias("_content"))
    return rows.select("label", F.sha2("label", 256).alias("place"), label_digest("label", "_content").alias("digest"))


def tree_levels(digests: DataFrame, depth: int) -> DataFrame:
    """level, place, digest: all nodes of the hash tree, the root at level 0, leaves at ``depth``."""
    level, levels = digests.select("place", "digest"), []
    for size in range(depth, -1, -1):
        # Each level is stored, a sixteenth of the one below, so none is computed twice.
        level = cut_lineage(parent_level(level, size), "tree-level")
        levels.append(level.select(F.lit(size).alias("level"), "place", "digest"))
    tree = levels[0]
    for more in levels[1:]:
        tree = tree.unionByName(more)
    return tree


def store_fingerprint(df: DataFrame, label: str, content: Column, path: str) -> None:
    """Keep what a later check needs beside an index: its tree by level, and the digest of every row in
    folders by the beginning of its place."""
    digests = digest_rows(df, label, content)
    depth = fingerprint_depth(df.count())
    digests.withColumn("branch", F.substring("place", 1, BRANCH)).repartition("branch").write.partitionBy("branch").parquet(f"{path}/rows")
    tree_levels(_digest_table(df.sparkSession, path), depth).write.partitionBy("level").parquet(f"{path}/tree")


def _digest_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("label string, place string, digest string, branch string").parquet(f"{path}/rows")


def stored_tree(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    tree = spark.read.schema("place string, digest string, level int").parquet(f"{path}/tree")
    return tree, tree.agg(F.max("level")).first()[0] or 0  # an empty index has no nodes


def differing_leaves(left: DataFrame, right: DataFrame, depth: int) -> DataFrame:
    """place of the leaves that differ between two trees of ``depth``: only children of nodes that
    differ are compared, so equal trees cost one row each."""
    found = None
    for level in range(depth + 1):
        sides = []
        for tree, name in ((left, "_left"), (right, "_right")):
            nodes = tree.where(F.col("level") == level).select("place", F.col("digest").alias(name))
            if found is not None:
                above = found.select(F.col("place").alias("_above"))
                nodes = nodes.join(above, F.substring("place", 1, level - 1) == F.col("_above"), "left_semi")
            sides.append(nodes)
        both = sides[0].join(sides[1], "place", "full")
        found = cut_lineage(both.where(~F.col("_left").eqNullSafe(F.col("_right"))).select("place"), "differing")
        if found.isEmpty():
            break
    return found


def stored_rows(spark: SparkSession, path: str, leaves: DataFrame) -> DataFrame:
    """Stored digests under the given leaves; only the folders that hold them are read."""
    branches = [r[0] for r in leaves.select(F.substring("place", 1, BRANCH)).distinct().limit(16**BRANCH).collect()]
    rows = _digest_table(spark, path)
    # A leaf of a small tree is shorter than the name of a folder.
    held = [F.col("branch").startswith(b) for b in branches if len(b) < BRANCH]
    listed = [b for b in branches if len(b) == BRANCH]
    chosen = F.col("branch").isin(listed) if listed else F.lit(False)
    for more in held:
        chosen = chosen | more
    return rows.where(chosen).drop("branch")


def content_drift(spark: SparkSession, path: str, source: DataFrame, label: str, content: Column) -> DataFrame:
    """label, problem, leaf of rows whose content is not what was stored: ``changed``, ``index_only`` or
    ``source_only``; rows of one label are compared as a multiset.

    The source is digested once; its rows and the stored ones are compared below differing leaves only."""
    tree, depth = stored_tree(spark, path)
    digests = cut_lineage(digest_rows(source, label, content), "source-digests")
    leaves = differing_leaves(tree, tree_levels(digests, depth), depth)

    def below(rows: DataFrame) -> DataFrame:
        marked = rows.withColumn("leaf", F.substring("place", 1, depth))
        return marked.join(leaves.select(F.col("place").alias("leaf")), "leaf", "left_semi").select("label", "leaf", "digest")

    apart = row_drift(below(stored_rows(spark, path, leaves)), below(digests), ["label", "leaf", "digest"])
    sides = apart.groupBy("label", "leaf").agg(F.min("side").alias("_first"), F.max("side").alias("_last"))
    problem = F.when(F.col("_first") != F.col("_last"), "changed").otherwise(F.col("_first"))
    return sides.select("label", problem.alias("problem"), "leaf")


def require_unchanged(spark: SparkSession, path: str, records: DataFrame, source: DataFrame, columns: list[str], label: str, content: Column) -> None:
    """The two refusals of loading an index: its records must be those of the source, and the content
    of the source must have the stored fingerprint."""
    if not row_drift(records, source, columns).isEmpty():
        raise ValueError("records of the index and of its source differ")
    tree, depth = stored_tree(spark, path)
    root = tree.where("level = 0").select("digest").first()
    now = tree_levels(digest_rows(source, label, content), depth).where("level = 0").select("digest").first()
    if root != now:
        raise ValueError("the source has another fingerprint than when the index was built")
