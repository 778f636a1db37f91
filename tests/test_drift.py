"""Fingerprint trees: what is read for one change, and both refusals."""

import pytest
from pyspark.sql import functions as F

from evidex.operators import drift, embeddings


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "fingerprint")
    rows = spark.range(0, 20_000).select(F.col("id").cast("string").alias("label"), F.concat(F.lit("text "), F.col("id") % 77).alias("text"))
    drift.store_fingerprint(rows, "label", F.col("text"), path)
    return path, rows


def changed(rows, label):
    return rows.withColumn("text", F.when(F.col("label") == label, "other").otherwise(F.col("text")))


def test_one_changed_row_touches_one_leaf(spark, stored):
    path, rows = stored
    tree, depth = drift.stored_tree(spark, path)
    assert depth == embeddings.fingerprint_depth(20_000) == 3
    root = tree.where("level = 0").first().digest
    assert root == embeddings.fingerprint(rows, "label", "text", depth).first().fingerprint
    now = drift.tree_levels(drift.digest_rows(changed(rows, "1234"), "label", F.col("text")), depth)
    leaves = drift.differing_leaves(tree, now, depth)
    assert leaves.count() == 1
    read = drift.stored_rows(spark, path, leaves)
    place = leaves.first().place
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert files and all(f"branch={place[:2]}/" in name for name in files)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert f"= {place[:2]})" in plan.split("PartitionFilters: [")[1].split("]")[0]  # the other folders are not opened
    assert read.where(F.col("place").startswith(place)).count() < 64 < 20_000
    found = drift.content_drift(spark, path, changed(rows, "1234"), "label", F.col("text")).collect()
    assert [(r.label, r.problem, r.leaf) for r in found] == [("1234", "changed", place)]


def test_equal_trees_stop_at_the_root(spark, stored):
    path, rows = stored
    tree, depth = drift.stored_tree(spark, path)
    assert drift.differing_leaves(tree, tree, depth).count() == 0
    assert drift.content_drift(spark, path, rows.repartition(5), "label", F.col("text")).count() == 0


def test_new_lost_and_repeated_rows(spark, stored):
    path, rows = stored
    extra = spark.createDataFrame([("new", "x"), ("7", "text 7"), (None, "y")], "label string, text string")
    found = drift.content_drift(spark, path, rows.where("label <> '11'").unionByName(extra), "label", F.col("text")).collect()
    assert {(r.label, r.problem) for r in found} >= {("new", "source_only"), ("11", "index_only"), ("7", "source_only")}


def test_small_and_empty_indexes(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "label string, text string")
    for name, was in (("small", rows), ("empty", rows.where("label = 'z'"))):
        drift.store_fingerprint(was, "label", F.col("text"), str(tmp_path / name))
        found = drift.content_drift(spark, str(tmp_path / name), changed(rows, "b"), "label", F.col("text")).collect()
        want = {("b", "changed")} if name == "small" else {("a", "source_only"), ("b", "source_only")}
        assert {(r.label, r.problem) for r in found} == want


def test_both_refusals(spark, stored):
    path, rows = stored
    check = lambda records, source: drift.require_unchanged(spark, path, records, source, ["label"], "label", F.col("text"))
    check(rows, rows)
    with pytest.raises(ValueError, match="differ"):
        check(rows.where("label <> '5'"), rows)
    with pytest.raises(ValueError, match="fingerprint"):
        check(rows, changed(rows, "5"))
