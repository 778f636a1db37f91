"""What grows with the documents meets by a shuffle of both sides; small files say little of the rows made of them."""

import corpus_pipeline
from evidex.llm import components, simhash


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_links_and_components_are_not_broadcast(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "prints")
    spark.createDataFrame([(i, (i // 2) << 20) for i in range(40)], "doc_id long, fp long").write.parquet(path)
    prints, seen = spark.read.parquet(path), []
    kept = components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df, name: (seen.append(broadcasts(df)), kept(df, name))[1])
    found = simhash.components_of(prints)
    assert len({r.component_id for r in found.collect()}) < 20
    nodes = prints.groupBy("fp").min("doc_id").toDF("fp", "node")
    assert len(seen) > 1 and not any(seen) and not broadcasts(found) and not broadcasts(simhash.links(nodes))


def test_kept_ids_of_the_pipeline_are_not_broadcast(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert not broadcasts(corpus_pipeline.drop_near_copies(spark, docs, sf_dir))
