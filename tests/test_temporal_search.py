"""The temporal evaluation scores a question's vector against vectors, not against every window that names one."""

from evidex.operators import evaluation as ev, search
from evidex.plans import evaluation as plans

SF_DIR = "/root/testdata/sf0.001"


def test_memory_is_a_row_per_vector(spark, monkeypatch):
    seen, kept = [], search.scan_blocks
    monkeypatch.setattr(search, "scan_blocks", lambda queries, memory, *more: (seen.append(memory.count()), kept(queries, memory, *more))[1])
    plans.temporal(spark, SF_DIR).count()
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
    assert seen and all(n <= vectors for n in seen)


def test_named_and_held_vectors_give_the_same_results(spark):
    vectors = spark.createDataFrame([(i, [((i * 37 + d * 11) % 23 - 11) / 7.0 for d in range(6)]) for i in range(12)], "vec_id long, vector array<double>")
    windows = spark.createDataFrame(
        [(n, (n * 5) % 13, f"w{n}", f"v{n % 4}", 2.0 * (n // 4), 2.0 * (n // 4) + 4) for n in range(200)],
        "ord long, vec_id long, window_id string, video_id string, start_s double, end_s double",
    )
    asked = vectors.where("vec_id < 5").selectExpr("cast(vec_id as string) as query_id", "vector")
    columns = ["query_id", "rank", "window_id", "start_s", "end_s"]
    held = ev.temporal_results(asked, windows.join(vectors, "vec_id"), 4).select(*columns)
    named = ev.temporal_results(asked, windows, 4, vectors).select(*columns)
    assert held.count() >= 5 and sorted(named.collect()) == sorted(held.collect())
