"""The vector searches beside brute force."""

import numpy as np
import pytest

import check
from evidex.llm import maxscore, projections, queries


def test_maxscore_beside_sql(spark, sf_dir):
    con = check.duck(sf_dir)
    name = "op2_maxscore_search"
    ok, note, *_ = check.compare(spark, con, sf_dir, queries.queries()[name], queries.oracle_sql()[name])
    assert ok, note


def odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(2)], "x") for i in range(1, 400)]
    rows += [(i, [0.5] * 8, "tie") for i in range(400, 460)]
    rows += [(0, None, None), (460, [None] * 8, "x"), (500, [float("nan")] * 8, "x"), (520, [0.0] * 8, "x"), (540, [], "x"), (None, [1.0] * 8, "x"), (401, [0.5] * 8, "again")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")


def plain(table, every, k, zero, score):
    rows = []
    for r in table.collect():
        e = r.embedding
        if r.vec_id is not None and e and all(x is not None and np.isfinite(x) for x in e) and (zero or any(e)):
            rows.append((r.vec_id, np.array(e, float)))
    out = {}
    for q, v in {q: v for q, v in reversed(rows) if q % every == 0}.items():
        best = sorted(((-score(v, w), i) for i, w in rows if i != q))[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect()):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_maxscore_of_odd_rows(spark):
    table = odd_vectors(spark)
    want = plain(table, 50, 5, True, lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b)))
    assert by_query(maxscore.top_k(table)) == want
    assert maxscore.top_k(table.limit(0)).count() == 0


def test_projections_of_odd_rows(spark):
    table = odd_vectors(spark)
    want = plain(table, 20, 20, False, lambda a, b: float((a * b).sum()))
    got = by_query(projections.nearest(table, sure=0.999999))
    assert got.keys() == want.keys()
    hit = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hit) > 0.98
    for q in want:
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert projections.nearest(table.limit(0)).count() == 0


def test_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = plain(table, 20, 20, False, lambda a, b: float((a * b).sum()))
    got = by_query(queries.queries()["op4_stable_projection_search"](spark, sf_dir))
    hit = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert np.mean(hit) / 20 >= 0.9 and got.keys() == want.keys()
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(s == pytest.approx(exact[q, i], abs=1e-12) for q in got for i, s in got[q] if (q, i) in exact)


def test_chi_square():
    assert projections.chi_square(projections.needed_ratio(0.95, 12), 12) == pytest.approx(0.95)
    assert projections.needed_ratio(0.95, 2) == pytest.approx(5.991, abs=1e-3)
