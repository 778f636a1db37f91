"""Distributed operators against plain restatements on random small inputs."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidex.operators import blocks, joins, objects as ob, places as pl, quantiles as qt, ranking as rk, scan, search, windows as win


def iou(a, b):
    hull = max(a[1], b[1]) - min(a[0], b[0])
    return max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / hull if hull > 0 else 0.0


def ranked_rows(rng, queries=40, rows=24):
    out = []
    for q in range(queries):
        for rank in range(1, rows + 1):
            start = float(rng.randrange(0, 20))
            out.append((f"q{q}", rank, f"q{q}w{rank}", f"v{rng.randrange(3)}", start, start + rng.choice([2.0, 4.0, 7.0]), round(1 - rank / 100, 4)))
    return out


RANKED = "query_id string, rank int, window_id string, video_id string, start_s double, end_s double, score double"


@pytest.mark.parametrize("per_video", [1, 2, 3])
def test_diversify(spark, per_video):
    rows = ranked_rows(random.Random(per_video))
    got = {}
    for r in rk.diversify_by_interval(spark.createDataFrame(rows, RANKED), 5, per_video, 0.25).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.window_id))
    for q in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: r[1]):
            mine = [k for k in kept if k[3] == r[3]]
            if len(mine) < per_video and all(iou(r[4:6], k[4:6]) < 0.25 for k in mine):
                kept.append(r)
        assert sorted(got[q]) == [(i + 1, k[2]) for i, k in enumerate(kept[:5])]


def test_merge_events(spark):
    rng = random.Random(5)
    rows = []
    for r in ranked_rows(rng, 40, 20):
        ids = sorted(rng.sample(["a", "b", "c", "d", "e", "f", "g"], rng.randrange(0, 2)))
        shift = rng.choice([None, 0.5])
        rows.append((*r, None if shift is None else r[4] + shift, None if shift is None else r[5] - shift, [(i, f"N{i}", 0.0, 1.0) for i in ids], rng.sample(["x", "y", "z"], 2)))
    schema = RANKED + ", predicted_start_s double, predicted_end_s double, actions array<struct<action_id:string,name:string,start_s:double,end_s:double>>, objects array<string>"
    got = {}
    for r in rk.merge_events(spark.createDataFrame(rows, schema), 4).collect():
        got.setdefault(r.query_id, {})[r.event_rank] = (r.start_s, r.end_s, r.context_start_s, r.context_end_s, r.score, tuple(r.evidence_window_ids), tuple(r.objects), tuple(a.action_id for a in r.actions))
    for q in {r[0] for r in rows}:
        events = []
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: r[1]):
            span = (r[7], r[8]) if r[7] is not None and r[8] > r[7] else (r[4], r[5])
            ids = {a[0] for a in r[9]}
            home = next((e for e in events if e["v"] == r[3] and (iou(span, e["s"]) >= 0.25 or ids & e["ids"])), None)
            if home is None:
                events.append({"v": r[3], "s": span, "c": (r[4], r[5]), "score": r[6], "w": [r[2]], "ids": ids, "o": set(r[10]), "a": [a[0] for a in r[9]]})
                continue
            home["s"] = (min(home["s"][0], span[0]), max(home["s"][1], span[1]))
            home["c"] = (min(home["c"][0], r[4]), max(home["c"][1], r[5]))
            home["score"] = max(home["score"], r[6])
            home["w"].append(r[2])
            home["ids"] |= ids
            home["o"] |= set(r[10])
            home["a"] += [a[0] for a in r[9] if a[0] not in home["a"]]
        events.sort(key=lambda e: -e["score"])
        want = {i + 1: (*e["s"], *e["c"], e["score"], tuple(e["w"]), tuple(sorted(e["o"])), tuple(e["a"])) for i, e in enumerate(events[:4])}
        assert got[q] == want


def test_diversify_by_sequence(spark):
    rng = random.Random(8)
    rows = [(f"q{q}", rank, f"s{rng.randrange(rng.choice([1, 3, 8]))}", rng.randrange(120)) for q in range(60) for rank in range(1, 31)]
    got = {}
    for r in rk.diversify_by_sequence(spark.createDataFrame(rows, "query_id string, rank int, sequence_id string, step long"), 10).collect():
        got.setdefault(r.query_id, {})[r.display_rank] = (r.rank, r.kind)
    for q in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: r[1])
        chosen = []
        for level in (1, 2, 3):
            for r in mine:
                if len(chosen) >= 10 or any(r is c[0] for c in chosen):
                    continue
                same = [c[0] for c in chosen if c[0][2] == r[2]]
                if level < 3 and len(same) >= 2:
                    continue
                if level == 1 and any(abs(r[3] - s[3]) < 20 for s in same):
                    continue
                kind = "best visual match" if not chosen else "same area, another traversal" if r[2] != chosen[0][0][2] else "related office view" if level == 1 else "additional view"
                chosen.append((r, kind))
        assert got[q] == {i + 1: (c[0][1], c[1]) for i, c in enumerate(chosen)}


@pytest.mark.parametrize("fold_rows", [3, 512])
def test_class_nms(spark, fold_rows):
    rng = random.Random(fold_rows)
    rows = []
    for f in range(6):
        for i in range(80 if f == 0 else 12):
            x, y = rng.randrange(0, 40), rng.randrange(0, 20)
            rows.append((f"f{f}", i, rng.choice(["chair", "box"]), rng.randrange(100) / 100, [float(x), float(y), x + 12.0, y + 12.0]))
    df = spark.createDataFrame(rows, "frame_id string, src int, canonical_class string, score double, box array<double>")
    kept = ob.class_nms(df, "frame_id", [F.col("score").desc(), F.col("src")], fold_rows=fold_rows)
    got = {}
    for r in kept.collect():
        got.setdefault(r.frame_id, {})[r["rank"]] = r.src

    def box_iou(a, b):
        inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return inter / (288 - inter)

    for f in {r[0] for r in rows}:
        want = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[3], r[1])):
            if len(want) < 20 and all(r[2] != k[2] or box_iou(r[4], k[4]) <= 0.5 for k in want):
                want.append(r)
        assert got[f] == {i + 1: k[1] for i, k in enumerate(want)}


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_keyframes_by_motion(spark, chunk):
    rng = random.Random(3)
    rows, eye = [], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    for s in range(4):
        place = [0.0, 0.0, 0.0]
        for step in range(90 if s == 0 else 20):
            place = [p + rng.uniform(-0.2, 0.3) for p in place]
            rows.append((f"s{s}", step, list(place), eye))
    df = spark.createDataFrame(rows, "sequence_id string, step long, translation array<double>, rotation array<double>")
    got = sorted((r.sequence_id, r.step) for r in pl.keyframes_by_motion(df, "sequence_id", "step", chunk_steps=chunk).collect())
    want, last = [], {}
    for s, step, t, _ in rows:
        if s not in last or math.dist(t, last[s]) >= 0.5:
            want.append((s, step))
            last[s] = t
    assert got == sorted(want)


@pytest.mark.parametrize("limit", [0, 10_000])
@pytest.mark.parametrize("scoped, presample", [(False, 0.0), (True, 0.0), (False, 0.3), (True, 0.5)])
def test_topk_by_broadcast_and_by_grid(spark, limit, scoped, presample, monkeypatch):
    monkeypatch.setattr(blocks, "QUERY_BLOCK_ROWS", 16)
    monkeypatch.setattr(blocks, "MEMORY_BLOCK_ROWS", 50)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    vectors = base[rng.integers(0, 60, 220)]  # many exact ties
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    scope = [f"s{int(x)}" for x in rng.integers(0, 3, 220)]
    memory = spark.createDataFrame([(i, v.tolist(), s) for i, (v, s) in enumerate(zip(vectors, scope))], "ord long, vector array<double>, scope string").repartition(5)
    queries = memory.select(F.col("ord").cast("string").alias("query_id"), F.col("ord").alias("q_ord"), "vector", F.when(F.col("ord") % 2 == 0, F.col("scope")).alias("q_scope"))
    got = {}
    for r in search.cosine_topk(queries, memory, 6, exclude_self=True, scoped=scoped, presample=presample, max_broadcast_rows=limit).collect():
        got.setdefault(int(r.query_id), {})[r["rank"]] = r.ord
    scores = np.round(vectors @ vectors.T, 9)
    for q in range(220):
        rows = [m for m in range(220) if m != q and (not scoped or q % 2 or scope[m] == scope[q])]
        want = sorted(rows, key=lambda m: (-scores[q, m], m))[:6]
        assert got[q] == {i + 1: m for i, m in enumerate(want)}


def test_rows_of_other_scopes_are_never_scored(spark):
    """Vectors of the scopes have different lengths, so a product across scopes would fail."""
    memory = spark.createDataFrame([(i, [1.0] * (2 + i % 5), f"s{i % 5}") for i in range(50)], "ord long, vector array<double>, scope string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", [1.0] * (2 + i % 5), f"s{i % 5}") for i in range(10)] + [("none", [1.0], "gone")], "query_id string, vector array<double>, q_scope string")
    found = search.cosine_topk(queries, memory, 3, scoped=True).collect()
    assert sorted((r.query_id, r.ord) for r in found) == sorted((f"q{i}", i % 5 + 5 * j) for i in range(10) for j in range(3))


@pytest.mark.parametrize("block_rows", [5, 2048])
def test_association_blocks(spark, block_rows):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(90):
        lost = i % 7 == 0
        c = [None] * 3 if lost else rng.normal(size=3).tolist()
        rows.append((f"d{i}", i, int(rng.integers(0, 3)), "chair" if i % 3 else "box", rng.normal(size=4).tolist(), float(rng.uniform(0.2, 0.9)), float(rng.uniform(0.01, 0.4)), *c))
    df = spark.createDataFrame(rows, "detection_id string, ord long, observation long, object_class string, vector array<double>, quality double, mask_area_fraction double, cx double, cy double, cz double")
    pairs, totals = ob.associate(df, 15, block_rows)
    got = {}
    for r in pairs.collect():
        got.setdefault((r.earlier_observation, r.later_observation, r.object_class), {})[r["rank"]] = (r.earlier_ord, r.later_ord, r.association_score)
    counts = {(r.earlier_observation, r.later_observation, r.object_class): r.pair_count for r in totals.collect()}
    unit = {r[1]: np.array(r[4]) / np.linalg.norm(r[4]) for r in rows}
    want = {}
    for a in rows:
        for b in rows:
            if a[3] == b[3] and a[2] < b[2]:
                position = 0.5 if a[7] is None or b[7] is None else math.exp(-math.dist(a[7:], b[7:]) / 2)
                score = 0.55 * (unit[a[1]] @ unit[b[1]] + 1) / 2 + 0.15 * math.exp(-abs(math.log(a[6] / b[6]))) + 0.15 * (a[5] + b[5]) / 2 + 0.15 * position
                want.setdefault((a[2], b[2], a[3]), []).append((a[1], b[1], score))
    assert counts == {k: len(v) for k, v in want.items()}
    for key, values in want.items():
        best = sorted(values, key=lambda v: (-round(v[2], 9), v[0], v[1]))[:15]
        assert [(g[0], g[1]) for _, g in sorted(got[key].items())] == [(v[0], v[1]) for v in best]


def test_running_aggregates_and_islands(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, float(rng.randrange(0, 400)), 0.0) for i in range(300)]
    rows = [(k, i, s, s + rng.choice([1.0, 5.0, 60.0])) for k, i, s, _ in rows]
    df = spark.createDataFrame(rows, "k string, i long, s double, e double")
    order = [F.col("s"), F.col("e"), F.col("i")]
    got = {r.i: r.island for r in scan.islands(df, ["k"], "s", "e", order, 0.5, 16.0).collect()}
    places = {r.i: r.ordinal for r in scan.ordinal(df, ["k"], order, F.floor(F.col("s") / 16)).collect()}
    for key in "ab":
        reach, island = -1.0, 0
        for place, (_, i, s, e) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[3], r[1]))):
            if reach < 0 or s > reach + 0.5:
                island += 1
            reach = max(reach, e)
            assert got[i] == island and places[i] == place


def test_quantiles(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"k": rng.integers(0, 4, 500), "v": np.round(rng.exponential(2.0, 500), 2)})
    got = {r.k: (r.a, r.b) for r in qt.exact_quantiles(spark.createDataFrame(frame), ["k"], "v", {"a": 0.5, "b": 0.9}, 0.25).collect()}
    for key, part in frame.groupby("k"):
        assert got[key] == pytest.approx(tuple(np.percentile(part["v"], [50, 90])))


def test_interval_join_counts_each_pair_once(spark):
    rng = random.Random(7)
    span = lambda: (lambda s: (s, s + rng.choice([0.5, 3.0, 40.0])))(rng.uniform(0, 100))
    left = [(rng.choice("ab"), i, *span()) for i in range(60)]
    right = [(rng.choice("ab"), i, *span()) for i in range(60)]
    a = spark.createDataFrame(left, "k string, i int, s double, e double")
    b = spark.createDataFrame(right, "k string, j int, s2 double, e2 double")
    got = sorted((r.i, r.j) for r in joins.interval_join(a, b, "k", ("s", "e"), ("s2", "e2"), 8.0).collect())
    assert got == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[3] > y[2] and x[2] < y[3])


def test_grid_neighbours_find_every_close_pair(spark):
    rng = np.random.default_rng(9)
    points = rng.uniform(-2, 2, size=(120, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "i int, p array<double>")
    other = df.select(F.col("i").alias("j"), F.col("p").alias("r"))
    rows = joins.grid_neighbours(df, other, "p", "r", 0.5).collect()
    near = sorted((r.i, r.j) for r in rows if math.dist(r.p, r.r) <= 0.5)
    assert near == sorted((i, j) for i in range(120) for j in range(120) if math.dist(points[i], points[j]) <= 0.5)


def test_nearest_and_forward_frames(spark):
    rng = random.Random(11)
    frames = {k: sorted({round(rng.uniform(0, 300), 1) for _ in range(40)}) for k in "ab"}
    targets = [(k, round(rng.uniform(-5, 320), 1)) for k in "ab" for _ in range(80)]
    targets = list(dict.fromkeys(targets))
    f = spark.createDataFrame([(k, t) for k, ts in frames.items() for t in ts], "k string, frame_s double")
    t = spark.createDataFrame(targets, "k string, target_s double")
    near = {(r.k, r.target_s): r.frame_s for r in win.nearest_frame(t, f, "k", 16.0).collect()}
    ahead = {(r.k, r.target_s): (r.frame_s, r.padded) for r in win.forward_frame(t, f, "k", 16.0).collect()}
    for k, x in targets:
        assert abs(near[k, x] - x) == min(abs(v - x) for v in frames[k])
        later = [v for v in frames[k] if v >= x]
        assert ahead[k, x] == ((later[0], False) if later else (frames[k][-1], True))


def test_even_sample(spark):
    rows = [(k, i) for k, n in (("a", 1), ("b", 5), ("c", 37)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long")
    got = {}
    for r in win.even_sample(df, ["k"], [F.col("i")], F.floor(F.col("i") / 10), 8).collect():
        got.setdefault(r.k, []).append(r.i)
    for k, n in (("a", 1), ("b", 5), ("c", 37)):
        assert sorted(got[k]) == sorted(set(np.rint(np.linspace(0, n - 1, min(n, 8))).astype(int).tolist()))


def test_exact_mean_in_any_order(spark):
    from evidex.operators.evaluation import exact_mean

    for values in ([1e14, 0.3, -1e14, 0.3, None], [0.3, 0.3, 1e14, -1e14, None]):
        rows = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
        assert float(rows.agg(exact_mean("x").alias("m")).first().m) == 0.15
