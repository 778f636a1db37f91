"""Labels are found in rounds of growing distance."""

import math

import numpy as np

from evidex.operators import places


def gap(a, b):
    cosine = (float(np.dot(a[2], b[2])) - 1) / 2
    return float(np.linalg.norm(np.subtract(a[1], b[1]))), float(np.degrees(np.arccos(np.clip(cosine, -1, 1))))


def test_labels_found_in_rounds_are_those_of_the_least_cost(spark, monkeypatch):
    """Near, far, tied and turned representatives, so that every round settles some records; as few pairs as a tenth."""
    turn = lambda a: [math.cos(a), -math.sin(a), 0.0, math.sin(a), math.cos(a), 0.0, 0.0, 0.0, 1.0]
    point = lambda n, spread: [spread * ((n * 7919 % 1009) / 1009 + (n % 5)), spread * (n * 104729 % 997) / 997, 0.3 * (n % 3)]
    rows = [(f"o{n}", point(n, 1.0), turn(n * 0.37 % 3), n) for n in range(600)]
    reps = [(f"r{n}", point(n + 3, 1.01), turn(n * 0.41 % 3), "unassigned" if n % 9 == 0 else f"zone-{n % 4}", n) for n in range(500)]
    reps += [(f"same{n}", *rows[n][1:3], f"tie-{i}", 1000 + n * 2 + i) for n in range(0, 600, 40) for i in (0, 1)]
    frame = spark.createDataFrame(rows, "observation_id string, translation array<double>, rotation array<double>, step long")
    given = spark.createDataFrame(reps, "observation_id string, translation array<double>, rotation array<double>, label string, rep_order long")
    whole = {r.observation_id: r.label for r in places.propagate_labels(frame, given).collect()}
    monkeypatch.setattr(places, "FEW_REPRESENTATIVES", 16)
    assert places._shares(500) == [0.5, 1.0] and places._shares(70_000) == [0.125, 0.25, 0.5, 1.0]
    monkeypatch.setattr(places, "_shares", lambda n: [0.0625, 0.125, 0.25, 0.5, 1.0])
    sizes, kept = [], places.pose_join
    monkeypatch.setattr(places, "pose_join", lambda left, *more: (sizes.append(left.count()), kept(left, *more))[1])
    assert {r.observation_id: r.label for r in places.propagate_labels(frame, given).collect()} == whole
    assert len(sizes) == 5 and sizes[0] == 600 > sizes[1] > sizes[-1]
    want = {}
    for r in rows:
        near = [(round((d / 0.5) ** 2 + (a / 45) ** 2, 9), m[4], m[3]) for m in reps if m[3] != "unassigned" for d, a in [gap(r, m)] if d <= 0.5 and a <= 45]
        want[r[0]] = min(near)[2] if near else "unassigned"
    assert whole == want
