"""Labels of all recordings by words in common, beside brute force."""

import random

import pytest

from evidex.operators import lexical

WORDS = [f"w{i}" for i in range(30)]
GENERAL = ["g0", "g1", "g2"]


@pytest.mark.parametrize("seed", [1, 2])
def test_best_labels(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: list(dict.fromkeys([*rng.sample(GENERAL, rng.randint(0, 3)), *[WORDS[min(int(rng.expovariate(0.25)), 29)] for _ in range(n)]]))
    labels = [(f"label {i:03}", pick(rng.randint(0, 4))) for i in range(150)]
    asked = []
    for i in range(120):
        q = pick(rng.randint(0, 5)) if i % 6 else rng.sample(GENERAL, rng.randint(0, 3))
        asked.append((f"q{i}", q + (["unknown"] if i % 5 == 0 else []), [t for t in q if t not in GENERAL] + (["unknown"] if i % 5 == 0 else [])))
    found = lexical.best_labels(
        spark.createDataFrame(asked, "query_id string, _q array<string>, _distinct array<string>"), spark.createDataFrame(labels, "label string, _l array<string>")
    )
    got = {r.query_id: (r._best, r._tied) for r in found.collect()}
    for query, q, distinct in asked:
        share = {name: len(set(q) & set(l)) / max(1, len(q)) for name, l in labels if not distinct or set(distinct) & set(l)}
        best = max(share.values(), default=0)
        if best == 0:
            assert query not in got
            continue
        tied = sorted(name for name, s in share.items() if s == best)
        assert got[query] == (best, tied if len(tied) == 1 or best >= 0.5 else [])
