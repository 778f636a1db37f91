"""The stored lexical index with every split of light and heavy words."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.functions.text import ACTION_HINTS, QUESTION_STOPWORDS
from evidex.operators import lexical, lexical_index as li


def plain_search(questions, windows, k):
    def words(text):
        out = set()
        for t in set(re.findall("[a-z0-9]+", (text or "").lower())):
            out.add(t)
            if t.endswith("ing") and len(t) > 5:
                out.add(t[:-3])
                if len(t) > 5 and t[-4] == t[-5]:
                    out.add(t[:-4])
            if t.endswith("ed") and len(t) > 4:
                out.add(t[:-2])
        return out

    found = set()
    for query, question in questions:
        terms = {t for t in re.findall("[a-z0-9]+", question) if len(t) > 2 and t not in QUESTION_STOPWORDS}
        scored = []
        for window, video, names, description, objects in windows:
            a, d, o = (terms & words(x) for x in (" ".join(names), description, " ".join(objects)))
            hits = 2 * len(a) + len(d) + 0.5 * len(o)
            if hits and (a or not terms & set(ACTION_HINTS)):
                scored.append((-hits / max(1, 2 * len(terms)), window, video))
        per, rank = Counter(), 0
        for score, window, video in sorted(scored):
            per[video] += 1
            if per[video] <= 2 and rank < k:
                rank += 1
                found.add((query, rank, window, video, round(-score, 4)))
    return found


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(21)
    # Words of very uneven frequency, the first in nearly every window.
    vocabulary = ["common", "plain", "opening", "sitting", "door"] + [f"word{i}" for i in range(60)]
    pick = lambda n: [vocabulary[min(int(rng.expovariate(0.12)), len(vocabulary) - 1)] for _ in range(n)]
    windows = [
        (f"w{i:04}", f"v{i % 7 if i % 3 else 0}", pick(rng.randint(0, 3)), None if i % 19 == 0 else "Common " + " ".join(pick(rng.randint(0, 6))), pick(rng.randint(0, 2)))
        for i in range(400)
    ]
    questions = [(f"q{i}", "When did the person " + " ".join(pick(rng.randint(0, 5)))) for i in range(40)] + [("none", "nothing at all here"), ("empty", "")]
    frames = (
        spark.createDataFrame(questions, "query_id string, question string"),
        spark.createDataFrame(windows, "window_id string, video_id string, action_names array<string>, description string, objects array<string>").repartition(5),
    )
    return questions, windows, frames


@pytest.mark.parametrize("heavy, block, per_pass", [(10_000, 200_000, 4096), (100, 200_000, 4096), (30, 50, 7), (0, 100, 4096)])
def test_every_split_gives_the_same_rows(spark, corpus, monkeypatch, heavy, block, per_pass):
    questions, windows, (asked, rows) = corpus
    monkeypatch.setattr(li, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(li, "PASS_QUESTIONS", per_pass)
    for k in (3, 8):
        found = [tuple(r) for r in lexical.lexical_search(asked, rows, k, heavy=heavy).collect()]
        assert len(found) == len(set(found)) and set(found) == plain_search(questions, windows, k)


def test_heavy_words_make_no_row_per_question_and_window(spark, corpus, tmp_path):
    _, windows, (_, rows) = corpus
    path = str(tmp_path / "index")
    li.store_index(rows, path, heavy=150)
    assert "common" in {r.term for r in spark.read.parquet(f"{path}/heavy").collect()}
    asked = spark.range(300).select(F.concat(F.lit("q"), "id").alias("query_id"), F.lit("common").alias("question"))
    found = li.search_index(spark, path, asked, 2)
    assert found.count() == 600
    # What reaches the merge: at most two rows of two recordings per question and block.
    words = asked.select("query_id", F.lit(1).alias("_n"), F.lit(False).alias("_hint"), F.col("question").alias("term"), F.lit(True).alias("_heavy"))
    none = spark.createDataFrame([], li.FOUND)
    assert li._heavy_pass(li._postings(spark, path), words, none, 2, 3).count() <= 300 * 4 * 3 < 300 * sum(bool(w[3]) for w in windows)


def test_what_a_block_keeps_is_enough():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, k = 60, int(rng.integers(1, 5))
        score, video = rng.integers(0, 5, n) / 2, rng.integers(0, 5, n).astype(object)
        part = rng.integers(0, 3, n)

        def best(rows):
            per, out = defaultdict(int), []
            for i in sorted(rows, key=lambda i: (-score[i], i)):
                per[video[i]] += 1
                if score[i] > 0 and per[video[i]] <= 2 and len(out) < k:
                    out.append(i)
            return out

        kept = []
        for p in range(3):
            own = np.flatnonzero(part == p)
            kept += own[li.best_of_block(score[own], own, video[own], k)].tolist()
        assert best(kept) == best(range(n))
