"""A stored inverted index of windows, searched with frequent words in blocks.

Words of few windows (light) meet the words of questions by an equality join.  A word of many windows
(heavy) would make a row for every question and window that hold it; its postings are dealt into
blocks of windows instead, a task scores all questions against its block at once, together with the
light hits of the block, and only the best rows of each question leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from evidex.functions.text import ACTION_HINTS, question_terms, strings, token_variants, tokens
from evidex.session import cut_lineage

MAX_PER_VIDEO = 2
HEAVY_POSTINGS = 10_000  # postings above which a word is heavy
BLOCK_POSTINGS = 200_000  # heavy postings of a block, about
PASS_QUESTIONS = 4096  # questions that are sent to every task at once
ACTION_WEIGHT, DESCRIPTION_WEIGHT, OBJECT_WEIGHT = 2.0, 1.0, 0.5
POSTING = "term string, window_id string, video_id string, weight double"
FOUND = "query_id string, window_id string, video_id string, hits double, action int"


def _words(names: Column) -> Column:
    return token_variants(tokens(F.lower(F.array_join(names, " "))))


def _qualified(term: Column, within: str | None) -> Column:
    """A word of one value of ``within``; null where the value is."""
    return F.concat(F.col(within).cast("string"), F.lit("\x1f"), term) if within else term


def store_index(windows: DataFrame, path: str, within: str | None = None, heavy: int = HEAVY_POSTINGS) -> None:
    """Write the postings of ``windows`` (window_id, video_id, action_names, description, objects) and the
    heavy words with their number of postings.  A word is a posting once per field that holds it."""
    fields = (
        (_words(F.col("action_names")), ACTION_WEIGHT), (token_variants(tokens(F.lower("description"))), DESCRIPTION_WEIGHT),
        (_words(F.col("objects")), OBJECT_WEIGHT),
    )
    empty = F.array().cast("array<struct<t:string,w:double>>")
    weighted = F.concat(*[F.coalesce(F.transform(x, lambda t: F.struct(t.alias("t"), F.lit(w).alias("w"))), empty) for x, w in fields])
    keys = list(dict.fromkeys(["window_id", "video_id", *([within] if within else [])]))
    rows = windows.select(*keys, F.explode(weighted).alias("_p")).select(
        _qualified(F.col("_p.t"), within).alias("term"), "window_id", "video_id", F.col("_p.w").alias("weight")
    )
    rows.where("term is not null").write.option("compression", "zstd").parquet(f"{path}/postings")
    stored = _postings(windows.sparkSession, path)
    stored.groupBy("term").agg(F.count("*").alias("postings")).where(F.col("postings") > heavy).write.parquet(f"{path}/heavy")


def _postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTING).parquet(f"{path}/postings")


def search_index(spark: SparkSession, path: str, questions: DataFrame, k: int = 8, within: str | None = None) -> DataFrame:
    """Best windows per question (query_id, question): rank, window_id, video_id, score.

    A hit counts 2 in an action, 1 in the description and 0.5 in an object; a question with a hint of an
    action needs an action hit; a recording gives at most two windows; ties go to the smaller id."""
    heavy = spark.read.schema("term string, postings long").parquet(f"{path}/heavy")
    terms = question_terms(F.col("question"))
    asked = questions.select(
        F.col("query_id").cast("string").alias("query_id"), F.size(terms).alias("_n"), F.arrays_overlap(terms, strings(ACTION_HINTS)).alias("_hint"),
        F.explode(F.transform(terms, lambda t: _qualified(t, within))).alias("term"),
    ).where("term is not null").join(heavy.select("term", F.lit(True).alias("_heavy")), "term", "left")
    asked = cut_lineage(asked.withColumn("_heavy", F.coalesce("_heavy", F.lit(False))), "asked-words")
    questions_of = asked.groupBy("query_id", "_n", "_hint").agg(F.max("_heavy").alias("_mixed"))
    light = (
        _postings(spark, path).join(asked.where("not _heavy").select("query_id", "term"), "term")
        .groupBy("query_id", "window_id", "video_id")
        .agg(F.sum("weight").alias("hits"), F.max((F.col("weight") == ACTION_WEIGHT).cast("int")).alias("action"))
    )
    light = light.join(questions_of, "query_id")
    score = (F.col("hits") / F.greatest(F.lit(1.0), F.lit(2.0) * F.col("_n"))).alias("_score")
    whole = light.where("not _mixed").where(~F.col("_hint") | (F.col("action") == 1))
    found = whole.select("query_id", "window_id", "video_id", score)
    passes = -(-questions_of.where("_mixed").count() // PASS_QUESTIONS)
    if passes:
        blocks = max(1, -(-(heavy.agg(F.sum("postings")).first()[0] or 0) // BLOCK_POSTINGS))
        mixed = light.where("_mixed").select("query_id", "window_id", "video_id", "hits", "action")
        mixed = cut_lineage(mixed, "light-hits") if passes > 1 else mixed
        for turn in range(passes):
            own = F.pmod(F.xxhash64("query_id"), F.lit(passes)) == turn
            found = found.unionByName(_heavy_pass(_postings(spark, path), asked.where(own), mixed.where(own), k, blocks))
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = [F.col("_score").desc(), F.col("window_id")]
    place = F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return (
        found.withColumn("_place", place).filter(F.col("_place") <= MAX_PER_VIDEO)
        .withColumn("rank", rank).filter(F.col("rank") <= k)
        .select("query_id", "rank", "window_id", "video_id", F.round("_score", 4).alias("score"))
    )


def best_of_block(score: np.ndarray, windows: np.ndarray, videos: np.ndarray, k: int) -> np.ndarray:
    """The rows of a block that can still be among the ``k`` best of a question: at most two per recording,
    of the ``k`` recordings with the best rows.  ``windows`` are ascending.

    A row outside them has ``k`` recordings with a better row before it, wherever their other rows are."""
    order = np.argsort(-score, kind="stable")
    order = order[score[order] > 0]
    kept, seen = [], {}
    for at in order.tolist():
        video = videos[at]
        if video not in seen and len(seen) == k:
            continue
        seen[video] = seen.get(video, 0) + 1
        if seen[video] <= MAX_PER_VIDEO:
            kept.append(at)
        if len(kept) == MAX_PER_VIDEO * k:
            break
    return np.array(kept, np.int64)


def _heavy_pass(postings: DataFrame, asked: DataFrame, light: DataFrame, k: int, blocks: int) -> DataFrame:
    """Best rows of the questions of one pass that have heavy words, block by block."""
    spark = postings.sparkSession
    words = asked.where("_heavy").select("query_id", "_n", "_hint", "term").collect()  # of at most about PASS_QUESTIONS questions
    number = {q: i for i, q in enumerate(sorted({r["query_id"] for r in words}))}
    column = {t: i for i, t in enumerate(sorted({r["term"] for r in words}))}
    wants = np.zeros((len(column), len(number)))
    size, hint = np.ones(len(number)), np.zeros(len(number), bool)
    for r in words:
        at = number[r["query_id"]]
        wants[column[r["term"]], at] = 1
        size[at], hint[at] = max(1.0, 2.0 * r["_n"]), r["_hint"]
    shared = spark.sparkContext.broadcast((list(number), number, column, wants, size, hint))
    needed = F.broadcast(spark.createDataFrame([(t,) for t in column], "term string")) if column else None
    if needed is None:
        return spark.createDataFrame([], "query_id string, window_id string, video_id string, _score double")
    block = F.pmod(F.xxhash64("window_id"), F.lit(blocks)).alias("block")
    left = postings.join(needed, "term").select(block, "term", "window_id", "video_id", "weight")
    right = light.select(block.alias("at"), "query_id", "window_id", "video_id", "hits", "action")
    schema = "query_id string, window_id string, video_id string, _score double"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(heavy: pa.Table, light: pa.Table) -> pa.Table:
        names, number, column, wants, size, hint = shared.value
        joined = lambda name: pa.concat_arrays([*heavy[name].chunks, *light[name].chunks]).dictionary_encode()
        ids, of_video = joined("window_id"), joined("video_id")
        names_of = np.array(ids.dictionary.to_pylist(), object)
        order = np.argsort(names_of, kind="stable")
        windows, place = names_of[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[ids.indices.to_numpy()]
        videos = np.empty(len(windows), object)
        videos[at] = np.array(of_video.dictionary.to_pylist(), object)[of_video.indices.to_numpy()]
        weight, acts = np.zeros((len(windows), len(column))), np.zeros((len(windows), len(column)))
        numbers = lambda values, known: np.array([known[x] for x in values.dictionary.to_pylist()], np.int64)[values.indices.to_numpy()]
        encoded = lambda column: pa.concat_arrays(column.chunks or [pa.array([], column.type)]).dictionary_encode()
        own = (at[: len(heavy)], numbers(encoded(heavy["term"]), column))
        given = heavy["weight"].to_numpy()
        np.add.at(weight, own, given)
        np.add.at(acts, own, given == ACTION_WEIGHT)
        hits, action = weight @ wants, acts @ wants
        other = (at[len(heavy) :], numbers(encoded(light["query_id"]), number))
        np.add.at(hits, other, light["hits"].to_numpy())
        np.add.at(action, other, light["action"].to_numpy())
        score = np.where(hint[None, :] & (action == 0), 0.0, hits / size[None, :])
        out = []
        for q in range(len(names)):
            for i in best_of_block(score[:, q], windows, videos, k).tolist():
                out.append((names[q], windows[i], videos[i], float(score[i, q])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)] if out else [pa.array([], f.type) for f in arrow], schema=arrow)

    return left.groupBy("block").cogroup(right.groupBy("at")).applyInArrow(run, schema)
