"""The dealt operators bound to the test tables, with reference SQL where SQL can say the same."""

from __future__ import annotations

from evidex.llm import (
    alignment, bpe, divergence, licenses, maxscore, mixing, passages, projections, quality, secrets, simhash, toxicity, warc,
)
from evidex.llm.common import table, tokenizer_dir

QUERIES = {}
ORACLES = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_maxscore_search(spark, sf_dir):
    return maxscore.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op2_maxscore_search"] = maxscore.ORACLE


@query
def op3_quality_classifier(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_stable_projection_search(spark, sf_dir):
    return projections.nearest(table(spark, sf_dir, "embeddings"))


@query
def op5_compact_window_passages(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op6_license_scan(spark, sf_dir):
    return licenses.license_spans(table(spark, sf_dir, "documents"))


@query
def op7_bpe_round_trip(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"), f"{tokenizer_dir()}/word_bpe_49k.json")


@query
def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query
def op9_secret_scan(spark, sf_dir):
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


@query
def op10_entropy_balanced_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op11_token_alignment(spark, sf_dir):
    vocabularies = (f"{tokenizer_dir()}/{name}" for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_documents(table(spark, sf_dir, "documents"), *vocabularies)


@query
def op12_warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op12_warc_round_trip"] = warc.ORACLE


@query
def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = divergence.ORACLE


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
