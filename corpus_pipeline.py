"""A training-data pipeline: five of the operators of ``evidex.llm`` in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` writes every stage's rows to the shared folder and reads them
back as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.llm import bpe, mixing, quality, secrets, simhash
from evidex.llm.common import table, tokenizer_dir
from evidex.operators.joins import grown
from evidex.session import cut_lineage


def keep_quality(spark, docs, sf_dir):
    """Documents that the quality classifier accepts; it is fitted on the labelled ones of them.
    Scoring passes whole rows through, so nothing is joined back."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).where("predicted = 1").select(*docs.columns)


def drop_near_copies(spark, docs, sf_dir):
    """The document of smallest id of every group of near copies.  A row without an id stays."""
    found = simhash.components_of(simhash.fingerprint_table(docs.where("doc_id is not null")))
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    # Both by doc_id, as ``dropDuplicates`` needs them anyway; the ids grow with the documents.
    first = grown(docs.where("doc_id is not null")).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def redact_secrets(spark, docs, sf_dir):
    """Credentials in the texts give way to a mark; every row stays."""
    redacted = secrets.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """Each document as many times (0 to 3) as the mix of its source takes it."""
    return mixing.mixed_documents(docs)


def encode(spark, docs, sf_dir):
    """doc_id, n_tokens, digests, ids and decoded text of every row."""
    return bpe.encode_documents(docs, f"{tokenizer_dir()}/word_bpe_49k.json", full=True).select(
        "doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("near copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("bpe", encode),
]
ORACLE_SQL = None  # the classifier has no SQL form; tests/llm holds run() against plain Python


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = cut_lineage(docs, f"stage-{at}")
    return docs
