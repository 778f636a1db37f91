"""The pipeline's stages, each held against plain Python on its own input."""

import hashlib
from collections import Counter

import corpus_pipeline
from evidex.llm import quality
from evidex.llm.common import table, tokenizer_dir
from test_text_operators import plain_components, plain_encoding, plain_fingerprint, plain_spans


def test_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    out = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame((made := stage(spark, docs, sf_dir)).collect(), made.schema)
        out.append((name, before, docs.collect()))
        assert name == "bpe" or docs.columns == columns
    (_, first, good), (_, _, single), (_, _, clean), (_, _, mixed), (_, _, encoded) = out

    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = model.scorer()([r.text for r in first])
    assert Counter(good) == Counter(r for r, s in zip(first, score) if s >= 0.3)

    group = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in good])
    assert Counter(single) == Counter(r for r in good if group[r.doc_id] == r.doc_id)

    assert [r.doc_id for r in sorted(clean)] == [r.doc_id for r in sorted(single)]
    texts = {r.doc_id: r.text for r in single}
    assert not any(plain_spans(r.text) for r in clean)
    assert all(r.text == texts[r.doc_id] for r in clean if "[SECRET]" not in r.text)

    copies = Counter(r.doc_id for r in mixed)
    assert set(mixed) <= set(clean) and max(copies.values()) <= 3

    tokenizer = Tokenizer.from_file(f"{tokenizer_dir()}/word_bpe_49k.json")
    want = Counter()
    for r in mixed:
        ids, decoded = plain_encoding(r.text, tokenizer)
        want[(r.doc_id, tuple(ids), hashlib.sha256(decoded.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in encoded) == want


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and rows.count() > 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
