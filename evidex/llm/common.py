"""Small helpers shared by the text operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """The fold of a document: crc32 of its id as text, mod ``folds``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def held_out(doc_id: str = "doc_id") -> Column:
    """Fold 0; a document without an id belongs to no fold."""
    return F.coalesce(remainder(doc_id) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_chars: int) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents outside fold 0.

    The sample is the ``rows`` labelled ids of smallest hash, so it is the same at every run.
    Texts over ``max_chars`` and null texts or labels are left out of it.  An id that occurs
    several times counts once, with its largest label and smallest text.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & (remainder() != 0))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # At most ``rows`` ids, so this side is bounded whatever the size of the tables.
    return (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("_y").alias("y"))
    )


def fit_in_task(sample: DataFrame, fit: Callable[[list[tuple[str, int]]], object]) -> object:
    """``fit`` of the bounded sample's (text, y), by id, run as one task; the model comes back."""

    def run(batches):
        found = [r for batch in batches for r in batch.to_pylist()]
        found.sort(key=lambda r: r["doc_id"])
        model = fit([(r["text"], r["y"]) for r in found])
        yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(model)], pa.binary())], ["model"])

    row = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return cloudpickle.loads(row["model"]) if row else fit([])


def map_batches(
    df: DataFrame,
    columns: Iterable[str],
    start: Callable[[], Callable[[pa.RecordBatch], dict[str, object] | None]],
    fields: str,
) -> DataFrame:
    """Replace the rows of each Arrow batch.

    ``start`` is called once per task and returns a function from a batch of ``columns`` to the
    columns named in ``fields`` (a DDL string); None gives no rows.
    """
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            made = step(batch) if batch.num_rows else None
            if made is not None:
                yield pa.RecordBatch.from_arrays(
                    [as_array(made[f.name], f.type) for f in arrow], schema=arrow
                )

    return df.select(*columns).mapInArrow(run, schema)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def score_texts(df: DataFrame, fields: str, start) -> DataFrame:
    """Append columns computed from ``text``; every other column passes through.

    ``start()`` gives a function from a list of texts (str or None) to a dict of columns.  A
    column of ``df`` that has the name of a new one is replaced.
    """
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(fields)
    kept = [c for c in df.columns if c not in added.names]
    schema = StructType([df.schema[c] for c in kept] + list(added))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = step(batch.column(kept.index("text")).to_pylist())
            parts = [batch.column(i) for i in range(len(kept))]
            parts += [as_array(made[f.name], arrow.field(f.name).type) for f in added]
            yield pa.RecordBatch.from_arrays(
                [as_array(p, f.type) for p, f in zip(parts, arrow)], schema=arrow
            )

    return df.select(*kept).mapInArrow(run, schema)


def tokenizer_dir() -> str:
    """The folder of public tokenizer files; a parameter of the operators that read them."""
    try:
        import public_tokenizers

        return os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))
    except ImportError:
        return "/opt/tokenizers"


__all__ = [
    "as_array", "from_arrow_schema", "held_out", "map_batches", "remainder", "score_texts", "table",
    "fit_in_task", "tokenizer_dir", "training_rows",
]
