"""BPE encoding and decoding over a distinct-word table.

White space never belongs to a token of the vocabularies served, so a text's ids are its words'
ids in order.  Tasks split their documents into words and number the distinct ones; documents
travel as word numbers.  The distinct words meet by hash, each is encoded once by the public
tokenizer, and its ids go back to the chunks of documents that hold it, where they are joined by
position.  Ids become pieces through the vocabulary's id-to-piece table, whose size is fixed (one
row per id), so it is sent to every task.

Rows between the steps are blocks: compressed word numbers of up to 512 documents, or the words of
one chunk that share a hash bucket.  A chunk is what one task reads, at most ``CHUNK_WORDS`` words
(one longer text is a chunk of its own), so every step works in bounded memory.
"""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from evidex.session import shuffle_partitions

CHUNK_WORDS, CHUNK_DISTINCT = 6_000_000, 1_200_000
BLOCK_DOCS, BLOCK_WORDS = 512, 600_000
BLOCK_FIELDS = "chunk long, bucket int, home long, payload binary"


def vocabulary(path: str) -> str:
    """The tokenizer file, read on the driver and sent to tasks (its size is fixed)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def load(description: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(description)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Arrays (uint32, as byte planes) and a tail in one compressed value."""
    head = np.array([len(arrays), *map(len, arrays)], "<u4").tobytes()
    planes = [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=6).compress(head + b"".join(planes) + tail)


def unpack(payload: bytes) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    count = int(np.frombuffer(data, "<u4", 1)[0])
    sizes = np.frombuffer(data, "<u4", count, 4).tolist()
    at, out = 4 + 4 * count, []
    for n in sizes:
        planes = np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64))
        at += 4 * n
    return out, data[at:]


class Chunk:
    """Documents of one task as word numbers, and their distinct words."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.docs: list[tuple[object, np.ndarray]] = []
        self.words = 0

    def add(self, doc_id, text: bytes | None) -> None:
        number = self.number
        found = text.split() if text else []
        ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found))
        self.docs.append((doc_id, ids))
        self.words += len(ids)

    def full(self) -> bool:
        return self.words >= CHUNK_WORDS or len(self.number) >= CHUNK_DISTINCT

    def blocks(self, chunk: int, buckets: int):
        """(bucket or None, doc ids or None, payload); frequent words get small numbers.

        Words that occur once come last, in the order of the text, so in a document they are all
        written as 0 and counted on from the block's first."""
        count = np.zeros(len(self.number), np.int64)
        for _, ids in self.docs:
            count += np.bincount(ids, minlength=len(count))
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        repeated = next_single = int((count > 1).sum())
        at = 0
        while at < len(self.docs):
            end, size = at, 0
            while end < len(self.docs) and end - at < BLOCK_DOCS and size < BLOCK_WORDS:
                size += len(self.docs[end][1])
                end += 1
            some = self.docs[at:end]
            lengths = np.array([len(ids) for _, ids in some])
            ranks = rank[np.concatenate([ids for _, ids in some])]
            single = ranks >= repeated
            yield None, [d for d, _ in some], pack(lengths, np.array([next_single]), np.where(single, 0, ranks + 1))
            next_single += int(single.sum())
            at = end
        split: dict[int, list[tuple[bytes, int]]] = {}
        for word, i in self.number.items():
            split.setdefault(zlib.crc32(word) % buckets, []).append((word, int(rank[i])))
        for bucket, rows in sorted(split.items()):
            rows.sort()
            yield bucket, None, pack(np.array([r for _, r in rows]), tail=b"\n".join(w for w, _ in rows))


def word_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks of documents (bucket -1, to be kept by chunk) and of distinct words (by bucket)."""
    kind = docs.schema["doc_id"].dataType
    schema = StructType.fromDDL(BLOCK_FIELDS).add("doc_ids", ArrayType(kind))
    arrow = to_arrow_schema(schema)

    def run(batches):
        task, turn = TaskContext.get().partitionId(), 0

        def flush(held):
            base = (task << 24) + turn
            for bucket, ids, payload in held.blocks(base, buckets):
                home = base if bucket is None else bucket
                row = [[base], [-1 if bucket is None else bucket], [home], [payload], [ids]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, arrow)], schema=arrow)

        held = Chunk()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                held.add(doc_id, text.as_py())
                if held.full():
                    yield from flush(held)
                    held, turn = Chunk(), turn + 1
        if held.docs:
            yield from flush(held)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode_words(blocks: DataFrame, description) -> DataFrame:
    """Words of a bucket become ids; each distinct word of a task is encoded once.  Blocks of
    documents pass through."""
    arrow = to_arrow_schema(blocks.schema)

    def run(batches):
        tokenizer, known = load(description.value), {}
        for batch in batches:
            buckets, payloads = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for i, bucket in enumerate(buckets):
                if bucket < 0:
                    continue
                (ranks,), tail = unpack(payloads[i])
                words = tail.split(b"\n")
                if len(known) > 4_000_000:
                    known.clear()
                new = [w for w in words if w not in known]
                got = tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
                known.update((w, tuple(e.ids)) for w, e in zip(new, got))
                ids = [known[w] for w in words]
                payloads[i] = pack(ranks, np.array([len(x) for x in ids]), np.array([y for x in ids for y in x], np.int64))
            columns = [batch.column(j) for j in range(batch.num_columns)]
            columns[3] = pa.array(payloads, arrow.field(3).type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return blocks.mapInArrow(run, blocks.schema)


class Assembler:
    """Joins ids back by position, chunk by chunk; word blocks of a chunk come before documents."""

    def __init__(self, pieces: list[str], full: bool):
        self.pieces, self.full, self.chunk = pieces, full, None

    def words(self, chunk: int, payload: bytes) -> None:
        if chunk != self.chunk:
            self.chunk, self.parts, self.ready = chunk, [], False
        self.parts.append(unpack(payload)[0])

    def _settle(self) -> None:
        total = sum(len(p[0]) for p in self.parts)
        self.length = np.zeros(total, np.int64)
        self.id_text, self.piece_text = [""] * total, [""] * total
        self.ids: list = [None] * total
        name = list(map(str, range(len(self.pieces))))
        for ranks, lengths, ids in self.parts:
            self.length[ranks] = lengths
            flat, at = ids.tolist(), 0
            for r, n in zip(ranks.tolist(), lengths.tolist()):
                own = flat[at : at + n]
                at += n
                self.id_text[r] = " ".join([name[i] for i in own])
                self.piece_text[r] = " ".join([self.pieces[i] for i in own])
                if self.full:
                    self.ids[r] = own
        self.parts, self.ready = [], True

    def documents(self, chunk: int, payload: bytes):
        """Per document: tokens, digest of ids, digest of the decoded text, ids, decoded text."""
        if chunk != self.chunk:  # no word in the whole chunk
            self.chunk, self.parts, self.ready = chunk, [], False
        if not self.ready:
            self._settle()
        (lengths, first, ranks), _ = unpack(payload)
        single = ranks == 0
        ranks -= 1
        ranks[single] = first[0] + np.arange(single.sum())
        at = 0
        for n in lengths.tolist():
            own = ranks[at : at + n]
            at += n
            size = self.length[own]
            seq = own[size > 0].tolist()
            ids = " ".join(map(self.id_text.__getitem__, seq))
            text = " ".join(map(self.piece_text.__getitem__, seq))
            yield (
                int(size.sum()), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(),
                [i for r in seq for i in self.ids[r]] if self.full else None, text if self.full else None,
            )


def encode_documents(docs: DataFrame, path: str, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (``full``: also ids and decoded), one row per
    row of ``docs``; null texts count as empty, empty ones have no tokens.

    The ids are those of the whole text without special tokens added; the decoded text is the
    pieces joined by one space, as a tokenizer without a decoder gives it.  The rows of ``docs``
    must come in the same order when a task is repeated, as those of a stored table do."""
    spark = docs.sparkSession
    description = vocabulary(path)
    tokenizer = load(description)
    table = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    shared, pieces = spark.sparkContext.broadcast(description), spark.sparkContext.broadcast(table)
    buckets = shuffle_partitions(spark)
    blocks = word_blocks(docs, buckets).repartition("home")
    encoded = encode_words(blocks, shared)
    # Words (bucket 0 and up) before documents (bucket -1), within each chunk.
    ordered = encoded.repartition("chunk").sortWithinPartitions("chunk", F.col("bucket").desc())
    kind = docs.schema["doc_id"].dataType
    digests = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    made = StructType.fromDDL(digests + (", ids array<int>, decoded string" if full else ""))
    schema = StructType([StructField("doc_id", kind), *made])
    arrow = to_arrow_schema(schema)

    def run(batches):
        made = Assembler(pieces.value, full)
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] >= 0:
                    made.words(row["chunk"], row["payload"])
                    continue
                rows = list(made.documents(row["chunk"], row["payload"]))
                columns = [row["doc_ids"], *([r[i] for r in rows] for i in range(len(arrow) - 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return ordered.mapInArrow(run, schema)


def decode(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """The text of rows (key, ids) by a join with ``pieces`` (id, piece): doc rows of any key.

    Spark broadcasts the pieces by its own size check, else shuffles by id."""
    parts = encoded.select("key", F.posexplode("ids").alias("pos", "id")).join(pieces, "id")
    joined = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    texts = joined.select("key", F.array_join(F.col("p.piece"), " ").alias("decoded"))
    return encoded.select("key").join(texts, "key", "left").select("key", F.coalesce("decoded", F.lit("")).alias("decoded"))
