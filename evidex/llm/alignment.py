"""Alignment of two tokenizers over the same bytes.

Rows are shuffled by their full text, so a text that many documents share is tokenised and aligned
once and counts as often as it occurs; the measures go back to the documents by the digest of the text.

Byte offsets at which both tokenizations have an end cut a text into groups; two tokens are linked if
their byte ranges overlap.  Every stretch between two neighbouring ends of either kind lies in one
token of each, and every linked pair of tokens has exactly one such stretch, so links, groups and
tokens come from one pass over the marked ends of a batch of texts.

How many documents hold an id pair linked is known only after all texts were aligned.  Tasks
therefore store their texts in chunks: per text its measures and its pairs as numbers of the chunk,
per chunk its distinct pairs with the documents that hold them.  Counts are summed over all chunks
and meet the texts of their chunk again by a co-group; both sides of it are bounded by ``CHUNK_PAIRS``
(and one text), however often a pair or a text occurs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from evidex.llm.bpe import pack, unpack
from evidex.session import cut_lineage

SPACE = "▁"  # the mark of a space in a piece
BATCH_BYTES = 1 << 20  # text that is tokenised and aligned at once (or one longer text)
CHUNK_PAIRS = 3_000_000  # pairs of texts after which a chunk ends
NEAR, LONG_WORD = 0x250, 500
#: Fixed value: how the byte-level vocabulary cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WIDE = 1 << 16  # above every id of either vocabulary
MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
STORED = f"chunk long, digest string, copies long, {MEASURES}, payload binary, pairs array<long>, holders array<long>"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for
    themselves, the others follow from U+0100 on in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers, and tables by id: bytes, and the decimal id with what may follow it."""

    def __init__(self, description: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(description)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_proto=model)
        stands = byte_level()
        spell = lambda token: bytes(stands[c] for c in token)
        self.merger = self.pair_merger(description, spell)
        a_bytes = [spell(self.a.id_to_token(i)) if i not in self.specials() else b"" for i in range(self.a.get_vocab_size())]
        b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(self.b.vocab_size())
        ]
        self.bytes = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        self.lengths = [np.array([len(x) for x in y]) for y in (a_bytes, b_bytes)]
        ids = [f"{i}{end}" for end in ",|;" for i in range(WIDE)]
        self.marked = pa.array(ids, pa.string())

    def specials(self) -> set[int]:
        return {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}

    def pair_merger(self, description: str, spell):
        """(engine, pattern of the characters it is not used for), or none: tiktoken over the vocabulary of
        ``description``, if the ids of merged tokens follow the order of the merges, as it presumes.  It
        cuts texts by the same pattern with character classes of its own; characters below U+0250 for
        which the two do not agree, and all others, are left to the first engine."""
        import tiktoken

        model = json.loads(description)["model"]
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        ids = [model["vocab"].get(m.replace(" ", ""), -1) for m in merged]
        if any(b <= a for a, b in zip(ids, ids[1:])) or min(ids, default=-1) < 256:
            return None
        ranks = {spell(t): i for t, i in model["vocab"].items() if i not in self.specials()}
        engine = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        differ = []
        for c in map(chr, range(NEAR)):
            some = [f"a{c}b", f" {c}{c} x", f"1{c}1", f"{c} {c}", f"!{c}!", f"{c}\n{c}"]
            if [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)] != [engine.encode_ordinary(x) for x in some]:
                differ.append(re.escape(c))
        return engine, re.compile(f"[{''.join(differ)}]|[^\\x00-{chr(NEAR - 1)}]" if differ else f"[^\\x00-{chr(NEAR - 1)}]")

    def encode(self, texts: list[str]):
        a: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            # Its merging takes the square of a word's length.
            if self.merger and not self.merger[1].search(t) and max(map(len, t.split(" "))) < LONG_WORD:
                a[i] = np.array(self.merger[0].encode_ordinary(" " + t), np.int64)
            else:
                rest.append(i)
        for i, e in zip(rest, self.a.encode_batch_fast([" " + texts[i] for i in rest], add_special_tokens=False)):
            a[i] = np.array(e.ids, np.int64)
        b = [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]
        return a, b

    def spelled(self, ids: list[np.ndarray], side: int) -> pa.Array:
        """The bytes of each sequence of ids."""
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        parts = self.bytes[side].take(pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts), b"")

    def align(self, texts: list[str]) -> list[tuple]:
        """Per text: n_a, n_b, n_groups, n_links, groups, distinct pairs (a * WIDE + b), times of each.
        A text that either tokenizer spells otherwise has no tokens."""
        a, b = self.encode(texts)
        spelled = [x.to_pylist() for x in (self.spelled(a, 0), self.spelled(b, 1))]
        none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        out: list[tuple] = [none] * len(texts)
        good = [i for i, t in enumerate(texts) if t and spelled[0][i] == spelled[1][i] == b" " + t.encode()]
        if not good:
            return out
        flat = [np.concatenate([x[i] for i in good]) for x in (a, b)]
        starts = [np.concatenate([[0], np.cumsum([len(x[i]) for i in good])]) for x in (a, b)]
        ends = [np.cumsum(table[ids]) for table, ids in zip(self.lengths, flat)]
        mark = np.zeros(ends[0][-1] + 1, np.uint8)
        for side in (0, 1):
            mark[ends[side]] |= 1 << side
        at = np.flatnonzero(mark)
        kinds = mark[at]
        token = [np.cumsum(kinds >> side & 1) - (kinds >> side & 1) for side in (0, 1)]  # of the stretch that ends there
        link_text = np.searchsorted(starts[0], token[0], "right") - 1
        shared = kinds == 3
        groups = np.bincount(link_text[shared], minlength=len(good))
        links = np.bincount(link_text, minlength=len(good))
        key, times = np.unique((link_text << 32) | (flat[0][token[0]] * WIDE + flat[1][token[1]]), return_counts=True)
        own = np.searchsorted(key, np.arange(len(good) + 1) << 32)
        written = self.group_texts(flat, starts, token, shared, good)
        for k, i in enumerate(good):
            some = slice(own[k], own[k + 1])
            out[i] = (
                len(a[i]), len(b[i]), int(groups[k]), int(links[k]), written[k], key[some] & 0xFFFFFFFF, times[some],
            )
        return out

    def group_texts(self, flat, starts, token, shared, good) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        # The last token of every group on either side, and with it each token's group.
        last = [np.zeros(len(x), bool) for x in flat]
        for side in (0, 1):
            last[side][token[side][shared]] = True
        group = [np.cumsum(x) - x for x in last]
        size = [np.bincount(g, minlength=int(shared.sum())) for g in group]
        before_b = np.cumsum(size[1]) - size[1]  # tokens of b in earlier groups
        upto_a = np.cumsum(size[0])
        order = np.empty(len(flat[0]) + len(flat[1]), np.int64)
        order[np.arange(len(flat[0])) + before_b[group[0]]] = flat[0] + np.where(last[0], WIDE, 0)
        order[np.arange(len(flat[1])) + upto_a[group[1]]] = flat[1] + np.where(last[1], 2 * WIDE, 0)
        offsets = pa.array(starts[0] + starts[1], pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, self.marked.take(pa.array(order))), "")
        return [x[:-1] for x in joined.to_pylist()]


def batches_of(texts: list[str]):
    """Ranges of texts of at most ``BATCH_BYTES`` characters, or one longer text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_BYTES):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def aligned_texts(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, chunk_pairs: int = CHUNK_PAIRS) -> DataFrame:
    """Chunks of aligned distinct texts, stored.  A row is a text (``pairs`` null) or the distinct
    pairs of a chunk with the number of documents that hold each (``digest`` null)."""
    spark = docs.sparkSession
    with open(tokenizer_a, encoding="utf-8") as f, open(tokenizer_b, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))  # two vocabularies, of fixed size
    distinct = docs.where(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("copies"))
    rows = distinct.select("text", F.sha2("text", 256).alias("digest"), "copies")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(STORED))

    def run(batches):
        aligner, turn, held, size = Aligner(*files.value), 0, [], 0

        def flush():
            chunk = (TaskContext.get().partitionId() << 24) + turn
            every = np.concatenate([h[1] for h in held])
            distinct, number = np.unique(every, return_inverse=True)
            copies = np.repeat([h[0][1] for h in held], [len(h[1]) for h in held])
            holders = np.zeros(len(distinct), np.int64)
            np.add.at(holders, number, copies)
            # Pairs of many texts get small numbers.
            rank = np.argsort(-np.bincount(number, minlength=len(distinct)), kind="stable")
            place = np.empty_like(rank)
            place[rank] = np.arange(len(rank))
            number = place[number]
            rows, at = [], 0
            for (digest, copies, *measures), pairs, times in held:
                own = number[at : at + len(pairs)]
                at += len(pairs)
                order = np.argsort(own)
                rows.append((chunk, digest, copies, *measures, pack(np.diff(own[order], prepend=0), times[order] - 1), None, None))
            rows.append((chunk, None, None, None, None, None, None, None, None, distinct[rank].tolist(), holders[rank].tolist()))
            for low in range(0, len(rows), 2_000):
                columns = zip(*rows[low : low + 2_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            texts, digests, copies = (c.to_pylist() for c in batch.columns)
            for low, high in batches_of(texts):
                for i, (n_a, n_b, groups, links, written, pairs, times) in enumerate(aligner.align(texts[low:high]), low):
                    if not n_a:
                        continue  # as a document without text
                    digest = hashlib.sha256(written.encode()).hexdigest()
                    held.append(((digests[i], copies[i], n_a, n_b, groups, links, digest), pairs, times))
                    size += len(pairs)
                    if size >= chunk_pairs:
                        yield from flush()
                        held, size, turn = [], 0, turn + 1
        if held:
            yield from flush()

    return cut_lineage(rows.mapInArrow(run, STORED), "aligned-texts")


def pair_counts(stored: DataFrame) -> DataFrame:
    """a, b, count: documents of the corpus that hold the pair linked; best: no pair of a has more."""
    rows = stored.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "holders")).alias("x"))
    counted = rows.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("count"))
    pair = F.col("pair")
    split = counted.select(F.shiftright(pair, 16).alias("a"), pair.bitwiseAND(F.lit(WIDE - 1)).alias("b"), "count")
    most = split.groupBy("a").agg(F.max("count").alias("most"))
    return split.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def text_measures(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """digest and all measures of each distinct text."""
    spots = stored.where("pairs is not null").select(F.col("chunk").alias("home"), F.posexplode("pairs").alias("number", "pair"))
    code = (F.shiftleft(F.col("a"), 16) + F.col("b")).alias("pair")
    priced = spots.join(counts.select(code, "count", "best"), "pair").select("home", "number", "count", "best")
    texts = stored.where("digest is not null").select("chunk", "digest", *[x.split()[0] for x in MEASURES.split(", ")], "payload")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        number = right["number"].to_numpy()
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), bool)
        count[number] = right["count"].to_numpy()
        best[number] = right["best"].to_numpy(zero_copy_only=False)
        n_best, total = [], []
        for payload in left["payload"].to_pylist():
            (steps, more), _ = unpack(payload)
            own, times = np.cumsum(steps), more + 1
            n_best.append(int(times[best[own]].sum()))
            total.append(int((times * count[own]).sum()))
        kept = left.drop_columns(["chunk", "payload"])
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))

    grouped = texts.groupBy("chunk").cogroup(priced.groupBy("home"))
    return grouped.applyInArrow(run, f"digest string, {MEASURES}, n_best long, count_sum long")


def align_documents(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, chunk_pairs: int = CHUNK_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row per row of ``docs``.

    Null and empty texts, and texts whose tokens spell other bytes, have zeros and ''.  Repeated rows
    and ids count and return each; a null doc_id is kept; other columns are not read."""
    stored = aligned_texts(docs, tokenizer_a, tokenizer_b, chunk_pairs)
    measures = text_measures(stored, pair_counts(stored))
    rows = docs.select("doc_id", F.sha2("text", 256).alias("digest")).join(measures, "digest", "left")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return rows.select(
        "doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )
