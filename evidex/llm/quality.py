"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

Random indexing gives every word a sparse ternary index vector; a word's context vector is the
sum of the index vectors of its neighbours over *all* documents.  Words share ``buckets`` hash
buckets, so the table of vectors is bounded by ``buckets * dims`` whatever the corpus, has a row
for every word that will ever occur, and sums exactly (integers).  A document is the weighted mean
of its words' context vectors, the mean of their index vectors and four counts.  A two-layer numpy
network over that is fitted on a bounded labelled sample and calibrated by a temperature on a part
it did not see.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidex.llm.common import fit_in_task, held_out, score_texts, training_rows

OTHER, LETTERS = re.compile(r"\W+"), re.compile(r"\w+")


@dataclass(frozen=True)
class Shape:
    """Bounded sizes of the model; ``sample_rows`` labelled documents are the only fitted rows."""

    buckets: int = 1 << 14
    dims: int = 32
    window: int = 2
    hidden: int = 32
    epochs: int = 80
    sample_rows: int = 6000
    max_chars: int = 40_000
    seed: int = 7


def bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


class Buckets(dict):
    """Raw word -> buckets of its letters and of its punctuation (bucket 0: none) as one number.

    Remembered for the words a task meets, forgotten when there are many."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, raw: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        word, marks = (raw, "") if raw.isalnum() else (OTHER.sub("", raw), LETTERS.sub("", raw))
        value = bucket(word or marks, self.size) * self.size + (bucket(marks, self.size) if marks else 0)
        self[raw] = value
        return value


def word_ids(text: str | None, seen: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their punctuation, in order."""
    words = text.split() if text else []
    both = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    return both // seen.size, both % seen.size


def index_vectors(shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Two (position, sign) pairs per bucket: the sparse ternary index vectors."""
    rng = np.random.default_rng(shape.seed)
    at = np.stack([rng.integers(0, shape.dims, shape.buckets) for _ in range(2)], 1)
    return at, rng.choice([-1, 1], (shape.buckets, 2))


def context_table(docs: DataFrame, shape: Shape) -> np.ndarray:
    """Occurrences and context sums of every bucket over all documents: (buckets, 1 + dims).

    Each task adds up its own documents and sends one row per bucket; the sums meet by bucket.
    """
    names = [f"c{i}" for i in range(shape.dims + 1)]

    def run(batches):
        at, sign = index_vectors(shape)
        seen, width = Buckets(shape.buckets), shape.dims
        total = np.zeros(shape.buckets * width, np.int64)
        count = np.zeros(shape.buckets, np.int64)

        def flush(held):
            nonlocal total
            if not held:
                return
            ids = np.concatenate(held)
            real = ids >= 0
            count[:] += np.bincount(ids[real], minlength=shape.buckets)
            for gap in range(1, shape.window + 1):
                left, right = ids[:-gap], ids[gap:]
                both = (left >= 0) & (right >= 0)
                if gap > 1:  # no pair reaches over the end of a document
                    for mid in range(1, gap):
                        both &= ids[mid : mid + len(left)] >= 0
                left, right = left[both], right[both]
                for a, b in ((left, right), (right, left)):
                    for j in range(2):
                        flat = a * width + at[b, j]
                        total += np.bincount(flat, sign[b, j], len(total)).astype(np.int64)

        held, size, stop = [], 0, np.array([-1])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids, _ = word_ids(text, seen)
                held += [ids, stop]
                size += len(ids)
                if size > 300_000:
                    flush(held)
                    held, size = [], 0
        flush(held)
        rows = np.flatnonzero(count)
        if len(rows):
            table = total.reshape(shape.buckets, width)
            columns = [rows, count[rows], *(table[rows, i] for i in range(width))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["bucket", *names])

    sums = (
        docs.select("text")
        .mapInArrow(run, "bucket long, " + ", ".join(f"{n} long" for n in names))
        .groupBy("bucket")
        .agg(*[F.sum(n).alias(n) for n in names])
    )
    out = np.zeros((shape.buckets, shape.dims + 1), np.int64)
    for row in sums.collect():  # at most ``buckets`` rows
        out[row[0]] = row[1:]
    return out


def word_table(context: np.ndarray, shape: Shape) -> np.ndarray:
    """Per bucket: weighted unit context vector, then the dense index vector."""
    count, sums = context[:, 0].astype(float), context[:, 1:].astype(float)
    share = count / max(1.0, count.sum())
    unit = sums / np.maximum(np.sqrt((sums**2).sum(1, keepdims=True)), 1.0)
    at, sign = index_vectors(shape)
    index = np.zeros((shape.buckets, shape.dims))
    for j in range(2):
        np.add.at(index, (np.arange(shape.buckets), at[:, j]), sign[:, j])
    return np.hstack([unit * (1e-3 / (1e-3 + share))[:, None], index]).astype(np.float32)


def features(texts: list[str | None], words: np.ndarray, seen: Buckets) -> np.ndarray:
    """One row per text: means of the words' vectors, of their punctuation's index vectors, and
    four counts; an empty or null text is all zeros."""
    width, dims = words.shape[1], words.shape[1] // 2
    marks = words[:, dims:].copy()
    marks[0] = 0
    out = np.zeros((len(texts), width + dims + 4))
    for i, text in enumerate(texts):
        ids, punctuation = word_ids(text, seen)
        n = len(ids)
        if not n:
            continue
        for at in range(0, n, 65_536):
            out[i, :width] += words[ids[at : at + 65_536]].sum(0, dtype=np.float64)
        some = punctuation[punctuation > 0]
        for at in range(0, len(some), 65_536):
            out[i, width:-4] += marks[some[at : at + 65_536]].sum(0, dtype=np.float64)
        out[i, :-4] /= n
        distinct = len(np.unique(ids))
        out[i, -4:] = np.log1p(n), distinct / n, (ids[1:] == ids[:-1]).mean() if n > 1 else 0.0, len(text) / n / 10
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, shape: Shape) -> Network:
    """Adam on the logistic loss; every fifth row only sets the temperature.  Without rows of
    both classes the network is constant at the (smoothed) share of ones."""
    share = (y.sum() + 1) / (len(y) + 2)
    width = x.shape[1]
    if len(np.unique(y)) < 2:
        flat = np.log(share / (1 - share))
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(flat))
    rng = np.random.default_rng(shape.seed)
    part = np.arange(len(y)) % 5 == 4
    xt, yt = x[~part], y[~part]
    mean, scale = xt.mean(0), xt.std(0) + 1e-3
    h = shape.hidden
    params = [rng.normal(0, 1 / np.sqrt(width), (width, h)), np.zeros(h), rng.normal(0, 1 / np.sqrt(h), h), np.array(np.log(share / (1 - share)))]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (xt - mean) / scale
    for _ in range(shape.epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            rows = order[at : at + 256]
            a = np.tanh(z[rows] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-(a @ params[2] + params[3]))) - yt[rows]) / len(rows)
            da = np.outer(d, params[2]) * (1 - a**2)
            grads = [z[rows].T @ da + 1e-3 * params[0], da.sum(0), a.T @ d + 1e-3 * params[2], d.sum()]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g**2
                params[i] = params[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, *params[:3], float(params[3]))
    xc, yc = (x[part], y[part]) if part.any() else (xt, yt)
    raw = net.logits(xc)
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.logaddexp(0, -(2 * yc - 1) * raw / t).mean() for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class QualityModel:
    words: np.ndarray
    network: Network
    shape: Shape

    def scorer(self):
        seen = Buckets(self.shape.buckets)
        return lambda texts: self.network(features(texts, self.words, seen))


def train(docs: DataFrame, labels: DataFrame, shape: Shape = Shape(), label: str = "quality") -> QualityModel:
    words = word_table(context_table(docs, shape), shape)
    sample = training_rows(docs, labels, label, shape.sample_rows, shape.max_chars)
    vectors = docs.sparkSession.sparkContext.broadcast(words)

    def fit_rows(rows):
        x = features([t for t, _ in rows], vectors.value, Buckets(shape.buckets))
        return fit(x, np.array([y for _, y in rows], float), shape)

    return QualityModel(words, fit_in_task(sample, fit_rows), shape)


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` of every text; null and empty texts are scored as
    texts without words.  All columns of ``docs`` stay; clashing ones are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        score = shared.value.scorer()

        def step(texts):
            got = np.concatenate([score(texts[i : i + 256]) for i in range(0, len(texts), 256)])
            return {"score": got, "predicted": (got >= threshold).astype(np.int32)}

        return step

    return score_texts(docs, "score double, predicted int", start)


def quality_scores(docs: DataFrame, labels: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, one row per input row."""
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels, shape))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
