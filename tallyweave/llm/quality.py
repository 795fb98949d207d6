"""Document quality from random-indexing word vectors and a small calibrated network.

Every word type has a sparse ternary index vector drawn from its hash, so vectors need no
dictionary.  A type's context vector is the sum of the index vectors that stand beside it in
all documents, labelled or not: each task adds up its own, and the sums are added by type.  A document is the mean of its words' vectors, for two kinds of
types: the words themselves and their shapes (what characters they are made of), beside the
shares of repeated words and word pairs.  A two-layer network gives the logit, and a
temperature fitted on training documents that the network hasn't seen makes it a
probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import kept_rows, partitions
from tallyweave.llm.textarrays import U64, chunks, lowered, mix, release, span_hashes, word_spans
from tallyweave.llm.toxicity import MOST_BYTES, MOST_ROWS, training_sample

TYPES, SHAPES = 1 << 16, 1 << 12  # hashed word types and shapes
DIM, SHAPE_DIM = 48, 32
NONZERO = 4  # entries of an index vector
CHUNK = 1 << 19
_KIND = np.full(256, 3, dtype=np.uint8)  # 0 upper case, 1 lower case or beyond ASCII, 2 digit, 3 other
_KIND[65:91] = 0
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[48:58] = 2


def index_entries(n: int, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (NONZERO, n) of n sparse ternary vectors, each made from the hash of its number."""
    h = mix(np.arange(n, dtype=U64) * U64(NONZERO) + (np.arange(1, NONZERO + 1, dtype=U64) + U64(seed << 32))[:, None])
    return (h % U64(dim)).astype(np.int64), np.where(h >> U64(63), 1, -1).astype(np.int32)


def index_vectors(n: int, dim: int, seed: int) -> np.ndarray:
    out = np.zeros((n, dim), dtype=np.float32)
    for place, sign in zip(*index_entries(n, dim, seed), strict=True):
        out[np.arange(n), place] += sign
    return out / np.sqrt(NONZERO)


def types_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, word types, shapes and each document's first word."""
    starts, ends, first = word_spans(data, offsets)
    low = lowered(data)
    hashes = span_hashes(low, starts, ends)
    shape = np.zeros(len(starts), dtype=np.int64)
    for kind, most in ((0, 3), (1, 3), (2, 2), (3, 3)):
        running = np.concatenate([[0], np.cumsum(_KIND[data] == kind)])
        shape = shape * (most + 1) + np.minimum(running[ends] - running[starts], most)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    shape = shape * 256 + np.where(_KIND[last] == 3, last, 0)
    shape_number = (mix(shape.astype(U64)) % U64(SHAPES)).astype(np.int32)
    return hashes, (hashes % U64(TYPES)).astype(np.int32), shape_number, first


@dataclass
class QualityModel:
    words: np.ndarray  # TYPES x DIM: index plus context vectors
    shapes: np.ndarray  # SHAPES x SHAPE_DIM
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray  # inputs + 1 x units
    out: np.ndarray  # units + 1
    temperature: float = 1.0
    constant: float | None = None  # the score of everything, where labels don't allow training

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.hidden[:-1] + self.hidden[-1]) @ self.out[:-1] + self.out[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _pooled(vectors: np.ndarray, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = np.diff(first)
    out = np.zeros((len(n), vectors.shape[1]))
    if len(numbers):
        full = n > 0
        out[full] = np.add.reduceat(vectors[numbers], first[:-1][full], axis=0) / n[full][:, None]
    return out


def document_vectors(model: QualityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One vector for each document: pooled word and shape vectors and shares of repetition."""
    hashes, types, shapes, first = types_of(data, offsets)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1 if len(doc) else np.zeros(0, np.int64)
    same = np.bincount(doc[inner[hashes[inner] == hashes[inner - 1]]], minlength=len(n)) if len(doc) else np.zeros(len(n))
    pairs = mix(hashes[inner] * U64(3) + hashes[inner - 1]) ^ mix(doc[inner].astype(U64))
    _, at = np.unique(pairs, return_index=True)
    fresh = np.bincount(doc[inner[at]], minlength=len(n)) if len(at) else np.zeros(len(n))
    safe = np.maximum(n, 1)
    size = np.diff(offsets)
    extra = np.stack([same / safe, np.where(n > 1, 1 - fresh / np.maximum(n - 1, 1), 0), np.log1p(n) / 5, size / safe / 8], axis=1)
    return np.concatenate([_pooled(model.words, types, first), _pooled(model.shapes, shapes, first), extra], axis=1)


class ContextSums:
    """Sums of neighbours' index vectors, as whole numbers, for each word type and, after these, each shape."""

    SIZES = (TYPES * DIM, SHAPES * SHAPE_DIM)

    def __init__(self):
        self.entries = index_entries(TYPES, DIM, 1), index_entries(SHAPES, SHAPE_DIM, 2)
        self.sums = [np.zeros(size, dtype=np.int32) for size in self.SIZES]

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        _, types, shapes, first = types_of(data, offsets)
        border = np.zeros(len(types) + 1, dtype=bool)
        border[first] = True
        inner = np.flatnonzero(~border[1:-1]) + 1 if len(types) else np.zeros(0, np.int64)
        for numbers, dim, (places, signs), sums in zip((types, shapes), (DIM, SHAPE_DIM), self.entries, self.sums, strict=True):
            left, right = numbers[inner - 1], numbers[inner]
            for own, other in ((left, right), (right, left)):
                for place, sign in zip(places, signs, strict=True):
                    np.add.at(sums, own.astype(np.int64) * dim + place[other], sign[other])

    @staticmethod
    def vectors(sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Types' and shapes' vectors: their own index vectors and, of length one, their contexts."""
        out = []
        for own, around in zip((index_vectors(TYPES, DIM, 1), index_vectors(SHAPES, SHAPE_DIM, 2)), sums, strict=True):
            around = around.reshape(own.shape).astype(np.float32)
            around /= np.maximum(np.sqrt(np.einsum("nd,nd->n", around, around))[:, None], 1e-6)
            around += own
            out.append(around)
        return out[0], out[1]


def gather_contexts(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Word and shape vectors from the whole texts of all documents.

    A task sends its sums on in parts of a fixed number of entries, those of zero only left out; each part is added
    up by one task, a batch at a time.  What comes to the driver has the same size whatever the corpus.
    """
    parts = max(8, min(512, partitions(docs)))
    bounds = [[size * k // parts for k in range(parts + 1)] for size in ContextSums.SIZES]

    def packed(sums: list[np.ndarray], k: int) -> bytes:
        return zlib.compress(b"".join(s[b[k] : b[k + 1]].astype("<i8").tobytes() for s, b in zip(sums, bounds, strict=True)), 1)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, some = ContextSums(), False
        for _, data, offsets in chunks(batches, "text", CHUNK):
            own.add(data, offsets)
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([packed(own.sums, k) for k in range(parts)], pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(zlib.decompress(raw.as_py()), dtype="<i8")
                totals[k] = totals[k] + values if k in totals else values
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], names=["part", "sums"])

    schema = "part int, sums binary"
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(gather, schema).repartitionById(parts, F.col("part")).mapInArrow(add, schema).toArrow()
    sums = [np.zeros(size, dtype=np.int64) for size in ContextSums.SIZES]
    for k, raw in zip(found.column(0).to_pylist(), found.column(1), strict=True):
        values, at = np.frombuffer(raw.as_buffer(), dtype="<i8"), 0
        for s, b in zip(sums, bounds, strict=True):
            s[b[k] : b[k + 1]] = values[at : at + b[k + 1] - b[k]]
            at += b[k + 1] - b[k]
    del found
    return ContextSums.vectors(sums)


def fit(texts: pa.Array, labels: np.ndarray, vectors: tuple[np.ndarray, np.ndarray] | None = None, units: int = 32, epochs: int = 60, seed: int = 11) -> QualityModel:
    """Trains on documents labelled 0 or 1, with word and shape vectors (by default from these texts); with one class or none, all scores are that label (0.5 without labels)."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    if vectors is None:
        own = ContextSums()
        for _, data, offsets in chunks(iter([batch]), "text", CHUNK):
            own.add(data, offsets)
        vectors = ContextSums.vectors(own.sums)
    model = QualityModel(*vectors, *(np.zeros(1),) * 4)
    if not len(labels) or labels.min() == labels.max():
        model.constant = float(labels[0]) if len(labels) else 0.5
        return model
    x = np.concatenate([document_vectors(model, data, offsets) for _, data, offsets in chunks(iter([batch]), "text", CHUNK)])
    y = labels.astype(float)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    aside = rng.random(len(y)) < 0.2
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    _train(model, z[~aside], y[~aside], units, epochs, rng)
    if aside.any():
        raw = model.logits(x[aside])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.logaddexp(0, -np.where(y[aside] > 0, raw, -raw) / t).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _train(model: QualityModel, z: np.ndarray, y: np.ndarray, units: int, epochs: int, rng) -> None:
    """Cross-entropy by Adam over small batches, with weight decay."""
    hidden = rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1] + 1, units))
    hidden[-1] = 0
    out = rng.normal(0, 1 / np.sqrt(units), units + 1)
    out[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    params, first, second = [hidden, out], [np.zeros_like(hidden), np.zeros_like(out)], [np.zeros_like(hidden), np.zeros_like(out)]
    step, size = 0, 128
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(y))
        for at in range(0, len(order), size):
            rows = order[at : at + size]
            a = z[rows]
            h = np.tanh(a @ hidden[:-1] + hidden[-1])
            gap = (1 / (1 + np.exp(-np.clip(h @ out[:-1] + out[-1], -30, 30))) - y[rows]) / len(rows)
            back = gap[:, None] * out[:-1] * (1 - h * h)
            grads = [np.concatenate([a.T @ back, back.sum(axis=0, keepdims=True)]) + 1e-3 * hidden, np.append(h.T @ gap, gap.sum()) + 1e-3 * out]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.hidden, model.out = hidden, out


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Gathers vectors from all documents and fits the network on labels (doc_id, quality) outside fold 2 of 4, on at most ``most`` documents of ``most_bytes`` together (see ``training_sample``)."""
    vectors = gather_contexts(docs, text_col)
    release()
    model = fit(*training_sample(docs, labels, "quality", 4, 2, most, most_bytes, id_col, text_col), vectors=vectors)
    release()
    return model


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row (doc_id, score, predicted) for each document; predicted is 1 from ``threshold`` on.

    Reads whole texts; only the text enters the score.  Null and empty texts have no words and get the
    score of that.  Repeated rows and null ids keep their rows; other columns are ignored.  No shuffle;
    the model goes to the workers as a broadcast of fixed size.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch, data, offsets in chunks(batches, "text", CHUNK):
            result = own.score(document_vectors(own, data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(result), pa.array((result >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows whose text scores ``threshold`` or more, with all their columns, whatever their names.

    A null or empty text has no words and is judged by that.  Repeated rows and null ids are kept or dropped each by its own text.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, text_col, CHUNK, lambda data, offsets: held.value.score(document_vectors(held.value, data, offsets)) >= threshold)
