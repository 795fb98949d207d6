"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Two states (clean, toxic) over a document's words.  A word's features are hashes of the word
and of its first and last bytes; the transition weights let neighbouring words speak for
each other.  Labels are known for documents only, so training first labels tokens: a feature
that stands in far more toxic documents than clean ones marks its tokens in toxic documents.
Forward-backward then gives each token's marginal; a document's score is a logistic function
of their sum, maximum and share, and its offending offsets are the tokens of marginal 0.5 or
more.

The recursions are exact: all documents of a chunk form one sequence in which a document's
start forgets the state.  The sequence is cut into blocks whose 2 x 2 transfer matrices are
multiplied side by side, then chained, then expanded again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.shared import fold, kept_rows, stored, tidy
from tallyweave.llm.textarrays import Hasher, chunks, distinct, lowered, mix, ragged, release, run_spans

WIDTH = 1 << 20  # weights; feature hashes are taken modulo this
PREFIXES = (3, 4, 5, 6, 7, 8)  # bytes
SUFFIXES = (4,)
_WORD = np.zeros(256, dtype=bool)
_WORD[ord("a") : ord("z") + 1] = True
_WORD[128:] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the runs of letters, and each document's first word."""
    data = lowered(data)
    return (data, *run_spans(data, offsets, _WORD))


KINDS = [(0, 0), *((1, k) for k in PREFIXES), *((2, k) for k in SUFFIXES)]  # the word, its beginnings, its ends


def feature(hasher, starts: np.ndarray, ends: np.ndarray, kind: tuple[int, int]) -> np.ndarray:
    """Weight numbers of one kind for each word; number 0, whose weight stays 0, where a word is too short for the kind."""
    where, length = kind
    if not where:
        return (hasher.spans(starts, ends) % np.uint64(WIDTH - 1) + np.uint64(1)).astype(np.int32)
    low, high = (starts, np.minimum(starts + length, ends)) if where == 1 else (np.maximum(ends - length, starts), ends)
    h = (hasher.spans(low, high) ^ np.uint64(where * 64 + length)) % np.uint64(WIDTH - 1) + np.uint64(1)
    return np.where(ends - starts > length, h, np.uint64(0)).astype(np.int32)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Weight numbers (kinds, words)."""
    hasher = Hasher(data)
    return np.stack([feature(hasher, starts, ends, kind) for kind in KINDS])


@dataclass
class CrfModel:
    weights: np.ndarray  # one for each feature number: added to the toxic state's potential
    bias: float
    trans: np.ndarray  # 2 x 2 log potentials, from and to
    start: np.ndarray  # 2 log potentials
    scorer: np.ndarray  # logistic weights of document_inputs

    def unary(self, numbers: np.ndarray) -> np.ndarray:
        out = np.full(numbers.shape[1], self.bias, dtype=np.float64)
        for row in numbers:
            out += self.weights[row]
        return out

    def token_marginals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        return marginals(self.unary(features(data, starts, ends)), first, self.start, self.trans)

    def score(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs @ self.scorer, -30, 30)))


def marginals(unary: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray, block: int = 256) -> np.ndarray:
    """P(toxic) of every token; ``first`` holds each document's first token and, last, the number of tokens."""
    n = len(unary)
    if not n:
        return np.zeros(0)
    n_blocks = -(-n // block)
    e = np.ones(n_blocks * block)
    e[:n] = np.exp(np.clip(unary, -30, 30))
    heads = np.zeros(n_blocks * block, dtype=bool)
    heads[first[:-1][first[:-1] < n]] = True
    heads[n:] = True
    e, heads = e.reshape(n_blocks, block).T.copy(), heads.reshape(n_blocks, block).T.copy()
    (a00, a01), (a10, a11) = np.exp(trans - trans.max())
    s0, s1 = np.exp(start - start.max())

    def step(p0, p1, k):
        both = p0 + p1
        q0 = np.where(heads[k], both * s0, p0 * a00 + p1 * a10)
        q1 = np.where(heads[k], both * s1, p0 * a01 + p1 * a11) * e[k]
        return q0, q1

    # Each block's transfer matrix, row by row, and its chain over the blocks.
    one, zero = np.ones(n_blocks), np.zeros(n_blocks)
    m = [[one, zero], [zero, one]]
    for k in range(block):
        m = [step(*row, k) for row in m]
        scale = 1 / np.maximum(np.maximum(m[0][0], m[0][1]), np.maximum(m[1][0], m[1][1]))
        m = [[x * scale for x in row] for row in m]
    table = np.stack([np.stack(row) for row in m])  # from, to, block
    ahead, back = np.ones((2, n_blocks)), np.ones((2, n_blocks))
    v = np.ones(2)
    for b in range(n_blocks):
        ahead[:, b] = v
        v = v @ table[:, :, b]
        v /= v.max()
    v = np.ones(2)
    for b in range(n_blocks - 1, -1, -1):
        back[:, b] = v
        v = table[:, :, b] @ v
        v /= v.max()
    f0, f1 = ahead
    alpha = np.empty((2, block, n_blocks))
    for k in range(block):
        f0, f1 = step(f0, f1, k)
        scale = 1 / (f0 + f1)
        f0, f1 = f0 * scale, f1 * scale
        alpha[0, k], alpha[1, k] = f0, f1
    b0, b1 = back
    out = np.empty((block, n_blocks))
    for k in range(block - 1, -1, -1):
        toxic = alpha[1, k] * b1
        out[k] = toxic / (alpha[0, k] * b0 + toxic)
        c0, c1 = b0, b1 * e[k]
        b0 = np.where(heads[k], 1.0, a00 * c0 + a01 * c1)
        b1 = np.where(heads[k], 1.0, a10 * c0 + a11 * c1)
        scale = 1 / (b0 + b1)
        b0, b1 = b0 * scale, b1 * scale
    return out.T.reshape(-1)[:n]


def document_inputs(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What the score of a document is made from: 1, log of 1 + expected toxic tokens, the largest marginal, their share."""
    n = np.diff(first)
    running = np.concatenate([[0], np.cumsum(p)])
    total = running[first[1:]] - running[first[:-1]]
    top = np.zeros(len(n))
    if len(p):
        top[n > 0] = np.maximum.reduceat(p, first[:-1][n > 0])
    return np.stack([np.ones(len(n)), np.log1p(np.maximum(total, 0)), top, np.sqrt(np.maximum(total, 0) / np.maximum(n, 1))], axis=1)


def token_labels(texts: pa.Array, labels: np.ndarray, least: float = 25.0, ratio: float = 8.0) -> np.ndarray:
    """Features that mark toxic tokens (a bool for each number), from labelled documents.

    A feature is counted once for each pair of neighbouring words that it stands between, so that copied and nearly
    copied passages don't speak many times.  It is taken if the log-likelihood ratio of its counts
    in toxic and clean documents is ``least`` or more and its rate among toxic ones ``ratio`` times the other or more.
    """
    counts, n = np.zeros((2, WIDTH), dtype=np.int64), np.ones(2)
    batch = pa.RecordBatch.from_arrays([texts, pa.array(labels)], names=["text", "label"])
    for kind in KINDS:
        seen: tuple[list, list] = ([], [])
        for part, data, offsets in chunks(iter([batch]), "text"):
            low, starts, ends, first = words_of(data, offsets)
            hasher = Hasher(low)
            words = hasher.spans(starts, ends)
            around = np.zeros((2, len(words)), dtype=np.uint64)
            around[0, 1:], around[1, :-1] = words[:-1], words[1:]
            own = first[:-1][np.diff(first) > 0]
            around[0, own] = 0
            around[1, np.append(own[1:], len(words))[: len(own)] - 1] = 0
            numbers = feature(hasher, starts, ends, kind).astype(np.uint64)
            # The number in the low bits, a hash of the place above them.
            place = mix(mix(around[0]) + around[1] * np.uint64(3) + numbers)
            keys = place << np.uint64(20) | numbers
            toxic = np.repeat(part.column(1).to_numpy(), np.diff(first)).astype(bool)
            seen[0].append(distinct(keys[~toxic]))
            seen[1].append(distinct(keys[toxic]))
        for y in (0, 1):
            total = 0
            for top in range(8):  # by the highest bits, so that only an eighth is sorted at a time
                own = distinct(np.concatenate([k[k >> np.uint64(61) == top] for k in seen[y]]))
                counts[y] += np.bincount((own & np.uint64(WIDTH - 1)).astype(np.int64), minlength=WIDTH)
                total += len(own)
            if kind == KINDS[0]:
                n[y] = max(total, 1)
    counts[:, 0] = 0
    some = np.flatnonzero(counts[1])
    k = counts[:, some].astype(float)
    rate = (k + 0.5) / (n[:, None] + 1)
    share = (k[0] + k[1]) / n.sum()

    def part(x, expected):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(expected, 1e-9)), 0)

    llr = 2 * sum(part(k[y], n[y] * share) + part(n[y] - k[y], n[y] * (1 - share)) for y in (0, 1))
    marks = np.zeros(WIDTH, dtype=bool)
    marks[some[(llr >= least) & (rate[1] >= ratio * rate[0])]] = True
    return marks


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 7, window: int = 32, unmarked: float = 0.01, epochs: int = 40) -> CrfModel:
    """Trains on documents labelled 0 or 1.  With one class or none, all scores are that share of toxic documents (0 without labels).

    The labelled documents are cut into windows of ``window`` words (the last one may be shorter).  Every window with a marked word is trained
    on, whether its document is toxic or not, and of the others, which are clean throughout, the share ``unmarked``, drawn with ``seed``.
    """
    start, trans = np.zeros(2), np.zeros((2, 2))
    model = CrfModel(np.zeros(WIDTH, dtype=np.float32), -4.0, trans, start, np.zeros(4))
    if not len(labels) or labels.min() == labels.max():
        model.scorer[0] = 30.0 if len(labels) and labels[0] else -30.0
        return model
    marks = token_labels(texts, labels)
    rng = np.random.default_rng(seed)
    parts, batch = [], pa.RecordBatch.from_arrays([texts, pa.array(labels)], names=["text", "label"])
    for part, data, offsets in chunks(iter([batch]), "text"):
        low, starts, ends, first = words_of(data, offsets)
        numbers = features(low, starts, ends)
        doc_label = np.repeat(part.column(1).to_numpy(), np.diff(first)).astype(bool)
        marked = marks[numbers].any(axis=0)
        borders = np.arange(0, len(starts), window)
        hit = np.logical_or.reduceat(marked, borders) if len(borders) else np.zeros(0, bool)
        chosen = borders[hit | (rng.random(len(borders)) < unmarked)]
        cut = np.zeros(len(starts) + 1, dtype=bool)
        cut[first] = cut[chosen] = True
        take = ragged(chosen, np.minimum(window, len(starts) - chosen))
        parts.append((numbers[:, take], (marked & doc_label)[take], cut[take]))
    x, y, cut = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts]).astype(np.int64), np.concatenate([p[2] for p in parts])
    del parts
    if len(y):
        _train(model, x, y, cut, epochs)
    rows = []
    for part, data, offsets in chunks(iter([batch]), "text"):
        low, starts, ends, first = words_of(data, offsets)
        rows.append(document_inputs(model.token_marginals(low, starts, ends, first), first))
    model.scorer = _logistic(np.concatenate(rows), labels.astype(float))
    return model


def _train(model: CrfModel, flat: np.ndarray, state: np.ndarray, heads: np.ndarray, epochs: int) -> None:
    """Maximum likelihood with a small L2 term by Adagrad over features (kinds, words), states and where a window or a document begins."""
    w = np.zeros(WIDTH)
    first = np.concatenate([np.flatnonzero(heads), [heads.size]])
    inner = np.flatnonzero(~heads)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[inner - 1], state[inner]), 1)
    seen_start = np.bincount(state[heads], minlength=2)
    sums = {"w": np.full(WIDTH, 1e-8), "b": 1e-8, "t": np.full((2, 2), 1e-8), "s": np.full(2, 1e-8)}
    for _ in range(epochs):
        unary = np.full(flat.shape[1], model.bias)
        for row in flat:
            unary += w[row]
        p = marginals(unary, first, model.start, model.trans)
        gap = p - state
        gw = sum(np.bincount(row, weights=gap, minlength=WIDTH) for row in flat) + 0.02 * w
        gw[0] = 0
        # Expected transitions from the pairwise marginals.
        expected = _pair_marginals(unary, p, heads, model.start, model.trans)
        gt = expected - seen
        gs = np.array([(1 - p[heads]).sum(), p[heads].sum()]) - seen_start
        for name, g in (("w", gw), ("b", gap.sum()), ("t", gt), ("s", gs)):
            sums[name] = sums[name] + g * g
        w -= 0.5 * gw / np.sqrt(sums["w"])
        model.bias -= 0.3 * gap.sum() / np.sqrt(sums["b"])
        model.trans = np.clip(model.trans - 0.2 * gt / np.sqrt(sums["t"]), -4, 4)
        model.start = np.clip(model.start - 0.2 * gs / np.sqrt(sums["s"]), -4, 4)
    model.weights = w.astype(np.float32)


def _pair_marginals(unary, p, heads, start, trans) -> np.ndarray:
    """Expected counts of the four transitions.

    Given a token's marginal, the one before is drawn by the backward conditional
    P(s | next = t), which the ratio of forward messages times the transition gives; forward
    messages follow from the marginals of the chain up to each token.
    """
    ahead = np.empty(len(unary))  # forward probability of the toxic state
    a = np.exp(trans - trans.max())
    s = np.exp(start - start.max())
    e = np.exp(np.clip(unary, -30, 30))
    order = np.flatnonzero(heads)
    lengths = np.diff(np.append(order, len(unary)))
    active, f1, k = order, None, 0
    while len(active):
        if k == 0:
            one, nil = s[1] * e[active], np.full(len(active), s[0])
        else:
            one = ((1 - f1) * a[0, 1] + f1 * a[1, 1]) * e[active]
            nil = (1 - f1) * a[0, 0] + f1 * a[1, 0]
        f1 = one / (one + nil)
        ahead[active] = f1
        k += 1
        keep = lengths > k
        order, lengths, f1 = order[keep], lengths[keep], f1[keep]
        active = order + k
    inner = np.flatnonzero(~heads)
    f = ahead[inner - 1]
    out = np.zeros((2, 2))
    for to, chance in ((0, 1 - p[inner]), (1, p[inner])):
        from1 = f * a[1, to] / (f * a[1, to] + (1 - f) * a[0, to])
        out[1, to] = (from1 * chance).sum()
        out[0, to] = ((1 - from1) * chance).sum()
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.5) -> np.ndarray:
    """Newton's method for ridge logistic regression (the constant isn't shrunk)."""
    w = np.zeros(x.shape[1])
    shrink = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (p - y) + shrink @ w)
        size = np.abs(step).max()
        w -= step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


MOST_ROWS, MOST_BYTES = 12_000, 20 << 20  # of labelled documents that a classifier is trained on


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int = MOST_ROWS, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[pa.Array, np.ndarray]:
    """Whole texts and labels of labelled documents outside the held-out fold: at most ``most``, those of the smallest id hashes, and of these as many as have ``most_bytes`` bytes together.

    The bounds are on the classifiers' training rows alone.  A document above a sixteenth of
    ``most_bytes`` is no training row.  Ids with both labels are left out; rows that repeat an id count
    once, with the smallest text; a null text is empty.  The chosen ids are few, so they are broadcast and the texts' table isn't shuffled.
    """
    with tidy(docs.sparkSession):
        chosen = (
            labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
            .groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).cast("int").alias("_label"), F.max(label).cast("int").alias("_other"))
            .where("_label = _other").select("_id", "_label")
            .orderBy(F.xxhash64("_id"), "_id")
            .limit(most)
        )
        text = F.coalesce(F.col(text_col), F.lit("")).alias("_text")
        found = docs.select(F.col(id_col).alias("_id"), text).where(F.octet_length("_text") <= most_bytes // 16).join(F.broadcast(chosen), "_id")
        sample = stored(found.groupBy("_id", "_label").agg(F.min("_text").alias("_text")), "training", few=True)
        running = F.sum(F.octet_length("_text")).over(Window.orderBy(F.xxhash64("_id"), "_id"))
        kept = sample.select("_id", running.alias("_bytes")).where(F.col("_bytes") <= most_bytes).select("_id")
        table = sample.join(F.broadcast(kept), "_id").orderBy("_id").select("_text", "_label").toArrow().combine_chunks()
    return table.column(0).combine_chunks() if table.num_rows else pa.array([], pa.string()), table.column(1).to_numpy().astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> CrfModel:
    """Fits the field on labels (doc_id, toxic) outside fold 0 of 5, on at most ``most`` documents of ``most_bytes`` together (see ``training_sample``)."""
    model = fit(*training_sample(docs, labels, "toxic", 5, 0, most, most_bytes, id_col, text_col))
    release()
    return model


def score(docs: DataFrame, model: CrfModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, score, predicted, and spans (start and end in code points, marginal) of offending words.

    Reads whole texts; only the text enters the score.  Null and empty texts have no tokens and get
    the score of that.  Repeated rows and null ids keep their rows; other columns are ignored.
    No shuffle; the model goes to the workers as a broadcast of fixed size.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch, data, offsets in chunks(batches, "text"):
            low, starts, ends, first = words_of(data, offsets)
            p = own.token_marginals(low, starts, ends, first)
            result = own.score(document_inputs(p, first))
            bad = np.flatnonzero(p >= 0.5)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            origin = points[offsets[np.searchsorted(first, bad, side="right") - 1]]
            spans = pa.StructArray.from_arrays([pa.array(points[starts[bad]] - origin), pa.array(points[ends[bad]] - origin), pa.array(p[bad])], fields=list(span))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(bad, first).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(result), pa.array((result >= 0.5).astype(np.int32)), lists], names=["doc_id", "score", "predicted", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, spans array<struct<start:bigint,end:bigint,marginal:double>>")


def keep_clean(docs: DataFrame, model: CrfModel, text_col: str = "text") -> DataFrame:
    """The rows whose text isn't predicted toxic, with all their columns, whatever their names.

    A null or empty text has no tokens and is judged by that.  Repeated rows and null ids are kept or dropped each by its own text.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        low, starts, ends, first = words_of(data, offsets)
        return held.value.score(document_inputs(held.value.token_marginals(low, starts, ends, first), first)) < 0.5

    return kept_rows(docs, text_col, 1 << 19, keep)
