"""Harmonic packing of token sequences.

A document's ids fill sequences of the whole capacity C as far as they go; what is left of it, its
rest, belongs to the reciprocal-capacity class k = C // length, so that lengths above C/(k+1) and up to C/k are
together.  A bin of class k takes exactly k rests, uncut.  The gap that they leave is
filled by fillers, which are cut at its end: rests below C/CLASSES, and as many others of a batch as its gaps ask for.
Every task fills its own bins, so there is no shuffle and a lost task is simply run again with the same result.
What is left at a task's end is laid out in sequences of the whole capacity and, for lengths of a
power of two need no padding, in such ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyweave.llm import bpe
from tallyweave.llm.bpe_codec import block_ids, word_table
from tallyweave.llm.shared import tokenizer_path
from tallyweave.llm.textarrays import chunks, distinct

FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SEQUENCE_BITS = 36  # a task numbers up to 2**36 sequences of its own


CLASSES = 32
NOTHING = np.zeros((0, 4), dtype=np.int64)


def laid(rows: np.ndarray, sequence: np.ndarray, offset: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (document, start, length, total) laid one after the other into spaces (sequence, offset, room): pieces with sequence and offset as two more columns, and the rows that are left."""
    ends, borders = np.cumsum(rows[:, 2]), np.cumsum(room)
    total = int(min(ends[-1] if len(ends) else 0, borders[-1] if len(borders) else 0))
    cuts = distinct(np.concatenate([[0], ends[ends < total], borders[borders < total]])) if total else np.zeros(0, np.int64)
    row, space = np.searchsorted(ends, cuts, side="right"), np.searchsorted(borders, cuts, side="right")
    size = np.diff(np.append(cuts, total))
    pieces = np.stack([rows[row, 0], rows[row, 1] + cuts - (ends - rows[:, 2])[row], size, rows[row, 3], sequence[space], offset[space] + cuts - (borders - room)[space]], axis=1)
    first = int(np.searchsorted(ends, total, side="right"))
    left = rows[first:].copy()
    if len(left):
        used = total - (int(ends[first]) - int(rows[first, 2]))
        left[0, 1] += used
        left[0, 2] -= used
    return pieces, left


class HarmonicBins:
    """The open bins of one task.  Pieces are rows (document, start, length, total), documents being numbers."""

    def __init__(self, capacity: int, first_sequence: int, classes: int = CLASSES):
        self.capacity, self.classes, self.next = capacity, min(classes, capacity), first_sequence
        self.waiting = {k: NOTHING for k in range(1, self.classes + 1)}
        self.filler = NOTHING

    def _sequences(self, n: int) -> np.ndarray:
        self.next += n
        return np.arange(self.next - n, self.next)

    def _bins(self, rests: np.ndarray, kinds: np.ndarray) -> tuple[int, dict[int, np.ndarray]]:
        """The gaps that these rests would leave beside the waiting ones, in tokens, and each class's rests."""
        gap, own = 0, {}
        order = np.argsort(kinds, kind="stable")
        edges = np.searchsorted(kinds[order], np.arange(1, self.classes + 2))
        for k in range(1, self.classes + 1):
            held, new = self.waiting[k], rests[order[edges[k - 1] : edges[k]]]
            own[k] = np.concatenate([held, new]) if len(new) else held
            full = len(own[k]) // k
            gap += full * self.capacity - int(own[k][: full * k, 2].sum())
        return gap, own

    def add(self, documents: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Cuts documents of these lengths and returns the pieces of all bins that are now full, with sequence and offset as two more columns."""
        whole, rest = totals // self.capacity, totals % self.capacity
        rows = np.repeat(np.arange(len(totals)), whole)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(whole) - whole, whole)
        placed = [np.stack([documents[rows], nth * self.capacity, np.full(len(rows), self.capacity), totals[rows], self._sequences(len(rows)), np.zeros(len(rows), np.int64)], axis=1)]
        some = np.flatnonzero(rest)
        rests = np.stack([documents[some], (totals - rest)[some], rest[some], totals[some]], axis=1)
        kinds = self.capacity // rests[:, 2]
        small = kinds > self.classes
        fillers, rests, kinds = np.concatenate([self.filler, rests[small]]), rests[~small], kinds[~small]
        supply, after = int(fillers[:, 2].sum()), np.append(np.cumsum(rests[::-1, 2])[::-1], 0)
        # The most rests whose bins' gaps the other ones and the fillers can fill.
        low, high = 0, len(rests)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self._bins(rests[:middle], kinds[:middle])[0] <= supply + after[middle] else (low, middle - 1)
        _, own = self._bins(rests[:low], kinds[:low])
        fillers = np.concatenate([fillers, rests[low:]])
        spaces = []
        for k, items in own.items():
            full = len(items) // k
            if full:
                taken = items[: full * k]
                ends = np.cumsum(taken[:, 2].reshape(full, k), axis=1)
                sequence = self._sequences(full)
                placed.append(np.concatenate([taken, np.stack([np.repeat(sequence, k), ends.reshape(-1) - taken[:, 2]], axis=1)], axis=1))
                spaces.append(np.stack([sequence, ends[:, -1], self.capacity - ends[:, -1]], axis=1))
            self.waiting[k] = items[full * k :]
        # Fillers beyond the gaps fill sequences of their own.
        gaps = np.concatenate([*spaces, np.zeros((0, 3), np.int64)])
        gaps = gaps[gaps[:, 2] > 0]
        more = (int(fillers[:, 2].sum()) - int(gaps[:, 2].sum())) // self.capacity
        gaps = np.concatenate([gaps, np.stack([self._sequences(more), np.zeros(more, np.int64), np.full(more, self.capacity)], axis=1)])
        pieces, self.filler = laid(fillers, *gaps.T)
        return np.concatenate([*placed, pieces])

    def open(self) -> np.ndarray:
        """What isn't placed yet."""
        return np.concatenate([*self.waiting.values(), self.filler])

    def rest(self) -> np.ndarray:
        """Places what is open in full sequences and sequences of a power of two."""
        left = self.open()
        total, room = int(left[:, 2].sum()), []
        while total:
            room.append(self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1))
            total -= room[-1]
        return laid(left, self._sequences(len(room)), np.zeros(len(room), np.int64), np.array(room, dtype=np.int64))[0]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, vocabulary: str = "byte_bpe_50k.json", with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, the ids.

    A document is its text's ids and then ``end_id``; null and empty texts are that one id.
    Each id lies in one piece.  A sequence's pieces stand without gaps from 0; it is padded
    to ``capacity`` unless its length is a power of two.  Repeated rows are packed as often
    as they occur, rows with a null id too; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer_path(vocabulary))
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << SEQUENCE_BITS)
        held: dict[tuple[int, int], tuple] = {}  # key and ids of pieces whose bins are open, by (document, start)
        shift, kind = 0, None

        def part_of(doc: int, start: int, length: int) -> tuple:
            """Key and ids of a piece whose bin was open."""
            first, key, part = next((s, *held[doc, s]) for s in _starts.get(doc, ()) if s <= start < s + len(held[doc, s][1]))
            return key, part[start - first : start - first + length]

        def rows(placed: np.ndarray, keys: list, ids: np.ndarray | None, ends: np.ndarray | None) -> pa.RecordBatch:
            own_keys, parts = [], []
            for doc, start, length in placed[:, :3].tolist():
                if doc >= shift and ids is not None:
                    key, at = keys[doc - shift], int(ends[doc - shift]) + start
                    part = ids[at : at + length]
                else:
                    key, part = part_of(doc, start, length)
                own_keys.append(key)
                parts.append(part)
            columns = [pa.array(own_keys, kind), pa.array(placed[:, 1]), pa.array(placed[:, 2]), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()), pa.array(placed[:, 3]), pa.array(placed[:, 4]), pa.array(placed[:, 5])]
            names = ["doc_id", *FIELDS]
            if with_ids:
                borders = np.concatenate([[0], np.cumsum(placed[:, 2])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(borders), pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        _starts: dict[int, list[int]] = {}
        for block in bpe.blocks(table, ((b.column(0), data, offsets) for b, data, offsets in chunks(batches, "text"))):
            kind = block.keys.type
            plain, ends = block_ids(table, block)
            counts = np.diff(ends)
            new_ends = ends + np.arange(len(ends))
            ids = np.full(len(plain) + len(counts), end_id, dtype="<u4")
            stays = np.ones(len(ids), dtype=bool)
            stays[new_ends[1:] - 1] = False
            ids[stays] = plain
            keys = block.keys.to_pylist()
            if len(placed := bins.add(shift + np.arange(len(counts)), counts + 1)):
                yield rows(placed, keys, ids, new_ends)
            kept = {}
            for doc, start, length in bins.open()[:, :3].tolist():
                if doc >= shift:
                    at = int(new_ends[doc - shift]) + start
                    kept[doc, start] = keys[doc - shift], ids[at : at + length].copy()
                else:
                    kept[doc, start] = part_of(doc, start, length)
            held = kept
            _starts = {}
            for doc, start in held:
                _starts.setdefault(doc, []).append(start)
            shift += len(counts)
        last = bins.rest()
        if len(last):
            yield rows(last, [], None, None)

    key_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {key_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
