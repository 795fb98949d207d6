"""Byte-level BPE encoding and decoding of document tables.

Merges are replayed over the distinct words of the whole corpus:

1. Tasks split their texts and number the distinct words of every few megabytes (a chunk).  A
   document becomes the numbers of its words; the words themselves are dealt to buckets by hash.
2. A bucket has a word once, however many chunks sent it, and encodes all its words by merge
   replay.  Each chunk gets back, in one row a bucket, its words' ids by their numbers.
3. Documents and their chunk's words come together, and the numbers are replaced by ids.

Chunks and buckets have about the same size whatever the corpus and however often a word occurs.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyweave.llm import bpe
from tallyweave.llm.prefix_counts import vocabulary_file
from tallyweave.llm.shared import partitions, tokenizer_path
from tallyweave.llm.textarrays import chunks, mix, packed, ragged, unpacked


@functools.cache
def word_table(path: str) -> bpe.WordTable:
    """One table for each worker process and vocabulary."""
    return bpe.WordTable(vocabulary_file(path))


def block_ids(table: bpe.WordTable, block: bpe.Block) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block's documents in a row, and each document's offsets."""
    slots = block.slots
    special = slots < -1
    known = np.where(special, 0, slots)
    counts = np.where(special, 1, table.offsets[known + 1] - table.offsets[known]) if len(table.offsets) > 1 else np.ones(len(slots), np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    plain = ~special
    ids = np.empty(int(ends[-1]), dtype=np.int32)
    if special.any():
        ids[ends[:-1][special]] = -2 - slots[special]
        ids[ragged(ends[:-1][plain], counts[plain])] = table.ids[ragged(table.offsets[slots[plain]], counts[plain])]
    elif len(slots):
        ids[:] = table.ids[ragged(table.offsets[slots], counts)]
    return ids, ends[block.first_word]


@functools.cache
def number_texts(path: str) -> list[bytes]:
    return [b"%d" % i for i in range(len(vocabulary_file(path).token_bytes))]


def decode_ids(vocabulary: bpe.Vocabulary, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that ids stand for, and where those of each run of ids (ends) begin."""
    if "decode" not in vocabulary._tables:
        sizes = np.array([len(w) for w in vocabulary.token_bytes], dtype=np.int64)
        vocabulary._tables["decode"] = sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(vocabulary.token_bytes), dtype=np.uint8)
    sizes, heads, data = vocabulary._tables["decode"]
    own = sizes[ids]
    return data[ragged(heads[ids], own)], np.concatenate([[0], np.cumsum(own)])[ends]


CHUNK = 12 << 20  # bytes of text whose words are numbered together


def _narrow(values: np.ndarray) -> np.ndarray:
    """As bytes where all values fit, else as halves of words or words."""
    most = int(values.max()) if len(values) else 0
    return values.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def _widened(raw: np.ndarray, n: int) -> np.ndarray:
    """The n values that ``_narrow`` made these bytes of."""
    return raw.view({1: "u1", 2: "<u2", 4: "<u4"}[len(raw) // n if n else 1]).astype(np.int64)


def _numbered(docs: DataFrame, path: Callable[[], str], buckets: int, most: int, kind: int) -> DataFrame:
    """Rows of words (kind 0; bucket, chunk, blob of the first number, lengths and bytes) or of documents (kind 1; chunk, number, doc_id, blob of word numbers, all lower halves before the upper bytes or halves); numbers beyond the words are special strings.  Number -2 says how many words a chunk has.

    Both kinds come of the same rows, read twice rather than written: numbers follow from a chunk's set of words, and so does
    its name, so words and documents that aren't of the same chunk never meet.
    """
    key_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_file(path())
        nth, waiting, size = None, [], 0
        arrow_key = to_arrow_type(key_type)

        def rows(chunk: int, bucket: list, number: list, keys: pa.Array, blobs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([chunk] * len(blobs), pa.int64()), pa.array(number, pa.int32()), keys, pa.array(blobs, pa.binary())], names=["bucket", "chunk", "number", "doc_id", "blob"])

        def out() -> Iterator[pa.RecordBatch]:
            data = np.concatenate([w[3] for w in waiting])
            lengths = np.concatenate([w[4] for w in waiting])
            ends = np.cumsum(lengths)
            hashes, index, inverse = bpe.distinct_words(data, ends - lengths, ends)
            chunk = int(mix(np.array([hashes.sum(dtype=np.uint64) + np.uint64(nth)])).view(np.int64)[0])
            place = ((hashes >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            edges = np.searchsorted(place[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            # Numbers go by bucket, so a bucket's words need the first one only.
            number_of = np.empty(len(order), dtype=np.int64)
            number_of[order] = np.arange(len(order))
            if kind == 0:
                blobs = []
                for b in some.tolist():
                    own = index[order[edges[b] : edges[b + 1]]]
                    blobs.append(packed(edges[b : b + 2], _narrow(lengths[own]), data[ragged((ends - lengths)[own], lengths[own])]))
                yield rows(chunk, some.tolist(), [-1] * len(some), pa.nulls(len(some), arrow_key), blobs)
                return
            yield rows(chunk, [-1], [-2], pa.nulls(1, arrow_key), [len(index).to_bytes(8, "little")])
            at = number = 0
            for keys, first, own, _, own_lengths, special in waiting:
                words = number_of[inverse[at : at + len(own_lengths)][own]]
                words[special >= 0] = len(index) + special[special >= 0]
                at += len(own_lengths)
                low, high = words.astype("<u2"), (words >> 16).astype("<u2" if len(index) + len(vocabulary.token_bytes) >= 1 << 24 else "u1")
                borders = first.tolist()
                blobs = [low[a:b].tobytes() + high[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)]
                yield rows(chunk, [-1] * len(keys), list(range(number, number + len(keys))), keys, blobs)
                number += len(keys)

        for batch, data, offsets in chunks(batches, "text"):
            if nth is None:
                nth = batch.column(2)[0].as_py() << 24
            starts, ends, first, special = bpe.split_words(data, offsets, vocabulary.special)
            _, index, inverse = bpe.distinct_words(data, starts, ends)
            lengths = (ends - starts)[index]
            waiting.append((batch.column(0), first, inverse, data[ragged(starts[index], lengths)], lengths, special))
            size += len(data)
            if size >= most:
                yield from out()
                nth, waiting, size = nth + 1, [], 0
        if waiting:
            yield from out()

    # A task's own number isn't the same in both reads, a partition's is.
    return docs.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, f"bucket int, chunk long, number int, doc_id {key_type.simpleString()}, blob binary")


def _replayed(words: DataFrame, path: Callable[[], str], buckets: int) -> DataFrame:
    """(chunk, number, doc_id, blob): for each bucket and chunk the range of its words' numbers, how many ids each has, and the ids; number is -1."""
    key_type = words.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_file(path())
        whose, parts = [], []
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whose.append(chunk)
                edges, size, raw = unpacked(raw.as_py(), "<i8", "u1", "u1")
                parts.append((edges, _widened(size, int(edges[1] - edges[0])), raw))
        if not parts:
            return
        data = np.concatenate([p[2] for p in parts])
        lengths = np.concatenate([p[1] for p in parts])
        ends = np.cumsum(lengths)
        _, index, inverse = bpe.distinct_words(data, ends - lengths, ends)
        starts = (ends - lengths)[index]
        size = lengths[index]
        own_ends = np.cumsum(size)
        ids, offsets = bpe.encode_words(vocabulary, data[ragged(starts, size)], own_ends - size, own_ends)
        counts, at = np.diff(offsets), 0
        for chunk, (edges, size, _) in zip(whose, parts, strict=True):
            own = inverse[at : at + len(size)]
            at += len(size)
            blob = packed(edges, _narrow(counts[own]), _narrow(ids[ragged(offsets[own], counts[own])]))
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([-1], pa.int32()), pa.nulls(1, to_arrow_type(key_type)), pa.array([blob], pa.binary())], names=["chunk", "number", "doc_id", "blob"])

    dealt = words.repartitionById(buckets, F.col("bucket")).select("chunk", "blob")
    return dealt.mapInArrow(run, f"chunk long, number int, doc_id {key_type.simpleString()}, blob binary")


def _encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, made: Callable, fields: str, chunk: int = CHUNK) -> DataFrame:
    """What ``made`` (path, keys, ids, borders) makes of documents, some at a time."""
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    buckets, key_type = partitions(docs), docs.schema[id_col].dataType

    def path() -> str:
        return tokenizer_path(vocabulary)

    words = _replayed(_numbered(own, path, buckets, chunk, 0).select("bucket", "chunk", "doc_id", "blob"), path, buckets)
    together = words.union(_numbered(own, path, buckets, chunk, 1).select("chunk", "number", "doc_id", "blob"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers, table, n_words = None, [], None, 0
        keys, held, size = [], [], 0

        def out() -> pa.RecordBatch:
            counts, heads, ids = table
            wide = len(counts) + len(vocabulary_file(path()).token_bytes) >= 1 << 24
            sizes = [len(h) // (4 if wide else 3) for h in held]
            words = np.concatenate([np.frombuffer(h, "<u2", n) for h, n in zip(held, sizes, strict=True)]).astype(np.int64)
            words |= np.concatenate([np.frombuffer(h, "<u2" if wide else "u1", n, 2 * n) for h, n in zip(held, sizes, strict=True)]).astype(np.int64) << 16
            special = words >= len(counts)
            own = np.where(special, 1, counts[np.where(special, 0, words)] if len(counts) else 1)
            ends = np.concatenate([[0], np.cumsum(own)])
            flat = np.empty(int(ends[-1]), dtype=np.int32)
            flat[ends[:-1][special]] = words[special] - len(counts)
            flat[ragged(ends[:-1][~special], own[~special])] = ids[ragged(heads[words[~special]], own[~special])]
            return made(path(), pa.array(keys, key_arrow), flat, ends[np.concatenate([[0], np.cumsum(sizes)])])

        key_arrow = to_arrow_type(key_type)
        for batch in batches:
            for of, number, key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if of != now:
                    if held:
                        yield out()
                        keys, held, size = [], [], 0
                    now, answers, table = of, [], None
                if number == -2:
                    n_words = int.from_bytes(blob.as_py(), "little")
                    continue
                if number == -1:
                    edges, counts, ids = unpacked(blob.as_py(), "<i8", "u1", "u1")
                    counts = _widened(counts, int(edges[1] - edges[0]))
                    answers.append((int(edges[0]), counts, _widened(ids, int(counts.sum()))))
                    continue
                if table is None:
                    answers.sort(key=lambda a: a[0])
                    if sum(len(a[1]) for a in answers) != n_words:
                        raise ValueError("a chunk's words have no ids: its rows weren't the same when they were read again")
                    counts, ids = (np.concatenate([np.zeros(0, np.int64), *(a[k] for a in answers)]) for k in (1, 2))
                    table, answers = (counts, np.cumsum(counts) - counts, ids), []
                keys.append(key)
                held.append(blob.as_py())
                size += len(held[-1])
                if size >= 1 << 20:
                    yield out()
                    keys, held, size = [], [], 0
        if held:
            yield out()

    dealt = together.repartition(buckets, "chunk").sortWithinPartitions("chunk", "number")
    return dealt.mapInArrow(run, f"doc_id {key_type.simpleString()}, {fields}")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", chunk: int = CHUNK) -> DataFrame:
    """One row (doc_id, ids) for each document, ids being those that the vocabulary's own library gives for the whole text.

    Null and empty texts have no ids.  Repeated rows and null ids each keep their row; other
    columns are ignored.  A word that many texts share is encoded once.
    """

    def made(_: str, keys: pa.Array, ids: np.ndarray, borders: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return _encoded(docs, id_col, text_col, vocabulary, made, "ids array<int>", chunk)


def decode(encoded: DataFrame, ids_col: str = "ids", vocabulary: str = "byte_bpe_multi_50k.tiktoken", most: int = 1 << 20) -> DataFrame:
    """Adds ``decoded``, the bytes that the ids stand for; null ids give empty bytes, and an id outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary_file(tokenizer_path(vocabulary))
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(counts)])
            parts = []
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
                raw, borders = decode_ids(words, ids[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
                parts.append(pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(borders.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())]))
                at = to
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(parts) if parts else pa.array([], pa.binary())], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def codec_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the comma-joined ids and of the bytes that they decode to.

    Encodes as ``encode`` does and decodes the ids where they are made.  Null and empty texts have 0 tokens and the digests
    of nothing; repeated rows and null ids each keep their row; other columns are ignored.
    """

    def made(path: str, keys: pa.Array, ids: np.ndarray, borders: np.ndarray) -> pa.RecordBatch:
        numbers = number_texts(path)
        raw, places = decode_ids(vocabulary_file(path), ids, borders)
        raw, ends, places = memoryview(raw), borders.tolist(), places.tolist()
        as_text, decoded = [], []
        for d in range(len(ends) - 1):
            as_text.append(hashlib.sha256(b",".join([numbers[i] for i in ids[ends[d] : ends[d + 1]].tolist()])).hexdigest())
            decoded.append(hashlib.sha256(raw[places[d] : places[d + 1]]).hexdigest())
        return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(borders)), pa.array(as_text, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, id_col, text_col, vocabulary, made, "n_tokens long, ids_sha256 string, decoded_sha256 string", chunk)
