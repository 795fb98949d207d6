"""Removal of repeated and nearly repeated lines by a segment-partition edit join.

A line goes if an earlier one, by document id and line number, equals it or is within
``max_edits`` edits of it.  Equal lines meet by two hashes modulo 2**61 - 1.  For the others every distinct line is split into
max_edits + 1 segments: two lines within that many edits agree in one segment of the shorter
one, at a place of the longer one that is bound by their lengths.  Segments are entered in an
index under (length, number, hash); each line probes it, for every length that can fit, with
the substrings at the possible places.  A 32-bit sketch of each line's character parities,
of which an edit changes two bits at most, is compared before a pair is passed on, and the
pair is verified by a banded bit-parallel edit distance over the lines themselves.

A key that more than CROWD lines share gives no pairs.  Its lines are compared with the
crowd's PIVOTS earliest ones, part by part; only those that none of these settles are then
compared with the rest of the crowd, part against part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.shared import hub_join, key_filter, partitions, passes, stored, tidy
from tallyweave.llm.textarrays import U64, Hasher, chunks, distinct, mix, ragged

MIN_CHARS, EDIT_CHARS, MAX_EDITS = 1, 20, 2
CROWD, PIVOTS = 256, 64  # lines of one key that are paired, and a crowd's lines that all others are compared with first
LAST = (1 << 63) - 1
REFERENCE = U64((1 << 48) - 1)  # the bits of h1 that name a line in the index
_SECOND = U64(0x5851F42D4C957F2D)
_INK = np.array([not chr(c).isspace() for c in range(0x3002)])  # no white space lies beyond


class Lines:
    """The lines of some documents: spans of code points, hashes, documents and numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lead = (data & 0xC0) != 0x80
        self.at = np.append(np.flatnonzero(lead), len(data))  # byte of each code point
        order = np.concatenate([[0], np.cumsum(lead)])
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        borders = order[offsets]
        breaks = np.flatnonzero(points == 10)
        # A document's lines start at its border and after each of its line breaks.
        counts = np.bincount(np.searchsorted(borders, breaks, side="right") - 1, minlength=len(borders) - 1) + 1
        self.first = np.concatenate([[0], np.cumsum(counts)])
        rest = np.ones(int(self.first[-1]), dtype=bool)
        rest[self.first[:-1]] = False
        self.starts = np.empty(len(rest), dtype=np.int64)
        self.starts[self.first[:-1]] = borders[:-1]
        self.starts[rest] = breaks + 1
        self.doc = np.repeat(np.arange(len(counts)), counts)
        ends = np.empty_like(self.starts)
        last = np.zeros(len(self.starts), dtype=bool)
        last[self.first[1:] - 1] = True
        ends[last] = borders[1:]
        ends[~last] = breaks
        self.ends = ends
        self.number = np.arange(len(self.starts)) - self.first[self.doc]
        self.points = points
        self.data = data
        self.hasher = Hasher(data)
        self.h1 = self.hash(self.starts, self.ends)

    @property
    def length(self) -> np.ndarray:
        return self.ends - self.starts

    def blank(self) -> np.ndarray:
        """Whether a line has no code point but white space."""
        inked = np.concatenate([[0], np.cumsum(_INK[np.minimum(self.points, len(_INK) - 1)])])
        return inked[self.ends] == inked[self.starts]

    def hash(self, starts: np.ndarray, ends: np.ndarray, hasher: Hasher | None = None) -> np.ndarray:
        """Hashes of spans of code points, of their bytes."""
        return (hasher or self.hasher).spans(self.at[starts], self.at[ends])

    def h2(self, which: np.ndarray) -> np.ndarray:
        """Hashes of whole lines under another base."""
        return self.hash(self.starts[which], self.ends[which], Hasher(self.data, 1))

    def sketches(self) -> np.ndarray:
        """32 bits, each the parity of how often the characters of one class occur."""
        bit = np.uint32(1) << (mix(self.points.astype(U64)) >> U64(59)).astype(np.uint32)
        running = np.concatenate([[np.uint32(0)], np.bitwise_xor.accumulate(bit)]) if len(bit) else np.zeros(1, np.uint32)
        return running[self.ends] ^ running[self.starts]


def segments(length: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, start, length) of each of ``parts`` segments of lines; the first ones are the shorter."""
    small, longer = length // parts, length % parts
    for i in range(parts):
        extra = np.maximum(i - (parts - longer), 0)
        yield i, i * small + extra, small + (i >= parts - longer)


def probes(length: np.ndarray, edits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(gap, number, start, length, use): substrings of lines that may equal a segment of a line that is ``gap`` shorter.

    The places follow from both ends: a segment's shift is bound by the edits before it, and by the gap and the edits after it.
    """
    parts = edits + 1
    for gap in range(edits + 1):
        for i, start, size in segments(length - gap, parts):
            low = max(-i, gap - (edits - i))
            high = min(i, gap + (edits - i))
            for shift in range(low, high + 1):
                place = start + shift
                yield gap, i, place, size, (place >= 0) & (place + size <= length) & (size > 0)


def key_of(hashes: np.ndarray, length: np.ndarray, number: int) -> np.ndarray:
    return mix(hashes + length.astype(U64) * U64(0x9E3779B1) + U64((number + 1) * int(_SECOND) % (1 << 64)))


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``.

    Common ends are cut off.  Then one bit vector for each number of errors says on which of
    the band's 2 * edits + 1 diagonals the read part of ``a`` can be aligned; all diagonals
    advance by a few word operations for each character.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # the common beginning, by halving
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low] else (low, middle - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if max(len(a), len(b)) <= edits:
        return True
    width = 2 * edits + 1
    full = (1 << width) - 1
    # Of each character of b the places in the band, bit d for i + d - edits, as they were when i was the second number.
    where: dict[str, tuple[int, int]] = {}
    # Bit d of row e: a[:i] and b[:i + d - edits] are aligned with at most e errors.
    rows = [0] * (edits + 1)
    rows[0] = 1 << edits
    for e in range(1, edits + 1):
        rows[e] = (rows[e - 1] | rows[e - 1] << 1) & full
    size = len(b)
    for j, c in enumerate(b[:edits]):
        bits, _ = where.get(c, (0, 0))
        where[c] = bits | 1 << (j + edits), 0
    for i, c in enumerate(a):
        if i + edits < size:
            enters = b[i + edits]
            bits, then = where.get(enters, (0, i))
            where[enters] = bits >> (i - then) | 1 << (width - 1), i
        bits, then = where.get(c, (0, i))
        match = bits >> (i - then)
        # Diagonals that lie within b after this character.
        last = size - i - 1 + edits
        valid = full if last >= width - 1 else (1 << (last + 1)) - 1 if last >= 0 else 0
        before, made = rows[0], rows[0] & match & valid
        new = [made]
        for e in range(1, edits + 1):
            made = ((rows[e] & match) | before | (before >> 1) | (made << 1)) & valid
            before = rows[e]
            new.append(made)
        rows = new
        if not made:
            return False
    return bool(rows[edits] >> (size - len(a) + edits) & 1)


def _lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, row, line, h1, h2) of every line of ``min_chars`` code points or more that isn't blank; docs has doc, text and row, a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "text"):
            lines = Lines(data, offsets)
            own = np.flatnonzero((lines.length >= min_chars) & ~lines.blank())
            doc, row = (batch.column(k).to_numpy()[lines.doc[own]] for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(row), pa.array(lines.number[own].astype(np.int32)), pa.array(lines.h1[own].view(np.int64)), pa.array(lines.h2(own).view(np.int64))], names=["doc", "row", "line", "h1", "h2"])

    return docs.mapInArrow(run, "doc long, row long, line int, h1 long, h2 long")


def _entries(docs: DataFrame, buckets: int, min_chars: int, edits: int, flush: int = 60_000) -> DataFrame:
    """(bucket, blob): keys (40 bits), line references (48 bits of h1) and sketches; a blob's index entries stand before its probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys, kinds, refs, sketches = (np.concatenate([h[k] for h in held]) for k in range(4))
            bucket = ((keys >> U64(40)) % U64(buckets)).astype(np.int32)
            order = np.lexsort((kinds, bucket))
            keys, kinds, refs, sketches, bucket = keys[order], kinds[order], refs[order], sketches[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            numbers, blobs = [], []
            for b in range(buckets):
                cut = slice(edges[b], edges[b + 1])
                if edges[b] < edges[b + 1]:
                    k, r = keys[cut], refs[cut]
                    n_index = np.array([int((kinds[cut] == 0).sum()), len(k)], dtype="<i8")
                    numbers.append(b)
                    blobs.append(b"".join(x.tobytes() for x in (n_index, k.astype("<u4"), r.astype("<u4"), sketches[cut].astype("<u4"), (r >> U64(32)).astype("<u2"), (k >> U64(32)).astype("<u1"))))
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for _, data, offsets in chunks(batches, "text"):
            lines = Lines(data, offsets)
            own = np.flatnonzero(lines.length >= min_chars)
            own = own[np.unique(lines.h1[own], return_index=True)[1]]
            length, starts = lines.length[own], lines.starts[own]
            refs, sketches = lines.h1[own], lines.sketches()[own]
            for i, at, part in segments(length, edits + 1):
                held.append((key_of(lines.hash(starts + at, starts + at + part), length, i), np.zeros(len(own), np.uint8), refs, sketches))
            for gap, i, at, part, use in probes(length, edits):
                s = starts[use] + at[use]
                held.append((key_of(lines.hash(s, s + part[use]), length[use] - gap, i), np.ones(int(use.sum()), np.uint8), refs[use], sketches[use]))
            size += len(own)
            if size >= flush:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return docs.mapInArrow(run, "bucket int, blob binary")


def _candidates(entries: DataFrame, buckets: int, edits: int, crowd: int) -> DataFrame:
    """(a, b, key): pairs a < b of references whose probe meets the other's index entry and whose sketches allow it, without a key; and with it, b null, the lines of each key that more than ``crowd`` lines share."""

    def rows(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), none if b is None else pa.array(b.view(np.int64)), none if key is None else pa.array(key.view(np.int64))], names=["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for raw in batch.column(1):
                raw = raw.as_py()
                n_index, n = np.frombuffer(raw, "<i8", 2).tolist()
                at = 16
                arrays = []
                for kind in ("<u4", "<u4", "<u4", "<u2", "<u1"):
                    arrays.append(np.frombuffer(raw, kind, n, at))
                    at += n * np.dtype(kind).itemsize
                keys = (arrays[0].astype(U64) | arrays[4].astype(U64) << U64(32)) << U64(1)
                keys[n_index:] |= U64(1)
                parts.append((keys, arrays[1].astype(U64) | arrays[3].astype(U64) << U64(32), arrays[2]))
        if not parts:
            return
        keys, refs, sketches = (np.concatenate([p[k] for p in parts]) for k in range(3))
        del parts
        # Only keys that are both entered and probed matter; the same line from several tasks is one.
        order = np.argsort(keys)
        heads = np.flatnonzero(np.concatenate([[True], keys[order][1:] >> U64(1) != keys[order][:-1] >> U64(1)]))
        ends = np.append(heads[1:], len(keys))
        both = (keys[order[heads]] & U64(1) == 0) & (keys[order[ends - 1]] & U64(1) == 1)
        order = order[ragged(heads[both], (ends - heads)[both])]
        order = order[np.lexsort((refs[order], keys[order]))]
        keys, refs, sketches = keys[order], refs[order], sketches[order]
        if not len(keys):
            return
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (refs[1:] != refs[:-1])])
        probe, keys, refs, sketches = (keys[new] & U64(1)).astype(bool), keys[new] >> U64(1), refs[new], sketches[new]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(heads, len(keys)))
        probed = np.add.reduceat(probe, heads, dtype=np.int64)
        indexed = sizes - probed
        many = np.maximum(probed, indexed) > crowd
        for head, size in zip(heads[many].tolist(), sizes[many].tolist(), strict=True):
            own = distinct(refs[head : head + size])
            yield rows(own, None, np.full(len(own), keys[head]))
        heads, probed, indexed = heads[~many], probed[~many], indexed[~many]
        first = np.repeat(heads, probed)
        count = np.repeat(indexed, probed)
        which = ragged(heads + indexed, probed)
        ends = np.cumsum(count)
        low = 0
        while low < len(which):  # a bounded number of comparisons at a time
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (1 << 20), side="right")))
            left = np.repeat(which[low:high], count[low:high])
            right = ragged(first[low:high], count[low:high])
            close = (refs[left] != refs[right]) & (np.bitwise_count(sketches[left] ^ sketches[right]) <= 2 * edits)
            a, b = refs[left[close]], refs[right[close]]
            if len(a):
                a, b = np.minimum(a, b), np.maximum(a, b)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                yield rows(a[new], b[new], None)
            low = high

    return entries.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "a long, b long, key long").distinct()


def _texts_of(docs: DataFrame, places: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, ref, first, text) of the lines (h1, h2, ref, first) in places, first being where the line stands first.

    Two filters of fixed size, of those documents and of the references, keep most texts from being
    cut and most lines from being shuffled; where they are full more pass, and the join decides.
    """
    spark = docs.sparkSession
    in_docs = spark.sparkContext.broadcast(key_filter(places.select(F.col("first.doc").alias("doc"))))
    in_refs = spark.sparkContext.broadcast(key_filter(places.select("ref")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (batch.filter(pa.array(passes(in_docs.value, batch.column(0).to_numpy()))) for batch in batches)
        for _, data, offsets in chunks(some, "text"):
            lines = Lines(data, offsets)
            own = np.flatnonzero(lines.length >= min_chars)
            own = own[passes(in_refs.value, lines.h1[own] & REFERENCE)]
            own = own[np.unique(lines.h1[own], return_index=True)[1]]
            low, high = lines.at[lines.starts[own]], lines.at[lines.ends[own]]
            raw = data.tobytes()
            texts = pa.array([raw[a:b].decode() for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(lines.h1[own].view(np.int64)), pa.array(lines.h2(own).view(np.int64)), texts], names=["h1", "h2", "text"])

    found = docs.mapInArrow(run, "h1 long, h2 long, text string")
    return found.join(places, ["h1", "h2"]).dropDuplicates(["h1", "h2"])


def _settled(rows: DataFrame, keys: list[str], edits: int) -> DataFrame:
    """(h1, h2) of the asked lines of each group (keys, asked, doc, line, h1, h2, text) that have an earlier line there within ``edits`` edits."""
    n = len(keys)

    def decide(held: list[tuple]) -> pa.RecordBatch:
        raw = [r[5].encode() for r in held]
        lines = Lines(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        sketches = lines.sketches()
        length = np.array([len(r[5]) for r in held])
        order = sorted(range(len(held)), key=lambda k: held[k][1:3])
        place = np.empty(len(held), dtype=np.int64)
        place[order] = np.arange(len(held))
        near = []
        for k, r in enumerate(held):
            if r[0]:
                fits = (place < place[k]) & (np.abs(length - length[k]) <= edits) & (np.bitwise_count(sketches ^ sketches[k]) <= 2 * edits)
                if any(held[o][1:3] < r[1:3] and within(held[o][5], r[5], edits) for o in np.flatnonzero(fits).tolist()):
                    near.append(r[3:5])
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in near], pa.int64()) for k in (0, 1)], names=["h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != now:
                    if len(held) > 1:
                        yield decide(held)
                    held, now = [], row[:n]
                held.append(row[n:])
        if len(held) > 1:
            yield decide(held)

    dealt = rows.select(*keys, "asked", "doc", "line", "h1", "h2", "text").repartition(partitions(rows), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "h1 long, h2 long").distinct()


def _in_crowds(members: DataFrame, edits: int, crowd: int) -> DataFrame:
    """(h1, h2) of the lines of crowds (key, doc, line, h1, h2, text) that have an earlier line there within ``edits`` edits.

    No part holds more than about ``crowd`` asked lines and as many others; the second step's work is the
    unsettled lines times the crowd.
    """

    def parts_of(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias(name))

    def every(name: str):
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    sized = members.join(parts_of(members, "parts"), "key").withColumn("part", F.pmod(F.xxhash64("h1", "h2"), F.col("parts")).cast("int"))
    earliest = sized.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("doc", "line"))).where(F.col("n") <= PIVOTS).drop("n")
    asked = sized.withColumn("asked", F.lit(True))
    by_pivots = stored(_settled(asked.unionByName(earliest.withColumn("part", every("parts")).withColumn("asked", F.lit(False))), ["key", "part"], edits), "settled", few=True)
    left = asked.join(by_pivots, ["h1", "h2"], "left_anti")
    left = left.join(parts_of(left, "left_parts"), "key").withColumn("left_part", F.pmod(F.xxhash64("h2", "h1"), F.col("left_parts")).cast("int"))
    groups = parts_of(left, "n").select("key", F.col("n").alias("left_parts"))
    ask = left.withColumn("part", every("parts")).drop("parts", "left_parts")
    hold = sized.join(groups, "key").withColumn("left_part", every("left_parts")).withColumn("asked", F.lit(False)).drop("parts", "left_parts")
    return by_pivots.union(_settled(ask.unionByName(hold), ["key", "part", "left_part"], edits)).distinct()


def near_pairs(docs: DataFrame, firsts: DataFrame, min_chars: int, edits: int, crowd: int = CROWD) -> DataFrame:
    """(h1, h2) of the lines that have an earlier line within ``edits`` edits, not counting equal ones."""
    buckets = partitions(docs)
    found = stored(_candidates(_entries(docs, buckets, min_chars, edits), buckets, edits, crowd), "pairs", few=True)
    wanted = found.select(F.col("a").alias("ref")).union(found.where("b is not null").select("b")).distinct()
    places = stored(firsts.withColumn("ref", F.col("h1").bitwiseAND(F.lit(int(REFERENCE)))).join(wanted, "ref"), "places", few=True)
    texts = stored(_texts_of(docs, places, min_chars), "texts", few=True)

    def side(name: str) -> DataFrame:
        return texts.select(F.col("ref").alias(name), F.struct("h1", "h2").alias(f"{name}_line"), F.col("first").alias(f"{name}_first"), F.col("text").alias(f"{name}_text"))

    both = found.where("key is null").select("a", "b").join(side("a"), "a").join(side("b"), "b")
    ordered = F.when(F.col("a_first") < F.col("b_first"), F.col("b_line")).otherwise(F.col("a_line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fine = [within(a, b, edits) for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                kept = part.column(2).filter(pa.array(fine, pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.field("h1"), kept.field("h2")], names=["h1", "h2"])

    # Two different lines never have the same first place unless rows share a doc_id; then neither is earlier.
    decided = both.where("a_first <> b_first").select("a_text", "b_text", ordered.alias("later")).mapInArrow(run, "h1 long, h2 long")
    crowded = found.where("key is not null").select("key", F.col("a").alias("ref"))
    if not crowded.isEmpty():
        members = stored(crowded.join(texts, "ref").select("key", "first.doc", "first.line", "h1", "h2", "text"), "crowds", few=True)
        decided = decided.union(_in_crowds(members, edits, crowd))
    return decided.distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, max_edits: int = MAX_EDITS, edit_chars: int = EDIT_CHARS, crowd: int = CROWD) -> DataFrame:
    """The documents with their text less repeated lines, and n_lines and n_removed.

    Lines are what stands between line feeds; those of white space only always stay.  Any other
    line is removed if an earlier one, by smaller (doc_id, line number), equals it or, both being of
    ``edit_chars`` code points or more, is within ``max_edits`` edits of it, whether that
    line itself stays or not.  ``min_chars`` above 1 leaves shorter lines out.
    A null text stays null, an empty one empty (one empty line).  Rows that share a
    doc_id share their line numbers, so repeated rows keep the same lines.  Null ids come after
    all others, as one document.  Ids are integers, or text that is one.  Other columns stay as they are, but columns named n_lines and
    n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    place, row = F.coalesce(docs[id_col].cast("long"), F.lit(LAST)), F.xxhash64(docs[text_col])
    own = docs.select(place.alias("doc"), docs[text_col].alias("text"), row.alias("row"))
    with tidy(docs.sparkSession):
        lines = stored(_lines_of(own, min_chars), "lines", outlive=True)
        firsts = stored(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("c")), "firsts", few=True)
        later = near_pairs(own.select("doc", "text"), firsts.select("h1", "h2", "first"), max(min_chars, edit_chars), max_edits, crowd)
        # Only lines that occur more than once or have an earlier near one can lose occurrences.
        marked = stored(firsts.join(later.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("c > 1 or near"), "marked", outlive=True, few=True)
        total = firsts.agg(F.sum("c")).first()[0] or 0
    gone = hub_join(lines, marked, ["h1", "h2"], total).where(F.coalesce("near", F.lit(False)) | (F.struct("doc", "line") != F.col("first")))
    # Rows of one id and text lose the same lines.  A partition's drops are hashed, so that no task holds its partition's texts to sort them.
    drops = gone.groupBy(F.col("doc").alias("_dedup_doc"), F.col("row").alias("_dedup_row")).agg(F.collect_set("line").alias("_dedup_drops")).hint("shuffle_hash")
    whole = docs.withColumn("_dedup_place", place).withColumn("_dedup_text", row)
    joined = whole.join(drops, (F.col("_dedup_place") == F.col("_dedup_doc")) & (F.col("_dedup_text") == F.col("_dedup_row")), "left").select(*(F.col(f"`{c}`") for c in names), "_dedup_drops")
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                drop, texts = part.column(len(names)), part.column(at)
                counts = pc.add(pc.fill_null(pc.count_substring(texts, "\n"), 0).cast(pa.int64()), 1)
                removed = pc.fill_null(pc.list_value_length(drop), 0).cast(pa.int64())
                columns = list(part.columns[: len(names)])
                touched = np.flatnonzero(removed.to_numpy())
                if len(touched):
                    new = []
                    for k in touched.tolist():
                        gone = set(drop[k].as_py())
                        new.append("\n".join([s for n, s in enumerate(texts[k].as_py().split("\n")) if n not in gone]))
                    columns[at] = pc.replace_with_mask(texts, pa.array(removed.to_numpy() > 0), pa.array(new, texts.type))
                yield pa.RecordBatch.from_arrays([*columns, counts, removed], names=[*names, "n_lines", "n_removed"])

    schema = docs.schema.add("n_lines", "long").add("n_removed", "long")
    return joined.mapInArrow(run, schema)
