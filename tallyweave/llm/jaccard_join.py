"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents are sets of hashed word shingles.  Two sets of sizes n and m that are alike to 0.8
share at least 0.8 * max(n, m) elements, so a document must occur that often in the inverted
lists of another one's shingles.  The search runs in these steps, none of which emits pairs:

1. Equal sets become one class, by a 128-bit sum over their shingles.
2. Of each class the n - T + l shingles of the smallest hashes, l = 0.2 n, are dealt to the
   buckets of an inverted index as packed arrays.  Two linked classes have m = 0.2 * 0.8 n or
   more of these in common.  A bucket knows how many classes a shingle has; only shingles of
   two or more go back to their classes.
3. A class with fewer than m such shingles is linked with nothing.  The others order theirs
   from rare to frequent; all but the last m - 1 are the short lists, and any partner stands
   in one of them.  Only these classes' whole sets are gathered, by a second look at the texts.
4. Connected components over shared short lists are blocks that no link leaves.  In a block
   an inverted index is built by rising set size and each set searches it with DivideSkip:
   the longest lists are only probed by binary search, the short ones are merged on a heap
   that skips ahead to what can still reach T.
5. A block above BLOCK sets is cut into parts (of that size, or more in very large blocks).  Each part is joined with itself and with the
   block's first part; nearly all of a dense group then hangs together.  What isn't in the
   block's largest component is joined, part against part, with the whole block.

Links matter for components only, so sets that already hang together aren't verified again.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.components import components
from tallyweave.llm.shared import hub_join, key_filter, partitions, passes, stored, tidy
from tallyweave.llm.textarrays import U64, chunks, mix, packed, ragged, shingle_hashes, unpacked

BLOCK = 192  # sets that a task joins with as many others
LOW = U64((1 << 40) - 1)
_OTHER = U64(0xA24BAED4963EE407)


def needed(n: int, percent: int) -> int:
    """The overlap that a set of n elements needs with any set that is alike to it."""
    return max(1, -(-n * percent // 100))


def dealt(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's n shingles, those of the smallest hashes, go to the inverted index."""
    least = -(-n * percent // 100)
    return np.minimum(n, n - least - (-n * (100 - percent) // 100))


def in_common(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of these a set has in common with any linked one's at least."""
    return np.maximum(1, -(-(-(-n * percent // 100)) * (100 - percent) // 100))


def chunk_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document, their offsets, and two 64-bit sums that tell sets apart."""
    hashes, starts = shingle_hashes(data, offsets, width)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        hashes[a:b].sort()
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    heads = starts[:-1][starts[:-1] < starts[1:]]
    new[heads] = True
    running = np.concatenate([[0], np.cumsum(new)])
    ends = running[starts]
    hashes = hashes[new]
    sums = np.zeros((2, len(starts) - 1), dtype=U64)
    full = ends[1:] > ends[:-1]
    if len(hashes):
        sums[0, full] = np.add.reduceat(mix(hashes), ends[:-1][full])
        sums[1, full] = np.add.reduceat(mix(hashes ^ _OTHER), ends[:-1][full])
    return hashes, ends, sums[0], sums[1]


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, hi, lo) for each document; hi and lo tell its set from all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "text"):
            _, ends, hi, lo = chunk_sets(data, offsets, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], names=["doc_id", "n_shingles", "hi", "lo"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long")


def _blobs(batches: Iterator[pa.RecordBatch], *kinds: str) -> list[np.ndarray]:
    """The arrays of all rows' last column, joined."""
    parts = [unpacked(raw.as_py(), *kinds) for batch in batches for raw in batch.column(batch.num_columns - 1)]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds)]


def _classes(hi: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal (hi, n) together, and which of the ordered entries begin a class."""
    order = np.lexsort((n, hi))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (n[order][1:] != n[order][:-1])
    return order, new


def posting_blobs(docs: DataFrame, buckets: int, width: int, percent: int, flush: int = 1 << 20) -> DataFrame:
    """(bucket, blob): a blob has sets (hi, n, count) and their shingles of the bucket (40 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            tokens, counts, hi, n = (np.concatenate([h[k] for h in held]) for k in range(4))
            order, new = _classes(hi, n)
            keep = np.zeros(len(hi), dtype=bool)
            keep[order[new]] = True
            keep &= counts > 0
            tokens = tokens[np.repeat(keep, counts)]
            hi, n, counts = hi[keep], n[keep], counts[keep]
            owner = np.repeat(np.arange(len(counts)), counts)
            bucket = ((tokens >> U64(40)) % U64(buckets)).astype(np.int32)
            by = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            numbers, blobs = [], []
            for b in range(buckets):
                own = by[edges[b] : edges[b + 1]]
                if len(own):
                    t, o = tokens[own] & LOW, owner[own]
                    heads = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                    sets = o[heads]
                    numbers.append(b)
                    blobs.append(packed(hi[sets], n[sets].astype("<u4"), np.diff(np.append(heads, len(o))).astype("<u4"), t.astype("<u4"), (t >> U64(32)).astype("<u1")))
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for _, data, offsets in chunks(batches, "text"):
            tokens, ends, hi, _ = chunk_sets(data, offsets, width)
            n = np.diff(ends)
            part = dealt(n, percent)
            held.append((tokens[ragged(ends[:-1], part)], part, hi, n))
            size += int(part.sum())
            if size >= flush:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return docs.mapInArrow(run, "bucket int, blob binary")


def shared_blobs(postings: DataFrame, buckets: int) -> DataFrame:
    """(target, blob): of the shingles that two or more classes have, for each class its own with their list lengths, dealt by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, number = [], None
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                number = b
                parts.append(unpacked(raw.as_py(), "<u8", "<u4", "<u4", "<u4", "<u1"))
        if not parts:
            return
        hi, n, counts, low, high = (np.concatenate([p[k] for p in parts]) for k in range(5))
        del parts
        order, new = _classes(hi, n)
        keep = np.zeros(len(hi), dtype=bool)
        keep[order[new]] = True
        counts = counts.astype(np.int64)
        mine = np.repeat(keep, counts)
        tokens = low[mine].astype(U64) | high[mine].astype(U64) << U64(32)
        hi, n, counts = hi[keep], n[keep], counts[keep]
        owner = np.repeat(np.arange(len(n), dtype=np.int32), counts)
        by = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[by], owner[by]
        heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(heads, len(tokens)))
        lengths = np.repeat(lengths, lengths)
        some = lengths > 1
        tokens, owner, lengths = tokens[some], owner[some], lengths[some]
        if not len(tokens):
            return
        by = np.argsort(owner, kind="stable")
        tokens, owner, lengths = tokens[by], owner[by], lengths[by]
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        counts = np.diff(np.append(heads, len(owner)))
        sets = owner[heads]
        target = (hi[sets] % U64(buckets)).astype(np.int64)
        place = np.repeat(target, counts)
        for t in np.flatnonzero(np.bincount(target)).tolist():
            own, elements = target == t, place == t
            k = tokens[elements]
            blob = packed(hi[sets[own]], n[sets[own]], counts[own].astype("<u4"), np.full(int(own.sum()), number, "<u4"), k.astype("<u4"), (k >> U64(32)).astype("<u1"), lengths[elements].astype("<u4"))
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([blob], pa.binary())], names=["target", "blob"])

    return postings.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "target int, blob binary")


def survivors(shared: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(hi, n, short): the classes that have enough shared shingles, and their short lists' shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi, n, counts, bucket, low, high, lengths = _blobs(batches, "<u8", "<u4", "<u4", "<u4", "<u4", "<u1", "<u4")
        if not len(hi):
            return
        counts = counts.astype(np.int64)
        order, new = _classes(hi, n)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        total = np.bincount(number, weights=counts).astype(np.int64)
        size = n[first].astype(np.int64)
        least = in_common(size, percent)
        lives = total >= least
        keep = np.repeat(lives[number], counts)
        owner = np.repeat(number, counts)[keep]
        tokens = (np.repeat(bucket, counts)[keep].astype(U64) << U64(40)) | (high[keep].astype(U64) << U64(32)) | low[keep].astype(U64)
        by = np.lexsort((tokens, lengths[keep], owner))
        tokens = tokens[by]
        alive = np.flatnonzero(lives)
        ends = np.concatenate([[0], np.cumsum(total[alive])])
        short = total[alive] - least[alive] + 1
        for at in range(0, len(alive), 2000):
            own = slice(at, at + 2000)
            taken = tokens[ragged(ends[:-1][own], short[own])]
            borders = np.concatenate([[0], np.cumsum(short[own])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(borders), pa.array(taken.view(np.int64)))
            rows = first[alive[own]]
            yield pa.RecordBatch.from_arrays([pa.array(hi[rows].view(np.int64)), pa.array(size[alive[own]]), lists], names=["hi", "n", "short"])

    return shared.repartitionById(buckets, F.col("target")).mapInArrow(run, "hi long, n long, short array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, hi, shingles) of the wanted documents (rep, hi); a key filter over their ids keeps the others' texts from being read on."""
    held = docs.sparkSession.sparkContext.broadcast(key_filter(wanted.select("rep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (batch.filter(pa.array(passes(held.value, batch.column(0).to_numpy()))) for batch in batches)
        for batch, data, offsets in chunks(some, "text"):
            tokens, ends, hi, _ = chunk_sets(data, offsets, width)
            raw = [tokens[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hi.view(np.int64)), pa.array(raw, pa.binary())], names=["rep", "hi", "shingles"])

    found = docs.where("doc_id is not null").select(F.col("doc_id").alias("rep"), "text").mapInArrow(run, "rep long, hi long, shingles binary")
    return found.join(wanted, ["rep", "hi"], "left_semi").dropDuplicates(["rep", "hi"])


class Sets:
    """Disjoint sets whose roots are their smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


class DivideSkip:
    """An inverted index of sets that are added by rising size; lists hold their numbers in order."""

    def __init__(self, mu: float = 0.0085):
        self.lists: dict[int, list[int]] = {}
        self.mu = mu

    def add(self, number: int, elements: list[int]) -> None:
        for e in elements:
            held = self.lists.get(e)
            if held is None:
                self.lists[e] = [number]
            else:
                held.append(number)

    def search(self, elements: list[int], least: int, first: int, skip=None) -> Iterator[tuple[int, int]]:
        """(number, occurrences) of the sets from number ``first`` on that occur in ``least`` or more of the elements' lists; ``skip`` may name some that aren't wanted."""
        lists = [held for e in elements if (held := self.lists.get(e)) is not None and held[-1] >= first]
        if len(lists) < least:
            return
        lists.sort(key=len)
        n_long = min(least - 1, int(least / (self.mu * math.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        threshold = least - n_long
        # One entry for each short list: its current number, which list, and where.
        heap = []
        for k, held in enumerate(short):
            at = bisect_left(held, first) if first else 0
            if at < len(held):
                heap.append((held[at], k, at))
        heapq.heapify(heap)
        while len(heap) >= threshold:
            number = heap[0][0]
            popped = []
            while heap and heap[0][0] == number:
                popped.append(heapq.heappop(heap))
            count = len(popped)
            if count >= threshold:
                if skip is None or not skip(number):
                    left = len(long)
                    for held in reversed(long):
                        if count + left < least:
                            break
                        at = bisect_left(held, number)
                        count += at < len(held) and held[at] == number
                        left -= 1
                    if count >= least:
                        yield number, count
                for _, k, at in popped:
                    if at + 1 < len(short[k]):
                        heapq.heappush(heap, (short[k][at + 1], k, at + 1))
            else:
                # No number below the next top can reach the threshold any more.
                for _ in range(min(threshold - 1 - count, len(heap))):
                    popped.append(heapq.heappop(heap))
                if not heap:
                    break
                top = heap[0][0]
                for _, k, at in popped:
                    at = bisect_left(short[k], top, at)
                    if at < len(short[k]):
                        heapq.heappush(heap, (short[k][at], k, at))


def join_block(rows: list[tuple[int, int, np.ndarray, bool, int]], percent: int) -> Sets:
    """Links the sets of one block.

    rows: (name, n, shingles, side, label).  Sets of side False are searched among all, those of side True only among sides False; sets of equal labels aren't compared.
    """
    joined = Sets()
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    index = DivideSkip()
    mates = DivideSkip()  # of side True sets: only sides False look there
    sizes = [r[1] for r in rows]
    for number, (name, n, shingles, side, label) in enumerate(rows):
        least = needed(n, percent)
        elements = shingles.tolist()
        first = bisect_left(sizes, -(-n * percent // 100))

        def skip(other: int, name=name, label=label) -> bool:
            return rows[other][4] == label or joined.root(rows[other][0]) == joined.root(name)

        for where in (index,) if side else (index, mates):
            for other, overlap in where.search(elements, least, first, skip):
                if 100 * overlap >= percent * (n + rows[other][1] - overlap):
                    joined.join(name, rows[other][0])
        (mates if side else index).add(number, elements)
    return joined


def _join_groups(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(u, v) edges that connect what hangs together in each group of rows (keys, rep, n, shingles, side, label)."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def out() -> pa.RecordBatch:
            joined = join_block(held, percent)
            pairs = [(x, joined.root(x)) for x in joined.parent]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                key_rows = zip(*(c.to_pylist() for c in part.columns[:n]), strict=True)
                for key, rep, size, raw, side, label in zip(key_rows, *(c.to_pylist() for c in part.columns[n:]), strict=True):
                    if key != now:
                        if len(held) > 1:
                            yield out()
                        held, now = [], key
                    held.append((rep, size, np.frombuffer(raw, dtype="<u8"), side, label))
        if len(held) > 1:
            yield out()

    dealt = rows.repartition(partitions(rows), *keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "rep", "n", "shingles", "side", "label").mapInArrow(run, "u long, v long")


def _parts(size, block: int):
    """In how many parts a block of that many sets is cut.  Parts grow with the root of the size, so that what is replicated, sets times parts, does too."""
    return F.ceil(size / F.greatest(F.lit(float(block)), 4 * F.sqrt(size))).cast("int")


def linked(records: DataFrame, docs: DataFrame, width: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(node, root) of every record (rep, hi, n, short) that is linked with another; docs has their texts."""
    postings = records.select("rep", F.explode("short").alias("shingle"))
    lists = postings.groupBy("shingle").agg(F.min("rep").alias("v"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    near = postings.join(lists, "shingle").where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()
    blocks = components(near)
    found = stored(records.join(blocks, F.col("rep") == F.col("node")).select(F.col("root").alias("block"), "rep", "hi", "n"), "blocks", few=True)
    members = stored(found.join(whole_sets(docs, found.select("rep", "hi"), width), ["rep", "hi"]).select("block", "rep", "n", "shingles"), "members")
    sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("c")).withColumn("parts", _parts(F.col("c"), block))
    plain = members.join(sizes.where("parts = 1").select("block"), "block")
    own = F.lit(False).alias("side"), F.col("rep").alias("label")
    edges = _join_groups(plain.select("block", "rep", "n", "shingles", *own), ["block"], percent)
    large = members.join(sizes.where("parts > 1").select("block", "parts"), "block").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    if large.isEmpty():
        return components(edges)
    # Each part with itself and the block's first part.
    with_first = large.withColumn("at", F.explode(F.when(F.col("part") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))))
    edges = stored(edges.union(_join_groups(with_first.select("block", "at", "rep", "n", "shingles", *own), ["block", "at"], percent)), "edges", few=True)
    labels = components(edges)
    labelled = large.join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("root", "rep")).drop("node", "root")
    labelled = stored(labelled, "labelled", few=True)
    biggest = labelled.groupBy("block", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("block").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    rest = labelled.join(biggest, "block").where("label <> main").drop("main")
    rest_parts = rest.groupBy("block").agg(_parts(F.count(F.lit(1)), block).alias("rest_parts"))
    rest = rest.join(rest_parts, "block").withColumn("rest_part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rest_parts")).cast("int"))
    one = rest.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "at", "rest_part", "rep", "n", "shingles", F.lit(False).alias("side"), "label")
    two = labelled.join(rest_parts, "block").withColumn("rest_part", F.explode(F.sequence(F.lit(0), F.col("rest_parts") - 1))).select("block", F.col("part").alias("at"), "rest_part", "rep", "n", "shingles", F.lit(True).alias("side"), "label")
    more = _join_groups(one.union(two), ["block", "at", "rest_part"], percent)
    return components(edges.union(more))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, n_shingles (its set's size), component_id (the smallest doc_id reachable by links).

    Two documents are linked when 100 * intersection >= percent * union of their sets of
    distinct shingles of ``width`` words (A-Z lower-cased, words being runs without ASCII white
    space); a document of fewer words has its whole sequence as one shingle.  Null, empty and
    blank texts have no shingle and no link; their component is their own id.  Rows that share
    a doc_id count as one document.  A row with a null id takes no part: its component is null.
    Ids are integers, or text that is one.  Other columns are ignored.
    """
    buckets = partitions(docs)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    with tidy(docs.sparkSession):
        sets = stored(shingle_sets(own, width=width), "sets", outlive=True)
        full = sets.where("n_shingles > 0 and doc_id is not null")
        shared = shared_blobs(posting_blobs(own.where("doc_id is not null").select("text"), buckets, width, percent), buckets)
        classes = stored(full.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("c")), "classes", few=True)
        records = stored(survivors(shared, buckets, percent).join(classes.select("hi", "n", "rep"), ["hi", "n"]).select("rep", "hi", "n", "short"), "records", few=True)
        roots = linked(records, own, width, percent, block)
        named = classes.join(roots, F.col("rep") == F.col("node"), "left").select("hi", "lo", F.coalesce("root", "rep").alias("component_id"), "c")
        named = stored(named, "named", outlive=True, few=True)
    found = hub_join(full, named, ["hi", "lo"], named.agg(F.sum("c")).first()[0] or 0).select("doc_id", "n_shingles", "component_id")
    return found.union(sets.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
