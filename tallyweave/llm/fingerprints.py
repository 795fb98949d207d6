"""Document fingerprints from modular prefix arrays.

For a text c[0..n) the array S[i] = sum of c[j] * B**j for j < i, modulo two primes, gives
the hash of any span in constant time, so two spans are compared without reading them and
longest common extensions are found by binary search.  A fingerprint holds the length, the
whole text's hash, and the smallest mixed hashes of its spans of WINDOW code points, whose
overlap estimates the share of common spans of two texts wherever these lie.  In a short text
an edit touches every such span, so a text whose spans of NARROW code points are KEPT at most
has all of these as well, and two such texts are compared by them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import partitions
from tallyweave.llm.textarrays import U64, distinct, mix

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 911_382_323)
WINDOW = 24  # code points
NARROW = 3  # code points, of short texts' spans
KEPT = 64  # span hashes of one width in a fingerprint
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASES[k]**i and BASES[k]**-i modulo PRIMES[k] for i < n (kept and doubled as needed)."""
    power, inverse = _tables.get(k, (np.ones(1, U64), np.ones(1, U64)))
    p = U64(PRIMES[k])
    while len(power) < n:
        size = len(power)
        step, back = pow(BASES[k], size, PRIMES[k]), pow(BASES[k], -size, PRIMES[k])
        power, inverse = np.concatenate([power, power * U64(step) % p]), np.concatenate([inverse, inverse * U64(back) % p])
    _tables[k] = power, inverse
    return power[:n], inverse[:n]


class PrefixHashes:
    """The prefix arrays of one text."""

    def __init__(self, text: str):
        self.points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        self.n = len(self.points)
        self.sums = [self._extend(k, np.zeros(1, U64), 0, self.points) for k in range(2)]

    @staticmethod
    def _extend(k: int, sums: np.ndarray, at: int, points: np.ndarray) -> np.ndarray:
        """The array of a text that goes on with ``points`` after its first ``at`` code points."""
        p = U64(PRIMES[k])
        terms = (points.astype(U64) + U64(1)) * _powers(k, at + len(points))[0][at:] % p
        return np.concatenate([sums[: at + 1], (np.cumsum(terms) + sums[at]) % p])

    def edited(self, keep: int, tail: np.ndarray) -> PrefixHashes:
        """The arrays of the first ``keep`` code points followed by ``tail``."""
        out = object.__new__(PrefixHashes)
        out.points = np.concatenate([self.points[:keep], tail])
        out.n = len(out.points)
        out.sums = [self._extend(k, self.sums[k], keep, tail) for k in range(2)]
        return out

    def span(self, start: int, length: int) -> tuple[int, int]:
        """The hash of a span, the same wherever its text stands."""
        values = []
        for k in range(2):
            s = self.sums[k]
            gap = (int(s[start + length]) - int(s[start])) % PRIMES[k]
            values.append(gap * pow(BASES[k], -start, PRIMES[k]) % PRIMES[k] if start else gap)
        return values[0], values[1]

    def equal(self, start: int, other: PrefixHashes, other_start: int, length: int) -> bool:
        return self.span(start, length) == other.span(other_start, length)

    def common_extension(self, other: PrefixHashes, start: int = 0, other_start: int = 0) -> int:
        """The length of the longest common extension from two positions, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        if start == other_start == 0:
            (a, b), (c, d) = self.sums, other.sums
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if a[middle] == c[middle] and b[middle] == d[middle] else (low, middle - 1)
            return low
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(start, other, other_start, middle) else (low, middle - 1)
        return low

    def window_hashes(self, width: int = WINDOW) -> np.ndarray:
        """Mixed hashes of all spans of ``width`` code points (of the whole text if it is shorter)."""
        if not self.n:
            return np.zeros(0, U64)
        width = min(width, self.n)
        parts = []
        for k in range(2):
            p, s = U64(PRIMES[k]), self.sums[k]
            parts.append((s[width:] + p - s[: self.n - width + 1]) * _powers(k, self.n - width + 1)[1] % p)
        return mix(parts[0] << U64(32) | parts[1])

    def fingerprint(self) -> str:
        """'length-hash-spans' or, of short texts, 'length-hash-spans-narrow' in hexadecimal; the spans of a width are KEPT values of 32 bits at most, ascending."""
        hashes = self.window_hashes() >> U64(32)
        kept = hashes
        if len(hashes) > KEPT:
            size = min(4 * KEPT, len(hashes))
            while True:
                kept = distinct(np.partition(hashes, size - 1)[:size])
                if len(kept) >= KEPT or size == len(hashes):
                    break
                size = min(4 * size, len(hashes))
        kept = distinct(kept)[:KEPT].astype(">u4")
        whole = self.span(0, self.n)
        out = f"{self.n:x}-{whole[0]:08x}{whole[1]:08x}-{kept.tobytes().hex()}"
        if self.n - NARROW + 1 > KEPT:
            return out
        return f"{out}-{distinct(self.window_hashes(NARROW) >> U64(32)).astype('>u4').tobytes().hex()}"


def likeness(one: str, other: str) -> float:
    """0 to 1 from two fingerprints: twice the common spans over all spans of both, as their samples estimate it (exactly, of two short texts); 1 for equal fingerprints only."""
    if one == other:
        return 1.0
    parts = one.split("-"), other.split("-")
    short = min(map(len, parts)) == 4
    a, b = (np.frombuffer(bytes.fromhex(p[3 if short else 2]), dtype=">u4") for p in parts)
    if not len(a) or not len(b):
        return 0.0
    if short:
        return float(min(2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b)), 0.9999))
    # Of the union's smallest values all are known: those up to the smaller of the two samples' ends, where a sample is not its whole set.
    union = distinct(np.concatenate([a, b]))[:KEPT]
    common = np.isin(union, np.intersect1d(a, b, assume_unique=True)).sum()
    shared = common / len(union)
    return float(min(2 * shared / (1 + shared), 0.9999))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text, place, extra) such that each document and the next one by id lie in one partition, in order.

    Documents are dealt out by ranges of their ids, and each range also gets the first
    document of the next range (the last one the very first), marked as extra.  The ranges'
    limits and first ids are one number for each partition.  Null ids come first.
    """
    n = partitions(docs)
    low = -(1 << 63)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.coalesce(docs[id_col].cast("long"), F.lit(low)).alias("_key"))
    found = own.agg(F.percentile_approx("_key", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0]
    limits = np.unique(np.array(found or [], dtype=np.int64)) if n > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("long")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, key.to_numpy(), side="left"))

    firsts = {r["_range"]: r["_first"] for r in own.select("_key").groupBy(range_of("_key").alias("_range")).agg(F.min("_key").alias("_first")).collect()}
    order = sorted(firsts)
    borders = {firsts[r]: order[i - 1] for i, r in enumerate(order)}  # first id of a range -> the range before it

    keys = np.array(sorted(borders), dtype=np.int64)
    before = np.array([borders[k] for k in keys.tolist()], dtype=np.int64)

    @F.pandas_udf("array<long>")
    def places(key: pd.Series) -> pd.Series:
        values = key.to_numpy()
        at = np.minimum(np.searchsorted(keys, values), max(len(keys) - 1, 0))
        home = np.searchsorted(limits, values, side="left")
        return pd.Series([[h, before[i]] if len(keys) and keys[i] == v else [h] for h, i, v in zip(home, at, values, strict=True)])

    dealt = own.select("doc_id", "text", "_key", F.posexplode(places("_key")).alias("extra", "place"))
    return dealt.repartitionById(n, F.col("place").cast("int")).sortWithinPartitions("place", "extra", "_key", "text").select("doc_id", "text", "place", "extra")


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document about its text, its edited text and the next document's text.

    The edited text has its last floor(n/4) code points replaced by the first as many (or all)
    of the next document by ascending id; the last one's next is the first.  A null text is
    empty; a document alone is its own next; rows of equal ids follow one another by text;
    null ids come before all others.  Other columns are ignored.  Besides the fingerprints and
    their likenesses there are the lengths of the common beginnings, found by binary search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # doc_id, text, arrays, fingerprint, place
        out: list[tuple] = []

        def compare(one, two) -> tuple:
            doc_id, text, arrays, fingerprint, _ = one
            _, after, next_arrays, next_fingerprint, _ = two
            cut = arrays.n // 4
            keep = arrays.n - cut
            changed = arrays.edited(keep, next_arrays.points[:cut])
            changed_fingerprint = changed.fingerprint()
            digest = hashlib.sha256((text[:keep] + after[:cut]).encode()).hexdigest()
            return doc_id, arrays.n, digest, fingerprint, changed_fingerprint, likeness(fingerprint, changed_fingerprint), likeness(fingerprint, next_fingerprint), arrays.common_extension(changed), arrays.common_extension(next_arrays)

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_start_edited", "common_start_next"]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                for doc_id, text, place, extra in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if extra and (held is None or held[4] != place):
                        continue  # a further row with the next range's first id
                    text = text or ""
                    arrays = PrefixHashes(text)
                    row = (doc_id, text, arrays, arrays.fingerprint(), place)
                    if held is not None and held[4] == place:
                        out.append(compare(held, row))
                    held = None if extra else row
                if len(out) >= 256:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_start_edited long, common_start_next long"
    return with_next(docs, id_col, text_col).mapInArrow(run, schema)
