"""Vectorised text primitives shared by the corpus operators.

A batch of texts is one uint8 array of UTF-8 bytes plus document offsets, taken from
Arrow's own buffers.  Words are byte spans; a span's hash comes from prefix sums of a
polynomial modulo the prime 2**61 - 1, so hashing all words of a batch is a few array
operations whatever their lengths.  (Modulo a power of two, strings of the Thue-Morse kind
collide under every base.)  Who must not confuse two spans compares their bytes as well.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PRIME = (1 << 61) - 1
_P = U64(PRIME)
BASES = (0x0C7A9D5E3B1F4862, 0x13E6B0F7A24C98D1)  # drawn at random below PRIME
_LOW31, _LOW30 = U64((1 << 31) - 1), U64((1 << 30) - 1)
RUN = 1 << 23  # bytes over which prefix sums need no reduction
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (in a new array)."""
    h = h ^ (h >> U64(33))
    h *= _M1
    h ^= h >> U64(33)
    h *= _M2
    h ^= h >> U64(33)
    return h


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME (in a new array)."""
    x = (x & _P) + (x >> U64(61))
    np.subtract(x, _P, out=x, where=x >= _P)
    return x


def mod_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME for a, b < PRIME, from products of 31-bit halves."""
    a1, a0, b1, b0 = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    total = (a1 * b1 << U64(1)) + (middle >> U64(30)) + ((middle & _LOW30) << U64(31))
    total += a0 * b0
    return _reduced(total)


def _power_arrays(k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The upper and lower halves of BASES[k]**i (30 and 31 bits), and BASES[k]**-i, for i < n (kept; as long as the longest text so far asks for)."""
    if k not in _powers or len(_powers[k][2]) < n:
        size = -(-n >> 16) << 16
        power, inverse = np.ones(1, U64), np.ones(1, U64)
        while len(power) < size:
            step, back = (U64(pow(BASES[k], e, PRIME)) for e in (len(power), -len(power)))
            more = slice(size - len(power))
            power, inverse = np.concatenate([power, mod_product(power[more], step)]), np.concatenate([inverse, mod_product(inverse[more], back)])
        _powers[k] = (power >> U64(31)).astype(np.uint32), (power & _LOW31).astype(np.uint32), inverse
    return _powers[k]


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by a sort: hashing them, as numpy does by itself, takes many times longer for large arrays."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte as it is."""
    return _LOWER[data]


class Hasher:
    """Hashes of spans of bytes from prefix sums that are made once; ``which`` names the base."""

    def __init__(self, data: np.ndarray, which: int = 0):
        high, low, self.inverse = _power_arrays(which, len(data) + 1)
        values = data.astype(U64) + U64(1)
        self.high, self.low = np.zeros(len(data) + 1, dtype=U64), np.zeros(len(data) + 1, dtype=U64)
        for sums, power in ((self.high, high), (self.low, low)):
            for at in range(0, len(data), RUN):
                run = values[at : at + RUN]
                part = np.cumsum(run * power[at : at + len(run)], out=sums[at + 1 : at + 1 + len(run)])
                if at:
                    part += sums[at] % _P
        self.long = len(data) > RUN

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes; equal spans give equal hashes wherever they stand."""
        if self.long:
            high, low = (_reduced(_reduced(s[ends]) + _P - _reduced(s[starts])) for s in (self.high, self.low))
        else:
            high, low = _reduced(self.high[ends] - self.high[starts]), self.low[ends] - self.low[starts]
        # The upper halves stand for 2**31 times themselves, which is a rotation by 31 of 61 bits.
        total = _reduced(((high & _LOW30) << U64(31)) + (high >> U64(30)) + _reduced(low))
        h = mod_product(total, self.inverse[starts])
        h += (ends - starts).astype(U64) * _M1
        return mix(h)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    return Hasher(data).spans(starts, ends)


def same_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans a[a_starts:][:lengths] and b[b_starts:][:lengths] hold the same bytes (one bool for each)."""
    out = np.ones(len(lengths), dtype=bool)
    full = lengths > 0
    if full.any():
        size = lengths[full]
        differs = a[ragged(a_starts[full], size)] != b[ragged(b_starts[full], size)]
        if differs.any():
            out[full] = ~np.logical_or.reduceat(differs, np.cumsum(size) - size)
    return out


def run_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``inside`` (a bool for each byte value) holds, and each document's first run (one more entry at the end).

    A run never crosses a document's border.
    """
    solid = inside[data]
    border = np.zeros(len(data) + 1, dtype=bool)
    border[offsets] = True
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | border[:-1]))
    after = np.zeros(len(data), dtype=bool)
    if len(data):
        after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't white space, and each document's first word (one more entry at the end)."""
    return run_spans(data, offsets, ~_SPACE)


def flat_strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, raw = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Gives memory that arrays have left back to the system; else a worker that goes on to the next task, or the driver after a training, holds on to all it ever used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into runs of rows of at most ``most`` text bytes (a longer text stands alone), whole rows only."""
    for batch in batches:
        data, offsets = flat_strings(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    release()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lengths[0] entries, then the next run, as one index array."""
    total = int(lengths.sum())
    out = np.ones(total, dtype=np.int64)
    kept = lengths > 0
    starts, lengths = starts[kept], lengths[kept]
    if not total:
        return out
    out[0] = starts[0]
    heads = np.cumsum(lengths)[:-1]
    out[heads] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other behind their lengths in bytes."""
    return b"".join([np.array([a.nbytes for a in arrays], dtype="<i8").tobytes(), *(a.tobytes() for a in arrays)])


def unpacked(raw: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(raw, dtype="<i8", count=len(kinds))
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every document's shingles of ``width`` lower-cased words, in text order and with repeats, and offsets.

    A document of fewer words has its whole sequence as one shingle; one without words has none.
    """
    data = lowered(data)
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    counts = np.diff(first)
    multipliers = mix(np.arange(101, 101 + width, dtype=U64)) | U64(1)
    total = len(words)
    sums = np.zeros(max(total - width + 1, 0), dtype=U64)
    for k in range(width):
        sums += words[k : k + len(sums)] * multipliers[k]
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(out_offsets[-1]), dtype=U64)
    long = counts >= width
    inside = ragged(out_offsets[:-1][long], n[long])
    out[inside] = sums[ragged(first[:-1][long], n[long])]
    for d in np.flatnonzero((counts > 0) & ~long):
        s, c = int(first[d]), int(counts[d])
        out[out_offsets[d]] = (words[s : s + c] * multipliers[:c]).sum(dtype=U64) + U64(c)
    return mix(out), out_offsets
