"""Byte-level BPE over arrays of words: splitting, corpus-level merge replay and prefix tables.

Texts are split into words by array operations over code-point classes that reproduce the
public splitting pattern (contractions, a blank that joins the next run, white space that
leaves its last character).  Every distinct word of a block is then encoded once.
"""

from __future__ import annotations

import base64
import heapq
import json
import unicodedata
from dataclasses import dataclass, field

import numpy as np

from tallyweave.llm.textarrays import distinct, ragged, same_spans, span_hashes

NONE = np.int32((1 << 31) - 1)  # the rank of a pair that never merges
REPLAY_BYTES = 1 << 20  # of distinct words that one replay takes
SHORT = 32  # bytes of the longest word whose merges are found in a table of its places
# The Unicode White_Space characters.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None


def code_point_classes() -> np.ndarray:
    """For each code point 1 (letter), 2 (number), 3 (white space) or 0."""
    global _classes
    if _classes is None:
        table = np.zeros(0x110000, dtype=np.uint8)
        major = np.frombuffer("".join([x[0] for x in map(unicodedata.category, map(chr, range(0x110000)))]).encode(), dtype=np.uint8)
        table[major == ord("L")] = 1
        table[major == ord("N")] = 2
        table[WHITE_SPACE] = 3
        _classes = table
    return _classes


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _pair_slot(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (_pair_slot(keys) >> np.uint64(2)).view(np.int64)


@dataclass
class Vocabulary:
    """Ids, the bytes of each id, and the mergeable pairs.

    pair_keys: sorted left << 32 | right; pair_ranks, pair_ids: the merge's rank and the id it makes.
    whole: hash-free shortcut, the id of a word that is itself in the vocabulary (rank files), or None.
    special: added strings that are matched before splitting, with their ids.
    """

    token_bytes: list[bytes]
    base: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    whole: bool = False
    special: dict[bytes, int] = field(default_factory=dict)
    _tables: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def _pairs(rows: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.array(rows, dtype=np.int64).reshape(-1, 4)
        keys = a[:, 0] << 32 | a[:, 1]
        order = np.argsort(keys)
        return keys[order], a[order, 2], a[order, 3]

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A file of lines 'base64 rank': any two tokens whose concatenation is a token may merge, at that token's rank."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}
        tokens = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            tokens[rank] = word
        rows = [(ranks[w[:k]], ranks[w[k:]], r, r) for w, r in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks]
        base = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        return cls(tokens, base, *cls._pairs(rows), whole=True)

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        """A tokenizer file with a byte-level vocabulary, a merge list and added special tokens."""
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        value = {symbol: b for b, symbol in enumerate(byte_symbols())}
        ids = model["vocab"]
        special = {x["content"]: x["id"] for x in content.get("added_tokens", [])}
        tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for word, i in ids.items():
            tokens[i] = word.encode() if word in special else bytes(value[c] for c in word)
        rows = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            rows.append((ids[left], ids[right], rank, ids[left + right]))
        base = np.array([ids[symbol] for symbol in byte_symbols()], dtype=np.int64)
        return cls(tokens, base, *cls._pairs(rows), special={k.encode(): v for k, v in special.items()})

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where there is none) and merged id of pairs."""
        keys = left.astype(np.int64) << 32 | right
        if len(keys) > 4096:  # most pairs never merge: a table of slots spares them the search
            some = np.flatnonzero(self._pair_slots()[_pair_slot(keys)])
            ranks, ids = np.full(len(keys), NONE, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
            ranks[some], ids[some] = self._search(keys[some])
            return ranks, ids
        return self._search(keys)

    def _search(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        found = self.pair_keys[at] == keys
        return np.where(found, self.pair_ranks[at], NONE), self.pair_ids[at]

    def _pair_slots(self) -> np.ndarray:
        if "pairs" not in self._tables:
            slots = np.zeros(1 << 20, dtype=bool)
            slots[_pair_slot(self.pair_keys)] = True
            self._tables["pairs"] = slots
        return self._tables["pairs"]

    def pair_buckets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each bucket's pairs begin (one more entry at the end), the pairs and their ranks by bucket, and each rank's id."""
        if "buckets" not in self._tables:
            buckets = _bucket(self.pair_keys)
            order = np.argsort(buckets, kind="stable")
            ids = np.zeros(int(self.pair_ranks.max(initial=-1)) + 1, dtype=np.int32)
            ids[self.pair_ranks] = self.pair_ids
            edges = np.searchsorted(buckets[order], np.arange((1 << 18) + 1)).astype(np.int32)
            self._tables["buckets"] = edges, self.pair_keys[order], self.pair_ranks[order].astype(np.int32), ids
        return self._tables["buckets"]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of pairs, NONE where there is none; symbols below 0 are in no pair."""
        edges, keys, ranks, _ = self.pair_buckets()
        wanted = left.astype(np.int64) << 32 | right
        bucket = _bucket(wanted)
        at, end = edges[bucket], edges[bucket + 1]
        out = np.full(len(wanted), NONE, dtype=np.int32)
        some = np.flatnonzero(at < end)
        while len(some):
            place = at[some]
            hit = keys[place] == wanted[some]
            out[some[hit]] = ranks[place[hit]]
            some = some[~hit]
            at[some] += 1
            some = some[at[some] < end[some]]
        return out

    def byte_ranks(self) -> np.ndarray:
        """Rank of each pair of bytes, the first one times 256 plus the second."""
        if "bytes" not in self._tables:
            self._tables["bytes"] = self.ranks(np.repeat(self.base, 256), np.tile(self.base, 256))
        return self._tables["bytes"]

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of all tokens' bytes, their ids, each id's length, all tokens' bytes and where each id's begin."""
        if "hashes" not in self._tables:
            ids = np.array([i for i, w in enumerate(self.token_bytes) if w and w not in self.special], dtype=np.int64)
            words = [self.token_bytes[i] for i in ids]
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            ends = np.cumsum(lengths)
            data = np.frombuffer(b"".join(words), dtype=np.uint8)
            hashes = span_hashes(data, ends - lengths, ends)
            order = np.argsort(hashes)
            if len(np.unique(hashes)) < len(hashes):
                raise ValueError("two tokens of the vocabulary have the same hash")
            size, heads = np.zeros((2, len(self.token_bytes)), dtype=np.int64)
            size[ids], heads[ids] = lengths, ends - lengths
            self._tables["hashes"] = hashes[order], ids[order], size, data, heads
        return self._tables["hashes"]

    def token_of(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The id of the token that a span's bytes are, found by hash and compared byte by byte, or -1."""
        known, ids, size, bytes_, heads = self.table()
        at = np.searchsorted(known, hashes)
        at[at == len(known)] = 0
        out = np.where(known[at] == hashes, ids[at], -1)
        hit = np.flatnonzero(out >= 0)
        token, lengths = out[hit], (ends - starts)[hit]
        fits = size[token] == lengths
        fits[fits] = same_spans(data, starts[hit[fits]], bytes_, heads[token[fits]], lengths[fits])
        out[hit[~fits]] = -1
        return out

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two tokens that each token is finally merged from (itself where it is a byte) and the rank of that merge (-1 for a byte)."""
        if "halves" not in self._tables:
            n = len(self.token_bytes)
            left, right, rank = np.arange(n), np.arange(n), np.full(n, -1, dtype=np.int64)
            ids = np.array([i for i, w in enumerate(self.token_bytes) if len(w) > 1 and w not in self.special], dtype=np.int64)
            data = np.frombuffer(b"".join(self.token_bytes[i] for i in ids), dtype=np.uint8)
            lengths = np.array([len(self.token_bytes[i]) for i in ids], dtype=np.int64)
            last = merge_replay(self, data, np.cumsum(lengths) - lengths, lengths, history=True)[2]
            made = last[:, 0] >= 0
            left[ids[made]], right[ids[made]], rank[ids[made]] = last[made].T
            self._tables["halves"] = left, right, rank
        return self._tables["halves"]


def split_words(data: np.ndarray, offsets: np.ndarray, special: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts UTF-8 documents into the words of the public pattern.

    Returns starts and ends in bytes, each document's first word (one more entry at the
    end), and for each word -1 or the id of the special string that it is.
    """
    n_docs = len(offsets) - 1
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)  # byte position of each code point
    n = len(at)
    if not n:
        return *(np.zeros(0, np.int64),) * 2, np.zeros(n_docs + 1, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    kind = code_point_classes()[points]
    order = np.cumsum(lead) - 1  # byte position to code point
    border = np.zeros(n + 1, dtype=bool)
    border[-1] = True
    starts_of_docs = offsets[:-1][offsets[:-1] < len(data)]
    border[order[starts_of_docs]] = True
    inside = np.zeros(n, dtype=bool)
    marks: list[tuple[int, int, int]] = []
    if special:
        raw = data.tobytes()
        for text, i in special.items():
            found = raw.find(text)
            while found >= 0:
                first, last = int(order[found]), int(order[found + len(text) - 1])
                if not border[first + 1 : last + 1].any():  # not over a document's border
                    marks.append((first, last + 1, i))
                    found = raw.find(text, found + len(text))
                else:
                    found = raw.find(text, found + 1)
        for first, last, _ in marks:
            border[first] = border[last] = True
            inside[first:last] = True
    change = np.ones(n + 1, dtype=bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= border
    cut = change[:n].copy()
    # White space that something follows: its last character stands alone or joins the next run.
    space = kind == 3
    ends_space = np.flatnonzero(space & change[1:])
    followed = ends_space[~border[ends_space + 1]]
    cut[followed] = True
    blank = points[followed] == 0x20
    cut[followed[blank] + 1] = False
    # Contractions: an apostrophe that starts a word, then s, t, re, ve, m, ll or d.
    quote = np.flatnonzero((points == 0x27) & cut & np.append(change[1:n], False) & ~border[1 : n + 1])
    if len(quote):
        one = points[quote + 1]
        has_two = (quote + 2 < n) & ~border[np.minimum(quote + 2, n)]
        two = np.where(has_two, points[np.minimum(quote + 2, n - 1)], 0)
        # The pattern's contractions.
        short = np.isin(one, [ord("s"), ord("t"), ord("m"), ord("d")])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for taken, length in ((quote[short], 2), (quote[long], 3)):
            cut[taken + 1] = False
            after = taken + length
            after = after[after < n]
            cut[after] |= kind[after] == 1
    special_at = np.full(n, -1, dtype=np.int64) if marks else None
    for first, last, i in marks:
        cut[first:last] = False
        cut[first] = True
        if last < n:
            cut[last] = True
        special_at[first] = i
    heads = np.flatnonzero(cut)
    starts = at[heads]
    ends = np.append(starts[1:], len(data))
    first_word = np.searchsorted(starts, offsets)
    return starts, ends, first_word, (special_at[heads] if marks else np.full(len(heads), -1, dtype=np.int64))


def merge_replay(vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, history: bool = False):
    """Encodes words by applying every merge over all of them in rank order.

    An inverted index leads from a pair's rank to the positions where the pair stands.  The
    lowest rank is taken, all its positions are merged at once (left to right where they
    overlap), and only the pairs with the touched neighbours get new entries.
    Returns ids and offsets; with history also each word's last merge (left, right, rank).
    """
    n_words = len(starts)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    n = int(offsets[-1])
    symbol = vocabulary.base.astype(np.int32)[data[ragged(starts, lengths)]] if n else np.zeros(0, np.int32)
    following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    full = lengths > 0
    following[offsets[1:][full] - 1] = -1
    before[offsets[:-1][full]] = -1
    alive = np.ones(n, dtype=bool)
    rank = np.full(n, NONE, dtype=np.int32)
    made = np.zeros(n, dtype=np.int32)
    final = np.full((n_words, 3), -1, dtype=np.int64)
    owner = np.repeat(np.arange(n_words), lengths) if history else None
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def post(places: np.ndarray) -> None:
        """Looks up the pairs that start at these places and enters them in the index."""
        follows = following[places]
        places = places[follows >= 0]
        found, ids = vocabulary.lookup(symbol[places], symbol[following[places]])
        rank[places], made[places] = found, ids
        some = found < NONE
        places, found = places[some], found[some]
        if not len(places):
            return
        if len(places) > 1:
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
        edges = np.flatnonzero(found[1:] != found[:-1]) + 1
        keys = found[np.concatenate([[0], edges])].tolist()
        bounds = [0, *edges.tolist(), len(places)]
        for k, r in enumerate(keys):
            part = places[bounds[k] : bounds[k + 1]]
            held = index.get(r)
            if held is None:
                index[r] = [part]
                heapq.heappush(heap, r)
            else:
                held.append(part)

    post(np.arange(n, dtype=np.int32))
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        places = parts[0] if len(parts) == 1 else np.concatenate(parts)
        places = places[(rank[places] == r) & alive[places]]
        if not len(places):
            continue
        if len(places) > 1:
            first = places[0]
            if len(parts) > 1 or symbol[first] == symbol[following[first]]:
                places = distinct(places)
            if symbol[first] == symbol[following[first]]:
                chained = np.zeros(len(places), dtype=bool)
                chained[1:] = following[places[:-1]] == places[1:]
                heads = np.maximum.accumulate(np.where(chained, 0, np.arange(len(places))))
                places = places[(np.arange(len(places)) - heads) % 2 == 0]
        right = following[places]
        if history:
            final[owner[places]] = np.stack([symbol[places], symbol[right], np.full(len(places), r)], axis=1)
        symbol[places] = made[places]
        alive[right] = False
        rank[right] = NONE
        rank[places] = NONE
        after = following[right]
        following[places] = after
        some = after >= 0
        before[after[some]] = places[some]
        left = before[places]
        left = left[left >= 0]
        touched = np.concatenate([left, places])
        if len(places) > 1:
            touched = distinct(touched)
        post(touched)
    counts = np.add.reduceat(alive, offsets[:-1][full], dtype=np.int64) if full.any() else np.zeros(0, np.int64)
    per_word = np.zeros(n_words, dtype=np.int64)
    per_word[full] = counts
    out = symbol[alive], np.concatenate([[0], np.cumsum(per_word)])
    return (*out, final) if history else out


def _merge_equals(vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Symbols of words that all have ``size`` bytes: a row for each byte, a column for each word, -1 where the place has gone into one before it.

    Every round makes the first merge of the lowest rank in each word that has one left.  Places
    are linked; row ``size`` stands for the place beyond either end and is in no pair.
    """
    n = len(starts)
    raw = data[starts + np.arange(size)[:, None]]
    symbol = np.full((size + 1, n), -1, dtype=np.int32)
    symbol[:size] = vocabulary.base[raw]
    if size < 2:
        return symbol[:size]
    rank = vocabulary.byte_ranks()[raw[:-1].astype(np.int32) << 8 | raw[1:]].astype(np.int64)
    # Rank and place in one number, so that the least is the first place of the lowest rank.
    key = np.full((size + 1, n), int(NONE) << 6, dtype=np.int64)
    key[: size - 1] = rank << 6 | np.arange(size - 1)[:, None]
    ids = vocabulary.pair_buckets()[3]
    following = np.repeat(np.arange(1, size + 2, dtype=np.int8)[:, None], n, axis=1)
    before = np.repeat(np.concatenate([[size], np.arange(size)]).astype(np.int8)[:, None], n, axis=1)
    symbol, key, following, before = (a.reshape(-1) for a in (symbol, key, following, before))
    lowest = key.reshape(size + 1, n)
    while True:
        least = lowest.min(axis=0)
        word = np.flatnonzero(least < int(NONE) << 6)
        if not len(word):
            return symbol.reshape(size + 1, n)[:size]
        least = least[word]
        place = least & 63
        made = ids[least >> 6]
        at = place * n + word
        right = following[at] * np.int64(n) + word
        after = following[right]
        symbol[at], symbol[right], key[right] = made, -1, int(NONE) << 6
        following[at] = after
        behind, ahead = after * np.int64(n) + word, before[at].astype(np.int64)
        before[behind] = place
        key[at] = vocabulary.ranks(made, symbol[behind]).astype(np.int64) << 6 | place
        key[ahead * n + word] = vocabulary.ranks(symbol[ahead * n + word], made).astype(np.int64) << 6 | ahead


def merged(vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets of words by their merges: short ones of equal length together (``most`` bytes at a time), longer ones by replay."""
    counts, order = np.zeros(len(starts), dtype=np.int64), np.argsort(lengths, kind="stable")
    edges = np.searchsorted(lengths[order], np.arange(1, SHORT + 2))
    whose, parts = [], []
    for size in range(1, SHORT + 1):
        own = order[edges[size - 1] : edges[size]]
        for at in range(0, len(own), most // size):
            words = own[at : at + most // size]
            symbol = _merge_equals(vocabulary, data, starts[words], size).T
            stays = symbol >= 0
            counts[words] = stays.sum(axis=1)
            whose.append(words)
            parts.append(symbol[stays])
    long = order[edges[SHORT] :]
    if len(long):
        ids, offsets = merge_replay(vocabulary, data, starts[long], lengths[long])
        counts[long] = np.diff(offsets)
        whose.append(long)
        parts.append(ids)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(offsets[-1]), dtype=np.int32)
    if whose:
        words = np.concatenate(whose)
        out[ragged(offsets[words], counts[words])] = np.concatenate(parts)
    return out, offsets


def batched(starts: np.ndarray, ends: np.ndarray, most: int = REPLAY_BYTES):
    """Slices of words of at most ``most`` bytes together (a longer word stands alone)."""
    running = np.concatenate([[0], np.cumsum(ends - starts)])
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(running, running[at] + most, side="right")) - 1)
        yield slice(at, to)
        at = to


def encode_words(vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode=merge_replay) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets of words by ``encode`` (``merge_replay`` or ``merged``); rank files take a word that is itself a token whole."""
    parts = [_encode_words(vocabulary, data[starts[cut].min() : ends[cut].max()], starts[cut] - starts[cut].min(), ends[cut] - starts[cut].min(), encode) for cut in batched(starts, ends)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])


def _encode_words(vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
    lengths = ends - starts
    if not vocabulary.whole:
        return encode(vocabulary, data, starts, lengths)
    token = vocabulary.token_of(span_hashes(data, starts, ends), data, starts, ends)
    rest = token < 0
    ids, offsets = encode(vocabulary, data, starts[rest], lengths[rest])
    counts = np.ones(len(starts), dtype=np.int64)
    counts[rest] = np.diff(offsets)
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(out_offsets[-1]), dtype=np.int64)
    out[out_offsets[:-1][~rest]] = token[~rest]
    out[ragged(out_offsets[:-1][rest], counts[rest])] = ids
    return out, out_offsets


class WordTable:
    """Encodings of distinct words, kept between blocks of a worker and started anew beyond ``most`` words or ``most_bytes``.

    Words are found by hash and then compared byte by byte.  A word whose hash another one has
    taken is kept by its bytes, in ``odd``.
    """

    kind = None  # of what is kept: ids, as narrow as the vocabulary allows

    def __init__(self, vocabulary: Vocabulary, most: int = 1_000_000, most_bytes: int = 64 << 20):
        self.vocabulary, self.most, self.most_bytes = vocabulary, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.slots = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=self.kind or (np.uint16 if len(self.vocabulary.token_bytes) <= 1 << 16 else np.uint32))
        self.offsets = np.zeros(1, dtype=np.int64)
        self.data = np.zeros(0, dtype=np.uint8)
        self.borders = np.zeros(1, dtype=np.int64)  # of the slots' bytes
        self.odd: dict[bytes, int] = {}

    def made(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is kept of words, and its offsets."""
        return encode_words(self.vocabulary, data, starts, ends, merged)

    def _append(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Gives slots to words."""
        slots = np.arange(len(starts)) + len(self.offsets) - 1
        ids, offsets = self.made(data, starts, ends)
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        self.offsets = np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
        self.data = np.concatenate([self.data, data[ragged(starts, ends - starts)]])
        self.borders = np.concatenate([self.borders, np.cumsum(ends - starts) + self.borders[-1]])
        return slots

    def learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Adds words whose hashes aren't known yet (hashes must be distinct)."""
        self.slots = np.concatenate([self.slots, self._append(data, starts, ends)])
        self.hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(self.hashes)
        self.hashes, self.slots = self.hashes[order], self.slots[order]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Whether some word has that hash."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=bool)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return self.hashes[at] == hashes

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of words whose hashes are known; a word that isn't the one with its hash gets a slot of its own."""
        slots = self.slots[np.searchsorted(self.hashes, hashes)] if len(hashes) else np.zeros(0, np.int64)
        lengths = ends - starts
        fits = np.diff(self.borders)[slots] == lengths
        fits[fits] = same_spans(data, starts[fits], self.data, self.borders[slots[fits]], lengths[fits])
        for k in np.flatnonzero(~fits).tolist():
            word = data[starts[k] : ends[k]].tobytes()
            if word not in self.odd:
                self.odd[word] = int(self._append(data, starts[k : k + 1], ends[k : k + 1])[0])
            slots[k] = self.odd[word]
        return slots


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places of the distinct words, and for each word which one it is; words are told apart by their bytes, so a hash may occur twice."""
    hashes = span_hashes(data, starts, ends)
    found, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    lengths, first = ends - starts, index[inverse]
    same = lengths == lengths[first]
    same[same] = same_spans(data, starts[same], data, starts[first[same]], lengths[same])
    odd = np.flatnonzero(~same)
    if len(odd):
        words: dict[bytes, int] = {}
        for k in odd.tolist():
            inverse[k] = words.setdefault(data[starts[k] : ends[k]].tobytes(), len(found) + len(words))
        extra = odd[np.unique(inverse[odd], return_index=True)[1]]
        found, index = np.concatenate([found, hashes[extra]]), np.concatenate([index, extra])
    return found, index, inverse


@dataclass
class Block:
    """Documents whose words have slots of a WordTable (or -2 - id for a special string)."""

    keys: list
    first_word: np.ndarray
    slots: np.ndarray
    n_bytes: np.ndarray


def blocks(table: WordTable, pieces, most: int = 12 << 20):
    """Turns (keys, data, offsets) pieces into Blocks; the new words of up to ``most`` bytes are encoded in one replay."""
    waiting, size = [], 0

    def flush():
        nonlocal waiting, size
        if len(table.hashes) > table.most or len(table.data) > table.most_bytes:
            table.clear()
        # The first piece that has a word of a new hash lends its bytes.
        hashes, spans, parts, shift = [], [], [], 0
        for _, _, _, words, heads, data, _, _ in waiting:
            fresh = np.flatnonzero(~table.known(words))
            starts, lengths = heads[fresh], heads[fresh + 1] - heads[fresh]
            parts.append(data[ragged(starts, lengths)])
            ends = np.cumsum(lengths) + shift
            spans.append(np.stack([ends - lengths, ends]))
            hashes.append(words[fresh])
            shift += int(lengths.sum())
        if sum(map(len, hashes)):
            every = np.concatenate(hashes)
            index = np.sort(np.unique(every, return_index=True)[1])  # in the bytes' order, so that parts of them lie together
            both = np.concatenate(spans, axis=1)[:, index]
            table.learn(every[index], np.concatenate(parts), both[0], both[1])
        for keys, first_word, inverse, words, heads, data, special, n_bytes in waiting:
            slots = table.find(words, data, heads[:-1], heads[1:])[inverse]
            slots[special >= 0] = -2 - special[special >= 0]
            yield Block(keys, first_word, slots, n_bytes)
        waiting, size = [], 0

    for keys, data, offsets in pieces:
        starts, ends, first_word, special = split_words(data, offsets, table.vocabulary.special)
        words, index, inverse = distinct_words(data, starts, ends)
        lengths = (ends - starts)[index]
        own = data[ragged(starts[index], lengths)]
        waiting.append((keys, first_word, inverse, words, np.concatenate([[0], np.cumsum(lengths)]), own, special, np.diff(offsets)))
        size += len(data)
        if size >= most:
            yield from flush()
    yield from flush()
