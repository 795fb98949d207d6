"""Token counts of every prefix of a text by dynamic programming, and what follows from them.

For each prefix of a word the table holds the last token of its encoding: the one token
that ends there and is compatible with the last token of the prefix before it.  The count
of a prefix is one more than that shorter prefix's.  Counts of a document's prefixes are
running sums over its words and these tables, and the few prefixes whose end is split otherwise
than the whole text are tabulated with them.  So a truncation or a budget is answered by a
search in the tables, never by encoding again.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyweave.llm import bpe
from tallyweave.llm.shared import tokenizer_path
from tallyweave.llm.textarrays import U64, Hasher, chunks, ragged

LONG_WORD = 64  # longer words are tabulated one by one


def compatible(vocabulary: bpe.Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether encoding two tokens' joined bytes gives those two tokens.

    The merges that made both are undone from the latest; at no moment may a merge across
    the border have been due before the one that is undone.
    """
    heads, tails, made_at = vocabulary.halves()
    fine = np.ones(len(left), dtype=bool)
    active = np.arange(len(left))
    a, b, limit = left.copy(), right.copy(), np.full(len(left), bpe.NONE, dtype=np.int64)
    while len(active):
        rank, _ = vocabulary.lookup(a, b)
        clash = rank < limit
        fine[active[clash]] = False
        ra, rb = made_at[a], made_at[b]
        go = ~clash & ((ra >= 0) | (rb >= 0))
        active, a, b, ra, rb = active[go], a[go], b[go], ra[go], rb[go]
        first = ra > rb
        limit = np.where(first, ra, rb + 1)
        a, b = np.where(first, tails[a], a), np.where(first, b, heads[b])
    return fine


def reachable(vocabulary: bpe.Vocabulary) -> np.ndarray:
    """Tokens that encoding their own bytes gives back."""
    if "reachable" not in vocabulary._tables:
        made_at = vocabulary.halves()[2]
        fine = np.zeros(len(vocabulary.token_bytes), dtype=bool)
        ids = np.flatnonzero([bool(w) and w not in vocabulary.special for w in vocabulary.token_bytes])
        words = [vocabulary.token_bytes[i] for i in ids]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        out, offsets = bpe.merge_replay(vocabulary, np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths)
        single = np.diff(offsets) == 1
        fine[ids[single]] = out[offsets[:-1][single]] == ids[single]
        fine[vocabulary.base] = True
        fine &= (made_at >= 0) | np.isin(np.arange(len(fine)), vocabulary.base)
        vocabulary._tables["reachable"] = fine
    return vocabulary._tables["reachable"]


SLOTS = 18  # bits of a table that tells which last bytes no token has
_SPREAD = U64(0x9E3779B97F4A7C15)


def _slot(values: np.ndarray) -> np.ndarray:
    return (values * _SPREAD) >> U64(64 - SLOTS)


def tokens_by_length(vocabulary: bpe.Vocabulary) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of reachable tokens: whether some token's last bytes have a slot, the last eight bytes of these tokens as numbers in order, and their ids.

    A token of eight bytes or less is its number; longer ones are looked up by hash and compared.
    """
    if "by_length" not in vocabulary._tables:
        ids = np.flatnonzero(reachable(vocabulary)).tolist()
        own: dict[int, list[tuple[int, int]]] = {}
        for i in ids:
            word = vocabulary.token_bytes[i]
            own.setdefault(len(word), []).append((int.from_bytes(word[-8:], "big"), i))
        tables = {}
        for length, pairs in own.items():
            pairs.sort()
            values = np.array([v for v, _ in pairs], dtype=U64)
            slots = np.zeros(1 << SLOTS, dtype=bool)
            slots[_slot(values)] = True
            tables[length] = slots, values, np.array([i for _, i in pairs], dtype=np.int64)
        vocabulary._tables["by_length"] = tables
    return vocabulary._tables["by_length"]


def prefix_table(vocabulary: bpe.Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every non-empty prefix of every word its token count, words one after the other, and the words' offsets."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    text = data[ragged(starts, lengths)]
    count = np.zeros(int(offsets[-1]), dtype=np.int32)
    last = np.full(int(offsets[-1]), -1, dtype=np.int32)
    if not len(text):
        return count, offsets
    real, tables = reachable(vocabulary), tokens_by_length(vocabulary)
    heads = offsets[:-1]
    short = np.flatnonzero(lengths <= LONG_WORD)
    short = short[np.argsort(lengths[short], kind="stable")]
    size = lengths[short]
    hasher = None
    # The eight bytes before each place.
    window = np.zeros(len(text) + 1, dtype=U64)
    for k in range(min(8, len(text))):
        window[k + 1 :] |= text[: len(text) - k].astype(U64) << U64(8 * k)
    for p in range(1, int(size[-1]) + 1 if len(size) else 0):
        open_ = heads[short[np.searchsorted(size, p) :]]  # starts of the words that have this prefix
        before = window[open_ + p]
        for length in range(p, 0, -1):
            if not len(open_):
                break
            if length not in tables:
                continue
            slots, values, ids = tables[length]
            key = before & U64((1 << 8 * length) - 1) if length < 8 else before
            some = np.flatnonzero(slots[_slot(key)])
            key = key[some]
            place = np.searchsorted(values, key)
            place[place == len(values)] = 0
            met = values[place] == key
            some = some[met]
            if not len(some):
                continue
            if length <= 8:
                token = ids[place[met]]
            else:
                to = open_[some] + p
                hasher = hasher or Hasher(text)
                token = vocabulary.token_of(hasher.spans(to - length, to), text, to - length, to)
                met = token >= 0
                met[met] = real[token[met]]
                token, some = token[met], some[met]
            at = open_[some]
            if length < p:
                fine = compatible(vocabulary, last[at + p - length - 1], token)
                some, token, at = some[fine], token[fine], at[fine]
                count[at + p - 1] = count[at + p - length - 1] + 1
            else:
                count[at + p - 1] = 1
            last[at + p - 1] = token
            rest = np.ones(len(open_), dtype=bool)
            rest[some] = False
            open_, before = open_[rest], before[rest]
    for w in np.flatnonzero(lengths > LONG_WORD):
        count[heads[w] : heads[w] + lengths[w]] = _long_word(vocabulary, text[heads[w] : heads[w] + lengths[w]].tobytes(), real)
    return count, offsets


def _long_word(vocabulary: bpe.Vocabulary, word: bytes, real: np.ndarray) -> list[int]:
    """The same table for one long word, prefix by prefix."""
    memory = vocabulary._tables.setdefault("long", {})
    if "ids" not in memory:
        memory["ids"] = {w: i for i, w in enumerate(vocabulary.token_bytes) if w and real[i]}
        memory["ends"] = {w[k:] for w in memory["ids"] for k in range(len(w))}
        memory["fine"] = {}
    ids, ends, fine = memory["ids"], memory["ends"], memory["fine"]
    count, last = [0], [-1]
    for p in range(1, len(word) + 1):
        found = []  # tokens that end here, from the shortest
        low = p - 1
        while low >= 0 and (part := word[low:p]) in ends:
            if (token := ids.get(part)) is not None:
                found.append((low, token))
            low -= 1
        for low, token in reversed(found):
            if low:
                pair = (last[low], token)
                if pair not in fine:
                    if len(fine) > 1_000_000:
                        fine.clear()
                    fine[pair] = bool(compatible(vocabulary, np.array([last[low]]), np.array([token]))[0])
                if not fine[pair]:
                    continue
            count.append(count[low] + 1)
            last.append(token)
            break
    return count[1:]


class DocumentPrefixes:
    """Token counts of every prefix of one text, all of them tabulated when it is made.

    A prefix that ends in a word costs what the words before cost and what the word's table
    says.  Otherwise split, and tabulated apart (``odd_at``, ``odd_count``), are prefixes that end
    with a run of white space which something follows, within a contraction, or within a special string.
    """

    def __init__(self, vocabulary: bpe.Vocabulary, text: bytes):
        self.text, self.data = text, np.frombuffer(text, dtype=np.uint8)
        self.starts, self.ends, _, special = bpe.split_words(self.data, np.array([0, len(text)]), vocabulary.special)
        distinct, index, inverse = bpe.distinct_words(self.data, self.starts, self.ends)
        self.table, offsets = prefix_table(vocabulary, self.data, self.starts[index], self.ends[index])
        self.heads = offsets[:-1][inverse]
        totals = self.table[offsets[1:] - 1][inverse].astype(np.int64) if len(inverse) else np.zeros(0, np.int64)
        totals[special >= 0] = 1
        self.before = np.concatenate([[0], np.cumsum(totals)])
        odd = self._after_space(vocabulary, special) + self._contractions(vocabulary) + self._in_special(vocabulary, special)
        odd = dict(odd)
        self.odd_at = np.array(sorted(odd), dtype=np.int64)
        self.odd_count = np.array([odd[p] for p in self.odd_at.tolist()], dtype=np.int64)
        self.odd_least = np.minimum.accumulate(self.odd_count[::-1])[::-1]

    def _word(self, w: int) -> bytes:
        return self.text[self.starts[w] : self.ends[w]]

    def _after_space(self, vocabulary: bpe.Vocabulary, special: np.ndarray) -> list[tuple[int, int]]:
        """Ends of runs of two or more white-space characters that something follows: such a prefix ends with the run as one word."""
        at = np.flatnonzero((self.data & 0xC0) != 0x80)
        if not len(at):
            return []
        points = np.frombuffer(self.text.decode().encode("utf-32-le"), dtype=np.uint32)
        space = np.concatenate([[False], bpe.code_point_classes()[points] == 3, [False]])
        heads, tails = np.flatnonzero(space[1:] & ~space[:-1]), np.flatnonzero(~space[1:] & space[:-1])
        some = (tails - heads >= 2) & (tails < len(at))
        low, high = at[heads[some]], at[tails[some]]
        first = np.searchsorted(self.starts, low)
        within = special[np.searchsorted(self.starts, high, side="right") - 1] < 0  # a run before a special string is one word anyway
        low, high, first = low[within], high[within], first[within]
        distinct, index, inverse = bpe.distinct_words(self.data, low, high)
        return list(zip(high.tolist(), (self.before[first] + _totals(vocabulary, self.data, low[index], high[index])[inverse]).tolist(), strict=True))

    def _contractions(self, vocabulary: bpe.Vocabulary) -> list[tuple[int, int]]:
        """'r, 'v and 'l, the beginnings of longer contractions, are two words."""
        words = np.frombuffer(b"'rvl", dtype=np.uint8)
        costs = _totals(vocabulary, words, np.arange(4), np.arange(1, 5))
        three = np.flatnonzero((self.ends - self.starts == 3) & (self.data[self.starts] == ord("'"))) if len(self.starts) else []
        cost = dict(zip((b"'re", b"'ve", b"'ll"), costs[0] + costs[1:], strict=True))
        return [(int(self.starts[w]) + 2, int(self.before[w] + cost[self._word(w)])) for w in three if self._word(w) in cost]

    def _in_special(self, vocabulary: bpe.Vocabulary, special: np.ndarray) -> list[tuple[int, int]]:
        """A cut special string is ordinary text and may join the word before it."""
        out, known = [], {}
        for w in np.flatnonzero(special >= 0).tolist():
            low = w
            while low and special[low - 1] < 0:
                low -= 1
                if not self._word(low).decode().isspace():
                    break
            tail = self.text[self.starts[low] : self.ends[w] - 1]
            if tail not in known:
                size = len(self._word(w)) - 1
                own = DocumentPrefixes(vocabulary, tail)
                known[tail] = [own.count(len(tail) - size + k + 1) for k in range(size)]
            out += [(int(self.starts[w]) + 1 + k, int(self.before[low]) + n) for k, n in enumerate(known[tail])]
        return out

    def count(self, n_bytes: int) -> int:
        """Tokens of the text's first ``n_bytes`` bytes (a code point's border)."""
        if n_bytes >= len(self.text):
            return int(self.before[-1])
        if n_bytes <= 0:
            return 0
        k = int(np.searchsorted(self.odd_at, n_bytes))
        if k < len(self.odd_at) and self.odd_at[k] == n_bytes:
            return int(self.odd_count[k])
        w = int(np.searchsorted(self.ends, n_bytes))
        return int(self.before[w + 1]) if n_bytes == self.ends[w] else int(self.before[w] + self.table[self.heads[w] + n_bytes - self.starts[w] - 1])

    def truncate(self, budget: int) -> int:
        """The most bytes, at a code point's border, of a prefix of at most ``budget`` tokens."""
        if self.before[-1] <= budget:
            return len(self.text)
        k = int(np.searchsorted(self.odd_least, budget, side="right")) - 1
        best = int(self.odd_at[k]) if k >= 0 else 0
        # A word's prefixes cost one token at least beside the words before.
        w = int(np.searchsorted(self.before[:-1], budget)) - 1
        while w >= 0 and self.ends[w] > best:
            places = np.arange(self.starts[w] + 1, self.ends[w] + 1)
            costs = self.before[w] + self.table[self.heads[w] : self.heads[w] + len(places)].astype(np.int64)
            costs[-1] = self.before[w + 1]
            fits = (costs <= budget) & ((self.data[places % len(self.data)] & 0xC0) != 0x80) & ~np.isin(places, self.odd_at)
            if fits.any():
                return max(best, int(places[fits][-1]))
            w -= 1
        return best


def _totals(vocabulary: bpe.Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Token counts of whole words, none of them empty."""
    count, offsets = prefix_table(vocabulary, data, starts, ends)
    return count[offsets[1:] - 1].astype(np.int64)


class CountTable(bpe.WordTable):
    """A word table that keeps each distinct word's prefix counts instead of its ids."""

    kind = np.uint32

    def made(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tables = [prefix_table(self.vocabulary, data, starts[cut], ends[cut])[0] for cut in bpe.batched(starts, ends, 1 << 20)]
        return np.concatenate([np.zeros(0, np.int32), *tables]), np.concatenate([[0], np.cumsum(ends - starts)])

    def totals(self) -> np.ndarray:
        return self.ids[self.offsets[1:] - 1].astype(np.int64)


@functools.cache
def vocabulary_file(path: str) -> bpe.Vocabulary:
    return bpe.Vocabulary.from_ranks(path) if path.endswith(".tiktoken") else bpe.Vocabulary.from_json(path)


@functools.cache
def count_table(path: str) -> CountTable:
    """One table for each worker process and vocabulary."""
    return CountTable(vocabulary_file(path))


def truncated(docs: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """One row for each document: doc_id, text cut to the longest beginning of at most ``budget`` tokens, n_tokens of that and n_tokens_whole.

    The cut is read off the prefix tables.  A null text counts as empty; a budget of 0 or less leaves nothing.
    Repeated rows and null ids keep their rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary_file(tokenizer_path(vocabulary))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at, 64), []
                for text in part.column(1).to_pylist():
                    raw = (text or "").encode()
                    prefixes = DocumentPrefixes(words, raw)
                    end = prefixes.truncate(budget)
                    rows.append((raw[:end].decode(), prefixes.count(end), prefixes.count(len(raw))))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "text", "n_tokens", "n_tokens_whole"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, text string, n_tokens long, n_tokens_whole long")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """One row for each document: id, n_bytes, n_tokens, over_limit (n_tokens > limit) and words_within.

    words_within is how many of its leading words fit ``limit`` tokens, read off the same
    prefix sums.  A null text counts as empty: 0 bytes and tokens.  Rows with equal ids or
    texts each get their row; a null id stays null; other columns are ignored, whatever
    their names.  Any text length is counted whole.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = count_table(tokenizer_path(vocabulary))
        pieces = ((batch.column(0), data, offsets) for batch, data, offsets in chunks(batches, "text"))
        for block in bpe.blocks(table, pieces):
            totals = table.totals() if len(table.hashes) else np.zeros(1, np.int64)
            per_word = np.where(block.slots < -1, 1, totals[np.maximum(block.slots, 0)])
            running = np.concatenate([[0], np.cumsum(per_word)])
            first, past = block.first_word[:-1], block.first_word[1:]
            tokens = running[past] - running[first]
            within = np.searchsorted(running, running[first] + limit, side="right") - 1 - first
            yield pa.RecordBatch.from_arrays([block.keys, pa.array(block.n_bytes), pa.array(tokens), pa.array(tokens > limit), pa.array(np.minimum(within, past - first))], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "words_within"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, words_within long")
