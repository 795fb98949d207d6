import base64
import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from tallyweave.llm import bpe, bpe_codec, packing, prefix_counts  # noqa: E402
from tallyweave.llm.textarrays import span_hashes  # noqa: E402

SPECIAL = "<|endoftext|>"
random.seed(3)
TEXTS = ["", " ", "a", "don't we're I'll 's 'so ''s it's's", "  x  \n\n y\t z ", f"{SPECIAL}ab{SPECIAL} <|endof", "a" * 70, "é’s 12³½ ١٢", "日本 😀😀", "\n'\ns", "\x1c\x85 a", "word " * 3000, "x" * 2500]
TEXTS += ["".join(random.choice("ab 's'lt\n\tré12!?<|>endoftx日  ") for _ in range(random.randrange(60))) for _ in range(300)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (5000, None), (3, TEXTS[3])]


@pytest.fixture(scope="module")
def libraries():
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    one = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    two = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return (lambda s: one.encode(s or "", add_special_tokens=False).ids), (lambda s: two.encode_ordinary(s or ""))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in ROWS], "doc_id long, text string, ids string, n_tokens int").repartition(3).persist()


def test_counts(table, libraries):
    got = sorted(((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in prefix_counts.token_counts(table).collect()))
    want = sorted((i or -1, len((t or "").encode()), n := len(libraries[0](t)), n > 1024) for i, t in ROWS)
    assert got == want


def test_prefixes(libraries):
    vocabulary = bpe.Vocabulary.from_json(P.path("byte_bpe_50k.json"))
    for text in [t[:40] for t in TEXTS[:60]]:
        prefixes = prefix_counts.DocumentPrefixes(vocabulary, text.encode())
        counts = [len(libraries[0](text[:k])) for k in range(len(text) + 1)]
        assert [prefixes.count(len(text[:k].encode())) for k in range(len(text) + 1)] == counts
        for budget in (0, 1, 3):
            assert counts[len(text.encode()[: prefixes.truncate(budget)].decode())] <= budget


def test_codec(table, libraries):
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.codec_digests(table).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i or -1, len(x := libraries[1](t)), sha(",".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in ROWS)
    assert got == want


def test_packing(table, libraries):
    rows = packing.pack(table).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) == r.ids_crc32 and len(r.ids) == r.length > 0
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    total = sum(r.length for r in rows)
    assert padding < 0.02 * total
    wanted = sorted((i if i is not None else -1, [*libraries[0](t), 1]) for i, t in ROWS if i != 3)
    found = []
    for (key, _), pieces in by_doc.items():
        if key != 3:
            ids, at = [], 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at
                ids += r.ids
                at += r.length
            found.append((key if key is not None else -1, ids))
    assert sorted(found) == wanted
    assert sum(r.length for r in rows if r.doc_id == 3) == 2 * (len(libraries[0](TEXTS[3])) + 1)


def test_bins_hold_a_fixed_number_of_their_class():
    rng = np.random.default_rng(4)
    for capacity, longest, batches in ((2048, 6000, 12), (2048, 90, 12), (100, 260, 8), (1, 5, 3)):
        bins, placed, totals = packing.HarmonicBins(capacity, 1000), [], {}
        for batch in range(batches):
            own = rng.integers(1, longest, int(rng.integers(0, 400)))
            names = batch * 1000 + np.arange(len(own))
            totals |= dict(zip(names.tolist(), own.tolist()))
            placed.append(bins.add(names, own))
            assert bins.open()[:, 2].sum() < (bins.classes**2 + 4) * capacity  # what is held doesn't grow
        full = np.concatenate(placed)
        everything = np.concatenate([full, bins.rest()])
        spans, sequences = {}, {}
        for doc, start, length, total, sequence, offset in everything.tolist():
            assert total == totals[doc] and length > 0
            spans.setdefault(doc, []).append((start, length))
            sequences.setdefault(sequence, []).append((offset, length, doc, start, total))
        for doc, total in totals.items():
            at = 0
            for start, length in sorted(spans[doc]):
                assert start == at
                at += length
            assert at == total
        done, of_class = set(full[:, 4].tolist()), 0
        for sequence, pieces in sequences.items():
            at = 0
            for offset, length, *_ in sorted(pieces):
                assert offset == at
                at += length
            assert at == capacity if sequence in done else at <= capacity and at & (at - 1) == 0 or at == capacity
            if sequence in done:
                # A whole piece fills its sequence; a class's bin begins with k uncut rests of class k.
                k = capacity // min(pieces)[1]
                uncut = all(capacity // n == k and s + n == t and n == t % capacity for _, n, _, s, t in sorted(pieces)[:k])
                of_class += min(pieces)[1] == capacity or k <= bins.classes and uncut
        assert of_class >= 0.9 * len(done) or longest < 100
        assert len(everything) <= len(totals) + 2 * len(sequences)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    for f in (prefix_counts.token_counts, bpe_codec.codec_digests, packing.pack):
        assert f(empty).collect() == []


def thue_morse(n, a, b):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.mark.parametrize("letters", ["ab", "es", "th"])
def test_strings_that_collide_modulo_powers_of_two(spark, libraries, letters):
    texts = [t for n in (512, 1024, 2048, 4096, 8192) for t in thue_morse(n, *letters)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    assert {r.doc_id: r.n_tokens for r in prefix_counts.token_counts(docs).collect()} == {i: len(libraries[0](t)) for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in bpe_codec.encode(docs).collect()} == {i: libraries[1](t) for i, t in enumerate(texts)}
    ids = {}
    for r in packing.pack(docs).collect():
        ids.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert {i: [x for _, part in sorted(parts) for x in part] for i, parts in ids.items()} == {i: [*libraries[0](t), 1] for i, t in enumerate(texts)}


def test_colliding_hashes_change_nothing(libraries, monkeypatch):
    """Words that share a hash are told apart by their bytes."""
    vocabulary = bpe.Vocabulary.from_json(P.path("byte_bpe_50k.json"))
    vocabulary.table()
    few = lambda data, starts, ends: span_hashes(data, starts, ends) % np.uint64(7)
    monkeypatch.setattr(bpe, "span_hashes", few)
    table = bpe.WordTable(vocabulary)
    raw = [t.encode() for t in TEXTS]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    pieces = [(list(range(a, b)), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in ((0, 100), (100, len(raw)))]
    for block in bpe.blocks(table, pieces, most=1 << 10):
        ids, ends = bpe_codec.block_ids(table, block)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [libraries[0](TEXTS[k]) for k in block.keys]
    assert table.odd


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"])
def test_merges_of_short_words(vocabulary):
    """Words of one length that are merged together get the ids that the replay by rank gives them."""
    vocabulary = prefix_counts.vocabulary_file(P.path(vocabulary))
    draw = random.Random(7)
    tokens = [w for w in vocabulary.token_bytes if w]
    words = [b"", b"a" * 31, b"a" * 32, b"a" * 33, b"ab" * 20, "日本語の".encode() * 5, bytes(range(256))]
    words += [bytes(draw.choice(b"aabst ein\xc3\xa9") for _ in range(draw.randrange(45))) for _ in range(3000)]
    words += [b"".join(draw.choices(tokens, k=draw.randrange(1, 5))) for _ in range(3000)] + draw.sample(tokens, 3000)
    lengths = np.array([len(w) for w in words])
    data, starts = np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(lengths) - lengths
    want, borders = bpe.merge_replay(vocabulary, data, starts, lengths)
    for most in (64, 1 << 16):
        ids, ends = bpe.merged(vocabulary, data, starts, lengths, most)
        assert ids.tolist() == want.tolist() and ends.tolist() == borders.tolist()


def test_short_words_of_packed_texts_are_not_replayed(libraries, monkeypatch):
    """The replay by rank, whose steps are as many as there are ranks, is left to long words (round 3: op 4's time)."""
    texts = [t for t in TEXTS if max(map(len, t.encode().split()), default=0) < 16 and len(t) < 60]
    monkeypatch.setattr(bpe, "merge_replay", None)
    table = bpe.WordTable(prefix_counts.vocabulary_file(P.path("byte_bpe_50k.json")))
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    (block,) = bpe.blocks(table, [(list(range(len(raw))), np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)])
    ids, ends = bpe_codec.block_ids(table, block)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [libraries[0](t) for t in texts]


def test_budgets_are_answered_without_encoding(libraries, monkeypatch):
    vocabulary = bpe.Vocabulary.from_json(P.path("byte_bpe_50k.json"))
    texts = [t[:60] for t in TEXTS] + [f"!!{SPECIAL}", f"a  {SPECIAL}b  {SPECIAL}", f"'{SPECIAL}'re{SPECIAL}", "they're we've I'll 're", f"  {SPECIAL}  x", "　　x  é"]
    made = [prefix_counts.DocumentPrefixes(vocabulary, t.encode()) for t in texts]
    long = prefix_counts.DocumentPrefixes(vocabulary, b"x" * 100_000)
    for name in ("merge_replay", "split_words", "encode_words"):
        monkeypatch.setattr(bpe, name, None)
    monkeypatch.setattr(prefix_counts, "prefix_table", None)
    for text, prefixes in zip(texts, made, strict=True):
        counts = [len(libraries[0](text[:k])) for k in range(len(text) + 1)]
        assert [prefixes.count(len(text[:k].encode())) for k in range(len(text) + 1)] == counts
        for budget in (0, 1, 2, 3, 5, 8, 13, 100):
            assert prefixes.truncate(budget) == len(text[: max(k for k, c in enumerate(counts) if c <= budget)].encode())
    begun = time.time()
    for budget in (0, 1, 200, 3000):
        end = long.truncate(budget)
        assert long.count(end) <= budget < long.count(end + 1)
        assert long.count(end) == len(libraries[0]("x" * end))
    assert time.time() - begun < 1


def test_truncated(table, libraries):
    got = sorted((r.doc_id or -1, r.text, r.n_tokens, r.n_tokens_whole) for r in prefix_counts.truncated(table, 5).collect())
    assert sorted((i, n) for i, _, _, n in got) == sorted((i or -1, len(libraries[0](t))) for i, t in ROWS)
    assert all(n == len(libraries[0](text)) <= 5 for _, text, n, _ in got)


@pytest.mark.parametrize("chunk", [1, 300, 1 << 20])
def test_words_of_many_chunks(table, libraries, chunk):
    """The corpus's words are encoded once and come back to every chunk, special strings too."""
    for vocabulary, library in (("byte_bpe_50k.json", libraries[0]), ("byte_bpe_multi_50k.tiktoken", libraries[1])):
        got = sorted((r.doc_id or -1, r.ids) for r in bpe_codec.encode(table, vocabulary=vocabulary, chunk=chunk).collect())
        assert got == sorted((i or -1, library(t)) for i, t in ROWS)
    names = table.selectExpr("cast(doc_id as string) as name", "text as body")
    back = bpe_codec.decode(bpe_codec.encode(names, "name", "body", chunk=chunk))
    assert sorted((r.doc_id or "", bytes(r.decoded).decode()) for r in back.collect()) == sorted(("" if i is None else str(i), t or "") for i, t in ROWS)


def test_a_word_is_encoded_once(spark):
    """What a bucket replays doesn't grow with how often a word occurs."""
    rows = [(i, "common words " * 200 + f"own{i}") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    words, numbers = (bpe_codec._numbered(docs, lambda: P.path("byte_bpe_multi_50k.tiktoken"), 4, 1 << 20, kind) for kind in (0, 1))
    assert numbers.where("number >= 0").count() == 64 and words.count() <= 8 * 4
    assert words.selectExpr("sum(length(blob))").first()[0] < 8 * 4 * 200 + 64 * 20
    assert {r.chunk for r in words.collect()} == {r.chunk for r in numbers.collect()}


def test_rows_that_changed_between_two_reads_are_seen(spark):
    """The ids of one text's words never go to another text."""
    import itertools

    turns = itertools.count()
    real = bpe_codec._numbered

    def other(docs, path, buckets, most, kind):
        return real(docs.selectExpr("doc_id", f"concat(text, ' x{next(turns)}') as text"), path, buckets, most, kind)

    bpe_codec._numbered = other
    try:
        with pytest.raises(Exception, match="weren't the same"):
            bpe_codec.encode(spark.createDataFrame([(1, "some words")], "doc_id long, text string")).collect()
    finally:
        bpe_codec._numbered = real
