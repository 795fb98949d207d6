import hashlib
import random

from tallyweave.llm.fingerprints import BASES, KEPT, NARROW, PRIMES, WINDOW, PrefixHashes, edit_fingerprints, likeness

random.seed(4)


def test_spans_and_extensions():
    a, b = "".join(random.choices("ab", k=400)), "".join(random.choices("ab", k=300))
    x, y = PrefixHashes(a), PrefixHashes(b)
    for _ in range(500):
        i, j, n = random.randrange(390), random.randrange(290), random.randrange(10)
        assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
        common = 0
        while i + common < len(a) and j + common < len(b) and a[i + common] == b[j + common]:
            common += 1
        assert x.common_extension(y, i, j) == common
    z = PrefixHashes("same " * 50 + "x")
    assert z.common_extension(PrefixHashes("same " * 50 + "y")) == 250
    tail = PrefixHashes("日本").points
    assert x.edited(100, tail).fingerprint() == PrefixHashes(a[:100] + "日本").fingerprint()


def test_likeness():
    words = ["".join(random.choices("abcdefgh", k=6)) for _ in range(400)]
    text = " ".join(words)
    f = PrefixHashes(text).fingerprint()
    assert likeness(f, f) == 1 and likeness(f, PrefixHashes("").fingerprint()) == 0
    near = PrefixHashes("more " + text).fingerprint()
    other = PrefixHashes(" ".join("".join(random.choices("abcdefgh", k=6)) for _ in range(400))).fingerprint()
    assert likeness(f, near) > 0.9 and likeness(f, other) < 0.05
    half = PrefixHashes(" ".join(words[:200] + ["".join(random.choices("abcdefgh", k=6)) for _ in range(200)])).fingerprint()
    assert 0.25 < likeness(f, half) < 0.75
    assert PrefixHashes("").fingerprint() == PrefixHashes("").fingerprint() != PrefixHashes("a").fingerprint()


def brute(rows):
    order = sorted(rows, key=lambda r: ((-1 << 63) if r[0] is None else r[0], r[1] is not None, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + u[:cut]
        one, two, three = (PrefixHashes(s).fingerprint() for s in (t, edited, u))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), one, two, likeness(one, two), likeness(one, three)))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, place string").repartition(3)
    got = [tuple(r)[:7] for r in edit_fingerprints(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_query_shape(spark):
    rows = [(random.randrange(10**12), "".join(random.choices("abcde é日", k=random.randrange(300)))) for _ in range(200)]
    check(spark, rows)
    check(spark, rows + [(None, "null"), (5, None), (6, ""), (7, "long " * 20_000), rows[0], rows[0]])
    check(spark, [(1, "alone here")])
    check(spark, [(1, "abcdefgh"), (2, "x")])
    assert edit_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_short_texts_by_exact_measure(spark):
    def spans(text):
        return {text[i : i + 3] for i in range(max(len(text) - 2, 1))}

    rows = [(n, "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=n))) for n in range(4, 100)]
    got = {r.doc_id: r for r in edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (n, text), (_, after) in zip(rows, rows[1:]):
        one, two = spans(text), spans(text[: n - n // 4] + after[: n // 4])
        exact = 2 * len(one & two) / (len(one) + len(two))
        if n <= 66:
            assert abs(got[n].near_edited - exact) < 1e-9
        assert got[n].near_edited > got[n].near_next + 0.25 and got[n].near_edited >= 0.4


def plain_fingerprint(text):
    """The fingerprint span by span, each hashed on its own by whole numbers."""
    full = (1 << 64) - 1

    def mix(h):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = ((h ^ h >> 33) * m) & full
        return h ^ h >> 33

    def values(part):
        return [sum((ord(c) + 1) * pow(base, j, prime) for j, c in enumerate(part)) % prime for base, prime in zip(BASES, PRIMES)]

    def spans(width):
        width = min(width, len(text))
        hashes = {mix(a << 32 | b) >> 32 for a, b in (values(text[k : k + width]) for k in range(len(text) - width + 1))} if text else set()
        return "".join(f"{h:08x}" for h in sorted(hashes)[:KEPT])

    out = "-".join([f"{len(text):x}", "{:08x}{:08x}".format(*values(text)), spans(WINDOW)])
    return out if len(text) - NARROW + 1 > KEPT else out + "-" + spans(NARROW)


def test_fingerprints_by_brute_force():
    texts = ["", "a", "日本", "ab" * 13, "x" * 66, "y" * 67, "z" * 500] + ["".join(random.choices("abcde é日", k=random.randrange(400))) for _ in range(40)]
    for text in texts:
        assert PrefixHashes(text).fingerprint() == plain_fingerprint(text), text
        keep, tail = len(text) - len(text) // 4, PrefixHashes("tail 日本" * 9)
        assert PrefixHashes(text).edited(keep, tail.points).fingerprint() == plain_fingerprint(text[:keep] + "tail 日本" * 9)


def test_likeness_is_that_of_the_span_sets():
    """Against the exact share of common spans: short texts exactly, longer ones within what 64 kept spans can tell."""
    gaps = []
    for _ in range(120):
        n = random.randrange(4, 1500)
        text = "".join(random.choices("abcdefgh ", k=n))
        other = text[: n - n // 4] + "".join(random.choices("abcdefgh ", k=n // 4)) if random.random() < 0.7 else "".join(random.choices("abcdefgh ", k=n))
        short = max(len(text), len(other)) - NARROW + 1 <= KEPT
        width = NARROW if short else WINDOW
        a, b = ({t[k : k + min(width, len(t))] for k in range(len(t) - min(width, len(t)) + 1)} for t in (text, other))
        exact = 2 * len(a & b) / (len(a) + len(b))
        gap = abs(likeness(PrefixHashes(text).fingerprint(), PrefixHashes(other).fingerprint()) - exact)
        assert gap < (1e-3 if short else 0.3)
        gaps.append(gap)
    assert sum(gaps) / len(gaps) < 0.05
