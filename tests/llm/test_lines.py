import random
import time

import numpy as np
import pytest

from tallyweave.llm import line_dedup as ld

random.seed(8)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for k, y in enumerate(b, 1):
            new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b, edits):
    """Whether the distance is at most ``edits``, row by row within the band."""
    if abs(len(a) - len(b)) > edits:
        return False
    row = {k: k for k in range(min(edits, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for k in range(max(0, i - edits), min(len(b), i + edits) + 1):
            new[k] = min(row.get(k, 99) + 1, new.get(k - 1, 99) + 1, row.get(k - 1, 99) + (k > 0 and x != b[k - 1]))
        row = new
        if min(row.values()) > edits:
            return False
    return row.get(len(b), 99) <= edits


def mutated(s, n, letters="abcé日"):
    s = list(s)
    for _ in range(n):
        at = random.randrange(len(s) + 1)
        kind = random.randrange(3)
        if kind == 0:
            s.insert(at, random.choice(letters))
        elif s and kind == 1:
            s.pop(min(at, len(s) - 1))
        elif s:
            s[min(at, len(s) - 1)] = random.choice(letters)
    return "".join(s)


def test_within():
    for _ in range(4000):
        a = "".join(random.choices("abé", k=random.randrange(14)))
        b = mutated(a, random.randrange(5))
        for edits in (0, 1, 2, 3):
            assert ld.within(a, b, edits) == (distance(a, b) <= edits) == near(a, b, edits), (a, b, edits)


def test_lines_are_those_of_split():
    texts = ["", "a", "\n", "a\n", "\na", "é日\n\nx\n", "", "", "long line\nb", ""]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    lines = ld.Lines(np.frombuffer(data, dtype=np.uint8), offsets)
    got = [[data[lines.at[lines.starts[k]] : lines.at[lines.ends[k]]].decode() for k in range(lines.first[d], lines.first[d + 1])] for d in range(len(texts))]
    assert got == [t.split("\n") for t in texts]


def brute(rows, min_chars, edits, edit_chars=None):
    """Lines of ``edit_chars`` (by default ``min_chars``) or more also go where an earlier one is near."""
    edit_chars = min_chars if edit_chars is None else edit_chars
    counts = lambda s: len(s) >= min_chars and s.strip()
    lines = sorted((float("inf") if i is None else i, n, s) for i, t in rows for n, s in enumerate((t or "").split("\n")) if counts(s))
    first = {}
    for i, n, s in lines:
        first.setdefault(s, (i, n))
    long = [s for s in first if len(s) >= edit_chars]
    bad = {s for s in long for u in long if u != s and first[u] < first[s] and near(s, u, edits)}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 1, 0))
            continue
        own = t.split("\n")
        kept = [s for n, s in enumerate(own) if not counts(s) or not (s in bad or first[s] < (float("inf") if i is None else i, n))]
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [256, 2])
def test_dedup_by_brute_force(spark, crowd):
    base = ["".join(random.choices("abcdefgh é日", k=random.randrange(5, 40))) for _ in range(40)]
    pool = base + [mutated(random.choice(base), random.randrange(1, 4)) for _ in range(80)]
    rows = [(i, "\n".join(random.choices(pool, k=random.randrange(0, 6)))) for i in range(120)]
    rows += [(None, base[0]), (None, None), (500, None), (501, ""), (502, "\n\n"), (503, "x" * 900), (504, "x" * 899 + "y"), (3, rows[3][1])]
    random.shuffle(rows)
    df = spark.createDataFrame([(i, 9, t, 1.5, "c") for i, t in rows], "doc_id long, n_removed int, text string, line double, doc string").repartition(4)
    for edits, min_chars in ((2, 12), (1, 8), (0, 20), (3, 16)):
        out = ld.dedup_lines(df, min_chars=min_chars, max_edits=edits, edit_chars=min_chars, crowd=crowd)
        assert out.columns == ["doc_id", "text", "line", "doc", "n_lines", "n_removed"]
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str) == brute(rows, min_chars, edits)


def test_empty(spark):
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_short_repeats_go_and_blanks_stay(spark):
    rows = [(1, "Les.\n\n \t\nLes."), (2, "Les.\n\n\u3000\nLet."), (3, "\n \t\nonly here"), (4, "Let.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, r.n_removed) for r in ld.dedup_lines(df).collect()}
    # Equal short lines go, near ones ("Let.") don't.
    assert got == {1: ("Les.\n\n \t", 1), 2: ("\n\u3000\nLet.", 1), 3: ("\n \t\nonly here", 0), 4: ("", 1)}


def test_query_removes_every_repeat(spark):
    from tallyweave.llm import queries

    sf = "/root/testdata/sf0.001"
    lines = [s for r in queries.op6_line_dedup(spark, sf).collect() for s in r.deduplicated.split("\n") if s.strip()]
    assert len(lines) == len(set(lines))


def test_defaults_by_brute_force(spark):
    """Every line that isn't blank, near ones from 20 code points on; ids that are text, nulls that repeat."""
    pool = ["".join(random.choices("abcdefgh é日", k=random.randrange(1, 40))) for _ in range(30)]
    pool += [mutated(random.choice(pool), random.randrange(1, 4)) for _ in range(60)] + ["", " ", "\t\u3000"]
    rows = [(i, "\n".join(random.choices(pool, k=random.randrange(0, 8)))) for i in range(90)] + [(None, "\n".join(random.choices(pool, k=6))) for _ in range(12)]
    for kind in ("long", "string"):
        df = spark.createDataFrame([(i if i is None or kind == "long" else str(i), t) for i, t in rows], f"doc_id {kind}, text string").repartition(5)
        got = sorted(((None if r.doc_id is None else int(r.doc_id), r.text, r.n_lines, r.n_removed) for r in ld.dedup_lines(df).collect()), key=str)
        # Null ids are one document with line numbers of its own for each row, so rows that share a first place keep it.
        assert got == brute(rows, 1, 2, 20)


def test_families_of_near_lines_make_no_pairs(spark, monkeypatch):
    """600 lines of one template: their common keys are crowds, and the result is that of brute force."""
    lines = [f"the template line number {n:04d} of a very long list" for n in random.sample(range(10_000), 600)]
    rows = [(k, "\n".join(lines[3 * k : 3 * k + 3])) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    own = df.selectExpr("doc_id doc", "text")
    entries = ld._entries(own, 8, 20, 2)
    found = ld._candidates(entries, 8, 2, ld.CROWD).persist()
    assert found.where("key is not null").count() > 0
    assert found.where("key is null").count() < 30 * len(lines)
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in ld.dedup_lines(df).collect()) == sorted(brute(rows, 1, 2, 20))


def test_strings_that_collide_modulo_powers_of_two(spark):
    bits = [0]
    while len(bits) < 8192:
        bits += [1 - x for x in bits]
    texts = [w for n in (1024, 2048, 4096, 8192) for w in ("".join("ab"[x] for x in bits[:n]), "".join("ba"[x] for x in bits[:n]))]
    out = ld.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == dict(enumerate(texts))


def test_within_long_lines_is_linear():
    a = "".join(random.choices("abc", k=160_000))
    b = "z" + a[1:-1] + "z"
    begun = time.time()
    assert ld.within(a, b, 2) and not ld.within(a, "zz" + a[2:-1] + "z", 2)
    assert time.time() - begun < 2


def test_texts_are_not_sorted(spark):
    """A task that sorts its partition's texts holds them all."""
    done = ld.dedup_lines(spark.createDataFrame([(k, f"line {k % 3}\nanother {k}") for k in range(40)], "doc_id long, text string"))
    plan = done._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan.split("MapInArrow")[1]
    assert {r.doc_id: r.text for r in done.where("doc_id < 5").collect()} == {0: "line 0\nanother 0", 1: "line 1\nanother 1", 2: "line 2\nanother 2", 3: "another 3", 4: "another 4"}
