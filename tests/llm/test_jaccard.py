import random
import re

import numpy as np
import pytest

from tallyweave.llm import jaccard_join as j
from tallyweave.llm.components import components

random.seed(9)
WORDS = ["".join(random.choices("abcdefghij", k=random.randrange(1, 6))) for _ in range(60)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    rows = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    real = [(i, s) for i, s in rows if i is not None and s]
    for a, (i, s) in enumerate(real):
        for k, t in real[:a]:
            if 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(i), root(k)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in rows), key=str)


def edited(text, n):
    words = text.split(" ")
    for _ in range(n):
        words[random.randrange(len(words))] = random.choice(WORDS)
    return " ".join(words)


def corpus():
    rows = [(i, " ".join(random.choices(WORDS, k=random.randrange(0, 80)))) for i in range(0, 120)]
    rows += [(200 + k, edited(rows[random.randrange(40)][1], random.randrange(4))) for k in range(120)]
    core = " ".join(random.choices(WORDS, k=60))
    rows += [(400 + k, edited(core, random.randrange(5))) for k in range(150)]
    rows += [(600 + k, core.upper()) for k in range(30)]
    passage = " ".join(random.choices(WORDS, k=20))
    rows += [(700 + k, passage + " " + " ".join(random.choices(WORDS, k=random.randrange(8)))) for k in range(60)]
    rows += [(800, None), (801, ""), (802, " \n\t"), (803, "One two"), (804, "one  TWO"), (805, "É é"), (None, core), (None, "x"), (806, "w " * 30_000), (807, "w " * 9)]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [192, 16])
def test_components_by_brute_force(spark, block):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rep int, root string").repartition(4)
    got = sorted((tuple(r) for r in j.jaccard_components(df, block=block).collect()), key=str)
    assert got == brute(rows)


def test_divide_skip_finds_all():
    rng = np.random.default_rng(1)
    for trial in range(60):
        universe = int(rng.integers(5, 60))
        sets = [sorted(rng.choice(universe, size=int(rng.integers(1, universe)), replace=False).tolist()) for _ in range(40)]
        index = j.DivideSkip(mu=float(rng.choice([0.0085, 0.3])))
        for number, s in enumerate(sets):
            index.add(number, s)
        for s in sets[:10]:
            for least in range(1, len(s) + 1):
                first = int(rng.integers(0, 20))
                want = {(k, c) for k, t in enumerate(sets) if k >= first and (c := len(set(s) & set(t))) >= least}
                assert set(index.search(s, least, first)) == want


def test_components(spark):
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2001 + k) for k in range(90)] + [(None, 3), (5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {(r.node, r.root) for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {(x, root(x)) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_empty(spark):
    assert j.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_strings_that_collide_modulo_powers_of_two(spark):
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - x for x in bits]
    texts = [w for n in (1024, 2048, 4096) for w in ("".join("ab"[x] for x in bits[:n]), "".join("ba"[x] for x in bits[:n]))]
    got = j.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, 1, i) for i in range(len(texts))}


def test_hubs(spark):
    """A star of more leaves than a shuffle key may have, and text that more rows share than that."""
    got = {(r.node, r.root) for r in components(spark.createDataFrame([(7, 100 + k) for k in range(2500)] + [(3, 100)], "u long, v long")).collect()}
    assert got == {(x, 3) for x in (3, 7, *range(100, 2600))}
    rows = [(i, "one two three four five six" if i % 2 else f"a{i} b{i} c{i} d{i} e{i}") for i in range(2600)]
    got = {(r.doc_id, r.component_id) for r in j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 1 if i % 2 else i) for i, _ in rows}
