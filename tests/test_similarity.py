"""Similarities against hand-worked values and their symmetries."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.functions import similarity as s

WORDS = st.text("ab c", max_size=12)


def test_known_values():
    assert s.jaro_winkler_text("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert s.jaro_winkler_text("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert s.jaro_winkler_text("", "a") == 0 and s.jaro_winkler_text("abc", "abc") == 1
    assert s.common_subsequence("abcde", "ace") == 3
    assert s.ratio_text("this is a test", "this is a test!") == pytest.approx(28 / 29)
    assert s.ratio_text("", "") == 1 and s.ratio_text("", "a") == 0
    assert s.token_sort_text("fuzzy wuzzy", "wuzzy fuzzy") == 1
    assert s.token_set_text("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1
    assert s.token_set_text("a", "") == 0
    assert s.partial_text("abc", "xxabcxx") == 1 and s.partial_text("", "a") == 0
    assert s.blocks_text("abcd", "bcde") == 0.75 and s.blocks_text("", "") == 1 and s.blocks_text("a", "") == 0


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_symmetric_and_bounded(a, b):
    for f in (s.jaro_winkler_text, s.ratio_text, s.token_sort_text, s.token_set_text, s.partial_text):
        assert f(a, b) == pytest.approx(f(b, a)) and 0 <= f(a, b) <= 1
    if a.split():
        assert s.token_set_text(a, a) == s.ratio_text(a, a) == s.partial_text(a, a) == 1


def test_columns(spark):
    df = spark.createDataFrame([("kitten", "sitting", ["a", "b"], ["b", "c", "c"]), ("", "", [], []), ("x", "", ["a"], [])], "a string, b string, u array<string>, v array<string>")
    got = df.select(
        F.round(s.levenshtein_similarity(F.col("a"), F.col("b")), 6),
        F.round(s.jaccard(F.col("u"), F.col("v")), 6),
        F.round(s.token_overlap(F.col("u"), F.col("v")), 6),
        F.round(s.containment(F.col("u"), F.col("v")), 6),
        F.round(s.jaro_winkler(F.col("a"), F.col("b")), 6),
        F.round(s.length_difference(F.col("a"), F.col("b")), 6),
    ).collect()
    assert [tuple(r) for r in got] == [(0.571429, 0.333333, 0.5, 0.5, 0.746032, 0.142857), (1.0, 1.0, 1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0, 1.0)]


def blocks(a, b):
    """Letters of matching blocks: the longest common part, leftmost in a and then in b, and the same to its left and right."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for k in range(len(b)):
            n = 0
            while i + n < len(a) and k + n < len(b) and a[i + n] == b[k + n]:
                n += 1
            if n > best[0]:
                best = (n, i, k)
    n, i, k = best
    return n and n + blocks(a[:i], b[:k]) + blocks(a[i + n :], b[k + n :])


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_blocks_by_brute_force(a, b):
    def ratio(a, b):
        return 1.0 if a == b else 2 * blocks(a, b) / (len(a) + len(b)) if a and b else 0.0

    assert s.blocks_text(a, b) == pytest.approx(ratio(a, b))
    one, two = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    assert s.blocks_token_sort_text(a, b) == pytest.approx(ratio(one, two))
    common, left, right = (" ".join(sorted(x)) for x in (set(a.split()) & set(b.split()), set(a.split()) - set(b.split()), set(b.split()) - set(a.split())))
    first, second = f"{common} {left}".strip(), f"{common} {right}".strip()
    best = max([ratio(first, second)] + [ratio(common, x) for x in (first, second) if common])
    assert s.blocks_token_set_text(a, b) == pytest.approx(best)


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=40), st.text("abcd", max_size=40))
def test_subsequence_by_brute_force(a, b):
    assert s.common_subsequence(a, b) == subsequence(a, b)
