"""Similarities of strings and token sets.

Set and edit-distance measures are Column expressions.  Jaro-Winkler, the indel ratios and the
matching-blocks ratio have no counterpart in Spark and run as Arrow UDFs, which compute each
distinct pair of a batch once.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Shared over all distinct elements; ``both_empty`` if there are none, 0 if one side has none."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(shared(a, b) / union)


def token_overlap(a: Column, b: Column) -> Column:
    """Shared over the larger side's distinct elements."""
    most = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(most == 0, 1.0).otherwise(shared(a, b) / most)


def containment(a: Column, b: Column) -> Column:
    """Shared over the smaller side's distinct elements."""
    return shared(a, b) / F.greatest(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(1))


def length_difference(a: Column, b: Column) -> Column:
    return F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    kept = []
    for i, x in enumerate(a):
        for k in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[k] and b[k] == x:
                taken[k] = True
                kept.append(x)
                break
    if not kept:
        return 0.0
    others = [y for y, t in zip(b, taken, strict=True) if t]
    half = sum(x != y for x, y in zip(kept, others, strict=True)) // 2
    m = len(kept)
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler_text(a: str, b: str) -> float:
    """Jaro similarity, raised for up to four common first letters where it is above 0.7; 0 if a side is empty."""
    if not a or not b:
        return 0.0
    base = jaro(a, b)
    if base <= 0.7:
        return base
    start = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        start += 1
    return base + 0.1 * start * (1 - base)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by a bit vector of ``a`` that is advanced for each letter of ``b``."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        met = row & where.get(y, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def ratio_text(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; two empty texts are alike."""
    total = len(a) + len(b)
    return 1.0 if not total else 2 * common_subsequence(a, b) / total


def _sorted(a: str) -> str:
    return " ".join(sorted(a.split()))


def token_sort_text(a: str, b: str) -> float:
    return ratio_text(_sorted(a), _sorted(b))


def token_set_text(a: str, b: str) -> float:
    """The best ratio among the common words, and these with either side's other words; 0 if a side has none."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    common, left, right = " ".join(sorted(one & two)), " ".join(sorted(one - two)), " ".join(sorted(two - one))
    if common and (not left or not right):
        return 1.0
    first, second = f"{common} {left}".strip(), f"{common} {right}".strip()
    best = ratio_text(first, second)
    return max(best, ratio_text(common, first), ratio_text(common, second)) if common else best


def partial_text(a: str, b: str) -> float:
    """The best ratio of the shorter text with any window of its length, cut off at the ends, of the longer one."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    short, long = sorted((a, b), key=len)

    def best(short: str, long: str) -> float:
        n = len(short)
        windows = {long[max(0, at) : at + n] for at in range(1 - n, len(long))}
        return max(ratio_text(short, w) for w in windows)

    return best(short, long) if len(short) < len(long) else max(best(short, long), best(long, short))


def blocks_text(a: str, b: str) -> float:
    """Ratio of matching blocks (longest block first, then to its left and right); 1 if equal, 0 if a side is empty."""
    if a == b:
        return 1.0
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def blocks_token_sort_text(a: str, b: str) -> float:
    return blocks_text(_sorted(a), _sorted(b))


def blocks_token_set_text(a: str, b: str) -> float:
    one, two = set(a.split()), set(b.split())
    common = " ".join(sorted(one & two))
    first = f"{common} {' '.join(sorted(one - two))}".strip()
    second = f"{common} {' '.join(sorted(two - one))}".strip()
    best = blocks_text(first, second)
    return max(best, blocks_text(common, first), blocks_text(common, second)) if common else best


def _arrow(function: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    def measure(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna(""), strict=True):
            if pair not in known:
                known[pair] = function(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    # Made where it is used: workers import this module too, and have no session.
    return lambda a, b: F.pandas_udf(measure, "double")(a, b)


jaro_winkler = _arrow(jaro_winkler_text)
ratio = _arrow(ratio_text)
token_sort_ratio = _arrow(token_sort_text)
token_set_ratio = _arrow(token_set_text)
partial_ratio = _arrow(partial_text)
blocks_ratio = _arrow(blocks_text)
blocks_token_sort = _arrow(blocks_token_sort_text)
blocks_token_set = _arrow(blocks_token_set_text)
