"""Candidate pairs from blocking keys.

A tier is a name, a score and two expressions over a normalised record that give the keys of
an anchor (build side) and of a candidate (probe side).  All tiers' keys form one long table,
so candidate generation is one equi-join on (tier, key), whatever the tiers.  Keys that too
many anchors share are dropped before the join: that limit is part of the operator, and it is
what keeps the join linear.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import text as t

SEP = "\x01"
ANCHORS, CANDIDATES = 4096, 65536  # names of a block
CHUNK = 1000  # candidates with the same keys that one row holds


def _words() -> Column:
    return F.col("words")


def _key(*parts: Column) -> Column:
    return F.concat_ws(SEP, F.col("country"), *parts)


def _one(guard: Column, *parts: Column) -> Column:
    return F.when(guard, F.array(_key(*parts))).otherwise(F.array().cast("array<string>"))


def _word(i: int) -> Column:
    return F.coalesce(F.get(_words(), F.lit(i)), F.lit(""))


def _last() -> Column:
    return t.last_or(_words())


def _long(c: Column, n: int = 3) -> Column:
    return F.length(c) >= n


def _each(words: Column, make: Callable[[Column], Column]) -> Column:
    return F.array_distinct(F.transform(words, make))


@dataclass(frozen=True)
class Tier:
    name: str
    score: int
    build: Callable[[], Column]
    probe: Callable[[], Column] | None = None
    limit: int = 350

    def keys(self, probe: bool) -> Column:
        return (self.probe or self.build)() if probe else self.build()


def _bigrams(n: int) -> Column:
    grams = F.slice(F.transform(F.sequence(F.lit(0), F.size(_words()) - 2), lambda i: F.concat_ws(" ", F.get(_words(), i), F.get(_words(), i + 1))), 1, n)
    return F.when(F.size(_words()) >= 2, _each(grams, lambda w: _key(w))).otherwise(F.array().cast("array<string>"))


def _significant() -> Column:
    return F.filter(_words(), lambda w: _long(w))


def _num() -> Column:
    return F.col("street_num")


def _has_num() -> Column:
    return _num() != ""


def _city() -> Column:
    return F.col("city_words")


TIERS = {
    tier.name: tier
    for tier in (
        Tier("exact", 100, lambda: _one(F.col("name") != "", F.col("name"))),
        Tier("slug", 95, lambda: _one(_long(F.col("slug"), 4), F.col("slug"))),
        Tier("fingerprint", 85, lambda: _one(F.size(_words()).between(2, 4), t.fingerprint(_words()))),
        Tier("w12", 80, lambda: _one((F.size(_words()) >= 2) & _long(_word(0)) & _long(_word(1)), _word(0), _word(1))),
        Tier("first_last", 75, lambda: _one((F.size(_words()) >= 2) & _long(_word(0)) & _long(_last()), _word(0), _last())),
        Tier("w23", 70, lambda: _one((F.size(_words()) >= 3) & _long(_word(1)) & _long(_last()), _word(1), _last())),
        Tier("brand", 65, lambda: _each(t.distinctive(_words()), lambda w: _key(w)), lambda: _each(F.filter(_words(), lambda w: _long(w, 5)), lambda w: _key(w)), 60),
        Tier("num_name", 65, lambda: _one(_has_num() & _long(_word(0)), _num(), _word(0)), limit=80),
        Tier("num_street", 60, lambda: _one(_has_num() & (F.col("street3") != ""), _num(), F.col("street3")), limit=80),
        Tier("num_street2", 58, lambda: _one(_has_num() & _long(F.col("street2"), 2), _num(), F.col("street2")), limit=80),
        Tier("num_word", 55, lambda: F.when(_has_num(), _each(F.filter(F.slice(_words(), 1, 2), lambda w: _long(w)), lambda w: _key(_num(), w))).otherwise(F.array().cast("array<string>")), limit=80),
        Tier("city_pair", 55, lambda: _one(F.size(_city()) >= 2, F.get(_city(), F.lit(0)), F.get(_city(), F.lit(1))), limit=50),
        Tier("num_city", 50, lambda: _one(_has_num() & (F.size(_city()) >= 1), _num(), F.get(_city(), F.lit(0))), limit=50),
        Tier("pin_word", 45, lambda: _one((F.col("pin") != "") & (F.size(_words()) >= 1), F.col("pin"), F.left(_word(0), F.lit(4))), limit=150),
        Tier("first_token", 40, lambda: _one(F.size(_words()) >= 1, _word(0))),
        Tier("prefix3", 35, lambda: _one(F.col("name") != "", F.left(F.col("name"), F.lit(3)))),
        Tier("first_last_sorted", 75, lambda: _one(F.size(_significant()) >= 2, F.least(F.get(_significant(), F.lit(0)), F.element_at(_significant(), -1)), F.greatest(F.get(_significant(), F.lit(0)), F.element_at(_significant(), -1)))),
        Tier("bigram", 30, lambda: _bigrams(3), lambda: _bigrams(2)),
    )
}
#: The production tiers in the order of their scores.
PRODUCTION = ("exact", "slug", "fingerprint", "w12", "first_last", "w23", "brand", "num_street", "num_word")


def _entries(tiers: tuple[str, ...], probe: bool) -> Column:
    """(tier, score, key) of all tiers' keys of a record, as one list."""

    def entries(tier: Tier) -> Column:
        return F.transform(tier.keys(probe), lambda k: F.struct(F.lit(tier.name).alias("tier"), F.lit(tier.score).alias("score"), k.alias("key")))

    return F.concat(*(entries(TIERS[name]) for name in tiers))


def key_table(records: DataFrame, tiers: tuple[str, ...] = PRODUCTION, probe: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """(entity_id, src, tier, score, key) of all tiers' keys, and ``more`` of the records' columns, from one pass over the records."""

    # Outer, as a plain explode would be given a filter on the list's size, for which all keys would be made twice.
    return records.select("entity_id", "src", *more, F.explode_outer(_entries(tiers, probe)).alias("k")).where("k.key is not null").select("entity_id", "src", *more, "k.*")


def pruned(keys: DataFrame, limit: int | dict[str, int] | None = None, count: Column | None = None) -> DataFrame:
    """Anchor keys that at most the tier's limit (or the given one) of anchors share, decided by a partial aggregate and a semi-join; ``count`` where a row isn't one anchor."""
    if isinstance(limit, int):
        most = F.lit(limit)
    else:
        limits = {name: tier.limit for name, tier in TIERS.items()} | (limit or {})
        most = F.element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), F.col("tier"))
    few = keys.groupBy("tier", "key").agg((F.count(F.lit(1)) if count is None else count).alias("c")).where(F.col("c") <= most).select("tier", "key")
    return keys.join(few, ["tier", "key"], "left_semi")


def tier_hits(anchor_keys: DataFrame, probe_keys: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(s1_id, cand_id, src, tier, score) for every key that an anchor and a candidate share."""
    a = anchor_keys.select(F.col("entity_id").alias("s1_id"), "tier", "key", "score")
    b = probe_keys.select(F.col("entity_id").alias("cand_id"), "src", "tier", "key", *more)
    return a.join(b, ["tier", "key"]).where("s1_id <> cand_id").select("s1_id", "cand_id", "src", "tier", "score", *more)


def _alike(records: DataFrame, tiers: tuple[str, ...], probe: bool) -> DataFrame:
    """(ids, src, c, tier, score, key): records with all keys in common as one row for each of these, with their ids, CHUNK at most of candidates, and their number."""
    own = records.select("entity_id", "src", _entries(tiers, probe).alias("keys"))
    # Rows that share an id count as often as they are there, and make no pair twice.
    whole = own.groupBy("entity_id", "src").agg(F.array_sort(F.flatten(F.collect_list("keys"))).alias("keys"))
    alike = whole.groupBy("keys", "src").agg(F.array_sort(F.collect_list("entity_id")).alias("ids"), F.count(F.lit(1)).alias("c"))
    if probe:
        starts = F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / CHUNK).cast("int"))
        alike = alike.select("keys", "src", "c", F.explode(F.transform(starts, lambda i: F.slice("ids", i * CHUNK + 1, F.lit(CHUNK)))).alias("ids"))
    return alike.select("ids", "src", "c", F.explode_outer("keys").alias("k")).where("k.key is not null").select("ids", "src", "c", "k.*")


def candidate_pairs(records: DataFrame, tiers: tuple[str, ...] = PRODUCTION, limit: int | dict[str, int] | None = None) -> DataFrame:
    """(s1_id, cand_id, src, score): the best tier score of each pair of an anchor (src 1) and a candidate.

    Records with the same keys are joined as one and written out as pairs at the end, so what is shuffled grows with the different
    ones. Groups are dealt to all tasks by name, as their rows are few and become many.
    """
    anchors = pruned(_alike(records.where("src = 1"), tiers, False), limit, F.sum("c"))
    a = anchors.select(F.col("ids").alias("_a"), "tier", "key", "score")
    b = _alike(records.where("src <> 1"), tiers, True).select(F.col("ids").alias("_b"), "src", "tier", "key")
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = a.join(b, ["tier", "key"]).select("_a", "_b", "src", "score").repartition(parts, "_a", "_b", "src")
    best = met.groupBy("_a", "_b", "src").agg(F.max("score").alias("score"))
    return best.select(F.explode("_a").alias("s1_id"), "_b", "src", "score").select("s1_id", F.explode("_b").alias("cand_id"), "src", "score").where("s1_id <> cand_id")


def first_pairs(records: DataFrame, k: int, tiers: tuple[str, ...] = PRODUCTION, limit: int | dict[str, int] | None = None, order: str | None = None) -> DataFrame:
    """Those of ``candidate_pairs`` that can be among an anchor's k best of a source by score and cand_id, or by ``order`` (a column of the records) and cand_id.

    Candidates of one key and source differ in that order only, as the key gives all the same score: of each key the first k
    ids that aren't the anchor's own, so k + 1, stand for all. Pairs grow with the anchors' keys, not with groups of equal ones.
    A pair found may have a lower score than ``candidate_pairs`` has for it, if it isn't among the k best.
    """
    by = ["entity_id"] if order is None else [order, "entity_id"]
    probes = key_table(records.where("src <> 1"), tiers, probe=True, more=tuple(by[:-1]))
    w = Window.partitionBy("tier", "key", "src").orderBy(*by)
    few = probes.withColumn("_rank", F.dense_rank().over(w)).where(F.col("_rank") <= k + 1)
    anchors = pruned(key_table(records.where("src = 1"), tiers), limit)
    # Dealt by anchor, so that neither the pairs' best scores nor what ranks them needs another shuffle.
    hits = tier_hits(anchors, few, tuple(by[:-1])).repartition("s1_id")
    return hits.groupBy("s1_id", "cand_id", "src", *by[:-1]).agg(F.max("score").alias("score"))


def top_k(pairs: DataFrame, k: int, by: tuple[str, ...] = ("s1_id", "src"), order: str = "score") -> DataFrame:
    """The k best pairs of each group; ties go by cand_id, so the result doesn't depend on arrival."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc(), "cand_id")
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def first_come(pairs: DataFrame, k: int, by: tuple[str, ...], order: str = "ord") -> DataFrame:
    """The first k pairs of each group by a stated arrival order."""
    w = Window.partitionBy(*by).orderBy(order, "cand_id")
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def per_key_take(hits: DataFrame, per_tier: int, total: int) -> DataFrame:
    """At most ``per_tier`` candidates of an anchor in each tier, then ``total`` in all, by score and cand_id."""
    best = top_k(hits.dropDuplicates(["s1_id", "cand_id", "tier"]), per_tier, ("s1_id", "tier"), "score")
    pairs = best.groupBy("s1_id", "cand_id", "src").agg(F.max("score").alias("score"))
    return top_k(pairs, total, ("s1_id",))


def address_overlap(records: DataFrame, least: int = 2, min_length: int = 3) -> DataFrame:
    """(s1_id, cand_id, shared) of pairs with ``least`` or more common address words of ``min_length`` letters, within a country.

    Of a record's words that both sides have, the ``least`` - 1 most frequent ones stay out of the join: two records with ``least`` words in
    common share one of the others as well, in one order of all words. So the commonest words pair nothing; the whole lists decide.
    """
    words = F.explode_outer(F.array_distinct(F.filter("addr_words", lambda w: F.length(w) >= min_length))).alias("w")
    rows = records.select("entity_id", "src", "country", words).where("w is not null")
    met = rows.groupBy("country", "w").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("src") == 1).alias("a")).where("a > 0 and a < c").select("country", "w", "c")
    lists = rows.join(met, ["country", "w"]).groupBy("entity_id", "src", "country").agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("k")).where(F.size("k") >= least)
    entered = lists.select("entity_id", "src", "country", F.explode_outer(F.slice(F.col("k"), 1, F.greatest(F.size("k") - least + 1, F.lit(0)))["w"]).alias("w")).where("w is not null")
    a, b = entered.where("src = 1").select(F.col("entity_id").alias("s1_id"), "country", "w"), entered.where("src <> 1").select(F.col("entity_id").alias("cand_id"), "country", "w")
    pairs = a.join(b, ["country", "w"]).select("s1_id", "cand_id").distinct()
    whole = lists.select("entity_id", F.col("k.w").alias("ws"))
    both = pairs.join(whole.select(F.col("entity_id").alias("s1_id"), F.col("ws").alias("_wa")), "s1_id").join(whole.select(F.col("entity_id").alias("cand_id"), F.col("ws").alias("_wb")), "cand_id")
    return both.select("s1_id", "cand_id", F.size(F.array_intersect("_wa", "_wb")).cast("long").alias("shared")).where(F.col("shared") >= least)


def _grams(words: Column, low: int, high: int) -> Column:
    """N-grams of each word padded with blanks; of a shorter word the whole."""
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column, n: Column) -> Column:
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))).otherwise(F.array(w))

    return F.flatten(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: of(w, n)))))


def _whole(records: DataFrame, words: str) -> DataFrame:
    return records.groupBy("entity_id").agg(F.flatten(F.collect_list(words)).alias("_w"))


def cosine_of(records: DataFrame, words: str, low: int = 2, high: int = 4) -> Callable[[Column, Column], Column]:
    """The TF-IDF cosine of the n-grams of two entities, of whose words each is given as one text; 0 where a side has none.

    Vectors are made in the tasks, each once.  The n-grams' weights are broadcast: at most 37 to the power of ``high`` for
    cleaned words of a-z and 0-9, whatever the number of records.
    """
    whole = _whole(records, words)
    own = whole.select(F.explode_outer(F.array_distinct(_grams(F.col("_w"), low, high))).alias("g")).where("g is not null")
    n = records.agg(F.count(F.lit(1)).alias("n"))
    found = own.groupBy("g").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("g", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")).toArrow()
    held = records.sparkSession.sparkContext.broadcast(dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)))

    def measure(a: pd.Series, b: pd.Series) -> pd.Series:
        idf, known = held.value, {}

        def vector(text: str) -> dict[str, float]:
            if text not in known:
                tf: dict[str, int] = {}
                for word in text.split(" ") if text else ():
                    for g in _word_grams(SEP + word, low, high):
                        tf[g[1:]] = tf.get(g[1:], 0) + 1
                v = {g: c * idf[g] for g, c in tf.items()}
                size = math.sqrt(sum(w * w for w in v.values()))
                known[text] = {g: w / size for g, w in v.items()}
            return known[text]

        def cosine(x: str, y: str) -> float:
            v, u = vector(x), vector(y)
            return sum(v[g] * u[g] for g in v.keys() & u.keys())

        return pd.Series([cosine(x, y) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype="float64")

    return F.pandas_udf(measure, "double")


def with_cosine(pairs: DataFrame, records: DataFrame, words: str, name: str, low: int = 2, high: int = 4) -> DataFrame:
    """The pairs and, as ``name``, the TF-IDF cosine of both sides' n-grams; pairs are given both sides' words, not their vectors."""
    texts = _whole(records, words).select("entity_id", F.array_join("_w", " ").alias("_t"))
    both = pairs.join(texts.select(F.col("entity_id").alias("s1_id"), F.col("_t").alias("_ta")), "s1_id", "left").join(texts.select(F.col("entity_id").alias("cand_id"), F.col("_t").alias("_tb")), "cand_id", "left")
    return both.withColumn(name, cosine_of(records, words, low, high)(F.col("_ta"), F.col("_tb"))).drop("_ta", "_tb")


def ranked(pairs: DataFrame, most: int, order: str = "cosine") -> DataFrame:
    """The ``most`` best pairs of each anchor with their rank, so that any smaller number of them is a filter on it."""
    w = Window.partitionBy("s1_id").orderBy(F.col(order).desc(), "cand_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def _word_grams(word: str, low: int, high: int) -> list[str]:
    """``_grams`` of one word that has its country and SEP before it, each with these as well."""
    country, _, own = word.rpartition(SEP)
    own = f" {own} "
    return [f"{country}{SEP}{own[i : i + n]}" for n in range(low, high + 1) for i in range(max(len(own) - n, 0) + 1)]


class _Words:
    """TF-IDF vectors of the distinct words of many names, whose vectors are the sums of their words'."""

    def __init__(self, words: list[str], numbers: dict[str, int], idf: np.ndarray, low: int, high: int):
        grams, counts = [], []
        for word in words:
            own = [g for x in _word_grams(word, low, high) if (g := numbers.get(x)) is not None]
            grams.extend(own)
            counts.append(len(own))
        self.ends = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
        self.grams = np.array(grams, np.int64)
        self.idf = idf

    def vector(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of a name's words, and their weights."""
        grams, tf = np.unique(np.concatenate([self.grams[self.ends[w] : self.ends[w + 1]] for w in words.tolist()] or [self.grams[:0]]), return_counts=True)
        return grams, tf * self.idf[grams]

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """The words of each n-gram, one after the other as often as they have it, with the n-grams' ends."""
        words = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))
        by = np.argsort(self.grams, kind="stable")
        return words[by], np.concatenate([[0], np.cumsum(np.bincount(self.grams, minlength=len(self.idf)))])


def _names(table: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of a column of lists, their numbers in each list, and the lists' ends."""
    lists = table.column("ws").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))]).astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), ends


def _best_of_block(anchors: pa.Table, others: pa.Table, numbers: dict[str, int], idf: np.ndarray, low: int, high: int, least: float, k: int) -> Iterator[pa.RecordBatch]:
    """(s1, cand, cosine) for each name of an anchor: its ids, and those of the k names most similar to it, and of all as similar as the k-th."""
    words, coded, ends = _names(others)
    dictionary = _Words(words, numbers, idf, low, high)
    length = np.zeros(others.num_rows)
    for i in range(others.num_rows):
        w = dictionary.vector(coded[ends[i] : ends[i + 1]])[1]
        length[i] = math.sqrt(w @ w)
    # Longest names first: the words at one place of all names that have it are the beginning of a column.
    order = np.argsort(-np.diff(ends), kind="stable")
    sizes = np.diff(ends)[order]
    places = [coded[ends[:-1][order[: int((sizes > j).sum())]] + j] for j in range(int(sizes[0]) if len(sizes) else 0)]
    length = length[order]
    scale = np.divide(1.0, length, out=np.zeros_like(length), where=length > 0)
    of_gram, gram_ends = dictionary.postings()
    words, coded, ends = _names(anchors)
    mine = _Words(words, numbers, idf, low, high)
    s1, ids = anchors.column("ids").combine_chunks(), others.column("ids").combine_chunks()
    held: tuple[list, list, list] = ([], [], [])

    def out() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([s1.take(pa.array(held[0], pa.int64())), ids.take(pa.array(held[1], pa.int64())), pa.array(held[2], pa.float64())], names=["s1", "cand", "cosine"])
        for column in held:
            column.clear()
        return found

    for i in range(anchors.num_rows):
        grams, w = mine.vector(coded[ends[i] : ends[i + 1]])
        size = math.sqrt(w @ w)
        counts = gram_ends[grams + 1] - gram_ends[grams]
        if not counts.sum():
            continue
        touched = np.concatenate([of_gram[gram_ends[g] : gram_ends[g + 1]] for g in grams.tolist()])
        alike = np.bincount(touched, np.repeat(w * idf[grams] / size, counts), minlength=len(dictionary.ends) - 1)
        cosine = alike[places[0]]
        for place in places[1:]:
            cosine[: len(place)] += alike[place]
        cosine *= scale
        # Wider by what rounding to six digits may add.
        hit = np.flatnonzero((cosine >= least - 1e-6) & (cosine > 0))
        if len(hit) > k:
            hit = hit[cosine[hit] >= np.partition(cosine[hit], len(hit) - k)[len(hit) - k] - 2e-6]
        held[0].extend([i] * len(hit))
        held[1].extend(order[hit].tolist())
        held[2].extend(cosine[hit].tolist())
        if len(held[0]) >= 5000:
            yield out()
    if held[0]:
        yield out()


def tfidf_pairs(records: DataFrame, low: int = 2, high: int = 4, min_df: int = 1, max_df: float = 1.0, least: float = 0.3, k: int = 20, fit_on_anchors: bool = True) -> DataFrame:
    """(s1_id, cand_id, cosine): the k most similar candidates of each anchor by TF-IDF of character n-grams, within a country.

    N-grams of each word padded with blanks; smooth idf ln((1 + n) / (1 + df)) + 1; rows of unit
    length.  A term in more than ``max_df`` of a country's documents is dropped.

    A name's vector is the sum of its words', so an anchor is multiplied with the distinct words of a block of candidates and
    each of these adds up what its words have: no pair is shuffled.  Names of the same words are one.  Blocks of anchors meet
    blocks of candidates, so time grows with the product of both within a country, and what is shuffled with a table's blocks.
    """
    own = records.select("entity_id", "src", "country", F.transform("words", lambda w: F.concat("country", F.lit(SEP), w)).alias("ws"))
    # Rows that share an id are one text, in all the countries that they name.
    whole = own.groupBy("entity_id", "src").agg(F.array_sort(F.flatten(F.collect_list("ws"))).alias("ws")).where(F.size("ws") > 0)
    side = F.when(F.col("src") == 1, 1).otherwise(2)
    names = whole.groupBy("ws", side.alias("kind")).agg(F.array_sort(F.collect_list("entity_id")).alias("ids"))
    fitted = names if fit_on_anchors else names.where("kind = 2")
    # The n-grams of a word with its country before it.
    grams = F.flatten(F.transform("ws", lambda w: F.transform(_grams(F.array(F.element_at(F.split(w, SEP), -1)), low, high), lambda g: F.concat(F.substring_index(w, SEP, 1), F.lit(SEP), g))))
    df = fitted.select(F.size("ids").alias("c"), F.explode(F.array_distinct(grams)).alias("g")).groupBy("g").agg(F.sum("c").alias("df")).withColumn("country", F.substring_index("g", SEP, 1))
    n = (records if fit_on_anchors else records.where("src <> 1")).groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    idf = df.join(n, "country").where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n"))).select("country", "g", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    countries = F.array_distinct(F.transform("ws", lambda w: F.substring_index(w, SEP, 1)))
    # Of candidates with one name the first k stand for all.
    ids = F.when(F.col("kind") == 1, F.col("ids")).otherwise(F.slice("ids", 1, k))
    placed = names.select("kind", "ws", ids.alias("ids"), countries.alias("countries"), F.explode(countries).alias("country"))
    parts = placed.groupBy("country").agg(*(F.ceil(F.count_if(F.col("kind") == kind) / most).cast("int").alias(name) for kind, name, most in ((1, "na", ANCHORS), (2, "nb", CANDIDATES)))).where("na > 0 and nb > 0")
    here = placed.join(parts, "country")
    whole_number = lambda name: F.sequence(F.lit(0), F.col(name) - 1)
    part = lambda name: F.array(F.pmod(F.xxhash64("ws"), F.col(name)).cast("int"))
    none = F.lit(None).cast("array<double>")
    dealt = here.select("country", F.explode(F.when(F.col("kind") == 1, part("na")).otherwise(whole_number("na"))).alias("a"), F.when(F.col("kind") == 2, part("nb")).otherwise(whole_number("nb")).alias("b"), "kind", "ws", "ids", none.alias("idf"))
    # A country's weights, and those of any other that one of its names is in as well.
    needed = here.select("country", F.explode("countries").alias("of")).distinct().join(parts, "country")
    chunk = F.pmod(F.xxhash64("g"), F.lit(64))
    weights = idf.select(F.col("country").alias("of"), "g", "idf").join(needed, "of").groupBy("country", "na", "nb", chunk.alias("chunk")).agg(F.collect_list("g").alias("ws"), F.collect_list("idf").alias("idf"))
    weights = weights.select("country", F.explode(whole_number("na")).alias("a"), whole_number("nb").alias("b"), F.lit(0).alias("kind"), "ws", F.lit(None).cast("array<string>").alias("ids"), "idf")
    rows = dealt.unionByName(weights).select("country", "a", F.explode("b").alias("b"), "kind", "ws", F.col("ids").cast("array<string>").alias("ids"), "idf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            first, anchors, others = (table.filter(pc.equal(table.column("kind"), kind)) for kind in range(3))
            if first.num_rows and anchors.num_rows and others.num_rows:
                grams = [g for x in first.column("ws").chunks for g in x.flatten().to_pylist()]
                idf = np.concatenate([x.flatten().to_numpy() for x in first.column("idf").chunks])
                yield from _best_of_block(anchors, others, {g: i for i, g in enumerate(grams)}, idf, low, high, least, k)

        held, now = [], None
        for batch in batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for begin, end in zip(edges, edges[1:]):
                if begin < end:
                    if keys[begin] != now:
                        if held:
                            yield from found(held)
                        held, now = [], keys[begin]
                    held.append(batch.slice(begin, end - begin))
        if held:
            yield from found(held)

    by = ("country", "a", "b")
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(run, "s1 array<string>, cand array<string>, cosine double")
    pairs = met.select(F.explode("s1").alias("s1_id"), "cand", "cosine").select("s1_id", F.explode("cand").alias("cand_id"), F.round("cosine", 6).alias("cosine")).where(F.col("cosine") >= least)
    # A pair within two countries is found in both.
    return top_k(pairs.repartition("s1_id").groupBy("s1_id", "cand_id").agg(F.max("cosine").alias("cosine")), k, ("s1_id",), "cosine")
