"""The linkage queries over the documents' entity view, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave import oracles as o
from tallyweave.functions import similarity as sim
from tallyweave.functions import text as t
from tallyweave.operators import blocking, decide, evaluate, features, profile, validate
from tallyweave.operators.records import normalised
from tallyweave.plans import linkage, model
from tallyweave.sources import tables
from tallyweave.sources.fixture import entities, part_entities, true_pairs

K = 10
PRIMARY, SECONDARY = 0.40, 0.55
THRESHOLDS = [0.3, 0.45, 0.6, 0.75, 0.9]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE = (o.ENT, o.records())
PAIRS = (*BASE, o.pairs(blocking.PRODUCTION), o.top(K))
SCORED = (*PAIRS, o.PAIRED, o.SCORED)
CHOSEN = (*SCORED, o.two_tier(PRIMARY, SECONDARY))


def query(sql: str | None = None, name: str | None = None):
    """Registers a query and its SQL."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def _records(spark: SparkSession, sf: str, rules: str = "v5") -> DataFrame:
    return normalised(entities(spark, sf), rules)


def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    return entities(spark, sf).where("src = 1").select(F.col("entity_id").alias("s1_id"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.candidates(_records(spark, sf), linkage.Settings(per_source=K))


def _paired(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf)
    return features.with_records(linkage.candidates(records, linkage.Settings(per_source=K)), records)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return features.rule_score(_paired(spark, sf))


def _chosen(spark: SparkSession, sf: str) -> DataFrame:
    return decide.two_tier(_scored(spark, sf), PRIMARY, SECONDARY)


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to six digits, all others as they are."""
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes if not keep or c in keep))


# Normalisation


def _name_query(rules: str) -> None:
    @query(o.with_(o.ENT) + f"SELECT entity_id, {o.name_sql('business_name', t.NAME_RULES[rules])} AS name FROM ent", f"norm_name_{rules}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return entities(spark, sf).select("entity_id", t.clean_name(F.col("business_name"), t.NAME_RULES[rules]).alias("name"))


for _rules in t.NAME_RULES:
    _name_query(_rules)


def _field(field: str, column: Callable[[], Column], sql: str) -> None:
    @query(o.with_(*BASE) + f"SELECT entity_id, {sql} AS {field} FROM rec", f"norm_{field}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _records(spark, sf).select("entity_id", column().alias(field))


_field("addr", lambda: F.col("addr"), "addr")
_field("slug", lambda: F.col("slug"), "slug")
_field("street_num", lambda: F.col("street_num"), "street_num")
_field("all_nums", lambda: F.array_join(F.array_sort("nums"), ","), "array_to_string(list_sort(nums), ',')")
_field("street_prefix", lambda: F.concat_ws("/", "street3", "street2"), "street3 || '/' || street2")
_field("city_words", lambda: F.array_join("city_words", ","), "array_to_string(city_words, ',')")
_field("address_words", lambda: F.array_join(t.last_words(F.col("addr_words"), 4), ","), "array_to_string(list_filter(addr_words, lambda w: NOT regexp_matches(w, '^[0-9]+$') AND length(w) >= 4)[-4:], ',')")
_field("location", lambda: F.concat_ws("/", "pin", "state", "city"), "pin || '/' || state || '/' || city")
_field("distinctive", lambda: F.array_join(t.distinctive(F.col("words")), ","), f"array_to_string(list_filter(words, lambda w: length(w) >= 5 AND w NOT IN ({o._GENERIC})), ',')")
_field("fingerprint", lambda: t.fingerprint(F.col("words")), "array_to_string(list_sort(words), '|')")
_field("ngrams2", lambda: F.array_join(F.array_sort(t.char_ngrams(F.col("name"), 2, "none")), ","), f"array_to_string(list_sort({o.ngrams_sql('name', 2, 'none')}), ',')")
_field("ngrams3", lambda: F.array_join(F.array_sort("ngrams"), ","), "array_to_string(list_sort(ngrams), ',')")
_field("name_cut", lambda: F.concat_ws("/", F.left("name", F.lit(80)), t.first_or(F.col("words")), t.last_or(F.col("words"))), "name[1:80] || '/' || coalesce(words[1], '') || '/' || coalesce(words[-1], '')")


_MORE = t.COUNTRY_ALIASES | t.COUNTRY_ALIASES_MORE


@query(o.with_(o.ENT) + "SELECT entity_id, upper(trim(country)) AS upper_country, CASE lower(trim(country)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _MORE.items()) + " ELSE lower(trim(country))[1:5] END AS code FROM ent")
def country_norm(spark, sf):
    return entities(spark, sf).select("entity_id", t.upper_country(F.col("country")).alias("upper_country"), t.alias_country(F.col("country")).alias("code"))


@query(o.with_(o.ENT) + f"SELECT entity_id, {o._collapse(o._sub(o.ascii_only('business_address'), '[^a-z0-9' + chr(92) + 's]', ' '))} AS plain, {o._collapse(o._sub(o._sub(o.latin('business_address'), '[^a-z0-9' + chr(92) + 's]', ' '), o._any(t.ADDRESS_NOISE_SHORT), ' '))} AS short FROM ent")
def address_variants(spark, sf):
    return entities(spark, sf).select("entity_id", t.plain_addr(F.col("business_address")).alias("plain"), t.short_addr(F.col("business_address")).alias("short"))


@query("SELECT page_id, " + o.slug_sql(o.name_sql("url", t.NAME_RULES["v5"])) + " AS slug FROM pages")
def url_slug(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", t.squish(t.clean_name(F.col("url"))).alias("slug"))


# Blocking


def _block_query(tier: str) -> None:
    @query(o.with_(*BASE, o.pairs([tier])) + "SELECT s1_id, cand_id, score FROM pairs", f"block_{tier}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return blocking.candidate_pairs(_records(spark, sf), (tier,)).select("s1_id", "cand_id", "score")


for _tier in blocking.TIERS:
    _block_query(_tier)


@query(o.with_(o.PART_ENT, o.records(), o.pairs(["fingerprint", "first_last_sorted", "brand"])) + "SELECT s1_id, cand_id, score FROM pairs")
def block_parts(spark, sf):
    """Short names, whose words may be the other way round, and crowded keys."""
    return blocking.candidate_pairs(normalised(part_entities(spark, sf)), ("fingerprint", "first_last_sorted", "brand")).select("s1_id", "cand_id", "score")


@query(o.with_(*BASE, o.pairs(blocking.PRODUCTION)) + "SELECT tier, count(*) AS keys, CAST(sum(c) AS BIGINT) AS anchors FROM (SELECT tier, key, count(*) AS c FROM ka JOIN few USING (tier, key) GROUP BY ALL) GROUP BY tier")
def fanout_pruned_keys(spark, sf):
    kept = blocking.pruned(blocking.key_table(_records(spark, sf).where("src = 1")))
    return kept.groupBy("tier").agg(F.countDistinct("key").alias("keys"), F.count(F.lit(1)).alias("anchors"))


@query(o.with_(*PAIRS) + "SELECT s1_id, cand_id, src, score FROM topk")
def candidates_topk(spark, sf):
    return _pairs(spark, sf)


@query(o.with_(*BASE, o.pairs(blocking.PRODUCTION)) + "SELECT src, count(*) AS pairs, CAST(sum(score) AS BIGINT) AS total FROM pairs GROUP BY src")
def candidates_default_limits(spark, sf):
    return blocking.candidate_pairs(_records(spark, sf)).groupBy("src").agg(F.count(F.lit(1)).alias("pairs"), F.sum("score").alias("total"))


@query(o.with_(*BASE) + "SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, count(*) AS shared FROM (SELECT entity_id, country, unnest(list_distinct(list_filter(addr_words, lambda w: length(w) >= 3))) AS w FROM rec WHERE src = 1) a JOIN (SELECT entity_id, country, unnest(list_distinct(list_filter(addr_words, lambda w: length(w) >= 3))) AS w FROM rec WHERE src <> 1) b USING (country, w) GROUP BY ALL HAVING count(*) >= 4")
def block_addr_overlap(spark, sf):
    return blocking.address_overlap(_records(spark, sf), 4)


def _tfidf_sql(low: int, high: int, min_df: int, max_df: float, least: float, k: int, anchors: bool) -> str:
    grams = " UNION ALL ".join(f"SELECT entity_id, src, country, CASE WHEN length(w) + 2 >= {n} THEN list_transform(range(1, length(w) + 2 - {n} + 2), lambda i: (' ' || w || ' ')[i:i + {n - 1}]) ELSE [' ' || w || ' '] END AS gs FROM wd" for n in range(low, high + 1))
    fit = "" if anchors else "WHERE src <> 1"
    return o.with_(*BASE, f"""wd AS (SELECT entity_id, src, country, unnest(words) AS w FROM rec), gr AS ({grams}),
tf AS (SELECT entity_id, src, country, g, count(*) AS tf FROM (SELECT entity_id, src, country, unnest(gs) AS g FROM gr) GROUP BY ALL),
nn AS (SELECT country, count(*) AS n FROM rec {fit} GROUP BY country),
idf AS (SELECT country, g, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT country, g, count(*) AS df FROM tf {fit} GROUP BY ALL) JOIN nn USING (country) WHERE df >= {min_df} AND df <= {max_df} * n),
wt AS (SELECT entity_id, src, country, g, tf * idf AS w FROM tf JOIN idf USING (country, g)),
ln_ AS (SELECT entity_id, sqrt(sum(w * w)) AS len FROM wt GROUP BY entity_id), un AS (SELECT wt.entity_id, src, country, g, w / len AS w FROM wt JOIN ln_ USING (entity_id)),
cs AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, round(sum(a.w * b.w), 6) AS cosine FROM un a JOIN un b ON a.country = b.country AND a.g = b.g AND a.src = 1 AND b.src <> 1 GROUP BY ALL)""") + f"SELECT * FROM cs WHERE cosine >= {least} QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY cosine DESC, cand_id) <= {k}"


@query(_tfidf_sql(2, 4, 1, 1.0, 0.3, 20, True))
def tfidf_topk(spark, sf):
    return blocking.tfidf_pairs(_records(spark, sf))


@query(_tfidf_sql(3, 5, 2, 0.25, 0.05, 10, False))
def tfidf_candidates_fitted(spark, sf):
    return blocking.tfidf_pairs(_records(spark, sf), 3, 5, 2, 0.25, 0.05, 10, False)


@query(o.with_(*BASE, o.pairs(["w12", "first_token", "bigram"], 1000), "hits AS (SELECT DISTINCT s1_id, cand_id, src, tier, score FROM ka JOIN few USING (tier, key) JOIN kb USING (tier, key)), ht AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY s1_id, tier ORDER BY score DESC, cand_id) <= 5), hp AS (SELECT s1_id, cand_id, src, max(score) AS score FROM ht GROUP BY ALL)") + "SELECT s1_id, cand_id, score FROM hp QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) <= 8")
def per_key_take(spark, sf):
    records, tiers = _records(spark, sf), ("w12", "first_token", "bigram")
    keys = blocking.pruned(blocking.key_table(records.where("src = 1"), tiers), 1000)
    return blocking.per_key_take(blocking.tier_hits(keys, blocking.key_table(records.where("src <> 1"), tiers, True)), 5, 8).select("s1_id", "cand_id", "score")


@query(o.with_(o.ENT, o.records("plain"), o.pairs(["exact"], 1 << 30)) + "SELECT s1_id, cand_id, p.src FROM pairs p JOIN rec r ON r.entity_id = p.cand_id QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY ord, cand_id) <= 3")
def exact_only_matches(spark, sf):
    return linkage.exact_only(entities(spark, sf))


_FOUR = o.pairs(["exact", "slug", "first_last", "num_name"], 1 << 30).replace("length(slug) >= 4", "length(slug) >= 6")


@query(o.with_(o.ENT, o.records("boosted"), _FOUR) + "SELECT s1_id, cand_id, p.src FROM pairs p JOIN rec r ON r.entity_id = p.cand_id QUALIFY row_number() OVER (PARTITION BY s1_id, p.src ORDER BY ord, cand_id) <= 3")
def four_key_matches(spark, sf):
    return linkage.four_keys(entities(spark, sf))


@query(o.with_(*PAIRS, o.TRUTH) + "SELECT s1_id, cand_id, CAST(EXISTS (SELECT 1 FROM truth t WHERE t.s1_id = p.s1_id AND t.cand_id = p.cand_id) AS INTEGER) AS label FROM topk p")
def label_pairs(spark, sf):
    return evaluate.labelled(_pairs(spark, sf), true_pairs(spark, sf)).select("s1_id", "cand_id", "label")


@query(o.with_(*PAIRS, o.TRUTH) + "SELECT s1_id, cand_id FROM truth ANTI JOIN topk USING (s1_id, cand_id)")
def missed_pairs(spark, sf):
    return evaluate.missed_pairs(true_pairs(spark, sf), _pairs(spark, sf))


@query(o.with_(*PAIRS, o.TRUTH) + "SELECT s1_id, cand_id, src, score FROM topk UNION ALL SELECT t.s1_id, t.cand_id, r.src, 95 FROM (SELECT s1_id, cand_id FROM truth ANTI JOIN topk USING (s1_id, cand_id)) t JOIN rec r ON r.entity_id = t.cand_id")
def augmented_pairs(spark, sf):
    return evaluate.augmented(_pairs(spark, sf), true_pairs(spark, sf), _records(spark, sf))


@query(o.with_(o.ENT, o.TRUTH) + "SELECT s1_id, cand_id FROM truth", "true_pairs")
def _true_pairs(spark, sf):
    return true_pairs(spark, sf)


# Similarities


def _measure(name: str, column: Callable[[], Column], sql: str | None) -> None:
    @query(None if sql is None else o.with_(*PAIRS, o.PAIRED) + f"SELECT s1_id, cand_id, round({sql}, 6) AS value FROM paired", f"sim_{name}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _paired(spark, sf).select("s1_id", "cand_id", F.round(column(), 6).alias("value"))


_TSORT = o.ratio(o.sorted_words("a_name"), o.sorted_words("b_name"))

_measure("levenshtein", lambda: sim.levenshtein_similarity(F.col("a_name"), F.col("b_name")), "CASE WHEN greatest(length(a_name), length(b_name)) = 0 THEN 1.0 ELSE 1 - levenshtein(a_name, b_name) / greatest(length(a_name), length(b_name)) END")
_measure("jaccard_tokens", lambda: sim.jaccard(F.col("a_words"), F.col("b_words")), o.jaccard("a_words", "b_words"))
_measure("ngram_jaccard", lambda: sim.jaccard(F.col("a_ngrams"), F.col("b_ngrams")), o.jaccard("a_ngrams", "b_ngrams"))
_measure("token_overlap", lambda: sim.token_overlap(F.col("a_words"), F.col("b_words")), "CASE WHEN greatest(len(list_distinct(a_words)), len(list_distinct(b_words))) = 0 THEN 1.0 ELSE len(list_intersect(a_words, b_words)) / greatest(len(list_distinct(a_words)), len(list_distinct(b_words))) END")
_measure("containment", lambda: sim.containment(F.col("a_addr_words"), F.col("b_addr_words")), "len(list_intersect(a_addr_words, b_addr_words)) / greatest(least(len(list_distinct(a_addr_words)), len(list_distinct(b_addr_words))), 1)")
_measure("jaro_winkler", lambda: sim.jaro_winkler(F.col("a_name"), F.col("b_name")), "CASE WHEN a_name = '' OR b_name = '' THEN 0.0 ELSE jaro_winkler_similarity(a_name, b_name) END")
_measure("ratio", lambda: sim.ratio(F.col("a_name"), F.col("b_name")), o.ratio("a_name", "b_name"))
_measure("token_sort", lambda: sim.token_sort_ratio(F.col("a_name"), F.col("b_name")), _TSORT)
_measure("token_set", lambda: sim.token_set_ratio(F.col("a_name"), F.col("b_name")), o.token_set("a_name", "b_name"))
_measure("partial", lambda: sim.partial_ratio(F.col("a_name"), F.col("b_name")), o.partial("a_name", "b_name"))
_measure("blocks", lambda: sim.blocks_ratio(F.col("a_name"), F.col("b_name")), None)
_measure("blocks_token_sort", lambda: sim.blocks_token_sort(F.col("a_name"), F.col("b_name")), None)
_measure("blocks_token_set", lambda: sim.blocks_token_set(F.col("a_name"), F.col("b_name")), None)


@query(o.with_(*PAIRS, o.PAIRED) + "SELECT s1_id, cand_id, " + ", ".join(f"round({sql}, 6) AS {n}" for n, sql in o.NATIVE.items()) + " FROM paired")
def features_native(spark, sf):
    return _rounded(_paired(spark, sf).select("s1_id", "cand_id", *(c.alias(n) for n, c in features.native_features().items())))


def _or(condition: str, then: str, other: float) -> str:
    return f"CASE WHEN {condition} THEN {then} ELSE {other} END"


_WORD1, _WORD2 = "coalesce({}_words[1], '')", "coalesce({}_words[-1], '')"
#: The measures that production features are made of, and the features by name.
_MEASURES = {
    "jw_name": o.jaro_winkler("a_name", "b_name"),
    "tsort_name": _TSORT,
    "tset_name": o.token_set("a_name", "b_name"),
    "ratio_name": o.ratio("a_name", "b_name"),
    "partial_name": o.partial("a_name", "b_name"),
    "jw_slug": o.jaro_winkler("a_slug", "b_slug"),
    "first_jw": _or(o.NAMES, o.jaro_winkler(_WORD1.format("a"), _WORD1.format("b")), 0.0),
    "last_jw": _or(o.NAMES, o.jaro_winkler(_WORD2.format("a"), _WORD2.format("b")), 0.0),
    "jw_addr": _or(o.BOTH, o.jaro_winkler("a_addr", "b_addr"), 0.5),
    "tsort_addr": _or(o.BOTH, o.ratio(o.sorted_words("a_addr"), o.sorted_words("b_addr")), 0.5),
    "tset_addr": _or(o.BOTH, o.token_set("a_addr", "b_addr"), 0.5),
}
_PLACE = f"(CASE WHEN {o.BOTH} THEN jw_addr ELSE 0.8 END)"
_CONFLICT = f"({o.differ('street_num')} OR {o.differ('pin')} OR ({o.BOTH} AND jw_addr < 0.35))"
_SQL43 = o.NATIVE | {name: name for name in _MEASURES} | {
    "ngram_jaccard": f"CASE WHEN len(a_ngrams) > 0 AND len(b_ngrams) > 0 THEN {o.jaccard('a_ngrams', 'b_ngrams')} ELSE jw_slug END",
    "product": f"jw_name * {_PLACE}",
    "mean": f"(jw_name + {_PLACE}) / 2",
    "least": f"least(jw_name, {_PLACE})",
    "most": f"greatest(jw_name, {_PLACE})",
    "high_both": o._num(f"jw_name >= 0.88 AND jw_addr >= 0.75 AND {o.BOTH}"),
    "high_missing": o._num(f"jw_name >= 0.88 AND NOT {o.BOTH}"),
    "high_conflict": o._num(f"jw_name >= 0.85 AND {_CONFLICT}"),
}
MEASURED = (*PAIRS, o.PAIRED, "measured AS (SELECT *, " + ", ".join(f"{sql} AS {name}" for name, sql in _MEASURES.items()) + " FROM paired)")


@query(o.with_(*MEASURED) + "SELECT s1_id, cand_id, " + ", ".join(f"round({_SQL43[name]}, 6) AS {name}" for name in features.FS43) + " FROM measured")
def features43(spark, sf):
    return _rounded(features.features43(_paired(spark, sf)).select("s1_id", "cand_id", *features.FS43))


_SQL11 = {
    **{name: _MEASURES[name] for name in ("jw_name", "tsort_name", "tset_name", "partial_name")},
    "exact_name": o.NATIVE["exact_name"],
    "exact_slug": o._num("a_slug = b_slug AND length(a_slug) >= 5"),
    "num_match": o.NATIVE["num_match"],
    "jw_addr": _or(o.BOTH, o.jaro_winkler("a_addr", "b_addr"), 0.0),
    "tset_addr": _or(o.BOTH, o.token_set("a_addr", "b_addr"), 0.0),
    "country_match": o.NATIVE["country_match"],
    "prio": "CAST(score AS DOUBLE)",
}


@query(o.with_(*PAIRS, o.PAIRED) + "SELECT s1_id, cand_id, " + ", ".join(f"round({sql}, 6) AS {name}" for name, sql in _SQL11.items()) + " FROM paired")
def features11(spark, sf):
    return _rounded(features.features11(_paired(spark, sf)).select("s1_id", "cand_id", *_SQL11))


def _library_sql() -> str:
    out = []
    for p, text, words in (("name", "name", "words"), ("address", "addr", "addr_words")):
        a, b = f"a_{text}", f"b_{text}"
        g = {n: (o.ngrams_sql(a, n, "none"), o.ngrams_sql(b, n, "none")) for n in (2, 3)}
        w1, w2 = f"a_{words}", f"b_{words}"
        out += [
            f"CAST(CAST({a} = {b} AS INTEGER) AS DOUBLE) AS {p}_exact",
            f"round(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END, 6) AS {p}_levenshtein",
            f"round({o.jaccard(w1, w2)}, 6) AS {p}_jaccard_token",
            f"round({o.jaccard(*g[2])}, 6) AS {p}_jaccard_char2",
            f"round({o.jaccard(*g[3])}, 6) AS {p}_jaccard_char3",
            f"round(CASE WHEN greatest(len(list_distinct({w1})), len(list_distinct({w2}))) = 0 THEN 1.0 ELSE len(list_intersect({w1}, {w2})) / greatest(len(list_distinct({w1})), len(list_distinct({w2}))) END, 6) AS {p}_token_overlap",
            f"round(abs(length({a}) - length({b})) / greatest(length({a}), length({b}), 1), 6) AS {p}_len_diff",
        ]
    out.append("CAST(CAST(len(a_words) > 0 AND len(b_words) > 0 AND a_words[1] = b_words[1] AS INTEGER) AS DOUBLE) AS name_first_token_match")
    return ", ".join(out)


def _cosine_sql(words: str, name: str) -> str:
    """Common table expressions that end in (s1_id, cand_id, value) of the pairs whose vectors have something in common."""
    grams = " UNION ALL ".join(f"SELECT entity_id, CASE WHEN length(w) + 2 >= {n} THEN list_transform(range(1, length(w) + 2 - {n} + 2), lambda i: (' ' || w || ' ')[i:i + {n - 1}]) ELSE [' ' || w || ' '] END AS gs FROM (SELECT entity_id, unnest({words}) AS w FROM rec)" for n in (2, 3, 4))
    return f"""{name}_tf AS (SELECT entity_id, g, count(*) AS tf FROM (SELECT entity_id, unnest(gs) AS g FROM ({grams})) GROUP BY ALL),
{name}_idf AS (SELECT g, ln((1 + (SELECT count(*) FROM rec)) / (1 + count(*))) + 1 AS idf FROM {name}_tf GROUP BY g),
{name}_w AS (SELECT entity_id, g, tf * idf AS w FROM {name}_tf JOIN {name}_idf USING (g)),
{name}_u AS (SELECT entity_id, g, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS w FROM {name}_w),
{name}_c AS (SELECT s1_id, cand_id, sum(a.w * b.w) AS value FROM topk JOIN {name}_u a ON a.entity_id = s1_id JOIN {name}_u b ON b.entity_id = cand_id AND a.g = b.g GROUP BY ALL)"""


@query(
    o.with_(*PAIRS, o.PAIRED, _cosine_sql("words", "cn"), _cosine_sql("addr_words", "ca"))
    + f"SELECT s1_id, cand_id, {_library_sql()}, round(coalesce(cn_c.value, 0), 6) AS name_tfidf_cosine, round(coalesce(ca_c.value, 0), 6) AS address_tfidf_cosine, {o.NATIVE['country_match']} AS country_match FROM paired LEFT JOIN cn_c USING (s1_id, cand_id) LEFT JOIN ca_c USING (s1_id, cand_id)"
)
def features_library(spark, sf):
    records = _records(spark, sf)
    done = features.library_features(features.library_pairs(_pairs(spark, sf), records))
    names = [f"{p}_{m}" for p in ("name", "address") for m in ("exact", "levenshtein", "jaccard_token", "jaccard_char2", "jaccard_char3", "token_overlap", "tfidf_cosine", "len_diff")]
    return _rounded(done.select("s1_id", "cand_id", *names, "name_first_token_match", "country_match"))


_NAMES18 = (
    "country_match name_exact name_squish_exact name_edit_sim name_token_sort name_jaccard_token name_jaccard_bigram name_jaccard_trigram name_common_tokens "
    "name_len_diff name_first_token_match addr_exact addr_edit_sim addr_jaccard_token addr_common_tokens both_exact max_name_sim"
).split()


def _ngram_sql(n: int) -> str:
    return f"CASE WHEN length(a_name) < {n} OR length(b_name) < {n} THEN {o._num('a_name = b_name')} ELSE {o.jaccard(o.ngrams_sql('a_name', n), o.ngrams_sql('b_name', n))} END"


def _sql18() -> dict[str, str]:
    at = [f"list_filter({x}_addr_words, lambda w: length(w) >= 1)" for x in "ab"]
    return {
        "country_match": o.NATIVE["country_match"],
        "name_exact": o._num("a_name = b_name"),
        "name_squish_exact": o._num("a_slug = b_slug AND length(a_slug) >= 4"),
        "name_edit_sim": o.ratio("a_name", "b_name"),
        "name_token_sort": o.ratio("array_to_string(list_sort(a_words), ' ')", "array_to_string(list_sort(b_words), ' ')"),
        "name_jaccard_token": o.jaccard("a_words", "b_words"),
        "name_jaccard_bigram": _ngram_sql(2),
        "name_jaccard_trigram": _ngram_sql(3),
        "name_common_tokens": "CAST(len(list_intersect(a_words, b_words)) AS DOUBLE)",
        "name_len_diff": o.NATIVE["name_len_diff"],
        "name_first_token_match": o._num(f"{_WORD1.format('a')} = {_WORD1.format('b')}"),
        "addr_exact": o._num("a_addr <> '' AND a_addr = b_addr"),
        "addr_edit_sim": o.ratio("a_addr[1:80]", "b_addr[1:80]"),
        "addr_jaccard_token": o.jaccard(*at),
        "addr_common_tokens": f"CAST(len(list_intersect({at[0]}, {at[1]})) AS DOUBLE)",
        "both_exact": o._num("a_name = b_name AND a_addr = b_addr AND a_name <> ''"),
        "name_jaro_winkler": o.jaro_winkler("a_name", "b_name"),
        "max_name_sim": f"greatest({o.jaro_winkler('a_name', 'b_name')}, {o.ratio('a_name', 'b_name')}, {o.jaccard('a_words', 'b_words')})",
    }


@query()
def features18_blocks(spark, sf):
    return _rounded(features.features18(_paired(spark, sf)).select("s1_id", "cand_id", *_NAMES18, "name_token_set"))


@query(o.with_(*PAIRS, o.PAIRED) + "SELECT s1_id, cand_id, " + ", ".join(f"round({sql}, 6) AS {name}" for name, sql in _sql18().items()) + " FROM paired")
def features18_jaro(spark, sf):
    return _rounded(features.features18(_paired(spark, sf), sim.ratio, jaro=True).select("s1_id", "cand_id", *_NAMES18, "name_jaro_winkler"))


# Decisions


@query(o.with_(*SCORED) + "SELECT s1_id, cand_id, prob, exact_brand, has_conflict FROM scored")
def rule_score(spark, sf):
    return _scored(spark, sf).select("s1_id", "cand_id", "prob", "exact_brand", "has_conflict")


@query(o.with_(*SCORED) + "SELECT s1_id, cand_id, prob FROM scored WHERE prob >= 0.5")
def match_threshold(spark, sf):
    return decide.above(_scored(spark, sf), 0.5).select("s1_id", "cand_id", "prob")


@query(o.with_(*SCORED) + "SELECT s1_id, cand_id, prob FROM scored WHERE prob >= 0.35 QUALIFY row_number() OVER (PARTITION BY s1_id, src ORDER BY prob DESC, cand_id) <= 3")
def match_top3_per_source(spark, sf):
    return decide.top_per_source(_scored(spark, sf), 0.35).select("s1_id", "cand_id", "prob")


@query(o.with_(*CHOSEN) + "SELECT s1_id, cand_id, prob FROM chosen")
def match_two_tier(spark, sf):
    return _chosen(spark, sf).select("s1_id", "cand_id", "prob")


@query(o.with_(*SCORED) + "SELECT s1_id, cand_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS r FROM scored) WHERE r <= 3 AND prob >= CASE r WHEN 1 THEN 0.4 WHEN 2 THEN 0.5 ELSE 0.6 END")
def match_by_rank(spark, sf):
    return decide.by_rank(_scored(spark, sf), (0.4, 0.5, 0.6), 3).select("s1_id", "cand_id", "prob")


@query(o.with_(*SCORED) + "SELECT s1_id, cand_id, prob FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) <= 5) WHERE prob >= 0.4 QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) <= 3")
def match_capped(spark, sf):
    return decide.capped(_scored(spark, sf), 5, 0.4).select("s1_id", "cand_id", "prob")


_JW = "CASE WHEN a_name = '' OR b_name = '' THEN 0.0 ELSE jaro_winkler_similarity(a_name, b_name) END"


@query(o.with_(*SCORED) + f"SELECT s1_id, cand_id FROM scored WHERE prob >= 0.3 AND NOT {o.differ('street_num')} AND {_JW} >= 0.65 AND NOT (len(list_filter(a_nums, lambda n: length(n) >= 2)) > 0 AND len(list_filter(b_nums, lambda n: length(n) >= 2)) > 0 AND NOT list_has_any(list_filter(a_nums, lambda n: length(n) >= 2), list_filter(b_nums, lambda n: length(n) >= 2)) AND {_JW} < 0.95)")
def match_filtered(spark, sf):
    pairs = decide.above(_scored(spark, sf), 0.3).where(~features._differ("street_num")).withColumn("jw", sim.jaro_winkler(F.col("a_name"), F.col("b_name")))
    return pairs.where((F.col("jw") >= 0.65) & ~(decide.disjoint_numbers(pairs, 2) & (F.col("jw") < 0.95))).select("s1_id", "cand_id")


_CLAIM = f"round(100 * prob + 70 * ({o.NATIVE['name_jaccard']}) + CASE WHEN {o.same('street_num')} THEN 30.0 WHEN {o.differ('street_num')} THEN -50.0 ELSE 0.0 END, 6)"
WON = (*CHOSEN, f"won AS (SELECT * FROM (SELECT *, {_CLAIM} AS claim FROM chosen) QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY claim DESC, s1_id) = 1)")


def _won(spark: SparkSession, sf: str) -> DataFrame:
    street = F.when(features._same("street_num"), 30.0).when(features._differ("street_num"), -50.0).otherwise(0.0)
    claims = _chosen(spark, sf).withColumn("claim", F.round(100 * F.col("prob") + 70 * features.native_features()["name_jaccard"] + street, 6))
    return decide.one_to_one(claims)


@query(o.with_(*WON) + "SELECT s1_id, cand_id, claim FROM won")
def resolve_injective(spark, sf):
    return _won(spark, sf).select("s1_id", "cand_id", "claim")


@query(o.with_(*CHOSEN) + "SELECT cand_id, count(DISTINCT s1_id) AS claims, count(DISTINCT s1_id) - 1 AS excess FROM chosen GROUP BY cand_id HAVING count(DISTINCT s1_id) > 1")
def claim_conflicts(spark, sf):
    return decide.conflicts(_chosen(spark, sf))


_AGREES = f"100 * prob + 50 * {o.token_set('a_addr', 'b_addr')} + 20 * {o.token_set('a_name', 'b_name')} + CASE WHEN {o.same('street_num')} THEN 30.0 WHEN {o.differ('street_num')} THEN -50.0 ELSE 0.0 END"


@query(o.with_(*SCORED, o.two_tier(0.60, 0.75), f"claimed AS (SELECT *, {_AGREES} AS claim FROM chosen)") + "SELECT s1_id, cand_id, src, prob FROM claimed QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY claim DESC, s1_id) = 1")
def link_production(spark, sf):
    return linkage.link(entities(spark, sf))[1]


@query(
    o.with_(*SCORED, f"m AS (SELECT *, CAST(substr(s1_id, 4) AS BIGINT) AS ord, CAST(substr(cand_id, 4) AS BIGINT) % 5 = 0 OR CAST(substr(s1_id, 4) AS BIGINT) % 7 = 0 AS unknown FROM scored WHERE prob >= 0.3)", f"f AS (SELECT *, CASE WHEN unknown THEN 0.0 ELSE 30 * {o.token_set('a_name', 'b_name')} + 70 * {o.token_set('a_addr', 'b_addr')} + CASE WHEN {o.same('street_num')} THEN 30.0 WHEN {o.differ('street_num')} THEN -50.0 ELSE 0.0 END END AS fits FROM m)")
    + "SELECT s1_id, cand_id FROM f QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY fits DESC, ord, s1_id) = 1"
)
def post_hoc_matches(spark, sf):
    """One anchor for each candidate of finished matches; some sides' records are missing."""
    number = F.substring("entity_id", 4, 20).cast("long")
    known = _records(spark, sf).where(~(((F.col("src") == 1) & (number % 7 == 0)) | ((F.col("src") != 1) & (number % 5 == 0))))
    matches = decide.above(_scored(spark, sf), 0.3).select("s1_id", "cand_id", F.substring("s1_id", 4, 20).cast("long").alias("ord"))
    return decide.post_hoc(matches, known).select("s1_id", "cand_id")


# Evaluation


@query(o.with_(*PAIRS, o.TRUTH, o.per_entity("topk")) + "SELECT round(sum(tp) / greatest(sum(n_true), 1), 6) AS pair_recall, round(sum(tp) / greatest(sum(n_pred), 1), 6) AS candidate_precision, round(avg(CASE WHEN tp > 0 OR n_true = 0 THEN 1.0 ELSE 0.0 END), 6) AS entity_coverage, CAST(sum(n_pred) AS BIGINT) AS candidates, round(avg(n_pred), 6) AS candidates_per_entity FROM per")
def blocking_recall(spark, sf):
    return _rounded(evaluate.blocking_report(_anchors(spark, sf), true_pairs(spark, sf), _pairs(spark, sf)))


@query(o.with_(*WON, o.TRUTH, o.per_entity("won")) + "SELECT s1_id, n_true, n_pred, tp, round(f05, 6) AS f05 FROM per")
def entity_f05(spark, sf):
    return _rounded(evaluate.entity_scores(_anchors(spark, sf), true_pairs(spark, sf), _won(spark, sf)))


@query(o.with_(*WON, o.TRUTH, o.per_entity("won")) + f"SELECT {o.SUMMARY} FROM per")
def macro_f05(spark, sf):
    return _rounded(evaluate.summary(evaluate.counts(_anchors(spark, sf), true_pairs(spark, sf), _won(spark, sf))))


@query(o.with_(*WON, o.TRUTH, o.per_entity("won")) + "SELECT round(avg(f05), 6) AS macro_f05, count(*) AS entities FROM per WHERE n_true > 0 OR n_pred > 0")
def macro_f05_union_keys(spark, sf):
    return _rounded(evaluate.macro_f05_union(true_pairs(spark, sf), _won(spark, sf)))


@query(o.with_(*WON, o.TRUTH, o.per_entity("won")) + "SELECT n_true = 0 AS singleton, count(*) AS entities, round(avg(f05), 6) AS macro_f05 FROM per GROUP BY 1")
def singleton_breakdown(spark, sf):
    return _rounded(evaluate.singleton_breakdown(evaluate.counts(_anchors(spark, sf), true_pairs(spark, sf), _won(spark, sf))))


@query(o.with_(*WON, o.TRUTH, o.per_entity("won")) + "SELECT round(min(f05), 6) AS least, round(max(f05), 6) AS most, round(median(f05), 6) AS middle FROM per")
def score_spread(spark, sf):
    return _rounded(evaluate.score_spread(evaluate.counts(_anchors(spark, sf), true_pairs(spark, sf), _won(spark, sf))))


@query(o.with_(*WON, o.TRUTH, o.per_entity("won"), "ab AS (SELECT coalesce(avg(f05) FILTER (n_true = 0), 0) AS a, coalesce(avg(f05) FILTER (n_true > 0), 0) AS f FROM per)") + "SELECT share, round(share * a + (1 - share) * f, 6) AS macro_f05 FROM ab, (SELECT CAST(unnest([0.056, 0.15, 0.25, 0.35, 0.50]) AS DOUBLE) AS share)")
def singleton_blend(spark, sf):
    return _rounded(evaluate.blend(evaluate.counts(_anchors(spark, sf), true_pairs(spark, sf), _won(spark, sf))))


@query(" UNION ALL ".join(f"SELECT CAST({x} AS DOUBLE) AS threshold, * FROM ({o.with_(*SCORED, f'hit AS (SELECT s1_id, cand_id FROM scored WHERE prob >= {x})', o.TRUTH, o.per_entity('hit'))}SELECT {o.SUMMARY} FROM per)" for x in THRESHOLDS))
def threshold_sweep(spark, sf):
    return _rounded(evaluate.threshold_sweep(_anchors(spark, sf), true_pairs(spark, sf), _scored(spark, sf), THRESHOLDS))


_STRATEGIES = {"all": "true", "no_conflict": f"NOT {o.differ('street_num')}", "brand": "exact_brand", "strict": "prob >= 0.7"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS strategy, * FROM ({o.with_(*SCORED, f'hit AS (SELECT s1_id, cand_id FROM scored WHERE prob >= 0.3 AND ({sql}))', o.TRUTH, o.per_entity('hit'))}SELECT {o.SUMMARY} FROM per)" for n, sql in _STRATEGIES.items()))
def strategy_grid(spark, sf):
    scored = decide.above(_scored(spark, sf), 0.3)
    strategies = {"all": scored, "no_conflict": scored.where(~features._differ("street_num")), "brand": scored.where("exact_brand"), "strict": scored.where("prob >= 0.7")}
    return _rounded(evaluate.strategy_grid(_anchors(spark, sf), true_pairs(spark, sf), strategies))


def _rules_sql(grid) -> str:
    rows = ", ".join(f"('{n}', {t}, '{r}', {m})" for n, t, r, m in grid)
    long = ["list_filter({}_nums, lambda n: length(n) >= 2)".format(x) for x in "ab"]
    disjoint = {"disjoint": ("a_nums", "b_nums"), "disjoint_long": long}
    refused = " ".join(f"WHEN '{r}' THEN len({a}) > 0 AND len({b}) > 0 AND NOT list_has_any({a}, {b}) AND {o.jaro_winkler('a_name', 'b_name')} < 0.95" for r, (a, b) in disjoint.items())
    return o.with_(
        *SCORED,
        f"g AS (SELECT * FROM (VALUES {rows}) v(strategy, threshold, rule, lowest))",
        f"hit AS (SELECT strategy, s1_id, cand_id FROM scored, g WHERE prob >= threshold AND {o.jaro_winkler('a_name', 'b_name')} >= lowest AND NOT CASE rule WHEN 'num' THEN {o.differ('street_num')} {refused} ELSE false END QUALIFY row_number() OVER (PARTITION BY strategy, s1_id, src ORDER BY prob DESC, cand_id) <= 3)",
        o.TRUTH,
        "ent_counts AS (SELECT strategy, s1_id, (SELECT count(*) FROM truth t WHERE t.s1_id = a.s1_id) AS n_true, (SELECT count(*) FROM hit p WHERE p.s1_id = a.s1_id AND p.strategy = g.strategy) AS n_pred, (SELECT count(*) FROM hit p JOIN truth t USING (s1_id, cand_id) WHERE p.s1_id = a.s1_id AND p.strategy = g.strategy) AS tp FROM anchors a, g)",
        f"per AS (SELECT *, {o.F05} AS f05 FROM ent_counts)",
    ) + f"SELECT strategy, {o.SUMMARY} FROM per GROUP BY strategy"


def _rule_query(name: str, grid) -> None:
    @query(_rules_sql(grid), name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _rounded(evaluate.rule_grid(_anchors(spark, sf), true_pairs(spark, sf), decide.with_marks(_scored(spark, sf)), grid))


_rule_query("rule_grid_numbers", evaluate.GRID_NUMBERS)
_rule_query("rule_grid_singletons", evaluate.GRID_SINGLETONS)
_rule_query("rule_grid_disjoint", evaluate.GRID_DISJOINT)


_GRID = [(p, s) for p in (0.3, 0.4) for s in (0.4, 0.5, 0.6) if s >= p]


@query(" UNION ALL ".join(f"SELECT '{p}/{s}' AS setting, * FROM ({o.with_(*SCORED, f'hit AS (SELECT s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS r FROM scored) WHERE r <= 4 AND prob >= CASE r WHEN 1 THEN {p} ELSE {s} END)', o.TRUTH, o.per_entity('hit'))}SELECT {o.SUMMARY} FROM per)" for p, s in _GRID))
def two_tier_grid(spark, sf):
    return _rounded(model.two_tier_grid(_anchors(spark, sf), true_pairs(spark, sf), _scored(spark, sf), [0.3, 0.4], [0.4, 0.5, 0.6]))


_THREE = [(p, s, x) for p in model.THREE_TIERS[0] for s in model.THREE_TIERS[1] for x in model.THREE_TIERS[2] if p <= s <= x]


@query(
    o.with_(
        *SCORED,
        "g AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}/{s}/{x}', {p}, {s}, {x})" for p, s, x in _THREE) + ") v(strategy, t1, t2, t3))",
        "hit AS (SELECT strategy, s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS r FROM scored), g WHERE r <= 3 AND prob >= CASE r WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END)",
        o.TRUTH,
        "ent_counts AS (SELECT strategy, s1_id, (SELECT count(*) FROM truth t WHERE t.s1_id = a.s1_id) AS n_true, (SELECT count(*) FROM hit p WHERE p.s1_id = a.s1_id AND p.strategy = g.strategy) AS n_pred, (SELECT count(*) FROM hit p JOIN truth t USING (s1_id, cand_id) WHERE p.s1_id = a.s1_id AND p.strategy = g.strategy) AS tp FROM anchors a, g)",
        f"per AS (SELECT *, {o.F05} AS f05 FROM ent_counts)",
    )
    + f"SELECT strategy AS setting, {o.SUMMARY} FROM per GROUP BY strategy"
)
def three_tier_grid(spark, sf):
    return _rounded(model.three_tier_grid(_anchors(spark, sf), true_pairs(spark, sf), _scored(spark, sf)))


_KS = [5, 10, 20, 30, 50]


@query(
    _tfidf_sql(3, 5, 2, 0.25, 0.05, 50, False).split("SELECT * FROM cs WHERE")[0].replace("cs AS (", o.pairs(blocking.PRODUCTION) + ", " + o.top(K) + ", " + o.TRUTH + ",\ncs AS (")
    + """, rk AS (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY cosine DESC, cand_id) AS r FROM cs WHERE cosine >= 0.05),
ks AS (SELECT CAST(unnest([5, 10, 20, 30, 50]) AS INTEGER) AS top_k), un2 AS (SELECT top_k, s1_id, cand_id FROM topk, ks UNION SELECT top_k, s1_id, cand_id FROM rk, ks WHERE r <= top_k),
ec AS (SELECT top_k, s1_id, (SELECT count(*) FROM truth t WHERE t.s1_id = a.s1_id) AS n_true, (SELECT count(*) FROM un2 p WHERE p.s1_id = a.s1_id AND p.top_k = ks.top_k) AS n_pred, (SELECT count(*) FROM un2 p JOIN truth t USING (s1_id, cand_id) WHERE p.s1_id = a.s1_id AND p.top_k = ks.top_k) AS tp FROM anchors a, ks)
SELECT top_k, CAST(sum(n_pred) AS BIGINT) AS candidate_count, round(avg(n_pred), 6) AS avg_candidates_per_entity, round(sum(tp) / greatest(sum(n_true), 1), 6) AS pair_recall, round(avg(CASE WHEN tp > 0 OR n_true = 0 THEN 1.0 ELSE 0.0 END), 6) AS entity_coverage FROM ec GROUP BY top_k"""
)
def blocking_sweep(spark, sf):
    """Rules and the k best by TF-IDF, for each k: ranked once to the largest."""
    found = blocking.ranked(blocking.tfidf_pairs(_records(spark, sf), 3, 5, 2, 0.25, 0.05, max(_KS), False), max(_KS))
    return _rounded(evaluate.blocking_by_k(_anchors(spark, sf), true_pairs(spark, sf), _pairs(spark, sf), found, _KS))


@query(o.with_(*SCORED, o.TRUTH) + "SELECT cutoff, count(*) FILTER (prob >= cutoff) AS pairs, count(*) FILTER (prob >= cutoff AND t.s1_id IS NOT NULL) AS true_pairs FROM scored s LEFT JOIN truth t USING (s1_id, cand_id), (SELECT CAST(unnest([0.3, 0.5, 0.7, 0.9]) AS DOUBLE) AS cutoff) GROUP BY cutoff")
def probability_spread(spark, sf):
    return evaluate.probability_spread(_scored(spark, sf), true_pairs(spark, sf), [0.3, 0.5, 0.7, 0.9])


@query(o.with_(*PAIRS, o.TRUTH) + "SELECT count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative, round(count(*) FILTER (label = 0) / greatest(count(*) FILTER (label = 1), 1), 6) AS positive_weight FROM (SELECT CAST(t.s1_id IS NOT NULL AS INTEGER) AS label FROM topk p LEFT JOIN truth t USING (s1_id, cand_id))")
def class_balance(spark, sf):
    return _rounded(model.class_balance(evaluate.labelled(_pairs(spark, sf), true_pairs(spark, sf))))


@query()
def gbt_scores(spark, sf):
    """Scores of the validation split's pairs by a model of the others'."""
    # The labels are read by the training and by the scoring; kept, they aren't found twice. They are few and small.
    labelled = evaluate.labelled(features.features43(_paired(spark, sf)), true_pairs(spark, sf).persist())
    fitted = model.fit(labelled.where(~model.in_split()), trees=10)
    return model.scored(fitted, labelled.where(model.in_split())).select("s1_id", "cand_id", "label", F.round("prob", 6).alias("prob"))


# Profiles, validation, sinks


@query(o.with_(*CHOSEN, o.TRUTH) + "SELECT c AS matches, count(*) AS anchors FROM (SELECT s1_id, (SELECT count(*) FROM chosen p WHERE p.s1_id = a.s1_id) AS c FROM anchors a) GROUP BY c")
def match_count_distribution(spark, sf):
    return profile.match_distribution(_anchors(spark, sf), _chosen(spark, sf))


@query(o.with_(o.ENT) + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL OR {c} = '') AS missing, round(100 * count(*) FILTER ({c} IS NULL OR {c} = '') / count(*), 2) AS percent FROM ent" for c in ("business_name", "business_address", "country")))
def missing_value_profile(spark, sf):
    return profile.missing_values(entities(spark, sf), ["business_name", "business_address", "country"])


@query(o.with_(o.ENT) + "SELECT country, count(*) AS n FROM ent GROUP BY country ORDER BY n DESC, country LIMIT 10")
def country_distribution(spark, sf):
    return profile.frequencies(entities(spark, sf), "country")


@query(o.with_(o.ENT) + "SELECT count(*) AS rows, count(DISTINCT entity_id) AS ids FROM ent")
def distinct_ids(spark, sf):
    return profile.distinct_ids(entities(spark, sf))


@query(o.with_(*WON) + "SELECT string_split(cand_id, '-')[1] AS source, count(*) AS matches, count(DISTINCT s1_id) AS anchors FROM won GROUP BY 1")
def matches_by_source(spark, sf):
    return profile.by_source(_won(spark, sf))


@query(o.with_(*WON) + "SELECT s1_id, arg_max(cand_id, (prob, cand_id)) AS cand_id, max(prob) AS prob FROM scored WHERE s1_id NOT IN (SELECT s1_id FROM won) GROUP BY s1_id")
def rejected_best(spark, sf):
    return profile.rejected(_anchors(spark, sf), _scored(spark, sf), _won(spark, sf))


@query(o.with_(*WON, "best AS (SELECT s1_id, max(prob) AS prob FROM scored WHERE s1_id NOT IN (SELECT s1_id FROM won) GROUP BY s1_id)") + "SELECT count(*) AS n, round(avg(prob), 6) AS mean, round(stddev_samp(prob), 6) AS std, min(prob) AS least, max(prob) AS most, " + "".join(f"round(quantile_cont(prob, {q}), 6) AS q{int(100 * q)}, " for q in (0.25, 0.5, 0.75)) + ", ".join(f"round(avg(CAST(prob >= {c} AS INTEGER)), 6) AS above_{int(100 * c)}" for c in (0.5, 0.7, 0.8)) + " FROM best")
def rejected_tail(spark, sf):
    return _rounded(profile.tail(profile.rejected(_anchors(spark, sf), _scored(spark, sf), _won(spark, sf))))


def _lists(pairs: str, name: str) -> str:
    return f"SELECT s1_id AS source1_entity_id, coalesce((SELECT string_agg(cand_id, ',' ORDER BY cand_id) FROM {pairs} p WHERE p.s1_id = a.s1_id), '') AS {name} FROM anchors a"


@query(o.with_(*WON, o.TRUTH) + _lists("won", "matched_entity_ids"))
def output_rows(spark, sf):
    return tables.id_lists(_anchors(spark, sf), _won(spark, sf), "matched_entity_ids")


@query(o.with_(*PAIRS, o.TRUTH) + _lists("topk", "candidate_entity_ids"))
def candidate_rows(spark, sf):
    return tables.id_lists(_anchors(spark, sf), _pairs(spark, sf), "candidate_entity_ids")


#: Results with planted faults, so that every rule of the contract has something to find.
_BROKEN = """ok AS (SELECT s1_id, string_agg(cand_id, ',' ORDER BY cand_id) AS ids FROM topk GROUP BY s1_id),
m AS (SELECT s1_id, CASE WHEN CAST(substr(s1_id, 4) AS BIGINT) % 7 = 0 THEN ids || ',' || string_split(ids, ',')[1] WHEN CAST(substr(s1_id, 4) AS BIGINT) % 11 = 0 THEN ids || ',S9-1' ELSE ids END AS ids FROM ok WHERE CAST(substr(s1_id, 4) AS BIGINT) % 5 <> 0
  UNION ALL SELECT s1_id, ids FROM ok WHERE CAST(substr(s1_id, 4) AS BIGINT) % 13 = 0 UNION ALL SELECT 'S1-none', ''),
li AS (SELECT s1_id, id FROM (SELECT s1_id, unnest(string_split(ids, ',')) AS id FROM m) WHERE id <> ''), lc AS (SELECT s1_id, unnest(string_split(ids, ',')) AS id FROM ok)"""


@query(
    o.with_(*PAIRS, o.TRUTH, _BROKEN)
    + """SELECT 'duplicate_anchor' AS rule, s1_id, NULL AS id, count(*) AS n FROM m GROUP BY s1_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'unknown_anchor', s1_id, NULL, 1 FROM m WHERE s1_id NOT IN (SELECT s1_id FROM anchors)
UNION ALL SELECT 'repeated_match', s1_id, id, count(*) FROM li GROUP BY s1_id, id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'unknown_match', s1_id, id, 1 FROM li WHERE id NOT IN (SELECT entity_id FROM ent WHERE src <> 1)
UNION ALL SELECT 'missing_anchor', s1_id, NULL, 1 FROM anchors WHERE s1_id NOT IN (SELECT s1_id FROM m)
UNION ALL SELECT 'duplicate_candidate_row', s1_id, NULL, 2 FROM ok WHERE CAST(substr(s1_id, 4) AS BIGINT) % 17 = 0
UNION ALL SELECT DISTINCT 'match_not_candidate', s1_id, id, 1 FROM li WHERE (s1_id, id) NOT IN (SELECT s1_id, id FROM lc)"""
)
def validate_output(spark, sf):
    ok = _pairs(spark, sf).groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list("cand_id")), ",").alias("ids"))
    n = F.substring("s1_id", 4, 20).cast("long")
    first = F.split("ids", ",")[0]
    changed = F.when(n % 7 == 0, F.concat_ws(",", "ids", first)).when(n % 11 == 0, F.concat_ws(",", "ids", F.lit("S9-1"))).otherwise(F.col("ids"))
    rows = ok.where(n % 5 != 0).select("s1_id", changed.alias("ids")).union(ok.where(n % 13 == 0)).union(spark.sql("select 'S1-none', ''"))
    named = rows.select(F.col("s1_id").alias("source1_entity_id"), F.col("ids").alias("matched_entity_ids"))
    return validate.issues(entities(spark, sf), named, ok.union(ok.where(n % 17 == 0)).select(F.col("s1_id").alias("source1_entity_id"), F.col("ids").alias("candidate_entity_ids")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
