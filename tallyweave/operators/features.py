"""Feature sets of candidate pairs, as columns over pairs joined with both sides' records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import similarity as s
from tallyweave.functions import text as t
from tallyweave.operators import blocking

FIELDS = ("name", "slug", "addr", "street_num", "country", "nums", "words", "addr_words", "pin", "state", "city", "ngrams")

# The names of the production features, in the model's order.
FS43 = (
    "jw_name tsort_name tset_name ratio_name partial_name exact_name exact_name_long exact_slug jw_slug name_starts name_contains "
    "name_jaccard ngram_jaccard name_len_diff first_jw last_jw both_addr addr_missing jw_addr tsort_addr tset_addr exact_addr "
    "addr_jaccard addr_containment addr_shared addr_len_diff country_match city_match state_match city_or_state pin_match pin_conflict "
    "num_match num_conflict shared_nums disjoint_nums product mean least most high_both high_missing high_conflict"
).split()


def with_records(pairs: DataFrame, records: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Pairs with both sides' record fields as a_<field> (anchor) and b_<field> (candidate); pairs with an unknown side go."""
    a = records.select(F.col("entity_id").alias("s1_id"), *(F.col(f).alias(f"a_{f}") for f in fields))
    b = records.select(F.col("entity_id").alias("cand_id"), *(F.col(f).alias(f"b_{f}") for f in fields))
    return pairs.join(a, "s1_id").join(b, "cand_id")


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _a(name: str) -> Column:
    return F.col(f"a_{name}")


def _b(name: str) -> Column:
    return F.col(f"b_{name}")


def _same(name: str) -> Column:
    return (_a(name) != "") & (_a(name) == _b(name))


def _differ(name: str) -> Column:
    return (_a(name) != "") & (_b(name) != "") & (_a(name) != _b(name))


def _either(one: Column, other: Column, name: str) -> Column:
    return (F.length(_a(name)) >= 4) & (F.length(_b(name)) >= 4) & (one | other)


def _tail(words: Column) -> Column:
    return F.when(F.size(words) <= 2, words).otherwise(F.slice(words, -2, 2))


def native_features() -> dict[str, Column]:
    """The production features that need no Python."""
    both = (_a("addr") != "") & (_b("addr") != "")
    names = (F.size(_a("words")) > 0) & (F.size(_b("words")) > 0)
    city, state = _same("city"), _same("state")
    shared_nums = F.size(F.array_intersect(_a("nums"), _b("nums")))
    return {
        "exact_name": _flag(_same("name")),
        "exact_name_long": _flag((_a("name") == _b("name")) & (F.length(_a("name")) >= 5)),
        "exact_slug": _flag((_a("slug") == _b("slug")) & (F.length(_a("slug")) >= 4)),
        "name_starts": _flag(_either(_a("name").startswith(_b("name")), _b("name").startswith(_a("name")), "name")),
        "name_contains": _flag(_either(_a("name").contains(_b("name")), _b("name").contains(_a("name")), "name")),
        "name_jaccard": F.when(names, s.jaccard(_a("words"), _b("words"))).otherwise(0.0),
        "name_len_diff": s.length_difference(_a("name"), _b("name")),
        "both_addr": _flag(both),
        "addr_missing": _flag(~both),
        "exact_addr": _flag(both & (_a("addr") == _b("addr"))),
        "addr_jaccard": F.when(both, s.jaccard(_a("addr_words"), _b("addr_words"))).otherwise(0.0),
        "addr_containment": F.when(both, s.containment(_a("addr_words"), _b("addr_words"))).otherwise(0.5),
        "addr_shared": F.when(both, s.shared(_a("addr_words"), _b("addr_words")).cast("double")).otherwise(0.0),
        "addr_len_diff": s.length_difference(_a("addr"), _b("addr")),
        "country_match": _flag(_a("country") == _b("country")),
        "city_match": _flag(city),
        "state_match": _flag(state),
        "city_or_state": _flag(city | state | F.arrays_overlap(_tail(_a("addr_words")), _tail(_b("addr_words")))),
        "pin_match": _flag(_same("pin")),
        "pin_conflict": _flag(_differ("pin")),
        "num_match": _flag(_same("street_num")),
        "num_conflict": _flag(_differ("street_num")),
        "shared_nums": shared_nums.cast("double"),
        "disjoint_nums": _flag((F.size(_a("nums")) > 0) & (F.size(_b("nums")) > 0) & (shared_nums == 0)),
    }


def features43(pairs: DataFrame) -> DataFrame:
    """Pairs (with both sides' records) and the 43 production features; the string measures run in one pass of Arrow UDFs."""
    both = (_a("addr") != "") & (_b("addr") != "")
    names = (F.size(_a("words")) > 0) & (F.size(_b("words")) > 0)
    measured = pairs.withColumns(
        {
            "jw_name": s.jaro_winkler(_a("name"), _b("name")),
            "tsort_name": s.token_sort_ratio(_a("name"), _b("name")),
            "tset_name": s.token_set_ratio(_a("name"), _b("name")),
            "ratio_name": s.ratio(_a("name"), _b("name")),
            "partial_name": s.partial_ratio(_a("name"), _b("name")),
            "jw_slug": s.jaro_winkler(_a("slug"), _b("slug")),
            "first_jw": s.jaro_winkler(t.first_or(_a("words")), t.first_or(_b("words"))),
            "last_jw": s.jaro_winkler(t.last_or(_a("words")), t.last_or(_b("words"))),
            "_jw_addr": s.jaro_winkler(_a("addr"), _b("addr")),
            "_tsort_addr": s.token_sort_ratio(_a("addr"), _b("addr")),
            "_tset_addr": s.token_set_ratio(_a("addr"), _b("addr")),
        }
    )
    full = measured.withColumns(native_features()).withColumns(
        {
            "first_jw": F.when(names, F.col("first_jw")).otherwise(0.0),
            "last_jw": F.when(names, F.col("last_jw")).otherwise(0.0),
            "ngram_jaccard": F.when((F.size(_a("ngrams")) > 0) & (F.size(_b("ngrams")) > 0), s.jaccard(_a("ngrams"), _b("ngrams"))).otherwise(F.col("jw_slug")),
            "jw_addr": F.when(both, F.col("_jw_addr")).otherwise(0.5),
            "tsort_addr": F.when(both, F.col("_tsort_addr")).otherwise(0.5),
            "tset_addr": F.when(both, F.col("_tset_addr")).otherwise(0.5),
        }
    )
    place = F.when(both, F.col("jw_addr")).otherwise(0.8)
    conflict = (F.col("num_conflict") == 1) | (F.col("pin_conflict") == 1) | (both & (F.col("jw_addr") < 0.35))
    combined = full.withColumns(
        {
            "product": F.col("jw_name") * place,
            "mean": (F.col("jw_name") + place) / 2,
            "least": F.least(F.col("jw_name"), place),
            "most": F.greatest(F.col("jw_name"), place),
            "high_both": _flag((F.col("jw_name") >= 0.88) & (F.col("jw_addr") >= 0.75) & both),
            "high_missing": _flag((F.col("jw_name") >= 0.88) & ~both),
            "high_conflict": _flag((F.col("jw_name") >= 0.85) & conflict),
        }
    )
    return combined.drop("_jw_addr", "_tsort_addr", "_tset_addr")


def features11(pairs: DataFrame) -> DataFrame:
    """The eleven features of the early generation, the blocking score among them (pairs must have ``score``)."""
    both = (_a("addr") != "") & (_b("addr") != "")
    return pairs.withColumns(
        {
            "jw_name": s.jaro_winkler(_a("name"), _b("name")),
            "tsort_name": s.token_sort_ratio(_a("name"), _b("name")),
            "tset_name": s.token_set_ratio(_a("name"), _b("name")),
            "partial_name": s.partial_ratio(_a("name"), _b("name")),
            "exact_name": _flag(_same("name")),
            "exact_slug": _flag((_a("slug") == _b("slug")) & (F.length(_a("slug")) >= 5)),
            "num_match": _flag(_same("street_num")),
            "jw_addr": F.when(both, s.jaro_winkler(_a("addr"), _b("addr"))).otherwise(0.0),
            "tset_addr": F.when(both, s.token_set_ratio(_a("addr"), _b("addr"))).otherwise(0.0),
            "country_match": _flag(_a("country") == _b("country")),
            "prio": F.col("score").cast("double"),
        }
    )


def _ngram_equal(a: Column, b: Column, n: int) -> Column:
    """n-gram Jaccard; texts shorter than n are alike only if equal."""
    return F.when((F.length(a) < n) | (F.length(b) < n), (a == b).cast("double")).otherwise(s.jaccard(t.char_ngrams(a, n), t.char_ngrams(b, n)))


def library_pairs(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs with what library_features reads: both sides' cleaned texts, words and countries, and the cosines of names and addresses.

    Each side is joined once, and pairs carry texts and countries only; their words are cut from the texts after that.  In cosines
    the rows that share an id are one text, which goes along where there are several.
    """
    same = Window.partitionBy("entity_id")
    texts = {"name": "words", "addr": "addr_words"}
    several = F.count(F.lit(1)).over(same) > 1
    whole = {f"{text}_all": F.when(several, F.array_join(F.collect_list(F.when(F.col(text) != "", F.col(text))).over(same), " ")) for text in texts}
    paired = with_records(pairs, records.select("entity_id", "country", *texts, *(c.alias(n) for n, c in whole.items())), ("country", *texts, *whole))
    paired = paired.withColumns({f"{side}_{words}": t.tokens(F.col(f"{side}_{text}")) for text, words in texts.items() for side in "ab"})
    cosines = {"name_cosine": "name", "address_cosine": "addr"}
    given = {text: [F.coalesce(F.col(f"{side}_{text}_all"), F.array_join(f"{side}_{texts[text]}", " ")) for side in "ab"] for text in texts}
    return paired.withColumns({name: blocking.cosine_of(records, texts[text])(*given[text]) for name, text in cosines.items()})


def library_features(pairs: DataFrame) -> DataFrame:
    """The 18 features of the library path: name_ and address_ measures on cleaned texts, tf-idf cosines (0 unless the pairs have them) and the country."""
    out: dict[str, Column] = {}
    for prefix, text, words in (("name", "name", "words"), ("address", "addr", "addr_words")):
        a, b = _a(text), _b(text)
        cosine = f"{prefix}_cosine"
        out |= {
            f"{prefix}_exact": _flag(a == b),
            f"{prefix}_levenshtein": s.levenshtein_similarity(a, b),
            f"{prefix}_jaccard_token": s.jaccard(_a(words), _b(words)),
            f"{prefix}_jaccard_char2": s.jaccard(t.char_ngrams(a, 2, "none"), t.char_ngrams(b, 2, "none")),
            f"{prefix}_jaccard_char3": s.jaccard(t.char_ngrams(a, 3, "none"), t.char_ngrams(b, 3, "none")),
            f"{prefix}_token_overlap": s.token_overlap(_a(words), _b(words)),
            f"{prefix}_tfidf_cosine": F.coalesce(F.col(cosine), F.lit(0.0)) if cosine in pairs.columns else F.lit(0.0),
            f"{prefix}_len_diff": s.length_difference(a, b),
        }
    out["name_first_token_match"] = _flag((F.size(_a("words")) > 0) & (t.first_or(_a("words")) == t.first_or(_b("words"))))
    out["country_match"] = _flag(_a("country") == _b("country"))
    return pairs.withColumns(out)


def features18(pairs: DataFrame, ratio=s.blocks_ratio, jaro: bool = False) -> DataFrame:
    """The 18 features of the second generation.

    ``jaro`` chooses the variant with Jaro-Winkler in place of the token-set ratio, whose edit measure is the indel ratio (pass ``s.ratio``).
    """
    n1, n2, a1, a2 = _a("name"), _b("name"), _a("addr"), _b("addr")
    sorted1, sorted2 = F.array_join(F.array_sort(_a("words")), " "), F.array_join(F.array_sort(_b("words")), " ")
    least = 1 if jaro else 3
    at1, at2 = (F.filter(w, lambda x: F.length(x) >= least) for w in (_a("addr_words"), _b("addr_words")))
    common = {
        "country_match": _flag(_a("country") == _b("country")),
        "name_exact": _flag(n1 == n2),
        "name_squish_exact": _flag((_a("slug") == _b("slug")) & (F.length(_a("slug")) >= 4)),
        "name_edit_sim": ratio(n1, n2),
        "name_token_sort": ratio(sorted1, sorted2),
        "name_jaccard_token": s.jaccard(_a("words"), _b("words")),
        "name_jaccard_bigram": _ngram_equal(n1, n2, 2),
        "name_jaccard_trigram": _ngram_equal(n1, n2, 3),
        "name_common_tokens": s.shared(_a("words"), _b("words")).cast("double"),
        "name_len_diff": s.length_difference(n1, n2),
        "name_first_token_match": _flag((t.first_or(_a("words")) == t.first_or(_b("words"))) & (F.lit(jaro) | (F.size(_a("words")) > 0))),
        "addr_exact": _flag((a1 != "") & (a1 == a2)),
        "addr_edit_sim": ratio(F.left(a1, F.lit(80)), F.left(a2, F.lit(80))),
        "addr_jaccard_token": s.jaccard(at1, at2),
        "addr_common_tokens": s.shared(at1, at2).cast("double"),
        "both_exact": _flag((n1 == n2) & (a1 == a2) & (n1 != "")),
    }
    if jaro:
        done = pairs.withColumns(common | {"name_jaro_winkler": s.jaro_winkler(n1, n2)})
        return done.withColumn("max_name_sim", F.greatest("name_jaro_winkler", "name_edit_sim", "name_jaccard_token"))
    done = pairs.withColumns(common | {"name_token_set": s.blocks_token_set(n1, n2)})
    return done.withColumn("max_name_sim", F.greatest("name_edit_sim", "name_token_sort"))


def rule_score(pairs: DataFrame) -> DataFrame:
    """``prob`` from native features by a fixed weighting: a score that needs no trained model."""
    f = native_features()
    weights = {"exact_name": 0.30, "exact_slug": 0.15, "name_jaccard": 0.20, "addr_jaccard": 0.10, "num_match": 0.15, "pin_match": 0.10}
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + weight * f[name]
    penalty = F.lit(0.10) * f["num_conflict"] + F.lit(0.05) * f["pin_conflict"]
    conflict = _differ("street_num") | _differ("pin")
    brand = (_a("name") == _b("name")) & (F.length(_a("name")) >= 5) & (_a("country") == _b("country")) & ~_differ("street_num")
    return pairs.withColumns({"prob": F.round(F.greatest(F.lit(0.0), total - penalty), 6), "exact_brand": brand, "has_conflict": conflict})
