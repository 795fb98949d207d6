"""Normalised records: everything that blocking and features need, computed once for each entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import scripts
from tallyweave.functions import text as t


def normalised(entities: DataFrame, rules: str = "v5") -> DataFrame:
    """entity_id, src, ord and the fields of a normalised record of each entity.

    Null names, addresses and countries count as ''.  Numbers, postal code, state and city come
    from the raw address.  Rule sets that fold to Latin letters spell other scripts in them first.  Works on one row at a time, without a shuffle.
    """
    spell = scripts.transliterate if t.NAME_RULES[rules].fold == "latin" else lambda c: c
    raw = F.coalesce(F.col("business_address"), F.lit(""))
    base = entities.select(
        "entity_id",
        "src",
        "ord",
        raw.alias("raw"),
        t.clean_name(spell(F.col("business_name")), t.NAME_RULES[rules]).alias("name"),
        t.clean_name(spell(F.col("business_address")), t.NAME_RULES[rules]).alias("_street"),
        t.upper_country(F.col("country")).alias("country"),
    ).withColumn("addr", t.clean_addr(spell(F.col("raw")), F.col("country")))
    slug = {"wide": t.SLUG_WORDS_WIDE, "generic": t.SLUG_WORDS_WIDE}.get(rules, t.SLUG_WORDS)
    return base.select(
        "entity_id",
        "src",
        "ord",
        "name",
        t.squish(F.col("name"), slug).alias("slug"),
        "addr",
        t.street_num(F.col("raw")).alias("street_num"),
        "country",
        t.all_nums(F.col("raw")).alias("nums"),
        t.tokens(F.col("name")).alias("words"),
        t.tokens(F.col("addr")).alias("addr_words"),
        t.pin_code(F.col("raw"), F.col("country")).alias("pin"),
        t.state_of(F.col("raw"), F.col("addr"), F.col("country")).alias("state"),
        t.city_of(F.col("raw"), F.col("addr"), F.col("country")).alias("city"),
        t.char_ngrams(F.col("name"), 3).alias("ngrams"),
        t.street_prefix(F.col("_street"), 3).alias("street3"),
        t.street_prefix(F.col("_street"), 2, False).alias("street2"),
        t.last_words(t.tokens(F.col("addr")), 3).alias("city_words"),
    )
