"""Record linkage from entities to matches, as one declarative plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import similarity
from tallyweave.operators import blocking, decide, features
from tallyweave.operators.records import normalised


@dataclass(frozen=True)
class Settings:
    tiers: tuple[str, ...] = blocking.PRODUCTION
    limit: int | None = None  # of anchors that may share a key; the tiers' own limits if None
    per_source: int = 10
    primary: float = 0.60
    secondary: float = 0.75
    rules: str = "v5"


def candidates(records: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The best ``per_source`` candidates of each anchor and source."""
    return blocking.top_k(blocking.first_pairs(records, settings.per_source, settings.tiers, settings.limit), settings.per_source)


def claimed(scored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Selected pairs with the score by which one anchor wins each candidate.

    scored has both sides' records, prob, exact_brand and has_conflict.
    """
    kept = decide.two_tier(scored, settings.primary, settings.secondary)
    ratios = similarity.token_set_ratio(F.col("a_name"), F.col("b_name")), similarity.token_set_ratio(F.col("a_addr"), F.col("b_addr"))
    return kept.withColumns({"_tn": ratios[0], "_ta": ratios[1]}).withColumn("claim", decide.agreement(F.col("_tn"), F.col("_ta"), F.col("prob"))).drop("_tn", "_ta")


def link(entities: DataFrame, settings: Settings = Settings(), score=features.rule_score) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs, matches) of entities; ``score`` adds prob, exact_brand and has_conflict to pairs with records.

    With a trained model pass ``lambda pairs: model.scored(m, features.features43(features.rule_score(pairs).drop("prob")))``.
    """
    records = normalised(entities, settings.rules)
    pairs = candidates(records, settings)
    return pairs, decide.one_to_one(claimed(score(features.with_records(pairs, records)), settings)).select("s1_id", "cand_id", "src", "prob")


def exact_only(entities: DataFrame, rules: str = "plain", k: int = 3) -> DataFrame:
    """The first generation: equal country and name, the first k candidates in file order."""
    records = normalised(entities, rules)
    pairs = blocking.first_pairs(records, k, ("exact",), 1 << 30, "ord")
    return blocking.first_come(pairs, k, ("s1_id",)).select("s1_id", "cand_id", "src")


def four_keys(entities: DataFrame, take: int = 4, keep: int = 3) -> DataFrame:
    """The boosted generation: exact, slug (six letters), first and last word, number and first word; first come, ``keep`` of each source."""
    records = normalised(entities, "boosted")
    tiers = ("exact", "slug", "first_last", "num_name")
    hits = blocking.first_pairs(records.withColumn("slug", F.when(F.length("slug") >= 6, F.col("slug")).otherwise("")), take, tiers, 1 << 30, "ord")
    first = blocking.first_come(hits, take, ("s1_id", "src"))
    return blocking.first_come(first, keep, ("s1_id", "src")).select("s1_id", "cand_id", "src")
