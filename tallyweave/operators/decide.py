"""From scored pairs to matches: thresholds by rank, caps, and one winner for each candidate.

Scored pairs have s1_id, cand_id, src, prob, and where a rule needs them exact_brand and
has_conflict.  Ties always go by cand_id or s1_id, so results don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import similarity
from tallyweave.operators.features import _a, _b, _differ, _same


def _ranked(pairs: DataFrame, by: tuple[str, ...], order: list[Column]) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def _best() -> list[Column]:
    return [F.col("prob").desc(), F.col("cand_id")]


def above(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.where(F.col("prob") >= threshold)


def top_per_source(pairs: DataFrame, threshold: float = 0.88, k: int = 3) -> DataFrame:
    """The k likeliest of each source among pairs above the threshold."""
    return _ranked(above(pairs, threshold), ("s1_id", "src"), _best()).where(F.col("rank") <= k).drop("rank")


def two_tier(pairs: DataFrame, primary: float, secondary: float, conflict: float = 0.88, ease: float = 0.08, per_source: int = 3, total: int = 4) -> DataFrame:
    """The production rule.

    Pairs below their first gate (``conflict`` with a conflict, else ``primary``, less ``ease`` for an exact brand)
    don't rank.  Of each source's first ``per_source`` the best needs that gate, the others ``secondary``;
    then the ``total`` best of both sources stay.
    """
    gate = F.when(F.col("has_conflict"), conflict).when(F.col("exact_brand"), primary - ease).otherwise(primary)
    ranked = _ranked(pairs.where(F.col("prob") >= gate), ("s1_id", "src"), _best()).where(F.col("rank") <= per_source)
    wanted = F.when(F.col("has_conflict"), conflict).when(F.col("rank") > 1, secondary).when(F.col("exact_brand"), primary - ease).otherwise(primary)
    kept = ranked.where(F.col("prob") >= wanted).drop("rank")
    return _ranked(kept, ("s1_id",), _best()).where(F.col("rank") <= total).drop("rank")


def by_rank(pairs: DataFrame, thresholds: tuple[float, ...], total: int) -> DataFrame:
    """The training-time rule: rank i of an anchor needs the i-th threshold (the last one from there on), within the first ``total``."""
    ranked = _ranked(pairs, ("s1_id",), _best()).where(F.col("rank") <= total)
    wanted = F.lit(thresholds[-1])
    for i, threshold in reversed(list(enumerate(thresholds[:-1], 1))):
        wanted = F.when(F.col("rank") == i, threshold).otherwise(wanted)
    return ranked.where(F.col("prob") >= wanted).drop("rank")


def capped(pairs: DataFrame, cap: int, threshold: float, k: int = 3) -> DataFrame:
    """The first ``cap`` by blocking score, of these the likely ones, of these the k best."""
    first = _ranked(pairs, ("s1_id",), [F.col("score").desc(), F.col("cand_id")]).where(F.col("rank") <= cap).drop("rank")
    return _ranked(above(first, threshold), ("s1_id",), _best()).where(F.col("rank") <= k).drop("rank")


def disjoint_numbers(pairs: DataFrame, least: int = 1) -> Column:
    """Both sides have (``least`` or more) numbers and share none."""
    nums = [F.filter(x, lambda n: F.length(n) >= least) for x in (_a("nums"), _b("nums"))]
    return (F.size(nums[0]) > 0) & (F.size(nums[1]) > 0) & ~F.arrays_overlap(*nums)


def with_marks(pairs: DataFrame) -> DataFrame:
    """Pairs (with both sides' records) and what the grids' rules ask: jw, number_conflict, disjoint and disjoint_long."""
    return pairs.withColumns({"jw": similarity.jaro_winkler(_a("name"), _b("name")), "number_conflict": _differ("street_num"), "disjoint": disjoint_numbers(pairs), "disjoint_long": disjoint_numbers(pairs, 2)})


def agreement(name: Column, addr: Column, prob: Column | None = None, use_pin: bool = False) -> Column:
    """How well a candidate fits one of the anchors that claim it; name and addr are token-set ratios from 0 to 1."""
    street = F.when(_same("street_num"), 30.0).when(_differ("street_num"), -50.0).otherwise(0.0)
    pin = F.when(_same("pin"), 20.0).when(_differ("pin"), -30.0).otherwise(0.0) if use_pin else F.lit(0.0)
    if prob is None:
        return 30 * name + 70 * addr + F.when(_same("street_num"), 30.0).when(_differ("street_num"), -50.0).otherwise(0.0)
    return 100 * prob + 50 * addr + 20 * name + street + pin


def one_to_one(claims: DataFrame, score: str = "claim") -> DataFrame:
    """Of each candidate's claims the best by ``score``, then by s1_id; the losers get nothing in its place."""
    return _ranked(claims, ("cand_id",), [F.col(score).desc(), F.col("s1_id")]).where("rank = 1").drop("rank")


def post_hoc(matches: DataFrame, records: DataFrame) -> DataFrame:
    """Finished matches (s1_id, cand_id, ord) with each candidate left to one anchor.

    Records (entity_id, name, addr, street_num) are read only for the sides of candidates that more than one
    row claims; ord says in which order rows were claimed.  The best agreement wins, 0 where the anchor's record is
    missing; where the candidate's is, or by equal agreement, the first claim.
    """
    claimed = matches.groupBy("cand_id").agg(F.count(F.lit(1)).alias("claims"))
    contested = matches.join(claimed.where("claims > 1").select("cand_id"), "cand_id", "left_semi")
    fields = ("name", "addr", "street_num")

    def meta(key: str, prefix: str) -> DataFrame:
        ids = contested.select(F.col(key).alias("entity_id")).distinct()
        return records.join(ids, "entity_id", "left_semi").select(F.col("entity_id").alias(key), *(F.col(f).alias(f"{prefix}_{f}") for f in fields), F.lit(True).alias(f"{prefix}_known"))

    both = contested.join(meta("s1_id", "a"), "s1_id", "left").join(meta("cand_id", "b"), "cand_id", "left")
    names = similarity.token_set_ratio(_a("name"), _b("name")), similarity.token_set_ratio(_a("addr"), _b("addr"))
    scored = both.withColumns({"_tn": names[0], "_ta": names[1]})
    fits = F.when(F.col("a_known") & F.col("b_known"), agreement(F.col("_tn"), F.col("_ta"))).otherwise(0.0)
    won = _ranked(scored.withColumn("_fits", fits), ("cand_id",), [F.col("_fits").desc(), F.col("ord"), F.col("s1_id")]).where("rank = 1")
    return matches.join(claimed.where("claims = 1").select("cand_id"), "cand_id", "left_semi").select("s1_id", "cand_id", "ord").union(won.select("s1_id", "cand_id", "ord"))


def conflicts(claims: DataFrame) -> DataFrame:
    """(cand_id, claims, excess) of candidates that more than one anchor claims."""
    return claims.groupBy("cand_id").agg(F.countDistinct("s1_id").alias("claims")).where("claims > 1").withColumn("excess", F.col("claims") - 1)
