"""Descriptive queries over entity tables, truth lists and scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_values(entities: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, percent) by one pass over the table; '' counts as missing."""
    sums = entities.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull() | (F.col(c) == "")).alias(c) for c in columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns))).alias("r")
    return sums.select("n", rows).select("r.column", "r.missing", F.round(F.when(F.col("n") == 0, 0.0).otherwise(100 * F.col("r.missing") / F.col("n")), 2).alias("percent"))


def frequencies(entities: DataFrame, column: str, k: int = 10) -> DataFrame:
    return entities.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(k)


def distinct_ids(entities: DataFrame) -> DataFrame:
    return entities.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("entity_id").alias("ids"))


def match_distribution(anchors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(matches, anchors): how many anchors have how many pairs, 0 included."""
    per = anchors.select("s1_id").distinct().join(pairs.groupBy("s1_id").agg(F.count(F.lit(1)).alias("c")), "s1_id", "left")
    return per.groupBy(F.coalesce("c", F.lit(0)).cast("long").alias("matches")).agg(F.count(F.lit(1)).alias("anchors"))


def by_source(pairs: DataFrame) -> DataFrame:
    """Matches by the source that their ids name."""
    return pairs.groupBy(F.substring_index("cand_id", "-", 1).alias("source")).agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("s1_id").alias("anchors"))


def rejected(anchors: DataFrame, scored: DataFrame, matched: DataFrame) -> DataFrame:
    """Anchors with candidates but without a match: their best candidate."""
    left = scored.join(matched.select("s1_id").distinct(), "s1_id", "left_anti").join(anchors.select("s1_id").distinct(), "s1_id", "left_semi")
    return left.groupBy("s1_id").agg(F.max_by("cand_id", F.struct("prob", "cand_id")).alias("cand_id"), F.max("prob").alias("prob"))


def tail(best: DataFrame, cutoffs: tuple[float, ...] = (0.5, 0.7, 0.8)) -> DataFrame:
    """Spread of rejected anchors' best probabilities (count, mean, standard deviation of a sample, extremes, quartiles) and the share above each cutoff."""
    quartiles = (F.percentile("prob", q).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75))
    return best.agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean"), F.stddev_samp("prob").alias("std"), F.min("prob").alias("least"), F.max("prob").alias("most"), *quartiles, *(F.avg((F.col("prob") >= c).cast("double")).alias(f"above_{int(100 * c)}") for c in cutoffs))
