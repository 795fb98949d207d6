"""The output contract as queries that return what breaks it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("duplicate_anchor", "unknown_anchor", "repeated_match", "unknown_match", "missing_anchor", "duplicate_candidate_row", "match_not_candidate")


def missing_columns(matches: DataFrame, candidates: DataFrame | None = None) -> list[str]:
    """The columns that the files must have and don't."""
    wanted = [(matches, "source1_entity_id"), (matches, "matched_entity_ids")]
    if candidates is not None:
        wanted += [(candidates, "source1_entity_id"), (candidates, "candidate_entity_ids")]
    return [name for df, name in wanted if name not in df.columns]


def _listed(rows: DataFrame, ids: str) -> DataFrame:
    one = F.explode(F.split(F.coalesce(F.col(ids), F.lit("")), ",")).alias("id")
    return rows.select(F.col("source1_entity_id").alias("s1_id"), one).withColumn("id", F.trim("id")).where("id <> ''")


def issues(entities: DataFrame, matches: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(rule, s1_id, id, n) of every violation; entities has entity_id and src (1 for anchors)."""
    if lost := missing_columns(matches, candidates):
        raise ValueError(f"missing columns: {', '.join(lost)}")
    anchors = entities.where("src = 1").select(F.col("entity_id").alias("s1_id"))
    others = entities.where("src <> 1").select(F.col("entity_id").alias("id"))
    rows = matches.select(F.col("source1_entity_id").alias("s1_id"))
    listed = _listed(matches, "matched_entity_ids")

    def found(rule: str, df: DataFrame) -> DataFrame:
        has = df.columns
        return df.select(F.lit(rule).alias("rule"), "s1_id", (F.col("id") if "id" in has else F.lit(None).cast("string")).alias("id"), (F.col("n") if "n" in has else F.lit(1).cast("long")).alias("n"))

    def repeated(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    parts = [
        found("duplicate_anchor", repeated(rows, "s1_id")),
        found("unknown_anchor", rows.distinct().join(anchors, "s1_id", "left_anti")),
        found("repeated_match", repeated(listed, "s1_id", "id")),
        found("unknown_match", listed.distinct().join(others, "id", "left_anti")),
        found("missing_anchor", anchors.join(rows, "s1_id", "left_anti")),
    ]
    if candidates is not None:
        parts.append(found("duplicate_candidate_row", repeated(candidates.select(F.col("source1_entity_id").alias("s1_id")), "s1_id")))
        parts.append(found("match_not_candidate", listed.distinct().join(_listed(candidates, "candidate_entity_ids").distinct(), ["s1_id", "id"], "left_anti")))
    return reduce(DataFrame.unionByName, parts)
