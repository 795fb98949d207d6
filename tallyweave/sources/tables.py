"""Sources and sinks of record linkage: tab-separated entity files, truth lists, results, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTITY = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"
CANDIDATES = "source1_entity_id string, candidate_entity_ids string"
EXPERIMENT = "experiment_id blocking_strategy blocking_recall candidate_count avg_candidates normalization features model threshold macro_f05 precision recall notes".split()


def read_tsv(spark: SparkSession, path: str, schema: str = ENTITY) -> DataFrame:
    """A tab-separated file with a header; the schema is given, so nothing is read twice, and columns that aren't selected aren't parsed."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", None).csv(path)


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows by a stated order (file order isn't one)."""
    return df.orderBy(*order).limit(n)


def having_ids(df: DataFrame, ids: DataFrame, column: str = "entity_id") -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


def split_ids(df: DataFrame, key: str, ids: str) -> DataFrame:
    """(s1_id, cand_id) from rows with a comma-joined list; blanks around ids and empty ids go, and repeated ones too."""
    one = F.explode(F.split(F.coalesce(F.col(ids), F.lit("")), ",")).alias("cand_id")
    return df.select(F.col(key).alias("s1_id"), one).withColumn("cand_id", F.trim("cand_id")).where("cand_id <> ''").distinct()


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All anchors (s1_id) and the true pairs (s1_id, cand_id); an anchor without pairs is a singleton."""
    rows = read_tsv(spark, path, TRUTH)
    return rows.select(F.col("source1_entity_id").alias("s1_id")).distinct(), split_ids(rows, "source1_entity_id", "matched_entity_ids")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first by a stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merged(earlier: DataFrame, later: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both tables; where both have a key, the later table's."""
    return earlier.join(later.select(*keys).distinct(), keys, "left_anti").unionByName(later)


def id_lists(anchors: DataFrame, pairs: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """One row for each anchor (s1_id) with its pairs' cand_ids joined by commas, in order; '' without any.

    Anchors that have ``ord``, their place in the source, keep it, so that rows can be written in that order.
    """
    keys = order or ["cand_id"]
    place = ["ord"] if "ord" in anchors.columns else []
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, F.col("cand_id").alias("_id")))), lambda x: x["_id"]), ",").alias(name))
    joined = anchors.select("s1_id", *place).join(lists, "s1_id", "left")
    return joined.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name), *place)


def write_tsv(df: DataFrame, path: str) -> None:
    """A table with a header; rows that have ``ord`` are written in that order, over all files in their names' order, and without it."""
    if "ord" in df.columns:
        df = df.orderBy("ord").drop("ord")
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "").csv(path)


def write_matches(anchors: DataFrame, pairs: DataFrame, path: str) -> None:
    write_tsv(id_lists(anchors, pairs, "matched_entity_ids"), path)


def write_candidates(anchors: DataFrame, pairs: DataFrame, path: str) -> None:
    write_tsv(id_lists(anchors, pairs, "candidate_entity_ids"), path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def log_experiment(spark: SparkSession, values: dict[str, object], path: str) -> None:
    """Appends one row to an experiment log of text columns."""
    row = [tuple(str(values.get(c, "")) for c in EXPERIMENT)]
    spark.createDataFrame(row, ", ".join(f"{c} string" for c in EXPERIMENT)).coalesce(1).write.mode("append").option("header", True).csv(path)


def write_blocking(report: DataFrame, path: str, configuration: str) -> None:
    """The report of ``evaluate.blocking_by_k`` as a CSV of six columns, a row for each k: means to one digit, shares as percentages."""
    percent = {c: F.format_string("%.2f%%", 100 * F.col(c)).alias(c) for c in ("pair_recall", "entity_coverage")}
    rows = report.select(F.format_string(f"{configuration.replace('%', '%%')}, K=%d", "top_k").alias("configuration"), "top_k", "candidate_count", F.round("avg_candidates_per_entity", 1).alias("avg_candidates_per_entity"), *percent.values())
    rows.orderBy("top_k").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def missing_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths, on whatever file system, that don't exist."""
    return [p for p in paths if not exists(spark, p)]


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, which is made and written first where it isn't there yet (scored pairs, most often).

    Only a table that was written to its end counts, so a run that is broken off makes it anew.
    """
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def validation_ids(spark: SparkSession, anchors: DataFrame, n: int, path: str) -> DataFrame:
    """(s1_id) of the first n anchors by ``ord``: as saved at ``path``, or chosen and saved there."""
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        head(anchors, ["ord", "s1_id"], n).select("s1_id").coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema("s1_id string").json(path)
