"""From documents to packed training sequences: five stages, each over all that the one before it kept.

Stages read doc_id, text and, where it is there, n_chars; other columns go through unread, whatever their
names.  Null and empty texts are judged as texts without words, so they stay wherever the classifiers keep such
a text, lose no lines, are nobody's copy and are packed as one end id.  Rows with a null id are filtered and
packed like others but are nobody's copy.  Rows that repeat an id with the same text are one document from the
fourth stage on; rows that share an id with different texts stay.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import jaccard_join, line_dedup, packing, quality, toxicity
from tallyweave.llm.shared import discard, read, stored, tidy


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents predicted toxic go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that score below 0.7 go."""
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: repeated and nearly repeated lines go, and documents of which nothing but blanks is left by that; n_chars follows the text."""
    done = line_dedup.dedup_lines(docs)
    left = (F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    done = done.where(F.coalesce(left, F.lit(True)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of linked documents the one with the smallest doc_id stays, and of rows with equal id and text one."""
    copies = jaccard_join.jaccard_components(docs, width=5, percent=80).where("component_id <> doc_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(copies, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).union(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the texts as token sequences of at most 2048."""
    return packing.pack(docs, with_ids=False)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("line_dedup", drop_lines), ("ngram_jaccard", drop_near_copies), ("packing", pack)]

#: Classifiers and tokenizers can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with tidy(spark):
            docs = stored(stage(spark, docs, sf_dir), name, outlive=True)
        if before is not None:
            discard(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
