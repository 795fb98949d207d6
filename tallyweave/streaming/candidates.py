"""Candidates that arrive as a stream, joined with a fixed set of anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyweave.operators import blocking
from tallyweave.operators.records import normalised


def watch(entities: DataFrame, anchors: DataFrame, table: str, checkpoint: str, k: int = 10, tiers: tuple[str, ...] = blocking.PRODUCTION, limit: int | None = None, once: bool = True) -> StreamingQuery:
    """Keeps in ``table`` the k best candidates of each anchor and source among all entities that the stream has brought.

    Anchors' keys are pruned and joined with each micro-batch's; the batch's pairs are merged with
    the last batch's, and the best k stay.  Every batch writes a table of its own, named by its
    number, from the one before it, so a batch that is run again after a failure gives the same
    result; older tables are dropped.
    """
    keys = blocking.pruned(blocking.key_table(normalised(anchors.where("src = 1")), tiers), limit)

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hits = blocking.tier_hits(keys, blocking.key_table(normalised(batch.where("src <> 1")), tiers, probe=True))
        pairs = hits.groupBy("s1_id", "cand_id", "src").agg(F.max("score").alias("score"))
        before = max((n for n in _versions(spark, table) if n < number), default=None)
        if before is not None:
            pairs = pairs.unionByName(spark.table(f"{table}_{before}")).groupBy("s1_id", "cand_id", "src").agg(F.max("score").alias("score"))
        blocking.top_k(pairs, k).write.mode("overwrite").saveAsTable(f"{table}_{number}")
        for old in _versions(spark, table):
            if before is not None and old < before:
                spark.sql(f"drop table if exists {table}_{old}")

    writer = entities.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _versions(spark, table: str) -> list[int]:
    names = [t.name for t in spark.catalog.listTables()]
    return sorted(int(n.rpartition("_")[2]) for n in names if n.rpartition("_")[0] == table.lower() and n.rpartition("_")[2].isdigit())


def current(spark, table: str) -> DataFrame:
    """The candidates after the last batch."""
    return spark.table(f"{table}_{_versions(spark, table)[-1]}")
