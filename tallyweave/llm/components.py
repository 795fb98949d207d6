"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node that it reaches.

    Every round points all larger neighbours of a node to its smallest neighbour, then the
    smaller ones; the number of rounds grows with the logarithm of a component's size, and
    the rows never exceed those of the edges.  It ends when all components are stars.  A round
    is written to the shared folder, so lineage stays short.  Nulls and loops are left out.
    """
    spark = edges.sparkSession
    now = stored(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components", few=True)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        # Stars around smallest nodes: each edge's larger node has that edge only.
        found = least.agg(F.count_if((F.col("c") == 1) & (F.col("m") < F.col("u"))).alias("leaves"), F.sum("c").alias("ends")).first()
        if 2 * found["leaves"] == (found["ends"] or 0):
            break
        large = both.where("v > u").join(least.drop("c"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Each node now has only smaller neighbours; all of them and the node itself go to the smallest.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        following = stored(large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct(), "components", few=True)
        discard(spark, now)
        now = following
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

