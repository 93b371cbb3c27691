"""Connected components of an edge table, by alternating large and small stars.

Each round replaces every edge by one to the smallest neighbour, which keeps the components and halves paths; it
ends when a round changes nothing. A round is written to the shared folder, so the lineage stays short. Hubs are
safe: minima are combined before the shuffle, and the joins are ones that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom import scratch


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.where("m < u").select("u", F.col("m").alias("v"))
    ).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(u, v), root being the smallest node of its component, for all but the roots."""
    spark = edges.sparkSession
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, where = scratch.save(now.distinct(), "edges")
    mark = None
    while True:
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, old = new, where
        now, where = scratch.save(_round(now), "edges")
        scratch.drop(spark, old)
