"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded(rows: DataFrame, key: str, n: int, by: Column) -> DataFrame:
    """At most n rows for each value of key, those with the smallest hashes of by, with __h, their hashes; the caller bounds the values of key.

    Rows are counted first; a threshold on the hash then leaves about 2 n rows for a key, so that the ranking
    that follows is of bounded size, whatever share of the table a key has.
    """
    mark = F.pmod(F.xxhash64(by, F.lit(11)), F.lit(1 << 40))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    near = rows.withColumn("__h", mark).join(F.broadcast(counts), key).where(F.col("__h") * F.col("__n") < F.lit(float((2 * n + 20) * (1 << 40))))
    order = Window.partitionBy(key).orderBy("__h", by)
    return near.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__n", "__r")
