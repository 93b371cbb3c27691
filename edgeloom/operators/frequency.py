"""Runs of k candidates between the same two entities.

Candidates of a pair are ordered by time and seq. A run starts at a candidate and takes the k next distinct event ids,
itself included, that the match doesn't use already. An id has two rows at most (start and end of an interval), so of
the rows from a candidate on, a fixed number holds its run, and a frame of that size is all that is gathered.

Pairs of very many rows are dealt over tasks by time: a part is as wide as the window, and what a run can need of later
parts is in the next one, as a run spans a window at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def near(candidates: DataFrame, k: int, skipped: int, window_ms: int) -> DataFrame:
    """src, dst, start_ms, near: for each candidate row the (ts_ms, event_id) from it on that k distinct ids can take, so many others left out, within the window."""
    many = 2 * (k + skipped) - 1
    part = F.floor(F.col("ts_ms") / window_ms)
    rows = candidates.select("ts_ms", "seq", "event_id", "src", "dst", part.alias("cell"))
    # A row goes to its part, and to the one before for the runs that start there.
    rows = rows.select("*", F.explode(F.array("cell", F.col("cell") - 1)).alias("of"))
    order = Window.partitionBy("src", "dst", "of").orderBy("ts_ms", "seq", "event_id").rowsBetween(0, many - 1)
    rows = rows.withColumn("near", F.collect_list(F.struct("ts_ms", "event_id")).over(order)).where("cell = of")
    return rows.select("src", "dst", F.col("ts_ms").alias("start_ms"), F.filter("near", lambda x: x["ts_ms"] - F.col("ts_ms") <= window_ms).alias("near"))


def ids_of(used: Column, k: int) -> Column:
    """Of the column near, the run's ids: none that is in used, null where there are fewer than k or where its first candidate is used."""
    free = F.filter("near", lambda x: ~F.array_contains(used, x["event_id"]))
    ids = F.slice(F.array_distinct(F.transform(free, lambda x: x["event_id"])), 1, k)
    return F.when((F.size(ids) == k) & (F.try_element_at(ids, F.lit(1)) == F.col("near")[0]["event_id"]), ids)


def end_of(ids: str) -> Column:
    """When the last of the ids first occurs in near."""
    return F.try_element_at(F.filter("near", lambda x: x["event_id"] == F.try_element_at(F.col(ids), F.lit(-1))), F.lit(1))["ts_ms"]


def runs(candidates: DataFrame, k: int, window_ms: int) -> DataFrame:
    """src, dst, start_ms, end_ms, ids: for each candidate row its run, within the window, nothing being used already."""
    rows = near(candidates, k, 0, window_ms)
    rows = rows.withColumn("ids", ids_of(F.array().cast("array<bigint>"), k)).where("ids is not null")
    return rows.withColumn("end_ms", end_of("ids")).select("src", "dst", "start_ms", "end_ms", "ids")
