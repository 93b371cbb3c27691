"""Matching on a stream of edges, of any kind of pattern.

Each micro-batch puts its edges into a log and emits the matches that have become certain: those that end before the
watermark (the latest time seen less the lateness) and not before the last one. Such a match starts at most a window
earlier, and whether an equal one has ended before is looked up a window further back, so a micro-batch reads two
windows of the log and what came since: a batch plan that is dealt over the cluster, not the state of one key. Equal
matches over a window apart are both emitted, as nothing older is kept.

All is Parquet below one folder that the cluster shares, in folders numbered by micro-batch that a repeated micro-batch
overwrites with the same rows; results are exactly once. Edges before the watermark of the micro-batch before are late:
they are kept apart (``late``) and take no part. Log folders that no later or repeated micro-batch reads are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgeloom import api, scratch
from edgeloom.plans.pattern import Pattern
from edgeloom.sources.edges import EDGE, EDGE_SCHEMA

FOUND_SCHEMA = "start_ms long, end_ms long, events string"
MARKS = "batch long, watermark long, latest long"


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Of the micro-batches that have a folder there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(p)] if system.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit())


def _read(spark: SparkSession, folder: str, numbers: list[int], schema) -> DataFrame:
    paths = [f"{folder}/{n}" for n in numbers]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _marks(spark: SparkSession, where: str, before: int | None = None) -> list:
    """A row for each micro-batch still in the log: as many as two windows have."""
    kept = [n for n in _numbers(spark, f"{where}/marks") if before is None or n < before]
    return sorted(_read(spark, f"{where}/marks", kept, MARKS).collect())


def _between(spark: SparkSession, where: str, numbers: list[int], p: Pattern, window_ms: int, low: int | None, high: int | None, how: dict) -> DataFrame:
    """Matches that end at low or later and before high."""
    log = _read(spark, f"{where}/edges", numbers, EDGE_SCHEMA)
    if low is not None:
        log = log.where(F.col("ts_ms") >= low - 2 * window_ms)
    if high is not None:
        log = log.where(F.col("ts_ms") < high)
    out = api.match(log, p, window_ms, **how)
    return out if low is None else out.where(F.col("end_ms") >= low)


def advance(rows: DataFrame, n: int, p: Pattern, window_ms: int, where: str, lateness_ms: int = 0, **how) -> None:
    """Take in micro-batch n of edges."""
    spark = rows.sparkSession
    marks = _marks(spark, where, before=n)
    low = marks[-1].watermark if marks else None
    rows = rows.select(*EDGE).persist()
    try:
        fresh = rows if low is None else rows.where(F.col("ts_ms") >= low)
        fresh.write.mode("overwrite").parquet(f"{where}/edges/{n}")
        if low is not None:
            rows.where(F.col("ts_ms") < low).write.mode("overwrite").parquet(f"{where}/late/{n}")
    finally:
        rows.unpersist()
    latest = _read(spark, f"{where}/edges", [n], EDGE_SCHEMA).agg(F.max("ts_ms")).first()[0]
    high = max((x for x in (low, None if latest is None else latest - lateness_ms) if x is not None), default=None)
    needed = lambda mark: low is None or mark.latest is not None and mark.latest >= low - 2 * window_ms
    live = [m.batch for m in marks if needed(m)]
    if high is not None:
        _between(spark, where, [*live, n], p, window_ms, low, high, how).write.mode("overwrite").parquet(f"{where}/found/{n}")
    spark.createDataFrame([(n, high, latest)], MARKS).coalesce(1).write.mode("overwrite").parquet(f"{where}/marks/{n}")
    for m in marks[:-1]:
        if m.batch not in live:
            scratch.drop(spark, f"{where}/edges/{m.batch}")
            scratch.drop(spark, f"{where}/marks/{m.batch}")


def start(edges: DataFrame, p: Pattern, window_ms: int, where: str, lateness_ms: int = 0, trigger: dict | None = None, **how) -> StreamingQuery:
    """Run over a stream of edges; what there is now, unless trigger says otherwise. how: see api.match."""
    take = lambda rows, n: advance(rows, n, p, window_ms, where, lateness_ms, **how)
    return edges.writeStream.foreachBatch(take).option("checkpointLocation", f"{where}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def found(spark: SparkSession, where: str) -> DataFrame:
    """start_ms, end_ms, events: all that was emitted."""
    return _read(spark, f"{where}/found", _numbers(spark, f"{where}/found"), FOUND_SCHEMA)


def late(spark: SparkSession, where: str) -> DataFrame:
    """The edges that came too late."""
    return _read(spark, f"{where}/late", _numbers(spark, f"{where}/late"), EDGE_SCHEMA)


def rest(spark: SparkSession, where: str, p: Pattern, window_ms: int, **how) -> DataFrame:
    """The matches that the watermark holds back: what is missing where the stream has ended."""
    marks = _marks(spark, where)
    return _between(spark, where, [m.batch for m in marks], p, window_ms, marks[-1].watermark if marks else None, None, how)
