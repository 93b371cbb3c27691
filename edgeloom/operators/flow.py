"""Time-respecting reachability: which node's influence has reached which other, when it left and when it came.

A row (src, dst, depart, arrive) is kept if no row of the pair that arrives earlier or then departs as late. Time falls
into cells of a window; what arrives in a cell is made of arcs of that cell and the one before.

Cells are counted first. Those with few arcs are worked off in a task, in order of time: each arc hands on what has reached
its start, and arcs of one instant are repeated until they hand on nothing new. What a source reaches does not depend on other
sources. So a task that knows of more than a bound at some instant puts off some of its sources and goes through the arcs
again for those, and where few cells are heavy their sources are dealt over several tasks. Rows leave a task as they are found.
The arcs of such a cell go to two tasks each, or these parts, and nothing else is shuffled.

The other cells, however many arcs they have, are worked off together in a fix-point of joins. A round extends only what
the round before found, by one arc, and keeps what the known rows of the same pairs don't make useless; known rows are
written round by round and never rewritten. Only targets that are asked for come out, and arcs that lead to none of them
within a window are left out from the last hop on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom import scratch

#: What one task takes: arcs of a cell and the one before, and known pairs (of source and node) at once.
ARCS, KNOWN = 200_000, 1_000_000
#: A cell of more arcs times sources is heavy; sources of at most so many heavy cells are dealt over as many tasks.
HEAVY, TASKS = 10_000_000, 64
#: Rows that leave a task at once.
BATCH = 50_000
REACH = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("depart", pa.int64()), ("arrive", pa.int64())])


def _useful(rows: DataFrame) -> DataFrame:
    """Of each (src, dst), the rows that depart later than all that have arrived before; the latest departure of an arrival."""
    best = rows.groupBy("src", "dst", "arrive").agg(F.max("depart").alias("depart"))
    before = Window.partitionBy("src", "dst").orderBy("arrive").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("top", F.max("depart").over(before)).where("top is null or depart > top").select("src", "dst", "depart", "arrive")


def updates(arcs: Callable[[], Iterable[tuple[int, int, int, bool, bool]]], window: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """(t, b, sources, when they last departed): what arrives at t in b. In order of t for a source, not over all.

    arcs gives (t, a, b, whether a is a source, whether b is a target) in order of t, each time it is called.
    """
    only: dict[int, float] | None = None  # the sources of this pass, and up to when their rows have gone out
    while only is None or only:
        put_off: dict[int, float] = {}
        yield from _pass(arcs(), window, only, put_off)
        only = put_off


def _pass(arcs: Iterable[tuple[int, int, int, bool, bool]], window: int, only: dict[int, float] | None, put_off: dict[int, float]) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """latest[b] has, for each source that has reached b, when it last departed. put_off gets the sources that are left to a later pass."""
    latest: dict[int, dict[int, int]] = {}
    known, most = 0, KNOWN

    def sent(a: int, b: int, t: int, source: bool) -> dict[int, int]:
        """What arc a, b hands on at t that b doesn't know."""
        there, low = latest.get(b, {}), t - window
        out = {}
        if from_ := latest.get(a):
            alive = {s: d for s, d in from_.items() if d >= low}
            if 2 * len(alive) < len(from_):
                latest[a] = alive
            out = {s: d for s, d in alive.items() if s != b and there.get(s, low - 1) < d}
        if source and a not in put_off and (only is None or a in only) and there.get(a, low - 1) < t:
            out[a] = t
        return out

    for t, group in groupby(arcs, itemgetter(0)):
        now = list(group)
        wanted = {b for _, _, b, _, target in now if target}
        changed: dict[int, dict[int, int]] = {}
        again = True
        while again:
            again = False
            for _, a, b, source, _ in now:
                if new := sent(a, b, t, source):
                    known += len(new)
                    latest.setdefault(b, {}).update(new)
                    changed.setdefault(b, {}).update(new)
                    again = len(now) > 1
        for b, new in changed.items():
            if b in wanted:
                if only is not None:
                    new = {s: d for s, d in new.items() if only[s] < t}
                yield t, b, list(new), list(new.values())
        if known > most:
            known = _let_go(latest, t, window, only, put_off)
            most = max(KNOWN, 2 * known)


def _let_go(latest: dict[int, dict[int, int]], t: int, window: int, only: dict[int, float] | None, put_off: dict[int, float]) -> int:
    """Forget what departed too long ago and, if that leaves over half the bound, all about some sources, but for one; how much is known then."""
    of: Counter[int] = Counter()
    for b in list(latest):
        if alive := {s: d for s, d in latest[b].items() if t - d <= window}:
            latest[b] = alive
            of.update(alive.keys())
        else:
            del latest[b]
    known = of.total()
    if 2 * known <= KNOWN or len(of) < 2:
        return known
    gone, first = set(), next(iter(of))
    for s in sorted(of, key=of.get, reverse=True):
        if 2 * known > KNOWN and s != first:
            gone.add(s)
            known -= of[s]
    for s in gone:
        put_off[s] = t if only is None else max(t, only[s])
    for b in list(latest):
        if left := {s: d for s, d in latest[b].items() if s not in gone}:
            latest[b] = left
        else:
            del latest[b]
    return known


def _of_cell(window: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = key[0].as_py()
        g = pa.Table.from_batches(list(batches)).select(["t", "a", "b", "source", "target"]).sort_by("t").combine_chunks()

        def arcs() -> Iterator[tuple[int, int, int, bool, bool]]:
            for part in g.to_batches(max_chunksize=10_000):
                yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        out: tuple[list[int], ...] = ([], [], [], [])
        for t, b, sources, departs in updates(arcs, window):
            if t // window == cell:
                n = len(sources)
                for column, values in zip(out, (sources, [b] * n, departs, [t] * n), strict=True):
                    column += values
                if len(out[0]) >= BATCH:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in out], schema=REACH)
                    out = ([], [], [], [])
        yield pa.record_batch([pa.array(c, pa.int64()) for c in out], schema=REACH)

    return run


def _fixpoint(arcs: DataFrame, window_ms: int) -> DataFrame:
    """Of arcs(a, b, t, cell, source), all rows."""
    spark = arcs.sparkSession
    read = lambda paths: spark.read.schema("src long, dst long, depart long, arrive long").parquet(*paths)
    first = arcs.where("source").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("t").alias("depart"), F.col("t").alias("arrive"))
    delta, where = scratch.save(first.distinct(), "reach")
    paths = [where]
    cells = F.sequence(F.floor(F.col("arrive") / window_ms), F.floor((F.col("depart") + window_ms) / window_ms))
    while True:
        new = delta.withColumn("near", F.explode(cells))
        new = new.join(arcs, (F.col("dst") == F.col("a")) & (F.col("near") == F.col("cell")) & (F.col("t") >= F.col("arrive")) & (F.col("t") - F.col("depart") <= window_ms) & (F.col("b") != F.col("src")))
        new = new.groupBy("src", F.col("b").alias("dst"), F.col("t").alias("arrive")).agg(F.max("depart").alias("depart"))
        new, at = scratch.save(new, "found")
        known = read(paths).join(new.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
        both = known.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))
        # At one arrival, what is known goes before what is found, so that only a later departure is news.
        ahead = Window.partitionBy("src", "dst").orderBy("arrive", "fresh").rowsBetween(Window.unboundedPreceding, -1)
        news = both.withColumn("top", F.max("depart").over(ahead)).where("fresh = 1 and (top is null or depart > top)").select("src", "dst", "depart", "arrive")
        delta, where = scratch.save(news, "reach")
        scratch.drop(spark, at)
        if not delta.take(1):
            return _useful(read(paths))
        paths.append(where)


def reach(edges: DataFrame, window_ms: int, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """src, dst, depart, arrive: each time that dst learns of a later departure from src, at most window_ms before.

    sources(entity_id) limits where flows start, targets(entity_id) where they end. Arcs from a node to itself count for nothing.
    """
    spark = edges.sparkSession
    arcs = edges.where("subject_id <> object_id").select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"), F.col("ts_ms").alias("t")).distinct()
    for ends, column, name in ((sources, "a", "source"), (targets, "b", "target")):
        if ends is None:
            arcs = arcs.withColumn(name, F.lit(True))
        else:
            arcs = arcs.join(ends.select(F.col("entity_id").alias(column), F.lit(True).alias("__in")), column, "left").withColumn(name, F.coalesce("__in", F.lit(False))).drop("__in")
    arcs, _ = scratch.save(arcs.withColumn("cell", F.floor(F.col("t") / window_ms)).select("a", "b", "t", "source", "target", "cell"), "arcs")
    here = arcs.select("*", F.explode(F.array("cell", F.col("cell") + 1)).alias("of"))
    size = here.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.when(F.col("source"), F.col("a")), 0.02).alias("s"), F.max(F.col("cell") == F.col("of")).alias("own"), F.max("source").alias("any"))
    size = size.where("own and any")  # else nothing arrives there
    size, _ = scratch.save(size.select("of", (F.col("n") <= ARCS).alias("small"), (F.col("n") * F.col("s")).alias("work")), "cells")
    counts = {r["small"]: (r["n"], r["heavy"]) for r in size.groupBy("small").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("work") > HEAVY).alias("heavy")).collect()}
    parts = []
    if True in counts:
        shares = TASKS // max(1, counts[True][1])
        dealt = size.where("small").select("of", F.when(F.lit(shares > 1) & (F.col("work") > HEAVY), F.least(F.lit(shares), F.ceil(F.col("work") / HEAVY))).otherwise(F.lit(1)).cast("int").alias("shares"))
        own = here.join(dealt, "of").select("of", "a", "b", "t", "source", "target", "shares", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        own = own.select("of", "share", "a", "b", "t", (F.col("source") & (F.pmod(F.xxhash64("a"), F.col("shares")) == F.col("share"))).alias("source"), "target")
        parts.append(own.groupBy("of", "share").applyInArrow(_of_cell(window_ms), "src long, dst long, depart long, arrive long"))
    if False in counts:
        large = size.where("not small").select("of")
        near = large.select(F.explode(F.array(F.col("of"), F.col("of") - 1)).alias("cell")).distinct()
        some = arcs.join(near, "cell")
        if targets is not None:
            some = _leading(some, window_ms)
        found = _fixpoint(some, window_ms).withColumn("of", F.floor(F.col("arrive") / window_ms)).join(large, "of").drop("of")
        if targets is not None:
            found = found.join(targets.select(F.col("entity_id").alias("dst")), "dst", "left_semi").select("src", "dst", "depart", "arrive")
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], "src long, dst long, depart long, arrive long")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _leading(arcs: DataFrame, window_ms: int) -> DataFrame:
    """The arcs that end in a target, or from whose end some arc goes on at that time or later within a window."""
    last = arcs.groupBy(F.col("a").alias("b"), "cell").agg(F.max("t").alias("last")).select("b", "last", F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("cell"))
    last = last.groupBy("b", "cell").agg(F.max("last").alias("last"))
    return arcs.join(last, ["b", "cell"], "left").where("target or last >= t").drop("last")
