"""Patterns of default events as stream-stream joins, for any sink.

Each event of the pattern is its own stream; joins are keyed by bound entities, and ranges of event time about the first
joined event bound their state to a window and the lateness; a join's result has that one event time only. Matches come when their last event does. Edges over the lateness behind
are dropped by Spark's watermark. Events of two times (start and end of an interval) can give a match more than once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import candidates, results
from edgeloom.plans.pattern import Pattern
from edgeloom.plans.planner import join_order


def match(edges: DataFrame, p: Pattern, window_ms: int, lateness_ms: int = 0) -> DataFrame:
    """start_ms, end_ms, events of a stream of edges, as a stream."""
    p = p.optimize()
    if any(e.kind != "default" for e in p.events):
        raise ValueError("frequencies and flows need front.start")
    if window_ms <= 0:
        raise ValueError("the window must be positive")
    wide = F.expr(f"INTERVAL {window_ms} MILLISECONDS")
    order = join_order(p)
    anchor = f"at_{order[0]}"
    out: DataFrame | None = None
    bound: list[int] = []
    done: list[int] = []
    for i in order:
        e = p.events[i]
        rows = candidates.event_candidates(edges, p, i)
        t = rows.select(F.timestamp_millis("ts_ms").alias(f"at_{i}"), F.col("ts_ms").alias(f"s_{i}"), F.array("event_id").alias(f"ids_{i}"), F.col("src").alias(f"src_{i}"), F.col("dst").alias(f"dst_{i}"))
        t = t.withWatermark(f"at_{i}", f"{lateness_ms} milliseconds")
        ends = {e.subject: f"src_{i}", e.object: f"dst_{i}"}
        if out is None:
            out = t
        else:
            on = [F.col(f"v_{v}") == F.col(c) for v, c in ends.items() if v in bound]
            on += [F.col(f"v_{w}") != F.col(c) for v, c in ends.items() if v not in bound for w in bound]
            on += [F.col(f"s_{q}") <= F.col(f"s_{i}") for q in e.parents if q in done] + [F.col(f"s_{i}") <= F.col(f"s_{c}") for c in p.children(i) if c in done]
            on += [c for q in done for c in (F.abs(F.col(f"s_{i}") - F.col(f"s_{q}")) <= window_ms, F.col(f"ids_{q}")[0] != F.col(f"ids_{i}")[0])]
            on += [F.col(f"at_{i}") >= F.col(anchor) - wide, F.col(f"at_{i}") <= F.col(anchor) + wide]
            out = out.join(t, reduce(lambda a, b: a & b, on)).drop(f"at_{i}")
        for v, c in ends.items():
            if v not in bound:
                out = out.withColumn(f"v_{v}", F.col(c))
                bound.append(v)
        done.append(i)
    times = [F.col(f"s_{i}") for i in done]
    low, high = (F.least(*times), F.greatest(*times)) if len(times) > 1 else (times[0], times[0])
    return out.select(low.alias("start_ms"), high.alias("end_ms"), results.events_text(p).alias("events"))
