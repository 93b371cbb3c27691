"""The engine in a call: edges and a pattern in, matches out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from edgeloom.operators import compose, results
from edgeloom.plans.pattern import Pattern


def match(edges: DataFrame, pattern: Pattern, window_ms: int, output: str = "flat", dedup_key: str = "all", **how) -> DataFrame:
    """output: flat (start_ms, end_ms, events), nested, or text (line). dedup_key: see results.distinct; how: see compose.match."""
    p = pattern.optimize()
    return {"flat": results.flat, "nested": results.nested, "text": results.rendered}[output](compose.match(edges, p, window_ms, **how), p, dedup_key)
