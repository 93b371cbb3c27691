"""Graphs that hold planted occurrences of a pattern."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

from edgeloom.plans.pattern import Pattern
from edgeloom.sources.edges import EDGE


def planted(spark: SparkSession, p: Pattern, n: int, seed: int = 0) -> DataFrame:
    """An edge table of n disjoint copies of a literal pattern, in random orders that the pattern allows; time steps by 0 or 1 s.

    A flow is one arc, a frequency so many. The rows are made on the driver: for tests, where n is small.
    """
    rnd, t, rows = random.Random(seed), 0, []
    for copy in range(n):
        base, done = copy * len(p.entities), []
        while len(done) < len(p.events):
            i = rnd.choice([i for i, e in enumerate(p.events) if i not in done and all(q in done for q in e.parents)])
            e = p.events[i]
            for _ in range(e.frequency):
                t += rnd.choice((0, 1000))
                k = len(rows)
                rows.append((t, k, k, e.signature or "arc", base + e.subject, p.entities[e.subject], base + e.object, p.entities[e.object]))
            done.append(i)
    kinds = ("long", "long", "long", "string", "long", "string", "long", "string")
    return spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(EDGE, kinds, strict=True)))
