"""Patterns by graphs, timed; experiments; and how many partial matches a plan goes through."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import api
from edgeloom.operators import compose
from edgeloom.plans.pattern import Pattern

RUN = "pattern string, graph string, run int, matches long, seconds double"


def run_matrix(spark: SparkSession, patterns: dict[str, Pattern], graphs: dict[str, DataFrame], window_ms: int, repeats: int = 3, first: int = 1, **how) -> DataFrame:
    """A row for each pattern, graph and run; ``first`` runs before them aren't counted."""
    rows = []
    for name, p in patterns.items():
        for graph, edges in graphs.items():
            for k in range(-first, repeats):
                began = time.time()
                n = api.match(edges, p, window_ms, **how).count()
                if k >= 0:
                    rows.append((name, graph, k, n, time.time() - began))
    return spark.createDataFrame(rows, RUN)


def averages(runs: DataFrame) -> DataFrame:
    """pattern, graph, matches, seconds: means over runs; and a row without a pattern for each graph, of the means over patterns."""
    each = runs.groupBy("pattern", "graph").agg(F.avg("matches").alias("matches"), F.avg("seconds").alias("seconds"))
    return each.unionByName(each.groupBy("graph").agg(F.avg("matches").alias("matches"), F.avg("seconds").alias("seconds")).withColumn("pattern", F.lit(None).cast("string")))


def experiments(spark: SparkSession, edges: DataFrame, which: dict[str, dict[str, tuple[Pattern, int, dict]]]) -> DataFrame:
    """experiment, variant, matches, seconds: the variants (pattern, window, options of match) of each experiment side by side."""
    rows = []
    for experiment, variants in which.items():
        for variant, (p, window, how) in variants.items():
            began = time.time()
            rows.append((experiment, variant, api.match(edges, p, window, **how).count(), time.time() - began))
    return spark.createDataFrame(rows, "experiment string, variant string, matches long, seconds double")


def states(edges: DataFrame, p: Pattern, window_ms: int, **how) -> list[tuple[tuple[int, ...], int]]:
    """The events and the number of partial matches of every join of chains, in order of doing them."""
    seen: list[compose.Part] = []
    compose.match(edges, p, window_ms, seen=seen, **how)
    return [(part.events, part.df.count()) for part in seen]
