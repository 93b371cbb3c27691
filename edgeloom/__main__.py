"""``python -m edgeloom [-w SECONDS] [-s] PATTERN DATA``: matches of a JSON pattern in a CSV graph."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from edgeloom import api
from edgeloom.plans.pattern import Pattern
from edgeloom.sources import edges


def main(argv: list[str] | None = None) -> int:
    """Print each match as a line unless silent, then how many there are; that number."""
    args = argparse.ArgumentParser(prog="edgeloom", description=__doc__)
    args.add_argument("pattern", help="JSON file")
    args.add_argument("data", help="CSV file or folder")
    args.add_argument("-w", "--window-size", type=int, default=1800, help="seconds")
    args.add_argument("-s", "--silent", action="store_true", help="don't print matches")
    args.add_argument("--output", help="write matches there as Parquet, from the executors")
    given = args.parse_args(argv)
    spark = SparkSession.builder.appName("edgeloom").getOrCreate()
    began = time.time()
    graph = edges.edges(edges.read_csv(spark, given.data))
    lines = api.match(graph, Pattern.read(given.pattern), given.window_size * 1000, "text")
    if given.output:
        lines.write.mode("overwrite").parquet(given.output)
        lines = spark.read.schema(lines.schema).parquet(given.output)
    if given.silent:
        n = lines.count()
    else:
        n = 0
        for row in lines.toLocalIterator():  # a partition at a time
            print(f"Pattern Match: {row.line}")
            n += 1
    print(f"Total number of matches: {n}")
    print(f"Seconds: {time.time() - began:.3f}")
    return n


if __name__ == "__main__":
    main()
