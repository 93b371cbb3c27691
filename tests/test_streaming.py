"""Streams of several micro-batches against the batch plan."""

import os
import random

import pytest

from edgeloom import api
from edgeloom.plans.pattern import Pattern
from edgeloom.sources import edges as src
from edgeloom.streaming import front, joined

PATH = Pattern.from_graph(["[ab]", ".*", ".*"], [(0, 1, "x"), (1, 2, "x|y")]).before(0, 1)
RUN = PATH.frequency(1, 2)
FLOW = Pattern.from_graph(["a", ".*", ".*"], [(0, 1, ""), (1, 2, "y")]).flow(0).before(0, 1)
WINDOW = 9_000


@pytest.fixture
def files(tmp_path):
    """Five CSV files in order of time, by which the source takes them."""
    rnd, t, rows = random.Random(3), 0, []
    for k in range(100):
        t += rnd.choice((0, 1, 1, 2))
        a, b = rnd.randrange(7), rnd.randrange(7)
        rows.append(f"{t}.0,{t}.0,{k},{rnd.choice('xy')},{a},{'abc'[a % 3]},{b},{'abc'[b % 3]}")
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(5):
        (folder / f"{n}.csv").write_text("\n".join(rows[20 * n : 20 * n + 20]) + "\n")
        os.utime(folder / f"{n}.csv", (1_700_000_000 + n, 1_700_000_000 + n))
    return folder


def _stream(spark, folder):
    raw = spark.readStream.schema(src.RAW_SCHEMA).option("maxFilesPerTrigger", 1).option("mode", "DROPMALFORMED").csv(str(folder))
    return src.edges(raw)


def _rows(df):
    return sorted((r.start_ms, r.end_ms, r.events) for r in df.collect())


@pytest.mark.parametrize("p", [PATH, RUN, FLOW], ids=["default", "frequency", "flow"])
def test_front(spark, files, tmp_path, p):
    where = str(tmp_path / "out")
    front.start(_stream(spark, files), p, WINDOW, where).awaitTermination()
    sent, held = front.found(spark, where), front.rest(spark, where, p, WINDOW)
    everything = src.edges(src.read_csv(spark, str(files)).withColumn("seq", src.F.col("event_id").cast("long")))
    want = _rows(api.match(everything, p, WINDOW))
    assert sent.count() > 0
    got = _rows(sent.unionByName(held))
    if p is FLOW:  # equal events over a window apart come again
        first = {}
        for r in sorted(got, key=lambda r: (r[1], r[0])):
            first.setdefault(r[2], r)
        got = sorted(first.values())
    assert got == want and front.late(spark, where).count() == 0


def test_repeated_and_late(spark, tmp_path):
    where, kinds = str(tmp_path), src.EDGE_SCHEMA
    row = lambda t, k, a, b: (t * 1000, k, k, "x", a, "a", b, "b")
    batches = [[row(1, 0, 1, 2), row(3, 1, 2, 3)], [row(5, 2, 2, 4), row(2, 3, 2, 5)], [], [row(60, 4, 8, 9)], [row(61, 5, 9, 7)], [row(62, 6, 9, 6)]]
    for n, rows in enumerate(batches):
        for _ in range(2):
            front.advance(spark.createDataFrame(rows, kinds), n, PATH, WINDOW, where)
    assert [r.event_id for r in front.late(spark, where).collect()] == [3]
    assert sorted(r.events for r in front.found(spark, where).collect()) == ["[0, 1]", "[0, 2]", "[4, 5]"]
    assert [r.events for r in front.rest(spark, where, PATH, WINDOW).collect()] == ["[4, 6]"]
    assert not (tmp_path / "edges" / "0").exists() and (tmp_path / "edges" / "4").exists()


def test_joined(spark, files, tmp_path):
    p = Pattern.from_graph(["[ab]", ".*", ".*", ".*"], [(0, 1, "x"), (1, 2, "x|y"), (2, 3, "y")]).chained()
    q = joined.match(_stream(spark, files), p, WINDOW).writeStream.format("parquet").option("path", str(tmp_path / "found")).option("checkpointLocation", str(tmp_path / "check"))
    q.trigger(availableNow=True).start().awaitTermination()
    want = _rows(api.match(src.edges(src.read_csv(spark, str(files))), p, WINDOW))
    assert want and _rows(spark.read.parquet(str(tmp_path / "found"))) == want
    with pytest.raises(ValueError):
        joined.match(_stream(spark, files), RUN, WINDOW)
