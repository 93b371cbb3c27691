"""Registered queries of sources, tools and the reading of patterns, over rows that are made of the events table."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import api, measure, scratch
from edgeloom.functions.times import epoch_ms, seconds_text
from edgeloom.operators import results
from edgeloom.operators.generate import planted
from edgeloom.plans import legacy, pattern
from edgeloom.plans.pattern import Pattern
from edgeloom.sources import edges as src
from edgeloom.streaming import front

HOUR = 3_600_000
#: What comes of an event in every format, so that formats can be compared.
PARTS = ("ts_ms", "event_id", "event_sig", "subject_id", "subject_sig", "object_id", "object_sig")
MS_SQL = "epoch_us(ts) // 1000"
K_SQL = """regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", epoch_ms("ts").alias("ms"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """seq, value: of 50 lines, one lacks a column, one has one more, one has no time, and some are quoted."""
    e = _events(spark, d)
    time, sig = seconds_text(F.col("ms")), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('"a,'), "event_type", F.lit('"'))).otherwise(F.col("event_type"))
    line = F.concat_ws(",", time, time, _text("event_id"), sig, _text("user_id"), F.lit("User"), (F.col("k") + 1_000_000).cast("string"), F.lit("Key"))
    odd = F.col("event_id") % 50
    line = F.when(odd == 7, F.substring_index(line, ",", 7)).when(odd == 9, F.concat(line, F.lit(",x"))).when(odd == 11, F.concat(F.lit("x"), line)).otherwise(line)
    return e.select(F.col("event_id").alias("seq"), line.alias("value"))


def _csv(spark: SparkSession, d: str) -> DataFrame:
    where = scratch.path(spark, "csv")
    _csv_lines(spark, d).orderBy("seq").select("value").write.text(where)
    return src.read_csv(spark, where)


def _csv_rejects(spark: SparkSession, d: str) -> DataFrame:
    rows = src.rejects(_csv(spark, d))
    return rows.groupBy(F.col("malformed").isNotNull().alias("wrong_width")).agg(F.count(F.lit(1)).alias("n"))


def _csv_seq(spark: SparkSession, d: str) -> DataFrame:
    """Whether edges come in the order of the lines: the first file has the smallest ids."""
    rows = src.edges(_csv(spark, d))
    return rows.select("event_id", F.rank().over(_by_seq()).cast("bigint").alias("place"))


def _by_seq():
    from pyspark.sql import Window

    return Window.partitionBy(F.col("event_id") % 16).orderBy("seq")


def _node(kind: str, **properties: Column) -> Column:
    return F.struct(*[F.lit(kind).alias("type")] * bool(kind), *[c.alias(k) for k, c in properties.items()])


def _spade_lines(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    path, n = F.concat(F.lit("/k/"), _text("k")), F.col("k") % 6
    props = F.create_map(
        F.lit("type"), F.when(n == 5, "Agent").when(n == 4, "Process").otherwise("Artifact"), F.lit("subtype"), F.when(n == 0, "file").when(n == 1, "directory").when(n == 2, "network socket").when(n == 3, "unnamed pipe"),
        F.lit("path"), F.when(n < 2, path), F.lit("name"), F.when(n == 4, path), F.lit("remote address"), F.when(n == 2, F.lit("10.0.0.1")), F.lit("remote port"), F.when(n == 2, _text("k")),
    )
    time, late = seconds_text(F.col("ms")), seconds_text(F.col("ms") + F.col("event_id") % 3 * 1000)
    spanned = F.col("event_id") % 2 == 0
    r = F.create_map(F.lit("operation"), F.col("event_type"), F.lit("time"), F.when(~spanned | (F.col("k") > 50), time), F.lit("earliest"), F.when(spanned, time), F.lit("lastest"), F.when(spanned, late))
    node = lambda i, p: F.struct(i.alias("id"), F.map_filter(p, lambda _, v: v.isNotNull()).alias("properties"))
    user = F.create_map(F.lit("type"), F.lit("Process"), F.lit("name"), F.concat(F.lit("u"), _text("user_id")))
    return e.select(F.to_json(F.struct(node(_text("event_id"), r).alias("r"), node(_text("user_id"), user).alias("m"), node((F.col("k") + 1_000_000).cast("string"), props).alias("n"))).alias("value"))


def _darpa_lines(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    n = F.col("k") % 6
    props = F.create_map(
        F.lit("type"), F.when(n == 0, "FILE_OBJECT_FILE").when(n == 1, "SRCSINK_UNKNOWN").when(n == 4, "PRINCIPAL"), F.lit("path"), F.when(n == 0, F.concat(F.lit("/k/"), _text("k"))), F.lit("SrcSinkObject_pid"), F.when(n == 1, _text("k")),
        F.lit("NetFlowObject_baseObject_epoch"), F.when(n == 2, F.lit("1")), F.lit("NetFlowObject_remoteAddress"), F.when(n == 2, F.lit("10.0.0.1")), F.lit("NetFlowObject_remotePort"), F.when(n == 2, _text("k")), F.lit("UnnamedPipeObject_baseObject_epoch"), F.when(n == 3, F.lit("1")),
    )
    nanos = lambda more: (F.col("ms") + more) * 1_000_000 + F.col("event_id") % 1_000_000
    spanned = F.col("event_id") % 2 == 0
    times = F.struct(F.col("event_type").alias("type"), F.when(~spanned, nanos(0)).alias("time"), F.when(spanned, nanos(0)).alias("earliest"), F.when(spanned, nanos(F.col("event_id") % 3 * 1000)).alias("lastest"))
    node = lambda i, p: F.struct(i.alias("id"), p.alias("properties"))
    user = F.create_map(F.lit("type"), F.lit("SUBJECT_PROCESS"), F.lit("Subject_properties_map_name"), F.concat(F.lit("u"), _text("user_id")))
    return e.select(F.to_json(F.struct(node(_text("event_id"), times).alias("r"), node(_text("user_id"), user).alias("m"), node((F.col("k") + 1_000_000).cast("string"), F.map_filter(props, lambda _, v: v.isNotNull())).alias("n"))).alias("value"))


def _six_lines(spark: SparkSession, d: str) -> DataFrame:
    time = seconds_text(F.col("ms"))
    sig = F.concat(F.when(F.col("event_id") % 3 == 0, F.lit("a#b")).otherwise(F.col("event_type")), F.lit("#User::x#Key::"), _text("k"))
    sig = F.when(F.col("event_id") % 11 == 0, F.lit("none")).otherwise(sig)
    return _events(spark, d).select(F.concat_ws(",", time, time, sig, _text("event_id"), _text("user_id"), (F.col("k") + 1_000_000).cast("string")).alias("value"))


def _ingested(lines, read) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: src.edges(read(lines(spark, d))).select(*PARTS)


JSON_PATTERN = json.dumps({"Version": "0.2.0", "Entities": [{"ID": 4, "Signature": "p"}, {"ID": 2, "Signature": "f.*"}], "Events": [
    {"ID": 9, "Signature": "read", "SubjectID": 2, "ObjectID": 4, "Frequency": 3}, {"ID": 5, "Signature": "write", "SubjectID": 4, "ObjectID": 2, "Parents": [9]}, {"ID": 6, "Type": "Flow", "SubjectID": 2, "ObjectID": 4, "Parents": [9, 5]}]})
OLD_PATTERN = json.dumps({"Version": "0.1.0", "UseRegex": False, "Events": [{"ID": 0, "Signature": "open#p::a#f::b", "SubjectID": 7, "ObjectID": 3, "Parents": []}, {"ID": 1, "Signature": "read#f::b#p::a", "SubjectID": 3, "ObjectID": 7, "Parents": [0]}]})
GRAPH_NODES = ['{"node": {"id": "3", "properties": {"type": "Process", "name": "sh"}}}', '{"node": {"id": "8", "properties": {"type": "Artifact", "subtype": "unnamed pipe"}}}']
GRAPH_EDGES = ['{"edge": {"id": "0", "start": {"id": "3"}, "end": {"id": "8"}, "properties": {"operation": "write"}}}', '{"edge": {"id": "1", "start": {"id": "8"}, "end": {"id": "3"}, "properties": {"operation": "read"}}}']
GRAPH_ORDER = '{"0": {"parents": ["root"], "children": [1]}, "1": {"parents": [0], "children": []}, "root": {"parents": [], "children": [0]}}'


def read_patterns() -> dict[str, Pattern]:
    """By where each comes from: JSON of either version, a property graph with an order file, calls."""
    return {
        "json": Pattern.parse(JSON_PATTERN),
        "upgraded": Pattern.parse(pattern.upgrade(OLD_PATTERN)),
        "property graph": legacy.from_property_graph(GRAPH_NODES, GRAPH_EDGES, GRAPH_ORDER),
        "built": Pattern.from_graph(["x", "y"], [(0, 1, "a"), (1, 0, "b")]).chained().frequency(0, 1).optimize(),
    }


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    rows = [
        (name, i, e.kind, e.frequency, e.signature, p.entities[e.subject], p.entities[e.object], ",".join(map(str, e.parents)), p.use_regex)
        for name, p in read_patterns().items() for i, e in enumerate(p.events)
    ]
    return spark.createDataFrame(rows, "pattern string, event int, kind string, frequency int, signature string, subject string, object string, parents string, use_regex boolean")


def _dot(spark: SparkSession, d: str) -> DataFrame:
    lines = read_patterns()["json"].to_dot().split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


PLANTED = Pattern.from_graph(["p", "f", "s"], [(0, 1, "read"), (0, 2, "send"), (2, 1, "wait")], use_regex=False).before(0, 1).frequency(1, 2)


def _planted(spark: SparkSession, d: str) -> DataFrame:
    found = api.match(planted(spark, PLANTED, 25), PLANTED, 1 << 40)
    return found.agg(F.count(F.lit(1)).alias("matches"))


TWO = Pattern.from_graph(["Key::.*", "User::.*"], [(0, 1, "view"), (1, 0, "purchase")]).before(0, 1)
WIDE = 7 * 24 * HOUR


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return src.from_events(spark.read.parquet(f"{d}/events.parquet"))


def _first_id(c: str = "events") -> Column:
    return F.regexp_extract(c, "[0-9]+", 0).cast("bigint")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """What a program found, some twice, against lines that lack some and have one too many."""
    lines, _ = scratch.save(api.match(_graph(spark, d), TWO, WIDE, "text"), "lines")
    events = lines.select(F.regexp_extract("line", r"\[.*", 0).alias("events"))
    found = events.unionByName(events.where(_first_id() % 5 == 0))
    told = lines.where(_first_id("line") % 3 != 0).select(F.col("line").alias("value")).unionByName(spark.createDataFrame([("<0.000, 1.000>[1, (2, 3)]",), ("Total number of matches: 9",)], "value string"))
    # ids in a line come after two times
    told = told.unionByName(lines.where(_first_id("line") % 3 == 0).where(_first_id(F.regexp_extract("line", r"\[.*", 0)) % 2 == 0).select(F.col("line").alias("value")))
    return results.diff(found, results.parse_answers(told))


def _repro(spark: SparkSession, d: str) -> DataFrame:
    first = api.match(_graph(spark, d), TWO, WIDE).orderBy("end_ms", "events").limit(1)
    ids = first.select(F.transform(F.regexp_extract_all("events", F.lit("([0-9]+)")), lambda x: x.cast("bigint")).alias("ids"))
    return results.repro(_graph(spark, d), ids).drop("seq")


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    runs = measure.run_matrix(spark, {"ordered": TWO, "any order": Pattern.from_graph(list(TWO.entities), [(0, 1, "view"), (1, 0, "purchase")])}, {"all": g, "even": g.where("event_id % 2 = 0")}, WIDE, repeats=2, first=0)
    return measure.averages(runs).select("pattern", "graph", "matches")


def _experiments(spark: SparkSession, d: str) -> DataFrame:
    return measure.experiments(spark, _graph(spark, d), EXPERIMENTS).select("experiment", "variant", "matches")


FREQUENT = Pattern.from_graph(["Key::.*", "User::.*", "Key::.*"], [(0, 1, "view"), (1, 2, "purchase")]).before(0, 1)
EXPERIMENTS: dict[str, dict[str, tuple[Pattern, int, dict]]] = {
    "frequency": {"plain": (FREQUENT, 6 * HOUR, {}), "of two": (FREQUENT.frequency(0, 2), 20 * 24 * HOUR, {})},
    "flow": {"one edge": (Pattern.from_graph(["Key::1.*", "User::.*"], [(0, 1, ".*")]), HOUR, {}), "any way": (Pattern.from_graph(["Key::1.*", "User::.*"], [(0, 1, "")]).flow(0), HOUR, {})},
}


def _late(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth event of the first half comes with the second half, late by the watermark if over an hour behind."""
    g, where = _graph(spark, d), scratch.path(spark, "late")
    half = F.col("ts_ms") < F.lit(g.agg((F.min("ts_ms") + F.max("ts_ms")) / 2).first()[0])
    late = F.col("event_id") % 10 == 3
    for n, rows in enumerate((g.where(half & ~late), g.where(~half | late))):
        front.advance(rows, n, TWO, HOUR, where, lateness_ms=HOUR)
    return front.late(spark, where).select("event_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "csv_edges": lambda s, d: src.edges(_csv(s, d)).select(*PARTS),
        "csv_rejects": _csv_rejects,
        "csv_order": _csv_seq,
        "csv_verify": lambda s, d: src.odd_lines(_csv_lines(s, d)),
        "ingest_spade": _ingested(_spade_lines, src.from_spade),
        "ingest_spade_reversed": _ingested(_spade_lines, lambda lines: src.from_spade(lines, reverse=True)),
        "ingest_darpa": _ingested(_darpa_lines, src.from_darpa),
        "ingest_six_columns": _ingested(_six_lines, src.from_six_columns),
        "patterns_read": _patterns,
        "pattern_dot": _dot,
        "planted_matches": _planted,
        "answers_diff": _answers,
        "repro_graph": _repro,
        "run_matrix": _matrix,
        "experiments": _experiments,
        "stream_late": _late,
    }


def _parts_sql(rest: str, ts: str = "ts_ms") -> str:
    return f"SELECT {ts} AS ts_ms, {rest}"


def oracle_sql() -> dict[str, str]:
    from edgeloom.catalogue import EDGES_SQL, pattern_sql

    e = f"WITH e AS (SELECT event_id, user_id, event_type, {MS_SQL} AS ms, {K_SQL} AS k FROM events)"
    sig = "CASE WHEN event_id % 7 = 0 THEN 'a,' || event_type ELSE event_type END"
    fine = "event_id % 50 NOT IN (7, 9, 11)"
    span = "unnest(CASE WHEN event_id % 2 = 0 THEN list_distinct([ms, ms + event_id % 3 * 1000]) ELSE [ms] END)"
    user, key = "user_id AS subject_id, {u} AS subject_sig", "k + 1000000 AS object_id, {o} AS object_sig"
    spade_sig = "CASE k % 6 WHEN 0 THEN 'Artifact::file::/k/' || k WHEN 1 THEN 'Artifact::directory::/k/' || k WHEN 2 THEN 'Artifact::network socket::10.0.0.1:' || k WHEN 3 THEN 'Artifact::unnamed pipe::' WHEN 4 THEN 'Process::/k/' || k ELSE 'Agent::' END"
    darpa_sig = "CASE k % 6 WHEN 0 THEN 'FILE_OBJECT_FILE::/k/' || k WHEN 1 THEN 'SRCSINK_UNKNOWN::' || k WHEN 2 THEN 'OBJECT_SOCKET::10.0.0.1:' || k WHEN 3 THEN 'OBJECT_UNNAMEPIPE::' WHEN 4 THEN 'PRINCIPAL::' ELSE 'OTHER' END"
    both = lambda u, o: f"{user.format(u=u)}, {key.format(o=o)}"
    commas = "CASE event_id % 50 WHEN 7 THEN 7 WHEN 9 THEN 9 ELSE 8 END + CASE WHEN event_id % 7 = 0 AND (event_id % 50 <> 7) THEN 1 ELSE 0 END"
    view = f"WITH {EDGES_SQL}"
    sec = lambda c: f"({c} // 1000)::VARCHAR || '.' || lpad(({c} % 1000)::VARCHAR, 3, '0')"
    line = f"'<' || {sec('start_ms')} || ', ' || {sec('end_ms')} || '>' || events"
    first = "regexp_extract({}, '[0-9]+')::BIGINT"
    answers = f"""lines AS (SELECT events, {line} AS line FROM firsts), had AS (SELECT events FROM lines UNION ALL SELECT events FROM lines WHERE {first.format('events')} % 5 = 0),
told AS (SELECT events FROM lines WHERE {first.format('line')} % 3 <> 0 OR {first.format('events')} % 2 = 0 UNION ALL SELECT '[1, (2, 3)]')
SELECT events, 'false positive' AS problem FROM (SELECT DISTINCT events FROM had) WHERE events NOT IN (SELECT events FROM told)
UNION ALL SELECT events, 'missing' FROM (SELECT DISTINCT events FROM told) WHERE events NOT IN (SELECT events FROM had)
UNION ALL SELECT events, 'duplicate' FROM had GROUP BY events HAVING count(*) > 1"""
    repro = """one AS (SELECT events FROM firsts ORDER BY end_ms, events LIMIT 1), ids AS (SELECT unnest(regexp_extract_all(events, '[0-9]+'))::BIGINT AS event_id FROM one),
rows AS (SELECT * FROM edges WHERE event_id IN (SELECT event_id FROM ids)), v AS (SELECT x, dense_rank() OVER (ORDER BY x) - 1 AS n FROM (SELECT subject_id AS x FROM rows UNION SELECT object_id FROM rows)), i AS (SELECT event_id AS x, dense_rank() OVER (ORDER BY event_id) - 1 AS n FROM (SELECT DISTINCT event_id FROM rows))
SELECT ts_ms, i.n AS event_id, event_sig, a.n AS subject_id, subject_sig, b.n AS object_id, object_sig FROM rows JOIN i ON i.x = event_id JOIN v a ON a.x = subject_id JOIN v b ON b.x = object_id"""
    any_order = Pattern.from_graph(list(TWO.entities), [(0, 1, "view"), (1, 0, "purchase")])
    even = EDGES_SQL.replace("FROM events))", "FROM events WHERE event_id % 2 = 0))")
    count = lambda p, w, v: f"({pattern_sql(p, w, last='SELECT count(*) FROM firsts', view=v)})"
    cells = [(n, g, count(p, WIDE, v)) for n, p in (("ordered", TWO), ("any order", any_order)) for g, v in (("all", EDGES_SQL), ("even", even))]
    each = " UNION ALL ".join(f"SELECT '{n}' AS pattern, '{g}' AS graph, {sql}::DOUBLE AS matches" for n, g, sql in cells)
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    known = [
        ("json", 0, "frequency", 3, "read", "f.*", "p", "", True), ("json", 1, "default", 1, "write", "p", "f.*", "0", True), ("json", 2, "flow", 1, "", "f.*", "p", "0,1", True),
        ("upgraded", 0, "default", 1, "open", "p::a", "f::b", "", False), ("upgraded", 1, "default", 1, "read", "f::b", "p::a", "0", False),
        ("property graph", 0, "default", 1, "write", "Process::sh", "Artifact::unnamed pipe::", "", False), ("property graph", 1, "default", 1, "read", "Artifact::unnamed pipe::", "Process::sh", "0", False),
        ("built", 0, "default", 1, "a", "x", "y", "", True), ("built", 1, "default", 1, "b", "y", "x", "0", True),
    ]
    values = ", ".join("(" + ", ".join(str(x) if isinstance(x, (bool, int)) else quoted(x) for x in r) + ")" for r in known)
    dot = ["digraph {", '  v0 [label="p"];', '  v1 [label="f.*"];', '  v1 -> v0 [label="e0 read x3"];', '  v0 -> v1 [label="e1 write"];', '  v1 -> v0 [label="e2 ", style=dashed];', "}"]
    return {
        "csv_edges": f"{e} SELECT ms AS ts_ms, event_id, {sig} AS event_sig, {both(quoted('User'), quoted('Key'))} FROM e WHERE {fine}",
        "csv_rejects": f"{e} SELECT event_id % 50 IN (7, 9) AS wrong_width, count(*) AS n FROM e WHERE NOT ({fine}) GROUP BY 1",
        "csv_order": f"{e} SELECT event_id, rank() OVER (PARTITION BY event_id % 16 ORDER BY event_id) AS place FROM e WHERE {fine}",
        "csv_verify": f"WITH c AS (SELECT event_id AS seq, ({commas})::INT AS columns FROM events) SELECT seq, columns FROM (SELECT *, lag(columns) OVER (ORDER BY seq) AS before FROM c) WHERE columns <> before",
        "ingest_spade": f"{e} SELECT {span} AS ts_ms, event_id, event_type AS event_sig, {both(quoted('Process::u') + ' || user_id', spade_sig)} FROM e",
        "ingest_spade_reversed": f"{e} SELECT {span} AS ts_ms, event_id, event_type AS event_sig, user_id AS object_id, 'Process::u' || user_id AS object_sig, k + 1000000 AS subject_id, {spade_sig} AS subject_sig FROM e",
        "ingest_darpa": f"{e} SELECT {span} AS ts_ms, event_id, event_type AS event_sig, {both(quoted('SUBJECT_PROCESS::u') + ' || user_id', darpa_sig)} FROM e",
        "ingest_six_columns": f"{e} SELECT ms AS ts_ms, event_id, CASE WHEN event_id % 3 = 0 THEN 'a#b' ELSE event_type END AS event_sig, {both(quoted('User::x'), quoted('Key::') + ' || k')} FROM e WHERE event_id % 11 <> 0",
        "patterns_read": f"SELECT * FROM (VALUES {values}) AS t(pattern, event, kind, frequency, signature, subject, object, parents, use_regex)",
        "pattern_dot": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(x)})" for i, x in enumerate(dot)) + ") AS t(line, text)",
        "planted_matches": "SELECT 25::BIGINT AS matches",
        "answers_diff": pattern_sql(TWO, WIDE, last=", " + answers).replace(")\n, lines AS", "),\nlines AS"),
        "repro_graph": pattern_sql(TWO, WIDE, last=", " + repro).replace(")\n, one AS", "),\none AS"),
        "run_matrix": f"WITH x AS ({each}) SELECT * FROM x UNION ALL SELECT NULL, graph, avg(matches) FROM x GROUP BY graph",
        "experiments": " UNION ALL ".join(f"SELECT '{x}' AS experiment, '{v}' AS variant, {count(p, w, EDGES_SQL)}::BIGINT AS matches" for x, variants in EXPERIMENTS.items() for v, (p, w, _) in variants.items()),
        "stream_late": f"{view}, m AS (SELECT (min(ts_ms) + max(ts_ms)) / 2 AS half FROM edges), w AS (SELECT max(ts_ms) - {HOUR} AS mark FROM edges, m WHERE ts_ms < half AND event_id % 10 <> 3) SELECT event_id FROM edges, m, w WHERE ts_ms < mark AND (ts_ms >= half OR event_id % 10 = 3)",
    }
