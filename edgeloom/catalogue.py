"""The registered queries of the engine and their SQL.

The SQL of a pattern is written out from its definition as one join of all its events with every condition in WHERE,
apart from how the engine plans it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import api, samples, scratch
from edgeloom.functions.signatures import matches
from edgeloom.functions.times import epoch_ms, timestamp_ms
from edgeloom.operators import candidates, compose, flow, frequency, results
from edgeloom.plans.pattern import Pattern
from edgeloom.sources import edges as src
from edgeloom.streaming import front, joined

HOUR = 3_600_000
DAY = 24 * HOUR

EDGES_SQL = """edges AS (SELECT epoch_us(ts) // 1000 AS ts_ms, event_id AS seq, event_id, event_type AS event_sig,
  CASE WHEN event_type IN ('view', 'click') THEN k ELSE user_id END AS subject_id, CASE WHEN event_type IN ('view', 'click') THEN 'Key::' || k ELSE 'User::' || user_id END AS subject_sig,
  CASE WHEN event_type IN ('view', 'click') THEN user_id ELSE k END AS object_id, CASE WHEN event_type IN ('view', 'click') THEN 'User::' || user_id ELSE 'Key::' || k END AS object_sig
  FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT + 1000000 AS k FROM events))"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _sig(column: str, signature: str, regex: bool) -> str:
    return f"regexp_full_match({column}, '{signature}')" if regex else f"{column} = '{signature}'"


def pattern_sql(p: Pattern, window_ms: int, unique: bool = True, last: str = "SELECT start_ms, end_ms, events FROM firsts", view: str = EDGES_SQL) -> str:
    """DuckDB SQL for the matches of a pattern in the edge view."""
    p, ctes, where, text = p.optimize(), [view], [], []
    n = range(len(p.events))
    for i in n:
        e = p.events[i]
        ends = f"{_sig('subject_sig', p.entities[e.subject], p.use_regex)} AND {_sig('object_sig', p.entities[e.object], p.use_regex)}"
        rows = f"SELECT * FROM edges WHERE {_sig('event_sig', e.signature, p.use_regex)} AND {ends}"
        if e.kind == "default":
            ctes.append(f"e{i} AS (SELECT subject_id AS src, object_id AS dst, ts_ms AS s, ts_ms AS t, [event_id] AS ids FROM ({rows}))")
            text.append(f"e{i}.ids[1]")
        elif e.kind == "frequency":
            k = e.frequency - 1
            ctes.append(f"e{i} AS (SELECT * FROM (SELECT subject_id AS src, object_id AS dst, ts_ms AS s, lead(ts_ms, {k}) OVER w AS t, list(event_id) OVER (PARTITION BY subject_id, object_id ORDER BY ts_ms, seq ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING) AS ids FROM ({rows}) WINDOW w AS (PARTITION BY subject_id, object_id ORDER BY ts_ms, seq)) WHERE t - s <= {window_ms})")
            text.append(f"'(' || array_to_string(e{i}.ids, ', ') || ')'")
        else:
            node = lambda v: f"(SELECT subject_id FROM edges WHERE {_sig('subject_sig', p.entities[v], p.use_regex)} UNION SELECT object_id FROM edges WHERE {_sig('object_sig', p.entities[v], p.use_regex)})"
            ctes.append(f"r{i} AS (SELECT subject_id AS src, object_id AS dst, ts_ms AS s, ts_ms AS t FROM edges WHERE subject_id <> object_id AND subject_id IN {node(e.subject)} UNION SELECT r.src, a.object_id, r.s, a.ts_ms FROM r{i} r JOIN edges a ON a.subject_id = r.dst AND a.ts_ms >= r.t AND a.ts_ms - r.s <= {window_ms} AND a.object_id <> r.src AND a.subject_id <> a.object_id)")
            ctes.append(f"e{i} AS (SELECT src, dst, s, t, []::BIGINT[] AS ids FROM (SELECT *, max(s) OVER (PARTITION BY src, dst ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT src, dst, max(s) AS s, t FROM r{i} GROUP BY src, dst, t)) WHERE (top IS NULL OR s > top) AND dst IN {node(e.object)})")
            text.append(f"'(' || e{i}.src || ' -> ' || e{i}.dst || ')'")
        where += [f"e{q}.t <= e{i}.s" for q in e.parents]
        if unique and e.kind != "flow":
            where += [f"NOT list_has_any(e{q}.ids, e{i}.ids)" for q in range(i) if p.events[q].kind != "flow"]
    place: dict[int, list[str]] = {}
    for i in n:
        place.setdefault(p.events[i].subject, []).append(f"e{i}.src")
        place.setdefault(p.events[i].object, []).append(f"e{i}.dst")
    for cols in place.values():
        where += [f"{cols[0]} = {c}" for c in cols[1:]]
    firsts = [cols[0] for cols in place.values()]
    where += [f"{a} <> {b}" for k, a in enumerate(firsts) for b in firsts[:k]]
    low, high = (f"{f}({', '.join(f'e{i}.{c}' for i in n)})" if len(p.events) > 1 else f"e0.{c}" for f, c in (("least", "s"), ("greatest", "t")))
    where.append(f"{high} - {low} <= {window_ms}")
    joined = " || ', ' || ".join(text)
    found = f"found AS (SELECT {low} AS start_ms, {high} AS end_ms, '[' || {joined} || ']' AS events FROM {', '.join(f'e{i}' for i in n)} WHERE {' AND '.join(where)})"
    pick = "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY events ORDER BY end_ms, start_ms) AS r FROM found) WHERE r = 1)"
    return "WITH RECURSIVE " + ",\n".join([*ctes, found, pick]) + "\n" + last


#: Signups as edges from a user to itself.
LOOPS_SQL = EDGES_SQL.replace("edges AS", "plain AS") + """,
edges AS (SELECT ts_ms, seq, event_id, event_sig, subject_id, subject_sig, CASE WHEN event_sig = 'signup' THEN subject_id ELSE object_id END AS object_id,
  CASE WHEN event_sig = 'signup' THEN subject_sig ELSE object_sig END AS object_sig FROM plain)"""
#: Every event as an interval of some days, so twice.
SPANS_SQL = EDGES_SQL.replace("edges AS", "plain AS") + f""",
edges AS (SELECT unnest(list_distinct([ts_ms, ts_ms + event_id % 3 * {2 * DAY}])) AS ts_ms, seq, event_id, event_sig, subject_id, subject_sig, object_id, object_sig FROM plain)"""


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.col("event_sig") == "signup"
    return graph(spark, sf_dir).withColumns({"object_id": F.when(one, F.col("subject_id")).otherwise(F.col("object_id")), "object_sig": F.when(one, F.col("subject_sig")).otherwise(F.col("object_sig"))})


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph(spark, sf_dir).withColumnRenamed("ts_ms", "start_ms")
    return src.with_duplicates(rows.withColumn("end_ms", F.col("start_ms") + F.col("event_id") % 3 * (2 * DAY))).select(*src.EDGE)


USER, KEY = "User::.*", "Key::.*"


def _graph(entities: list[str], events: list[tuple[int, int, str]], *order: tuple[int, int]) -> Pattern:
    p = Pattern.from_graph(entities, events)
    for a, b in order:
        p = p.before(a, b)
    return p


#: Its first two chains share no entity, so that joining them as they come goes through all pairs within a window.
FAR_APART = _graph([KEY, USER, KEY, USER], [(0, 1, "view"), (2, 3, "click"), (1, 2, "purchase")])

#: Name to pattern, window and options of match().
PATTERNS: dict[str, tuple[Pattern, int, dict]] = {
    "pat_two_step_shared_object": (_graph([KEY, USER, KEY], [(0, 1, "view"), (1, 2, "purchase")], (0, 1)), HOUR, {}),
    "pat_two_step_shared_subject": (_graph([USER, KEY, KEY], [(0, 1, "purchase"), (0, 2, "signup")], (0, 1)), 2 * HOUR, {}),
    "pat_two_step_both_endpoints": (_graph([KEY, USER], [(0, 1, "view"), (1, 0, "purchase")], (0, 1)), 7 * DAY, {}),
    "pat_path3": (_graph([KEY, USER, KEY, USER], [(0, 1, "view"), (1, 2, "purchase"), (2, 3, "click")], (0, 1), (1, 2)), 8 * HOUR, {}),
    "pat_star3": (_graph([USER, KEY, KEY, KEY], [(1, 0, "click"), (2, 0, "view"), (0, 3, "error")], (0, 2), (1, 2)), 6 * HOUR, {}),
    "pat_diamond": (_graph([USER, USER, KEY, KEY], [(2, 0, "view"), (0, 3, "purchase"), (2, 1, "click"), (1, 3, "error")], (0, 1), (2, 3)), 3 * DAY, {}),
    "pat_partial_order_unordered": (_graph([KEY, USER, KEY], [(0, 1, "view"), (1, 2, "purchase")]), HOUR, {}),
    "pat_partial_order_dag": (_graph([KEY, USER, KEY, KEY], [(0, 1, "view"), (1, 2, "purchase"), (1, 3, "signup")], (0, 1), (0, 2)), 8 * HOUR, {}),
    "pat_event_uniqueness_global": (_graph([KEY, USER], [(0, 1, "view"), (0, 1, "view|click")]), 3 * DAY, {}),
    "pat_event_uniqueness_chain": (_graph([KEY, USER], [(0, 1, "view"), (0, 1, "view|click")]), 3 * DAY, {"event_uniqueness": "chain"}),
    "pat_window_inclusive": (_graph([KEY, USER, KEY], [(0, 1, "view"), (1, 2, "purchase")], (0, 1)), 3_000_000, {}),
    "pat_entity_injective": (_graph([KEY, USER, KEY], [(0, 1, "click"), (2, 1, "click")], (0, 1)), 2 * HOUR, {}),
    "pat_multi_chain_join": (_graph([KEY, USER, KEY, USER], [(0, 1, "view"), (1, 2, "purchase"), (0, 3, "click"), (3, 2, "signup")], (0, 1), (2, 3)), 3 * DAY, {}),
    "pat_join_tree": (FAR_APART, 4 * HOUR, {}),
    "pat_left_deep_ablation": (FAR_APART, 4 * HOUR, {"left_deep": True}),
    "freq_k2_root": (_graph([KEY, USER], [(0, 1, "click")]).frequency(0, 2), 7 * DAY, {}),
    "freq_k3_after_parent": (_graph([KEY, USER, KEY], [(0, 1, "view"), (2, 1, "click")], (0, 1)).frequency(1, 3), 30 * DAY, {}),
    "freq_two_in_pattern": (_graph([KEY, USER, KEY], [(0, 1, "view|click"), (1, 2, "purchase|error")], (0, 1)).frequency(0, 2).frequency(1, 2), 30 * DAY, {}),
    "freq_one_rewrite": (_graph([KEY, USER], [(0, 1, "view"), (1, 0, "purchase")], (0, 1)).frequency(0, 1), 7 * DAY, {}),
    "flow_seed": (_graph([KEY, KEY], [(0, 1, "")]).flow(0), HOUR, {}),
    "flow_window": (_graph([KEY, USER], [(0, 1, "")]).flow(0), HOUR // 4, {}),
    "flow_after_parent": (_graph([USER, KEY, USER], [(0, 1, "purchase"), (1, 2, "")], (0, 1)).flow(1), HOUR, {}),
    "flow_then_event": (_graph([KEY, KEY, USER], [(0, 1, ""), (1, 2, "click")], (0, 1)).flow(0), 3 * HOUR, {}),
    "freq_and_flow_combined": (_graph([KEY, KEY, USER], [(0, 1, ""), (1, 2, "view|click")], (0, 1)).flow(0).frequency(1, 2), 40 * HOUR, {}),
}
TWO_STEP = PATTERNS["pat_two_step_both_endpoints"]


def _pattern(name: str) -> Callable[[SparkSession, str], DataFrame]:
    p, window, how = PATTERNS[name]
    return lambda spark, d: api.match(graph(spark, d), p, window, **how)


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select(epoch_ms("ts").alias("start_ms"), "event_id", "value")
    return src.with_duplicates(rows.select("start_ms", (F.col("start_ms") + F.floor("value").cast("bigint") % 3).alias("end_ms"), "event_id")).select("ts_ms", "event_id")


def _times(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("event_id").cast("string"), F.element_at(F.array(*map(F.lit, ("", ".", ".1", ".12", ".1234", "x"))), (F.col("event_id") % 6 + 1).cast("int")))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", text.alias("text")).select("event_id", timestamp_ms(F.col("text")).alias("ms"))


def _flow_pairs(spark: SparkSession, d: str) -> DataFrame:
    return flow.reach(graph(spark, d), 2 * HOUR)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    p = Pattern.from_graph([KEY, USER], [(0, 1, "click")])
    r = frequency.runs(candidates.event_candidates(graph(spark, d), p, 0), 2, 7 * DAY)
    return r.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("first"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    names = ["pat_two_step_shared_object", "pat_two_step_both_endpoints", "pat_path3"]
    each = [_pattern(n)(spark, d).agg(F.count(F.lit(1)).alias("matches")).select(F.lit(n).alias("pattern"), "matches") for n in names]
    return each[0].unionByName(each[1]).unionByName(each[2])


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return src.from_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))


def _streamed(name: str) -> Callable[[SparkSession, str], DataFrame]:
    p, window, how = PATTERNS[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        where = scratch.path(spark, "stream")
        front.start(_stream(spark, d), p, window, where, **how).awaitTermination()
        return front.found(spark, where).unionByName(front.rest(spark, where, p, window, **how))

    return run


def _stream_joined(spark: SparkSession, d: str) -> DataFrame:
    p, window, _ = PATTERNS["pat_path3"]
    where = scratch.path(spark, "joined")
    out = joined.match(_stream(spark, d), p, window)
    out.writeStream.format("parquet").option("path", f"{where}/found").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/found")


def _shipped(spark: SparkSession, d: str) -> DataFrame:
    return api.match(src.from_lineitem(spark.read.parquet(f"{d}/lineitem.parquet")), *SHIPPED)


LOOP = (_graph([USER, KEY], [(0, 0, "signup"), (0, 1, "purchase")], (0, 1)), DAY)
#: The run is between the entities of the event before it, whose id it leaves out.
SKIPS = (_graph([KEY, USER], [(0, 1, "view"), (0, 1, "view|click|error")], (0, 1)).frequency(1, 2), 20 * DAY)
SKIPS_SQL = f"""WITH {SPANS_SQL},
e0 AS (SELECT subject_id AS src, object_id AS dst, ts_ms AS t, event_id AS id FROM edges WHERE event_sig = 'view'),
later AS (SELECT subject_id AS src, object_id AS dst, ts_ms AS s, event_id AS first, list({{'t': ts_ms, 'id': event_id}}) OVER (PARTITION BY subject_id, object_id ORDER BY ts_ms, seq, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM edges WHERE event_sig IN ('view', 'click')),
free AS (SELECT e0.id, e0.t, l.s, l.first, list_filter(rest, lambda x: x.id <> e0.id AND x.id <> l.first)[1] AS second FROM e0 JOIN later l ON e0.src = l.src AND e0.dst = l.dst AND l.s >= e0.t AND l.first <> e0.id)
SELECT start_ms, end_ms, events FROM (SELECT *, row_number() OVER (PARTITION BY events ORDER BY end_ms, start_ms) AS r FROM (
  SELECT t AS start_ms, second.t AS end_ms, '[' || id || ', (' || first || ', ' || second.id || ')]' AS events FROM free WHERE second IS NOT NULL AND second.t - t <= {20 * DAY})) WHERE r = 1"""
STREAMED = {"stream_default_pattern": "pat_two_step_shared_object", "stream_flow_freq": "freq_and_flow_combined"}
SHIPPED = (Pattern.from_graph(["Supplier", "Part", "Order"], [(0, 1, "supply"), (2, 1, "ship_R")], use_regex=False).before(0, 1).frequency(0, 2), 30 * DAY)
LINES_SQL = """lines AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, epoch_us(l_shipdate) // 1000 AS ts_ms FROM lineitem),
numbered AS (SELECT *, concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, ts_ms) AS line FROM lines),
edges AS (SELECT ts_ms, id AS seq, id AS event_id, event_sig, subject_id, subject_sig, l_partkey + 3000000000 AS object_id, 'Part' AS object_sig FROM (
  SELECT *, ('0x' || left(md5('ship|' || line), 15))::BIGINT AS id, 'ship_' || l_returnflag AS event_sig, l_orderkey + 2000000000 AS subject_id, 'Order' AS subject_sig FROM numbered
  UNION ALL SELECT *, ('0x' || left(md5('supply|' || line), 15))::BIGINT, 'supply', l_suppkey + 4000000000, 'Supplier' FROM numbered))"""


def _isolated(spark: SparkSession, d: str) -> DataFrame:
    """The join of chains alone, over matches of the chains that were written before."""
    p, window, _ = PATTERNS["pat_multi_chain_join"]
    parts = [scratch.save(df, "part")[0] for df in compose.chain_matches(graph(spark, d), p, window)[0]]
    return results.flat(compose.join_chains(parts, p, window), p)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    p, window, _ = TWO_STEP
    two = lambda s, d: compose.match(graph(s, d), p, window)
    mask = Pattern.from_graph([KEY, USER], [(0, 1, "view"), (0, 1, "v.*|click")])
    return {
        "edges_from_events": graph,
        "edges_from_orders": lambda s, d: src.from_orders(s.read.parquet(f"{d}/orders.parquet"), s.read.parquet(f"{d}/customer.parquet")),
        "edges_from_lineitem": lambda s, d: src.from_lineitem(s.read.parquet(f"{d}/lineitem.parquet")),
        "lineitem_freq_then_ship": _shipped,
        "stream_joined_path3": _stream_joined,
        "pat_self_loop": lambda s, d: api.match(loops(s, d), *LOOP),
        "freq_skips_used_ids": lambda s, d: api.match(spans(s, d), *SKIPS),
        "isolated_join": _isolated,
        "edges_interval_dup": _intervals,
        "timestamp_to_ms": _times,
        "sig_regex_filter": lambda s, d: graph(s, d).where(matches(F.col("event_sig"), "(?:pur|sig).*", True)),
        "sig_literal_filter": lambda s, d: graph(s, d).where(matches(F.col("event_sig"), "purchase", False)),
        "candidate_mask": lambda s, d: candidates.candidate_mask(graph(s, d), mask).select("event_id", F.array_join(F.transform("mask", lambda x: x.cast("string")), ",").alias("mask")),
        "node_signature_match": lambda s, d: candidates.node_matches(graph(s, d), Pattern.from_graph(["User::1.*", KEY], [(0, 1, "x")]), 0),
        "flow_pairs": _flow_pairs,
        "freq_runs_by_pair": _runs,
        "dedup_matches": lambda s, d: results.distinct(two(s, d).unionByName(two(s, d)), p).select("start_ms", "end_ms", "events"),
        "match_interval": lambda s, d: results.flat(two(s, d), p).select((F.col("end_ms") - F.col("start_ms")).alias("span_ms")),
        "match_count_by_pattern": _counts,
        "render_match": lambda s, d: api.match(graph(s, d), p, window, "text"),
        "match_nested": lambda s, d: api.match(graph(s, d), p, window, "nested").select("match_id", "start_ms", "end_ms", F.col("events")[0]["event_ids"][0].alias("first_event"), F.col("entities")[1]["entity_id"].alias("user")),
    } | {name: _pattern(name) for name in PATTERNS} | {name: _streamed(of) for name, of in STREAMED.items()} | samples.queries()


def oracle_sql() -> dict[str, str]:
    p, window, _ = TWO_STEP
    view = f"WITH {EDGES_SQL} "
    sec = lambda c: f"({c} // 1000)::VARCHAR || '.' || lpad(({c} % 1000)::VARCHAR, 3, '0')"
    count = lambda n: pattern_sql(*PATTERNS[n][:2], last=f"SELECT '{n}' AS pattern, count(*) AS matches FROM firsts")
    reach = pattern_sql(Pattern.from_graph([".*", ".*"], [(0, 1, "")]).flow(0), 2 * HOUR, last="SELECT src, dst, s AS depart, t AS arrive FROM e0")
    return {
        "edges_from_events": view + "SELECT * FROM edges",
        "edges_from_orders": "SELECT epoch_us(o_orderdate) // 1000 AS ts_ms, o_orderkey AS seq, o_orderkey AS event_id, 'place' AS event_sig, o_custkey + 1000000000 AS subject_id, 'Customer::' || c_mktsegment AS subject_sig, o_orderkey + 2000000000 AS object_id, 'Order::' || o_orderpriority AS object_sig FROM orders JOIN customer ON o_custkey = c_custkey",
        "edges_from_lineitem": f"WITH {LINES_SQL} SELECT * FROM edges",
        "lineitem_freq_then_ship": pattern_sql(*SHIPPED, view=LINES_SQL),
        "stream_joined_path3": pattern_sql(*PATTERNS["pat_path3"][:2]),
        "pat_self_loop": pattern_sql(*LOOP, view=LOOPS_SQL),
        "freq_skips_used_ids": SKIPS_SQL,
        "isolated_join": pattern_sql(*PATTERNS["pat_multi_chain_join"][:2]),
        "edges_interval_dup": "SELECT unnest(list_distinct([s, s + floor(value)::BIGINT % 3])) AS ts_ms, event_id FROM (SELECT epoch_us(ts) // 1000 AS s, event_id, value FROM events)",
        "timestamp_to_ms": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id * 1000 WHEN 1 THEN event_id * 1000 WHEN 2 THEN event_id * 1000 + 100 WHEN 3 THEN event_id * 1000 + 120 WHEN 4 THEN event_id * 1000 + 123 END AS ms FROM events",
        "sig_regex_filter": view + "SELECT * FROM edges WHERE regexp_full_match(event_sig, '(pur|sig).*')",
        "sig_literal_filter": view + "SELECT * FROM edges WHERE event_sig = 'purchase'",
        "candidate_mask": "SELECT event_id, CASE WHEN event_type = 'view' THEN '0,1' ELSE '1' END AS mask FROM events WHERE event_type IN ('view', 'click')",
        "node_signature_match": "SELECT DISTINCT user_id AS entity_id FROM events WHERE user_id::VARCHAR LIKE '1%'",
        "flow_pairs": reach,
        "freq_runs_by_pair": pattern_sql(Pattern.from_graph([KEY, USER], [(0, 1, "click")]).frequency(0, 2), 7 * DAY, last="SELECT src, dst, count(*) AS n, min(s) AS first FROM e0 GROUP BY src, dst"),
        "dedup_matches": pattern_sql(p, window),
        "match_interval": pattern_sql(p, window, last="SELECT end_ms - start_ms AS span_ms FROM firsts"),
        "match_count_by_pattern": " UNION ALL ".join(f"({count(n)})" for n in ("pat_two_step_shared_object", "pat_two_step_both_endpoints", "pat_path3")),
        "render_match": pattern_sql(p, window, last=f"SELECT '<' || {sec('start_ms')} || ', ' || {sec('end_ms')} || '>' || events AS line FROM firsts"),
        "match_nested": pattern_sql(p, window, last="SELECT sha256(events) AS match_id, start_ms, end_ms, regexp_extract(events, '[0-9]+')::BIGINT AS first_event, user_id AS \"user\" FROM firsts JOIN (SELECT event_id, user_id FROM events) ON event_id = regexp_extract(events, '[0-9]+')::BIGINT"),
    } | {name: pattern_sql(q, w, unique=how.get("event_uniqueness") != "chain") for name, (q, w, how) in PATTERNS.items()} | {name: pattern_sql(*PATTERNS[of][:2]) for name, of in STREAMED.items()} | samples.oracle_sql()
