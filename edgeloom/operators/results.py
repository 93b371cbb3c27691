"""Matches as results: distinct, nested, as text, counted, and compared with expected answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.plans.pattern import Pattern


def _event_text(p: Pattern, i: int) -> Column:
    if p.events[i].kind == "default":
        return F.col(f"ids_{i}")[0].cast("string")
    ids = F.col(f"ids_{i}").cast("array<string>")
    if p.events[i].kind == "flow":
        return F.concat(F.lit("("), F.col(f"src_{i}").cast("string"), F.lit(" -> "), F.col(f"dst_{i}").cast("string"), F.lit(")"))
    if p.events[i].kind == "frequency" and p.events[i].frequency > 1:
        return F.concat(F.lit("("), F.array_join(ids, ", "), F.lit(")"))
    return F.array_join(ids, ", ")


def events_text(p: Pattern) -> Column:
    """``[e0, (e1a, e1b), (src -> dst)]``"""
    return F.concat(F.lit("["), F.concat_ws(", ", *[_event_text(p, i) for i in range(len(p.events))]), F.lit("]"))


def distinct(matches: DataFrame, p: Pattern, dedup_key: str = "all") -> DataFrame:
    """start_ms, end_ms, events and the columns of matches: of matches of equal events the one that ends, then starts, first.

    dedup_key: ``all``; or ``ids``, by which matches that differ in their flows only are equal.
    """
    if dedup_key not in ("all", "ids"):
        raise ValueError(dedup_key)
    keyed = matches.select("*", events_text(p).alias("events"))
    key = ["events"] if dedup_key == "all" else [f"ids_{i}" for i in range(len(p.events))]
    first = Window.partitionBy(*key).orderBy("end_ms", "start_ms", *[f"s_{i}" for i in range(len(p.events))])
    return keyed.select("*", F.row_number().over(first).alias("__r")).where("__r = 1").drop("__r")


def flat(matches: DataFrame, p: Pattern, dedup_key: str = "all") -> DataFrame:
    """start_ms, end_ms, events."""
    return distinct(matches, p, dedup_key).select("start_ms", "end_ms", "events")


def nested(matches: DataFrame, p: Pattern, dedup_key: str = "all") -> DataFrame:
    """match_id, start_ms, end_ms, events (pattern_event, kind, event_ids, src, dst, start_ms, end_ms), entities (pattern_entity, entity_id)."""
    events = F.array(*[
        F.struct(F.lit(i).alias("pattern_event"), F.lit(e.kind).alias("kind"), F.col(f"ids_{i}").alias("event_ids"), F.col(f"src_{i}").alias("src"), F.col(f"dst_{i}").alias("dst"), F.col(f"s_{i}").alias("start_ms"), F.col(f"t_{i}").alias("end_ms"))
        for i, e in enumerate(p.events)
    ])
    used = sorted({v for e in p.events for v in (e.subject, e.object)})
    entities = F.array(*[F.struct(F.lit(v).alias("pattern_entity"), F.col(f"v_{v}").alias("entity_id")) for v in used])
    rows = distinct(matches, p, dedup_key)
    return rows.select(F.sha2(rows["events"], 256).alias("match_id"), "start_ms", "end_ms", events.alias("events"), entities.alias("entities"))


def _seconds(ms: Column) -> Column:
    return F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def rendered(matches: DataFrame, p: Pattern, dedup_key: str = "all") -> DataFrame:
    """line: ``<t0, t1>[...]`` with exact milliseconds."""
    return flat(matches, p, dedup_key).select(F.concat(F.lit("<"), _seconds(F.col("start_ms")), F.lit(", "), _seconds(F.col("end_ms")), F.lit(">"), F.col("events")).alias("line"))


def parse_answers(lines: DataFrame) -> DataFrame:
    """events of lines(value) like rendered ones; others are left out."""
    text = F.regexp_extract("value", r"^<[^>]*>(\[.*\])\s*$", 1)
    return lines.select(text.alias("events")).where("events <> ''")


def diff(found: DataFrame, answers: DataFrame) -> DataFrame:
    """events, problem: ``false positive``, ``missing`` or ``duplicate``, of two tables of events."""
    extra = found.select("events").distinct().join(answers, "events", "left_anti").withColumn("problem", F.lit("false positive"))
    lost = answers.select("events").distinct().join(found, "events", "left_anti").withColumn("problem", F.lit("missing"))
    twice = found.groupBy("events").count().where("count > 1").select("events", F.lit("duplicate").alias("problem"))
    return extra.unionByName(lost).unionByName(twice)


def repro(edges: DataFrame, match: DataFrame) -> DataFrame:
    """The edges whose ids are in match(ids), with ids renumbered densely from 0. For the graph of one match."""
    ids = match.select(F.explode("ids").alias("event_id")).distinct()
    rows = edges.join(ids, "event_id", "left_semi")
    number = lambda c: rows.select(F.col(c).alias("k")).distinct()
    entities = number("subject_id").unionByName(number("object_id")).distinct().select("k", (F.dense_rank().over(Window.orderBy("k")) - 1).cast("bigint").alias("n"))
    events = number("event_id").select("k", (F.dense_rank().over(Window.orderBy("k")) - 1).cast("bigint").alias("n"))
    for column, table in (("event_id", events), ("subject_id", entities), ("object_id", entities)):
        t = table.select(F.col("k").alias(column), F.col("n").alias(f"new_{column}"))
        rows = rows.join(t, column)
    return rows.select("ts_ms", "seq", *[F.col(f"new_{c}").alias(c) if c.endswith("_id") else c for c in ("event_id", "event_sig", "subject_id", "subject_sig", "object_id", "object_sig")])
