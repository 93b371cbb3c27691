"""Rows that can be an event of a pattern by their signatures alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom import scratch
from edgeloom.functions.signatures import is_plain, matches
from edgeloom.plans.pattern import Pattern


def condition(p: Pattern, i: int) -> Column:
    e = p.events[i]
    c = matches(F.col("subject_sig"), p.entities[e.subject], p.use_regex) & matches(F.col("object_sig"), p.entities[e.object], p.use_regex)
    if e.kind != "flow":
        c = c & matches(F.col("event_sig"), e.signature, p.use_regex)
    return c & (F.col("subject_id") == F.col("object_id")) if e.subject == e.object else c & (F.col("subject_id") != F.col("object_id"))


def event_candidates(edges: DataFrame, p: Pattern, i: int) -> DataFrame:
    """ts_ms, seq, event_id, src, dst of the rows that event i can be. Signatures are dropped: joins carry ids and times only."""
    return edges.where(condition(p, i)).select("ts_ms", "seq", "event_id", F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))


def can_be(i: int) -> Column:
    """Of narrow rows: event i."""
    return F.col("mask")[i // 63].bitwiseAND(F.lit(1 << i % 63)) != 0


def narrow(edges: DataFrame, p: Pattern) -> DataFrame:
    """ts_ms, seq, event_id, src, dst, mask of the rows that some event but a flow can be, in one pass. mask: a bit for each event, 63 in a number.

    Where all events have plain signatures, the filter on them alone goes first, which Parquet can be asked for.
    """
    bare = [i for i, e in enumerate(p.events) if e.kind != "flow"]
    if bare and all(not p.use_regex or is_plain(p.events[i].signature) for i in bare):
        edges = edges.where(F.col("event_sig").isin(*sorted({p.events[i].signature for i in bare})))
    bits = []
    for at in range(0, len(p.events), 63):
        own = [F.when(condition(p, i), F.lit(1 << i - at)).otherwise(F.lit(0)) for i in bare if at <= i < at + 63]
        bits.append(reduce(lambda a, b: a.bitwiseOR(b), own, F.lit(0).cast("bigint")))
    rows = edges.select("ts_ms", "seq", "event_id", F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.array(*bits).alias("mask"))
    return rows.where(F.exists("mask", lambda x: x != 0))


def of_event(rows: DataFrame, i: int) -> DataFrame:
    """ts_ms, seq, event_id, src, dst of the narrow rows that event i can be."""
    return rows.where(can_be(i)).drop("mask")


def candidate_mask(edges: DataFrame, p: Pattern) -> DataFrame:
    """The rows that some event but a flow can be, with mask: the indices of those events."""
    mask = F.array_compact(F.array(*[F.when(condition(p, i), F.lit(i)) for i, e in enumerate(p.events) if e.kind != "flow"]))
    return edges.withColumn("mask", mask).where(F.size("mask") > 0)


def nodes(edges: DataFrame) -> DataFrame:
    """(entity_id, sig), once for each pair, of one pass."""
    end = lambda k: F.struct(F.col(f"{k}_id").alias("entity_id"), F.col(f"{k}_sig").alias("sig"))
    return edges.select(F.explode(F.array(end("subject"), end("object"))).alias("n")).select("n.*").distinct()


def node_matches(edges: DataFrame, p: Pattern, entity: int) -> DataFrame:
    """entity_id of the nodes that have a signature of this entity on some row."""
    return nodes(edges).where(matches(F.col("sig"), p.entities[entity], p.use_regex)).select("entity_id").distinct()


def flow_ends(edges: DataFrame, p: Pattern, i: int, first_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The nodes that flow i can start from, and those it can go to, of one pass. first_only: only the signature counts that a node is first seen with."""
    e = p.events[i]
    if first_only:
        end = lambda k: F.struct(F.col(f"{k}_id").alias("entity_id"), F.struct("ts_ms", "seq", F.lit(k == "object").alias("side"), F.col(f"{k}_sig").alias("sig")).alias("seen"))
        named = edges.select(F.explode(F.array(end("subject"), end("object"))).alias("n")).groupBy("n.entity_id").agg(F.min("n.seen").alias("seen")).select("entity_id", "seen.sig")
    else:
        named = nodes(edges)
    found = named.groupBy("entity_id").agg(*[F.max(matches(F.col("sig"), p.entities[v], p.use_regex)).alias(n) for n, v in (("leaves", e.subject), ("arrives", e.object))])
    found, _ = scratch.save(found.where("leaves or arrives"), "nodes")
    return found.where("leaves").select("entity_id"), found.where("arrives").select("entity_id")
