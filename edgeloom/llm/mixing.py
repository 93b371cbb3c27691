"""Temperature mixing of sources to target weights.

Source token shares are raised to an exponent alpha in 0..1 and normalised: 1 keeps the shares, 0 makes them equal.
alpha is bisected to be the largest whose weights have the target entropy, and, if that repeats a source more often
than ``max_repeats``, the least that doesn't. With ``whole`` there is no target entropy, and alpha is bisected on the
repetition limit alone, the budget being what passes over each source once at least. The weights times the budget are
each source's tokens. They are realised as block permutations: documents fall into ``BLOCKS`` blocks of their source
by a hash; each pass over the source takes its blocks in an order that is permuted anew; all full passes take every
document, and the last pass takes blocks in order while the budget lasts, and of the block that doesn't fit the
documents in order that fit.

Only a row for each source comes to the driver (``MAX_SOURCES`` at most, else ValueError). Block sums are made by
combining before the shuffle, so a source of any size is no hot key; a window orders the blocks of a source. The
documents of the one block of a source that the budget cuts are dealt into ``PARTS`` ranges of the hash that orders
them: ranges are summed, and windows number documents within a range only, 1/1048576 of the source. Token counts are
written once and reread, so texts are read once.

A token is a run of other than ASCII white space. Null source is a source of its own; null or empty text has no
tokens and goes with its block. Rows with null doc_id hash as the empty string; rows that repeat are ordered and
counted as others are, though those of equal doc_id in the last block share one fate. A source without tokens is
passed over as often as max_repeats allows, once at least. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom import scratch

BLOCKS = 1024
PARTS = 1024
MAX_SOURCES = 100_000
#: Sources times blocks for which block plans are broadcast; beyond, the documents are shuffled.
BROADCAST_ROWS = 500_000


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _hash(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def weights(tokens: list[int], alpha: float) -> list[float]:
    total = sum(tokens)
    raised = [(t / total) ** alpha if t else 0.0 for t in tokens]
    return [r / sum(raised) for r in raised]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def exponent(tokens: list[int], target_entropy: float | None, max_repeats: float | None, budget: int) -> float:
    """The largest alpha of 0..1 of at least the entropy asked for, raised as far as the limit of repetition needs; bisected in 60 steps."""

    def bisect(holds) -> float:  # holds from 0 up to some alpha
        if holds(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low

    alpha = 1.0 if target_entropy is None else bisect(lambda a: entropy(weights(tokens, a)) >= target_entropy)
    if max_repeats is not None:
        over = lambda a: any(w * budget > max_repeats * t for w, t in zip(weights(tokens, a), tokens, strict=True) if t)
        if over(alpha):
            low, high = alpha, 1.0
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if over(mid) else (low, mid)
            alpha = high
    return alpha


def _placed(docs: DataFrame) -> DataFrame:
    """docs with __name of the source, __key of the document, __block."""
    name = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source")))
    key = F.when(F.col("doc_id").isNull(), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit(""))))).otherwise(F.col("doc_id").cast("string"))
    rows = docs.withColumn("__name", name).withColumn("__key", key)
    return rows.withColumn("__block", F.pmod(_hash(F.col("__name"), F.col("__key")), F.lit(BLOCKS)).cast("int"))


def _order(seed: str) -> Column:
    """Of the documents of a block."""
    return _hash(F.lit(seed), F.col("__name"), F.col("__key"))


def _blocks(rows: DataFrame, entropy_share: float | None, max_repeats: float | None, budget: float, whole: bool, seed: str) -> DataFrame:
    """__name, __block, weight, passes, rank, fits, and of the cut block __last: the (hash, key) up to which documents fit, for rows(__name, __key, __block, n_tokens)."""
    spark = rows.sparkSession
    blocks = rows.groupBy("__name", "__block").agg(F.sum("n_tokens").alias("t"))
    sources = sorted((r["__name"], r["t"]) for r in blocks.groupBy("__name").agg(F.sum("t").alias("t")).limit(MAX_SOURCES + 1).collect())
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = [t for _, t in sources]
    plan = []
    if sum(tokens):
        h = entropy(weights(tokens, 1.0))
        if whole:
            alpha, total = _whole(tokens, max_repeats or 1.0)
        else:
            total = budget * sum(tokens)
            target = None if entropy_share is None else h + entropy_share * (math.log(sum(1 for t in tokens if t)) - h)
            alpha = exponent(tokens, target, max_repeats, total)
        w = weights(tokens, alpha)
        plan = [(n, x, math.floor(x * total / t + 1e-9) if t else 1, float(max(0.0, x * total - t * math.floor(x * total / t + 1e-9))) if t else 0.0) for (n, t), x in zip(sources, w, strict=True)]
    else:
        plan = [(n, 1 / len(sources), 1, 0.0) for n, _ in sources]
    plan = spark.createDataFrame(plan, "__name string, weight double, passes long, rest double")
    order = Window.partitionBy("__name").orderBy("key", "__block")
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("passes").cast("string"), F.col("__name"), F.col("__block").cast("string")))
    blocks = blocks.join(F.broadcast(plan), "__name").withColumn("key", key)
    blocks = blocks.select("__name", "__block", "weight", "passes", "rest", F.row_number().over(order).cast("long").alias("rank"), F.sum("t").over(order).alias("upto"), "t")
    blocks = blocks.withColumn("fits", F.col("upto") <= F.col("rest")).withColumn("cut", ~F.col("fits") & (F.col("upto") - F.col("t") < F.col("rest")))
    blocks, _ = scratch.save(blocks, "blocks")
    # The documents of the block that the budget cuts: sums over those of equal keys at once, so that rows that repeat share a fate.
    room = F.broadcast(blocks.where("cut").select("__name", "__block", (F.col("rest") - F.col("upto") + F.col("t")).alias("room")))  # a row for each source at most
    cut = rows.join(room, ["__name", "__block"]).withColumn("k", _order(seed))
    cut = cut.withColumn("part", F.floor(F.col("k") / ((1 << 32) // PARTS)))
    ahead = F.sum("part_t").over(Window.partitionBy("__name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = cut.groupBy("__name", "part").agg(F.sum("n_tokens").alias("part_t"), F.first("room").alias("room")).select("__name", "part", F.coalesce(ahead, F.lit(0)).alias("ahead"), "part_t", "room")
    # Parts that fit whole, and the one that doesn't, of which each source has one at most.
    parts = parts.where("ahead <= room").withColumn("whole", F.col("ahead") + F.col("part_t") <= F.col("room"))
    parts, _ = scratch.save(parts, "parts")
    inner = cut.drop("room").join(F.broadcast(parts.where("not whole")), ["__name", "part"])
    inside = F.sum("n_tokens").over(Window.partitionBy("__name").orderBy("k", "__key"))
    some = inner.withColumn("fit", F.col("ahead") + inside <= F.col("room")).where("fit").select("__name", F.struct("k", "__key").alias("last"))
    full = parts.where("whole").select("__name", F.struct(((F.col("part") + 1) * ((1 << 32) // PARTS) - 1).alias("k"), F.lit(chr(0x10FFFF)).alias("__key")).alias("last"))
    last = some.unionByName(full).groupBy("__name").agg(F.max("last").alias("__last"))
    return blocks.join(F.broadcast(last), "__name", "left").select("__name", "__block", "weight", "passes", "rank", "fits", F.when(F.col("cut"), F.col("__last")).alias("__last"))


def _taken(rows: DataFrame, blocks: DataFrame, seed: str) -> DataFrame:
    """rows with weight, copies and rank."""
    blocks = F.broadcast(blocks) if blocks.select("__name").distinct().count() * BLOCKS <= BROADCAST_ROWS else blocks
    more = F.col("fits") | F.coalesce(F.struct(_order(seed).alias("k"), F.col("__key")) <= F.col("__last"), F.lit(False))
    return rows.join(blocks, ["__name", "__block"]).withColumn("copies", F.col("passes") + more.cast("long"))


def mix(docs: DataFrame, entropy_share: float | None = 0.5, max_repeats: float | None = 4.0, budget: float = 1.0, whole: bool = False, seed: str = "0") -> DataFrame:
    """doc_id, source, n_tokens, weight, copies, rank for each row of docs(doc_id, text, source).

    The target entropy lies by entropy_share between that of the shares and that of equal weights. budget: tokens to
    be had, as a multiple of those there are; with whole, it is raised until each source is passed over once at
    least, and max_repeats counts from there. copies: how often the document is to be taken; rank: of its block in the
    last pass.
    """
    rows = _placed(docs.select("doc_id", "source", "text")).select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), "__name", "__key", "__block")
    rows, _ = scratch.save(rows, "counted")
    out = _taken(rows, _blocks(rows, entropy_share, max_repeats, budget, whole, seed), seed)
    return out.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "copies", "rank")


def _whole(tokens: list[int], max_repeats: float) -> tuple[float, float]:
    """The least alpha, and its budget, with every source passed over once at least and none more than max_repeats times; bisected in 60 steps."""
    most = lambda a: max(t / x for t, x in zip(tokens, weights(tokens, a), strict=True) if t)
    over = lambda a: any(x * most(a) > max_repeats * t for t, x in zip(tokens, weights(tokens, a), strict=True) if t)
    low, high = 0.0, 1.0
    if not over(low):
        high = low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) else (low, mid)
    return high, most(high)


def mixed(docs: DataFrame, entropy_share: float | None = 0.5, max_repeats: float | None = 4.0, budget: float = 1.0, whole: bool = False, seed: str = "0") -> DataFrame:
    """docs as mix() has it: each row as often as it is to be taken."""
    rows, at = scratch.save(_placed(docs.select("doc_id", "source", "text")).select("__name", "__key", "__block", n_tokens(F.col("text")).alias("n_tokens")), "counted")
    blocks, _ = scratch.save(_blocks(rows, entropy_share, max_repeats, budget, whole, seed).drop("weight", "rank"), "decided")
    scratch.drop(docs.sparkSession, at)
    out = _taken(_placed(docs.select(F.struct("*").alias("__row"), "doc_id", "source", "text")), blocks, seed)
    return out.withColumn("__i", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("__row.*")


SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS name,
  coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) AS key FROM documents),
r AS (SELECT *, (('0x' || substr(md5(name || '|' || key), 1, 8))::BIGINT % 1024)::INT AS block FROM d),
b AS (SELECT name, block, sum(n_tokens)::BIGINT AS t FROM r GROUP BY ALL),
s AS (SELECT name, sum(t)::DOUBLE AS t FROM b GROUP BY name),
tot AS (SELECT sum(t) AS total, count(*) FILTER (t > 0) AS n FROM s),
p AS (SELECT name, t, t / total AS p FROM s, tot WHERE t > 0),
goal AS (SELECT h + 0.5 * (ln(n) - h) AS goal FROM (SELECT -sum(p * ln(p)) AS h FROM p), tot),
bis(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL SELECT i + 1, CASE WHEN e >= goal THEN (lo + hi) / 2 ELSE lo END, CASE WHEN e >= goal THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT bis.*, (SELECT ln(sum(p ** ((lo + hi) / 2))) - sum(p ** ((lo + hi) / 2) * ln(p ** ((lo + hi) / 2))) / sum(p ** ((lo + hi) / 2)) FROM p) AS e FROM bis WHERE i < 60), goal),
a AS (SELECT CASE WHEN (SELECT -sum(p * ln(p)) FROM p) >= goal THEN 1.0::DOUBLE ELSE lo END AS alpha FROM bis, goal WHERE i = 60),
bis2(i, lo, hi) AS (
  SELECT 0, alpha, 1.0::DOUBLE FROM a
  UNION ALL SELECT i + 1, CASE WHEN o THEN (lo + hi) / 2 ELSE lo END, CASE WHEN o THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT bis2.*, (SELECT bool_or(x * total > 4 * t) FROM (SELECT t, p ** ((lo + hi) / 2) / (SELECT sum(p ** ((lo + hi) / 2)) FROM p) AS x FROM p), tot) AS o FROM bis2 WHERE i < 60)),
fin AS (SELECT CASE WHEN (SELECT bool_or(x * total > 4 * t) FROM (SELECT t, p ** alpha / (SELECT sum(p ** alpha) FROM p) AS x FROM p), tot) THEN hi ELSE alpha END AS alpha FROM a, bis2 WHERE i = 60),
w AS (SELECT s.name, s.t, coalesce(p.p ** alpha / (SELECT sum(p ** alpha) FROM p), 0) AS weight, total FROM s LEFT JOIN p USING (name), fin, tot),
plan AS (SELECT name, weight, CASE WHEN t > 0 THEN floor(weight * total / t + 1e-9)::BIGINT ELSE 1 END AS passes,
  CASE WHEN t > 0 THEN greatest(0, weight * total - t * floor(weight * total / t + 1e-9)) ELSE 0 END AS rest FROM w),
bb AS (SELECT b.*, weight, passes, rest, row_number() OVER o AS rank, sum(t) OVER o AS upto FROM (SELECT b.*, weight, passes, rest, md5('0|' || passes || '|' || name || '|' || block) AS key FROM b JOIN plan USING (name)) b
  WINDOW o AS (PARTITION BY name ORDER BY key, block)),
pl AS (SELECT r.doc_id, r.source, r.n_tokens, r.name, r.key AS k, weight, passes, rest, rank, upto, t, upto <= rest AS fits, upto > rest AND upto - t < rest AS cut FROM r JOIN bb USING (name, block)),
c AS (SELECT *, upto - t + sum(n_tokens) OVER (PARTITION BY name ORDER BY ('0x' || substr(md5('0|' || name || '|' || k), 1, 8))::BIGINT, k) <= rest AS more FROM pl WHERE cut)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, (passes + fits::BIGINT) AS copies, rank FROM pl WHERE NOT cut
UNION ALL SELECT doc_id, source, n_tokens, round(weight, 9), (passes + more::BIGINT), rank FROM c
"""
