"""Exact dedup in DataFrame functions only, with skew-safe combining.

Three combining steps, each of which groups by the digest and by the full content: Spark's map-side aggregation
dedups locally; the groups of (digest, salt, content) merge what the tasks found, so that no task gets all copies of
a text; the salt winners, at most ``salts`` rows for a text, are combined globally. A digest that stands for one
content only (the combined rows tell) then serves as the key that takes the outcome back to the documents, so the
texts aren't moved again; there the rows of a digest that very many rows have are dealt over tasks by salts. Digests
that stand for several contents go through a join on digest and content.

Null text counts as empty, and empty texts are equal. Only runs of white space are made equal, not white space at
the ends. Rows with a null doc_id take part; they never win against a row that has one, and a group without any gets a
null keep_id and keeps its rows. Rows that repeat the smallest doc_id of their group are all kept. one_of_each, which
the pipeline uses, decides by row instead and leaves one of them. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom import scratch
from edgeloom.llm.rows import by_row, join_hot

#: A run of white space that isn't one space already.
LONG_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
SALTS = 16


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), LONG_SPACE, " ")


def _hashed(docs: DataFrame, digest_bits: int = 256) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("doc_id"), normalised(F.col("text")).alias("content"))
    digest = F.sha2("content", 256)
    return rows.withColumn("digest", digest if digest_bits == 256 else F.substring(digest, 1, digest_bits // 4))


def contents(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, content, keep_id, group_size), a row for each content."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts))
    salted = rows.groupBy("digest", salt.alias("salt"), "content").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "content").agg(F.min("low").alias("keep_id"), F.sum("n").alias("group_size"))


def winners(docs: DataFrame, salts: int = SALTS, digest_bits: int = 256) -> tuple[DataFrame, DataFrame | None]:
    """(digest, keep_id, group_size) of the digests with one content; and with their content those of the others, if any.

    digest_bits is for tests: few bits make digests collide.
    """
    rows = _hashed(docs, digest_bits)
    each = contents(rows, salts).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_contents"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    each, _ = scratch.save(each, "digests")
    clash = each.where("n_contents > 1").select("digest")
    more = contents(rows.join(clash, "digest", "left_semi"), salts) if clash.take(1) else None
    return each.where("n_contents = 1").drop("n_contents"), more


def exact_dedup(docs: DataFrame, salts: int = SALTS, digest_bits: int = 256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text) for each row of docs(doc_id, text)."""
    one, more = winners(docs, salts, digest_bits)
    rows = _hashed(docs, digest_bits)
    back = lambda rows: join_hot(rows, one.withColumn("n", F.col("group_size")), "digest", "n", F.monotonically_increasing_id())
    out = back(rows.drop("content"))
    if digest_bits != 256:
        out = back(rows).withColumn("digest", F.sha2("content", 256)).drop("content")
    if more is not None:
        out = out.unionByName(rows.join(more, ["digest", "content"]).withColumn("digest", F.sha2("content", 256)).drop("content"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def without_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns. Rows with null doc_id stay: nothing names them."""
    one, more = winners(docs, salts)
    ids = one.select(F.col("keep_id").alias("__keep_id"))
    if more is not None:
        ids = ids.unionByName(more.select(F.col("keep_id").alias("__keep_id")))
    named = docs.join(ids.where("__keep_id is not null"), docs["doc_id"] == F.col("__keep_id"), "left_semi")
    return named.unionByName(docs.where("doc_id is null"))


def one_of_each(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row of docs for each text, with all its columns: of the smallest doc_id; rows with null doc_id and rows that repeat one are copies, too."""
    return by_row(docs, lambda rows: without_copies(rows, salts))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(content) AS text_sha256
FROM t WINDOW w AS (PARTITION BY content)
"""
