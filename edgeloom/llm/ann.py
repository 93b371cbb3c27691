"""Approximate nearest neighbours with additive quantisation.

A vector, at length 1, is the sum of ``BOOKS`` codewords of full dimension. Each codebook is fitted by k-means to what
the ones before leave; encoding is a beam search that keeps the ``BEAM`` best sums at each step. A code is BOOKS bytes
and the length of the sum. For a query, its inner products with all codewords make lookup tables; the sum of the looked-up
values over the stored length scores a row. Over all that a query has looked at, the ``RERANK`` best scores are then
taken to the original vectors and scored as ``list_cosine_similarity`` of DuckDB does, in double precision.

A query doesn't look at all codes: vectors are dealt into lists by the nearest of about as many centres as the square
root of their number (``LISTS`` at most), and a query looks through its nearest lists: as many as hold the neighbours of
``SURE`` of the sample's vectors within the sample, and on until these lists have ``LOOKED`` vectors. Vectors that gather
about centres need few lists; vectors without any order, most. Lists are packed into shards of about ``PART`` vectors,
or cut into several, and what asks a shard into groups of about ``ASKING`` queries; a task compares one such shard and
group at a time, so its memory is bounded whatever the size of a list. The best of the shards are merged in two steps.
None of these numbers depends on how many tasks there are, so neither do results.

Equal vectors are one row of the index with its ``k`` + 1 smallest ids (more can't be among the nearest of any query
after itself), so thousands of copies cost no more than one, for queries as well.

Centres and codebooks are fitted on at most ``SAMPLE`` distinct vectors (smallest hashes); all rows are indexed. Vectors that are
null, zero, or hold null or non-finite components take no part, nor do rows with null vec_id; of rows that repeat a
vec_id with another vector, each is a candidate; a candidate with the query's own id is not one. Vectors must have one length
among them: the most frequent one, the larger on a tie, and others take no part. Vectors whose products leave the range
of doubles have no order. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom import scratch
from edgeloom.llm.rows import bound_batches, mapped

BOOKS, WORDS, BEAM = 24, 256, 3
SAMPLE, ROUNDS = 8192, 4
LISTS, LOOKED, SURE = 2048, 1024, 0.985
RERANK = 192
PART, ASKING, MERGED = 4096, 512, 32


def _nearest_words(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x @ words.T - (words**2).sum(1) / 2).argmax(1)


def fit(x: np.ndarray) -> np.ndarray:
    """Codebooks (BOOKS, words, dimension) for unit vectors x."""
    rnd, rest, books = np.random.RandomState(8), x.astype(np.float32), []
    for _ in range(BOOKS):
        words = rest[rnd.permutation(len(rest))[: min(WORDS, len(rest))]].copy()
        for _ in range(ROUNDS):
            own = _nearest_words(rest, words)
            n = np.bincount(own, minlength=len(words))
            order = np.argsort(own, kind="stable")
            some = np.flatnonzero(n)
            sums = np.add.reduceat(rest[order], np.cumsum(np.append(0, n[some][:-1])), axis=0)
            words[some] = sums / n[some][:, None]
        rest = rest - words[_nearest_words(rest, words)]
        books.append(words)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, BOOKS) and the lengths of the sums, by beam search."""
    n = len(x)
    rest, codes = x.astype(np.float32)[:, None], np.zeros((n, 1, 0), np.uint8)
    for words in books:
        gain = (words**2).sum(1) - 2 * rest @ words.T + (rest**2).sum(2)[..., None]  # squared length of what each choice leaves
        flat = gain.reshape(n, -1)
        keep = min(BEAM, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        came, word = best // len(words), best % len(words)
        at = np.arange(n)[:, None]
        codes = np.concatenate([codes[at, came], word[..., None].astype(np.uint8)], 2)
        rest = rest[at, came] - words[word]
    low = (rest**2).sum(2).argmin(1)
    codes = codes[np.arange(n), low]
    total = sum(books[m][codes[:, m]] for m in range(len(books)))
    return codes, np.maximum(np.sqrt((total**2).sum(1)), 1e-6)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of a and b in double precision, with sums in the order of components."""
    dot, x, y = (np.zeros(len(a)) for _ in range(3))
    for i in range(a.shape[1]):
        p, q = a[:, i].astype(np.float64), b[:, i].astype(np.float64)
        dot, x, y = dot + p * q, x + p * p, y + q * q
    return np.clip(dot / np.sqrt(x * y), -1, 1)


def centres(x: np.ndarray, many: int) -> np.ndarray:
    """So many unit vectors that the unit vectors x gather about."""
    out = x[np.random.RandomState(9).permutation(len(x))[: min(many, len(x))]].astype(np.float32)
    for _ in range(ROUNDS):
        own = (x @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        length = np.sqrt((sums**2).sum(1))
        out = np.where(length[:, None] > 1e-6, sums / np.maximum(length, 1e-6)[:, None], out)
    return out


def lists_needed(x: np.ndarray, mids: np.ndarray, k: int) -> int:
    """How many of the lists nearest to it hold the k nearest of a vector of x, for ``SURE`` of some of them."""
    some = np.random.RandomState(10).permutation(len(x))[:256]
    own, near = (x @ mids.T).argmax(1), (x[some] @ -mids.T).argsort(1).argsort(1)  # list of each vector; places of lists
    score = x[some] @ x.T
    score[np.arange(len(some)), some] = -np.inf
    best = np.argpartition(-score, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else np.zeros((1, 1), int)
    return int(np.quantile(np.take_along_axis(near, own[best], 1), SURE, method="higher")) + 1


def _rows(vectors: pa.Array) -> np.ndarray:
    """A matrix of a slice's vectors of one length."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]  # so that squares stay finite
    return x / np.sqrt((x**2).sum(1))[:, None]


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v of the rows that take part."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == (size["d"] if size else 0))


FOUND = pa.schema([("q", pa.int64()), ("at", pa.list_(pa.int64())), ("about", pa.list_(pa.float32()))])


def _scored(books: np.ndarray, top: int):
    """For a shard and a group of queries: the best codes of each query, in the lists that it looks through."""

    def run(asks: pa.Table, part: pa.Table) -> pa.Table:
        if not asks.num_rows or not part.num_rows:
            return FOUND.empty_table()
        asks, part = asks.combine_chunks(), part.combine_chunks()
        unit = _unit(_rows(asks["v"].chunk(0))).astype(np.float32)
        codes = np.frombuffer(b"".join(part["code"].to_pylist()), np.uint8).reshape(part.num_rows, -1)
        length, ids, keep = part["length"].to_numpy(), part["at"].to_numpy(), min(top, part.num_rows)
        lists, own = np.unique(part["list"].to_numpy(), return_inverse=True)
        looked = np.stack([np.isin(lists, np.asarray(x)) for x in asks["lists"].to_pylist()])
        at, about = [], []
        for a in range(0, len(unit), 64):
            tables = np.einsum("qd,mwd->mqw", unit[a : a + 64], books)
            scores = sum(t[:, codes[:, m]] for m, t in enumerate(tables)) / length
            scores[~looked[a : a + 64][:, own]] = -np.inf
            best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
            for i, s in zip(best, np.take_along_axis(scores, best, 1), strict=True):
                at.append(ids[i[np.isfinite(s)]])
                about.append(s[np.isfinite(s)].astype(np.float32))
        return pa.table([asks["q"], pa.array(at, FOUND.field(1).type), pa.array(about, FOUND.field(2).type)], schema=FOUND)

    return run


def _merged(top: int):
    """The best of several rows of a query, as one."""

    def run(rows: pa.Table) -> pa.Table:
        at, about = (rows[c].combine_chunks().flatten().to_numpy() for c in ("at", "about"))
        best = np.lexsort((at, -about))[:top]
        return pa.table([rows["q"][:1], pa.array([at[best]], FOUND.field(1).type), pa.array([about[best]], FOUND.field(2).type)], schema=FOUND)

    return run


def _exact(q: pa.Array, at: pa.Array, a: pa.Array, b: pa.Array) -> list:
    return [q, at, cosine(_rows(a), _rows(b))]


def nearest(vectors: DataFrame, k: int = 5, each: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row of vectors(vec_id, embedding) whose vec_id is divisible by ``each``."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = _usable(vectors)
    # A few smallest ids of each vector: within parts of the ids first, so that no task gets all copies of a vector.
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    few = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, k + 1)
    ranked = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v", part).orderBy("vec_id"))).where(F.col("r") <= k + 1)
    index = ranked.groupBy("v").agg(few(F.collect_list("vec_id")).alias("ids")).withColumn("at", F.monotonically_increasing_id())
    index, _ = scratch.save(index, "vectors")
    asked, _ = scratch.save(rows.where(F.pmod("vec_id", F.lit(each)) == 0).select("v", "vec_id").distinct(), "asked")
    wanted, _ = scratch.save(asked.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    total = index.count()
    sample = [r["v"] for r in index.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = _unit(np.array(sample)).astype(np.float32)
    del sample
    books, mids = fit(x), centres(x, max(1, min(LISTS, len(x) // 8, math.isqrt(total))))

    def coded(at: pa.Array, v: pa.Array) -> list:
        unit = _unit(_rows(v))
        codes, length = encode(unit, books)
        return [at, (unit @ mids.T).argmax(1).astype(np.int32), [c.tobytes() for c in codes], length.astype(np.float64)]

    many = max(1, 2 * spark.sparkContext.defaultParallelism)
    fields = {"at": pa.int64(), "list": pa.int32(), "code": pa.binary(), "length": pa.float64()}
    codes, _ = scratch.save(mapped(index.select("at", "v").repartition(many), fields, lambda: coded, 512), "codes")
    sizes = {r["list"]: r["n"] for r in codes.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = np.array([sizes.get(i, 0) for i in range(len(mids))])
    probes = lists_needed(x, mids, k)
    # Shards: lists next to each other up to PART vectors together; a larger one is cut into its own.
    parts, shard_of, full = np.maximum(1, -(-held // PART)), np.zeros(len(mids), np.int64), 0
    for i, n in enumerate(held):
        new = i == 0 or full + n > PART or parts[i] > 1
        shard_of[i] = 0 if i == 0 else shard_of[i - 1] + new
        full = n if new else full + n

    def probed(q: pa.Array, v: pa.Array) -> list:
        order = (_unit(_rows(v)) @ -mids.T).argsort(1, kind="stable")
        before = np.cumsum(held[order], 1) - held[order]
        look = ((np.arange(len(mids)) < probes) | (before < LOOKED)) & (held[order] > 0)
        out = [[], [], []]
        for one, o, w in zip(q.to_pylist(), order, look, strict=True):
            for s in np.unique(shard_of[o[w]]):
                out[0].append(one), out[1].append(int(s)), out[2].append(o[w][shard_of[o[w]] == s].astype(np.int32))
        return out

    asks = mapped(wanted.select("q", "v"), {"q": pa.int64(), "shard": pa.int64(), "lists": pa.list_(pa.int32())}, lambda: probed)
    asks, _ = scratch.save(asks, "asks")
    crowd = {r["shard"]: -(-r["n"] // ASKING) for r in asks.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    how = spark.createDataFrame([(int(shard_of[i]), i, int(parts[i]), crowd[shard_of[i]]) for i in range(len(mids)) if shard_of[i] in crowd], "shard long, list int, parts long, groups long")  # LISTS rows at most
    each = how.groupBy("shard").agg(F.max("parts").alias("parts"), F.max("groups").alias("groups"))
    asks = asks.join(F.broadcast(each), "shard").join(wanted, "q")
    asks = asks.select("q", "v", "lists", "shard", F.pmod(F.xxhash64("q"), "groups").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"))
    sides = codes.join(F.broadcast(how), "list")
    sides = sides.select("at", "list", "code", "length", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"), F.pmod(F.xxhash64("at"), "parts").alias("p"))
    key, found_as = ["shard", "g", "p"], "q long, at array<long>, about array<float>"
    found = asks.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(_scored(books, RERANK), found_as)
    found, _ = scratch.save(found.withColumn("m", F.pmod(F.xxhash64("at"), F.lit(MERGED))), "found")
    # Of all that a query has looked at.
    some = found.groupBy("q", "m").applyInArrow(_merged(RERANK), found_as)
    best = some.groupBy("q").applyInArrow(_merged(RERANK), found_as).select("q", F.explode("at").alias("at"))
    pairs = best.join(wanted, "q").join(index.select("at", F.col("v").alias("w")), "at").select("q", "at", "v", "w")
    scored = mapped(pairs, {"q": pa.int64(), "at": pa.int64(), "score": pa.float64()}, lambda: _exact, 1024)
    hits = scored.join(index.select("at", "ids"), "at").select("q", "score", F.explode("ids").alias("vec_id")).distinct()
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    hits = hits.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("hits"))
    hits = wanted.join(hits, "q").select("v", "hits")
    mine = asked.withColumnRenamed("vec_id", "query_id").join(hits, "v")
    mine = mine.select("query_id", F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k).alias("hits"))
    return mine.select("query_id", F.posexplode("hits").alias("p", "hit")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


SQL = r"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
