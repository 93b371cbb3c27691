"""MinHash near-dedup with tensored banding.

Two collections of ``m`` short sketches are made for each distinct shingle set, each sketch from ``k`` minima. A table
key joins one sketch of the first collection with one of the second, so ``m * m`` tables of ``2 * k`` minima need
``2 * m * k`` minima only. Two sets of similarity s meet unless one of the collections has no equal sketch, so they
are missed with probability of about ``2 * (1 - s**k)**m``: 4e-7 at 0.85 and 1e-5 at 0.8 with the defaults.

1. Texts give (doc_id, set size, 128-bit key of the set, sketches). Equal sets become one class at once, so thousands
   of copies cost one row.
2. Sketches that no other class has are put aside before keys are formed; that loses no pair.
3. In each table cell every class is compared with the smallest one. Cells whose members are connected after that need
   no more. The members of the others are compared across components in blocks of bounded size, which give out no more
   links than connect them.
4. A pair is confirmed on the full sets of 64-bit shingle hashes. Pairs whose set sizes alone exclude the similarity
   aren't fetched; that loses no pair.
5. Confirmed links give connected components.

Null or wordless text has an empty set and no link. With fewer words than a shingle has, the whole sequence is the one
shingle. Rows with null doc_id get null component_id unless their set has another row. Rows that repeat a doc_id have
their own set size and one component, which the links of any of them make. Extra columns are ignored. An empty table
gives an empty result.

Words' hashes are remembered up to ``WORDS`` a task. Sets are dealt by a hash to as many blocks as keep
these at about ``BLOCK`` sets and ``BLOCK_SHINGLES`` shingles, and two blocks are compared in slices of ``SHINGLES``.
Intermediate tables are deleted as soon as nothing reads them; what the result is made of stays until the application
ends. A key that very many rows share (a set, a cell) is dealt over tasks by salts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom import scratch
from edgeloom.llm.components import components
from edgeloom.llm.rows import bound_batches, by_row, join_hot, mapped

#: Classes are looked up by broadcast up to this many ids of 8 bytes; beyond, the texts are shuffled.
BROADCAST_IDS = 400_000
#: Sets in a block of those that are compared all with all, and shingles in all of a block's sets.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Shingles of two blocks that are compared at a time.
SHINGLES = 1 << 17
#: Words that a task remembers the hash of, none longer than LONG bytes.
WORDS, LONG = 50_000, 64


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG:
            if len(self) >= WORDS:
                self.clear()
            self[word] = h
        return h


def shingles(text: bytes | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of so many words."""
    parts = (text or b"").lower().split()  # bytes: only A-Z are lowered and only ASCII white space splits
    if not parts:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(w))
    out = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ w[k : len(w) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out = (out + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def sketches(x: np.ndarray, m: int, k: int) -> np.ndarray:
    """2 * m sketches of k minima; the even ones are the first collection. As signed numbers whose lowest bit tells the collection."""
    draw = np.random.RandomState(20).randint(1, 2**62, size=(2, 2 * m * k)).astype(np.uint64)
    a, b = draw[0] * np.uint64(2) + np.uint64(1), draw[1]
    low = np.full(2 * m * k, np.uint64(2**64 - 1))
    for at in range(0, len(x), 4096):
        low = np.minimum(low, (x[at : at + 4096, None] * a + b).min(axis=0))
    low = low.reshape(2 * m, k)
    out = np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for i in range(k):
        out = (out ^ low[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    out = (out >> np.uint64(1) << np.uint64(1)) | (np.arange(2 * m, dtype=np.uint64) & np.uint64(1))
    return out.view(np.int64)


def _signed(words: int, m: int, k: int):
    def start():
        hashes = WordHashes()

        def run(ids: pa.Array, texts: pa.Array) -> list:
            sizes, keys, sk = [], [], []
            for t in texts.to_pylist():
                x = shingles(t, words, hashes)
                sizes.append(len(x))
                keys.append(xxhash.xxh3_128_digest(x.tobytes()))
                sk.append(sketches(x, m, k) if len(x) else np.empty(0, np.int64))
            return [ids, sizes, keys, sk]

        return run

    return start


def _sets(words: int):
    def start():
        hashes = WordHashes()
        return lambda ids, texts: [ids, [shingles(t, words, hashes).tobytes() for t in texts.to_pylist()]]

    return start


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if den * len(small) < num * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return den * both >= num * (len(x) + len(y) - both)


def _confirmed(num: int, den: int):
    def run(u: pa.Array, v: pa.Array, x: pa.Array, y: pa.Array) -> list:
        ok = pa.array([_similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), num, den) for a, b in zip(x, y, strict=True)], pa.bool_())
        return [u.filter(ok), v.filter(ok)]

    return lambda: run


def _plausible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Without the pairs of sets so unlike in size that they can't be similar enough."""
    a = classes.select(F.col("cid").alias("u"), F.col("n_shingles").alias("nu"))
    b = classes.select(F.col("cid").alias("v"), F.col("n_shingles").alias("nv"))
    return pairs.join(a, "u").join(b, "v").where(den * F.least("nu", "nv") >= num * F.greatest("nu", "nv")).select("u", "v")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id and the text's bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _set_table(ids: DataFrame, docs: DataFrame, words: int) -> tuple[DataFrame, str]:
    """(cid, hashes), the shingle sets of the documents of these ids(__cid), and where it lies."""
    ids, _ = scratch.save(ids.distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = _texts(docs).join(wanted, F.col("doc_id") == F.col("__cid"), "left_semi")
    return scratch.save(mapped(texts, {"cid": pa.int64(), "hashes": pa.binary()}, _sets(words)), "sets")


def _links(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Those of pairs(u, v) that are similar enough, confirmed on the sets of the documents of these ids."""
    sets, where = _set_table(pairs.select(F.col("u").alias("__cid")).unionByName(pairs.select(F.col("v").alias("__cid"))), docs, words)
    x = sets.select(F.col("cid").alias("u"), F.col("hashes").alias("x"))
    y = sets.select(F.col("cid").alias("v"), F.col("hashes").alias("y"))
    out, _ = scratch.save(mapped(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y"), {"u": pa.int64(), "v": pa.int64()}, _confirmed(num, den)), "links")
    scratch.drop(docs.sparkSession, where)
    return out


def common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, most: int = 0) -> np.ndarray:
    """Intersection sizes of the sets x with the sets y: ranges of about ``most`` shingles at a time, as a product of matrices of ones."""
    most = most or SHINGLES
    total = sum(map(len, sets))
    ranges = max(1, -(-total // most))
    edges = (np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges)) if ranges > 1 else np.empty(0, np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(s, edges), [len(s)]]) for s in sets]  # sets are sorted hashes, so ranges are even
    both = np.zeros((len(x), len(y)), np.float32)
    for r in range(ranges):
        parts = [s[c[r] : c[r + 1]] for s, c in zip(sets, cuts, strict=True)]
        row = np.repeat(np.arange(len(sets)), [len(p) for p in parts])
        _, inv, seen = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = seen > 1  # a shingle of one set only adds to no intersection
        row, col = row[shared[inv]], (np.cumsum(shared) - 1)[inv[shared[inv]]]
        for at in range(0, int(shared.sum()), 4096):
            here, has = (col >= at) & (col < at + 4096), np.zeros((len(sets), 4096), np.float32)
            has[row[here], col[here] - at] = 1
            both += has[x] @ has[y].T
    return both


def _across(num: int, den: int):
    kind = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(g: pa.Table) -> pa.Table:
        g = g.combine_chunks()
        sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in g["hashes"].chunk(0)]
        cid, comp, b = (g[c].to_numpy() for c in ("cid", "comp", "b"))
        size, p, q = np.array([len(s) for s in sets]), g["p"][0].as_py(), g["q"][0].as_py()
        x, y = np.flatnonzero(b == p), np.flatnonzero(b == q)
        both = common(sets, x, y)
        ok = (den * both >= num * (size[x][:, None] + size[y][None] - both)) & (comp[x][:, None] != comp[y][None])
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.setdefault(c, c)) != c:
                c = up
            return c

        out = []
        for i, j in np.argwhere(ok):  # of many links between components, those of a spanning forest will do
            a, c = find(comp[x[i]]), find(comp[y[j]])
            if a != c:
                root[a] = c
                out.append((cid[x[i]], cid[y[j]]))
        u = np.array(out, np.int64).reshape(-1, 2)
        return pa.table([u[:, 0].copy(), u[:, 1].copy()], schema=kind)

    return run


def _links_across(left: DataFrame, classes: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links between the components of left(cid, comp): all pairs that share a sketch of the first collection, in blocks of bounded size.

    Only links come out of a block, and of those no more than connect it; the sets of a block are compared in one matrix product.
    """
    sets, where = _set_table(left.select(F.col("cid").alias("__cid")), docs, words)
    bands = left.join(classes.select("cid", "n_shingles", "sketches"), "cid").select("cid", "comp", "n_shingles", F.explode("sketches").alias("band")).where("band & 1 = 0").distinct()
    full = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    full = full.select("band", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("s") / BLOCK_SHINGLES)).alias("blocks"))
    own = bands.join(full, "band").withColumn("b", F.pmod(F.xxhash64("cid"), "blocks"))
    own = own.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    own = own.select("cid", "comp", "band", "b", F.least("b", "c").alias("p"), F.greatest("b", "c").alias("q"))
    out, _ = scratch.save(own.join(sets, "cid").groupBy("band", "p", "q").applyInArrow(_across(num, den), "u long, v long"), "links")
    scratch.drop(docs.sparkSession, where)
    return out


def near_dedup(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, m: int = 12, k: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text).

    Documents whose sets have den * intersection >= num * union are linked; component_id is the smallest doc_id that
    links reach, and kept marks the document of that id.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    fields = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "set_key": pa.binary(), "sketches": pa.list_(pa.int64())}
    signed, signed_at = scratch.save(mapped(_texts(docs), fields, _signed(words, m, k)), "signed")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("cid"), F.first("n_shingles").alias("n_shingles"), F.first("sketches").alias("sketches"), F.count(F.lit(1)).alias("n_rows"))
    classes, classes_at = scratch.save(classes, "classes")
    rows, _ = scratch.save(signed.select("doc_id", "n_shingles", "set_key"), "rows")
    scratch.drop(spark, signed_at)
    bands = classes.select("cid", F.explode("sketches").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = join_hot(bands, shared, "band", "n", F.col("cid")).groupBy("cid").agg(F.collect_list("band").alias("bands"))
    first = F.filter("bands", lambda b: b.bitwiseAND(F.lit(1)) == 0)
    second = F.filter("bands", lambda b: b.bitwiseAND(F.lit(1)) == 1)
    cells = own.select("cid", first.alias("a"), second.alias("b")).where("size(a) > 0 and size(b) > 0")
    cells = cells.select("cid", "b", F.explode("a").alias("i")).select("cid", "i", F.explode("b").alias("j"))
    cells, cells_at = scratch.save(cells.select("cid", F.xxhash64("i", "j").alias("cell")), "cells")

    low = cells.groupBy("cell").agg(F.min("cid").alias("u"), F.max("cid").alias("high"), F.count(F.lit(1)).alias("n")).where("u <> high").select("cell", "u", "n")
    low, low_at = scratch.save(low, "low")
    stars = join_hot(cells, low, "cell", "n", F.col("cid")).where("cid <> u")
    placed, placed_at = scratch.save(stars.select("cid", "cell", "u"), "placed")
    scratch.drop(spark, cells_at)
    stars, stars_at = scratch.save(_plausible(placed.select("u", F.col("cid").alias("v")).distinct(), classes, num, den), "stars")
    links = _links(stars, docs, words, num, den)
    scratch.drop(spark, stars_at)
    comps = components(links)

    # In a cell that still holds several components, without its smallest class, which has been compared with all.
    now = placed.select("cid", "cell").join(comps, F.col("cid") == F.col("node"), "left").select("cid", "cell", F.coalesce("root", "cid").alias("comp"))
    open_ = now.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("cell", "n")
    open_, open_at = scratch.save(open_, "open")
    left, left_at = scratch.save(join_hot(now, open_, "cell", "n", F.col("cid")).select("cid", "comp").distinct(), "left")
    if left.take(1):
        more = _links_across(left, classes, docs, words, num, den)
        comps = components(links.unionByName(more))
    named = classes.join(comps, classes["cid"] == comps["node"], "left").select("set_key", "n_rows", F.coalesce("root", "cid").alias("component_id"))
    named, _ = scratch.save(named, "named")
    for where in (low_at, placed_at, open_at, left_at, classes_at):
        scratch.drop(spark, where)
    linked = join_hot(rows.where("n_shingles > 0"), named, "set_key", "n_rows", F.monotonically_increasing_id(), "left").drop("set_key")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that near_dedup keeps, with all their columns, decided by row: one of each component, whether rows have a doc_id of their own or not."""

    def keep(rows: DataFrame) -> DataFrame:
        kept = near_dedup(rows, **how).where("kept").select(F.col("doc_id").alias("__kept_id"))
        return rows.join(kept, rows["doc_id"] == kept["__kept_id"], "left_semi")

    return by_row(docs, keep)


SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower_ascii, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM
  (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS cid, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
e AS (SELECT cid, n, unnest(s) AS g FROM classes),
p AS (SELECT a.cid AS u, b.cid AS v FROM e a JOIN e b ON a.g = b.g AND a.cid <> b.cid GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT cid AS u, cid AS v FROM classes UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u),
c AS (SELECT u AS cid, min(v) AS root FROM r GROUP BY u)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.root, s.doc_id) AS component_id, s.doc_id = coalesce(c.root, s.doc_id) AS kept
FROM s LEFT JOIN classes k ON len(s.s) > 0 AND list_sort(s.s) = k.s LEFT JOIN c ON k.cid = c.cid
"""
