"""How rows go to Python and back, decisions by row, and joins on keys that may be hot."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import scratch

#: Bytes of an Arrow batch that a task hands to Python; a row that is longer is a batch of its own.
BATCH = 4 << 20
#: Rows of a batch that are Python objects at a time.
SLICE = 128
#: A key is hot if it has more than this share of all rows, so there are at most this many hot keys.
HOT = 1000
SALTS = 64

_DDL = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<long>"}
Fields = dict[str, pa.DataType]


def ddl(fields: Fields) -> str:
    return ", ".join(f"{name} {_DDL[kind]}" for name, kind in fields.items())


def bound_batches(spark: SparkSession) -> None:
    """Batches of this session are of about BATCH bytes at most, unless it asks for less. The setting stays, as frames run later."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("bB"))
    if now <= 0 or now > BATCH:
        spark.conf.set(name, str(BATCH))


def mapped(rows: DataFrame, fields: Fields, start: Callable[[], Callable], size: int = SLICE) -> DataFrame:
    """fields of what start()'s function makes of slices of rows.

    start is called once for each partition, and what it made goes when the partition ends. Its function takes the
    slice as Arrow arrays, one for each column, and returns arrays or lists, one for each field. Arrow keeps ids as they
    are, beside nulls, too.
    """
    bound_batches(rows.sparkSession)
    kinds, names = list(fields.values()), list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for b in batches:
            for at in range(0, b.num_rows, size):
                got = work(*b.slice(at, size).columns)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(got, kinds, strict=True)], names=names)
        del work
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, ddl(fields))


def of_texts(docs: DataFrame, fields: Fields, start: Callable[[], Callable], size: int = SLICE) -> DataFrame:
    """doc_id and fields for each row of docs(doc_id, text). start()'s function takes a list of texts and returns a list for each field."""

    def by_text() -> Callable:
        work = start()
        return lambda ids, texts: [ids, *work(texts.to_pylist())]

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), {"doc_id": pa.int64(), **fields}, by_text, size)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, spread: Column, how: str = "inner") -> DataFrame:
    """left joined with right, which has each key once and, in column n, about how many rows of left have it; n goes.

    The rows of a hot key are dealt out over SALTS tasks by a hash of spread, and right's row for it is repeated as
    often. Hot keys come from a broadcast of HOT rows at most.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(right.where(F.col(n) * HOT > total).select(key, F.lit(SALTS).alias("__salts")))
    left = left.join(hot, key, "left").withColumn("__salt", F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))).drop("__salts")
    salts = F.when(F.col(n) * HOT > total, F.lit(SALTS)).otherwise(F.lit(1))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(n)
    return left.join(right, [key, "__salt"], how).drop("__salt")


def by_row(docs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """keep(docs), where rows without a doc_id, or that repeat one, are kept or not each on its own.

    keep returns rows of docs. If there are such rows, all are numbered in the order of doc_id, those without one last,
    and written once; keep then sees the numbers as doc_ids.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    if not odd.take(1):
        return keep(docs)
    rows = docs.withColumn("__at", F.monotonically_increasing_id())  # parts a range of equal doc_ids
    rows = rows.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text"), "__at").drop("__at").withColumnRenamed("doc_id", "__doc_id")
    rows, _ = scratch.save(rows.withColumn("doc_id", F.monotonically_increasing_id()), "rows")
    return keep(rows).drop("doc_id").withColumnRenamed("__doc_id", "doc_id").select(*docs.columns)
