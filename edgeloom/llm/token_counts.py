"""Token counts of documents in flat token files, by a separator scan.

A file is a bare sequence of little-endian token ids, of two bytes where the tokenizer's ids fit and else of four; an
end-of-document id follows each document, and no index says where. Both come from the tokenizer's file: the end is its
special token of one of the names ``ENDS``. Files are cut into blocks of ``BLOCK`` tokens, wherever that falls. In each block the ends are
found by one vectorised comparison; a document that begins in one block and ends in a later one gets its length by
prefix scans over the blocks of its file: the sum of ends so far numbers the documents, and the largest place of an
end so far is where the document began. The scans have two levels, within groups of ``GROUP`` blocks and over the
groups, so no task holds more than a file's group totals.

A file without a last end has a last document with ended = false; an empty file has no documents; two ends in a row
make a document of 0 tokens. A file whose size isn't a whole number of tokens raises ValueError.

``write_flat`` makes such files of documents: null text is empty, strings of special tokens are ordinary text, so that
no document holds an end; rows that repeat are documents of their own; extra columns are ignored; an empty table makes
no files and gives an empty result. Each task writes its own file under a temporary name and renames it, so a task
that runs again leaves the same file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom import scratch
from edgeloom.llm.bpe import Bpe
from edgeloom.llm.rows import SLICE, bound_batches, ddl

#: What tokenizers call the end of a document.
ENDS = ("<|endoftext|>", "<|end_of_text|>", "<eos>", "</s>", "[SEP]")
BLOCK = 1 << 20
GROUP = 1024


def layout(file: str) -> tuple[int, str]:
    """The end-of-document id of a tokenizer's file, and the type of its ids in flat files."""
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    end = next((special[t] for t in ENDS if t in special), None)
    if end is None:
        raise ValueError("the tokenizer has no end-of-document token")
    return end, "<u2" if max([*spec["model"]["vocab"].values(), *special.values()]) < 1 << 16 else "<u4"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_flat(docs: DataFrame, file: str, uri: str) -> DataFrame:
    """(file, ordinal, doc_id) of the documents of docs(doc_id, text), whose ids, by the BPE file, are written as flat files in the folder uri."""
    end, kind = layout(file)
    fields = {"file": pa.int32(), "ordinal": pa.int64(), "doc_id": pa.int64()}
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, n, sink = Bpe(file), TaskContext.get().partitionId(), 0, None
        where, top = _place(uri)
        tmp, final = f"{top}/.{part}-{uuid.uuid4().hex}", f"{top}/{part:08d}.tokens"
        for b in batches:
            if sink is None and b.num_rows:
                where.create_dir(top, recursive=True)
                sink = where.open_output_stream(tmp)
            for at in range(0, b.num_rows, SLICE):
                for text in b.column(1).slice(at, SLICE).to_pylist():
                    sink.write(np.array([*bpe.encode_plain(text), end], kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows)), b.column(0)], names=list(fields))
            n += b.num_rows
        if sink is not None:
            sink.close()
            where.move(tmp, final)

    return scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl(fields)), "ordinals")[0]


def blocks(spark: SparkSession, uri: str, kind: str, size: int = BLOCK) -> DataFrame:
    """(name, block, start, n) of the token files in a folder; a row for each file comes from its listing, and blocks are made on the executors."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(uri)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = [(s.getPath().getName(), s.getLen()) for s in (system.listStatus(p) if system.exists(p) else [])]
    width = np.dtype(kind).itemsize
    files = [(name, n // width) for name, n in listed if name.endswith(".tokens")]
    if any(n % width for name, n in listed if name.endswith(".tokens")):
        raise ValueError("a file ends within a token")
    out = spark.createDataFrame(files, "name string, total long").where("total > 0")
    out = out.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / size).cast("long"))))
    return out.select("name", "block", (F.col("block") * size).alias("start"), F.least(F.lit(size), F.col("total") - F.col("block") * size).cast("long").alias("n"))


def scan(found: DataFrame, uri: str, end: int, kind: str) -> DataFrame:
    """For each block: the number of ends, the places in the file of the first and the last, and the lengths between them."""
    fields = {"name": pa.string(), "block": pa.int64(), "ends": pa.int64(), "first": pa.int64(), "last": pa.int64(), "upto": pa.int64(), "inner": pa.list_(pa.int64())}
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = _place(uri)
        for b in batches:
            for r in b.to_pylist():
                with where.open_input_file(f"{top}/{r['name']}") as f:
                    f.seek(r["start"] * width)
                    at = np.flatnonzero(np.frombuffer(f.read(r["n"] * width), kind) == end) + r["start"]
                row = [r["name"], r["block"], len(at), at[0] if len(at) else None, at[-1] if len(at) else None, r["start"] + r["n"], np.diff(at) - 1]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, fields.values(), strict=True)], names=list(fields))

    # Round robin needs no key: every task gets blocks of every file.
    many = max(1, 2 * found.sparkSession.sparkContext.defaultParallelism)
    return found.repartition(many).mapInArrow(run, ddl(fields))


def stitched(scanned: DataFrame) -> DataFrame:
    """(name, ordinal, n_tokens, ended): the documents of the scanned files."""
    s = scanned.withColumn("g", F.floor(F.col("block") / GROUP))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = s.groupBy("name", "g").agg(F.sum("ends").alias("ends"), F.max("last").alias("last"))
    over = before(Window.partitionBy("name").orderBy("g"))
    groups = groups.select("name", "g", F.coalesce(F.sum("ends").over(over), F.lit(0)).alias("g_ends"), F.max("last").over(over).alias("g_last"))
    inside = before(Window.partitionBy("name", "g").orderBy("block"))
    s = s.withColumn("b_ends", F.coalesce(F.sum("ends").over(inside), F.lit(0))).withColumn("b_last", F.max("last").over(inside)).join(groups, ["name", "g"])
    s = s.select("*", (F.col("g_ends") + F.col("b_ends")).alias("base"), F.coalesce(F.greatest("b_last", "g_last"), F.lit(-1)).alias("open"))
    first = s.where("ends > 0").select("name", F.col("base").alias("ordinal"), (F.col("first") - F.col("open") - 1).alias("n_tokens"), F.lit(True).alias("ended"))
    inner = s.where("ends > 1").select("name", "base", F.posexplode("inner").alias("k", "n_tokens")).select("name", (F.col("base") + F.col("k") + 1).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    total = s.groupBy("name").agg(F.max("upto").alias("upto"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"), F.sum("ends").alias("ordinal"))
    rest = total.where("upto - last > 1").select("name", "ordinal", (F.col("upto") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return first.unionByName(inner).unionByName(rest)


def count_tokens(spark: SparkSession, uri: str, file: str, size: int = BLOCK) -> DataFrame:
    """(name, ordinal, n_tokens, ended) of each document in the flat files of a folder; file: their tokenizer's."""
    end, kind = layout(file)
    return stitched(scratch.save(scan(blocks(spark, uri, kind, size), uri, end, kind), "scanned")[0])


def count_documents(docs: DataFrame, file: str, size: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens of docs(doc_id, text), counted in flat files that are written first."""
    spark = docs.sparkSession
    uri = scratch.path(spark, "flat")
    ids = write_flat(docs, file, uri)
    counts = count_tokens(spark, uri, file, size).select(F.substring_index("name", ".", 1).cast("int").alias("file"), "ordinal", "n_tokens")
    return ids.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
