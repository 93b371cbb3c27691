"""Edge tables: ts_ms, seq, event_id, event_sig, subject_id, subject_sig, object_id, object_sig; and what they are read from.

Every function maps DataFrames to DataFrames in built-in expressions. Times are integer milliseconds, cut after the
third digit, never rounded through a double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.functions import signatures
from edgeloom.functions.times import epoch_ms, seconds_of_nanos, timestamp_ms

RAW = ("start_time", "end_time", "event_id", "event_sig", "subject_id", "subject_sig", "object_id", "object_sig")
EDGE = ("ts_ms", "seq", "event_id", "event_sig", "subject_id", "subject_sig", "object_id", "object_sig")
EDGE_SCHEMA = T.StructType([T.StructField(c, T.StringType() if c.endswith("sig") else T.LongType()) for c in EDGE])
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW])
#: Where read_csv keeps a line that has another number of columns.
MALFORMED = "malformed"


def read_csv(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The raw columns as text; malformed, the line where it has another number of columns, else null; and, of a batch, seq, its place.

    seq orders lines by file name and by their place in the file. A split starts at its first byte, and has no more
    lines than bytes; a split that shares a task with others is the last of its file, so sums of both keep the order.
    """
    schema = T.StructType([*RAW_SCHEMA, T.StructField(MALFORMED, T.StringType())])
    reader = spark.readStream if streaming else spark.read
    rows = reader.schema(schema).option("header", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).option("columnPruning", False).option("escape", '"').csv(path)
    if streaming:
        return rows
    files = sorted(rows.inputFiles())
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    if len(files) < 2:
        return rows.withColumn("seq", place)
    ranks = F.broadcast(spark.createDataFrame([(f, k << 44) for k, f in enumerate(files)], "__file string, __rank long"))  # a row for each file
    return rows.withColumns({"__place": place, "__of": F.input_file_name()}).join(ranks, F.col("__of") == F.col("__file"), "left").withColumn("seq", F.coalesce("__rank", F.lit(0)) + F.col("__place")).drop("__place", "__of", "__file", "__rank")


def typed(raw: DataFrame) -> DataFrame:
    """start_ms, end_ms (null unless it can be read), ids and signatures; null where they can't be read."""
    ids = [F.col(c).try_cast("bigint").alias(c) for c in ("event_id", "subject_id", "object_id")]
    return raw.select(timestamp_ms(F.col("start_time")).alias("start_ms"), timestamp_ms(F.col("end_time")).alias("end_ms"), *ids, "event_sig", "subject_sig", "object_sig", *[c for c in raw.columns if c not in RAW])


_NEEDED = " and ".join(f"{c} is not null" for c in ("start_ms", "event_id", "subject_id", "object_id", "event_sig", "subject_sig", "object_sig"))


def _needed(raw: DataFrame) -> str:
    return f"{_NEEDED} and {MALFORMED} is null" if MALFORMED in raw.columns else _NEEDED


def rejects(raw: DataFrame) -> DataFrame:
    """The typed rows that edges() leaves out, lines of another number of columns among them."""
    return typed(raw).where(f"not ({_needed(raw)})")


def with_duplicates(rows: DataFrame) -> DataFrame:
    """A row for the start and, where it differs, one for the end."""
    times = F.when(F.col("end_ms").isNull(), F.array("start_ms")).otherwise(F.array_distinct(F.array("start_ms", "end_ms")))
    return rows.select(F.explode(times).alias("ts_ms"), "*").drop("start_ms", "end_ms")


def edges(raw: DataFrame) -> DataFrame:
    """The edge table of raw text columns. seq, which breaks ties of time, is a column of raw or the row's place in it; in a stream, the event's id."""
    if "seq" not in raw.columns:
        raw = raw.withColumn("seq", F.col("event_id").try_cast("bigint") if raw.isStreaming else F.monotonically_increasing_id())
    return with_duplicates(typed(raw).where(_needed(raw))).select(*EDGE)


def from_six_columns(lines: DataFrame) -> DataFrame:
    """Raw columns from lines(value) of ``t1,t2,event#subject#object,event id,subject id,object id``. Others give nulls."""
    m = r"^([^,]*),([^,]*),(.*),([^,]*),([^,]*),([^,]*)$"
    part = lambda i: F.regexp_extract("value", m, i)
    sig = r"^(.+)#(\w+::.+)#(\w+::.+)$"
    plain = F.split(part(3), "#")
    get = lambda i: F.when(F.size(plain) == 3, plain[i - 1]).when(part(3).rlike(sig), F.regexp_extract(part(3), sig, i))
    return lines.where(F.col("value").rlike(m)).select(
        part(1).alias("start_time"), part(2).alias("end_time"), part(4).alias("event_id"), get(1).alias("event_sig"),
        part(5).alias("subject_id"), get(2).alias("subject_sig"), part(6).alias("object_id"), get(3).alias("object_sig"),
    )


_NODE = "struct<id: string, properties: map<string, string>>"


def _relation(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", f"r {_NODE}, m {_NODE}, n {_NODE}").alias("j")).select("j.*")


def _raw(rows: DataFrame, signature, start, end, kind: str, subject: str = "m", object_: str = "n") -> DataFrame:
    return rows.select(
        start.alias("start_time"), end.alias("end_time"), F.col("r.id").alias("event_id"), F.col("r.properties")[kind].alias("event_sig"),
        F.col(f"{subject}.id").alias("subject_id"), signature(F.col(f"{subject}.properties")).alias("subject_sig"),
        F.col(f"{object_}.id").alias("object_id"), signature(F.col(f"{object_}.properties")).alias("object_sig"),
    )


def _times() -> tuple:
    """Start and end: ``earliest`` and ``lastest`` (so spelt; also ``latest``) where there is an earliest, else ``time`` for both."""
    p = F.col("r.properties")
    there = p["earliest"].isNotNull()
    return F.when(there, p["earliest"]).otherwise(p["time"]), F.when(there, F.coalesce(p["lastest"], p["latest"])).otherwise(p["time"])


def from_spade(lines: DataFrame, reverse: bool = False) -> DataFrame:
    """Raw columns from lines(value) of JSON {r: relation, m: node, n: node}. reverse swaps subject and object. Nulls where something lacks."""
    return _raw(_relation(lines), signatures.spade, *_times(), "operation", *(("n", "m") if reverse else ("m", "n")))


def from_darpa(lines: DataFrame) -> DataFrame:
    """Raw columns from lines(value) of JSON {r, m, n} with times in whole nanoseconds. Nulls where something lacks."""
    start, end = _times()
    return _raw(_relation(lines), signatures.darpa, seconds_of_nanos(start), seconds_of_nanos(end), "type")


def odd_lines(lines: DataFrame) -> DataFrame:
    """seq, columns: lines(seq, value) whose number of commas differs from the line before. Ranges of seq are compared at their borders only."""
    rows = lines.select("seq", F.size(F.split("value", ",")).alias("columns"), F.floor(F.col("seq") / 100_000).alias("part"))
    last = rows.groupBy("part").agg(F.max_by("columns", "seq").alias("before"))
    last = last.select("part", F.lag("before").over(Window.orderBy("part")).alias("before"))
    own = rows.withColumn("prev", F.lag("columns").over(Window.partitionBy("part").orderBy("seq"))).join(last, "part")
    return own.where(F.col("columns") != F.coalesce("prev", "before")).select("seq", "columns")


def from_events(events: DataFrame) -> DataFrame:
    """Users and keys of the events table. View and click go from key to user, the others from user to key."""
    key = (F.get_json_object("props", "$.k").cast("bigint") + 1_000_000).alias("key")
    rows = events.select(epoch_ms("ts").alias("ts_ms"), "event_id", "event_type", "user_id", key)
    read = F.col("event_type").isin("view", "click")
    user, item = F.concat(F.lit("User::"), F.col("user_id")), F.concat(F.lit("Key::"), F.col("key"))
    return rows.select(
        "ts_ms", F.col("event_id").alias("seq"), "event_id", F.col("event_type").alias("event_sig"),
        F.when(read, F.col("key")).otherwise(F.col("user_id")).alias("subject_id"), F.when(read, item).otherwise(user).alias("subject_sig"),
        F.when(read, F.col("user_id")).otherwise(F.col("key")).alias("object_id"), F.when(read, user).otherwise(item).alias("object_sig"),
    )


def from_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Customer to order, signature ``place``."""
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        epoch_ms("o_orderdate").alias("ts_ms"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("event_id"), F.lit("place").alias("event_sig"),
        (F.col("o_custkey") + 1_000_000_000).alias("subject_id"), F.concat(F.lit("Customer::"), F.col("c_mktsegment")).alias("subject_sig"),
        (F.col("o_orderkey") + 2_000_000_000).alias("object_id"), F.concat(F.lit("Order::"), F.col("o_orderpriority")).alias("object_sig"),
    )


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Order to part, signature ``ship_<flag>``, and supplier to part, ``supply``, at the day of shipping.

    Ids are 60 bits of the MD5 of order, part, supplier, line, flag and time; rows that share all of these are one event.
    Numbering rows in an order of all columns would take the whole table through one task.
    """
    ms = epoch_ms("l_shipdate").alias("ts_ms")
    rows = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", ms).distinct()
    text = F.concat_ws("|", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "ts_ms")))
    number = lambda kind: F.conv(F.substring(F.md5(F.concat(F.lit(kind), text)), 1, 15), 16, 10).cast("bigint")
    order = F.struct(number("ship|").alias("id"), F.concat(F.lit("ship_"), "l_returnflag").alias("sig"), (F.col("l_orderkey") + 2_000_000_000).alias("subject_id"), F.lit("Order").alias("subject_sig"))
    supplier = F.struct(number("supply|").alias("id"), F.lit("supply").alias("sig"), (F.col("l_suppkey") + 4_000_000_000).alias("subject_id"), F.lit("Supplier").alias("subject_sig"))
    rows = rows.select("ts_ms", "l_partkey", F.explode(F.array(order, supplier)).alias("e"))
    return rows.select(
        "ts_ms", F.col("e.id").alias("seq"), F.col("e.id").alias("event_id"), F.col("e.sig").alias("event_sig"), "e.subject_id", "e.subject_sig",
        (F.col("l_partkey") + 3_000_000_000).alias("object_id"), F.lit("Part").alias("object_sig"),
    )
