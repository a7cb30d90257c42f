"""The canonical event table, and adapters that give it from other tables, JSON lines and dumps.

Columns: lamport, node, stream_nr, offset, ts, tags (sorted, distinct), app_id, is_local, payload (a struct).
(lamport, node, stream_nr) is the total order; (node, stream_nr, offset) is an event's place in its stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.offsets import placed
from ..operators.tags import Atom, Where

COLUMNS = ("lamport", "node", "stream_nr", "offset", "ts", "tags", "app_id", "is_local", "payload")
#: Fixed form of application ids.
APP_ID = r"^[a-z0-9-]+(\.[a-z0-9-]+)*$"
DEFAULT_APP = "com.example.test"


def tag_set(*tags: Column) -> Column:
    """Tags as a sorted array without repetitions, nulls or empty tags."""
    return F.filter(F.array_sort(F.array_distinct(F.array_compact(F.array(*tags)))), lambda t: t != "")


def _on_users(atom: Atom) -> Column | None:
    """A selection's atom as a condition on the columns of the ``events`` table."""
    if atom.kind == "key":
        op, (lamport, _, _) = atom.op, atom.value
        return F.col("event_id") >= lamport - 1 if op in (">", ">=") else F.col("event_id") <= lamport - 1
    if atom.kind == "app":
        return F.col("event_type") == "error" if atom.value == "com.example.ops" else None
    if atom.kind == "tag" and atom.value != "user":
        kind, user = F.col("event_type") == atom.value, str(atom.value).removeprefix("user:")
        return kind | (F.col("user_id") == int(user)) if user.isdecimal() and str(int(user)) == user and user != atom.value else kind
    return None


def user_events(spark: SparkSession, sf_dir: str, offsets: bool = False, where: Where | None = None) -> DataFrame:
    """The ``events`` table: four nodes, tags for the kind of event and the user.  The table has no offsets;
    with offsets they are numbered without gaps in each stream, otherwise they only ascend.  where: a selection that will be
    made from the events; what it says about the table's own columns goes to the scan (not with offsets, which count all)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    known = where.implied(_on_users) if where is not None and not offsets else None
    if known is not None:
        e = e.where(known)
    node = F.col("user_id") % 4
    if offsets:
        e = placed(e.withColumn("__node", node), "event_id", by=("__node",), name="__offset")
    dense = F.col("__offset")
    return e.select(
        (F.col("event_id") + 1).alias("lamport"),
        F.concat(F.lit("n"), node.cast("string")).alias("node"),
        F.lit(0).cast("long").alias("stream_nr"),
        (dense if offsets else F.col("event_id")).cast("long").alias("offset"),
        F.col("ts").cast("timestamp").alias("ts"),
        tag_set(F.col("event_type"), F.lit("user"), F.concat(F.lit("user:"), F.col("user_id").cast("string"))).alias("tags"),
        F.when(F.col("event_type") == "error", "com.example.ops").otherwise("com.example.shop").alias("app_id"),
        (node == 0).alias("is_local"),
        F.struct("user_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type").alias("payload"),
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events tagged ``order`` and ``order:<key>``."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    return o.select(
        (key + 1).alias("lamport"),
        F.lit("orders").alias("node"),
        F.lit(0).cast("long").alias("stream_nr"),
        key.alias("offset"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        tag_set(F.lit("order"), F.concat(F.lit("order:"), key.cast("string"))).alias("tags"),
        F.lit("com.example.orders").alias("app_id"),
        F.lit(True).alias("is_local"),
        F.struct(*(F.col(c) for c in o.columns)).alias("payload"),
    )


def item_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as events tagged ``item`` and ``order:<key>``, in the order of order, line, part and supplier."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return i.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber") + 1_000_000_000).cast("long").alias("lamport"),
        F.lit("items").alias("node"),
        F.col("l_partkey").alias("stream_nr"),
        F.col("l_suppkey").alias("offset"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        tag_set(F.lit("item"), F.concat(F.lit("order:"), F.col("l_orderkey").cast("string"))).alias("tags"),
        F.lit("com.example.orders").alias("app_id"),
        F.lit(True).alias("is_local"),
        F.struct(*(F.col(c) for c in i.columns)).alias("payload"),
    )


def json_lines(lines: DataFrame, payload: T.DataType | str, now: Column | None = None, app_id: str = DEFAULT_APP, line: str = "value", number: str | None = None) -> DataFrame:
    """Events from JSON lines {timestamp (microseconds) or time (ISO), tags, appId, payload}.  timestamp
    beats time; both default to now, appId to app_id.  Lines that are not JSON objects are dropped.  number
    names an integer column that orders the lines; without it they keep the order of their partitions."""
    kind = payload if isinstance(payload, str) else payload.simpleString()
    parsed = F.from_json(F.col(line), f"timestamp bigint, time string, tags array<string>, appId string, payload {kind}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.select((F.col(number) if number else F.monotonically_increasing_id()).alias("__n"), parsed.alias("e"))
    rows = rows.where(F.col("e").isNotNull() & F.col("e._bad").isNull())
    at = F.col("__n").cast("long")
    if number is None:
        rows, at = placed(rows, "__n"), F.col("__at").cast("long")
    moment = F.coalesce(F.timestamp_micros("e.timestamp"), F.try_to_timestamp("e.time"), now if now is not None else F.current_timestamp())
    return rows.select(
        (at + 1).alias("lamport"),
        F.lit("local").alias("node"),
        F.lit(0).cast("long").alias("stream_nr"),
        at.alias("offset"),
        moment.alias("ts"),
        F.array_sort(F.array_distinct(F.coalesce("e.tags", F.array().cast("array<string>")))).alias("tags"),
        F.coalesce("e.appId", F.lit(app_id)).alias("app_id"),
        F.lit(True).alias("is_local"),
        F.col("e.payload").alias("payload"),
    )


def valid_app_id(app_id: Column) -> Column:
    return F.coalesce(app_id.rlike(APP_ID), F.lit(False))


def dump(events: DataFrame, path: str) -> None:
    """Events as compressed JSON lines, one each, with a payload of any shape."""
    key = F.struct("lamport", "node", "stream_nr", "offset", F.unix_micros("ts").alias("timestamp"), "tags", F.col("app_id").alias("appId"), "is_local", "payload")
    events.select(F.to_json(key).alias("value")).write.option("compression", "gzip").text(path)


def restore(spark: SparkSession, path: str, payload: T.DataType | str) -> DataFrame:
    kind = payload if isinstance(payload, str) else payload.simpleString()
    schema = f"lamport bigint, node string, stream_nr bigint, offset bigint, timestamp bigint, tags array<string>, appId string, is_local boolean, payload {kind}"
    e = spark.read.text(path).select(F.from_json("value", schema).alias("e"))
    return e.select("e.lamport", "e.node", "e.stream_nr", "e.offset", F.timestamp_micros("e.timestamp").alias("ts"), "e.tags", F.col("e.appId").alias("app_id"), "e.is_local", "e.payload")
