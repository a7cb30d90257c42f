"""Offset maps: sets of events given by the highest offset of each stream; bounds and chunks by them.

``OffsetMap`` is a small driver-side value with one entry for each stream (node, stream number).  A stream that is not in
it holds no event (offset -1).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Stream = tuple[str, int]


@dataclass(frozen=True)
class OffsetMap:
    offsets: dict[Stream, int] = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "offsets", {s: o for s, o in self.offsets.items() if o >= 0})

    def offset(self, stream: Stream) -> int:
        return self.offsets.get(stream, -1)

    def contains(self, stream: Stream, offset: int) -> bool:
        return offset <= self.offset(stream)

    @property
    def size(self) -> int:
        return sum(o + 1 for o in self.offsets.values())

    def __or__(self, other: OffsetMap) -> OffsetMap:
        return OffsetMap({s: max(self.offset(s), other.offset(s)) for s in self.offsets.keys() | other.offsets.keys()})

    def __and__(self, other: OffsetMap) -> OffsetMap:
        return OffsetMap({s: min(self.offset(s), other.offset(s)) for s in self.offsets.keys() & other.offsets.keys()})

    def __sub__(self, other: OffsetMap) -> int:
        """How many events of this set the other lacks."""
        return sum(max(0, o - other.offset(s)) for s, o in self.offsets.items())

    def including(self, stream: Stream, offset: int) -> OffsetMap:
        return self | OffsetMap({stream: offset})

    def excluding(self, stream: Stream, offset: int) -> OffsetMap:
        """Without the event and what follows it in its stream."""
        return OffsetMap({**self.offsets, stream: min(self.offset(stream), offset - 1)})

    def compare(self, other: OffsetMap) -> int | None:
        """-1, 0, 1 if contained, equal, containing; None if neither contains the other."""
        less, more = other - self, self - other
        return None if less and more else (more > 0) - (less > 0)

    def __le__(self, other: OffsetMap) -> bool:
        return self.compare(other) in (-1, 0)

    def rows(self, spark, name: str) -> DataFrame:
        return spark.createDataFrame([(n, nr, o) for (n, nr), o in self.offsets.items()], f"node string, stream_nr bigint, {name} bigint")


def present(events: DataFrame) -> DataFrame:
    """node, stream_nr and the highest offset of each stream."""
    return events.groupBy("node", "stream_nr").agg(F.max("offset").alias("offset"))


def present_map(events: DataFrame) -> OffsetMap:
    return OffsetMap({(r["node"], r["stream_nr"]): r["offset"] for r in present(events).collect()})  # a row for each stream


def to_replicate(events: DataFrame, target: OffsetMap) -> dict[Stream, int]:
    """How many events of each stream the target has and the table lacks."""
    have = present_map(events)
    return {s: o - have.offset(s) for s, o in target.offsets.items() if o > have.offset(s)}


def within(events: DataFrame, lower: OffsetMap | None = None, upper: OffsetMap | None = None, known: OffsetMap | None = None) -> DataFrame:
    """Events above lower (exclusive) and up to upper (inclusive) of each stream; streams that upper lacks have none.
    With known, an upper bound beyond it is refused."""
    if upper is not None and known is not None and not upper <= known:
        raise ValueError("the upper bound must be within the known offsets")
    out, spark = events, events.sparkSession
    if upper is not None:
        out = out.join(F.broadcast(upper.rows(spark, "__upper")), ["node", "stream_nr"]).where(F.col("offset") <= F.col("__upper")).drop("__upper")
    if lower is not None and lower.offsets:
        low = F.broadcast(lower.rows(spark, "__lower"))  # a row for each stream
        out = out.join(low, ["node", "stream_nr"], "left").where(F.col("offset") > F.coalesce("__lower", F.lit(-1))).drop("__lower")
    return out.select(events.columns)


#: Numbers of a range, and ranges of a range of ranges.
STEP = 4096


def placed(rows: DataFrame, number: str, by: tuple[str, ...] = (), ties: tuple[str, ...] = (), descending: bool = False, name: str = "__at") -> DataFrame:
    """rows with their place (from 0) in the order of an integer column, for each value of ``by``.

    Rows are numbered within ranges of STEP numbers, and what comes before a range is summed up in two levels, so the one task that
    sees a whole group has a row for STEP * STEP numbers.
    """
    sign = -1 if descending else 1
    held = rows.withColumn("__range", F.floor(F.col(number) / STEP) * sign)
    counts = held.groupBy(*by, "__range").agg(F.count("*").alias("__c")).withColumn("__wide", F.floor(F.col("__range") / STEP))
    above = lambda order, *part: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    wide = counts.groupBy(*by, "__wide").agg(F.sum("__c").alias("__sum"))
    wide = wide.select(*by, "__wide", F.coalesce(F.sum("__sum").over(above("__wide", *by)), F.lit(0)).alias("__first"))
    inside = F.coalesce(F.sum("__c").over(above("__range", *by, "__wide")), F.lit(0))
    starts = counts.withColumn("__in", inside).join(wide, [*by, "__wide"]).select(*by, "__range", (F.col("__first") + F.col("__in")).alias("__start"))
    order = [F.desc(c) if descending else F.asc(c) for c in (number, *ties)]
    own = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order)) - 1
    return held.withColumn("__own", own).join(starts, [*by, "__range"]).withColumn(name, F.col("__start") + F.col("__own")).drop("__range", "__own", "__start")


def chunks(events: DataFrame, size: int, descending: bool = False) -> DataFrame:
    """events with ``chunk``: in key order, so many events each."""
    at = placed(events, "lamport", ties=("node", "stream_nr"), descending=descending)
    return at.withColumn("chunk", F.floor(F.col("__at") / size).cast("bigint")).drop("__at")


def chunk_bounds(events: DataFrame, size: int) -> DataFrame:
    """chunk, node, stream_nr, and the offsets (lower exclusive, upper inclusive) of each chunk's part of a stream."""
    parts = chunks(events, size).groupBy("chunk", "node", "stream_nr").agg((F.min("offset") - 1).alias("lower"), F.max("offset").alias("upper"), F.count("*").alias("events"))
    return parts


def event_id() -> Column:
    """Text that sorts as keys do: lamport with leading zeros, then the stream."""
    return F.concat(F.lpad(F.col("lamport").cast("string"), 16, "0"), F.lit("/"), F.col("node"), F.lit("-"), F.col("stream_nr").cast("string"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Events of both, each key once; of two with one key the one of a, or within a table the older."""
    both = a.withColumn("__side", F.lit(0)).unionByName(b.withColumn("__side", F.lit(1)))
    key = ["lamport", "node", "stream_nr"]
    older = F.min_by(F.struct(*a.columns), F.struct("__side", "ts", "offset"))
    return both.groupBy(*key).agg(older.alias("__e")).select("__e.*")
