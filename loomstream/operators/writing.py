"""Publishing, routing to streams, retention."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .offsets import placed
from .tags import Where

#: Streams 0 to 3 (fixed values).
RESERVED = ("default", "discovery", "metrics", "files")
SIZES = {"B": 1, "kB": 10**3, "MB": 10**6, "GB": 10**9, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30}
#: Offsets of a stream that are summed in one task.
BLOCK = 65_536
AGES = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


@dataclass(frozen=True)
class Route:
    where: Where
    stream: str


def stream_numbers(routes: list[Route]) -> dict[str, int]:
    """Numbers of the reserved streams, then of new names in order of appearance."""
    out = {name: i for i, name in enumerate(RESERVED)}
    for r in routes:
        out.setdefault(r.stream, len(out))
    return out


def route(events: DataFrame, routes: list[Route]) -> Column:
    """The stream number of each event: that of the first route that selects it, else 0."""
    numbers = stream_numbers(routes)
    out = F.lit(0).cast("bigint")
    for r in reversed(routes):
        if any(a.kind not in ("tag", "app") for c in r.where.alternatives for a in c):
            raise ValueError("a route selects by tags and application only")
        out = F.when(r.where.predicate(), F.lit(numbers[r.stream]).cast("bigint")).otherwise(out)
    return out


def publish(store: DataFrame, batch: DataFrame, node: str, app_id: str, at: str, routes: list[Route] | None = None) -> DataFrame:
    """Events of a batch (n: its order, an integer; tags, payload), appended to what the store holds: lamports go on from the
    store's highest, offsets from each stream's highest; all get the one time of the request."""
    rows = batch.withColumn("tags", F.array_sort(F.array_distinct("tags"))).withColumn("app_id", F.lit(app_id))
    rows = rows.withColumn("stream_nr", route(rows, routes or []))
    top = store.agg(F.coalesce(F.max("lamport"), F.lit(0)).alias("__l"))
    own = store.where(F.col("node") == node).groupBy("stream_nr").agg((F.max("offset") + 1).alias("__o"))
    rows = rows.crossJoin(F.broadcast(top)).join(F.broadcast(own), "stream_nr", "left")  # one row; one for each stream
    rows = placed(placed(rows, "n", name="__place"), "n", by=("stream_nr",), name="__inside")
    return rows.select(
        (F.col("__l") + F.col("__place") + 1).cast("bigint").alias("lamport"),
        F.lit(node).alias("node"),
        "stream_nr",
        (F.coalesce("__o", F.lit(0)) + F.col("__inside")).cast("bigint").alias("offset"),
        F.lit(at).cast("timestamp").alias("ts"),
        "tags",
        "app_id",
        F.lit(True).alias("is_local"),
        "payload",
    )


def _amount(text: str, units: dict[str, int]) -> int:
    m = re.fullmatch(r"(\d+)\s*([A-Za-z]+)", text)
    if m is None or m[2] not in units:
        raise ValueError(f"{text!r} is not a number and one of {', '.join(units)}")
    return int(m[1]) * units[m[2]]


def bytes_of(text: str) -> int:
    return _amount(text, SIZES)


def seconds_of(text: str) -> int:
    return _amount(text, AGES)


def _held_from(events: DataFrame) -> DataFrame:
    """node, stream_nr, offset and ``__held``: bytes of an event's payload and of all later ones of its stream.  Sums
    by block of offsets come first, so that a long stream is no task of its own."""
    stream = ["node", "stream_nr"]
    sized = events.select(*stream, "offset", F.floor(F.col("offset") / BLOCK).alias("__block"), F.octet_length(F.to_json("payload")).alias("__size"))
    later = Window.partitionBy(*stream).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sized.groupBy(*stream, "__block").agg(F.sum("__size").alias("__sum")).withColumn("__after", F.coalesce(F.sum("__sum").over(later), F.lit(0)))
    newer = Window.partitionBy(*stream, "__block").orderBy(F.desc("offset"))
    held = sized.withColumn("__own", F.sum("__size").over(newer)).join(blocks.drop("__sum"), [*stream, "__block"])
    return held.select(*stream, "offset", (F.col("__own") + F.col("__after")).alias("__held"))


def retain(events: DataFrame, max_events: int | None = None, max_age: str | None = None, max_size: str | None = None, now: str | None = None) -> DataFrame:
    """What a stream's retention keeps: its last events, those young enough, those that fit; all that are given hold.
    Exact to the event.  Size counts the payload as JSON; the event that passes the limit goes too."""
    out = events
    if max_events is not None:
        top = events.groupBy("node", "stream_nr").agg(F.max("offset").alias("__top"))
        out = out.join(top, ["node", "stream_nr"]).where(F.col("offset") > F.col("__top") - max_events).drop("__top")
    if max_age is not None:
        out = out.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(seconds_of(max_age))))
    if max_size is not None:
        fits = _held_from(events).where(F.col("__held") <= bytes_of(max_size)).drop("__held")
        out = out.join(fits, ["node", "stream_nr", "offset"], "left_semi")
    return out.select(events.columns)
