"""Observers: earliest, latest, best match, folds, and snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _whole(events: DataFrame) -> Column:
    return F.struct(*events.columns)


def _by(timestamps: bool) -> Column:
    key = ["lamport", "node", "stream_nr"]
    return F.struct("ts", *key) if timestamps else F.struct(*key)


def earliest(events: DataFrame, timestamps: bool = False) -> DataFrame:
    """The first event, by key or by (time, key)."""
    return events.agg(F.min_by(_whole(events), _by(timestamps)).alias("e")).where(F.col("e").isNotNull()).select("e.*")


def latest(events: DataFrame, timestamps: bool = False) -> DataFrame:
    return events.agg(F.max_by(_whole(events), _by(timestamps)).alias("e")).where(F.col("e").isNotNull()).select("e.*")


def latest_by(events: DataFrame, entity: Column, timestamps: bool = False) -> DataFrame:
    """The last event of each entity."""
    rows = events.withColumn("entity", entity)
    return rows.groupBy("entity").agg(F.max_by(_whole(events), _by(timestamps)).alias("e")).select("entity", "e.*")


def best(events: DataFrame, score: Column) -> DataFrame:
    """The event with the highest score; of equals the first."""
    first = F.struct(score.alias("s"), (-F.col("lamport")).alias("l"))
    return events.where(score.isNotNull()).agg(F.max_by(_whole(events), first).alias("e")).where(F.col("e").isNotNull()).select("e.*")


def fold(events: DataFrame, reduce: Callable[[object, pd.DataFrame], object], combine: Callable[[object, object], object], initial: object, result: str) -> DataFrame:
    """An unordered reduction by user code: each partition folds its batches, and the partitions' results, one
    each, are combined at the end."""

    def part(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = initial
        for batch in batches:
            state = reduce(state, batch)
        yield pd.DataFrame({"state": [state]})

    def whole(states: pd.DataFrame) -> pd.DataFrame:
        state = initial
        for s in states["state"]:
            state = combine(state, s)
        return pd.DataFrame({"state": [state]})

    schema = T.StructType([T.StructField("state", T._parse_datatype_string(result))])
    partial = events.mapInPandas(part, schema)
    return partial.withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(lambda pdf: whole(pdf), schema)


def named_state(events: DataFrame, name: Column, added: Column) -> DataFrame:
    """A naming service: for each name the last word on it; names whose last event removes them are gone."""
    rows = events.withColumn("name", name).withColumn("__added", added).where(F.col("name").isNotNull())
    last = rows.groupBy("name").agg(F.max_by(F.struct("__added", "payload"), F.struct("lamport", "node", "stream_nr")).alias("s"), F.max("lamport").alias("lamport"))
    return last.where(F.col("s.__added")).select("name", "lamport", F.col("s.payload").alias("payload"))


def newest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Of each (semantics, entity) the snapshots of the newest version, and of these the one with the latest key."""
    pick = F.max_by(F.struct(*snapshots.columns), F.struct("version", "lamport"))
    return snapshots.groupBy("semantics", "entity").agg(pick.alias("s")).select("s.*")


def valid_snapshots(snapshots: DataFrame, changed_from: DataFrame) -> DataFrame:
    """Snapshots below the key from which their entity's past has changed (semantics, entity, lamport)."""
    changed = changed_from.select("semantics", "entity", F.col("lamport").alias("__from"))
    joined = snapshots.join(changed, ["semantics", "entity"], "left")
    return joined.where(F.col("__from").isNull() | (F.col("lamport") < F.col("__from"))).drop("__from")
