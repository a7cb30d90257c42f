"""Subscriptions that keep their state in tables: one plan a micro-batch, nothing row by row.

``Subscription`` runs a step for what is known (the catch-up) and then for every micro-batch of a stream.  A step gets the batch
and the state so far and gives the new state, in which the lines to say are held; both are written in one job under the number of
the batch in the shared folder, so that a batch that is run again after a failure overwrites what it wrote before.

Steps:

``aggregating``   one aggregate, or several one after another, of each group: after a batch that changes a result, an
                  ``antiEvent`` with the old one and an ``event`` with the new one.  A later aggregate takes what the one
                  before it says: an antiEvent is an anti-input.  Sums and products invert; an anti-input ends others with a
                  ``diagnostic`` of severity error, after which the group says nothing more.  What a batch feeds into a group is
                  summed up where its rows are, so a group of any size costs one row a partition.
``limiting``      LIMIT n of each group, in order of key; an anti-input gives one back unless all are used up.
``monotonic``     events in order of key.  One at or below the last key passed gives ``timeTravel`` with the earliest such key,
                  and the subscription ends.  The last event of each batch is marked ``caught_up``.
``chunking``      each batch in order of key, cut into chunks of so many events at most; events of one chunk share ``seq``.  The
                  trigger's interval is the longest that an event waits for its chunk.

A group stands for a subscription of its own; a query over everything has one group.  State is one row a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.offsets import OffsetMap, chunks, present, within

KEY = ("lamport", "node", "stream_nr")
INVERTIBLE = ("sum", "product")
#: Lines that a batch can say of one group, at most, for numbering them.
LINES = 1 << 20

Step = Callable[[DataFrame, DataFrame | None, int], DataFrame]


@dataclass(frozen=True)
class Aggregate:
    """One aggregate of a chain; ``of`` makes its input from the value it is fed."""

    kind: str  # sum, product, min, max, first, last
    of: Callable[[Column], Column] = lambda v: v


class Subscription:
    """A step over all batches so far, under a path in the shared folder."""

    def __init__(self, path: str, step: Step):
        self.path, self.step = path, step
        self._schema: T.StructType | None = None  # of what a batch writes, once there was one
        self._written: tuple[Column, list[Column]] | None = None  # the columns that write it

    def _place(self, spark, version: int, name: str):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/taken/version={version}/{name}")
        return place.getFileSystem(spark._jsc.hadoopConfiguration()), place

    def _forget(self, spark, version: int) -> None:
        """Deletes a state that no batch can need any more."""
        files, place = self._place(spark, version, "held=state")
        files.delete(place, True)

    def _state(self, spark, version: int) -> DataFrame | None:
        for name in ("_SUCCESS", "held=state"):
            files, place = self._place(spark, version, name)
            if version < 0 or not files.exists(place):
                return None
        reader = spark.read.schema(self._schema) if self._schema is not None else spark.read
        return reader.parquet(f"{self.path}/taken/version={version}/held=state")

    def _take(self, batch: DataFrame, version: int) -> None:
        """Writes the new state, and beside it the lines of the groups that say something, in one job.  Rows that a step marks as
        ``passing`` only say something: they are no state."""
        spark = batch.sparkSession
        new = self.step(batch, self._state(spark, version - 1), version)
        if self._written is None or self._schema != new.schema:
            state, said = F.lit("state"), F.lit("said")
            of = lambda c: F.col(c) if c in ("grp", "touched") else F.when(F.col("held") == (said if c == "lines" else state), F.col(c)).alias(c)
            passing = F.col("passing") if "passing" in new.columns else F.lit(False)
            says = F.when(passing, F.array(said)).when(F.col("touched") & (F.size("lines") > 0), F.array(state, said)).otherwise(F.array(state))
            self._schema, self._written = new.schema, (F.explode(says).alias("held"), [*(of(c) for c in new.columns), F.col("held")])
        held, columns = self._written
        new.select("*", held).select(*columns).write.mode("overwrite").partitionBy("held").parquet(f"{self.path}/taken/version={version}")
        if version > 1:
            self._forget(spark, version - 2)

    def catch_up(self, known: DataFrame, lower: OffsetMap | None = None) -> OffsetMap:
        """Takes the known events above lower, and gives the offsets from which the live part goes on: those of all known events
        and lower together."""
        self._take(within(known, lower=lower), 0)
        here = OffsetMap({(r["node"], r["stream_nr"]): r["offset"] for r in present(known).collect()})  # a row for each stream
        return here | lower if lower is not None else here

    def _start(self, stream: DataFrame, after: OffsetMap | None, **trigger):
        rows = within(stream, lower=after) if after is not None else stream
        out = rows.writeStream.foreachBatch(lambda batch, number: self._take(batch, number + 1)).option("checkpointLocation", f"{self.path}/checkpoint")
        return (out.trigger(**trigger) if trigger else out).start()

    def run(self, stream: DataFrame, after: OffsetMap | None = None) -> DataFrame:
        """Takes what is in the stream now, from where it was left; of each stream of events, what lies after the given
        offsets.  Gives all that was said so far."""
        self._start(stream, after, availableNow=True).awaitTermination()
        return self.said(stream.sparkSession)

    def follow(self, stream: DataFrame, arrivals: Iterable[object], after: OffsetMap | None = None) -> DataFrame:
        """As run, but stays with the stream while events come: after each arrival, takes what has come into the stream."""
        followed(self._start(stream, after), arrivals)
        return self.said(stream.sparkSession)

    def said(self, spark) -> DataFrame:
        reader = spark.read.option("mergeSchema", "false")
        if self._schema is not None:
            reader = reader.schema(T.StructType([*self._schema, T.StructField("held", T.StringType()), T.StructField("version", T.LongType())]))
        lines = reader.parquet(f"{self.path}/taken").where("held = 'said'").select("grp", "version", F.explode("lines").alias("line")).select("grp", "version", "line.*")
        seq = (F.col("version").cast("bigint") * LINES + F.col("pos")).alias("seq")
        return lines.select("grp", seq, *(c for c in lines.columns if c not in ("grp", "version", "pos")))


def _key(prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + k).alias(k) for k in KEY))


def _wide(kind: str, dtype: T.DataType) -> T.DataType:
    """The type of an aggregate of values of a type."""
    if kind in INVERTIBLE and not isinstance(dtype, T.BooleanType):
        return T.DecimalType(38, 0) if kind == "sum" and isinstance(dtype, (T.IntegralType, T.DecimalType)) else T.DoubleType()
    return dtype


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def aggregating(*chain: Aggregate) -> Step:
    """For batches of (grp, lamport, node, stream_nr, value, anti)."""

    def made(batch: DataFrame, known: bool) -> tuple[list[Column], list[list[Column]], list[Column]]:
        """What a batch is summed up by, the columns to add one list after another, and the new state of a group; known: there is a
        state already.  What a later expression uses more than once is a column, so that a plan grows no faster than the chain."""
        types, kind = [], batch.schema["value"].dataType
        for a in chain:
            kind = _wide(a.kind, batch.select(a.of(F.lit(None).cast(kind)).alias("x")).schema["x"].dataType)
            types.append(kind)
        first = chain[0]
        # Of truth values, a sum is true while some TRUE is left, a product while no FALSE is: z counts what decides.
        logical = [a.kind in INVERTIBLE and isinstance(t, T.BooleanType) for a, t in zip(chain, types)]
        decides = lambda a, x: F.when(x == F.lit(a.kind == "sum"), 1).otherwise(0)
        value = first.of(F.col("value"))
        wide = value.cast(types[0])
        plus, minus = ~F.col("anti"), F.col("anti")
        pick = F.min_by if first.kind in ("first", "min") else F.max_by
        order = F.when(plus & value.isNotNull(), _order(first.kind, value, _key()))
        fed = [
            F.count_if(plus).alias("pos"), F.count_if(minus).alias("neg"),
            *([F.sum(F.when(minus, -decides(first, value)).otherwise(decides(first, value))).alias("decided")] if logical[0] else []),
            *([F.sum(F.when(minus, -wide).otherwise(wide)).cast(types[0]).alias("sum")] if first.kind == "sum" and not logical[0] else []),
            *([F.product(F.when(plus & (wide != 0), wide)).alias("times"), F.product(F.when(minus & (wide != 0), wide)).alias("over"),
               F.sum(F.when(wide == 0, F.when(minus, -1).otherwise(1)).otherwise(0)).alias("zeros")] if first.kind == "product" and not logical[0] else []),
            *([pick(value, order).alias("best"), pick(_key(), order).alias("at")] if first.kind not in INVERTIBLE else []),
        ]
        has = lambda name: F.col(name) if known else F.lit(None)
        touched = F.col("pos").isNotNull()
        dead = F.coalesce(has("dead").cast("boolean"), F.lit(False))
        live = touched & ~dead
        stages: list[list[Column]] = []
        columns: dict[str, Column] = {}
        lines: list[Column] = []
        line = lambda pos, type_, value, severity=None, message=None: F.struct(
            F.lit(pos).alias("pos"), F.lit(type_).alias("type"), value.cast(types[-1]).alias("value"), F.lit(severity).cast("string").alias("severity"), F.lit(message).cast("string").alias("message")
        )
        none = F.lit(None)
        pos, neg = (F.coalesce(x, F.lit(0)) for x in ("pos", "neg"))
        new_value = old_value = at = None  # what the aggregate before says and takes back
        failed = F.lit(False)
        for i, a in enumerate(chain):
            key_type = "struct<lamport:bigint,node:string,stream_nr:bigint>"
            n0, v0 = F.coalesce(has(f"n{i}").cast("bigint"), F.lit(0)), has(f"v{i}").cast(types[i])
            z0, k0, said0 = F.coalesce(has(f"z{i}").cast("bigint"), F.lit(0)), has(f"at{i}").cast(key_type), has(f"said{i}").cast(types[i])
            if i:
                pos, neg = (F.when(x.isNotNull(), 1).otherwise(0) for x in (new_value, old_value))
            n = n0 + pos - neg
            z, key, result = z0, k0, lambda v, z: v
            if logical[i]:
                z = z0 + (F.coalesce("decided", F.lit(0)) if not i else F.when(pos > 0, decides(a, a.of(new_value))).otherwise(0) - F.when(neg > 0, decides(a, a.of(old_value))).otherwise(0))
                v, result = v0, lambda v, z, some=F.lit(a.kind == "sum"): (z > 0) == some
            elif a.kind == "sum":
                gain = F.col("sum") if not i else F.coalesce(F.when(pos > 0, a.of(new_value)).cast(types[i]), F.lit(0)) - F.coalesce(F.when(neg > 0, a.of(old_value)).cast(types[i]), F.lit(0))
                v = (F.coalesce(v0, F.lit(0)) + F.coalesce(gain, F.lit(0))).cast(types[i])
            elif a.kind == "product":
                if i:
                    x, y = (F.when(c > 0, a.of(w)).cast("double") for c, w in ((pos, new_value), (neg, old_value)))
                    times, over = F.when(x != 0, x), F.when(y != 0, y)
                    zeros = F.coalesce(F.when(x == 0, 1), F.lit(0)) - F.coalesce(F.when(y == 0, 1), F.lit(0))
                else:
                    times, over, zeros = F.col("times"), F.col("over"), F.coalesce("zeros", F.lit(0))
                z = z0 + zeros
                v = F.coalesce(v0, F.lit(1.0)) * F.coalesce(times, F.lit(1.0)) / F.coalesce(over, F.lit(1.0))
                result = lambda v, z: F.when(z > 0, 0.0).otherwise(v)
            else:
                best, place = (F.col("best"), F.col("at")) if not i else (F.when(pos > 0, a.of(new_value)), at)
                own, other = _order(a.kind, best, place), _order(a.kind, v0, k0)
                better = best.isNotNull() & (v0.isNull() | (own < other if a.kind in ("first", "min") else own > other))
                v, key = F.when(better, best).otherwise(v0), F.when(better, place).otherwise(k0)
            bad = live & ~failed & (neg > 0) & F.lit(a.kind not in INVERTIBLE)
            stages.append([n.alias(f"__n{i}"), z.alias(f"__z{i}"), v.cast(types[i]).alias(f"__v{i}"), key.alias(f"__at{i}"), bad.alias(f"__bad{i}"), (live & ~failed & ~bad).alias(f"__going{i}")])
            n, z, v, key, bad, going = (F.col(f"__{x}{i}") for x in ("n", "z", "v", "at", "bad", "going"))
            now = F.when(n > 0, result(v, z))
            changed = going & ~_same(now, said0)
            stages.append([F.when(changed, now).alias(f"__new{i}"), F.when(changed, said0).alias(f"__old{i}")])
            keep = lambda new, was: F.when(going, new).otherwise(was)
            columns |= {f"n{i}": keep(n, n0), f"v{i}": keep(v, v0).cast(types[i]), f"z{i}": keep(z, z0), f"at{i}": keep(key, k0).cast(key_type), f"said{i}": keep(now, said0).cast(types[i])}
            lines.append(F.when(bad, line(4 * i, "diagnostic", none, "error", f"anti-input cannot be processed in {a.kind.upper()}()")))
            lines.append(F.when(going & (n <= 0), line(4 * i + 1, "diagnostic", none, "warning", "no value added")))
            failed = failed | bad
            new_value, old_value, at = F.col(f"__new{i}"), F.col(f"__old{i}"), key
        lines.append(F.when(old_value.isNotNull(), line(4 * len(chain), "antiEvent", old_value)))
        lines.append(F.when(new_value.isNotNull(), line(4 * len(chain) + 1, "event", new_value)))
        return fed, stages, [F.col("grp"), (dead | (live & failed)).alias("dead"), touched.alias("touched"), *(c.alias(name) for name, c in columns.items()), F.array_compact(F.array(*lines)).alias("lines")]

    held = [f"{x}{i}" for i in range(len(chain)) for x in ("n", "v", "z", "at", "said")]
    kept: dict[tuple[str, bool], tuple[list[Column], list[list[Column]], list[Column]]] = {}

    def step(batch: DataFrame, before: DataFrame | None, version: int) -> DataFrame:
        case = (batch.schema["value"].dataType.simpleString(), before is not None)
        if case not in kept:  # the same for every batch
            kept[case] = made(batch, before is not None)
        fed, stages, columns = kept[case]
        rows = batch.groupBy("grp").agg(*fed)
        if before is not None:
            rows = rows.join(before.select("grp", "dead", *held), "grp", "full")
        for stage in stages:
            rows = rows.select("*", *stage)
        return rows.select(*columns)

    return step


def _order(kind: str, value: Column, key: Column) -> Column:
    """What is least (first, min) or greatest (last, max) for the value that an aggregate takes; of equal values the earlier."""
    if kind in ("first", "last"):
        return F.struct(key.alias("k"))
    return F.struct(value.alias("v"), (-key["lamport"] if kind == "max" else key["lamport"]).alias("l"))


def limiting(n: int) -> Step:
    """For batches of (grp, lamport, node, stream_nr, value, anti)."""

    def step(batch: DataFrame, before: DataFrame | None, version: int) -> DataFrame:
        value = batch.schema["value"].dataType.simpleString()
        antis = batch.where("anti").groupBy("grp").agg(F.count("*").alias("antis"))
        rank = F.row_number().over(Window.partitionBy("grp", "anti").orderBy(*KEY))
        # No more than the first n, and one for each anti-input, can pass.
        rows = batch.withColumn("r", rank).join(antis, "grp", "left").where(F.col("anti") | (F.col("r") <= n + F.coalesce("antis", F.lit(0))))
        fed = rows.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct(*KEY, "value", "anti"))).alias("rows"))
        if before is not None:
            fed = fed.join(before.select("grp", "left", "dead"), "grp", "full")
        else:
            fed = fed.select("grp", "rows", F.lit(None).cast("int").alias("left"), F.lit(None).cast("boolean").alias("dead"))

        def of(batches):
            for pdf in batches:
                out = []
                for grp, rows, left, dead in zip(pdf["grp"], pdf["rows"], pdf["left"], pdf["dead"]):
                    left, dead, lines = n if pd.isna(left) else int(left), False if pd.isna(dead) else bool(dead), []
                    for r in rows if rows is not None else ():
                        if dead:
                            break
                        if r["anti"] and left == 0:
                            dead = True
                            lines.append((len(lines), "diagnostic", None, None, "error", "anti-input cannot be processed in saturated LIMIT"))
                        elif r["anti"] or left > 0:
                            left += 1 if r["anti"] else -1
                            lines.append((len(lines), "antiEvent" if r["anti"] else "event", r["lamport"], r["value"], None, None))
                    out.append((grp, left, dead, rows is not None, [dict(zip(("pos", "type", "lamport", "value", "severity", "message"), x)) for x in lines]))
                yield pd.DataFrame(out, columns=["grp", "left", "dead", "touched", "lines"])

        line = f"struct<pos:int,type:string,lamport:bigint,value:{value},severity:string,message:string>"
        return fed.mapInPandas(of, f"grp string, left int, dead boolean, touched boolean, lines array<{line}>")

    return step


def monotonic(latest: tuple[int, str, int] | None = None) -> Step:
    """For batches of (lamport, node, stream_nr, value): lines of type event or timeTravel.  latest: the last key of what a
    caller has already."""

    def step(batch: DataFrame, before: DataFrame | None, version: int) -> DataFrame:
        key = _key()
        kind = "struct<lamport:bigint,node:string,stream_nr:bigint>"
        ends = batch.agg(F.min(key).alias("low"), F.max(key).alias("high"))
        ends = ends.crossJoin(F.broadcast(before.where("grp = 'clock'").select("at", "over"))).first() if before is not None else ends.first()  # one row
        at, over = (ends["at"], ends["over"]) if before is not None else (latest, False)
        none = F.lit(None).cast(kind)
        clock = none if at is None else F.struct(*(F.lit(x).alias(k) for k, x in zip(KEY, at))).cast(kind)
        late = at is not None and ends["low"] is not None and tuple(ends["low"]) <= tuple(at)
        value = batch.schema["value"].dataType
        line = lambda type_, caught: F.array(F.struct(F.lit(0).alias("pos"), F.lit(type_).alias("type"), *KEY, F.col("value").cast(value).alias("value"), caught.alias("caught_up")))
        said = batch.limit(0) if over else batch.orderBy(*KEY).limit(1) if late else batch
        high = F.struct(*(F.lit(x).alias(k) for k, x in zip(KEY, ends["high"] or (None,) * 3))).cast(kind)
        lines = line("timeTravel", F.lit(False)) if late else line("event", key == high)
        rows = said.select(F.lit("line").alias("grp"), none.alias("at"), F.lit(False).alias("over"), F.lit(True).alias("touched"), F.lit(True).alias("passing"), lines.alias("lines"))
        after = clock if ends["high"] is None or late or over else high
        row = batch.sparkSession.range(1).select(F.lit("clock").alias("grp"), after.alias("at"), F.lit(bool(over or late)).alias("over"), F.lit(False).alias("touched"), F.lit(False).alias("passing"), F.lit(None).cast(rows.schema["lines"].dataType).alias("lines"))
        return rows.unionByName(row)

    return step


def chunking(size: int = 1000) -> Step:
    """For batches of (lamport, node, stream_nr, offset, value).  A batch without events gives no chunk."""
    if size < 1:
        raise ValueError("a chunk has at least one event")

    def step(batch: DataFrame, before: DataFrame | None, version: int) -> DataFrame:
        line = F.struct(F.col("chunk").cast("int").alias("pos"), F.lit("event").alias("type"), *KEY, "offset", "value")
        return chunks(batch, size).select(F.lit("chunk").alias("grp"), F.lit(True).alias("touched"), F.lit(True).alias("passing"), F.array(line).alias("lines"))

    return step


def delivered_bounds(said: DataFrame) -> DataFrame:
    """seq, node, stream_nr, and the offsets (lower exclusive, upper inclusive) of each delivered chunk's part of a stream."""
    return said.groupBy("seq", "node", "stream_nr").agg((F.min("offset") - 1).alias("lower"), F.max("offset").alias("upper"), F.count("*").alias("events"))


def time_travel_before(events: DataFrame, known: OffsetMap, latest: tuple[int, str, int]) -> DataFrame:
    """lamport, node, stream_nr of the earliest event that known does not hold and that lies at or below the key a caller has
    reached; no row if there is none.  A subscription that goes on from a cached state asks this first."""
    at = F.struct(*(F.lit(x).alias(k) for k, x in zip(KEY, latest))).cast("struct<lamport:bigint,node:string,stream_nr:bigint>")
    new = within(events, lower=known).where(_key() <= at)
    return new.agg(F.min(_key()).alias("k")).where(F.col("k").isNotNull()).select("k.*")


def followed(query, arrivals: Iterable[object]) -> None:
    """Lets a running query take what is there, and then each arrival before the next one comes; ends it after the last."""
    try:
        query.processAllAvailable()
        for _ in arrivals:
            query.processAllAvailable()
    finally:
        query.stop()


def run_to_table(stream: DataFrame, checkpoint: str, path: str, arrivals: Iterable[object] | None = None) -> DataFrame:
    """Runs a stream without state into Parquet files, over all that is there now or over arrivals one after another, and gives what
    it said in all runs with this checkpoint."""
    out = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if arrivals is None:
        out.trigger(availableNow=True).start().awaitTermination()
    else:
        followed(out.start(), arrivals)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
