"""Pipelines over events: stages run in written order, errors become diagnostics, values keep provenance.

An ``EventFrame`` is a DataFrame with hidden columns: ``__key`` and ``__path`` (order: the source event, then the
place among what a stage emitted for it), ``__v`` (the current value), ``__m`` (provenance) and one column for each
binding.  A stage returns a new frame and leaves rows in error to ``diagnostics``.  Catalyst prunes what the result
does not read, provenance included.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import values as V
from .offsets import present
from .tags import Where, all_events

KEY_COLUMNS = ("lamport", "node", "stream_nr", "offset")


@dataclass(frozen=True)
class EventFrame:
    df: DataFrame
    dtype: T.DataType
    names: dict[str, T.DataType] = field(default_factory=dict)
    asked: str | None = None  # explicit order
    wanted: str = "asc"  # order of the request
    failed: tuple[DataFrame, ...] = ()
    outer: tuple[str, ...] = ()  # bindings of an outer query, which outlive AGGREGATE

    # -- sources ---------------------------------------------------------------------------------------

    @staticmethod
    def of(events: DataFrame, where: Where = all_events, order: str | None = None, request: str = "asc", strict: bool = True) -> EventFrame:
        """FROM: the selected events, with their payload as value."""
        key = F.struct(*KEY_COLUMNS).cast(V.KEY)
        meta = F.struct(F.lit(V.EVENT).alias("kind"), key.alias("lo"), key.alias("hi"), F.col("ts").alias("t0"), F.col("ts").alias("t1"), F.col("tags"), F.col("app_id").alias("app"))
        df = where.select(events, strict).select(
            key.alias("__key"), F.array().cast("array<int>").alias("__path"), F.col("payload").alias("__v"), meta.cast(V.META).alias("__m")
        )
        return EventFrame(df, events.schema["payload"].dataType, asked=order, wanted=request)

    @staticmethod
    def of_array(spark, *items) -> EventFrame:
        """FROM [a, ...b]: the elements, as synthetic values in order."""
        cell = V.array(*items).build(V.Scope(None))
        one = spark.range(1).select(F.posexplode(cell.value).alias("__i", "__v"))
        nothing = F.lit(None).cast(V.KEY)
        df = one.select(nothing.alias("__key"), F.array("__i").alias("__path"), "__v", V.shown(()).alias("__m"))
        return EventFrame(df, cell.dtype.elementType)

    # -- helpers ---------------------------------------------------------------------------------------

    def scope(self) -> V.Scope:
        names = {n: V.Cell(F.col(f"__b_{n}"), d, None, (F.col(f"__bm_{n}"),)) for n, d in self.names.items()}
        return V.Scope(V.Cell(F.col("__v"), self.dtype, None, (F.col("__m"),)), names)

    def _bindings(self) -> list[str]:
        return [c for n in self.names for c in (f"__b_{n}", f"__bm_{n}")]

    def _split(self, df: DataFrame, error: Column | None, stage: str) -> tuple[DataFrame, tuple[DataFrame, ...]]:
        """Rows without error, and what failed."""
        if error is None:
            return df, self.failed
        bad = df.where(error.isNotNull()).select(
            "__key", "__path", F.lit(stage).alias("stage"), F.lit("warning").alias("severity"), error.alias("message")
        )
        return df.where(error.isNull()), (*self.failed, bad)

    def order_columns(self, direction: str | None = None) -> list[Column]:
        down = (direction or self.asked or self.wanted) == "desc"
        return [F.desc("__key") if down else F.asc("__key"), F.asc("__path")]

    def preferring(self, direction: str) -> EventFrame:
        """The order that a later stage prefers, unless one was asked for."""
        return self if self.asked else replace(self, wanted=direction)

    # -- stages ----------------------------------------------------------------------------------------

    def filter(self, e: V.Expr) -> EventFrame:
        cell = V.expr(e).build(self.scope())
        error = cell.error
        if cell.kind != "Bool":
            error = V.first_error(error, F.lit(f"{cell.kind} is not a boolean"))
            cell = replace(cell, value=F.lit(False))
        good, failed = self._split(self.df, error, "filter")
        return replace(self, df=good.where(cell.value), failed=failed)

    def select(self, *items) -> EventFrame:
        """One value for each item and input; ``spread(e)`` gives the elements of an array."""
        parts = [(isinstance(x, V.Spread), x.inner if isinstance(x, V.Spread) else V.expr(x)) for x in items]
        cells = [(many, e.build(self.scope())) for many, e in parts]
        if len(cells) == 1 and not cells[0][0]:
            cell = cells[0][1]
            good, failed = self._split(self.df, cell.error, "select")
            df = good.select("__key", "__path", *self._bindings(), cell.value.alias("__v"), V.shown(cell.meta).alias("__m"))
            return replace(self, df=df, dtype=cell.dtype, failed=failed)
        # Each item fails by itself.  Emission: an array of (value, error) for each item, exploded once.
        single = [replace(c, dtype=c.dtype.elementType) if many and c.kind == "Array" else c for many, c in cells]
        kinds = {c.dtype.simpleString() for c in single if c.kind != "Null"}
        texts = len(kinds) > 1 and not all(c.kind in ("Number", "Null") for c in single)
        dtype = T.StringType() if texts else T.DoubleType() if len(kinds) > 1 else next((c.dtype for c in single if c.kind != "Null"), T.NullType())
        out = [_emission(many, c, s, dtype, texts) for (many, c), s in zip(cells, single)]
        exploded = self.df.select("__key", "__path", *self._bindings(), F.posexplode(F.concat(*out)).alias("__i", "__x"))
        good, failed = self._split(exploded.withColumn("__path", F.concat("__path", F.array("__i"))), F.col("__x.e"), "select")
        df = good.select("__key", "__path", *self._bindings(), F.col("__x.v").alias("__v"), F.col("__x.m").alias("__m"))
        return replace(self, df=df, dtype=dtype, failed=failed)

    def let(self, name: str, e: V.Expr) -> EventFrame:
        cell = V.expr(e).build(self.scope())
        good, failed = self._split(self.df, cell.error, "let")
        kept = [c for c in self._bindings() if c not in (f"__b_{name}", f"__bm_{name}")]
        df = good.select("__key", "__path", "__v", "__m", *kept, cell.value.alias(f"__b_{name}"), V.shown(cell.meta).alias(f"__bm_{name}"))
        return replace(self, df=df, names={**{n: d for n, d in self.names.items() if n != name}, name: cell.dtype}, failed=failed)

    def limit(self, n: int) -> EventFrame:
        """The first n values at this point of the pipeline, in its order."""
        if n < 1:
            raise ValueError("LIMIT needs a positive number")
        return replace(self, df=self.df.orderBy(*self.order_columns()).limit(n))

    def aggregate(self, e: V.Expr | dict) -> EventFrame:
        """One value over all inputs: an expression over aggregators."""
        e = V.expr(e)
        aggregators = list(e.aggregates)
        if not aggregators:
            one = self.df.sparkSession.range(1).select(F.lit(None).cast(V.KEY).alias("__key"), F.array().cast("array<int>").alias("__path"))
            return self._aggregated(one, e, {}, self.failed)
        inner = [a.inner.build(self.scope()) for a in aggregators]
        failed = self.failed
        for cell in inner:  # an input in error is left out of that aggregator alone
            failed = replace(self, failed=failed)._split(self.df, cell.error, "aggregate")[1]
        columns, cells = [], {}
        for i, (a, c) in enumerate(zip(aggregators, inner)):
            parts, cell = _aggregation(f"__a{i}", a.name, c)
            columns += parts
            cells[a] = cell
        return self._aggregated(self.df.agg(*columns, F.lit(None).cast(V.KEY).alias("__key")).withColumn("__path", F.array().cast("array<int>")), e, cells, failed)

    def _aggregated(self, one: DataFrame, e: V.Expr, cells: dict, failed: tuple[DataFrame, ...]) -> EventFrame:
        cell = e.build(V.Scope(None, {}, cells))
        good, failed = replace(self, failed=failed)._split(one, cell.error, "aggregate")
        df = good.select("__key", "__path", cell.value.alias("__v"), V.shown(cell.meta).alias("__m"))
        return EventFrame(df, cell.dtype, asked=self.asked, wanted=self.wanted, failed=failed)

    def earliest(self, e: V.Expr) -> EventFrame:
        """AGGREGATE FIRST(e) by one ordered row; for pipelines of filters only, where it gives the same."""
        return replace(self, df=self.df.orderBy(F.asc("__key"), F.asc("__path")).limit(1)).select(e)

    def latest(self, e: V.Expr) -> EventFrame:
        return replace(self, df=self.df.orderBy(F.desc("__key"), F.asc("__path")).limit(1)).select(e)

    # -- results ---------------------------------------------------------------------------------------

    def rows(self, meta: bool = False) -> DataFrame:
        """The values: an object's fields as columns, anything else as ``value``; unordered."""
        shown = [F.col(f"__v.`{n}`").alias(n) for n in self.dtype.names] if isinstance(self.dtype, T.StructType) else [F.col("__v").alias("value")]
        extra = [F.col("__m").alias("meta")] if meta else []
        return self.df.select(*shown, *extra)

    def ordered_rows(self) -> DataFrame:
        by = self.asked or self.wanted
        return replace(self, df=self.df if by == "stream" else self.df.orderBy(*self.order_columns())).rows()

    def diagnostics(self) -> DataFrame:
        """lamport, stage, severity, message of every value that failed."""
        empty = self.df.sparkSession.createDataFrame([], f"__key {V.KEY}, __path array<int>, stage string, severity string, message string")
        out = empty
        for f in self.failed:
            out = f if out is empty else out.unionByName(f)
        return out.select(F.col("__key.lamport").alias("lamport"), F.col("__path").alias("path"), "stage", "severity", "message")

    def response(self, known: DataFrame | None = None) -> DataFrame:
        """Lines of a response: type, lamport, and the line itself as JSON; events in order, then diagnostics, and at last, if
        the known events are given, one line with the highest offset of each stream."""
        event = F.to_json(F.struct(F.lit("event").alias("type"), F.col("__key.lamport").alias("lamport"), F.col("__m.t0").alias("timestamp"), F.col("__m.tags").alias("tags"), F.col("__v").alias("payload")))
        lines = self.df.select(F.lit("event").alias("type"), F.col("__key.lamport").alias("lamport"), F.col("__path").alias("path"), event.alias("line"))
        d = self.diagnostics()
        bad = d.select(F.lit("diagnostic").alias("type"), "lamport", "path", F.to_json(F.struct(F.lit("diagnostic").alias("type"), "severity", "message")).alias("line"))
        out = lines.unionByName(bad)
        if known is None:
            return out
        stream = F.struct(F.concat_ws("-", "node", "stream_nr").alias("key"), F.col("offset").alias("value"))
        one = present(known).agg(F.map_from_entries(F.collect_list(stream)).alias("offsets"))  # an entry for each stream
        line = F.to_json(F.struct(F.lit("offsets").alias("type"), "offsets"))
        return out.unionByName(one.select(F.lit("offsets").alias("type"), F.lit(None).cast("bigint").alias("lamport"), F.lit(None).cast("array<int>").alias("path"), line.alias("line")))


def _emission(many: bool, c: V.Cell, single: V.Cell, dtype: T.DataType, texts: bool) -> Column:
    """What one item of SELECT emits: an array of value, error and provenance."""
    meta, none = V.shown(c.meta), F.lit(None).cast("string")

    def entry(value: Column, error: Column) -> Column:
        return F.struct(value.cast(dtype).alias("v"), error.cast("string").alias("e"), meta.alias("m"))

    def shown(value: Column) -> Column:
        return V.as_text(replace(single, value=value)) if texts else value

    if many and c.kind != "Array":
        return F.array(entry(F.lit(None), V.first_error(c.error, F.lit(f"cannot spread a value of type {c.kind}"))))
    if many:
        elements = F.transform(c.value, lambda x: entry(shown(x), none))
        return elements if c.error is None else F.when(c.error.isNull(), elements).otherwise(F.array(entry(F.lit(None), c.error)))
    value = shown(c.value)
    return F.array(entry(value if c.error is None else F.when(c.error.isNull(), value), none if c.error is None else c.error))


def _aggregation(name: str, kind: str, c: V.Cell) -> tuple[list[Column], V.Cell]:
    """Aggregate columns for one aggregator, and the cell over them."""
    ok = F.lit(True) if c.error is None else c.error.isNull()
    value = c.value if c.error is None else F.when(ok, c.value)
    meta = F.when(ok, V.shown(c.meta))
    n = F.count(F.when(ok, F.lit(1))).alias(f"{name}_n")
    empty = V.when_error(F.col(f"{name}_n") == 0, "no value added")
    out = F.col(f"{name}_v")
    span = F.struct(
        F.max(meta["kind"]).alias("kind"), F.min(meta["lo"]).alias("lo"), F.max(meta["hi"]).alias("hi"), F.min(meta["t0"]).alias("t0"), F.max(meta["t1"]).alias("t1"),
        F.any_value(meta["tags"]).alias("tags"), F.any_value(meta["app"]).alias("app"),
    ).alias(f"{name}_m")
    m = F.col(f"{name}_m")
    one = (m["lo"] == m["hi"]) | m["lo"].isNull()
    joined = F.when(one, m).otherwise(F.struct(
        F.lit(V.RANGE).alias("kind"), m["lo"].alias("lo"), m["hi"].alias("hi"), m["t0"].alias("t0"), m["t1"].alias("t1"),
        F.lit(None).alias("tags"), F.lit(None).alias("app"),
    ).cast(V.META))
    if kind in ("sum", "product"):
        if c.kind == "Bool":
            v = (F.bool_or if kind == "sum" else F.bool_and)(value)
            return [n, v.alias(f"{name}_v"), span], V.Cell(out, T.BooleanType(), empty, (joined,))
        if c.kind != "Number":
            return [n, F.lit(None).alias(f"{name}_v"), span], V.Cell(out, T.LongType(), V.first_error(empty, F.lit(f"incompatible types in {kind}: {c.kind}")), (joined,))
        if c.natural:
            if kind == "product":
                return _natural_product(name, value, [n, span], empty, joined)
            v, most = F.sum(value.cast("decimal(20,0)")), 2**63 - 1
            error = V.first_error(empty, V.when_error(out > F.lit(most).cast("decimal(38,0)"), "integer overflow"))
            return [n, v.alias(f"{name}_v"), span], V.Cell(F.when(error.isNull(), out).cast("bigint"), T.LongType(), error, (joined,))
        v = F.sum(value.cast("double")) if kind == "sum" else F.product(value.cast("double"))
        bad = V.when_error(F.isnan(out) | (F.abs(out) == float("inf")), "floating-point overflow")
        return [n, v.alias(f"{name}_v"), span], V.Cell(out, T.DoubleType(), V.first_error(empty, bad), (joined,))
    fed = F.struct(F.col("__key").alias("k"), F.col("__path").alias("p"))
    back = F.struct(F.struct(*((-F.col(f"__key.{x}")).alias(x) for x in ("lamport", "stream_nr", "offset"))).alias("k"), F.transform("__path", lambda x: -x).alias("p"))
    pair = F.struct(value.alias("v"), meta.alias("m"))
    if kind in ("min", "max"):
        if c.kind not in ("Bool", "Number", "String", "Null"):
            bad = F.lit(f"incompatible types in {kind}: {c.kind}")
            return [n, F.lit(None).alias(f"{name}_x")], V.Cell(F.lit(None), T.NullType(), V.first_error(empty, bad))
        order = F.when(ok, F.struct(value.alias("v"), (fed if kind == "min" else back).alias("f")))
        picked = (F.min_by if kind == "min" else F.max_by)(pair, order)
    else:
        lo, hi = V.shown(c.meta)["lo"], V.shown(c.meta)["hi"]
        order = F.when(ok, F.struct(lo.alias("a"), hi.alias("b"), fed.alias("f"))) if kind == "first" else F.when(ok, F.struct(hi.alias("a"), lo.alias("b"), back.alias("f")))
        picked = (F.min_by if kind == "first" else F.max_by)(pair, order)
    x = F.col(f"{name}_x")
    return [n, picked.alias(f"{name}_x")], V.Cell(x["v"], c.dtype, empty, (x["m"],))


#: Primes whose product is more than twice what the product of naturals as a double can be off by, below 2**63.
PRIMES = (3, 5, 7, 11, 13, 17)


def _natural_product(name: str, value: Column, parts: list[Column], empty: Column, joined: Column) -> tuple[list[Column], V.Cell]:
    """The exact product of naturals, or "integer overflow" from 2**63 on.

    As a double it is known to within 63 roundings, which is less than 2**16; counts of the remainders modulo some primes give the
    exact product's remainder modulo all of them together, and so the one number near the double that it can be.
    """
    columns = [*parts, F.product(value.cast("double")).alias(f"{name}_v"), F.count_if(value == 0).alias(f"{name}_z")]
    whole, rest = math.prod(PRIMES), F.lit(0).cast("bigint")
    times = lambda p: lambda a, x: a * x % p
    for p in PRIMES:
        columns += [F.count_if(value % p == r).alias(f"{name}_{p}_{r}") for r in range(p) if r != 1]
        mod = F.lit(1).cast("bigint")
        for r in range(2, p):
            power = F.aggregate(F.array_repeat(F.lit(r), (F.col(f"{name}_{p}_{r}") % (p - 1)).cast("int")), F.lit(1).cast("bigint"), times(p))
            mod = mod * power % p
        mod = F.when(F.col(f"{name}_{p}_0") > 0, 0).otherwise(mod)
        rest = rest + mod * (whole // p * pow(whole // p, -1, p) % whole)
    near = F.when(F.col(f"{name}_v") < 2.0**64, F.col(f"{name}_v")).cast("decimal(38,0)")
    off = (rest.cast("decimal(38,0)") - near) % whole  # between -whole and whole
    off = F.when(off > whole // 2, off - whole).when(off < -(whole // 2), off + whole).otherwise(off)
    exact = F.when(F.col(f"{name}_z") > 0, F.lit(0).cast("decimal(38,0)")).otherwise((near + off).cast("decimal(38,0)"))
    error = V.first_error(empty, V.when_error(exact.isNull() | (exact > F.lit(2**63 - 1).cast("decimal(38,0)")), "integer overflow"))
    return columns, V.Cell(F.when(error.isNull(), exact).cast("bigint"), T.LongType(), error, (joined,))


def implied_order(e: V.Expr) -> str | None:
    """The order that an AGGREGATE prefers: only LAST, descending; only FIRST, ascending."""
    kinds = {a.name for a in e.aggregates}
    return "desc" if kinds == {"last"} else "asc" if kinds == {"first"} else None


def limited_aggregate(frame: EventFrame, n: int, e: V.Expr | dict) -> EventFrame:
    """LIMIT n AGGREGATE e, with the order that e prefers unless the frame has one (it changes which n count)."""
    e = V.expr(e)
    wanted = implied_order(e)
    return (frame.preferring(wanted) if wanted else frame).limit(n).aggregate(e)


def running_limit(frame: EventFrame, n: int, by: list[str]) -> EventFrame:
    """LIMIT n within each group of bindings, as a sub-query for each group has it."""
    order = Window.partitionBy(*(f"__b_{b}" for b in by)).orderBy(*frame.order_columns())
    ranked = frame.df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")
    return replace(frame, df=ranked)
