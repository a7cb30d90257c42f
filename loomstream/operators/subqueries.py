"""Sub-queries as joins.

A sub-query runs for each row of an outer frame.  Where it selects by a tag computed from the row, the join is an
equality on that tag (the inner events' tags exploded once, and of these only the ones that begin as the computed tag does);
other conditions are residual.  If the tag is all that a sub-query takes from the row, the inner side is grouped by tag first, and
each row looks its result up.  Results come back as an array in event order, as rows, as one aggregate, or as a test of existence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import values as V
from .frame import EventFrame

#: Ranges of values that are summed in tasks of their own.
RANGES = 64


def _outer(outer: EventFrame) -> DataFrame:
    return outer.df.withColumn("__row", F.struct("__key", "__path"))


def _tags_like(tags: Column, e: V.Expr) -> Column:
    """Those tags that the computed tag can be."""
    return F.filter(tags, lambda t: t.startswith(e.prefix)) if e.prefix else tags


def _by_tag(outer: EventFrame, inner: EventFrame, on_tags: tuple, where, value: V.Expr) -> tuple[DataFrame, Column, V.Cell] | None:
    """The inner side with ``__it`` for each tag that can be asked for, the outer row's tag, and the cell of value; None if the
    sub-query takes more from the row than its tag."""
    if len(on_tags) != 1 or where is not None:
        return None
    try:
        cell = value.build(V.Scope(inner.scope().it, inner.scope().names))
    except KeyError:  # a binding of the outer query
        return None
    tag = V.expr(on_tags[0])
    rows = inner.df.withColumn("__it", F.explode(_tags_like(F.col("__m")["tags"], tag)))
    return rows, as_column(outer, tag), cell


def _looked_up(outer: EventFrame, found: DataFrame, tag: Column) -> DataFrame:
    """Outer rows with ``__found`` of their tag, null where there is none."""
    return outer.df.withColumn("__tag", tag).join(found.withColumnRenamed("__it", "__tag"), "__tag", "left")


def _bound(outer: EventFrame, rows: DataFrame, name: str, dtype: T.DataType) -> EventFrame:
    kept = [c for c in outer._bindings() if c not in (f"__b_{name}", f"__bm_{name}")]
    df = rows.select("__key", "__path", "__v", "__m", *kept, F.col("__found").alias(f"__b_{name}"), F.col("__m").alias(f"__bm_{name}"))
    return replace(outer, df=df, names={**outer.names, name: dtype})


def _matched(outer: EventFrame, inner: EventFrame, on_tags: list[V.Expr], where: Callable[[V.Scope, V.Scope], V.Expr] | None) -> tuple[DataFrame, V.Scope]:
    """Outer row with each inner event that its tags (all of them) and the condition select; columns of the inner
    event are ``__i_*``, its frame's names are in the scope."""
    keys = [V.expr(e).build(outer.scope()) for e in on_tags]
    left = _outer(outer)
    for i, c in enumerate(keys):
        left = left.withColumn(f"__t{i}", c.value if c.error is None else F.when(c.error.isNull(), c.value))
    bindings = {n: d for n, d in inner.names.items()}
    right = inner.df.select(
        F.col("__key").alias("__ikey"), F.col("__path").alias("__ipath"), F.col("__v").alias("__iv"), F.col("__m").alias("__im"),
        *(F.col(f"__b_{n}").alias(f"__ib_{n}") for n in bindings), *(F.col(f"__bm_{n}").alias(f"__ibm_{n}") for n in bindings),
    )
    scope = V.Scope(
        V.Cell(F.col("__iv"), inner.dtype, None, (F.col("__im"),)),
        {**outer.scope().names, "outer": outer.scope().it, **{n: V.Cell(F.col(f"__ib_{n}"), d, None, (F.col(f"__ibm_{n}"),)) for n, d in bindings.items()}},
    )
    residual = None
    if where is not None:
        c = where.build(scope) if isinstance(where, V.Expr) else V.expr(where(scope)).build(scope)
        residual = c.value if c.error is None else c.error.isNull() & c.value
    if keys:
        right = right.withColumn("__it", F.explode(_tags_like(F.col("__im.tags"), on_tags[0])))
        on = F.col("__t0") == F.col("__it")
        for i in range(1, len(keys)):
            on = on & F.array_contains(F.col("__im.tags"), F.col(f"__t{i}"))
        joined = left.join(right, on if residual is None else on & residual, "inner")
    else:  # no equality: the condition alone, evaluated as a nested loop over a side that Spark chooses
        joined = left.join(right, residual if residual is not None else F.lit(True), "inner")
    return joined, scope


def nest(outer: EventFrame, name: str, inner: EventFrame, on_tags: tuple = (), where=None, select: V.Expr | None = None, limit: int | None = None) -> EventFrame:
    """Binds name to the array of the sub-query's values, in event order; empty where nothing matches.  The first
    error among the values, in that order, is the row's error, which goes to the diagnostics."""
    if (quick := _by_tag(outer, inner, on_tags, where, V.it if select is None else V.expr(select))) is not None:
        return _nest_by_tag(outer, name, inner, *quick, limit)
    joined, scope = _matched(outer, inner, [V.expr(t) for t in on_tags], where)
    cell = (V.it if select is None else V.expr(select)).build(scope)
    by = Window.partitionBy("__row").orderBy(F.asc("__ikey") if (inner.asked or "asc") != "desc" else F.desc("__ikey"), "__ipath")
    if limit is not None:
        joined = joined.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= limit)
    order = F.struct(F.col("__ikey").alias("k"), F.col("__ipath").alias("p"))
    entry = F.struct(order.alias("o"), cell.value.alias("v"), (F.lit(None).cast("string") if cell.error is None else cell.error).alias("e"))
    found = joined.groupBy(F.col("__row").alias("__frow")).agg(F.sort_array(F.collect_list(entry), (inner.asked or "asc") != "desc").alias("__found"))
    rows = _outer(outer).join(found, F.col("__row") == F.col("__frow"), "left")
    elements = F.transform(F.coalesce("__found", F.array()), lambda x: x["v"])
    error = F.get(F.filter(F.col("__found"), lambda x: x["e"].isNotNull()), F.lit(0))["e"]
    good, failed = outer._split(rows, error if cell.error is not None else None, "sub-query")
    kept = [c for c in outer._bindings() if c not in (f"__b_{name}", f"__bm_{name}")]
    df = good.select("__key", "__path", "__v", "__m", *kept, elements.alias(f"__b_{name}"), F.col("__m").alias(f"__bm_{name}"))
    return replace(outer, df=df, names={**outer.names, name: T.ArrayType(cell.dtype)}, failed=failed)


def _nest_by_tag(outer: EventFrame, name: str, inner: EventFrame, rows: DataFrame, tag: Column, cell: V.Cell, limit: int | None) -> EventFrame:
    down = (inner.asked or "asc") == "desc"
    if limit is not None:
        by = Window.partitionBy("__it").orderBy(F.desc("__key") if down else F.asc("__key"), "__path")
        rows = rows.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= limit)
    entry = F.struct(F.struct(F.col("__key").alias("k"), F.col("__path").alias("p")).alias("o"), cell.value.alias("v"), (F.lit(None).cast("string") if cell.error is None else cell.error).alias("e"))
    found = rows.groupBy("__it").agg(F.sort_array(F.collect_list(entry), not down).alias("__found"))
    joined = _looked_up(outer, found, tag)
    error = F.get(F.filter(F.col("__found"), lambda x: x["e"].isNotNull()), F.lit(0))["e"]
    good, failed = outer._split(joined, error if cell.error is not None else None, "sub-query")
    good = good.withColumn("__found", F.transform(F.coalesce("__found", F.array()), lambda x: x["v"]))
    return replace(_bound(outer, good, name, T.ArrayType(cell.dtype)), failed=failed)


def nest_uncorrelated(outer: EventFrame, name: str, inner: EventFrame) -> EventFrame:
    """Binds name to the values of a query that does not look at the row: computed once, one row to join."""
    entry = F.struct(F.col("__key").alias("k"), F.col("__path").alias("p"), F.col("__v").alias("v"))
    one = inner.df.agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["v"]).alias(f"__b_{name}"))
    df = outer.df.crossJoin(F.broadcast(one)).withColumn(f"__bm_{name}", F.col("__m"))  # one row
    return replace(outer, df=df, names={**outer.names, name: T.ArrayType(inner.dtype)})


def nest_array(outer: EventFrame, name: str, items: tuple, where: V.Expr | None = None, select: V.Expr | None = None, limit: int | None = None) -> EventFrame:
    """Binds name to the values of a sub-query over an array of the row, ``FROM [a, ...b] FILTER where SELECT select LIMIT limit``;
    ``outer`` is the row's own value.  It stays inside the row: no join.  The first error, up to the last value that
    the limit lets through, is the row's error."""
    source = V.array(*items).build(outer.scope())
    of = source.dtype.elementType if isinstance(source.dtype, T.ArrayType) else T.NullType()
    condition, chosen = V.lit(True) if where is None else V.expr(where), V.it if select is None else V.expr(select)

    def cells(x: Column) -> tuple[V.Cell, V.Cell]:
        scope = V.Scope(V.Cell(x, of, None, source.meta), {**outer.scope().names, "outer": outer.scope().it})
        c, v = condition.build(scope), chosen.build(scope)
        return (c if c.kind == "Bool" else replace(c, value=F.lit(False), error=V.first_error(c.error, F.lit(f"{c.kind} is not a boolean")))), v

    def judged(x: Column) -> Column:
        c, v = cells(x)
        wrong, error = (F.lit(None).cast("string") if e is None else e for e in (c.error, v.error))
        passes = wrong.isNull() & F.coalesce(c.value, F.lit(False))
        return F.struct((wrong.isNotNull() | passes).alias("seen"), v.value.alias("v"), F.coalesce(wrong, F.when(passes, error)).alias("e"))

    dtype = cells(F.lit(None).cast(of))[1].dtype
    if isinstance(source.dtype, T.ArrayType):
        seen = F.filter(F.transform(source.value, judged), lambda y: y["seen"])
        seen = F.slice(seen, 1, limit) if limit is not None else seen
        error = F.get(F.filter(seen, lambda y: y["e"].isNotNull()), F.lit(0))["e"]
        values = F.transform(seen, lambda y: y["v"])
    else:
        error, values = F.lit(None).cast("string"), F.array().cast(T.ArrayType(dtype))
    rows = outer.df.withColumn("__found", values).withColumn("__wrong", V.first_error(source.error, error))
    good, failed = outer._split(rows, F.col("__wrong"), "sub-query")
    return replace(_bound(outer, good, name, T.ArrayType(dtype)), failed=failed)


def join_rows(outer: EventFrame, inner: EventFrame, on_tags: tuple = (), where=None, select: V.Expr | None = None) -> EventFrame:
    """A sub-query spread into rows: each inner value is a row of its own, with its own provenance."""
    joined, scope = _matched(outer, inner, [V.expr(t) for t in on_tags], where)
    cell = (V.it if select is None else V.expr(select)).build(scope)
    joined = joined.withColumn("__path", F.concat("__path", F.array((F.col("__ikey.lamport") / 2**31).cast("int"), (F.col("__ikey.lamport") % 2**31).cast("int")), "__ipath"))
    good, failed = outer._split(joined, cell.error, "sub-query")
    df = good.select("__key", "__path", *outer._bindings(), cell.value.alias("__v"), F.col("__im").alias("__m"))
    return replace(outer, df=df, dtype=cell.dtype, failed=failed)


def nest_last(outer: EventFrame, name: str, inner: EventFrame, e: V.Expr, on_tags: tuple, where=None, earliest: bool = False) -> EventFrame:
    """Binds name to LAST (or FIRST) of e over the sub-query, NULL where there is none: one aggregate row by row
    of the outer frame, so nothing is collected."""
    if (quick := _by_tag(outer, inner, on_tags, where, V.expr(e))) is not None:
        rows, tag, cell = quick
        order = F.struct(F.col("__key").alias("k"), F.col("__path").alias("p"))
        order = order if cell.error is None else F.when(cell.error.isNull(), order)
        return _bound(outer, _looked_up(outer, rows.groupBy("__it").agg((F.min_by if earliest else F.max_by)(cell.value, order).alias("__found")), tag), name, cell.dtype)
    joined, scope = _matched(outer, inner, [V.expr(t) for t in on_tags], where)
    cell = V.expr(e).build(scope)
    ok = F.lit(True) if cell.error is None else cell.error.isNull()
    order = F.when(ok, F.struct(F.col("__ikey").alias("k"), F.col("__ipath").alias("p")))
    found = joined.groupBy(F.col("__row").alias("__frow")).agg((F.min_by if earliest else F.max_by)(cell.value, order).alias("__found"))
    rows = _outer(outer).join(found, F.col("__row") == F.col("__frow"), "left")
    df = rows.select("__key", "__path", "__v", "__m", *outer._bindings(), F.col("__found").alias(f"__b_{name}"), F.col("__m").alias(f"__bm_{name}"))
    return replace(outer, df=df, names={**outer.names, name: cell.dtype})


def nest_sum(outer: EventFrame, name: str, inner: EventFrame, e: V.Expr, on_tags: tuple, where=None) -> EventFrame:
    """Binds name to the SUM of e over the sub-query, NULL where nothing is added."""
    if (quick := _by_tag(outer, inner, on_tags, where, V.expr(e))) is not None:
        rows, tag, cell = quick
        value = cell.value if cell.error is None else F.when(cell.error.isNull(), cell.value)
        return _bound(outer, _looked_up(outer, rows.groupBy("__it").agg(F.sum(value).alias("__found")), tag), name, cell.dtype)
    joined, scope = _matched(outer, inner, [V.expr(t) for t in on_tags], where)
    cell = V.expr(e).build(scope)
    value = cell.value if cell.error is None else F.when(cell.error.isNull(), cell.value)
    found = joined.groupBy(F.col("__row").alias("__frow")).agg(F.sum(value).alias("__found"))
    rows = _outer(outer).join(found, F.col("__row") == F.col("__frow"), "left")
    df = rows.select("__key", "__path", "__v", "__m", *outer._bindings(), F.col("__found").alias(f"__b_{name}"), F.col("__m").alias(f"__bm_{name}"))
    return replace(outer, df=df, names={**outer.names, name: cell.dtype})


def nest_as_of(outer: EventFrame, name: str, inner: EventFrame, e: V.Expr, on_tag: V.Expr) -> EventFrame:
    """Binds name to e of the last inner event that has the row's tag and a key below the row's, NULL where there is none.  Both
    sides are put in order by tag and key, so no pair of them is made."""
    rows, tag, cell = _by_tag(outer, inner, (on_tag,), None, V.expr(e))
    value = F.struct(cell.value.alias("v"))
    value = value if cell.error is None else F.when(cell.error.isNull(), value)
    asked = outer.df.select(tag.alias("__tag"), F.col("__key").alias("__at"), F.lit(0).alias("__side"), F.struct(*outer.df.columns).alias("__row"))
    given = rows.select(F.col("__it").alias("__tag"), F.col("__key").alias("__at"), F.lit(1).alias("__side"), value.alias("__x"))
    before = Window.partitionBy("__tag").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(given, allowMissingColumns=True).withColumn("__found", F.last("__x", ignorenulls=True).over(before))
    return _bound(outer, both.where(F.col("__side") == 0).select("__row.*", F.col("__found.v").alias("__found")), name, cell.dtype)


def nest_count_above(outer: EventFrame, name: str, inner: EventFrame, e: V.Expr, than: V.Expr) -> EventFrame:
    """Binds name to how many values of e in the sub-query are above ``than`` of the row: 0 where none is, and where ``than`` is
    NULL or in error.  No pairs are made: values are counted, the counts summed from the top within ranges of values that a
    sample bounds and over the ranges, and the row looks its own value up."""
    counts = inner.df.select(as_column(inner, e).alias("__x")).where(F.col("__x").isNotNull()).groupBy("__x").agg(F.count("*").alias("__c"))
    rows = outer.df.withColumn("__x", as_column(outer, than))
    asked = rows.where(F.col("__x").isNotNull()).select("__x", F.lit(0).cast("bigint").alias("__c"))
    values = counts.unionByName(asked.distinct()).groupBy("__x").agg(F.sum("__c").alias("__c"))
    edges = values.agg(F.percentile_approx("__x", [i / RANGES for i in range(1, RANGES)])).first()[0] or []
    inside = F.lit(0)
    for x in sorted(set(edges)):
        inside = inside + (F.col("__x") > x).cast("int")
    ranged = values.withColumn("__r", inside)
    higher = Window.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = ranged.groupBy("__r").agg(F.sum("__c").alias("__all")).select("__r", F.coalesce(F.sum("__all").over(higher), F.lit(0)).alias("__over"))
    own = Window.partitionBy("__r").orderBy(F.desc("__x")).rowsBetween(Window.unboundedPreceding, -1)
    above = ranged.withColumn("__own", F.coalesce(F.sum("__c").over(own), F.lit(0))).join(F.broadcast(totals), "__r")
    found = above.select(F.col("__x").alias("__fx"), (F.col("__own") + F.col("__over")).cast("bigint").alias("__found"))
    df = rows.join(found, F.col("__x") == F.col("__fx"), "left")
    df = df.select("__key", "__path", "__v", "__m", *(c for c in outer._bindings() if c not in (f"__b_{name}", f"__bm_{name}")), F.coalesce("__found", F.lit(0)).cast("bigint").alias(f"__b_{name}"), F.col("__m").alias(f"__bm_{name}"))
    return replace(outer, df=df, names={**outer.names, name: T.LongType()})


def having(outer: EventFrame, inner: EventFrame, on_tag: V.Expr, negated: bool = False) -> EventFrame:
    """Rows for which the sub-query finds something (or nothing): a semi or anti join on the computed tag."""
    c = V.expr(on_tag).build(outer.scope())
    tags = inner.df.select(F.explode(_tags_like(F.col("__m.tags"), V.expr(on_tag))).alias("__it"))
    df = outer.df.join(tags, c.value == F.col("__it"), "left_anti" if negated else "left_semi")
    return replace(outer, df=df)


def by_entity(frame: EventFrame, key: V.Expr, **aggregates: V.Expr) -> DataFrame:
    """One row for each value of key with aggregates over its events: what a sub-query for each distinct key
    gives, as one groupBy."""
    from .frame import _aggregation

    k = V.expr(key).build(frame.scope())
    columns, out = [], []
    for name, e in aggregates.items():
        cells = {}
        for i, a in enumerate(e.aggregates):
            parts, cells[a] = _aggregation(f"__{name}{i}", a.name, a.inner.build(frame.scope()))
            columns += parts
        c = e.build(V.Scope(None, {}, cells))
        out.append((c.value if c.error is None else F.when(c.error.isNull(), c.value)).alias(name))
    rows = frame.df if k.error is None else frame.df.where(k.error.isNull())
    return rows.withColumn("entity", k.value).groupBy("entity").agg(*columns).select("entity", *out)


def as_column(frame: EventFrame, e: V.Expr) -> Column:
    """The column of an expression over a frame's rows, null where it is in error."""
    c = V.expr(e).build(frame.scope())
    return c.value if c.error is None else F.when(c.error.isNull(), c.value)
