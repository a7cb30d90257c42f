"""Expressions over event values in which an error is a value.

An expression is a function of a scope (the current value ``it``, and bindings) and gives a ``Cell``: a Spark
column for the value, one for the error (None where there can be none, so plain pipelines compile to
plain Spark expressions), the kind of value, and the provenance.  Nothing here runs Python on rows.

Numbers: integers of a payload are naturals (BIGINT, 0 or more; results outside 0 ... 2**63 - 1 are errors, so
``1 - 2`` is one), doubles are decimals (results that are not finite are errors).  A SQL NULL in a payload field
is a missing property, which is an error; the value NULL is written ``null``.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "struct<lamport:bigint,node:string,stream_nr:bigint,offset:bigint>"
META = f"struct<kind:int,lo:{KEY},hi:{KEY},t0:timestamp,t1:timestamp,tags:array<string>,app:string>"
SYNTHETIC, EVENT, RANGE = 0, 1, 2


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "Bool"
    if isinstance(dtype, (T.NumericType,)):
        return "Number"
    if isinstance(dtype, T.StringType):
        return "String"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "Timestamp"
    if isinstance(dtype, T.BinaryType):
        return "Bytes"
    if isinstance(dtype, T.ArrayType):
        return "Array"
    if isinstance(dtype, T.NullType):
        return "Null"
    return "Object"


def first_error(*errors: Column | None) -> Column | None:
    real = [e for e in errors if e is not None]
    return None if not real else real[0] if len(real) == 1 else F.coalesce(*real)


def when_error(condition: Column, message: str | Column) -> Column:
    return F.when(condition, F.lit(message) if isinstance(message, str) else message)


def join_meta(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """The sources of a value made from two, each once."""
    return (*a, *(m for m in b if not any(m is o for o in a)))


def shown(sources: tuple[Column, ...]) -> Column:
    """Provenance as one column: none is synthetic, the same event stays, others become a range without tags."""
    empty = F.struct(F.lit(SYNTHETIC).alias("kind"), *(F.lit(None).alias(n) for n in ("lo", "hi", "t0", "t1", "tags", "app"))).cast(META)
    if not sources:
        return empty
    if len(sources) == 1:
        return sources[0]

    def of(found: Column) -> Column:
        at = lambda name: F.transform(found, lambda m: m[name])
        one = F.element_at(found, 1)
        span = F.struct(
            F.lit(RANGE).alias("kind"), F.array_min(at("lo")).alias("lo"), F.array_max(at("hi")).alias("hi"),
            F.array_min(at("t0")).alias("t0"), F.array_max(at("t1")).alias("t1"),
            F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("app"),
        )
        return F.when(F.size(found) == 0, empty).when(F.size(F.array_distinct(found)) == 1, one).otherwise(span.cast(META))

    real = F.filter(F.array(*sources), lambda m: m["kind"] != SYNTHETIC)
    return F.element_at(F.transform(F.array(real), of), 1)


@dataclass(frozen=True)
class Cell:
    value: Column
    dtype: T.DataType
    error: Column | None = None
    meta: tuple[Column, ...] = ()  # sources; none: synthetic

    @property
    def kind(self) -> str:
        return kind_of(self.dtype)

    @property
    def natural(self) -> bool:
        return isinstance(self.dtype, T.IntegralType)

    def failing(self, error: Column | None) -> Cell:
        return replace(self, error=first_error(self.error, error))


@dataclass
class Scope:
    it: Cell | None
    names: dict[str, Cell] = field(default_factory=dict)
    aggregates: dict[tuple, Cell] | None = None


@dataclass(frozen=True, eq=False)
class Expr:
    build: Callable[[Scope], Cell]
    aggregates: tuple = ()  # the aggregators inside
    prefix: str = ""  # what a text that this makes begins with, as far as that is fixed

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, key: str | int | Expr) -> Expr:
        return index(self, key)

    def __add__(self, other): return arithmetic("+", self, other)
    def __radd__(self, other): return arithmetic("+", other, self)
    def __sub__(self, other): return arithmetic("-", self, other)
    def __rsub__(self, other): return arithmetic("-", other, self)
    def __mul__(self, other): return arithmetic("*", self, other)
    def __rmul__(self, other): return arithmetic("*", other, self)
    def __truediv__(self, other): return arithmetic("/", self, other)
    def __rtruediv__(self, other): return arithmetic("/", other, self)
    def __mod__(self, other): return arithmetic("%", self, other)
    def __pow__(self, other): return arithmetic("^", self, other)
    def __and__(self, other): return logic("&", self, other)
    def __or__(self, other): return logic("|", self, other)
    def __xor__(self, other): return logic("~", self, other)
    def __invert__(self): return negate(self)
    def __eq__(self, other): return compare("=", self, other)
    def __ne__(self, other): return compare("!=", self, other)
    def __lt__(self, other): return compare("<", self, other)
    def __le__(self, other): return compare("<=", self, other)
    def __gt__(self, other): return compare(">", self, other)
    def __ge__(self, other): return compare(">=", self, other)
    __hash__ = object.__hash__


def expr(x) -> Expr:
    return x if isinstance(x, Expr) else lit(x)


def _combined(*parts: Expr) -> tuple:
    return tuple(dict.fromkeys(a for p in parts for a in p.aggregates))


def _metas(*cells: Cell) -> tuple[Column, ...]:
    return functools.reduce(join_meta, (c.meta for c in cells), ())


def _chosen(condition: Column, a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    same = len(a) == len(b) and all(x is y for x, y in zip(a, b))
    return a if same else (F.when(condition, shown(a)).otherwise(shown(b)),)


def lit(x) -> Expr:
    """A literal: bool, int (a natural if not negative), float, str, None, list or dict of expressions."""
    if isinstance(x, list):
        return array(*x)
    if isinstance(x, dict):
        return obj(**x)
    if x is None:
        return Expr(lambda s: Cell(F.lit(None), T.NullType()))
    if isinstance(x, int) and not isinstance(x, bool) and x < 0:
        x = float(x)
    dtype = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}[type(x)]
    return Expr(lambda s: Cell(F.lit(x).cast(dtype), dtype))


null = lit(None)


def time(moment: str) -> Expr:
    """A timestamp; it can be made and printed but not compared."""
    return Expr(lambda s: Cell(F.lit(moment).cast("timestamp"), T.TimestampType()))


#: The current value.
it = Expr(lambda s: s.it)


def var(name: str) -> Expr:
    def build(s: Scope) -> Cell:
        if name not in s.names:
            raise KeyError(f"variable `{name}` is not bound")
        return s.names[name]

    return Expr(build)


def column(col: Column, dtype: T.DataType) -> Expr:
    """Any Spark column as an expression; SQL NULL is a missing value."""
    return Expr(lambda s: Cell(col, dtype, when_error(col.isNull(), "no value")))


def index(base: Expr, key: str | int | Expr) -> Expr:
    def missing(name: str, kind: str) -> str:
        return f"property `{name}` not found in {kind}"

    def build(s: Scope) -> Cell:
        head = base.build(s)
        if isinstance(key, Expr):
            at = key.build(s)
            if isinstance(head.dtype, T.ArrayType) and at.natural:
                got = F.get(head.value, at.value.cast("int"))
                absent = F.concat(F.lit("property `"), at.value.cast("string"), F.lit("` not found in Array"))
                return Cell(got, head.dtype.elementType, first_error(head.error, at.error, when_error(got.isNull(), absent)), head.meta)
            if isinstance(head.dtype, T.MapType) and at.kind == "String":
                got = F.try_element_at(head.value, at.value)
                absent = F.concat(F.lit("property `"), at.value, F.lit("` not found in Object"))
                return Cell(got, head.dtype.valueType, first_error(head.error, at.error, when_error(got.isNull(), absent)), head.meta)
            fail = F.lit(f"cannot index by {at.kind}")
            return Cell(F.lit(None), T.NullType(), first_error(head.error, at.error, fail), head.meta)
        if isinstance(key, str) and isinstance(head.dtype, T.StructType) and key in head.dtype.names:
            dtype = head.dtype[key].dataType
            got = head.value[key]
            wide = T.LongType() if isinstance(dtype, T.IntegralType) else T.DoubleType() if isinstance(dtype, (T.FractionalType,)) else dtype
            value = got.cast(wide) if wide != dtype else got
            if isinstance(dtype, T.NullType):
                return Cell(got, dtype, head.error, head.meta)
            error = when_error(got.isNull(), missing(key, "Object"))
            if isinstance(wide, T.LongType):
                error = error.when(got < 0, F.lit("not a natural number"))
            return Cell(value, wide, first_error(head.error, error), head.meta)
        if isinstance(key, str) and isinstance(head.dtype, T.VariantType):
            got = F.try_variant_get(head.value, f"$.{key}", "variant")
            return Cell(got, T.VariantType(), first_error(head.error, when_error(got.isNull(), missing(key, "Object"))), head.meta)
        if isinstance(key, int) and isinstance(head.dtype, T.ArrayType):
            got = F.get(head.value, F.lit(key))
            return Cell(got, head.dtype.elementType, first_error(head.error, when_error(got.isNull(), missing(str(key), "Array"))), head.meta)
        return Cell(F.lit(None), T.NullType(), first_error(head.error, F.lit(missing(str(key), head.kind))), head.meta)

    return Expr(build, _combined(base, *([key] if isinstance(key, Expr) else [])))


def typed(e: Expr, dtype: T.DataType) -> Expr:
    """A VARIANT value as one of a known type; another kind is an error, a JSON null the value NULL's kind."""

    def build(s: Scope) -> Cell:
        c = e.build(s)
        got = F.try_variant_get(c.value, "$", dtype.simpleString())
        wrong = F.concat(F.lit(f"expected {kind_of(dtype)}, found "), F.schema_of_variant(c.value))
        return Cell(got, dtype, first_error(c.error, when_error(got.isNull(), wrong)), c.meta)

    return Expr(build, e.aggregates)


def _mismatch(op: str, a: Cell, b: Cell) -> Column:
    return F.lit(f"binary operation {op} cannot be applied to {a.kind} and {b.kind}")


def arithmetic(op: str, left, right) -> Expr:
    left, right = expr(left), expr(right)

    def build(s: Scope) -> Cell:
        a, b = left.build(s), right.build(s)
        errors, meta = first_error(a.error, b.error), _metas(a, b)
        if a.kind != "Number" or b.kind != "Number":
            return Cell(F.lit(None).cast("bigint"), T.LongType(), first_error(errors, _mismatch(op, a, b)), meta)
        if a.natural and b.natural:
            x, y = a.value.cast("bigint"), b.value.cast("bigint")
            if op == "+":
                r, e = F.try_add(x, y), None
            elif op == "-":
                r, e = F.when(y <= x, x - y), None
            elif op == "*":
                r, e = F.try_multiply(x, y), None
            elif op == "^":
                power = F.aggregate(F.array_repeat(x, F.least(y, F.lit(64)).cast("int")), F.lit(1).cast("bigint"), lambda acc, v: F.try_multiply(acc, v))
                r, e = F.when(y == 0, F.lit(1).cast("bigint")).when(x <= 1, x).when(y < 64, power), None
            else:
                safe = F.when(y != 0, y)
                r = F.call_function("div", x, safe) if op == "/" else x % safe
                e = when_error(y == 0, "division by zero")
            return Cell(r, T.LongType(), first_error(errors, e, when_error(r.isNull(), "integer overflow")), meta)
        x, y = a.value.cast("double"), b.value.cast("double")
        if op in "/%":
            safe = F.when(y != 0, y)
            r = (x / safe) if op == "/" else (x % safe)
            zero = F.when((y == 0) & ((x == 0) | F.lit(op == "%")), F.lit("not a number")).when(y == 0, F.lit("floating-point overflow"))
            errors = first_error(errors, zero)
        else:
            r = {"+": x + y, "-": x - y, "*": x * y, "^": F.pow(x, y)}[op]
        bad = F.when(F.isnan(r), F.lit("not a number")).when(F.abs(r) == float("inf"), F.lit("floating-point overflow"))
        return Cell(r, T.DoubleType(), first_error(errors, bad), meta)

    return Expr(build, _combined(left, right))


def compare(op: str, left, right) -> Expr:
    left, right = expr(left), expr(right)

    def build(s: Scope) -> Cell:
        a, b = left.build(s), right.build(s)
        errors, meta = first_error(a.error, b.error), _metas(a, b)
        if a.kind != b.kind or a.kind not in ("Null", "Bool", "Number", "String"):
            return Cell(F.lit(None).cast("boolean"), T.BooleanType(), first_error(errors, _mismatch(op, a, b)), meta)
        if a.kind == "Null":
            return Cell(F.lit(op in ("=", "<=", ">=")), T.BooleanType(), errors, meta)
        x, y = a.value, b.value
        if a.kind == "Number" and a.natural != b.natural:
            x, y = x.cast("double"), y.cast("double")
        r = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return Cell(r, T.BooleanType(), errors, meta)

    return Expr(build, _combined(left, right))


def logic(op: str, left, right) -> Expr:
    """Both sides are evaluated; the right side's kind counts only where the left does not decide."""
    left, right = expr(left), expr(right)

    def build(s: Scope) -> Cell:
        a, b = left.build(s), right.build(s)
        errors, meta = first_error(a.error, b.error), _metas(a, b)
        if a.kind != "Bool" or (b.kind != "Bool" and op == "~"):
            return Cell(F.lit(None).cast("boolean"), T.BooleanType(), first_error(errors, _mismatch(op, a, b)), meta)
        if b.kind != "Bool":
            decided = ~a.value if op == "&" else a.value
            return Cell(F.lit(op == "|"), T.BooleanType(), first_error(errors, when_error(~decided, _mismatch(op, a, b))), meta)
        r = {"&": a.value & b.value, "|": a.value | b.value, "~": a.value != b.value}[op]
        return Cell(r, T.BooleanType(), errors, meta)

    return Expr(build, _combined(left, right))


def negate(e: Expr) -> Expr:
    def build(s: Scope) -> Cell:
        c = e.build(s)
        if c.kind != "Bool":
            return Cell(F.lit(None).cast("boolean"), T.BooleanType(), first_error(c.error, F.lit(f"{c.kind} is not a boolean")), c.meta)
        return replace(c, value=~c.value)

    return Expr(build, e.aggregates)


def _same_type(cells: list[Cell]) -> tuple[list[Column], T.DataType]:
    """Values of one type: as they are, as doubles, or as text where kinds differ."""
    kinds = {c.dtype.simpleString() for c in cells if c.kind != "Null"}
    if len(kinds) <= 1:
        dtype = next((c.dtype for c in cells if c.kind != "Null"), T.NullType())
        return [c.value.cast(dtype) if not isinstance(dtype, T.NullType) else c.value for c in cells], dtype
    if all(c.kind in ("Number", "Null") for c in cells):
        return [c.value.cast("double") for c in cells], T.DoubleType()
    return [as_text(c) for c in cells], T.StringType()


def alternative(*options) -> Expr:
    """The first option that is no error (NULL is none)."""
    options = [expr(o) for o in options]

    def build(s: Scope) -> Cell:
        cells = [o.build(s) for o in options]
        values, dtype = _same_type(cells)
        value, error, meta = values[-1], cells[-1].error, cells[-1].meta
        for c, v in list(zip(cells, values))[-2::-1]:
            if c.error is None:
                value, error, meta = v, None, c.meta
            else:
                good = c.error.isNull()
                value = F.when(good, v).otherwise(value)
                error = None if error is None else F.when(~good, error)
                meta = _chosen(good, c.meta, meta)
        return Cell(value, dtype, error, meta)

    return Expr(build, _combined(*options))


def case(*branches: tuple) -> Expr:
    """The value of the first branch whose condition is TRUE; a condition in error counts as FALSE."""
    pairs = [(expr(p), expr(v)) for p, v in branches]

    def build(s: Scope) -> Cell:
        conditions = []
        for p, _ in pairs:
            c = p.build(s)
            ok = F.lit(False) if c.kind != "Bool" else F.coalesce(c.value, F.lit(False))
            conditions.append(ok if c.error is None else ok & c.error.isNull())
        cells = [v.build(s) for _, v in pairs]
        values, dtype = _same_type(cells)
        value, error, meta = F.lit(None).cast(dtype), F.lit("no case matched"), ()
        for ok, c, v in list(zip(conditions, cells, values))[::-1]:
            value = F.when(ok, v).otherwise(value)
            error = F.when(ok, F.lit(None).cast("string") if c.error is None else c.error).otherwise(error)
            meta = _chosen(ok, c.meta, meta)
        return Cell(value, dtype, error, meta)

    return Expr(build, _combined(*(e for p in pairs for e in p)))


def is_defined(e) -> Expr:
    e = expr(e)

    def build(s: Scope) -> Cell:
        c = e.build(s)
        return Cell(F.lit(True) if c.error is None else c.error.isNull(), T.BooleanType())

    return Expr(build, e.aggregates)


#: Functions that may be called by name; a program may add its own.
FUNCTIONS: dict[str, Callable[..., Expr]] = {"IsDefined": is_defined}


def call(name: str, *arguments) -> Expr:
    if name not in FUNCTIONS:
        message = F.lit(f"undefined function '{name}'")
        return Expr(lambda s: Cell(F.lit(None), T.NullType(), message))
    return FUNCTIONS[name](*arguments)


def as_text(c: Cell) -> Column:
    """How a value shows inside a string."""
    if c.kind == "Null":
        return F.lit("NULL")
    if c.kind == "Bool":
        return F.when(c.value, "TRUE").otherwise("FALSE")
    if c.kind == "Timestamp":
        return F.date_format(c.value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if c.kind in ("Array", "Object"):
        return F.lit(c.kind.upper())
    return c.value.cast("string")


def text(*parts) -> Expr:
    """Interpolation: the parts' texts, one after another."""
    prefix = "".join(p for p in itertools.takewhile(lambda p: isinstance(p, str), parts))
    parts = [expr(p) for p in parts]

    def build(s: Scope) -> Cell:
        cells = [p.build(s) for p in parts]
        return Cell(F.concat(*(as_text(c) for c in cells)), T.StringType(), first_error(*(c.error for c in cells)), _metas(*cells))

    return Expr(build, _combined(*parts), prefix)


def obj(**fields) -> Expr:
    fields = {k: expr(v) for k, v in fields.items()}

    def build(s: Scope) -> Cell:
        cells = {k: v.build(s) for k, v in fields.items()}
        dtype = T.StructType([T.StructField(k, c.dtype) for k, c in cells.items()])
        return Cell(F.struct(*(c.value.alias(k) for k, c in cells.items())), dtype, first_error(*(c.error for c in cells.values())), _metas(*cells.values()))

    return Expr(build, _combined(*fields.values()))


def _without(made: Column, name: Column) -> Column:
    return F.map_filter(made, lambda key, _: key != name)


def mapping(*pairs: tuple) -> Expr:
    """An object with computed keys; of equal keys the last counts."""
    pairs = [(expr(k), expr(v)) for k, v in pairs]

    def build(s: Scope) -> Cell:
        keys, cells = [k.build(s) for k, _ in pairs], [v.build(s) for _, v in pairs]
        values, dtype = _same_type(cells)
        made = F.create_map()
        for k, v in zip(keys, values):
            name = as_text(k)
            one = F.create_map(name, v)
            made = one if k is keys[0] else F.map_concat(_without(made, name), one)
        return Cell(made, T.MapType(T.StringType(), dtype), first_error(*(c.error for c in (*keys, *cells))), _metas(*keys, *cells))

    return Expr(build, _combined(*(e for p in pairs for e in p)))


@dataclass(frozen=True)
class Spread:
    """...e: the elements of an array."""

    inner: Expr


def spread(e) -> Spread:
    return Spread(expr(e))


def array(*items) -> Expr:
    parts = [(isinstance(x, Spread), x.inner if isinstance(x, Spread) else expr(x)) for x in items]

    def build(s: Scope) -> Cell:
        cells = [(many, e.build(s)) for many, e in parts]
        errors = [c.error for _, c in cells]
        for many, c in cells:
            if many and c.kind != "Array":
                return Cell(F.lit(None), T.NullType(), first_error(*errors, F.lit(f"cannot spread a value of type {c.kind}")), _metas(*(c for _, c in cells)))
        singles = [replace(c, dtype=c.dtype.elementType) if many else c for many, c in cells]
        _, dtype = _same_type(singles)
        pieces = [c.value.cast(T.ArrayType(dtype)) if many else F.array(v) for (many, c), v in zip(cells, _same_type(singles)[0] if not any(m for m, _ in cells) else [c.value for _, c in cells])]
        value = F.concat(*pieces) if pieces else F.array()
        return Cell(value, T.ArrayType(dtype), first_error(*errors), _metas(*(c for _, c in cells)))

    return Expr(build, _combined(*(e for _, e in parts)))


def _of_meta(e, dtype: T.DataType, show: Callable[[Column], Column]) -> Expr:
    e = expr(e)

    def build(s: Scope) -> Cell:
        c = e.build(s)
        empty = F.array().cast(dtype)
        return Cell(F.coalesce(show(shown(c.meta)), empty) if c.meta else empty, dtype, c.error, c.meta)

    return Expr(build, e.aggregates)


def key(e) -> Expr:
    """[] for a synthetic value, [key] for an event's, [first, last] for a range's."""
    dtype = T.ArrayType(T._parse_datatype_string(KEY))
    return _of_meta(e, dtype, lambda m: F.when(m["kind"] == EVENT, F.array(m["lo"])).when(m["kind"] == RANGE, F.array(m["lo"], m["hi"])))


def times(e) -> Expr:
    return _of_meta(e, T.ArrayType(T.TimestampType()), lambda m: F.when(m["kind"] == EVENT, F.array(m["t0"])).when(m["kind"] == RANGE, F.array(m["t0"], m["t1"])))


def tags(e) -> Expr:
    return _of_meta(e, T.ArrayType(T.StringType()), lambda m: F.when(m["kind"] == EVENT, m["tags"]))


def app(e) -> Expr:
    return _of_meta(e, T.ArrayType(T.StringType()), lambda m: F.when(m["kind"] == EVENT, F.array(m["app"])))


@dataclass(frozen=True, eq=False)
class Aggregator:
    name: str
    inner: Expr


def _aggregate(name: str, e) -> Expr:
    a = Aggregator(name, expr(e))
    return Expr(lambda s: s.aggregates[a], (a,))


def total(e) -> Expr:
    """SUM: of numbers; of booleans, whether any is TRUE."""
    return _aggregate("sum", e)


def product(e) -> Expr:
    """PRODUCT: of numbers; of booleans, whether all are TRUE."""
    return _aggregate("product", e)


def least(e) -> Expr:
    return _aggregate("min", e)


def most(e) -> Expr:
    return _aggregate("max", e)


def first(e) -> Expr:
    return _aggregate("first", e)


def last(e) -> Expr:
    return _aggregate("last", e)
