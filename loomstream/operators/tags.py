"""Selecting events: tags, time, key, application and locality, combined with & and |.

A selection is a Spark predicate.  It also carries its normal form (alternatives of conjunctions, subsumed
ones removed), which gives the strict check that time and key restrictions are the same on all branches,
the tags that every match must have, and the text form.
"""

from __future__ import annotations

import datetime
import functools
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of ``ago`` in microseconds; a month is a synodic one, a year a tropical one (fixed values).
UNITS = {"s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "D": 86_400_000_000, "W": 604_800_000_000, "M": 2_551_442_876_908, "Y": 31_556_925_250_733}


def normal(tag: str) -> str:
    if not tag:
        raise ValueError("a tag is not empty")
    return unicodedata.normalize("NFC", tag)


@dataclass(frozen=True)
class Atom:
    kind: str  # tag, app, me, local, time, key
    op: str = ""
    value: object = None

    def predicate(self) -> Column:
        if self.kind == "tag":
            return F.array_contains("tags", self.value)
        if self.kind == "app":
            return F.col("app_id") == self.value
        if self.kind == "me":
            raise ValueError("appId(me) needs the application that asks: see called_by")
        if self.kind == "local":
            return F.col("is_local")
        if self.kind == "time":
            return _compare(F.col("ts"), self.op, F.timestamp_micros(F.lit(self.value)))
        lamport, node, nr = self.value
        # The bare comparison of lamport repeats what the key says, in a form that a scan can use.
        bound = F.col("lamport") >= lamport if self.op in (">", ">=") else F.col("lamport") <= lamport
        own = F.struct(F.col("lamport").alias("l"), F.col("node").alias("n"), F.col("stream_nr").alias("s"))
        other = F.struct(F.lit(lamport).cast("bigint").alias("l"), F.lit(node).alias("n"), F.lit(nr).cast("bigint").alias("s"))
        return bound & _compare(own, self.op, other)

    def __str__(self) -> str:
        if self.kind == "tag":
            return "'" + str(self.value).replace("'", "''") + "'"
        if self.kind == "app":
            return f"appId({self.value})"
        if self.kind == "me":
            return "appId(me)"
        if self.kind == "local":
            return "isLocal"
        if self.kind == "time":
            moment = datetime.datetime.fromtimestamp(0, datetime.UTC) + datetime.timedelta(microseconds=self.value)
            return f"TIME {self.op} {moment.strftime('%Y-%m-%dT%H:%M:%S.%fZ')}"
        lamport, node, nr = self.value
        return f"KEY {self.op} {lamport}" + (f"/{node}-{nr}" if node else "")


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


@dataclass(frozen=True)
class Where:
    """A selection; ``all_events`` selects everything."""

    alternatives: tuple[frozenset[Atom], ...]

    def __or__(self, other: Where) -> Where:
        return Where(_reduced(self.alternatives + other.alternatives))

    def __and__(self, other: Where) -> Where:
        return Where(_reduced(tuple(a | b for a in self.alternatives for b in other.alternatives)))

    def checked(self) -> Where:
        """Raises if time or key restrictions differ between branches."""
        for kind in ("time", "key"):
            if len({frozenset(a for a in c if a.kind == kind) for c in self.alternatives}) > 1:
                raise ValueError(f"{kind} restrictions must be the same on all branches")
        return self

    def predicate(self) -> Column:
        if not self.alternatives:
            return F.lit(False)
        common = frozenset.intersection(*self.alternatives)
        order = lambda atoms: sorted(atoms, key=lambda a: (a.kind in ("tag",), str(a)))  # noqa: E731  what a scan can use comes first
        both = lambda atoms: functools.reduce(lambda x, y: x & y, (a.predicate() for a in order(atoms)), F.lit(True))
        rest = [c - common for c in self.alternatives]
        if any(not r for r in rest):
            return both(common)
        return both(common) & functools.reduce(lambda x, y: x | y, (both(r) for r in rest))

    def implied(self, raw: Callable[[Atom], Column | None]) -> Column | None:
        """What the selection says about a table under its events, for a scan to use: raw gives an atom's condition on
        the table's own columns, or None where it has none."""
        found = []
        for c in self.alternatives:
            parts = [x for x in (raw(a) for a in sorted(c, key=str)) if x is not None]
            if not parts:
                return None
            found.append(functools.reduce(lambda a, b: a & b, parts))
        return functools.reduce(lambda a, b: a | b, found) if found else None

    def called_by(self, app: str) -> Where:
        """The selection as the application asks it: ``own_app`` is its own id."""
        return Where(_reduced(tuple(frozenset(Atom("app", "=", app) if a.kind == "me" else a for a in c) for c in self.alternatives)))

    def select(self, events: DataFrame, strict: bool = True) -> DataFrame:
        return events.where((self.checked() if strict else self).predicate())

    def __str__(self) -> str:
        shown = [" & ".join(sorted(map(str, c))) or "allEvents" for c in self.alternatives]
        return " | ".join(shown)


def _reduced(alternatives: tuple[frozenset[Atom], ...]) -> tuple[frozenset[Atom], ...]:
    possible = [c for c in dict.fromkeys(alternatives) if len({a.value for a in c if a.kind == "app"}) < 2]
    return tuple(c for c in possible if not any(o < c for o in possible))


def _one(atom: Atom) -> Where:
    return Where((frozenset([atom]),))


all_events = Where((frozenset(),))
is_local = _one(Atom("local"))
own_app = _one(Atom("me"))


def tag(name: str, *ids: str) -> Where:
    """Events with the tag; with an id, those that also have ``name:id``."""
    found = _one(Atom("tag", "=", normal(name)))
    for i in ids:
        found = found & _one(Atom("tag", "=", normal(f"{name}:{i}")))
    return found


def tags(*names: str) -> Where:
    return functools.reduce(lambda a, b: a & b, (tag(n) for n in names), all_events)


def app_id(name: str) -> Where:
    return _one(Atom("app", "=", name))


def micros(moment: str | datetime.datetime) -> int:
    """Microseconds since 1970 of an ISO time with its zone; further digits are cut off."""
    if isinstance(moment, str):
        head, dot, rest = moment.partition(".")
        if dot:
            digits = len(rest) - len(rest.lstrip("0123456789"))
            moment = f"{head}.{rest[:digits][:6].ljust(6, '0')}{rest[digits:]}"
        if len(moment) <= 11:  # a date; it needs a zone too
            moment = moment.replace("Z", "T00:00:00Z")
        moment = datetime.datetime.fromisoformat(moment)
    if moment.tzinfo is None:
        raise ValueError("a time needs a zone")
    return round((moment - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) / datetime.timedelta(microseconds=1))


def time(op: str, moment: str | datetime.datetime) -> Where:
    return _one(Atom("time", op, micros(moment)))


def ago(op: str, n: int, unit: str, now: str | datetime.datetime) -> Where:
    """Time relative to now, which the caller fixes; never before 1970."""
    return _one(Atom("time", op, max(0, micros(now) - n * UNITS[unit])))


def key(op: str, lamport: int, node: str = "", stream_nr: int = 0) -> Where:
    """Key comparison; without a node the least one is meant, so ``key(">", 5)`` has lamport 5 of any node."""
    return _one(Atom("key", op, (lamport, node, stream_nr)))


def since(moment: str) -> Where:
    return time(">=", moment)


def until(moment: str) -> Where:
    return time("<", moment)
