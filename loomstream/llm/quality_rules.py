"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``plan_cascade`` runs every rule over a sample, measures what it costs and how much it rejects, and
orders the rules by rejection per cost.  ``apply_cascade`` evaluates them in that order as one CASE
expression, so a row pays for no rule after the first that rejects it.  The order changes what a run
costs, never which rows it keeps: a row is kept if no rule rejects it.

A rule asks for statistics of the text (``Statistics``), each an expression that is evaluated where it is asked for; a
statistic that the caller has as a column anyway costs a rule nothing, and rules that need only such ones come first.

The cost of a rule is the time of one job over the sample, every row of which comes REPEATS times, less the time of a job that
evaluates no rule; so what a job itself takes is a small part of it.

Words are runs of characters other than space, tab, LF, VT, FF and CR.  Defined results: a null text has
no words; an empty text fails the rule on the number of words; a very long text is judged whole; repeated rows have the same
verdict each; of rules that tie in rejection per cost the first by name comes first; on an empty table every rule is worth
nothing and no row is kept or rejected.  Columns of docs keep their names and values, whatever they are called.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise

#: Rows of the sample on which rules are timed, about, and how often each comes.
SAMPLE_ROWS = 1000
REPEATS = 4
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once (a lambda's variable), however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    for space in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^ \t-\r]")))
    return let(lines, lambda kept: (F.size(kept) - F.size(F.array_distinct(kept))).cast("long"))


def n_repeat_words(word_list: Column, n: int = WINDOW) -> Column:
    """Words inside runs of n words that the text has twice or more.  Runs are compared by a 64-bit hash;
    texts without a repeated hash, which are most, stop after one hash set."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(n))))
        return F.when(F.size(w) < n, F.lit(0).cast("long")).otherwise(
            let(runs, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
        )

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(p: Column) -> Column:
            twin = F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-n).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(n), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(let(placed, again), first, step, lambda acc: acc["n"])

    return let(word_list, of)


#: What each statistic is, from the text (not null) and its words.
STATISTICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda t, w: n_symbols(t),
    "n_dup_lines": lambda t, w: n_dup_lines(t),
    "n_repeat_words": lambda t, w: n_repeat_words(w),
    "n_lines": lambda t, w: F.size(F.split(t, "\n")).cast("long"),
    "n_upper": lambda t, w: F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long"),
    "n_letters": lambda t, w: F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("long"),
}


class Statistics:
    """Statistics of a row by name: a known column, or the expression over the columns of text and words."""

    def __init__(self, text: Column, word_list: Column, known: dict[str, Column] | None = None):
        self.text, self.words, self.known = text, word_list, known or {}

    def __getitem__(self, name: str) -> Column:
        return self.known[name] if name in self.known else STATISTICS[name](self.text, self.words)


@dataclass(frozen=True)
class Rule:
    """A name, the statistics it needs, and the condition on them under which the rule rejects a row."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Statistics], Column] = field(compare=False)


def default_rules() -> list[Rule]:
    """Thresholds that ordinary prose is far from."""
    return [
        Rule("few_words", ("n_words",), lambda s: s["n_words"] < 10),
        Rule("repeated_words", ("n_words", "n_repeat_words"), lambda s: 100 * s["n_repeat_words"] > 20 * s["n_words"]),
        Rule("symbols", ("n_symbols", "word_chars"), lambda s: 10 * s["n_symbols"] > s["word_chars"]),
        Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda s: 2 * s["n_dup_lines"] > s["n_lines"]),
        Rule("upper_case", ("n_upper", "n_letters"), lambda s: 2 * s["n_upper"] > s["n_letters"] + 10),
        Rule("few_letters", ("n_letters", "word_chars"), lambda s: 2 * s["n_letters"] < s["word_chars"]),
    ]


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-4)


def plan_cascade(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS, known: tuple[str, ...] = ()) -> list[Measured]:
    """The rules by rejection per cost, most first; ties by name.  known: statistics that are there anyway, which cost nothing."""
    total = docs.count()
    drawn = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).sample(fraction=min(1.0, sample_rows / max(total, 1)), seed=7)
    sample = materialise(drawn.withColumn("w", words(F.col("t"))), "rule-sample")
    n = max(1, sample.count() * REPEATS)
    rows = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    own = Statistics(F.col("t"), F.col("w"))

    def timed(condition: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hits = rows.agg(F.count_if(condition).alias("n")).first()["n"]
        return time.perf_counter() - began, hits

    timed(own["n_words"] < 0)  # the first job of its kind is the slowest
    idle, _ = timed(own["n_words"] < 0)
    measured = []
    for rule in rules:
        seconds, hits = timed(rule.rejects(own))
        free = set(rule.needs) <= set(known)
        measured.append(Measured(rule, 0.0 if free else max(seconds - idle, 1e-4), hits / n))
    discard(sample)
    return sorted(measured, key=lambda m: (m.seconds > 0, -m.worth, m.rule.name))


def verdict(cascade: list[Measured], statistics: Statistics) -> Column:
    """The name of the first rule of the cascade that rejects the row, or null."""
    out = F
    for m in cascade:
        out = out.when(m.rule.rejects(statistics), F.lit(m.rule.name))
    return out.otherwise(F.lit(None).cast("string")) if cascade else F.lit(None).cast("string")


def apply_cascade(docs: DataFrame, cascade: list[Measured], text: str = "text", into: str = "rejected_by") -> DataFrame:
    """docs with a column that names the rule that rejected the row, null if it is kept."""
    t, w = (f"{x}_{uuid.uuid4().hex}" for x in "tw")
    held = docs.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn(w, words(F.col(t)))
    return held.withColumn(into, verdict(cascade, Statistics(F.col(t), F.col(w)))).drop(t, w)


def filter_documents(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with their own columns."""
    cascade = plan_cascade(docs, default_rules() if rules is None else rules, text, sample_rows)
    own = f"rejected_{uuid.uuid4().hex}"
    return apply_cascade(docs, cascade, text, own).where(F.col(own).isNull()).drop(own)
