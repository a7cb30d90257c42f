"""Secret scans: known forms, and sliding-window Shannon entropy over candidate strings.

Known forms (kinds ``assign``, ``access``, ``hex``) are regular expressions with a least length.  Besides
them, every run of 20 or more characters that keys are made of is a candidate; in it each character class (hexadecimal;
lower case and digits; upper case and digits; letters, digits and base64 marks) has a window slid over its runs.  The window's
entropy is kept by incremental counts: one character enters, one leaves, and only their two counts change.  Windows
at or above the class's threshold are joined to spans of kind ``entropy``.  A threshold is the entropy that 99 of 100 windows of
random characters of the class reach (base32 for upper case).

The allow-list suppresses what is random-looking but public or no secret: UUIDs, letters of one case (words), words in camel
case, words and short numbers joined by ``-``, ``_``, ``/``, ``+`` or ``=``, strings of one repeated unit, digests
that name their algorithm, and whatever patterns the caller adds.  It applies to entropy spans alone; known
forms always stay.  An entropy span inside a span of a known form is not reported again.

Offsets are code points, ends exclusive.  Defined results: a null text is empty and has no spans; texts
of any length are scanned whole; repeated rows get the same spans each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

KINDS = ("assign", "access", "hex", "entropy")
#: Keyword, then what stands between, then the value.  ASCII: only A-Z and a-z vary in case.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A hexadecimal run of 32 or more; runs that fail are never needed, since runs do not overlap.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Character class: its runs, the window's length, the entropy in bits at which a window counts, and what a run must hold too.
CLASSES = (
    (re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}"), 32, 3.27, re.compile(r"[0-9]")),
    (re.compile(r"(?<![a-z0-9])[a-z0-9]{20,}"), 20, 3.4, re.compile(r"[a-z][0-9]|[0-9][a-z]")),
    (re.compile(r"(?<![A-Z0-9])[A-Z0-9]{20,}"), 20, 3.32, re.compile(r"[A-Z][0-9]|[0-9][A-Z]")),
    (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.64, re.compile(r"[a-z][^a-z]*[A-Z]|[A-Z][^A-Z]*[a-z]")),
)
#: Each of these matches in one way only, so none takes more than linear time.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(r"[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+"),
    re.compile(r"[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})+[0-9]{0,4}"),
    re.compile(r"(.{1,4}?)\1+.{0,3}"),
)
MARKS = re.compile(r"[-/_=+]+")
PART = re.compile(r"[A-Z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,4}|")
#: Before a span: it is a digest and says so.
DIGEST_NAME = re.compile(r"(?:md5|sha-?(?:1|256|384|512))[:=-]\Z", re.IGNORECASE)


def busy_runs(text: str, window: int, least: float) -> list[tuple[int, int]]:
    """Joined windows of text whose Shannon entropy is at least so many bits."""
    if len(text) < window:
        return []
    weigh = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = window * (math.log2(window) - least)  # entropy = log2(window) - sum(c * log2(c)) / window
    counts: dict[str, int] = {}
    total = 0.0
    out: list[tuple[int, int]] = []
    for i, new in enumerate(text):
        c = counts.get(new, 0)
        counts[new] = c + 1
        total += weigh[c + 1] - weigh[c] if c < window else 0.0
        if i >= window:
            old = text[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += weigh[c - 1] - weigh[min(c, window)]
        if i >= window - 1 and total <= most + 1e-9:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def is_plain(text: str) -> bool:
    """Whether a string is public, a word, or words joined by marks."""
    if any(p.fullmatch(text) for p in ALLOWED):
        return True
    parts = MARKS.split(text)
    return len(parts) > 1 and all(PART.fullmatch(p) for p in parts)


def scan(text: str, allow: tuple[re.Pattern, ...] = ()) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans, by start, then kind in the order of KINDS."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))  # the furthest end of this and earlier spans
    entropy: set[tuple[int, int]] = set()
    for m in CANDIDATE.finditer(text):
        if is_plain(m[0]) or any(p.search(m[0]) for p in allow):
            continue
        for chars, window, least, holds in CLASSES:
            for run in chars.finditer(text, m.start(), m.end()):
                if not holds.search(run[0]):
                    continue
                for a, b in busy_runs(run[0], window, least):
                    a, b = run.start() + a, run.start() + b
                    before = bisect_right(starts, a)
                    if before and reach[before - 1] >= b:
                        continue
                    if not is_plain(text[a:b]) and not DIGEST_NAME.search(text[max(0, a - 8) : a]):
                        entropy.add((a, b))
    furthest = -1
    for a, b in sorted(entropy, key=lambda x: (x[0], -x[1])):  # a span inside another is not reported
        if b > furthest:
            base.append((a, 3, b))
            furthest = b
    return [(a, KINDS[k], b) for a, k, b in sorted(base)]


def scan_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", allow: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and spans (array of start, kind, end) for each row; allow: further patterns of no secrets."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = tuple(re.compile(p) for p in allow)
        for batch in batches:
            spans = [[{"start": a, "kind": k, "end": b} for a, k, b in scan(t.as_py() or "", patterns)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:int,kind:string,end:int>>"
    return rows.mapInArrow(of, schema)


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """text with each span, or run of overlapping spans, replaced by a mark that names its first kind."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind} removed]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", allow: tuple[str, ...] = ()) -> DataFrame:
    """docs with their own columns, each span in text replaced, and n_chars (if there is one) counted anew
    for the rows that changed."""
    small_batches(docs.sparkSession)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = tuple(re.compile(p) for p in allow)
        for batch in batches:
            old = batch.column(text).to_pylist()
            new = [t and redacted(t, scan(t, patterns)) for t in old]
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns[text] = pa.array(new, batch.schema.field(text).type)
            if n_chars in columns:
                count = columns[n_chars].to_pylist()
                columns[n_chars] = pa.array([len(b) if a != b else n for a, b, n in zip(old, new, count)], columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(of, docs.schema)


def digest_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", allow: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the spans as text and digests, in one pass."""
    spans = scan_documents(docs, doc_id, text, allow)
    shown = lambda chosen: F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(shown(F.filter("spans", lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
