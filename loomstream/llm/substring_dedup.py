"""Substring deduplication with a log-structured fingerprint index.

A window is WIDTH consecutive words of a text.  A word of a new text is removed if a window around it was
already in a text with a smaller doc_id, in this batch or in history.

The index does not hold every window.  Each window is filed under the least hash of the LEAD-word runs in
it (its anchor); consecutive windows with one anchor make one stretch, and the index has a row for a
stretch: anchor, the 128-bit BLAKE2b digest of the stretch's words (b1, b2), doc_id, place, number of windows.  Equal
windows have equal anchors, so all that can match meets under one anchor, with about a sixth of the rows.

* A run is an immutable table of such rows, sorted by anchor, digest and doc_id.
* A batch is sorted the same way and merged with the runs in one pass: a stretch that is there with a
  smaller doc_id is a repetition as a whole; where one anchor has different stretches, they are open.
* Open stretches are verified on the texts: the digests of their windows' words are compared one by one.
* The batch's table then is a new run, and runs are compacted into one, with the least doc_id of each stretch,
  when there are more than ``fanout``.

``FingerprintIndex.open`` finds the index of an earlier job under its path: a small table names the runs and the texts that
belong to it.  Batches must come in ascending doc_id.

No task gets what one passage gathers: copies of a stretch that meet in one slice of documents are told repeated there and
do not travel; rows of the few anchors that a sample finds very often are dealt out by digest too, and are open unless
repeated; the join on window digests leaves skewed ones to adaptive execution.

Defined results: null and empty texts have no words; texts shorter than a window keep all words; rows that
share a doc_id do not repeat each other, whatever their texts; a row without doc_id has no place in the order, keeps its words
and takes none from others; doc_ids may be of any type that sorts; an empty table gives no rows.  Texts of any length are
read whole.  Only doc_id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, digests, discard, materialise, numbered, run_hashes, scratch_base, signed, slices, sliding_min, small_batches, word_hashes, word_spans

WIDTH, LEAD = 13, 4
FANOUT = 4
#: Rows of the sample that looks for frequent anchors, and how many of them make an anchor frequent: at most SAMPLE / FREQUENT are.
SAMPLE, FREQUENT = 1_000_000, 200
#: What runs and batches are sorted by.
ORDER = ("anchor", "b1", "b2", "doc_id")


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts with one space between words, one after another, and their offsets."""
    raw = data.tobytes()
    texts = [b" ".join(raw[a:b].split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return b"".join(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def stretches(hashes: np.ndarray, first: np.ndarray, width: int, lead: int) -> tuple[np.ndarray, ...]:
    """For values (word hashes) of all rows one after another: anchor, row, first value and number of windows of each stretch."""
    rows = len(first) - 1
    owner = np.repeat(np.arange(rows), np.diff(first))
    count = len(hashes) - width + 1
    none = np.zeros(0, np.int64)
    if count <= 0:
        return none.astype(np.uint64), none, none, none
    least = sliding_min(run_hashes(hashes, lead), width - lead + 1)[:count]
    inside = owner[:count] == owner[width - 1 :]
    new = np.ones(count, bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    new &= inside
    start = np.flatnonzero(new)
    if not len(start):
        return none.astype(np.uint64), none, none, none
    return least[start], owner[start], start, np.add.reduceat(inside.astype(np.int64), start)


def known_here(anchor: np.ndarray, digest: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether a stretch stands in the same slice with a smaller rank (of its doc_id)."""
    order = np.argsort(digest[:, 0], kind="stable")
    a, d, r = anchor[order], digest[order], rank[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1]).any(axis=1)
    out = np.zeros(len(a), bool)
    if len(a):
        out[order] = r > np.minimum.reduceat(r, np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def fingerprints(rows: DataFrame, width: int = WIDTH, lead: int = LEAD) -> DataFrame:
    """anchor, b1, b2, doc_id, row, at, n, known: a row for each stretch of each text (row, doc_id, text); known: a smaller doc_id
    in the same slice of texts has it."""
    small_batches(rows.sparkSession)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                raw, offsets = canonical(data, offsets)
                data = np.frombuffer(raw, np.uint8)
                starts, ends, first = word_spans(data, offsets, SPACES)
                anchor, row, start, n = stretches(word_hashes(data, starts, ends), first, width, lead)
                digest = digests(raw[a:b] for a, b in zip(starts[start].tolist(), ends[start + n + width - 2].tolist()))
                ids = part.column("doc_id").to_pylist()
                rank = {d: i for i, d in enumerate(sorted(set(ids)))}
                known = known_here(anchor, digest, np.array([rank[d] for d in ids])[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchor)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), part.column("doc_id").take(pa.array(row)), part.column("row").take(pa.array(row)),
                     pa.array((start - first[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(known)],
                    ["anchor", "b1", "b2", "doc_id", "row", "at", "n", "known"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", "text").where(F.col("doc_id").isNotNull()).mapInArrow(of, f"anchor long, b1 long, b2 long, doc_id {kind}, row long, at int, n int, known boolean")


def merge_sorted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, digest, doc_id in; out with ``open``: False for a stretch that a smaller doc_id
    has, True for one whose anchor has other stretches or is frequent; rows that match nothing are left out."""
    last = first_doc = None  # (anchor, b1, b2) of the last row, and the first doc_id of its stretch
    mixed = False  # whether the last row's anchor has shown two stretches
    held: list[pa.RecordBatch] = []  # rows of the last anchor that are open if another stretch follows

    def flagged(rows: pa.RecordBatch, value: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("row", "at", "n", "fresh")), pa.array([value] * rows.num_rows, pa.bool_())], ["row", "at", "n", "fresh", "open"])

    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        anchor, b1, b2 = (np.asarray(batch.column(c)) for c in ("anchor", "b1", "b2"))
        docs, hot = np.asarray(batch.column("doc_id")), np.asarray(batch.column("hot"))
        new_anchor, new_body = np.ones(size, bool), np.ones(size, bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_body[1:] = new_anchor[1:] | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])
        if last is not None:
            new_anchor[0] = anchor[0] != last[0]
            new_body[0] = new_anchor[0] or b1[0] != last[1] or b2[0] != last[2]
        group = np.cumsum(new_body)
        heads = np.flatnonzero(new_body)
        firsts = np.concatenate((docs[:1] if first_doc is None else np.array([first_doc], docs.dtype), docs[heads]))
        repeated = (docs > firsts[group]).astype(bool)
        block = np.cumsum(new_anchor)  # 0: still the last batch's anchor
        several = np.bincount(block, weights=(new_body & ~new_anchor) | hot, minlength=block[-1] + 1) > 0
        several[0] |= mixed
        if held and several[0]:
            yield from (flagged(h, True) for h in held)
        if held and (several[0] or block[-1] > 0):
            held = []
        is_open = ~repeated & several[block]
        for value, chosen in ((False, repeated), (True, is_open)):
            if chosen.any():
                yield flagged(batch.filter(pa.array(chosen)), value)
        mixed = bool(several[block[-1]])
        waiting = ~repeated & (block == block[-1])
        if not mixed and waiting.any():
            held.append(batch.filter(pa.array(waiting)))
        last, first_doc = (anchor[-1], b1[-1], b2[-1]), firsts[group[-1]]


def frequent_anchors(rows: DataFrame) -> DataFrame:
    """anchor: those with at least FREQUENT of about SAMPLE rows, so at most SAMPLE / FREQUENT of them."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    return rows.select("anchor").sample(fraction=share, seed=3).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).select("anchor")


@dataclass
class FingerprintIndex:
    """Runs of stretches in the shared folder, and the texts they came from."""

    width: int = WIDTH
    lead: int = LEAD
    fanout: int = FANOUT
    path: str | None = None
    runs: list[DataFrame] = field(default_factory=list)
    texts: list[DataFrame] = field(default_factory=list)
    version: int = 0

    @staticmethod
    def open(spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that an earlier job left under path, in its newest state."""
        rows = spark.read.parquet(f"{path}/state")
        version = rows.agg(F.max("version")).first()[0]
        state = rows.where(F.col("version") == version).collect()  # a row for each run and table of texts
        made = FingerprintIndex(state[0]["width"], state[0]["lead"], state[0]["fanout"], path, version=version)
        for r in state:
            (made.runs if r["kind"] == "run" else made.texts).append(spark.read.parquet(r["table"]))
        return made

    def save(self, spark: SparkSession) -> None:
        """Adds the state to the table of states under the path; the newest one counts."""
        if self.path is None:
            self.path = f"{scratch_base(spark)}/loomstream-window-index-{uuid.uuid4().hex}"
        self.version += 1
        place = lambda df: df.inputFiles()[0].rsplit("/", 1)[0]
        state = [(self.version, kind, place(df), self.width, self.lead, self.fanout) for kind, tables in (("run", self.runs), ("texts", self.texts)) for df in tables if df.inputFiles()]
        spark.createDataFrame(state, "version int, kind string, table string, width int, lead int, fanout int").coalesce(1).write.mode("append").parquet(f"{self.path}/state")

    def match(self, batch: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame]:
        """(row, at, n, fresh, open) of the batch's matches with itself and history, and the batch's own stretches, sorted as a
        run unless no batch follows."""
        fresh = fingerprints(batch, self.width, self.lead)
        fresh = materialise(fresh if last else self.ordered(fresh), "window-rows")
        rows = fresh.where(~F.col("known")).drop("known").withColumn("fresh", F.lit(True))
        for run in self.runs:
            rows = rows.unionByName(run.where(~F.col("known")).drop("known").withColumn("fresh", F.lit(False)))
        often = frequent_anchors(rows).withColumn("hot", F.lit(True))
        rows = rows.join(F.broadcast(often), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))  # at most SAMPLE / FREQUENT rows
        dealt = rows.withColumn("part", F.when(F.col("hot"), F.col("b1")).otherwise(0)).repartition("anchor", "part").drop("part")
        merged = dealt.sortWithinPartitions(*ORDER).mapInArrow(merge_sorted, "row long, at int, n int, fresh boolean, open boolean")
        here = fresh.where("known").select("row", "at", "n", F.lit(True).alias("fresh"), F.lit(False).alias("open"))
        return merged.unionByName(here), fresh

    @staticmethod
    def ordered(rows: DataFrame) -> DataFrame:
        return rows.repartition("anchor", "b1", "b2").sortWithinPartitions(*ORDER)

    def append(self, fresh: DataFrame) -> None:
        """Adds the batch's stretches as a run, and compacts."""
        self.runs.append(fresh)
        if len(self.runs) > self.fanout:
            whole = self.runs[0]
            for run in self.runs[1:]:
                whole = whole.unionByName(run)
            first = F.min(F.struct("doc_id", "row", "at", "n", "known")).alias("x")
            compacted = materialise(self.ordered(whole.where(~F.col("known")).groupBy("anchor", "b1", "b2").agg(first).select("anchor", "b1", "b2", "x.*")), "window-run")
            discard(*self.runs)
            self.runs = [compacted]

    def removed(self, batch: DataFrame, texts: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame]:
        """row, at, n of the batch's windows that a smaller doc_id has, and the batch's stretches for append().  texts: row, doc_id
        and text of history and batch."""
        matches, fresh = self.match(batch, last)
        matches = materialise(matches, "window-matches")
        found = matches.where(F.col("fresh") & ~F.col("open")).select("row", "at", "n")
        # Windows of history may come up again here; they were decided with their own batch, the same way.
        checked, used = verify(matches.where("open").select("row", "at", "n"), texts, self.width)
        gone = materialise(found.unionByName(checked), "window-removed")
        discard(matches, *used)
        return gone, fresh

    def add(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_words, n_removed, kept of a new batch of documents, all with doc_ids above those of history; the batch
        becomes part of the index, and its state is saved."""
        spark = docs.sparkSession
        after = max([t.agg(F.max("row")).first()[0] or 0 for t in self.texts], default=-1) + 1
        rows = docs.select((F.monotonically_increasing_id() + after).alias("row"), "doc_id", "text")
        rows = materialise(rows, "rows")
        self.texts.append(rows)
        texts = self.texts[0]
        for t in self.texts[1:]:
            texts = texts.unionByName(t)
        gone, fresh = self.removed(rows, texts)
        self.append(fresh)
        self.save(spark)
        return without(gone.distinct(), rows, self.width)


def windows_of(spans: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """d1, d2 (digest of its words), doc_id, row, at: a row for each window of each span (row, spans)."""
    small_batches(texts.sparkSession)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                raw, offsets = canonical(data, offsets)
                starts, ends, first = word_spans(np.frombuffer(raw, np.uint8), offsets, SPACES)
                spans = part.column("spans")
                row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(spans.offsets)))
                inner = spans.flatten()
                at, n = (np.asarray(inner.field(k)).astype(np.int64) for k in range(2))
                owner = np.repeat(row, n)
                place = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                k = first[owner] + place
                digest = digests(raw[a:b] for a, b in zip(starts[k].tolist(), ends[k + width - 1].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest[:, 0]), pa.array(digest[:, 1]), part.column("doc_id").take(pa.array(owner)), part.column("row").take(pa.array(owner)), pa.array(place.astype(np.int32))],
                    ["d1", "d2", "doc_id", "row", "at"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    joined = texts.join(spans, "row").select("row", "doc_id", "text", "spans")
    return joined.mapInArrow(of, f"d1 long, d2 long, doc_id {kind}, row long, at int")


def verify(open_spans: DataFrame, texts: DataFrame, width: int) -> tuple[DataFrame, list[DataFrame]]:
    """row, at, n=1 of the windows of open spans that a smaller doc_id has, and the tables that this reads."""
    spans = open_spans.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    windows = materialise(windows_of(spans, texts, width), "windows")
    least = windows.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where(F.col("least") < F.col("most"))
    least = materialise(least.drop("most"), "window-least")  # a table of its own, so that the join can split skewed digests
    hit = windows.join(least, ["d1", "d2"]).where(F.col("doc_id") > F.col("least"))
    return hit.select("row", "at", F.lit(1).alias("n")), [windows, least]


def without(removed: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text) for each of rows, less the windows of removed (row, at, n)."""
    spans = removed.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("spans"))

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, kept = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                words = (text.as_py() or "").encode().split()
                counts.append(len(words))
                n = 0
                if spans:
                    cut = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        cut[s["at"]] += 1
                        cut[s["at"] + s["n"] - 1 + width] -= 1
                    cut = np.cumsum(cut[:-1]) > 0
                    n = int(cut.sum())
                    words = [w for w, c in zip(words, cut.tolist()) if not c]
                gone.append(n)
                kept.append(b" ".join(words))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    joined = rows.join(spans, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(of, f"doc_id {kind}, n_words long, n_removed long, kept string")


def batch_edges(rows: DataFrame, batches: int) -> list:
    """doc_ids that cut rows into so many batches, about, from a sample of at most some thousands."""
    if batches < 2:
        return []
    known = rows.select("doc_id").where(F.col("doc_id").isNotNull())
    drawn = sorted(r[0] for r in known.sample(fraction=min(1.0, 4000 / max(1, known.count())), seed=5).collect())
    return sorted({drawn[len(drawn) * k // batches] for k in range(1, batches)}) if drawn else []


def deduplicate(docs: DataFrame, batches: int = 1, width: int = WIDTH, lead: int = LEAD, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_words, n_removed, kept for each row of docs, which enter a new index in so many batches of
    ascending doc_id."""
    rows = numbered(docs)
    index = FingerprintIndex(width, lead, fanout)
    edges = batch_edges(rows, batches)
    removed = None
    for k in range(len(edges) + 1):
        batch = rows
        if k:
            batch = batch.where(F.col("doc_id") > edges[k - 1])
        if k < len(edges):
            batch = batch.where(F.col("doc_id") <= edges[k])
        gone, fresh = index.removed(batch, rows, last=k == len(edges))
        removed = gone if removed is None else removed.unionByName(gone)
        if k < len(edges):
            index.append(fresh)
        else:
            discard(fresh, *index.runs)
    return without(removed.distinct(), rows, width)
