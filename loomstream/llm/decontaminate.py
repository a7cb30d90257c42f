"""Benchmark decontamination with suffix arrays over the training text.

Every slice of documents is a shard with a suffix array over its words: positions sorted by the words that follow.
Every suffix of the benchmark (of a window's words or more; of an item of fewer words, the item) is looked up in every
shard by binary search.  The suffixes between its two bounds are all verbatim occurrences of its leading window, with document
and position; following both texts from there gives how far each of them goes on, and so the longest match.  Three things
keep this cheap:

* words outside the benchmark's vocabulary are word 0, which matches nothing;
* only positions whose leading words occur in the benchmark at all (a hash test on the first few words)
  enter the array, which is therefore short, and complete for the benchmark;
* the array is sorted on as many words as a window has.

Words stand for themselves by 64-bit hashes until something is found; then the words found are compared as text, and a
document's word that only shared a hash becomes word 0 before the shard is searched again.

A window is ``width`` consecutive words of an item; an item of fewer, but not none, is one window.  A
document word inside any occurrence of a window is hit.  Words are lower-cased (A-Z only) runs of 0-9, a-z
and characters above U+007F.

The benchmark is broadcast in blocks of at most ``block_words`` words, one at a time, so what driver and executors hold of
it has a fixed bound however large the benchmark is; a Python worker prepares a block once.  With several blocks the documents
are written once with a key for each row, read once for each block, and hits of all blocks are put together by that key.

Defined results: null and empty texts have no words and are not contaminated; repeated rows get the same
result each, rows that share a doc_id or have none their own; an empty benchmark
hits nothing; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, NON_ALNUM, discard, keyed, materialise, run_hashes, slices, small_batches, word_hashes, word_spans

WIDTH = 13
#: Words of benchmark items that are broadcast at once.
BLOCK_WORDS = 2_000_000
#: Leading words whose hash admits a position to the suffix array.
LEAD = 4


class Words:
    """The words of a slice of texts: their hashes, their bytes, and the index of each row's first word (n + 1 values)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.ends, self.first = word_spans(data, offsets, NON_ALNUM)
        self.hashes = word_hashes(self.data, self.starts, self.ends)

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


class Suffixes:
    """The suffixes of a block of items, ready to be looked up.  ``flat`` holds all items' words one after another, each item
    followed by a 0."""

    def __init__(self, items: pa.Table, width: int):
        self.width = width
        names, hashes, self.words = [], [], {}
        for batch in items.to_batches():
            for part, data, offsets in slices(batch, "text"):
                words = Words(data, offsets)
                names += part.column("item_id").to_pylist()
                hashes += np.split(words.hashes, words.first[1:-1])
                for k in np.unique(words.hashes, return_index=True)[1]:
                    self.words.setdefault(int(words.hashes[k]), words.text(k))
        self.vocabulary = np.array(sorted(self.words), np.uint64)
        self.texts = [self.words[int(h)] for h in self.vocabulary]
        self.items = sorted(set(names), key=str)
        number = {name: i for i, name in enumerate(self.items)}
        count = np.array([len(h) for h in hashes], np.int64)
        lengths = np.minimum(width, count)  # of an item's windows
        windows = np.where(count > 0, count - lengths + 1, 0)
        begin = np.cumsum(count + 1) - (count + 1)
        self.flat = np.zeros(int((count + 1).sum()), np.uint32)
        for b, h in zip(begin.tolist(), hashes):
            self.flat[b : b + len(h)] = self.ids(h)
        self.at_item = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        self.place = np.repeat(begin, windows) + self.at_item
        self.lengths = np.repeat(lengths, windows)
        self.owner = np.repeat(np.array([number[x] for x in names], np.int64), windows) if names else np.zeros(0, np.int64)
        inside = np.arange(width) < self.lengths[:, None]
        self.keys = np.where(inside, self.flat[np.minimum(self.place[:, None] + np.arange(width), len(self.flat) - 1)], 0).astype(">u4") if len(self.flat) else np.zeros((0, width), ">u4")
        self.leads = {}  # length of lead -> sorted hashes of leading words
        short = np.minimum(LEAD, self.lengths)
        for n in np.unique(short).tolist():
            self.leads[n] = np.unique(run_hashes(np.ascontiguousarray(self.keys[short == n, :n]).astype(np.uint64).ravel(), n)[::n])

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word from 1, 0 for others."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.uint32)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0).astype(np.uint32)

    def search(self, ids: np.ndarray, row_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of the suffix of each occurrence of a window in ids, where row_end holds the end of each
        position's row."""
        wanted = np.zeros(len(ids), bool)
        for n, known in self.leads.items():
            lead = run_hashes(ids.astype(np.uint64), n)
            at = np.minimum(np.searchsorted(known, lead), len(known) - 1)
            wanted[: len(lead)] |= known[at] == lead
        places = np.flatnonzero(wanted & (ids > 0))
        if not len(places):
            return places, places
        reach = places[:, None] + np.arange(self.width)
        inside = reach < row_end[places][:, None]
        suffixes = np.where(inside, ids[np.minimum(reach, len(ids) - 1)], 0).astype(">u4")
        kind = f"S{4 * self.width}"
        keyed = np.ascontiguousarray(suffixes).view(kind).ravel()
        order = np.argsort(keyed, kind="stable")  # the suffix array
        array = keyed[order]
        high_key = self.keys.copy()
        high_key[np.arange(self.width) >= self.lengths[:, None]] = 0xFFFFFFFF
        low = np.searchsorted(array, np.ascontiguousarray(self.keys).view(kind).ravel(), "left")
        high = np.searchsorted(array, high_key.view(kind).ravel(), "right")
        count = high - low
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return places[order[at]], np.repeat(np.arange(len(count)), count)

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of the suffix, and length in words of each match of a window or more."""
        ids = self.ids(words.hashes)
        row_end = np.repeat(words.first[1:], np.diff(words.first))
        while True:
            starts, suffix = self.search(ids, row_end)
            found = np.zeros(len(ids) + 1, np.int64)
            np.add.at(found, starts, 1)
            np.add.at(found, starts + self.lengths[suffix], -1)
            false = [k for k in np.flatnonzero(np.cumsum(found) > 0).tolist() if words.text(k) != self.texts[ids[k] - 1]]
            if not false:
                break
            ids[false] = 0
        length = self.lengths[suffix].copy()
        going = np.flatnonzero(length == self.width)
        while len(going):
            k = starts[going] + length[going]
            mine = self.flat[self.place[suffix[going]] + length[going]]
            same = (k < row_end[starts[going]]) & (mine > 0)
            same[same] = ids[k[same]] == mine[same]
            same[same] = [words.text(x) == self.texts[ids[x] - 1] for x in k[same].tolist()]
            going = going[same]
            length[going] += 1
        return starts, suffix, length


_prepared: dict[str, Suffixes] = {}


def prepared(block, width: int) -> Suffixes:
    """The suffixes of a broadcast block (its name and items), made once in a worker; it holds one block at a time."""
    name, items = block.value
    if name not in _prepared:
        _prepared.clear()
        _prepared[name] = Suffixes(items, width)
    return _prepared[name]


def spans_of(starts: np.ndarray, lengths: np.ndarray, n_words: int) -> list[list[int]]:
    """The union of runs of words, as pairs of start and end."""
    marks = np.zeros(n_words + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + lengths, -1)
    hit = np.concatenate(([0], (np.cumsum(marks[:-1]) > 0).astype(np.int8), [0]))
    edge = np.flatnonzero(np.diff(hit))
    return edge.reshape(-1, 2).tolist()


HITS = "key {id}, n_words long, spans array<array<int>>, items array<{item}>, matches array<struct<item_id:{item},item_at:int,at:int,n:int>>"


def find_hits(docs: DataFrame, items: DataFrame, width: int, key: str) -> tuple[DataFrame, object]:
    """key, n_words, spans of hit words, items found, matches (the longest one at each place: item and place in it, place in the
    document, words) for each row; items (item_id, text) is one block.  Also the broadcast, which whoever runs this ends."""
    spark = docs.sparkSession
    small_batches(spark)
    found = items.select("item_id", "text").toArrow()  # at most a block
    block = spark.sparkContext.broadcast((uuid.uuid4().hex, found))
    kind = found.schema.field("item_id").type
    match = pa.list_(pa.struct([("item_id", kind), ("item_at", pa.int32()), ("at", pa.int32()), ("n", pa.int32())]))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = prepared(block, width)
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                words = Words(data, offsets)
                first, per_row = words.first, np.diff(words.first)
                starts, suffix, n = suffixes.occurrences(words)
                row = np.searchsorted(first, starts, "right") - 1
                order = np.lexsort((-n, starts))
                starts, suffix, n, row = starts[order], suffix[order], n[order], row[order]
                lengths, owners = suffixes.lengths[suffix], suffixes.owner[suffix]
                reach = starts + n
                # A match that is the tail of the one before it adds nothing to what that one says.
                longest = np.ones(len(starts), bool)
                longest[1:] = (reach[1:] > np.maximum.accumulate(reach)[:-1]) | (row[1:] != row[:-1])
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                spans, items_found, matches = [], [], []
                for i in range(part.num_rows):
                    a, b = cut[i], cut[i + 1]
                    spans.append(spans_of(starts[a:b] - first[i], lengths[a:b], int(per_row[i])) if a < b else [])
                    items_found.append([suffixes.items[k] for k in np.unique(owners[a:b])])
                    own = a + np.flatnonzero(longest[a:b])
                    matches.append([
                        {"item_id": suffixes.items[owners[k]], "item_at": int(suffixes.at_item[suffix[k]]), "at": int(starts[k] - first[i]), "n": int(n[k])} for k in own
                    ])
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(per_row, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items_found, pa.list_(kind)), pa.array(matches, match)],
                    ["key", "n_words", "spans", "items", "matches"],
                )

    schema = HITS.format(id=docs.schema[key].dataType.simpleString(), item=items.schema["item_id"].dataType.simpleString())
    return docs.select(key, "text").mapInArrow(search, schema), block


def item_blocks(items: DataFrame, block_words: int) -> list[DataFrame]:
    """The items in blocks of about block_words words at most (an item is never split)."""
    sized = items.select("item_id", "text").withColumn("__n", F.coalesce(F.length("text"), F.lit(0)))
    total = sized.agg(F.sum("__n").alias("n")).first()["n"] or 0
    count = max(1, -(-total // (2 * block_words)))  # a word and what separates it are two characters at least
    if count == 1:
        return [sized.drop("__n")]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    return [sized.where(part == i).drop("__n") for i in range(count)]


def hit_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (array of the items found), matches (item_id, item_at, at, n: the longest verbatim matches
    by place in the document) for each row of docs."""
    blocks = item_blocks(items, block_words)
    if len(blocks) == 1:
        hits = find_hits(docs, blocks[0], width, "doc_id")[0].withColumnRenamed("key", "doc_id")
    else:  # each row has a key of its own through all blocks, as doc_id may be null or repeat
        rows = materialise(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "benchmark-rows")
        parts = []
        for own in blocks:
            found, block = find_hits(rows, own, width, "row")
            parts.append(materialise(found, "benchmark-hits"))
            block.destroy()
        hits = parts[0]
        for part in parts[1:]:
            hits = hits.unionByName(part)
        together = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  of one row: at most as many as its words for each block
        hits = hits.groupBy("key").agg(F.max("n_words").alias("n_words"), together("spans"), together("items"), together("matches"))
        hits = materialise(rows.select(F.col("row").alias("key"), "doc_id").join(hits, "key").withColumn("spans", F.array_sort("spans")), "benchmark-found")
        discard(rows, *parts)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s[1] - F.greatest(s[0], acc["end"]))).alias("n"), F.greatest(acc["end"], s[1]).alias("end")
    )
    n_hit = F.aggregate("spans", start, step, lambda acc: acc["n"]).cast("long")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.array_distinct("items").alias("items"), "matches")


def longest_matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, item_at, n, doc_id, at: for each place of an item where a match of a window or more begins, the longest verbatim
    one among all documents and where it stands; of equally long ones the one in the least doc_id, then at the least place."""
    found = hit_spans(docs, items, width, block_words).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
    order = F.struct((-F.col("n")).alias("n"), "doc_id", "at")
    best = found.groupBy("item_id", "item_at").agg(F.min(order).alias("b"))
    return best.select("item_id", "item_at", (-F.col("b.n")).alias("n"), "b.doc_id", "b.at")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that are not contaminated."""
    held, own = keyed(docs)
    found = hit_spans(held.select(F.col(f"`{own}`").alias("doc_id"), "text"), items, width, block_words)
    bad = found.where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias(own))
    return held.join(bad, own, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
