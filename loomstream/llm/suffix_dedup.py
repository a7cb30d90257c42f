"""Exact substring deduplication with a distributed sparse suffix array.

A byte is removed if a string of LENGTH bytes around it also starts anywhere else, in another text or at
another place of its own.  A full suffix array would ship every suffix; this one holds the suffixes that
start at anchors: every string of LENGTH bytes is filed under the first place of the least hash of the LEAD-byte strings in it.
Equal strings have their anchors at the same place, so every repetition shows at an anchor, with about one
suffix for 85 bytes.  Consecutive strings with one anchor make one stretch; its key is the suffix's first LEAD
bytes (its leading tokens) and then the 128-bit BLAKE2b digest of all the stretch's bytes.

* Splitters are a sorted sample of keys; they deal the suffixes out into buckets of like size by leading
  bytes.  A key that takes up several splitters is spread over all buckets between them.
* A bucket sorts its suffixes by multikey quicksort: on eight leading bytes, then, among ties only, on the next eight.
* Neighbours are compared in each bucket, and across boundaries by each bucket's first and last key: a
  stretch that stands twice is a repetition as a whole; suffixes that share their leading bytes but not their
  stretch are open.
* The strings of open stretches are taken from the texts.  Those under one anchor are brought together by a hash and then
  compared byte by byte; where an anchor has very many, they meet by a shuffle on the 128-bit digest of each string.

Defined results: a null text is an empty one; texts shorter than LENGTH keep all bytes; a row that repeats
another has all its bytes removed, as the other has, if it is LENGTH bytes long; an empty table gives no
rows.  Rows are told apart by a number of their own, so a doc_id may be null, repeat or be of any type.  Only the
columns doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import digests, discard, fixed_bytes, loads, materialise, mix, numbered, signed, slices, sliding_min, small_batches

LENGTH, LEAD, DIGEST = 200, 32, 16
#: Suffixes of a bucket, about, and sampled keys for each bucket.  Beyond MANY buckets these grow to LARGE suffixes, and fewer
#: keys are sampled for each, so that splitters stay at 48 bytes for LARGE suffixes.
BUCKET, SAMPLED, MANY, LARGE = 50_000, 20, 1 << 16, 500_000
#: Open stretches that are compared in one task, about, and those of one anchor at most.
PIECES, TOGETHER = 4_000, 50_000
#: Bytes that are compared at once.
COMPARED = 1 << 22


def byte_runs(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive bytes, put together from halves."""
    count = max(0, len(data) - n + 1)
    with np.errstate(over="ignore"):
        h = loads(data) & np.uint64(0xFFFFFFFFFFFFFFFF if n >= 8 else (1 << 8 * n) - 1)
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        have = min(8, n)
        while have < n:
            step = min(have, n - have)
            h = h[: len(h) - step] * np.uint64(0xD6E8FEB86659FD93) + h[step:]
            h ^= h >> np.uint64(29)
            have += step
        return h[:count] * np.uint64(0xBF58476D1CE4E5B9)


def whole_strings(count: int, offsets: np.ndarray, length: int) -> np.ndarray:
    """Whether each of so many strings of length bytes lies between two offsets."""
    inside = np.ones(max(0, count), bool)
    for edge in offsets[1:-1]:
        inside[max(0, edge - length + 1) : edge] = False
    return inside


def byte_stretches(data: np.ndarray, offsets: np.ndarray, length: int, lead: int) -> tuple[np.ndarray, ...]:
    """row, first string, number of strings and anchor of each stretch."""
    count = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if count <= 0:
        return none, none, none, none
    leads = byte_runs(data, lead) >> np.uint64(32) << np.uint64(32)
    # The place of the first least value in each string: value in the upper half, place in the lower.
    least = sliding_min(leads | np.arange(len(leads), dtype=np.uint64), length - lead + 1)[:count]
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = whole_strings(count, offsets, length)
    new = np.ones(count, bool)
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    new &= inside
    start = np.flatnonzero(new)
    if not len(start):
        return none, none, none, none
    n = np.add.reduceat(inside.astype(np.int64), start)
    return np.searchsorted(offsets, start, "right") - 1, start, n, place[start]


def suffixes(rows: DataFrame, length: int, lead: int) -> DataFrame:
    """row, key (leading bytes, then the digest of the stretch), at, n: a row for each stretch."""
    small_batches(rows.sparkSession)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                row, start, n, anchor = byte_stretches(data, offsets, length, lead)
                raw = data.tobytes()
                spans = zip(anchor.tolist(), start.tolist(), (start + n + length - 1).tolist())
                keys = [raw[a : a + lead] + blake2b(raw[s:e], digest_size=DIGEST).digest() for a, s, e in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(pa.array(row)), pa.array(keys, pa.binary()), pa.array((start - offsets[row]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["row", "key", "at", "n"],
                )

    return rows.select("row", "text").mapInArrow(of, "row long, key binary, at int, n int")


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of words (n x d): by the first word, and among ties by the next, and so on."""
    order = np.argsort(words[:, 0], kind="stable")
    tied = np.zeros(len(words), np.int64)  # the tie that each place in order belongs to
    for d in range(1, words.shape[1]):
        same = (words[order[1:], d - 1] == words[order[:-1], d - 1]) & (tied[1:] == tied[:-1])
        tied = np.concatenate(([0], np.cumsum(~same)))
        in_tie = np.zeros(len(words), bool)
        in_tie[1:] |= same
        in_tie[:-1] |= same
        at = np.flatnonzero(in_tie)
        if not len(at):
            break
        rows = order[at]
        order[at] = rows[np.lexsort((words[rows, d], tied[at]))]
    return order


def bucket_count(total: int) -> int:
    return max(1, min(MANY, -(-total // BUCKET)), -(-total // LARGE))


def deal_out(rows: DataFrame, lead: int) -> DataFrame:
    """rows with ``bucket``, between sampled splitters."""
    total = rows.count()
    count, width = bucket_count(total), lead + DIGEST
    sampled = SAMPLED if count <= MANY else SAMPLED // 5
    drawn = rows.select("key").sample(fraction=min(1.0, count * sampled / max(1, total)), seed=11).toArrow()
    drawn = np.sort(fixed_bytes(drawn.column("key"), width).view(f"S{width}").ravel())
    splitters = drawn[np.linspace(0, len(drawn) - 1, count + 1).astype(int)[1:-1]] if len(drawn) else drawn
    shared = rows.sparkSession.sparkContext.broadcast(splitters)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = fixed_bytes(batch.column("key"), width).view(f"S{width}").ravel()
            low = np.searchsorted(shared.value, keys, "left")
            high = np.searchsorted(shared.value, keys, "right")
            spread = np.asarray(batch.column("at")).astype(np.int64) * 31 + np.arange(len(keys))
            bucket = low + spread % (high - low + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket, pa.int32())], [*batch.schema.names, "bucket"])

    return rows.mapInArrow(of, rows.withColumn("bucket", F.lit(0)).schema)


def boundaries(dealt: DataFrame, lead: int) -> tuple[set[bytes], set[bytes]]:
    """From each bucket's first and last suffix: the keys that several buckets hold, and the leading bytes
    that show different stretches across a boundary."""
    ends = dealt.groupBy("bucket").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()  # two keys a bucket
    seen: dict[bytes, int] = {}
    bodies: dict[bytes, set[bytes]] = {}
    holders: dict[bytes, int] = {}
    for r in ends:
        own = {bytes(r["first"]), bytes(r["last"])}
        for key in own:
            seen[key] = seen.get(key, 0) + 1
            bodies.setdefault(key[:lead], set()).add(key)
        for head in {key[:lead] for key in own}:
            holders[head] = holders.get(head, 0) + 1
    return {k for k, n in seen.items() if n > 1}, {h for h, n in holders.items() if n > 1 and len(bodies[h]) > 1}


#: What compare_bucket() says of a stretch: it stands twice; it is open; it is one that open ones may match.
REPEATED, OPEN, PARTNER = 0, 1, 2


def compare_bucket(lead: int, shared):
    def of(bucket: pa.Table) -> pa.Table:
        again, across = shared.value
        keys = fixed_bytes(bucket.column("key"), lead + DIGEST)
        words = keys.view(">u8").astype(np.uint64)
        order = multikey_order(words)
        w = words[order]
        new_key = np.ones(len(w), bool)
        new_key[1:] = (w[1:] != w[:-1]).any(axis=1)
        new_head = np.ones(len(w), bool)
        new_head[1:] = (w[1:, : lead // 8] != w[:-1, : lead // 8]).any(axis=1)
        key, head = np.cumsum(new_key) - 1, np.cumsum(new_head) - 1
        first_of_key, first_of_head = np.flatnonzero(new_key), np.flatnonzero(new_head)
        several = np.bincount(key) > 1
        mixed = np.bincount(head[first_of_key]) > 1
        if again or across:
            for place in {0, len(first_of_key) - 1}:  # only these can go on in another bucket
                several[place] |= keys[order[first_of_key[place]]].tobytes() in again
            for place in {0, len(first_of_head) - 1}:
                mixed[place] |= keys[order[first_of_head[place]]].tobytes()[:lead] in across
        repeated = several[key]
        anchor = np.zeros(len(w), np.uint64)
        for column in w.T[: lead // 8]:
            anchor = mix(anchor ^ column)
        shown = mixed[head]
        chosen = [(REPEATED, np.flatnonzero(repeated)), (OPEN, np.flatnonzero(shown & ~repeated)), (PARTNER, np.flatnonzero(shown & repeated & new_key))]
        at = np.concatenate([c for _, c in chosen])
        rows = bucket.select(["row", "at", "n"]).take(pa.array(order[at]))
        rows = rows.append_column("kind", pa.array(np.concatenate([np.full(len(c), k, np.int32) for k, c in chosen])))
        return rows.append_column("anchor", pa.array(signed(anchor[at])))

    return of


def same_strings(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the length bytes from each place of a are those from the place of b.  Neighbours with neighbours as
    partners are compared in one go."""
    good = np.zeros(len(a), bool)
    order = np.lexsort((a, b - a))
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1)
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(x))) + length - 1  # bytes of each run of pairs
    cut = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + COMPARED, COMPARED)))
    cut = np.unique(np.concatenate(([0], cut, [len(first)])))
    for low, high in zip(cut[:-1], cut[1:]):
        size = sizes[low:high]
        begin = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(begin, size)
        differ = data[np.repeat(x[first[low:high]], size) + step] != data[np.repeat(y[first[low:high]], size) + step]
        bad = np.concatenate(([0], np.cumsum(differ)))
        pairs = size - length + 1
        at = np.repeat(begin, pairs) + np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        good[order[first[low] : first[low] + pairs.sum()]] = bad[at + length] == bad[at]
    return good


def repeated_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece (bytes between offsets): whether each of its strings stands twice among all pieces."""
    count = len(data) - length + 1
    place = np.flatnonzero(whole_strings(count, offsets, length))
    h = byte_runs(data, length)[place]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    alike = np.flatnonzero(same)
    good = same_strings(data, place[order[alike]], place[order[alike + 1]], length)
    twice = np.zeros(len(h), bool)
    twice[order[alike]] = True
    twice[order[alike + 1]] = True
    if not good.all():  # different strings under one hash: their group is sorted out one by one
        group = np.concatenate(([0], np.cumsum(~same)))
        for g in np.unique(group[alike[~good]]):
            members = order[group == g]
            strings = [data[p : p + length].tobytes() for p in place[members]]
            twice[members] = [strings.count(s) > 1 for s in strings]
    whole = np.zeros(max(0, count), bool)
    whole[place[twice]] = True
    return [whole[offsets[i] : offsets[i + 1] - length + 1] for i in range(len(offsets) - 1)]


def compare_pieces(length: int):
    def of(bucket: pa.Table) -> pa.Table:
        piece = bucket.column("piece").combine_chunks()
        ends = np.frombuffer(piece.buffers()[1], np.int32)[piece.offset : piece.offset + len(piece) + 1].astype(np.int64)
        data = np.frombuffer(piece.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        found = repeated_runs(data, ends - ends[0], length)
        kind, at = bucket.column("kind").to_pylist(), bucket.column("at").to_pylist()
        row, starts, counts = [], [], []
        for i, twice in enumerate(found):
            if kind[i] == OPEN and twice.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], twice.astype(np.int8), [0]))))
                for a, b in edge.reshape(-1, 2).tolist():
                    row.append(i)
                    starts.append(at[i] + a)
                    counts.append(b - a)
        rows = bucket.column("row").combine_chunks().take(pa.array(row, pa.int64()))
        return pa.table({"row": rows, "at": pa.array(starts, pa.int32()), "n": pa.array(counts, pa.int32())})

    return of


def pieces_of(open_rows: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """anchor, row, at, kind, piece (the stretch's bytes) for each open stretch and partner."""
    spans = open_rows.groupBy("row").agg(F.collect_list(F.struct("at", "n", "kind", "anchor")).alias("spans"))

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                raw = data.tobytes()
                out: list[tuple] = []
                row = []
                for i, spans in enumerate(part.column("spans").to_pylist()):
                    base = int(offsets[i])
                    for s in spans:
                        a = base + s["at"]
                        out.append((s["anchor"], s["at"], s["kind"], raw[a : a + s["n"] - 1 + length]))
                        row.append(i)
                columns = list(zip(*out)) or [(), (), (), ()]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["row", "anchor", "at", "kind", "piece"]
                )

    joined = texts.join(spans, "row").select("row", "text", "spans")
    return joined.mapInArrow(of, "row long, anchor long, at int, kind int, piece binary")


def strings_of(pieces: DataFrame, length: int) -> DataFrame:
    """h1, h2 (its digest), row, at, kind of every string of the pieces."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, piece in enumerate(batch.column("piece").to_pylist()):
                h = digests(piece[k : k + length] for k in range(len(piece) - length + 1))
                same = pa.array(np.full(len(h), i))
                at = np.arange(len(h), dtype=np.int32) + batch.column("at")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("row").take(same), pa.array(at), batch.column("kind").take(same)], ["h1", "h2", "row", "at", "kind"]
                )

    return pieces.select("row", "at", "kind", "piece").mapInArrow(of, "h1 long, h2 long, row long, at int, kind int")


def repeated_strings(rows: DataFrame, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """row, at, n: runs of n strings, the first at byte ``at``, that start elsewhere too; rows has row and text."""
    spark = rows.sparkSession
    array = materialise(suffixes(rows, length, lead), "suffixes")
    dealt = deal_out(array, lead)
    shared = spark.sparkContext.broadcast(boundaries(dealt, lead))
    compared = materialise(dealt.groupBy("bucket").applyInArrow(compare_bucket(lead, shared), "row long, at int, n int, kind int, anchor long"), "suffix-matches")
    discard(array)
    found = compared.where(F.col("kind") == REPEATED).select("row", "at", "n")
    pieces = materialise(pieces_of(compared.where(F.col("kind") != REPEATED), rows, length), "suffix-pieces")
    anchors = pieces.groupBy("anchor").agg(F.count("*").alias("size"))
    hot = anchors.where(F.col("size") > TOGETHER).select("anchor")
    groups = max(1, -(-pieces.count() // PIECES))
    few = pieces.join(hot, "anchor", "left_anti").withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)))
    found = found.unionByName(few.groupBy("group").applyInArrow(compare_pieces(length), "row long, at int, n int"))
    used = [compared, pieces]
    if not hot.isEmpty():
        strings = materialise(strings_of(pieces.join(hot, "anchor", "left_semi"), length), "suffix-strings")
        twice = strings.groupBy("h1", "h2").agg(F.count("*").alias("size")).where(F.col("size") > 1)
        found = found.unionByName(strings.where(F.col("kind") == OPEN).join(twice, ["h1", "h2"]).select("row", "at", F.lit(1).alias("n")))
        used.append(strings)
    found = materialise(found, "suffix-found")
    discard(*used)
    return found


def deduplicate(docs: DataFrame, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) for each row of docs."""
    rows = numbered(docs)
    spans = repeated_strings(rows, length, lead).groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("spans"))

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, runs, kept = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                raw = (text.as_py() or "").encode()
                n_gone = n_runs = at = 0
                parts = []
                for a, b in sorted((s["at"], s["at"] + s["n"] - 1 + length) for s in spans.as_py() or ()):
                    if n_runs == 0 or a > at:
                        parts.append(raw[at:a])
                        n_runs += 1
                        n_gone += b - a
                        at = b
                    elif b > at:
                        n_gone += b - at
                        at = b
                parts.append(raw[at:])
                sizes.append(len(raw))
                gone.append(n_gone)
                runs.append(n_runs)
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    joined = rows.join(spans, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(of, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
