"""Near duplicates by SetSketch registers, likelihood estimation and confirmation on full sets.

A text's set holds its distinct runs of ``width`` words (A-Z lower-cased; a text of fewer words is one run).
Texts with the same set (its size, and a 128-bit BLAKE2b digest of its sorted shingles) are one class from the start, so
copies cost one row each and no pair.

* Registers: for each of M hash functions the least exponential value over the set, on a scale spaced
  exponentially by BASE and truncated to 16 bits.  Registers of a union are the larger ones of each pair
  (``merge_registers``), and equal registers are likelier the more alike two sets are.
* Candidates: ROWS registers make a band; classes that share a band are candidates.  At a similarity of 0.8
  all 32 bands miss a pair with probability 5e-8.
* Estimation: of a candidate pair's registers some are larger on one side, some on the other, some equal;
  with both set sizes known this gives the likelihood of each similarity.  A pair is dropped only where the
  threshold is less likely than the best estimate below it by a factor of exp(25).
* Confirmation: all other pairs are compared on their full sets, from the texts; what they share is compared as text.

Pairs inside a band are not all formed.  First every class meets the first class of its bands alone, and
linked ones are joined to components.  Only bands that then still hold several components need more: their
classes, clustered by the bands they share, are dealt out in pairs of blocks of bounded size, and each task
compares the two blocks in memory, classes of different components only, and returns the links that join
components.  So no link between components is lost, no task gets an unbounded group, and a family of near copies costs a few rows
a copy.

Components contract by joins (least neighbour, then its own, then links between those) over tables in the shared folder.

Defined results: null and empty texts have no set and are linked with nothing; rows are told apart by a number of their own,
so doc_ids may be null, repeat or be of any type that sorts; a component_id is the least doc_id that is not null, and null if
all are; rows that share a doc_id are linked only if their texts are.  An empty table gives no rows.  Only doc_id and text
are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SPACES, Scratch, digests, keyed, mix, numbered, run_hashes, signed, slices, small_batches, word_hashes, word_spans

M, ROWS, BASE, RATE = 128, 4, 1.001, 20.0
BANDS = M // ROWS
#: Difference of log-likelihoods at which a candidate is dropped unseen.
CERTAIN = 25.0
#: Rows of a task while labels spread.
EDGES_PER_TASK = 200_000
#: Classes of a block; clusters of more than so many blocks are taken band by band.
BLOCK, MOST_BLOCKS = 256, 16

_SEEDS = mix(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, one after another, and each row's first (n + 1 values)."""
    starts, ends, first = word_spans(data, offsets, SPACES)
    words = word_hashes(LOWER[data], starts, ends)
    rows, count = len(offsets) - 1, np.diff(first)
    owner = np.repeat(np.arange(rows), count)
    runs = run_hashes(words, width)
    whole = owner[: len(runs)] == owner[width - 1 : width - 1 + len(runs)]
    values, owners = [runs[whole]], [owner[: len(runs)][whole]]
    for n in range(1, width):  # texts of fewer words: one run
        short = np.flatnonzero(count == n)
        if len(short):
            at = first[short][:, None] + np.arange(n)
            own = run_hashes(words[at.ravel()], n)[::n]
            values.append(mix(own + np.uint64(n)))
            owners.append(short)
    h, o = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(rows + 1))


def registers(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """M registers of each row (zeros for an empty set)."""
    rows = len(first) - 1
    out = np.zeros((rows, M), np.uint16)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        with np.errstate(over="ignore"):
            for j in range(M):
                least = np.minimum.reduceat(h * _SEEDS[j], first[full]).astype(np.float64)
                value = -np.log1p(-(least + 0.5) / 2.0**64).clip(max=745.0)
                out[full, j] = np.clip(np.floor(1 - np.log(np.maximum(value, 1e-300) / RATE) / np.log(BASE)), 0, 65535)
    return out


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    out = np.empty((len(regs), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(BANDS):
            key = np.full(len(regs), i + 1, np.uint64)
            for j in range(ROWS):
                key = mix(key * np.uint64(0x100000001B3) + regs[:, i * ROWS + j])
            out[:, i] = key
    return out


def unlikely(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's registers rule out a similarity of threshold or more."""
    larger = (ra > rb).sum(axis=1)
    smaller = (ra < rb).sum(axis=1)
    equal = M - larger - smaller
    u, v = na / (na + nb), nb / (na + nb)

    def likelihood(j: np.ndarray | float) -> np.ndarray:
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (1 - 1 / BASE)) / np.log(BASE)
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return larger * np.log(up + tiny) + smaller * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, tiny))

    most = np.minimum(na, nb) / np.maximum(na, nb)
    at_threshold = likelihood(np.minimum(threshold, most))
    below = np.max([likelihood(np.minimum(threshold * k / 20, most)) for k in range(20)], axis=0)
    return below - at_threshold > CERTAIN


def sketch_documents(rows: DataFrame, width: int) -> DataFrame:
    """row, doc_id, n (set size), f1 and f2 (digest of the sorted set), regs, keys (of bands) for each of (row, doc_id, text)."""
    small_batches(rows.sparkSession)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                h, first = shingle_sets(data, offsets, width)
                regs = registers(h, first)
                f = digests(h[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]),
                     pa.array([r.tobytes() for r in regs], pa.binary()), pa.array(list(signed(band_keys(regs))), pa.list_(pa.int64()))],
                    ["row", "doc_id", "n", "f1", "f2", "regs", "keys"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", "text").mapInArrow(of, f"row long, doc_id {kind}, n long, f1 long, f2 long, regs binary, keys array<long>")


def likely_pairs(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that size and registers do not rule out."""
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}")).hint("merge")
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    sized = joined.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("ra", "rb")]
                sizes = [np.asarray(batch.column(c)).astype(float) for c in ("na", "nb")]
                keep = pa.array(~unlikely(*regs, *sizes, threshold))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(of, pairs.select("a", "b").schema)


_LOWER = bytes(LOWER)


def shingle_texts(text: str, width: int) -> set[tuple[bytes, ...]]:
    """The set itself."""
    words = text.encode().translate(_LOWER).split()
    return set(zip(*(words[i:] for i in range(width)))) if len(words) >= width else {tuple(words)} - {()}


def truly_alike(x: set, y: set, threshold_percent: int) -> bool:
    both = len(x & y)
    return both > 0 and 100 * both >= threshold_percent * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, threshold_percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike: 100 * intersection >= percent * union."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")).hint("merge")
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "ta"):
                n = part.num_rows
                ha, fa = shingle_sets(data, offsets, width)
                values, owners = [ha], [np.repeat(np.arange(n), np.diff(fa))]
                sizes = np.diff(fa)
                done = 0
                for other, data_b, offsets_b in slices(part, "tb"):
                    hb, fb = shingle_sets(data_b, offsets_b, width)
                    count = np.diff(fb)
                    values.append(hb)
                    owners.append(np.repeat(np.arange(done, done + other.num_rows), count))
                    sizes[done : done + other.num_rows] += count
                    done += other.num_rows
                h, o = np.concatenate(values), np.concatenate(owners)
                order = np.lexsort((h, o))
                h, o = h[order], o[order]
                both = np.bincount(o[1:][(h[1:] == h[:-1]) & (o[1:] == o[:-1])], minlength=n)[:n]
                keep = 100 * both >= threshold_percent * (sizes - both)
                for i in np.flatnonzero(keep):
                    x, y = (shingle_texts(part.column(c)[int(i)].as_py(), width) for c in ("ta", "tb"))
                    keep[i] = truly_alike(x, y, threshold_percent)
                keep = pa.array(keep)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])

    return joined.mapInArrow(of, pairs.select("a", "b").schema)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and label (the least node reachable) for each node of links (a, b).

    Each round every node takes the least of itself and its neighbours, then what that one takes; links are then drawn between what
    their ends took, and those that join nothing any more go.  What is left of a family is small after one round.
    """
    edges = scratch.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "near-edges")
    labels = None
    while labels is None or not edges.isEmpty():
        tasks = 2 + edges.count() // EDGES_PER_TASK  # as many as the rows need, not one for each shuffle partition
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("x"))
        near = ends.select("x.*").groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label"))
        near = scratch.keep(near.coalesce(tasks), "near-took")
        own = near.select(F.col("node").alias("label"), F.col("label").alias("root"))
        near = scratch.keep(near.join(own, "label").select("node", F.col("root").alias("label")).coalesce(tasks), "near-took")
        took = lambda x: near.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
        if labels is None:
            labels = near
        else:
            after = labels.join(near.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
            labels = scratch.keep(after.select("node", F.coalesce("root", "label").alias("label")).coalesce(2 + tasks), "near-labels")
        drawn = edges.join(took("a"), "a").join(took("b"), "b").where(F.col("la") != F.col("lb"))
        edges = scratch.keep(drawn.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct().coalesce(tasks), "near-edges")
    return labels


def apart_members(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """key, node, comp of the bands that hold classes of several components."""
    placed = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("comp"))
    several = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where(F.col("low") != F.col("high"))
    return scratch.keep(placed.join(several.select("key"), "key"), "near-apart")


def compare_blocks(apart: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, threshold_percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join components of apart, each confirmed on full sets."""
    first = apart.groupBy("key").agg(F.min("node").alias("a"))
    ties = scratch.keep(apart.join(first, "key").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct(), "near-ties")
    clusters = components(ties, scratch).withColumnRenamed("label", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    where = F.when(F.col("size") <= BLOCK * MOST_BLOCKS, F.concat(F.lit("cluster "), F.col("cluster"))).otherwise(F.concat(F.lit("band "), F.col("key")))
    grouped = apart.join(clusters.join(sizes, "cluster"), "node").select("node", "comp", where.alias("at")).distinct()
    blocks = grouped.groupBy("at").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = grouped.join(blocks, "at").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = scratch.keep(dealt, "near-dealt")
    wanted = texts.join(dealt.select("node").distinct().hint("merge"), "node", "left_semi")
    known = scratch.keep(nodes.select("node", "n", "regs", "keys").join(wanted.hint("merge"), "node"), "near-known")
    full = dealt.join(known, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = full.select("at", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "n", "regs", "keys", "text")
    return scratch.keep(full.groupBy("at", "i", "j").applyInArrow(block_links(width, threshold_percent), "a long, b long").distinct(), "near-links")


def block_links(width: int, threshold_percent: int):
    def of(group: pa.Table) -> pa.Table:
        node, comp, own = (group.column(c).to_pylist() for c in ("node", "comp", "own"))
        n = np.asarray(group.column("n")).astype(float)
        regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(-1, M)
        keys = np.array(group.column("keys").to_pylist(), np.int64)
        sets: list[np.ndarray] = []
        for batch in group.select(["text"]).to_batches():
            for _, data, offsets in slices(batch, "text"):
                h, first = shingle_sets(data, offsets, width)
                sets += [h[first[k] : first[k + 1]] for k in range(len(first) - 1)]
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(place, kind="stable")
        holders, begin = owner[order], np.searchsorted(place[order], np.arange(len(values) + 1))
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        side = np.array(own)
        two = len(set(own)) > 1
        root: dict = {c: c for c in comp}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        true_sets: dict[int, set] = {}

        def true_set(k: int) -> set:
            if k not in true_sets:
                if len(true_sets) > BLOCK:
                    true_sets.clear()
                true_sets[k] = shingle_texts(group.column("text")[k].as_py(), width)
            return true_sets[k]

        links = []
        for k in range(len(sets)):
            after = np.arange(k + 1, len(sets))
            if two:
                after = after[side[after] != side[k]]
            mine = find(comp[k])
            after = np.array([y for y in after if find(comp[y]) != mine], np.int64)
            if len(after):
                after = after[100 * np.minimum(n[after], n[k]) >= threshold_percent * np.maximum(n[after], n[k])]
            if len(after):
                after = after[(keys[after] == keys[k]).any(axis=1)]
            if len(after):
                after = after[~unlikely(regs[after], np.broadcast_to(regs[k], (len(after), M)), n[after], np.full(len(after), n[k]), threshold_percent / 100)]
            if not len(after):
                continue
            own_values = place[starts[k] : starts[k + 1]]
            both = np.zeros(len(sets), np.int64)
            for v in np.array_split(own_values, max(1, len(own_values) // 4096)):
                count = begin[v + 1] - begin[v]
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[v], count)
                both += np.bincount(holders[at], minlength=len(sets))
            for y in after[100 * both[after] >= threshold_percent * (n[after] + n[k] - both[after])]:
                if find(comp[y]) != find(comp[k]) and truly_alike(true_set(int(y)), true_set(k), threshold_percent):
                    root[find(comp[y])] = find(comp[k])
                    links.append((min(node[k], node[y]), max(node[k], node[y])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return of


def place_rows(rows: DataFrame, width: int, threshold_percent: int) -> DataFrame:
    """row, doc_id, n, component_id, first (whether it is its component's first row) for each of (row, doc_id, text)."""
    threshold, scratch = threshold_percent / 100, Scratch()
    sketches = scratch.keep(sketch_documents(rows, width), "near-sketches")
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = sketches.where(F.col("n") > 0).groupBy("f1", "f2", "n").agg(
        F.min("row").alias("node"), F.min_by("regs", "row").alias("regs"), F.min_by("keys", "row").alias("keys"), F.min(lead).alias("lead")
    )
    nodes = scratch.keep(classes, "near-classes")
    banded = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("first")).where(F.col("size") > 1)
    members = scratch.keep(banded.join(shared.select("key", "first"), "key"), "near-members")
    # The texts that confirmation may need, fetched once; joins with texts and registers are merge joins at any size.
    wanted = members.select("node").distinct().hint("merge")
    texts = scratch.keep(rows.select(F.col("row").alias("node"), "text").join(wanted, "node", "left_semi"), "near-texts")

    pairs = scratch.keep(members.where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    likely = scratch.keep(likely_pairs(pairs, nodes, threshold), "near-likely")
    links = scratch.keep(confirm(likely, texts, width, threshold_percent).distinct(), "near-links")
    labels = components(links, scratch)
    found = compare_blocks(apart_members(members, labels, scratch), nodes, texts, width, threshold_percent, scratch)
    if not found.isEmpty():
        labels = components(links.unionByName(found), scratch)
    placed = nodes.join(labels, "node", "left").select("f1", "f2", "n", "lead", F.coalesce("label", "node").alias("label"))
    first = placed.groupBy("label").agg(F.min("lead").alias("first"))
    own = scratch.keep(placed.join(first, "label").select("f1", "f2", "n", "first"), "near-components")
    scratch.drop(sketches, own)
    result = sketches.select("row", "doc_id", "n", "f1", "f2").join(own, ["f1", "f2", "n"], "left")
    alone = F.col("first").isNull()
    return result.select(
        "row", "doc_id", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), (alone | (F.col("first.row") == F.col("row"))).alias("first")
    )


def find_components(docs: DataFrame, width: int = 5, threshold_percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    placed = place_rows(numbered(docs, doc_id, text), width, threshold_percent)
    return placed.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def deduplicate(docs: DataFrame, width: int = 5, threshold_percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, that are the first of their component: the least doc_id, of equal ones any one row;
    and the rows without a set."""
    held, own = keyed(docs, doc_id)
    placed = place_rows(held.select(F.col(f"`{own}`").alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), width, threshold_percent)
    gone = placed.where(~F.col("first")).select(F.col("row").alias(own))
    return held.join(gone, own, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
