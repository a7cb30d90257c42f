"""A quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Positives P are trusted texts, U is the unlabelled web text (every text of the table), and pi is the class
prior, the estimated share of positives in U.  With the square loss the risk of a linear score z = w.x is

    pi * E_P[(1 - z)**2] / 4  +  max(0, E_U[(1 + z)**2] / 4 - pi * E_P[(1 + z)**2] / 4)

where the part under max() estimates the risk on negatives, which no flexible fit may push below zero.
All of it depends on the data through second moments of x only.  So Spark makes one pass over all texts
for the features and one over the features for the moments, partial sums being added where the rows are;
the driver gets two matrices of fixed size and minimises the risk on them exactly as over all rows.  There is
no sample.  Under the square loss (1 + z) / 2 estimates the probability of a positive; it is the score.

Features are counts of a text's bytes, words and lines, each cut into bins at its quantiles over the
table, so that the linear score adds a free function of each feature; and the shares of its words (A-Z in lower case) that fall
into each of BUCKETS hash buckets, which enter as they are.

The prior: the positives' share among labelled rows where both labels are known; otherwise the largest value
that the scores allow, the least ratio of U's to P's mass above any score.

Defined results: a null text is an empty one, which has a score as any other; without positives every
score is 0.5; repeated rows get the same result each; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SPACES, byte_class, materialise, run_hashes, slices, small_batches, word_hashes, word_spans

FEATURES = (
    "n_words", "word_length", "longest_word", "upper", "marks", "exclaims", "digits", "points", "beyond_ascii",
    "distinct_words", "same_as_last", "repeated_runs", "repeated_lines", "line_words", "top_word", "byte_entropy",
)
#: Quantiles at which a feature is cut.
CUTS = (0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.75, 0.88, 0.94, 0.97, 0.99)
#: Ridge on the weights: a fixed part, and one observation's worth, which the trusted positives outweigh.
RIDGE = 1e-4
NEWLINE = byte_class((10, 10))
BUCKETS = 32


def per_row(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive edges."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return sums[edges[1:]] - sums[edges[:-1]]


def doubled(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row: values that the row has before, and the count of its commonest value."""
    rows = len(edges) - 1
    owner = np.repeat(np.arange(rows), np.diff(edges))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    again = np.bincount(o[~new], minlength=rows)[:rows] if len(h) else np.zeros(rows)
    top = np.zeros(rows)
    if len(h):
        at = np.flatnonzero(new)
        np.maximum.at(top, o[at], np.diff(np.append(at, len(h))))
    return again.astype(float), top


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES, and then of shares by bucket, for each row of text."""
    rows = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets, SPACES)
    words = word_hashes(data, starts, ends)
    n = np.diff(first).astype(float)
    lengths = (ends - starts).astype(float)
    size = np.maximum(1.0, np.diff(offsets))
    w = np.maximum(1.0, n)
    count = lambda *ranges: per_row(byte_class(*ranges)[data], offsets)
    upper, lower = count((65, 90)), count((97, 122))
    longest = np.zeros(rows)
    owner = np.repeat(np.arange(rows), np.diff(first))
    np.maximum.at(longest, owner, lengths)
    again, top = doubled(words, first)
    same = np.zeros(len(words))
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    runs = run_hashes(words, 5)
    whole = owner[: len(runs)] == owner[4 : 4 + len(runs)] if len(runs) else np.zeros(0, bool)
    run_edges = np.searchsorted(owner[: len(runs)][whole], np.arange(rows + 1))
    repeated, _ = doubled(runs[whole], run_edges)
    line_starts, line_ends, line_first = word_spans(data, offsets, NEWLINE)
    lines = np.maximum(1.0, np.diff(line_first))
    repeated_lines, _ = doubled(word_hashes(data, line_starts, line_ends), line_first)
    entropy = np.zeros(rows)
    for i in range(rows):
        seen = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=1)
        p = seen[seen > 0] / size[i]
        entropy[i] = -(p * np.log2(p)).sum()
    bucket = (word_hashes(LOWER[data], starts, ends) >> np.uint64(40)).astype(np.int64) % BUCKETS
    shares = np.bincount(owner * BUCKETS + bucket, minlength=rows * BUCKETS).reshape(rows, BUCKETS) / w[:, None]
    return np.column_stack([
        np.log1p(n), per_row(lengths, first) / w, longest, upper / np.maximum(1.0, upper + lower),
        count((35, 38), (42, 42), (60, 60), (62, 62), (124, 124)) / size, count((33, 33), (63, 63)) / size, count((48, 57)) / size,
        count((44, 44), (46, 46), (58, 59)) / w, count((128, 255)) / size, 1 - again / w, per_row(same, first) / w, repeated / w,
        repeated_lines / lines, n / lines, top / w, entropy, shares,
    ]).astype(np.float64)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with the array column ``__x`` of features."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    kept = docs.select(*(F.col(f"`{c}`") for c in others), F.col(text).alias("__text"))

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "__text"):
                x = pa.array(list(measure(data, offsets).astype(np.float32)), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), x], [*others, "__x"])

    return kept.mapInArrow(of, kept.select(*(F.col(f"`{c}`") for c in others), F.array(F.lit(0.0).cast("float")).alias("__x")).schema)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Ones for the constant and for each cut that a feature exceeds, and how far each bucket's share is from the mean of all."""
    return np.column_stack([np.ones(len(x)), *((x[:, [i]] > c).astype(float) for i, c in enumerate(cuts) if len(c)), np.clip(BUCKETS * x[:, len(FEATURES) :] - 1, -1, 3)])


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), len(FEATURES) + BUCKETS)


def quantile_cuts(rows: DataFrame) -> list[np.ndarray]:
    """Quantiles of each feature over all rows, from merged quantile sketches."""
    q = F.array(*(F.lit(c) for c in CUTS))
    found = rows.agg(*(F.percentile_approx(F.get("__x", i), q, F.lit(2000)).alias(str(i)) for i in range(len(FEATURES)))).first()
    return [np.unique(np.array(found[str(i)] or [], np.float64)) for i in range(len(FEATURES))]


def moments(rows: DataFrame, cuts: list[np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    """For group 0 (all rows) and 1 (trusted positives): the number of rows and the sum of x x'."""
    size = 1 + sum(map(len, cuts)) + BUCKETS
    shared = rows.sparkSession.sparkContext.broadcast(cuts)

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((2, size, size)), [0, 0]
        for batch in batches:
            x = binned(matrix(batch.column("__x")), shared.value)
            trusted = np.asarray(batch.column("__p").to_pylist(), bool)
            for g, part in enumerate((x, x[trusted])):
                sums[g] += part.T @ part
                counts[g] += len(part)
        for g in range(2):
            if counts[g]:
                yield pa.RecordBatch.from_pydict({
                    "g": pa.array([g] * size, pa.int32()), "i": pa.array(range(size), pa.int32()), "n": pa.array([float(counts[g])] * size),
                    "v": pa.array(list(sums[g]), pa.list_(pa.float64())),
                })

    parts = rows.select("__x", "__p").mapInArrow(total, "g int, i int, n double, v array<double>")
    cells = parts.select("g", "i", "n", F.posexplode("v").alias("j", "v")).groupBy("g", "i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    out = {0: (0.0, np.zeros((size, size))), 1: (0.0, np.zeros((size, size)))}
    table = cells.toArrow()  # 2 * size**2 numbers, whatever the input
    g, i, j = (np.asarray(table.column(c)) for c in ("g", "i", "j"))
    v, n = np.asarray(table.column("v")), np.asarray(table.column("n"))
    for k in (0, 1):
        if (own := g == k).any():
            m = np.zeros((size, size))
            m[i[own], j[own]] = v[own]
            out[k] = (float(n[own][0]), m)
    return out


def minimise(prior: float, u: np.ndarray, p: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """w of least non-negative risk, from E_U[x x'] and E_P[x x'] (x starts with a constant 1).

    The risk is the larger of A and A + N, where A is the positives' part and N the estimate for negatives; both are convex, so
    its minimum is that of A + t * N for the t in 0 ... 1 that is worst.  N falls as t grows, at the w that is best for t: if N
    is not negative for t = 1, nothing is clipped; if it is not positive for t = 0, all is; otherwise t is where N is 0.
    """
    penalty = ridge * np.eye(len(u))
    penalty[0, 0] = 1e-9
    mean_u, mean_p = u[0], p[0]

    def best(t: float) -> np.ndarray:
        return np.linalg.lstsq((1 - t) * prior * p + t * u + penalty, (1 + t) * prior * mean_p - t * mean_u, rcond=None)[0]

    def negatives(w: np.ndarray) -> float:
        return float(1 + 2 * w @ mean_u + w @ u @ w - prior * (1 + 2 * w @ mean_p + w @ p @ w)) / 4

    if negatives(best(1.0)) >= 0:
        return best(1.0)
    if negatives(best(0.0)) <= 0:
        return best(0.0)
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if negatives(best(middle)) > 0 else (low, middle)
    return best(low)


@dataclass(frozen=True)
class Model:
    cuts: list[np.ndarray]
    weights: np.ndarray | None
    prior: float


def bound_prior(rows: DataFrame, cuts: list[np.ndarray], u: np.ndarray, p: np.ndarray, ridge: float) -> float:
    """The largest prior that U allows: the least ratio of U's to P's mass above a score."""
    model = Model(cuts, minimise(0.5, u, p, ridge), 0.5)
    scored = score(rows, model, keep=("__p",)).groupBy(F.floor(F.col("score") * 50).alias("bin")).agg(
        F.count("*").alias("u"), F.count_if("__p").alias("p")
    )
    bins = sorted((r["bin"], r["u"], r["p"]) for r in scored.collect())
    all_u, all_p = sum(b[1] for b in bins), sum(b[2] for b in bins)
    least, above_u, above_p = 1.0, 0, 0
    for _, n_u, n_p in reversed(bins):
        above_u, above_p = above_u + n_u, above_p + n_p
        if above_p >= max(20, 0.05 * all_p):
            least = min(least, (above_u / all_u) / (above_p / all_p))
    return float(np.clip(least, 0.01, 0.99))


def fit(rows: DataFrame, prior: float | None = None) -> Model:
    """From rows of features(): ``__p`` marks trusted positives, ``__y`` holds known labels or null."""
    cuts = quantile_cuts(rows)
    m = moments(rows, cuts)
    if not m[1][0] or not m[0][0]:
        return Model(cuts, None, 0.5)
    u, p = m[0][1] / m[0][0], m[1][1] / m[1][0]
    ridge = RIDGE + 1 / m[1][0]
    if prior is None:
        known = rows.agg(F.avg(F.col("__y").cast("double")).alias("y")).first()["y"]
        prior = float(known) if known is not None and 0 < known < 1 else bound_prior(rows, cuts, u, p, ridge)
    return Model(cuts, minimise(prior, u, p, ridge), prior)


def score(rows: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns and score for each row of features()."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    source = rows.select(*keep, "__x")

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m.weights is None:
                values = np.full(batch.num_rows, 0.5)
            else:
                values = np.clip((1 + binned(matrix(batch.column("__x")), m.cuts) @ m.weights) / 2, 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(values, pa.float64())], [*keep, "score"])

    return source.mapInArrow(of, rows.select(*keep, F.lit(0.0).alias("score")).schema)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", prior: float | None = None) -> tuple[DataFrame, Model]:
    """doc_id and score for each row of docs; labels holds doc_id and quality (1: trusted positive, 0: known
    negative, used for the prior alone).  A doc_id with several labels is positive if any of them is 1."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("__y"))
    x = materialise(features(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "quality-features")
    rows = x.join(known, "doc_id", "left").withColumn("__p", F.coalesce(F.col("__y") == 1, F.lit(False)))
    model = fit(rows, prior)
    return score(x, model, keep=("doc_id",)), model
