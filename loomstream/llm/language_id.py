"""Language identification with language-bitmask n-gram filters.

A Bloom filter is bit-sliced by language: each of its positions holds a mask with one bit for each
language, and an n-gram of a language sets that bit at the n-gram's k positions.  The AND of the masks at an
n-gram's positions is thus the set of all languages that contain it, from one lookup for all of them.  For a
text the bits are counted by language over its n-grams, corrected for the filter's own false positives
(a language whose slice is filled to f is named by chance with probability f**k), and the largest count
decides.

N-grams are ``GRAM`` bytes of the text with A-Z in lower case and all other bytes below U+0080 as spaces.  A
language has an n-gram if its rate there is at least ``min_rate``, which leaves out what strays into its texts, and, if
``min_share`` is given, at least that share of the highest rate in any language.  Rates come from a bounded sample of labelled texts: ``sample_per_language`` rows of
each language in expectation, chosen by a hash of the text; counts are summed by Spark, and the driver gets
the finished filter alone, whose size has a fixed bound (``MOST_POSITIONS`` masks for each 63 languages).

Defined results: ``und`` with score 0 if a text is null or has no letter, or nothing was learned; a text with
letters but no known n-gram is the language with the most learned rows, with score 0; ties go to the language first in
alphabetical order; every text is judged whole; repeated rows get the same result each.  Names of languages may hold any
characters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix, slices, small_batches

GRAM = 4
HASHES = 3
MOST_POSITIONS = 1 << 22
SAMPLE_PER_LANGUAGE = 4000
BITS = 63

SHOWN = np.full(256, 32, np.uint8)
SHOWN[0x80:] = np.arange(0x80, 256)
SHOWN[97:123] = np.arange(97, 123)
SHOWN[65:91] = np.arange(97, 123)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (GRAM bytes as a number) of all rows, and the index of each row's first (n + 1 values).
    A space stands before and after each row; n-grams of fewer than two letters are left out."""
    rows = len(offsets) - 1
    padded = np.full(len(data) + rows + 1, 32, np.uint8)
    padded[np.arange(len(data)) + 1 + np.repeat(np.arange(rows), np.diff(offsets))] = SHOWN[data]
    count = len(padded) - GRAM + 1
    if count <= 0:
        return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
    code = np.zeros(count, np.uint32)
    letters = np.zeros(count, np.int8)
    for j in range(GRAM):
        part = padded[j : j + count]
        code = code << np.uint32(8) | part
        letters += part != 32
    edges = offsets[1:-1] + np.arange(1, rows)  # the space between two rows; an n-gram has it at an end only
    for j in range(1, GRAM - 1):
        inner = edges - j
        letters[inner[(inner >= 0) & (inner < count)]] = 0
    keep = np.flatnonzero(letters >= 2)
    first = np.searchsorted(keep, np.concatenate((offsets[:-1] + np.arange(rows), [count])))
    return code[keep], first


def positions(code: np.ndarray, size: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [(mix(code.astype(np.uint64) + np.uint64(j << 40)) & np.uint64(size - 1)).astype(np.int64) for j in range(HASHES)]


def learn(labelled: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, min_rate: float = 2e-5, min_share: float = 0.0) -> dict:
    """The filter, from (text, lang) rows: languages by number of rows, masks, and each language's fill."""
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return {"languages": [], "usual": "und", "masks": np.zeros((1, 1), np.uint64), "chance": np.zeros(0)}
    share = F.lit(1.0)
    for name, n in sizes.items():
        if n > sample_per_language:
            share = F.when(F.col("lang") == name, sample_per_language / n).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))

    place = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                code, first = grams(data, offsets)
                own = np.array([place[name] for name in part.column("lang").to_pylist()], np.int32)
                owner = np.repeat(np.arange(len(own)), np.diff(first))
                for i in np.unique(own):
                    values, n = np.unique(code[(own == i)[owner]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i, np.int32)), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))], ["place", "gram", "n"])

    places = list(range(len(languages)))  # languages by place: their names may be anything
    counts = sample.mapInArrow(count, "place int, gram long, n long").groupBy("gram").pivot("place", places).agg(F.sum("n"))
    counts = counts.fillna(0).cache()
    columns = [F.col(str(i)) for i in places]
    totals = counts.agg(*(F.sum(c).alias(f"t{i}") for i, c in enumerate(columns))).first()
    rates = [c / float(max(totals[i] or 0, 1)) for i, c in enumerate(columns)]
    highest = F.greatest(*rates) if len(rates) > 1 else rates[0]
    has = [(r > 0) & (r >= min_rate) & (r >= min_share * highest) for r in rates]
    groups = -(-len(languages) // BITS)
    masks = []
    for g in range(groups):
        bits = [F.when(has[i], F.lit(1 << (i - g * BITS)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(g * BITS, min(len(languages), (g + 1) * BITS))]
        mask = bits[0]
        for b in bits[1:]:
            mask = mask.bitwiseOR(b)
        masks.append(mask.alias(f"m{g}"))
    known = counts.select("gram", *masks).where(F.greatest(F.lit(0), *(F.col(f"m{g}") for g in range(groups))) > 0)
    n_grams = known.count()
    size = 1 << 12
    while size < min(MOST_POSITIONS, 10 * n_grams):
        size *= 2

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = positions(np.asarray(batch.column("gram")).astype(np.uint32), size)
            for p in at:
                yield pa.RecordBatch.from_arrays([pa.array(p), *(batch.column(f"m{g}") for g in range(groups))], ["at", *(f"m{g}" for g in range(groups))])

    placed = known.mapInArrow(put, "at long, " + ", ".join(f"m{g} long" for g in range(groups)))
    table = placed.groupBy("at").agg(*(F.bit_or(f"m{g}").alias(f"m{g}") for g in range(groups))).toArrow()
    counts.unpersist()
    filled = np.zeros((groups, size), np.uint64)
    for g in range(groups):
        filled[g, np.asarray(table.column("at"))] = np.asarray(table.column(f"m{g}")).astype(np.uint64)
    chance = np.array([float(((filled[i // BITS] >> np.uint64(i % BITS)) & np.uint64(1)).mean()) ** HASHES for i in range(len(languages))])
    return {"languages": languages, "usual": max(languages, key=lambda x: (sizes[x], x)), "masks": filled, "chance": chance}


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def predict(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        languages, masks, chance = m["languages"], m["masks"], m["chance"]
        size = masks.shape[1]
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                n = part.num_rows
                code, first = grams(data, offsets)
                total = np.diff(first)
                counts = np.zeros((n, len(languages)))
                if len(code) and languages:
                    at = positions(code, size)
                    for g in range(len(masks)):
                        every = masks[g][at[0]]
                        for p in at[1:]:
                            every = every & masks[g][p]
                        for i in range(g * BITS, min(len(languages), (g + 1) * BITS)):
                            sums = np.concatenate(([0], np.cumsum((every >> np.uint64(i % BITS)) & np.uint64(1), dtype=np.int64)))
                            counts[:, i] = sums[first[1:]] - sums[first[:-1]]
                real = np.maximum(0.0, (counts - total[:, None] * chance) / np.maximum(1e-9, 1.0 - chance))
                summed = real.sum(axis=1)
                ascii_letters = ((data | 32) >= 97) & ((data | 32) <= 122)
                lettered = np.concatenate(([0], np.cumsum(ascii_letters)))
                plain = lettered[offsets[1:]] > lettered[offsets[:-1]]
                names, scores = [], []
                for i in range(n):
                    if not languages or not (plain[i] or has_letter(part.column("text")[i].as_py())):
                        names.append("und")
                        scores.append(0.0)
                    elif summed[i] <= 0:
                        names.append(m["usual"])
                        scores.append(0.0)
                    else:
                        best = int(np.argmax(real[i]))
                        names.append(languages[best])
                        scores.append(float(real[i, best] / summed[i]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(judge, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
