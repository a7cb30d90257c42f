"""What the operators of this package have in common: scratch tables, Arrow text buffers, word hashes.

Texts reach Python as Arrow buffers and stay there: a batch of documents is one array of UTF-8 bytes
with offsets, and words are found with numpy over the whole batch.  A word's 64-bit hash takes eight bytes at
a time through a bijection of its state (words of more than 64 bytes: BLAKE2b).  Such hashes choose what is
compared; what decides is the text itself or its 128-bit BLAKE2b digest.  A null text counts as an empty one
everywhere in this package.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Rows that Spark hands to Python at once, and bytes of text that numpy works on at once.
ROWS_PER_BATCH = 512
BYTES_PER_SLICE = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds a Python worker's memory: long texts make the default of 10,000 rows a batch too many.  Spark reads this when
    a plan runs, so it is set in the session and stays lowered there."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


_own_dir: str | None = None


def scratch_base(spark: SparkSession) -> str:
    """The shared folder that the session names.  Where it names none, a temporary one on one machine (tests), an error on a cluster."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="loomstream-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage: lost
    executors cost a reread of that table, not a rerun of what made it."""
    spark = df.sparkSession
    path = f"{scratch_base(spark)}/loomstream-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """The tables that an operator makes on its way."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(materialise(df, name))
        return self.tables[-1]

    def drop(self, *but: DataFrame) -> None:
        """Deletes all of them but those that the result still reads."""
        discard(*(t for t in self.tables if all(t is not b for b in but)))
        self.tables = [t for t in self.tables if any(t is b for b in but)]


def keyed(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """docs and the name of a column of it that tells rows apart: doc_id if it is a bigint, never null and never repeated;
    otherwise a number of each row's own, fixed in a table."""
    ids = docs.select(F.col(f"`{doc_id}`").alias("id"))
    if isinstance(ids.schema["id"].dataType, LongType):
        if ids.groupBy("id").agg(F.count("*").alias("n")).where(F.col("id").isNull() | (F.col("n") > 1)).isEmpty():
            return docs, doc_id
    own = f"row_{uuid.uuid4().hex}"
    return materialise(docs.withColumn(own, F.monotonically_increasing_id()), "rows"), own


def numbered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, text, where row tells rows apart (see keyed)."""
    held, row = keyed(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    return held.select(F.col(row).alias("row"), "doc_id", "text")


def slices(batch: pa.RecordBatch, text: str, most: int = BYTES_PER_SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with at most so many bytes of text (or one row), each with the bytes of its
    texts and the offsets of its rows in them."""
    column = batch.column(text)
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Bytes that separate words.
SPACES = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes other than 0-9, A-Z, a-z and those of characters above U+007F.
NON_ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in data, and for each row the index of its first word (n + 1 values)."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


R1, R2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of a word that are hashed by numpy; longer words are digested.
LONGEST = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte of data on as a number; beyond the end are zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.uint64 = R1) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands; other seeds give other hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    eight = loads(data)
    lengths = ends - starts
    with np.errstate(over="ignore"):
        h = mix(lengths.astype(np.uint64) + seed)
        at = np.flatnonzero(lengths > 0)
        for k in range(0, LONGEST, 8):
            left = (lengths[at] - k).clip(max=8).astype(np.uint64)
            part = eight[starts[at] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - (left << np.uint64(3))))
            h[at] = mix(h[at] ^ part)
            at = at[lengths[at] > k + 8]
            if not len(at):
                break
    for i in at:
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=int(seed).to_bytes(8, "little")).digest(), "little")
    return h


def fixed_bytes(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Binary values of one width as rows of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), np.uint8)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + len(column) * width].reshape(-1, width)


def digests(pieces: Iterable[bytes]) -> np.ndarray:
    """Two 64-bit numbers for each piece, its 128-bit BLAKE2b digest (n x 2)."""
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(p, digest_size=16).digest() for p in pieces]), np.int64).reshape(-1, 2)


def run_hashes(hashes: np.ndarray, n: int, seed: np.uint64 = R2) -> np.ndarray:
    """A hash of each run of n consecutive values (across rows too; the caller keeps to its rows)."""
    count = max(0, len(hashes) - n + 1)
    out = np.full(count, seed, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = mix(out + hashes[j : j + count])
    return out


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    have, width = values, 1
    while width * 2 <= w:
        have = np.minimum(have[: len(have) - width], have[width:])
        width *= 2
    if width < w:
        have = np.minimum(have[: len(have) - (w - width)], have[w - width :])
    return have


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
