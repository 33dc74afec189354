"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passage.session import scratch_path

#: Rows in one Arrow batch sent to Python; texts are long, so fewer than Spark's 10,000.
ARROW_ROWS = 1000
#: Text handled at once inside a task; a longer single text is handled alone.
SLICE_BYTES = 8 << 20

# ASCII white space of the word pattern [^\x20\x09-\x0D]+ (fixed values)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# lower-cases ASCII letters byte by byte
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Another bound of Arrow batches while a table is written."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex[:12]}")


#: Rows that a task writes at least of a table known to be small.
TASK_ROWS = 1 << 14


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder once and read it back: later
    steps neither recompute it nor depend on the executors that made it.
    ``rows``: how many it has at most; a small table is then written by few tasks, however many a shuffle has."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df if rows is None else df.coalesce(1 + rows // TASK_ROWS)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose texts hold about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def give_back() -> None:
    """Return freed memory to the system: worker processes serve one stage after the other, and idle ones should hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def over_texts(run, kind: pa.DataType, limit: int = SLICE_BYTES):
    """An Arrow function of a text column from ``run``, which sees slices of about ``limit`` bytes: rows stay in the JVM,
    and only their texts go through Python. What the worker remembers of tokenizers is dropped, and memory given back."""
    def call(col: pa.Array) -> pa.Array:
        from passage.llm import tokens
        tokens._ENCODERS.clear()
        parts = [run(b.column("text")).cast(kind) for b in slices([pa.RecordBatch.from_arrays([col], names=["text"])], limit=limit)]
        give_back()
        return pa.concat_arrays(parts) if parts else pa.array([], kind)
    return call


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64) over an array of unsigned integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (base odd)."""
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        with np.errstate(over="ignore"):
            out[1:] = np.cumprod(np.full(n - 1, base, np.uint64), dtype=np.uint64)
    return out[:n]


#: Random odd multipliers of the polynomial hashes (fixed so that runs agree).
BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)


def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit code for each byte value."""
    return mix64(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000003 + 1))


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of all rows and the
    number of words before each row (one entry more than rows)."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~SPACE[raw]
    first = np.zeros(n + 1, bool)
    first[off] = True                       # a row's first byte starts a new word
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:n]
    close = solid.copy()
    close[:-1] &= ~solid[1:] | first[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(close) + 1, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    with np.errstate(over="ignore"):
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        src = np.repeat(starts, size) + at
        vals = byte_codes(seed)[raw[src]] * powers(BASES[seed & 1], int(size.max()))[at]
        sums = np.add.reduceat(vals, np.cumsum(size) - size)
    return mix64(sums ^ (size.astype(np.uint64) << np.uint64(48)))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i+1]]`` for each row i."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "fiu" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


# Bloom filters of 64-bit keys: a filter's errors only let too much through.
BLOOM_BITS, BLOOM_MAX, BLOOM_HASHES = 16, 1 << 29, 4


def bloom_bits(keys: np.ndarray, size: int) -> np.ndarray:
    h = mix64(keys.astype(np.uint64))
    return np.stack([(mix64(h + np.uint64(j)) % np.uint64(size)).astype(np.int64) for j in range(BLOOM_HASHES)])


def bloom_add(words: np.ndarray, keys: np.ndarray) -> None:
    bits = bloom_bits(keys, len(words) * 64).ravel()
    np.bitwise_or.at(words, bits >> 6, np.uint64(1) << (bits & 63).astype(np.uint64))


def in_bloom(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = bloom_bits(keys, len(words) * 64)
    return np.all((words[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1), axis=0)


def bloom_filter(keys: DataFrame, count: int) -> np.ndarray:
    """The filter of the column ``key`` as 64-bit words: BLOOM_BITS bits a key, never more than BLOOM_MAX bits (64 MB)."""
    size = 1 << 12
    while size < min(count * BLOOM_BITS, BLOOM_MAX):
        size *= 2

    def run(batches):
        words = np.zeros(size // 64, np.uint64)
        for b in batches:
            bloom_add(words, np.asarray(b.column("key")))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].astype(np.int64))], names=["at", "word"])

    got = keys.select("key").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[np.asarray(got["at"])] = np.asarray(got["word"]).astype(np.uint64)
    return words
