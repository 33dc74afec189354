"""Token ids in ORC: written in ascending document order, read by stripe.

Layout: documents are range-partitioned and sorted by ``doc_id`` (null last,
ties by a hash of the text), every partition is one ORC file whose ``ids``
column holds integers under ORC's integer run-length encoding. Stripes, row
indexes and a Bloom filter on ``doc_id`` let a reader split files by stripe
and skip stripes and row groups without a wanted document.

Edge cases: a null or empty text holds the end id alone; a null ``doc_id``
sorts last; repeated rows are written once each; an empty table gives a
readable table without rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passage.llm._common import slices, text_or_empty
from passage.llm.tokens import encoder

END_ID = 1
STRIPE_BYTES = 8 << 20
#: Rows that share one entry of a row index.
INDEX_ROWS = 1000
BLOOM_FPP = 0.01

_FILE_SCHEMA = "part int, first long, doc_id long, ids array<int>"
_SHAPE = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _encode(path: str, end_id: int):
    def run(batches):
        enc, part, first = encoder(path), TaskContext.get().partitionId(), 0
        for b in slices(batches):
            ids, bounds = enc.encode(b.column("text"), end_id)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, part, np.int32)),
                pa.array(first + bounds[:-1]),
                b.column("doc_id").cast(pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
            ], schema=_SHAPE)
            first += int(bounds[-1])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES,
                 index_rows: int = INDEX_ROWS) -> None:
    """Encode ``docs`` (doc_id, text) and write the ids as ORC below ``path``.

    Columns: ``part`` (place of the file in document order), ``first`` (ids of
    the file before the document), ``doc_id``, ``ids``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("copy", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("copy")]
    # the last two keys also split the rows of a much repeated document id
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    (ranged.mapInArrow(_encode(tokenizer, end_id), _FILE_SCHEMA).write
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .option("orc.create.index", "true").option("orc.row.index.stride", str(index_rows))
        .option("orc.stripe.size", str(stripe_bytes)).option("compression", "snappy")
        .orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents with ``start`` (ids of all documents before), in the layout of
    the files. ``doc_ids`` is pushed down to stripe statistics and Bloom filters."""
    table = spark.read.schema(_FILE_SCHEMA).orc(path)
    totals = table.groupBy("part").agg(F.max(F.col("first") + F.size("ids")).alias("n"))
    # one row a file
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", before.alias("base"))
    if doc_ids is not None:
        table = table.where(F.col("doc_id").isin([int(d) for d in doc_ids]))
    # a few bytes for each file, whatever the files hold: else the ids would be shuffled to meet them
    return table.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "ids")


def _digest(batches):
    for b in batches:
        ids = b.column("ids")
        values = np.ascontiguousarray(np.asarray(ids.flatten()), dtype="<u4")
        bounds = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))]).astype(np.int64)
        raw = memoryview(values).cast("B")
        crc = [zlib.crc32(raw[4 * a:4 * e]) for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id"), b.column("start"), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()),
        ], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
