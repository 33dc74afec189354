"""Hierarchical best-fit packing of documents into sequences.

1. Documents become pieces: ids with a closing id, cut every ``capacity`` ids.
2. Pieces are dealt evenly to partitions by their row number's hash; each
   partition packs best-fit in descending order.
3. Bins that no later round can improve leave as sequences. After best-fit at
   most one bin of a partition is at most half full and no two others fit
   together, so a round merging ``FAN_IN`` partitions uses at most ``FAN_IN``
   of the fuller bins: each partition hands on its emptiest ``FAN_IN`` bins,
   as single items, and nothing else can be merged.
4. Rounds repeat on a tree of ``FAN_IN`` branches until one task is left; its
   input is bounded by ``FAN_IN`` squared.

Edge cases: a null or empty text is one piece holding the closing id; an
empty table gives no pieces; repeated rows are packed once each (``uid``
tells them apart); other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passage.llm._common import give_back, materialise, slices, text_or_empty
from passage.llm.tokens import _ENCODERS, encoder

CAPACITY = 2048
END_ID = 0
#: Pieces a partition packs in the first round.
LOCAL_ITEMS = 50_000
#: Partitions that meet in one task of a later round.
FAN_IN = 32

#: Text read at once where a worker has to be small.
SMALL_SLICE = 1 << 20

_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, end_id: int, capacity: int, keep_ids: bool, release: bool = False):
    def run(batches):
        enc, uid = encoder(path), TaskContext.get().partitionId() << 36
        for b in slices(batches, limit=SMALL_SLICE) if release else slices(batches):
            ids, bounds = enc.encode(b.column("text"), end_id)
            sizes = np.diff(bounds)
            count = -(-sizes // capacity)
            row = np.repeat(np.arange(b.num_rows), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            at = bounds[:-1][row] + start
            crc = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            cols = [pa.array(uid + np.arange(len(row))), b.column("doc_id").cast(pa.int64()).take(pa.array(row)),
                    pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids)))
                names.append("ids")
            uid += len(row)
            yield pa.RecordBatch.from_arrays(cols, names=names)
        if release:
            del enc
            _ENCODERS.clear()
            give_back()
    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False, release: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids; ``uid`` numbers them. ``keep_ids`` adds the ids; ``release`` lets each task drop what its
    worker remembers of the tokenizer and read less text at once, where workers are many for their memory."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_cut(tokenizer, end_id, capacity, keep_ids, release), _PIECES + (", ids array<int>" if keep_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit in descending order: bin and offset of each item, fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0                                                       # bit r: a bin with room r is open
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        above = rooms >> n
        if above:
            room = n + ((above & -above).bit_length() - 1)
            k = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, k = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = k, fills[k]
        fills[k] += n
        room -= n
        if room:
            open_bins[room].append(k)
            rooms |= 1 << room
    return bins, offsets, np.array(fills, np.int64)


def _handed_on(fills: np.ndarray, capacity: int, fan_in: int) -> np.ndarray:
    """Bins that a later round may still fill: those at most half full and the ``fan_in`` emptiest others."""
    keep = np.zeros(len(fills), bool)
    order = np.argsort(fills, kind="stable")
    small = int((fills * 2 <= capacity).sum())
    keep[order[:small + fan_in]] = True
    return keep & (fills < capacity)


def _round(level: int, capacity: int, fan_in: int, last: bool):
    def run(batches):
        got = [(np.asarray(b.column("item")), np.asarray(b.column("length"))) for b in batches if b.num_rows]
        if not got:
            return
        item = np.concatenate([g[0] for g in got])
        length = np.concatenate([g[1] for g in got])
        by = np.argsort(item, kind="stable")  # the same result whatever order the rows arrive in
        item, length = item[by], length[by]
        bins, offsets, fills = best_fit(length, capacity)
        going = np.zeros(len(fills), bool) if last else _handed_on(fills, capacity, fan_in)
        # a bin is named after its first item, so names agree between runs of the task
        lead = np.full(len(fills), np.iinfo(np.int64).max)
        np.minimum.at(lead, bins, item)
        yield pa.RecordBatch.from_arrays([
            pa.array(item), pa.array(lead[bins]), pa.array(offsets), pa.array(fills[bins]), pa.array(going[bins]),
        ], names=["item", "bin", "offset", "fill", "going"])
    return run


def _dealt(items: DataFrame, groups: int, level: int, capacity: int, fan_in: int) -> DataFrame:
    group = F.pmod(F.xxhash64("item"), F.lit(groups))
    dealt = items.select("item", "length", group.alias("group")).repartition(groups, "group")
    return dealt.mapInArrow(_round(level, capacity, fan_in, groups == 1), "item long, bin long, offset long, fill long, going boolean")


def pack(items: DataFrame, capacity: int = CAPACITY, local_items: int = LOCAL_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """``items`` (uid, length <= capacity; a stored table) to (uid, sequence_id, offset)."""
    full = items.where(F.col("length") == capacity)
    rest = items.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // local_items))
    rounds = [materialise(_dealt(rest.select(F.col("uid").alias("item"), "length"), groups, 0, capacity, fan_in), "pack")]
    while groups > 1:
        groups = -(-groups // fan_in)
        open_bins = rounds[-1].where("going").groupBy(F.col("bin").alias("item")).agg(F.max("fill").alias("length"))
        rounds.append(materialise(_dealt(open_bins, groups, len(rounds), capacity, fan_in), "pack"))
    placed = rounds[0].select(F.col("item").alias("uid"), F.col("bin").alias("sequence_id"), "offset")
    if len(rounds) > 1:
        moved = rounds[-1].select("item", "bin", "offset")
        for r in reversed(rounds[1:-1]):  # where a bin of round 1 ended
            later = moved.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("by"))
            moved = r.select("item", "bin", "offset").join(later, "bin", "left").select(
                "item", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
        later = moved.select(F.col("item").alias("sequence_id"), F.col("bin").alias("to"), F.col("offset").alias("by"))
        placed = placed.join(later, "sequence_id", "left").select(
            "uid", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
    return placed.unionByName(full.select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY,
                   local_items: int = LOCAL_ITEMS, fan_in: int = FAN_IN, release: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialise(pieces(docs, tokenizer, end_id, capacity, release=release), "pieces")
    placed = pack(cut, capacity, local_items, fan_in)
    return cut.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most ``capacity``), doc_ids of the pieces in order."""
    cut = materialise(pieces(docs, tokenizer, end_id, capacity, keep_ids=True), "pieces")
    placed = cut.join(pack(cut.drop("ids"), capacity), "uid")
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most ``capacity`` ids in a group
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
