"""Lexical retrieval packing: windows filled with a seed's BM25 neighbours.

1. Documents become ids with a closing id. Full windows of ``capacity`` ids
   are sequences of their own, cut from the start; what is left of a document
   (its rest, shorter than a window) is packed. The terms of a document are
   the distinct ids of its whole text with their counts, so a short rest is
   still placed by what its document is about.
2. Document frequencies, the number of documents and their mean length are
   counted over all documents: at most a number a vocabulary entry.
3. A document's route is the sign bits of random projections of its BM25
   vector: like documents agree in the leading bits. Rests are
   range-partitioned by (route, hash of the row), which cuts a large group of
   copies anywhere; a partition is a shard of about ``shard_rows`` rests.
4. A shard builds an inverted index: for each term the documents that hold it
   and its BM25 weight there; a term that more than half of all documents hold
   weighs nothing. Seeds follow from the longest rest to the shortest. A seed asks for the
   unused rests of its shard by its ``query_terms`` heaviest terms; they fill
   the window in the order of their scores, whole as long as they fit, and the
   first that doesn't fit is cut, its remainder staying unused. Rests that no
   query finds follow in route order.
5. A shard's last window, if not full, is cut into sequences whose lengths are
   powers of two, so nothing is padded.

Bounds: a shard holds its rests (under ``capacity`` ids each) and the distinct
ids of their documents (at most the vocabulary); the driver and the broadcast
hold one number a vocabulary entry.

Edge cases: a null or empty text is one piece holding the closing id; a very
long text is encoded alone and leaves as full windows, only its rest and
distinct ids are kept; repeated rows and ids are packed once each; an empty
table gives no rows; documents without a weighing term are placed by route;
other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passage.llm._common import materialise, mix64, slices, text_or_empty
from passage.llm.byte_tokens import byte_encoder

CAPACITY = 1024
END_ID = 0
#: Rests of a shard.
SHARD_ROWS = 4096
#: Terms of a seed's query, the heaviest ones.
QUERY_TERMS = 24
#: Text encoded at once.
SLICE = 10 << 20
#: BM25's saturation and length normalisation.
K1, B = 1.2, 0.75
#: Bits of a route.
ROUTE_BITS = 32
#: A term's count above this weighs the same (BM25 saturates far below).
MOST = (1 << 16) - 1

_WINDOW, _REST = 0, 1
_PARTS = "uid long, doc_id long, kind byte, start long, length long, doc_tokens long, ids_crc32 long, ids binary, terms binary, counts binary"


def _spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _blobs(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each run of ``flat``."""
    off = (bounds * flat.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _unblob(col: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    parts = col.to_pylist()
    sizes = np.array([len(p) for p in parts], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind), np.concatenate([[0], np.cumsum(sizes)])


def _gathered(batches, limit: int = SLICE):
    """Arrow batches put together to about ``limit`` bytes of text: words that many texts share are looked up once."""
    held, size = [], 0
    for b in slices(batches, limit=limit):
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _kind(path: str) -> str:
    """The integers that hold a vocabulary's ids."""
    return "<u2" if byte_encoder(path).vocab_size <= 1 << 16 else "<u4"


def _split(path: str, end_id: int, capacity: int, keep_ids: bool, kind_of: str):
    def run(batches):
        enc, uid = byte_encoder(path), TaskContext.get().partitionId() << 36
        for b in _gathered(batches):
            ids, bounds = enc.encode(b.column("text"), end_id)
            ids = np.ascontiguousarray(ids, "<u4")
            sizes = np.diff(bounds)
            rows = b.num_rows
            full, rest = sizes // capacity, sizes % capacity
            # distinct ids of each row, by one sort of (row, id)
            key = np.sort(np.repeat(np.arange(rows, dtype=np.int64), sizes) << 32 | ids)
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            at = np.flatnonzero(new)
            row_of = key[at] >> 32
            terms = (key[at] & 0xFFFFFFFF).astype(kind_of)
            counts = np.minimum(np.diff(np.append(at, len(key))), MOST).astype("<u2")
            of_row = np.searchsorted(row_of, np.arange(rows + 1))
            doc = b.column("doc_id").cast(pa.int64())
            raw = memoryview(ids).cast("B")

            w_row = np.repeat(np.arange(rows), full)
            w_start = (np.arange(len(w_row)) - np.repeat(np.cumsum(full) - full, full)) * capacity
            w_at = bounds[:-1][w_row] + w_start
            r_row = np.arange(rows)
            r_at = bounds[:-1] + full * capacity
            row = np.concatenate([w_row, r_row])
            begin, length = np.concatenate([w_at, r_at]), np.concatenate([np.full(len(w_row), capacity), rest])
            kind = np.repeat(np.array([_WINDOW, _REST], np.int8), [len(w_row), len(r_row)])
            crc = [zlib.crc32(raw[4 * x:4 * (x + capacity)]) for x in w_at.tolist()] + [None] * len(r_row)
            with_ids = np.concatenate([np.full(len(w_row), capacity if keep_ids else 0), rest])
            flat = ids[_spans(begin, with_ids)]
            n_terms = np.concatenate([np.zeros(len(w_row), np.int64), np.diff(of_row)])
            mine = _spans(of_row[:-1][row], n_terms)
            ends = lambda n: np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([
                pa.array(uid + np.arange(len(row))), doc.take(pa.array(row)), pa.array(kind),
                pa.array(np.concatenate([w_start, full * capacity])), pa.array(length), pa.array(sizes[row]), pa.array(crc, pa.int64()),
                _blobs(flat.astype(kind_of), ends(with_ids)), _blobs(terms[mine], ends(n_terms)), _blobs(counts[mine], ends(n_terms)),
            ], names=[f.split()[0] for f in _PARTS.split(", ")])
            uid += len(row)
    return run


def parts(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Full windows and one rest of each document, which carries its ids and its document's distinct ids and counts
    (a document that ends with a full window has a rest of length 0)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_split(tokenizer, end_id, capacity, keep_ids, _kind(tokenizer)), _PARTS)


def _frequencies(kind: str):
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            terms, _ = _unblob(b.column("terms"), kind)
            n = np.bincount(terms, minlength=len(total))
            n[:len(total)] += total
            total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])
    return run


def _widened(kind: str):
    """The ids of windows as 32-bit integers."""
    def run(batches):
        for b in batches:
            ids, bounds = _unblob(b.column("ids"), kind)
            yield b.set_column(b.schema.get_field_index("ids"), b.schema.field("ids"), _blobs(ids.astype("<u4"), bounds))
    return run


class Weights:
    """BM25 weights of the terms of documents, from counts over all documents."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        # a term of more than half of the documents weighs nothing
        self.idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0.0)
        self.mean = mean

    def of(self, terms: np.ndarray, counts: np.ndarray, length: np.ndarray) -> np.ndarray:
        tf = counts.astype(np.float64)
        return self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))


def _route(weights, kind: str):
    def run(batches):
        signs = None
        for b in batches:
            if not b.num_rows:
                continue
            if signs is None:
                h = mix64(np.arange(len(weights.value.idf), dtype=np.uint64) + np.uint64(77))
                signs = np.where((h[:, None] >> np.arange(ROUTE_BITS, dtype=np.uint64)) & np.uint64(1), 1, -1).astype(np.float32)
            terms, bounds = _unblob(b.column("terms"), kind)
            counts, _ = _unblob(b.column("counts"), "<u2")
            n = np.diff(bounds)
            w = weights.value.of(terms, counts, np.repeat(np.asarray(b.column("doc_tokens")), n)).astype(np.float32)
            # a rest always has a term: the closing id
            bits = np.add.reduceat(signs[terms] * w[:, None], bounds[:-1], axis=0) > 0
            route = (bits << np.arange(ROUTE_BITS - 1, -1, -1, dtype=np.int64)).sum(1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names), pa.array(route)], names=[*b.schema.names, "route"])
    return run


class Index:
    """An inverted index of a shard: for each term the documents with it and its weight there."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, bounds: np.ndarray):
        self.rows = len(bounds) - 1
        self.terms, self.weight, self.bounds = terms, weight, bounds
        row = np.repeat(np.arange(self.rows), np.diff(bounds))
        order = np.argsort(terms, kind="stable")
        self.row, self.value = row[order], weight[order]
        self.key, first = np.unique(terms[order], return_index=True)
        self.first = np.append(first, len(order))

    def scores(self, row: int, query_terms: int) -> np.ndarray:
        """BM25 scores of all documents for the heaviest terms of ``row``."""
        a, b = self.bounds[row], self.bounds[row + 1]
        w = self.weight[a:b]
        pick = np.lexsort((self.terms[a:b], -w))[:query_terms]
        at = np.searchsorted(self.key, self.terms[a:b][pick[w[pick] > 0]])
        posted = _spans(self.first[at], self.first[at + 1] - self.first[at])
        return np.bincount(self.row[posted], self.value[posted], self.rows)


def fill_windows(index: Index, lengths: np.ndarray, capacity: int = CAPACITY, query_terms: int = QUERY_TERMS) -> list[list[tuple[int, int, int]]]:
    """Windows of (row, start, length) pieces, in order; all but the last one are full. Every length is under ``capacity``."""
    start, left = np.zeros(len(lengths), np.int64), lengths.astype(np.int64).copy()
    windows, unused, fresh = [], left > 0, 0
    for seed in np.argsort(-lengths, kind="stable").tolist():
        if not unused[seed]:
            continue
        window, room = [], capacity

        def take(i: int) -> None:
            nonlocal room
            n = min(room, int(left[i]))
            window.append((i, int(start[i]), n))
            start[i] += n
            left[i] -= n
            room -= n
            unused[i] = left[i] > 0

        take(seed)
        if room:
            s = index.scores(seed, query_terms)
            near = np.flatnonzero(unused & (s > 0))
            size = 16
            while room and len(near):  # the best ones first, without sorting all
                if len(near) > size:
                    cut = np.partition(s[near], len(near) - size)[len(near) - size]
                    best = near[s[near] >= cut]
                else:
                    best = near
                for i in best[np.lexsort((best, -s[best]))].tolist():
                    if not room:
                        break
                    take(i)
                if room:
                    near, size = near[~np.isin(near, best)], 4 * size
        while room and fresh < len(lengths):
            if unused[fresh]:
                take(fresh)
            else:
                fresh += 1
        windows.append(window)
    # a seed that a later window cut keeps its remainder: it is taken as a seed or in route order above
    return windows


def in_powers(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A window cut into sequences whose lengths are powers of two, the longest first."""
    total, out, pieces = sum(n for _, _, n in window), [], [list(p) for p in window]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        part = []
        while room:
            row, begin, n = pieces[0]
            k = min(n, room)
            part.append((row, begin, k))
            room -= k
            pieces[0] = [row, begin + k, n - k]
            if k == n:
                pieces.pop(0)
        out.append(part)
    return out


def _pack(weights, kind: str, capacity: int, query_terms: int, keep_ids: bool):
    names = ["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("route", "ascending"), ("tie", "ascending"), ("uid", "ascending")]).combine_chunks().to_batches()[0]
        terms, bounds = _unblob(t.column("terms"), kind)
        counts, _ = _unblob(t.column("counts"), "<u2")
        ids, at = _unblob(t.column("ids"), kind)
        ids = ids.astype("<u4")
        length, tokens, begin, uid = (np.asarray(t.column(c)) for c in ("length", "doc_tokens", "start", "uid"))
        w = weights.value.of(terms, counts, np.repeat(tokens, np.diff(bounds)))
        windows = fill_windows(Index(terms, w, bounds), length, capacity, query_terms)
        sequences = [s for x in windows for s in ([x] if sum(p[2] for p in x) == capacity else in_powers(x))]
        raw, rows, cols = memoryview(ids).cast("B"), [], [[] for _ in range(6)]
        for s in sequences:
            # named after its first id, which lies in this sequence only: runs of the task agree
            name, offset = (int(uid[s[0][0]]) * capacity + s[0][1]) * 2 + 1, 0
            for row, a, n in s:
                x = int(at[row]) + a
                rows.append(row)
                for c, v in zip(cols, (begin[row] + a, n, zlib.crc32(raw[4 * x:4 * (x + n)]), name, offset, x)):
                    c.append(v)
                offset += n
        pick = pa.array(rows, pa.int64())
        starts, lengths, crcs, seq, offsets, places = (np.array(c, np.int64) for c in cols)
        out = [t.column("uid").take(pick), t.column("doc_id").take(pick), pa.array(starts), pa.array(lengths), pa.array(crcs), t.column("doc_tokens").take(pick), pa.array(seq), pa.array(offsets)]
        if keep_ids:
            out.append(_blobs(ids[_spans(places, lengths)], np.concatenate([[0], np.cumsum(lengths)])))
        yield pa.RecordBatch.from_arrays(out, names=names)
    return run


def pack_related(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS,
                 query_terms: int = QUERY_TERMS, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset (with ``keep_ids`` the
    ids too, as little-endian 32-bit integers). ``capacity`` is a power of two."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spark = docs.sparkSession
    kind = _kind(tokenizer)
    cut = materialise(parts(docs, tokenizer, end_id, capacity, keep_ids), "parts")
    more = ["ids"] if keep_ids else []
    windows = cut.where(F.col("kind") == _WINDOW).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("uid") * 2 * capacity).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *more)
    if keep_ids:
        windows = windows.mapInArrow(_widened(kind), windows.schema)
    rests = cut.where(F.col("kind") == _REST)
    n, mean = rests.agg(F.count("*"), F.avg("doc_tokens")).first()
    if not n:
        return windows
    df = rests.select("terms").mapInArrow(_frequencies(kind), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # at most the vocabulary
    of = np.zeros(int(max(df["term"].to_numpy())) + 1, np.int64)
    of[df["term"].to_numpy()] = df["df"].to_numpy()
    weights = spark.sparkContext.broadcast(Weights(n, float(mean), of))
    fields = "uid long, doc_id long, start long, length long, doc_tokens long, ids binary, terms binary, counts binary"
    routed = materialise(rests.where("length > 0").select(*[f.split()[0] for f in fields.split(", ")]).mapInArrow(_route(weights, kind), fields + ", route long"), "routed")
    shards = max(1, -(-routed.count() // shard_rows))
    dealt = routed.withColumn("tie", F.xxhash64("uid")).repartitionByRange(shards, "route", "tie")
    schema = "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if keep_ids else "")
    return windows.unionByName(dealt.mapInArrow(_pack(weights, kind, capacity, query_terms, keep_ids), schema).drop("uid"))


def sequences(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian 32-bit integers) and doc_ids of the pieces in order."""
    packed = materialise(pack_related(docs, tokenizer, end_id, capacity, keep_ids=True), "packed")
    pieces = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most ``capacity`` ids in a group
    join = F.aggregate("p", F.expr("cast('' as binary)"), lambda whole, p: F.concat(whole, p["ids"]))
    return packed.groupBy("sequence_id").agg(pieces.alias("p")).select("sequence_id", join.alias("ids"), F.col("p.doc_id").alias("doc_ids"))
