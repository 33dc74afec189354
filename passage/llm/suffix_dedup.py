"""Exact removal of repeated 100-byte strings by a sparse suffix array.

A byte goes if a string of ``LENGTH`` bytes covering it also starts earlier
(in a document with a smaller id, or before in the same one).

Suffixes. Sorting every suffix would shuffle the text many times over, so only
suffixes at anchors are sorted: the anchor of a window of LENGTH bytes is its
``GRAM``-byte gram of smallest hash (the leftmost one), a choice that depends
on the window's bytes alone, so equal windows have equal anchors at equal
places. The windows that share an anchor are consecutive; together they form
one record, whose context is the bytes they cover.

1. Every record carries hashes of its leading bytes (the gram) and of its
   context. Splitters sampled from a few documents range-partition the
   records; a key that holds many records is split like any other, as the
   splitters go on into the document and place.
2. Partitions sort locally, key by key. In a run of equal contexts all but the
   earliest are repeats: every window of theirs starts earlier elsewhere.
3. Grams with two or more different contexts may still share windows. Their
   earliest records (found again in the texts by a Bloom filter of fixed size,
   whose errors only add work) are taken apart into single windows, which go
   through the same exchange and sort.
4. Runs that cross a partition's boundary are compared on the driver, which
   holds the first and the last record of every partition.

96 bits of hashes stand for a gram and context, and for a window.

Edge cases: null and empty texts have no bytes and the hash of the empty
string; texts under LENGTH bytes lose nothing; null ids come after all others;
documents with one id follow each other by a hash of the text, and equal rows
count as one document and share one fate; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passage.llm._common import BASES, arrow_rows, byte_codes, give_back, materialise, mix64, powers, slices, text_or_empty, utf8

LENGTH = 100
GRAM = 48
#: Text hashed at once, which takes some 100 bytes of memory a byte; a longer document is handled alone.
SLICE = 1 << 18
#: Sampled records for each partition.
SAMPLE = 100
#: Bits of the Bloom filter for each record to find again, and its largest size in bits (64 MB).
BLOOM_BITS, BLOOM_MAX, BLOOM_HASHES = 16, 1 << 29, 4
#: Rows of an Arrow batch of records, which are 24 bytes each, and of what comes of them.
RECORD_ROWS = 32_768

_RECORD = "pid int, a long, b long, c long"
_LEN_BITS = 7   # windows in a record: at most LENGTH - GRAM + 1
_MAX_DOC = 1 << (62 - _LEN_BITS)


def _inverse(base: int) -> int:
    x = base
    for _ in range(6):
        x = x * (2 - base * x) % (1 << 64)
    return x


class _Tables:
    """Powers of the two bases and their inverses, as long as the longest slice so far."""

    def __init__(self):
        self.n = 0

    def at_least(self, n: int):
        if n > self.n:
            self.n = n = max(n, SLICE)
            self.power = [powers(b, n + 1) for b in BASES]
            self.inverse = [powers(_inverse(b), n + 1) for b in BASES]
        return self

    def forget(self, more_than: int):
        """Drop tables that a long document made: the worker serves other tasks."""
        if self.n > more_than:
            self.n, self.power, self.inverse = 0, [], []


_TABLES = _Tables()
_CODES = [byte_codes(11), byte_codes(12)]


class _Prefix:
    """Hashes of any substring of a slice from prefix sums modulo 2**64."""

    def __init__(self, raw: np.ndarray, which: int):
        t = _TABLES.at_least(len(raw))
        self.inverse = t.inverse[which]
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_CODES[which][raw] * t.power[which][:len(raw)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])


def anchors(raw: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Records of a slice: row, first window, last window (places in the slice), gram hash, context hash."""
    none = np.zeros(0, np.int64)
    n, w = len(raw), length - gram + 1
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    one, two = _Prefix(raw, 0), _Prefix(raw, 1)
    place = np.arange(n - gram + 1)
    padded = np.full(-(-len(place) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(place)] = (one.hash(place, place + gram) & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)
    count = len(place) - w + 1
    del place
    blocks = padded.reshape(-1, w)  # a sliding minimum from the minima of block heads and tails
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(tail[:count], head[w - 1:w - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    del padded, blocks, head, tail
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.flatnonzero(row[:count] == row[length - 1:length - 1 + count])
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor, row = anchor[at], row[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    s = np.flatnonzero(new)
    first, last = at[s], at[np.append(s[1:], len(at)) - 1]
    context = mix64(two.hash(first, last + length) + (last - first).astype(np.uint64))
    return row[s], first, last, one.hash(anchor[s], anchor[s] + gram), context


def _pids(a: np.ndarray, b: np.ndarray, c: np.ndarray, split: np.ndarray) -> np.ndarray:
    """Partition of each record: how many splitters (sorted rows of a, b, c) are not greater."""
    left, right = np.searchsorted(split[:, 0], a, "left"), np.searchsorted(split[:, 0], a, "right")
    pid = right.copy()
    for i in np.flatnonzero(left != right):  # splitters inside the records of one leading key
        lo, hi = left[i], right[i]
        key = (b[i], c[i])
        while lo < hi:
            mid = (lo + hi) // 2
            if (split[mid, 1], split[mid, 2]) <= key:
                lo = mid + 1
            else:
                hi = mid
        pid[i] = lo
    return pid.astype(np.int32)


def _bits(doc: np.ndarray, lo: np.ndarray, size: int) -> np.ndarray:
    h = mix64(mix64(doc.astype(np.uint64)) ^ lo.astype(np.uint64))
    return np.stack([(mix64(h + np.uint64(j)) % np.uint64(size)).astype(np.int64) for j in range(BLOOM_HASHES)])


def _extract(length: int, gram: int, split: np.ndarray, bloom=None, keep_under: int | None = None):
    """Records of the documents as (pid, a, b, c); with ``bloom`` the single windows of the records it holds.
    ``keep_under`` keeps the records whose hash is below it (for sampling).

    a: 48 bits of the gram's hash, 16 of the context's; b: 32 more bits, first place; c: document, windows of the record."""
    def run(batches):
        words = bloom.value if bloom is not None else None
        for batch in slices(batches, limit=SLICE):
            raw, off = utf8(batch.column("text"))
            num = np.asarray(batch.column("num"))
            row, first, last, g, h = anchors(raw, off, length, gram)
            if words is not None and len(row):
                bits = _bits(num[row], first - off[row], len(words) * 64)
                hit = np.all((words[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1), axis=0)
                row, first, last = row[hit], first[hit], last[hit]
                count = last - first + 1
                row = np.repeat(row, count)
                first = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                last = first
                g, h = _Prefix(raw, 0).hash(first, first + length), _Prefix(raw, 1).hash(first, first + length)
            a = ((g & ~np.uint64(0xFFFF)) | (h >> np.uint64(48))).astype(np.int64)
            low = (h & np.uint64(0xFFFFFFFF)) if words is None else ((g & np.uint64(0xFFFF)) << np.uint64(16)) ^ (h & np.uint64(0xFFFFFFFF))
            b = ((low << np.uint64(32)) | (first - off[row]).astype(np.uint64)).astype(np.int64)
            c = (num[row] << _LEN_BITS) | (last - first + 1)
            if keep_under is not None:
                k = mix64((b ^ c).astype(np.uint64)) >> np.uint64(44) < np.uint64(keep_under)
                a, b, c = a[k], b[k], c[k]
            yield from _cut(pa.RecordBatch.from_arrays([pa.array(_pids(a, b, c, split)), pa.array(a), pa.array(b), pa.array(c)], names=["pid", "a", "b", "c"]))
            del raw, off, num, row, first, last, g, h, a, low, b, c
            _TABLES.forget(2 * SLICE)
        words = None
        give_back()
    return run


def _cut(batch: pa.RecordBatch):
    """The batch in parts of RECORD_ROWS rows."""
    for at in range(0, batch.num_rows, RECORD_ROWS):
        yield batch.slice(at, RECORD_ROWS)


def _whole_grams(batches):
    """Sorted records (a, b, c) in runs of about a batch that end where a gram does; a gram of many batches is one run."""
    held = []
    for x in batches:
        if not x.num_rows:
            continue
        cols = [np.asarray(x.column(k)) for k in ("a", "b", "c")]
        gram = cols[0] >> 16
        cut = int(np.searchsorted(gram, gram[-1]))  # where the batch's last gram begins
        if cut or (held and held[-1][0][-1] >> 16 != gram[0]):
            held.append([v[:cut] for v in cols])
            yield [np.concatenate(v) for v in zip(*held)]
            held = []
        held.append([v[cut:].copy() for v in cols])
    if held:
        yield [np.concatenate(v) for v in zip(*held)]


def _scan(find_groups: bool):
    """A sorted partition: kind 0 repeats, 1 earliest records of grams with several contexts, 2 the partition's ends."""
    def run(batches):
        first, tail = None, None
        for a, b, c in _whole_grams(batches):
            out, ends = scan(a, b, c, TaskContext.get().partitionId())
            first, tail = first if first is not None else ends.slice(0, 1), ends.slice(1)
            yield from _cut(out)
            del a, b, c, out
        if first is not None:
            yield first
            yield tail
        give_back()

    def scan(a, b, c, pid):
        n = len(a)
        doc, size, lo, cls = c >> _LEN_BITS, c & ((1 << _LEN_BITS) - 1), b & 0xFFFFFFFF, b >> 32
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (cls[1:] != cls[:-1])
        start = np.flatnonzero(new)
        run_of = np.cumsum(new) - 1
        length_of = np.diff(np.append(start, n))
        lead = start.copy()  # the earliest record of each run
        many = np.flatnonzero(length_of[run_of] > 1)
        if len(many):
            by = many[np.lexsort((lo[many], doc[many], run_of[many]))]
            head = np.ones(len(by), bool)
            head[1:] = run_of[by[1:]] != run_of[by[:-1]]
            lead[run_of[by[head]]] = by[head]
        # equal rows of the table give equal records: no record is a repeat of itself
        same = (doc == doc[lead[run_of]]) & (lo == lo[lead[run_of]])
        repeat = np.flatnonzero(~same)
        kinds, picks = [np.zeros(len(repeat), np.int8)], [repeat]
        gram = a[start] >> 16
        fresh = np.ones(len(start), bool)
        fresh[1:] = gram[1:] != gram[:-1]
        group = np.cumsum(fresh) - 1
        contexts = np.bincount(group)
        if find_groups:
            multi = lead[contexts[group] > 1]
            kinds.append(np.ones(len(multi), np.int8))
            picks.append(multi)
        pick, kind = np.concatenate(picks), np.concatenate(kinds)
        zero = pa.array(np.zeros(len(pick), np.int64))
        out = pa.RecordBatch.from_arrays([pa.array(kind), pa.array(doc[pick]), pa.array(lo[pick]), pa.array(size[pick]), *[zero] * 5], names=_SCANNED_NAMES)
        # the ends also say where they are, what they hold and how many contexts their gram has here
        two = lead[[0, -1]]
        ends = [np.full(2, 2, np.int8), doc[two], lo[two], size[two], np.full(2, pid), np.arange(2), a[two], cls[two], contexts[group[run_of[two]]]]
        return out, pa.RecordBatch.from_arrays([pa.array(v) for v in ends], names=_SCANNED_NAMES)
    return run


_SCANNED = "kind byte, doc long, lo long, n long, pid long, end long, a long, cls long, contexts long"
_SCANNED_NAMES = [f.split()[0] for f in _SCANNED.split(", ")]


def _across(ends: list) -> tuple[list[tuple], list[tuple]]:
    """Repeats and records of several contexts that only show across partitions.

    ``ends``: the first and the last run's earliest record of every partition, in order."""
    repeats, multi = [], []
    runs: dict = {}
    for e in ends:
        runs.setdefault((e.a, e.cls), []).append((e.doc, e.lo, e.n))
    firsts = {k: min(v) for k, v in runs.items()}
    for k, v in runs.items():
        repeats += [x for x in set(v) if x[:2] != firsts[k][:2]]
    groups: dict = {}
    for e in ends:
        groups.setdefault(e.a >> 16, []).append(e)
    for es in groups.values():
        if len({(e.a, e.cls) for e in es}) > 1 or max(e.contexts for e in es) > 1:
            multi += [firsts[k] for k in {(e.a, e.cls) for e in es}]
    return repeats, multi


def _splitters(rows: pa.Table, n: int) -> np.ndarray:
    a, b, c = (np.asarray(rows[k], np.int64) for k in ("a", "b", "c"))
    by = np.lexsort((c, b, a))
    at = by[len(by) * np.arange(1, n) // n] if len(by) else by
    return np.stack([a[at], b[at], c[at]], axis=1)


def _repeats(texts: DataFrame, sample: DataFrame, rate: int, n: int, length: int, gram: int, bloom=None) -> tuple[DataFrame, list, list]:
    """One exchange: scanned rows (a written table), and what shows across partitions."""
    spark = texts.sparkSession
    none = np.zeros((0, 3), np.int64)
    rows = sample.mapInArrow(_extract(length, gram, none, bloom, rate), _RECORD).select("a", "b", "c").toArrow()  # about SAMPLE * n rows
    split = _splitters(rows, n)
    records = texts.mapInArrow(_extract(length, gram, split, bloom), _RECORD)
    sorted_ = records.repartitionById(n, F.col("pid")).select("a", "b", "c").sortWithinPartitions("a", "b", "c")
    with arrow_rows(spark, RECORD_ROWS):
        scanned = materialise(sorted_.mapInArrow(_scan(bloom is None), _SCANNED), "suffixes")
    ends = scanned.where("kind = 2").orderBy("pid", "end").collect()  # two rows a partition
    repeats, multi = _across(ends)
    return scanned, repeats, multi


def _bloom(found: DataFrame, more: list[tuple]):
    """A Bloom filter of (doc, lo) as an array of 64-bit words; its size is bounded by BLOOM_MAX."""
    count = found.count() + len(more)
    size = 1 << 12
    while size < min(count * BLOOM_BITS, BLOOM_MAX):
        size *= 2

    def run(batches):
        words = np.zeros(size // 64, np.uint64)
        for b in batches:
            bits = _bits(np.asarray(b.column("doc")), np.asarray(b.column("lo")), size).ravel()
            np.bitwise_or.at(words, bits >> 6, np.uint64(1) << (bits & 63).astype(np.uint64))
        at = np.flatnonzero(words)
        yield from _cut(pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].astype(np.int64))], names=["at", "word"]))
        del words, at
        give_back()

    words = np.zeros(size // 64, np.uint64)
    parts = found.select("doc", "lo").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    got = parts.toArrow()  # at most size / 64 rows
    words[np.asarray(got["at"])] = np.asarray(got["word"]).astype(np.uint64)
    if more:
        bits = _bits(np.array([m[0] for m in more]), np.array([m[1] for m in more]), size).ravel()
        np.bitwise_or.at(words, bits >> 6, np.uint64(1) << (bits & 63).astype(np.uint64))
    return words, count


def _numbered(docs: DataFrame) -> DataFrame:
    """num, doc_id and text; ``num`` is the id where ids are unique and small, else the place in the order of (id, text hash)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    seen = rows.groupBy("doc_id").agg(F.count("*").alias("n")).agg(
        F.max("n").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if (seen.n or 0) <= 1 and not seen.nulls and (seen.lo or 0) >= 0 and (seen.hi or 0) < _MAX_DOC:
        return rows.select(F.col("doc_id").alias("num"), "doc_id", "text")
    rows = rows.withColumn("h", F.xxhash64("text"))
    keys = rows.select("doc_id", "h").distinct()
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    placed = materialise(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "numbers")
    part = F.shiftright("at", 33)
    base = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).select(
        "p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row a partition
    nums = placed.join(F.broadcast(base), part == F.col("p")).select(
        F.col("doc_id").alias("_id"), F.col("h").alias("_h"), (F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("num"))
    return rows.join(nums, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("num", "doc_id", "text")


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """num and its repeated stretches (lo, hi) in bytes, unmerged; ``texts`` has num and text."""
    spark = texts.sparkSession
    texts = texts.select("num", "text")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    docs = max(texts.count(), 1)
    # a few documents give the splitters: one in ``one_in`` by hash, and of their records about SAMPLE a partition
    one_in = max(1, docs // (20 * n + 500))
    sample = texts.where(F.pmod(F.xxhash64("num", F.lit(9)), F.lit(one_in)) == 0)
    weight = sample.agg(F.sum(F.length("text"))).first()[0] or 1
    rate = max(1, min(1 << 20, int((1 << 20) * SAMPLE * n * (length - gram) / (2 * weight))))
    scanned, repeats, multi = _repeats(texts, sample, rate, n, length, gram)
    words, count = _bloom(scanned.where("kind = 1"), multi)
    spans = scanned.where("kind = 0").select("doc", "lo", (F.col("lo") + F.col("n") - 1 + length).alias("hi"))
    if count:
        bloom = spark.sparkContext.broadcast(words)  # at most BLOOM_MAX bits
        windows, more, _ = _repeats(texts, sample, rate, n, length, gram, bloom)
        repeats = repeats + more
        spans = spans.unionByName(windows.where("kind = 0").select("doc", "lo", (F.col("lo") + F.col("n") - 1 + length).alias("hi")))
    if repeats:
        extra = pa.table({"doc": pa.array([r[0] for r in repeats], pa.int64()), "lo": pa.array([r[1] for r in repeats], pa.int64()),
                          "hi": pa.array([r[1] + r[2] - 1 + length for r in repeats], pa.int64())})
        spans = spans.unionByName(spark.createDataFrame(extra))
    return spans.select(F.col("doc").alias("num"), "lo", "hi")


def _pack(batches):
    codec = pa.Codec("zstd", compression_level=3)
    for b in slices(batches):
        raw, off = utf8(b.column("text"))
        view = memoryview(raw)
        yield pa.RecordBatch.from_arrays([
            b.column("num"), b.column("doc_id"), pa.array(np.diff(off)),
            pa.array([codec.compress(view[a:e], asbytes=True) for a, e in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary()),
        ], names=["num", "doc_id", "n_bytes", "packed"])
        del raw, off, view
    give_back()


def _merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the stretches."""
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], np.maximum.accumulate(hi[by])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    s = np.flatnonzero(new)
    return list(zip(lo[s].tolist(), hi[np.append(s[1:], len(lo)) - 1].tolist()))


def _kept(batches):
    codec = pa.Codec("zstd")
    for b in batches:
        out = []
        for n, packed, spans in zip(b.column("n_bytes").to_pylist(), b.column("packed"), b.column("spans")):
            text = codec.decompress(packed.as_buffer(), n, asbytes=True) if n else b""
            flat = np.asarray(spans.values.flatten()[0]) if spans.is_valid and len(spans.values) else np.zeros(0, np.int64)
            runs = _merged(flat, np.asarray(spans.values.flatten()[1])) if len(flat) else []
            h, at = hashlib.sha256(), 0
            for lo, hi in runs:
                h.update(text[at:lo])
                at = hi
            h.update(text[at:])
            out.append((sum(e - a for a, e in runs), len(runs), h.hexdigest()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array([o[0] for o in out], pa.int64()),
                                          pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    give_back()


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    texts = _numbered(docs)
    spans = repeated_spans(texts, length, gram)
    by_doc = spans.groupBy("num").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # bounded by one document
    packed = texts.mapInArrow(_pack, "num long, doc_id long, n_bytes long, packed binary")
    return packed.join(by_doc, "num", "left").select("doc_id", "n_bytes", "packed", "spans").mapInArrow(
        _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
