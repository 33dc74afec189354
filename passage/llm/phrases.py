"""Phrases (collocations) from an FM-index per shard over word ids.

1. Texts are lower-cased (A-Z), cut into pieces at signs and line ends and the
   pieces into words. A task collects about SHARD_WORDS words into a shard:
   its word ids in order, with 0 between pieces, and its own dictionary of
   (language, word) with counts.
2. Dictionaries meet by word: the sum over all shards is a word's count. Words
   below the least count become 0 too, as no phrase with them can be frequent;
   the others get numbers that are the same in all shards.
3. Each shard builds an FM-index of what is left (once a pass; it is cheaper to
   build than to store): the Burrows-Wheeler transform
   of its ids and of the reversed ids, ordered by the next DEPTH - 1 words, as
   no longer pattern is extended. A phrase is a pair of intervals of
   the same size, in the index and in the reversed one.
4. Phrases grow a word a level. A left extension splits the phrase's interval
   by the symbols in front (LF-mapping gives the new interval, the number of
   smaller symbols the new reversed one); a right extension does the same in
   the reversed index. A phrase is counted in the shard if both ways reach it,
   from its suffix and from its prefix. Pairs are counted first, and summed
   across shards; a filter of bounded size that holds the frequent ones tells
   each shard which of its pairs go on to DEPTH words. A shard then sends a
   phrase only with the occurrences that no longer phrase to the left covers:
   at most one row a word, whatever the filter lets through. A phrase's count
   is the sum over all rows that end with it.
5. A phrase is dropped if a left or right extension is as frequent: a longer
   phrase that holds it and is as frequent implies such an extension. Each cut
   of a phrase into two parts looks their counts up by their words; the
   arithmetic is done in decimals.

Counts are exact: pruning by frequent words and pairs loses nothing. A very frequent word or phrase is one row a shard.

Edge cases: a null or empty text has no words; a null language is 'und'; a
very long text makes its shard larger (about 5 bytes of shard a word), as
pieces aren't cut; repeated rows count each time; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passage.llm._common import LOWER, bloom_filter, in_bloom, materialise, slices, text_or_empty, utf8

#: Words of a phrase, five at most (three 64-bit columns hold their numbers).
DEPTH = 5
LEAST = 100
FIRST = 2000
#: Words of a shard, and text read at once.
SHARD_WORDS = 1 << 21
SLICE = 4 << 20
#: Rows of a bucket of words, about.
BUCKET_ROWS = 100_000

# signs and line ends that close a piece, white space between words (fixed values)
_CLOSE = np.zeros(256, bool)
_CLOSE[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SOLID = ~_CLOSE
_SOLID[[0x20, 0x09]] = False

_SHARD = "shard long, part int, ids binary, local int, lang string, word string, n long"
#: Ids in a row of a shard's text.
ROW_IDS = 1 << 18


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words put together, their sizes, and which words start a piece."""
    raw, off = utf8(col)
    low = LOWER[raw]
    if not len(low):
        return low, np.zeros(0, np.int64), np.zeros(0, bool)
    solid = _SOLID[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    close = solid.copy()
    close[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    sizes = np.flatnonzero(close) + 1 - starts
    cut = _CLOSE[low]
    cut |= edge[:-1]
    piece = np.cumsum(cut, dtype=np.int32)[starts]
    first = np.ones(len(starts), bool)
    first[1:] = piece[1:] != piece[:-1]
    return low[solid], sizes, first


def _pack(ids: np.ndarray) -> bytes:
    """Ids as compressed little-endian integers of two or four bytes."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\x02" if small else b"\x04") + len(ids).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(ids, "<u2" if small else "<u4"), "zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    kind, n = np.dtype("<u2" if blob[0] == 2 else "<u4"), int.from_bytes(blob[1:9], "little")
    return np.frombuffer(pa.decompress(blob[9:], n * kind.itemsize, "zstd"), kind) if n else np.zeros(0, kind)


def _shards(limit: int):
    def flush(shard: int, held: dict):
        seq, base, names = [], 0, [f.split()[0] for f in _SHARD.split(", ")]
        for lang in sorted(held):
            chunks = held[lang]
            data, sizes, first = (np.concatenate(x) for x in zip(*chunks))
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(data)]).dictionary_encode()
            index = np.asarray(coded.indices)
            words = coded.dictionary
            count = np.bincount(index, minlength=len(words))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(words), shard)), pa.nulls(len(words), pa.int32()), pa.nulls(len(words), pa.binary()), pa.array((base + 1 + np.arange(len(words))).astype(np.int32)),
                pa.array([lang], pa.string()).take(pa.array(np.zeros(len(words), np.int64))), words.cast(pa.binary()).cast(pa.string()), pa.array(count),
            ], names=names)
            at = np.arange(len(index)) + np.cumsum(first)      # a 0 in front of each piece
            out = np.zeros(len(index) + int(first.sum()), np.uint32)
            out[at] = base + 1 + index
            seq.append(out)
            base += len(words)
        seq = np.concatenate(seq)
        rows = [_pack(seq[i:i + ROW_IDS]) for i in range(0, len(seq), ROW_IDS)]
        none = [pa.nulls(len(rows), t) for t in (pa.int32(), pa.string(), pa.string(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary()), *none], names=names)

    def run(batches):
        shard, held, words = TaskContext.get().partitionId() << 32, {}, 0
        for b in slices(batches, limit=SLICE):
            lang = b.column("lang").dictionary_encode()
            of = np.asarray(lang.indices)
            for k, name in enumerate(lang.dictionary.to_pylist()):
                part = _words(b.column("text").take(pa.array(np.flatnonzero(of == k))) if len(lang.dictionary) > 1 else b.column("text"))
                if len(part[1]):
                    held.setdefault(name, []).append(part)
                    words += len(part[1])
            if words >= limit:
                yield from flush(shard, held)
                shard, held, words = shard + 1, {}, 0
        if words:
            yield from flush(shard, held)
    return run


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A written table of shards: one row with the ids of each, and a row with the count of each of its words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    return materialise(rows.mapInArrow(_shards(shard_words), _SHARD), "shards")


# ------------------------------------------------------------- the index

def _sorted_by(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the next ``depth`` symbols (0 beyond the end)."""
    n, wide = len(symbols), symbols.dtype.itemsize * 8
    padded = np.concatenate([symbols, np.zeros(depth, symbols.dtype)])
    order, fits = None, 64 // wide  # so many symbols make one key
    for end in range(depth, 0, -fits):
        key = np.zeros(n, np.uint64)
        for k in range(max(end - fits, 0), end):
            key <<= np.uint64(wide)
            key |= padded[k:k + n]
        order = np.argsort(key).astype(np.int32) if order is None else order[np.argsort(key[order], kind="stable")]
    return order


def transform(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The symbol in front of each suffix, suffixes in the order of their first ``depth`` symbols."""
    return symbols[_sorted_by(symbols, depth) - 1]    # the first symbol is a 0, like what precedes it


class Index:
    """One direction of the index: its transform and the LF-mapping."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        order = np.argsort(bwt, kind="stable")
        self.lf = np.empty(len(bwt), np.int32)
        self.lf[order] = np.arange(len(bwt), dtype=np.int32)

    def extended(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All extensions of disjoint intervals by the symbol in front: interval, symbol, count, start of the new
        interval here, and how many occurrences have a smaller symbol."""
        parent = np.repeat(np.arange(len(low), dtype=np.uint32), size)
        before = np.cumsum(size) - size
        place = (np.arange(len(parent)) + np.repeat(low - before, size)).astype(np.int32)
        key = parent.astype(np.uint64) << np.uint64(32) | self.bwt[place]
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        if not len(at):
            return (np.zeros(0, np.int64),) * 5
        count = np.diff(np.append(at, len(key)))
        p, s = (key[at] >> np.uint64(32)).astype(np.int64), (key[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        real = s > 0
        first = np.minimum.reduceat(self.lf[place[order]], at)  # the occurrences of a symbol keep their order
        return p[real], s[real], count[real], first[real].astype(np.int64), (at - before[p])[real]


def indexes(seq: pa.Table, words: pa.Table, depth: int) -> tuple[np.ndarray, Index, Index] | None:
    """The index of a shard over its frequent words, in both directions, and the words' global numbers by their own from 1."""
    if not seq.num_rows or not words.num_rows:
        return None
    ids = np.concatenate([_unpack(x) for x in seq.sort_by("part").column("ids").to_pylist()])
    local, number = np.asarray(words.column("local")), np.asarray(words.column("id")).astype(np.int64)
    own = np.zeros(max(int(ids.max()), int(local.max())) + 1, np.uint16 if len(local) < 1 << 16 else np.uint32)
    by = np.argsort(number, kind="stable")
    own[local[by]] = np.arange(1, len(local) + 1)
    # a 0 in front and behind; then runs of 0 become one, and words that stand alone go
    s = np.concatenate([own[:1] * 0, own[ids], own[:1] * 0])
    keep = np.ones(len(s), bool)
    keep[1:-1] = (s[:-2] > 0) | (s[1:-1] > 0) & (s[2:] > 0)
    s = s[keep]
    again = np.ones(len(s), bool)
    again[1:] = (s[1:] > 0) | (s[:-1] > 0)
    s = s[again]
    return np.concatenate([[0], number[by]]), Index(transform(s, depth - 1)), Index(transform(s[::-1], depth - 1))


def _from_behind(number: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """The phrases' columns a, b, c, d from their last word on: the numbers of the last and the one before it, two to a
    64-bit integer, and of the third, the fourth and the fifth from behind (0 for none)."""
    w = np.zeros((len(words), DEPTH), np.int64)
    w[:, :words.shape[1]] = number[words[:, ::-1]]
    return [w[:, 0] << 32 | w[:, 1], w[:, 2], w[:, 3], w[:, 4]]


def _columns(number: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """The phrases' columns a, b, c: the numbers of words 1 and 2, 3 and 4, and 5, two to a 64-bit integer (0 for none)."""
    w = np.zeros((len(words), DEPTH), np.int64)
    w[:, :words.shape[1]] = number[words]
    return [w[:, 0] << 32 | w[:, 1], w[:, 2] << 32 | w[:, 3], w[:, 4]]


def _two(forth: Index, words: int):
    """All pairs of words: both words, count, interval start here and in the reversed index."""
    size = np.bincount(forth.bwt, minlength=words)
    low = np.cumsum(size) - size          # where a word's interval starts, in both directions
    p, s, n, start, smaller = forth.extended(low[1:], size[1:])
    return np.stack([s, p + 1], 1), n, start, low[1:][p] + smaller


def _pairs(depth: int):
    """A shard's pairs of words and their counts."""
    def run(seq: pa.Table, words: pa.Table) -> pa.Table:
        built = indexes(seq, words, depth)
        if built is None:
            return pa.table({k: pa.array([], pa.int64()) for k in ("a", "n")})
        number, forth, _ = built
        pair, n, _, _ = _two(forth, len(number))
        return _in_rows(pa.table({"a": _columns(number, pair)[0], "n": n}))
    return run


def _in_rows(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches(table.to_batches(max_chunksize=1 << 16), table.schema)


def _longer(frequent, depth: int):
    """A shard's phrases of 3 to ``depth`` words, from its pairs that the filter holds, each with the number of its
    occurrences that no longer one to the left covers."""
    def run(seq: pa.Table, words: pa.Table) -> pa.Table:
        built, out = indexes(seq, words, depth), [pa.table({k: pa.array([], pa.int64()) for k in ("a", "b", "c", "d", "n")})]

        def send(number, phrase, n):
            some = n > 0
            out.append(pa.Table.from_arrays([pa.array(v) for v in _from_behind(number, phrase[some])] + [pa.array(n[some])], names=["a", "b", "c", "d", "n"]))

        if built is not None:
            number, forth, back = built
            phrase, n, low, other = _two(forth, len(number))
            known = in_bloom(frequent.value, _columns(number, phrase)[0])
            phrase, n, low, other = (v[known] for v in (phrase, n, low, other))
            for k in range(2, depth):
                order = np.argsort(low)
                phrase, n, low, other = (v[order] for v in (phrase, n, low, other))
                p, s, count, start, smaller = forth.extended(low, n)
                # right extensions: the symbols in front in the reversed index; their forward interval lies behind the smaller ones
                q, _, _, _, less = back.extended(other, n)
                # an interval belongs to one phrase of a length: both ways must reach it
                both = np.isin(start, low[q] + less)
                p, start, count = p[both], start[both], count[both]
                if k > 2:
                    send(number, phrase, n - np.bincount(p, count, len(n)).astype(np.int64))
                phrase, n, low, other = np.column_stack([s[both], phrase[p]]), count, start, other[p] + smaller[both]
            if depth > 2:
                send(number, phrase, n)
        return _in_rows(pa.concat_tables(out).combine_chunks())
    return run


# ------------------------------------------------------------- counts

def _frequent_words(own: DataFrame, least: int) -> DataFrame:
    """shard, local, lang, word, f and id of the words whose sum f over all shards reaches ``least``: a written table.
    A word has a row a shard at most. Numbers are dealt within buckets of words: bucket, bucket + buckets, ..."""
    buckets = max(64, own.count() // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(buckets))
    rows = own.withColumn("bucket", bucket).repartition("bucket")
    each = Window.partitionBy("bucket", "lang", "word")
    often = rows.withColumn("f", F.sum("n").over(each)).where(F.col("f") >= least)
    place = F.dense_rank().over(Window.partitionBy("bucket").orderBy("lang", "word")).cast("long")
    number = (F.col("bucket") + 1 + F.lit(buckets) * (place - 1)).cast("int")  # more than 31 bits raise an error
    return materialise(often.select("shard", "local", "lang", "word", "f", number.alias("id")), "words")


def _ends(found: DataFrame, least: int) -> DataFrame:
    """a, b, c (as in ``_columns``) and f of the phrases of three words or more whose count reaches ``least``, from rows
    (a, b, c, d from behind, n): a phrase occurs with each row that ends with it. The rows of the same last three words
    meet in a task, and only those frequent there go on."""
    three, four, five = (Window.partitionBy(*"abcd"[:k]) for k in (2, 3, 4))
    dealt = found.repartition("a", "b").sortWithinPartitions("a", "b", "c", "d")
    rows = dealt.withColumn("f3", F.sum("n").over(three)).where(F.col("f3") >= least)
    rows = rows.withColumn("f4", F.sum("n").over(four)).withColumn("f5", F.sum("n").over(five))
    zero = F.lit(0).cast("long")
    known = lambda c, f: F.when(F.col(f) >= least, F.col(c)).otherwise(zero).alias(c)
    # a row a frequent phrase, about: those that are not frequent are cut to what is
    ends = materialise(rows.groupBy("a", "b", known("c", "f4"), known("d", "f5")).agg(
        F.max("f3").alias("f3"), F.max("f4").alias("f4"), F.max("f5").alias("f5")), "ends")
    last, before = F.shiftright("a", 32), F.col("a").bitwiseAND(F.lit((1 << 32) - 1))
    two = lambda x, y: F.shiftleft(x, 32).bitwiseOR(y)
    b, c, d = F.col("b"), F.col("c"), F.col("d")
    out = ends.select(two(b, before).alias("a"), two(last, zero).alias("b"), zero.alias("c"), F.col("f3").alias("f")).distinct()
    out = out.union(ends.where("c > 0").select(two(c, b), two(before, last), zero, "f4").distinct())
    return out.union(ends.where("d > 0").select(two(d, c), two(b, before), last, "f5").distinct())


def counted_phrases(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The words of each language (lang, total), the frequent words (lang, word, f, id) and the frequent phrases of 2 to
    ``depth`` words (depth, w1, ..., f; 0 behind the last word)."""
    spark = docs.sparkSession
    rows = shards(docs, shard_words)
    own = rows.where("word is not null").select("shard", "local", "lang", "word", "n")
    totals = own.groupBy("lang").agg(F.sum("n").alias("total"))
    mine = _frequent_words(own, least)
    words = materialise(mine.groupBy("id").agg(F.min("lang").alias("lang"), F.min("word").alias("word"), F.min("f").alias("f")), "words")
    ids = mine.select("shard", "local", "id")
    seq = rows.where("ids is not null").select("shard", "part", "ids")
    pair = lambda: seq.groupBy("shard").cogroup(ids.groupBy("shard"))
    found = pair().applyInArrow(_pairs(depth), "a long, n long").groupBy("a").agg(F.sum("n").alias("f"))
    pairs = materialise(found.where(F.col("f") >= least), "pairs")
    # of bounded size; what it lets through by chance is counted and found below the least count
    frequent = spark.sparkContext.broadcast(bloom_filter(pairs.select(F.col("a").alias("key")), pairs.count()))
    found = pair().applyInArrow(_longer(frequent, depth), "a long, b long, c long, d long, n long")
    more = materialise(_ends(found, least), "longer")
    none = F.lit(0).cast("long")
    two = pairs.select("a", none.alias("b"), none.alias("c"), "f")
    high, low = lambda c: F.shiftright(c, 32).cast("int"), lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    w = [high("a"), low("a"), high("b"), low("b"), F.col("c").cast("int")][:depth]
    phrases = two.unionByName(more).select(*[x.alias(f"w{k}") for k, x in enumerate(w, 1)], "f")
    size = sum((F.col(f"w{k}") > 0).cast("int") for k in range(1, depth + 1))
    return totals, words, materialise(phrases.select(size.alias("depth"), "*"), "phrases")


def _part(depth: int, begin: Column, end: Column) -> list[Column]:
    """The words begin..end (from 1) of a phrase, with 0 behind."""
    all_words = F.array(*[F.col(f"w{k}") for k in range(1, depth + 1)])
    return [F.when(begin + k <= end, F.get(all_words, begin + k - 1)).otherwise(0).alias(f"w{k + 1}") for k in range(depth)]


def collocations(docs: DataFrame, least: int = LEAST, first: int | None = FIRST, depth: int = DEPTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``first`` phrases (all, with None)."""
    totals, words, phrases = counted_phrases(docs, least, depth, shard_words)
    keys = [f"w{k}" for k in range(1, depth + 1)]
    known = phrases.select(*keys, "f").unionByName(words.select(F.col("id").alias("w1"), *[F.lit(0).alias(k) for k in keys[1:]], "f"))
    # what an extension is as frequent as
    longer = phrases.where("depth > 2")
    inner = longer.select(*_part(depth, F.lit(1), F.col("depth") - 1), "f").unionByName(longer.select(*_part(depth, F.lit(2), F.col("depth")), "f"))
    most = inner.groupBy(*keys).agg(F.max("f").alias("longest"))
    kept = materialise(phrases.join(most, keys, "left").where(F.col("longest").isNull() | (F.col("longest") < F.col("f"))).select("depth", *keys, "f"), "kept")
    cuts = kept.select(F.struct("depth", *keys).alias("p"), F.col("f").alias("a"), "depth", *keys, F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"))
    left = cuts.select("p", "a", "k", "depth", *keys, F.struct(*_part(depth, F.lit(1), F.col("k"))).alias("x"), F.struct(*_part(depth, F.col("k") + 1, F.col("depth"))).alias("y"))
    part = known.select(F.struct(*keys).alias("key"), "f")
    both = left.join(part.select(F.col("key").alias("x"), F.col("f").alias("l")), "x").join(part.select(F.col("key").alias("y"), F.col("f").alias("r")), "y")
    lang = words.select(F.col("id").alias("w1"), "lang").join(totals, "lang").select("w1", "lang", F.col("total").alias("n"))
    scored = both.join(lang, "w1").withColumn(
        "score", F.expr("(cast(1000 as decimal(5,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    lowest = scored.groupBy("p", "lang", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    out = lowest.select("lang", "n", "a", "c.l", "c.r", "c.score", "p.*")
    names = words.select("id", "word")
    for k in keys:
        out = out.join(names.select(F.col("id").alias(k), F.col("word").alias(f"_{k}")), k, "left")
    out = out.withColumn("phrase", F.concat_ws(" ", *[f"_{k}" for k in keys]))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = out.withColumn("rank", rank)
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
