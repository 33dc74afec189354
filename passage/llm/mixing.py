"""Mixing sources to target weights by a multivariate-hypergeometric tree.

1. Sizes: the words of every document; one pass over the texts gives a small
   table of (key, source, size), the key being a hash of the row.
2. Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and
   share all words; a source is used at most ``MAX_PASSES`` times, the excess
   is shared again by weight.
3. Blocks: a source's documents are dealt to blocks by hash, and a keyed
   permutation orders the blocks. A pass takes every block; the last, partial
   pass takes the first blocks of the permutation, in the next block the first
   documents of a permutation, and then the documents that still fit. Words
   still missing are taken from the later blocks in the same way, until no
   remaining document fits; one may overshoot by less than is missing then.
4. Quotas: the block draws of all sources are split among the output shards
   by a binary tree; each node draws how many of its draws of each source go
   left from a multivariate hypergeometric distribution, so every shard's
   number of draws is fixed and every source's draws are dealt out exactly.
5. Draws: a source's draws, in permuted order, go to the shards by running
   quota, so shards hold disjoint blocks of a pass; each shard is shuffled
   locally by a hash.

All choices are functions of row hashes and a seed, so reruns agree.

Edge cases: a null text counts no words and is taken 0 words; a null source
is a source of its own, after all others; equal rows share one fate; sources
without words have target 0; an empty table gives no rows; other columns are
carried along untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passage.llm._common import SPACE, materialise, over_texts, slices, text_or_empty, utf8

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
SHARDS = 64
SEED = 20240607
#: Words a block holds on average, while a source has no more than MAX_BLOCKS; then blocks grow.
BLOCK_WORDS = 65_536
MAX_BLOCKS = 4096
#: Above every hash: a block is taken up to its last document.
WHOLE = 2 ** 63 - 1


def _count_words(col: pa.Array) -> np.ndarray:
    raw, off = utf8(col)
    if not len(raw):
        return np.zeros(len(off) - 1, np.int64)
    solid = ~SPACE[raw]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = off[1:-1][off[1:-1] < len(raw)]
    begin[inner] = solid[inner]
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(begin, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _add_size(name: str):
    def run(batches):
        for b in slices(batches, "_text"):
            size = pa.array(_count_words(b.column(b.schema.get_field_index("_text"))))
            cols = [b.column(i) for i, f in enumerate(b.schema.names) if f != "_text"]
            yield pa.RecordBatch.from_arrays([*cols, size], names=[f for f in b.schema.names if f != "_text"] + [name])
    return run


def row_key() -> Column:
    """A hash of what makes a row: id, source and text."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("source"), F.col("text"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, key and size of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), row_key().alias("key"),
                       text_or_empty().alias("_text"))
    return rows.mapInArrow(_add_size("size"), "doc_id long, source string, key long, size long")


def share(sizes: list[int]) -> list[float]:
    """Targets of sources in order: weights 5, 2, 1 share all words, none above MAX_PASSES times its size."""
    weight = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    target, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in sorted(open_) if left * weight[i] / total > MAX_PASSES * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weight[i] / total
            break
        for i in over:
            target[i] = float(MAX_PASSES * sizes[i])
        left -= sum(target[i] for i in over)
        open_ -= set(over)
    return target


@dataclass
class Source:
    name: str | None
    size: int
    target: float
    blocks: int
    full: int = 0          # whole passes
    rank: int = 0          # blocks of the partial pass taken whole
    upto: int | None = None  # in the next block: documents up to this hash
    extra: tuple[int, ...] = ()  # and these keys, of this block or a later one
    later: tuple[tuple[int, int | None], ...] = ()  # blocks after that, by rank, and up to which hash

    @property
    def draws(self) -> int:
        return self.full * self.blocks + self.rank + (1 if self.upto is not None or self.extra or self.later else 0) + len(self.later)


def block_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("key", F.lit(SEED)), blocks)


def rank_of(blocks: Column, source: Column) -> Column:
    """A keyed permutation of 0 .. blocks-1: an affine map of the block number by an odd step coprime to ``blocks``
    (blocks is a power of two)."""
    h = F.xxhash64(source, F.lit(SEED + 1))
    step = F.pmod(h, blocks) * 2 + 1
    shift = F.pmod(F.shiftright(h, 20), blocks)
    return F.pmod(F.col("block") * step + shift, blocks)


def _order() -> Column:
    return F.xxhash64("key", F.lit(SEED + 2))


def _blocks(size: int) -> int:
    """A power of two near size / BLOCK_WORDS."""
    n = 1
    while n < MAX_BLOCKS and n * BLOCK_WORDS < size:
        n *= 2
    return n


def _boundary(rooms: dict):
    """Documents of a source's partly taken block: by hash as long as they fit, then the largest that still fit;
    their words, and the smallest of the others."""
    def run(table: pa.Table) -> pa.Table:
        name = table.column("source")[0].as_py()
        key, order, size = (np.asarray(table.column(c)) for c in ("key", "order", "size"))
        by = np.lexsort((key, order))
        key, order, size = key[by], order[by], size[by]
        room = rooms[name]
        fit = int(np.searchsorted(np.cumsum(size), room, side="right"))
        if fit < len(key):  # rows with one hash stay together
            while fit and order[fit - 1] == order[fit]:
                fit -= 1
        room -= int(size[:fit].sum())
        extra: list[int] = []
        rest: tuple = (None, None)
        if fit < len(key):
            keys, back = np.unique(key[fit:], return_inverse=True)
            weight = np.bincount(back, size[fit:])
            for i in np.lexsort((keys, -weight)).tolist():
                if 0 < weight[i] <= room:
                    extra.append(int(keys[i]))
                    room -= int(weight[i])
            taken = set(extra)
            rest = min(((int(weight[i]), int(keys[i])) for i in range(len(keys)) if weight[i] > 0 and int(keys[i]) not in taken), default=rest)
        upto = int(order[fit - 1]) if fit else None
        return pa.table({"source": pa.array([name], pa.string()), "upto": pa.array([upto], pa.int64()), "extra": pa.array([extra], pa.list_(pa.int64())),
                         "room": pa.array([room], pa.int64()), "weight": pa.array([rest[0]], pa.int64()), "key": pa.array([rest[1]], pa.int64())})
    return run


def _next_blocks(state: dict):
    """Of a source's blocks from a rank on: those that fit whole, in order, and the first that may hold a document that fits."""
    def run(table: pa.Table) -> pa.Table:
        name = table.column("source")[0].as_py()
        start, room = state[name]
        rank, words, least = (np.asarray(table.column(c)) for c in ("rank", "words", "least"))
        whole, at = [], None
        for i in np.argsort(rank):
            if rank[i] < start or not words[i]:
                continue
            if words[i] <= room:
                whole.append(int(rank[i]))
                room -= int(words[i])
            elif least[i] <= room:
                at = int(rank[i])
                break
        return pa.table({"source": pa.array([name], pa.string()), "whole": pa.array([whole], pa.list_(pa.int64())),
                         "room": pa.array([room], pa.int64()), "at": pa.array([at], pa.int64())})
    return run


def _table(spark, **columns) -> DataFrame:
    """A small table of the source catalogue, whose size Spark knows."""
    schema = pa.schema([(k, t) for k, (t, _) in columns.items()])
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(v, t) for t, v in columns.values()], schema=schema))


def plan_sources(rows: DataFrame) -> list[Source]:
    """What is taken of each source. The driver holds one row a source (the mixture's own catalogue)."""
    found = {r.source: int(r.size) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    names = sorted((n for n in found if n is not None)) + ([None] if None in found else [])
    sources = [Source(n, found[n], t, _blocks(found[n])) for n, t in zip(names, share([found[n] for n in names]))]
    if not sources:
        return []
    spark = rows.sparkSession
    part = {}
    for s in sources:
        if s.size:
            s.full = min(MAX_PASSES, int(s.target // s.size))
            part[s.name] = s.target - s.full * s.size if s.full < MAX_PASSES else 0.0
    catalogue = _table(spark, source=(pa.string(), [s.name for s in sources]), blocks=(pa.int64(), [s.blocks for s in sources]),
                       part=(pa.float64(), [part.get(s.name, 0.0) for s in sources]))
    placed = (rows.join(catalogue, rows.source.eqNullSafe(catalogue.source)).select(rows.source, "key", "size", "blocks", "part")
              .where("part >= 1").withColumn("block", block_of(F.col("blocks"))).withColumn("rank", rank_of(F.col("blocks"), F.col("source"))))
    least = F.coalesce(F.min(F.when(F.col("size") > 0, F.col("size"))), F.lit(0).cast("long"))
    by_rank = materialise(placed.groupBy("source", "rank", "part").agg(F.sum("size").alias("words"), least.alias("least")), "blocks")
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("rank"))  # at most MAX_BLOCKS rows a source
    cut = by_rank.withColumn("upto", upto).where("upto <= part").groupBy("source").agg(F.max("rank").alias("last"), F.max("upto").alias("words"))
    whole = {r.source: (int(r["last"]) + 1, int(r.words)) for r in cut.collect()}
    rooms = {}
    for s in sources:
        if part.get(s.name, 0) >= 1:
            s.rank, words = whole.get(s.name, (0, 0))
            rooms[s.name] = int(round(part[s.name])) - words
    # blocks without documents have no row: the next block is the first one that has
    open_ = [s for s in sources if rooms.get(s.name, 0) > 0]
    after = _table(spark, source=(pa.string(), [s.name for s in open_]), after=(pa.int64(), [s.rank for s in open_]))
    if rooms:
        nxt = by_rank.join(after, by_rank.source.eqNullSafe(after.source)).where("rank >= after").groupBy(by_rank.source).agg(F.min("rank").alias("rank"))
        nxt = {r.source: int(r["rank"]) for r in nxt.collect()}
        for s in sources:
            s.rank = nxt.get(s.name, s.rank)
        _fill(spark, sources, placed, by_rank, rooms, nxt)
    return sources


def _fill(spark, sources: list[Source], placed: DataFrame, by_rank: DataFrame, rooms: dict, at: dict) -> None:
    """Takes documents of the blocks ``at`` and of later ones until none fits the words missing, all sources at once."""
    by_name = {s.name: s for s in sources}
    room = {n: rooms[n] for n in at}
    rest: dict = {}       # the smallest document left in the blocks looked through
    later: dict = {n: [] for n in at}
    first = True
    while at:
        edge = _table(spark, s=(pa.string(), list(at)), r=(pa.int64(), list(at.values())))
        docs = (placed.join(edge, placed.source.eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r")))
                .select("source", "key", "size", _order().alias("order")))
        schema = "source string, upto long, extra array<long>, room long, weight long, key long"
        for r in docs.groupBy("source").applyInArrow(_boundary(room), schema).collect():
            s = by_name[r.source]
            room[s.name] = r.room
            if first:
                s.upto = r.upto
            elif r.upto is not None or r.extra:
                later[s.name].append((at[s.name], r.upto))
            s.extra += tuple(r.extra)
            if r.key is not None and (s.name not in rest or (r.weight, r.key) < rest[s.name][:2]):
                rest[s.name] = (r.weight, r.key, at[s.name])
        first = False
        state = {n: (rank + 1, room[n]) for n, rank in at.items() if room[n] > 0}
        if not state:
            break
        names = _table(spark, s=(pa.string(), list(state)))
        left = by_rank.join(names, by_rank.source.eqNullSafe(F.col("s"))).select("source", "rank", "words", "least")
        at = {}
        for r in left.groupBy("source").applyInArrow(_next_blocks(state), "source string, whole array<long>, room long, at long").collect():
            later[r.source] += [(rank, WHOLE) for rank in r.whole]
            room[r.source] = r.room
            if r["at"] is not None:
                at[r.source] = r["at"]
    for n, (weight, key, rank) in rest.items():  # overshoot by less than what is missing
        if room[n] > 0 and weight - room[n] < room[n]:
            by_name[n].extra += (key,)
            if rank != by_name[n].rank and rank not in dict(later[n]):
                later[n].append((rank, None))
    for n, blocks in later.items():
        by_name[n].later = tuple(sorted(blocks, key=lambda x: x[0]))


def _shard_quotas(draws: list[int], shards: int, seed: int):
    """Draws of each source that a shard gets: its path down the splitting tree."""
    def run(batches):
        for b in batches:
            out = []
            for shard in b.column("shard").to_pylist():
                lo, hi, have = 0, shards, np.array(draws, np.int64)
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    total = int(have.sum())
                    # the shards of a node get equal numbers of draws, the first ones one more
                    left = total * (mid - lo) // (hi - lo)
                    rng = np.random.default_rng([seed, lo, hi])
                    go = rng.multivariate_hypergeometric(have, left, method="marginals") if total else have
                    (have, hi) = (go, mid) if shard < mid else (have - go, hi)
                    lo = lo if shard < mid else mid
                out.append(have.tolist())
            yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(out, pa.list_(pa.int64()))], names=["shard", "quota"])
    return run


def quotas(spark, sources: list[Source], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """source (its number), and the running quota of the shards: shard k gets draws ends[k-1] .. ends[k]-1."""
    by_shard = spark.range(shards).select(F.col("id").alias("shard")).mapInArrow(
        _shard_quotas([s.draws for s in sources], shards, seed), "shard long, quota array<long>")
    flat = by_shard.select("shard", F.posexplode("quota").alias("nr", "n"))
    ends = flat.withColumn("end", F.sum("n").over(Window.partitionBy("nr").orderBy("shard")))
    return ends.groupBy("nr").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))


def draw(rows: DataFrame, sources: list[Source], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` (with source, key and size, any others kept) plus source_size, target and ``shards``: the shard of each copy taken."""
    spark = rows.sparkSession
    ends = {r.nr: r.ends for r in quotas(spark, sources, shards, seed).collect()} if sources else {}  # sources * shards numbers
    plan = _table(spark, s_name=(pa.string(), [s.name for s in sources]), source_size=(pa.int64(), [s.size for s in sources]),
                  target=(pa.float64(), [s.target for s in sources]), blocks=(pa.int64(), [s.blocks for s in sources]),
                  full=(pa.int64(), [s.full for s in sources]), whole=(pa.int64(), [s.rank for s in sources]),
                  upto=(pa.int64(), [s.upto for s in sources]), extra=(pa.list_(pa.int64()), [list(s.extra) for s in sources]),
                  later=(pa.list_(pa.int64()), [[r for r, _ in s.later] for s in sources]),
                  later_upto=(pa.list_(pa.int64()), [[u for _, u in s.later] for s in sources]),
                  ends=(pa.list_(pa.int64()), [ends.get(i) for i in range(len(sources))]))
    keep = rows.columns
    r = rows.join(plan, rows.source.eqNullSafe(F.col("s_name"))).withColumn("block", block_of(F.col("blocks")))
    r = r.withColumn("rank", rank_of(F.col("blocks"), F.col("source")))
    nr = F.array_position("later", F.col("rank"))  # from 1, 0 for none
    upto = F.when(F.col("rank") == F.col("whole"), F.col("upto")).when(nr > 0, F.get("later_upto", (nr - 1).cast("int")))
    in_edge = (F.col("rank") >= F.col("whole")) & (F.coalesce(_order() <= upto, F.lit(False)) | F.array_contains("extra", F.col("key")))
    passes = F.col("full") + ((F.col("rank") < F.col("whole")) | in_edge).cast("long")
    # later blocks follow the edge in the partial pass
    slot = F.when(nr > 0, F.col("whole") + nr).otherwise(F.col("rank"))
    # copy c of a block is draw c * blocks + rank (of the partial pass: slot) of its source
    copies = F.when((F.col("size") > 0) & (passes > 0), F.sequence(F.lit(0).cast("long"), passes - 1)).otherwise(F.array().cast("array<long>"))
    shard = F.transform(copies, lambda c: F.size(F.filter("ends", lambda e: e <= c * F.col("blocks") + F.when(c == F.col("full"), slot).otherwise(F.col("rank")))))
    return r.select(*keep, "source_size", "target", shard.alias("shards"))


def mix_plan(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and the shards of the copies, of every document."""
    rows = materialise(sized(docs), "sizes")
    drawn = draw(rows, plan_sources(rows), shards, seed)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mixed(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, shard_column: str | None = None) -> DataFrame:
    """The mix itself: every row as often as it is taken, each shard in shuffled order; ``shard_column`` adds the shard's number."""
    sources = plan_sources(materialise(sized(docs), "sizes"))
    words = F.arrow_udf(over_texts(lambda col: pa.array(_count_words(col)), pa.int64()), "long")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").cast("string").alias("source"), row_key().alias("key"), words(text_or_empty()).alias("size"))
    out = draw(rows, sources, shards, seed).select("_row", "key", F.posexplode("shards").alias("_copy", "_shard"))
    # a hash in front of a shard's number splits a large shard; within it rows follow another hash
    out = out.repartition("_shard", F.pmod(F.xxhash64("key", F.lit(seed + 3)), F.lit(16))).sortWithinPartitions("_shard", F.xxhash64("key", "_copy", F.lit(seed + 4)))
    return out.select("_row.*", *([F.col("_shard").alias(shard_column)] if shard_column else []))
