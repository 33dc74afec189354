"""Near duplicates by BagMinHash signatures and verified multiset overlap.

1. A text is the multiset of its five-word shingles (a shorter text is one
   shingle; words are runs between white space, ASCII letters lower-cased).
   Texts with equal word sequences form a class; classes are compared.
2. BagMinHash: the integer weight axis of a shingle is cut at 1, 2, 4, 8, ...
   Each block holds a Poisson process whose rate is the block's length; a
   point has a time, a signature position and a level inside the block, found
   by halving. A text with count w sees the points of level at most w. A
   position's value is its earliest point, so two texts agree at a position
   with the probability of their weighted Jaccard similarity. Points are drawn
   up to a time at which all positions are surely taken, and on if not.
3. Bands of ROWS positions give bucket keys: at similarity 0.8 a pair shares
   one of BANDS buckets except for about 6 pairs in 100,000.
4. No bucket is expanded into pairs: its most central class (whose buckets
   hold most classes) is its hub. Members are compared with the hubs of their
   buckets and with the hubs of those hubs, and links make components. Then
   rounds follow: of the members outside the largest component of a bucket the
   most central ones (64, then 512, ... a bucket) are compared with every
   member of another component and retire from the bucket. Pairs are left out
   only by an upper bound of their overlap. Rounds end when no
   bucket holds two components, so every pair of a bucket was compared or is
   in one component.
5. A candidate whose signatures agree on under SCREEN of the positions is
   dropped (seven standard deviations below 0.8); the others are verified on
   the full multisets. Links make components by minimum labels with pointer
   jumping; the smallest id of a component names it and stays.

Edge cases: texts without words are never duplicates of anything; a null id
sorts last; of equal rows one stays; an empty table gives no rows; other
columns are carried along untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passage.llm._common import (BASES, LOWER, arrow_rows, bloom_filter, in_bloom, materialise, mix64, over_texts, slices, text_or_empty,
                                 utf8, word_bounds, word_hashes)

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
POSITIONS = BANDS * ROWS
SCREEN = 0.6
#: Hubs a bucket gives in the first round, their growth from round to round, and parts in which a bucket meets them.
FIRST_HUBS = 64
MORE_HUBS = 8
SALT = 16
#: Groups of shingles, by hash, whose counts bound the overlap of two texts.
GROUPS = 64
SLICE = 1 << 20
#: Pairs in an Arrow batch that carries both multisets.
PAIR_ROWS = 64


def shingles(raw: np.ndarray, off: np.ndarray):
    """Distinct shingles of each row: row, hash, count; the words of each row; two hashes of each row's word sequence."""
    rows = len(off) - 1
    low = LOWER[raw]
    starts, ends, bounds = word_bounds(low, off)
    words = np.diff(bounds)
    wh = word_hashes(low, starts, ends)
    n = len(wh)
    ident = []
    with np.errstate(over="ignore"):
        place = np.arange(n) - np.repeat(bounds[:-1], words)
        for j in (0, 1):  # order-dependent sums over all words of a row
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(mix64(wh + mix64(place.astype(np.uint64) + np.uint64(j << 40))), out=total[1:])
            ident.append(mix64(total[bounds[1:]] - total[bounds[:-1]] + words.astype(np.uint64)))
        h = np.zeros(n, np.uint64)
        size = np.minimum(WORDS, np.maximum(words, 1))
        take = np.repeat(size, words)
        for j in range(WORDS):
            nxt = np.zeros(n, np.uint64)
            nxt[:max(n - j, 0)] = wh[j:]
            h = np.where(j < take, h * np.uint64(BASES[0]) + nxt, h)
    row = np.repeat(np.arange(rows), words)
    ok = place <= np.repeat(words - size, words)
    h, row = mix64(h[ok]), row[ok]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h))), words, ident


def signatures(row: np.ndarray, item: np.ndarray, weight: np.ndarray, rows: int, m: int = POSITIONS) -> np.ndarray:
    """BagMinHash signatures (rows x m, 32-bit) of weighted sets given as (row, item, weight >= 1)."""
    sig = np.zeros((rows, m), np.uint32)
    if not len(row):
        return sig
    mass = np.bincount(row, weight, rows)
    limit = np.where(mass > 0, (np.log(m) + 6) / np.maximum(mass, 1), 0.0)  # per unit of rate
    todo = np.flatnonzero(mass > 0)
    while len(todo):
        mine = np.isin(row, todo)
        times = np.full(rows * m, np.inf)
        winner = np.zeros(rows * m, np.uint32)
        blocks = 1 + np.ceil(np.log2(np.maximum(weight[mine], 1))).astype(np.int64)   # (0,1], (1,2], (2,4], ...
        r, d, w = (np.repeat(x[mine], blocks) for x in (row, item, weight))
        block = np.arange(len(r)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        rate = np.where(block == 0, 1, 1 << np.maximum(block - 1, 0)).astype(np.float64)
        low = np.where(block == 0, 0, rate)          # levels low+1 .. low+rate
        seed = mix64(d ^ mix64(block.astype(np.uint64) + np.uint64(99)))
        until = limit[r]
        now, count = np.zeros(len(r)), np.zeros(len(r), np.int64)
        step = np.maximum(1, (m * rate * until / 4).astype(np.int64))
        while len(r):
            e = np.repeat(np.arange(len(r)), step)
            first = np.cumsum(step) - step
            k = np.arange(len(e)) - np.repeat(first, step) + count[e]
            bits = mix64(seed[e] + mix64(k.astype(np.uint64)))
            gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2 ** 53) / (m * rate[e])
            t = np.cumsum(gap)
            t = t - np.repeat(t[first] - gap[first], step) + now[e]
            more = mix64(bits ^ np.uint64(0x5851F42D4C957F2D))
            position = ((more >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            level = low[e] + 1 + np.floor((more & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2 ** 32 * rate[e])
            seen = np.flatnonzero((t <= until[e]) & (level <= w[e]))
            key = r[e[seen]] * m + position[seen]
            np.minimum.at(times, key, t[seen])
            best = t[seen] == times[key]
            winner[key[best]] = mix64(bits[seen[best]] + np.uint64(1)).astype(np.uint32)
            last = t[first + step - 1]
            go = last <= until
            now, count = last[go], (count + step)[go]
            r, w, seed, until, rate, low, step = r[go], w[go], seed[go], until[go], rate[go], low[go], step[go]
        times, winner = times.reshape(rows, m), winner.reshape(rows, m)
        done = todo[np.isfinite(times[todo]).all(1)]
        sig[done] = winner[done]
        todo = np.setdiff1d(todo, done)
        limit[todo] *= 2
    return sig


def _node(ident) -> list[bytes]:
    both = np.stack([ident[0], ident[1]], 1).astype(">u8").tobytes()
    return [both[i:i + 16] for i in range(0, len(both), 16)]


def _sketch(batches):
    for b in slices(batches, limit=SLICE):
        raw, off = utf8(b.column("text"))
        row, item, weight, words, ident = shingles(raw, off)
        sig = signatures(row, item, weight, b.num_rows)
        flat = sig.tobytes()
        size = POSITIONS * 4
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id"), pa.array([n if w else None for n, w in zip(_node(ident), words)], pa.binary()), pa.array(words),
            pa.array([flat[i * size:(i + 1) * size] for i in range(b.num_rows)], pa.binary()),
        ], names=["doc_id", "node", "words", "sig"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node (hash of the word sequence; null without words), words and signature of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_sketch, "doc_id long, node binary, words long, sig binary")


def _bands(batches):
    for b in batches:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
        h = np.zeros(sig.shape[:2], np.uint64)
        with np.errstate(over="ignore"):
            for j in range(ROWS):
                h = mix64(h * np.uint64(BASES[1]) + sig[:, :, j])
            h = mix64(h + np.arange(BANDS, dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(np.repeat(np.arange(len(sig)), BANDS))), pa.array(h.ravel().astype(np.int64))], names=["node", "bucket"])


def _screen(batches):
    """Pairs whose signatures agree often enough."""
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, POSITIONS) for c in ("x_sig", "y_sig"))
            keep = pa.array((x == y).mean(1) >= SCREEN)
            yield pa.RecordBatch.from_arrays([b.column("x").filter(keep), b.column("y").filter(keep)], names=["x", "y"])


def _payloads(bloom):
    """node and its multiset (sorted 64-bit shingles, then 32-bit counts) of the texts the filter holds."""
    def run(batches):
        for b in slices(batches, limit=SLICE):
            raw, off = utf8(b.column("text"))
            row, item, weight, words, ident = shingles(raw, off)
            want = in_bloom(bloom.value, ident[0]) & (words > 0)
            bounds = np.searchsorted(row, np.arange(b.num_rows + 1))
            nodes = _node(ident)
            pick = np.flatnonzero(want).tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array([nodes[i] for i in pick], pa.binary()),
                pa.array([item[bounds[i]:bounds[i + 1]].tobytes() + weight[bounds[i]:bounds[i + 1]].astype(np.uint32).tobytes() for i in pick], pa.binary()),
            ], names=["node", "bag"])
    return run


def _bag(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n)


def similarity(x: bytes, y: bytes) -> float:
    """Weighted Jaccard similarity of two multisets."""
    (a, m), (b, n) = _bag(x), _bag(y)
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = int(np.minimum(m[i], n[j]).sum())
    return common / max(int(m.sum()) + int(n.sum()) - common, 1)


def _verify(threshold: float):
    def run(batches):
        for b in batches:
            s = np.array([similarity(x, y) for x, y in zip(b.column("x_bag").to_pylist(), b.column("y_bag").to_pylist())])
            keep = pa.array(s >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("x").filter(keep), b.column("y").filter(keep)], names=["x", "y"])
    return run


def _prefix(c: str):
    """The first 64 bits of a node as an integer: the key of its filter."""
    return F.conv(F.hex(F.substring(c, 1, 8)), 16, -10).cast("long").alias("key")


def _node_filter(nodes: DataFrame):
    """A broadcast filter, of bounded size, that holds the ``nodes``; they may repeat."""
    distinct = nodes.agg(F.approx_count_distinct("node")).first()[0]
    return nodes.sparkSession.sparkContext.broadcast(bloom_filter(nodes.select(_prefix("node")), distinct))


def bags_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node and bag (its multiset of shingles) of the ``nodes``, which may repeat: a written table."""
    # copies of a text give equal rows: one is kept, and rows the filter let through by chance meet no pair
    return materialise(texts.mapInArrow(_payloads(_node_filter(nodes)), "node binary, bag binary").groupBy("node").agg(F.first("bag").alias("bag")), "bags")


def _wanted(bloom):
    def run(batches):
        for b in batches:
            if b.num_rows:
                key = np.frombuffer(b"".join(x[:8] for x in b.column("node").to_pylist()), ">u8").astype(np.uint64)
                yield b.filter(pa.array(in_bloom(bloom.value, key)))
    return run


def _links(pairs: DataFrame, reps: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (x, y) of nodes whose texts are similar enough: a written table."""
    spark = pairs.sparkSession
    sig = reps.select("node", "sig")
    x = sig.select(F.col("node").alias("x"), F.col("sig").alias("x_sig"))
    y = sig.select(F.col("node").alias("y"), F.col("sig").alias("y_sig"))
    near = materialise(pairs.join(x, "x").join(y, "y").select("x", "y", "x_sig", "y_sig").mapInArrow(_screen, "x binary, y binary"), "pairs")
    if not near.limit(1).count():
        return near
    bloom = _node_filter(near.select(F.col("x").alias("node")).union(near.select(F.col("y").alias("node"))))
    with arrow_rows(spark, PAIR_ROWS):
        # written: a task then never holds two Python workers, one that reads the bags and one that compares them
        mine = materialise(bags.mapInArrow(_wanted(bloom), "node binary, bag binary"), "wanted")
        xb = mine.select(F.col("node").alias("x"), F.col("bag").alias("x_bag"))
        yb = mine.select(F.col("node").alias("y"), F.col("bag").alias("y_bag"))
        return materialise(near.join(xb, "x").join(yb, "y").select("x", "y", "x_bag", "y_bag").mapInArrow(_verify(threshold), "x binary, y binary"), "links")


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) of all nodes with links."""
    rows = 2 * links.count()
    edges = materialise(links.select(F.col("x").alias("a"), F.col("y").alias("b")).union(links.select(F.col("y").alias("a"), F.col("x").alias("b"))), "edges", rows)
    labels = materialise(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels", rows)
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        # pointer jumping: the label's own label
        up = labels.select(F.col("node").alias("l"), F.col("label").alias("further"))
        new = materialise(low.join(up, F.col("label") == F.col("l"), "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels", rows)
        moved = new.where(F.col("old") != F.col("label")).limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def _shared(buckets: DataFrame) -> DataFrame:
    """The rows of buckets with several members, and each member's score: how many members its buckets hold."""
    size = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = buckets.join(size, "bucket")
    score = rows.groupBy("node").agg(F.sum("n").alias("score"))
    return materialise(rows.join(score, "node").select("bucket", "node", "score"), "members")


def _tops(shared: DataFrame, rows: int) -> DataFrame:
    """bucket, hub and hub_score: the most central member of each bucket, a written table; ``shared`` has ``rows`` rows."""
    top = shared.groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("top"))
    return materialise(top.select("bucket", F.col("top.node").alias("hub"), F.col("top.score").alias("hub_score")), "tops", rows)


def _retire(members: DataFrame, hubs: DataFrame, rows: int) -> DataFrame:
    """The members (of ``rows`` rows) without the hubs (bucket, hub), of buckets that keep two or more."""
    left = members.join(hubs.select("bucket", F.col("hub").alias("node")), ["bucket", "node"], "left_anti")
    several = left.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return materialise(left.join(several, "bucket").select(*members.columns), "members", rows)


def _items(bloom):
    """node, shingle and count of every shingle of the bags whose nodes the filter holds."""
    keep = _wanted(bloom)

    def run(batches):
        for b in keep(batches):
            yield from _unpacked(b)
    return run


def _unpacked(b: pa.RecordBatch):
    for node, raw in zip(b.column("node").to_pylist(), b.column("bag").to_pylist()):
        item, count = _bag(raw)
        yield pa.RecordBatch.from_arrays([pa.array([node] * len(item), pa.binary()), pa.array(item.astype(np.int64)), pa.array(count.astype(np.int64))], names=["node", "item", "n"])


def _reach(members: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The members (bucket, node, score) with ``size``, the shingles of a text, and ``parts``: how many of them, in GROUPS
    groups by hash, another member has too. Two members overlap at most in the smaller numbers of each group. A text
    with too few shingles in common with all others is left out."""
    bloom = _node_filter(members.select("node"))
    with arrow_rows(members.sparkSession, PAIR_ROWS):
        items = materialise(bags.mapInArrow(_items(bloom), "node binary, item long, n long"), "items")
    group = F.pmod("item", F.lit(GROUPS)).cast("int").alias("g")
    several = items.groupBy("node", group).agg(F.sum("n").alias("n"))
    alone = items.groupBy("item").agg(F.count("*").alias("k"), F.min("node").alias("node"), F.sum("n").alias("n")).where("k = 1").groupBy("node", group).agg(F.sum("n").alias("own"))
    counts = several.join(alone, ["node", "g"], "left").select("node", "g", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))
    # at most GROUPS rows a node
    vector = counts.groupBy("node").agg(F.sum("n").alias("size"), F.sum("common").alias("common"), F.map_from_entries(F.collect_list(F.struct("g", "common"))).alias("m"))
    able = vector.where(F.col("common") >= threshold * F.col("size") - 1e-9).select(
        "node", "size", F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.coalesce(F.try_element_at("m", g), F.lit(0)).cast("int")).alias("parts"))
    return materialise(members.join(able, "node").select("bucket", "node", "score", "size", "parts"), "reach")


def _apart(members: DataFrame, labels: DataFrame, hubs: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of the members outside the largest component of their bucket the ``hubs`` most central ones of each
    bucket (bucket, hub), and their pairs (x, y) with the bucket's members of other components that can reach the threshold."""
    rows = members.count()
    placed = materialise(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("bucket", "node", "score", "size", "parts", "label"), "placed", rows)
    parts = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("k")).where("k > 1").select("bucket", F.col("m.label").alias("main"))
    rest = placed.join(main, "bucket").where("label != main")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("score"), "node"))
    mine = materialise(rest.withColumn("rank", rank).where(F.col("rank") <= hubs).select(
        "bucket", F.col("node").alias("hub"), F.col("label").alias("hub_label"), F.col("size").alias("hub_size"), F.col("parts").alias("hub_parts")), "hubs", rows)
    # a large bucket meets its hubs in parts
    spread = mine.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    other = placed.select("bucket", "node", "label", "size", "parts", F.pmod(F.hash("node"), F.lit(SALT)).alias("salt"))
    overlap = F.aggregate(F.zip_with("parts", "hub_parts", lambda p, q: F.least(p, q)), F.lit(0), lambda total, n: total + n)
    able = overlap * (1 + threshold) >= threshold * (F.col("size") + F.col("hub_size")) - 1e-6
    pairs = spread.join(other, ["bucket", "salt"]).where((F.col("label") != F.col("hub_label")) & able)
    return mine, pairs.select(F.least("hub", "node").alias("x"), F.greatest("hub", "node").alias("y")).distinct()


def find_clusters(sketch: DataFrame, docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """node and label of all classes that have a near duplicate; ``sketch`` is a written table of ``sketches(docs)``."""
    reps = materialise(sketch.where("node is not null").groupBy("node").agg(F.first("sig").alias("sig")), "reps")
    members = _shared(reps.select("node", "sig").mapInArrow(_bands, "node binary, bucket long"))
    rows = members.count()
    bags = bags_of(members.select("node"), docs.select(text_or_empty().alias("text")))
    tops = _tops(members, rows)
    hubs = materialise(members.select("bucket", "node").join(tops, "bucket").where("node != hub").groupBy("node", "hub").agg(F.max("hub_score").alias("hub_score")), "hubs", rows)
    best = materialise(hubs.groupBy("node").agg(F.max(F.struct("hub_score", "hub")).alias("b")).select(F.col("node").alias("h"), F.col("b.hub").alias("next")), "best", rows)
    pairs = hubs.select(F.col("node").alias("x"), F.col("hub").alias("y"))
    for _ in range(2):  # hubs of hubs: members of a family meet its centre
        further = pairs.join(best, F.col("y") == F.col("h")).where("x != next").select("x", F.col("next").alias("y"))
        pairs = pairs.union(further).distinct()
    tried = materialise(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    links = _links(tried, reps, bags, threshold)
    labels = components(links)
    members, more = _reach(_retire(members, tops, rows), bags, threshold), FIRST_HUBS
    while True:
        mine, pairs = _apart(members, labels, more, threshold)
        if not mine.limit(1).count():
            return labels
        new = materialise(pairs.join(tried, ["x", "y"], "left_anti"), "pairs")
        found = _links(new, reps, bags, threshold)
        if found.limit(1).count():
            links = materialise(links.union(found), "links")
            labels = components(links)
        tried = materialise(tried.select("x", "y").union(new.select("x", "y")), "tried")
        members, more = _retire(members, mine, rows), more * MORE_HUBS


def clusters(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest id of the texts with its words), cluster_id (smallest id of its component) of every document."""
    sketch = materialise(sketches(docs), "sketch")
    labels = find_clusters(sketch, docs, threshold)
    classes = sketch.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("class_id"))
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = named.groupBy("label").agg(F.min("class_id").alias("cluster_id"))
    named = materialise(named.join(first, "label").select(F.col("node").alias("n"), "class_id", "cluster_id"), "named")
    return sketch.select("doc_id", "node").join(named, F.col("node") == F.col("n"), "left").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("cluster_id")).alias("cluster_id"))


def _nodes(col: pa.Array) -> pa.Array:
    raw, off = utf8(col)
    *_, words, ident = shingles(raw, off)
    return pa.array([n if w else None for n, w in zip(_node(ident), words)], pa.binary())


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each component, all columns as they were: the row with the smallest id."""
    sketch = materialise(sketches(docs), "sketch")
    labels = find_clusters(sketch, docs, threshold)
    classes = sketch.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    last = F.coalesce("first", F.lit(np.iinfo(np.int64).max))
    keepers = named.groupBy("label").agg(F.min(F.struct(last.alias("id"), "node", "first")).alias("k")).select(F.col("k.node").alias("_n"), F.col("k.first").alias("_first"))
    # the row travels as one value, so its columns' names can't clash with those added here
    node = F.arrow_udf(over_texts(_nodes, pa.binary(), SLICE), "binary")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), node(text_or_empty()).alias("node"))
    mine = rows.where("node is not null").join(keepers, (F.col("node") == F.col("_n")) & F.col("id").eqNullSafe(F.col("_first")))
    # rows repeated with their id: the first in the order of the join's partition
    place = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    one = mine.withColumn("place", place).where("place = 1").select("row.*")
    return one.union(rows.where("node is null").select("row.*"))
