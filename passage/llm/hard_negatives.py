"""Hard negatives by segment summaries.

1. Vectors become integers. A vector is cut into segments (LEVELS: first few
   long ones, then more and shorter ones); each segment's mean and deviation
   are stored beside the vector. Over a segment of n components the product of
   two vectors is n * (mean * mean' +- at most dev * dev'), so the summaries
   bound every score from both sides.
2. Anchors are taken in parts of at most ``part_rows`` rows, which are
   broadcast; every task streams over its share of the stored vectors once a
   part. A row and an anchor go from level to level while their bounds allow a
   wanted score, and only those left get the exact integer product. Wanted is
   what may still enter the task's best rows of the anchor, whose worst score
   rises as the task goes on.
3. The first pass finds each anchor's positives, the second one the negatives
   in the score windows of its positives. The tasks' best rows meet by anchor
   (and positive): at most k a task, so no group grows with the table.

A large or repeated group of vectors or labels is spread over the tasks like
any other, and nothing is sampled: results are exact.

Edge cases: rows whose id, label or vector is null, or whose vector holds a
null or a non-finite component, take no part; a shorter vector counts as
padded with zeros; a row is never its own positive, but another row with its
id may be; repeated ids and rows count once each; ties go to the smaller id;
an anchor without positives, a positive with a negative score (its window is
empty) and an empty table give no rows; other columns are not read.
Components must lie within 2**31 in size, so that products fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passage.llm._common import materialise

SCALE = 256
#: Segments of a vector, from the first bounds to the last.
LEVELS = (4, 16)
POSITIVES, NEGATIVES = 5, 10
#: Negatives score from LOW to HIGH percent of the positive's score.
LOW, HIGH = 30, 90
#: Anchors broadcast at once, and those scored together against a batch.
PART_ROWS = 16_384
BLOCK = 512
#: Share of pairs above which a level is done as one matrix product.
DENSE = 0.05

_OUT = "anchor long, target long, score long, id long, uid long"
_NONE = np.iinfo(np.int64).min


def _parse(scale: int):
    def run(batches):
        for b in batches:
            keep, vecs = [], []
            for i, v in enumerate(b.column("vec")):
                a = v.values
                if a is None or a.null_count:
                    continue
                x = np.floor(scale * np.asarray(a, np.float64))
                if np.isfinite(x).all():
                    keep.append(i)
                    vecs.append(x.astype("<i8").tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("uid", "id", "label")] + [pa.array(vecs, pa.binary())], names=["uid", "id", "label", "vec"])
    return run


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """The vectors of a column as rows of integers, padded with zeros."""
    out = np.zeros((len(col), width), np.int64)
    for i, v in enumerate(col.to_pylist()):
        x = np.frombuffer(v, "<i8")
        out[i, :len(x)] = x
    return out


def borders(width: int, parts: int) -> np.ndarray:
    return np.unique(np.linspace(0, width, min(parts, width) + 1).astype(np.int64))


def summary(x: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of each row."""
    n = np.diff(cut)
    x = x.astype(np.float64)
    mean = np.add.reduceat(x, cut[:-1], axis=1) / n
    off = x - np.repeat(mean, n, axis=1)
    return mean, np.sqrt(np.add.reduceat(off * off, cut[:-1], axis=1) / n)


def _summarise(width: int, levels: tuple):
    def run(batches):
        for b in batches:
            x = matrix(b.column("vec"), width)
            cols = [b.column(c) for c in ("uid", "id", "label")] + [pa.array([r.tobytes() for r in x], pa.binary())]
            names = ["uid", "id", "label", "vec"]
            for k, parts in enumerate(levels):
                for what, m in zip(("mean", "dev"), summary(x, borders(width, parts))):
                    cols.append(pa.array([r.tobytes() for r in m], pa.binary()))
                    names.append(f"{what}{k}")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


class Rows:
    """A block of vectors with its stored summaries."""

    def __init__(self, batch, width: int, levels: tuple):
        load = lambda c, t: np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(batch.num_rows, -1)
        self.uid, self.id, self.label = (np.asarray(batch.column(c)) for c in ("uid", "id", "label"))
        self.x = load("vec", "<i8")
        self.size = np.diff(borders(width, levels[0])), *(np.diff(borders(width, p)) for p in levels[1:])
        self.levels = [(load(f"mean{k}", "<f8"), load(f"dev{k}", "<f8")) for k in range(len(levels))]
        self.norm = np.sqrt((self.x.astype(np.float64) ** 2).sum(1))
        self.top = float(np.abs(self.x).max(initial=0))

    def part(self, a: int, b: int) -> "Rows":
        out = object.__new__(Rows)
        out.uid, out.id, out.label, out.x, out.norm = (v[a:b] for v in (self.uid, self.id, self.label, self.x, self.norm))
        out.size, out.top = self.size, self.top
        out.levels = [(m[a:b], d[a:b]) for m, d in self.levels]
        return out


def scored_pairs(q: Rows, r: Rows, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and exact score of all allowed pairs whose score lies in the query's low..high;
    the bounds of one level after the other leave out pairs before the product is taken."""
    pairs = None  # while None, ``allowed`` holds the pairs left
    for k, n in enumerate(r.size):
        (qm, qd), (rm, rd) = q.levels[k], r.levels[k]
        if pairs is None:
            mid, reach = (qm * n) @ rm.T, (qd * n) @ rd.T
            reach += 1e-9 * q.norm[:, None] * r.norm + 0.25  # rounding never loses a pair
            allowed = allowed & (mid + reach >= low[:, None]) & (mid - reach <= high[:, None])
            if allowed.mean() < DENSE:
                pairs = np.nonzero(allowed)
        else:
            i, j = pairs
            mid = np.einsum("ps,ps->p", qm[i] * n, rm[j])
            reach = np.einsum("ps,ps->p", qd[i] * n, rd[j]) + 1e-9 * q.norm[i] * r.norm[j] + 0.25
            ok = (mid + reach >= low[i]) & (mid - reach <= high[i])
            pairs = i[ok], j[ok]
    small = q.top * r.top * q.x.shape[1] < 2 ** 53  # then double precision is exact
    if pairs is None:
        score = (q.x.astype(np.float64) @ r.x.T.astype(np.float64)).astype(np.int64) if small else q.x @ r.x.T
        i, j = np.nonzero(allowed & (score >= low[:, None]) & (score <= high[:, None]))
        return i, j, score[i, j]
    i, j = pairs
    score = np.einsum("pd,pd->p", q.x[i], r.x[j])
    ok = (score >= low[i]) & (score <= high[i])
    return i[ok], j[ok], score[ok]


class Best:
    """The k highest (score, then smaller id) rows of each of n targets so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.target = self.score = self.id = self.uid = np.zeros(0, np.int64)
        self.worst = np.full(n, _NONE)  # the k-th score, once there are k

    def add(self, target, score, ids, uid) -> None:
        if not len(target):
            return
        t, s, i, u = (np.concatenate(p) for p in ((self.target, target), (self.score, score), (self.id, ids), (self.uid, uid)))
        order = np.lexsort((u, i, -s, t))
        t = t[order]
        first = np.searchsorted(t, t)
        place = np.arange(len(t)) - first
        keep = order[place < self.k]
        self.target, self.score, self.id, self.uid = t[place < self.k], s[keep], i[keep], u[keep]
        last = place == self.k - 1
        self.worst[t[last]] = s[order[last]]

    def batch(self, anchor: np.ndarray, named: np.ndarray) -> pa.RecordBatch:
        cols = (anchor[self.target], named[self.target], self.score, self.id, self.uid)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "target", "score", "id", "uid"])


def _positives(anchors, width: int, levels: tuple, k: int):
    def run(batches):
        q = Rows(anchors.value, width, levels)
        best = Best(len(q.uid), k)
        for b in batches:
            if not b.num_rows:
                continue
            r = Rows(b, width, levels)
            for a in range(0, len(q.uid), BLOCK):
                p = q.part(a, a + BLOCK)
                same = (p.label[:, None] == r.label) & (p.uid[:, None] != r.uid)
                i, j, s = scored_pairs(p, r, best.worst[a:a + BLOCK], np.full(len(p.uid), np.iinfo(np.int64).max), same)
                best.add(i + a, s, r.id[j], r.uid[j])
        yield best.batch(q.uid, np.zeros(len(q.uid), np.int64))
    return run


def _negatives(anchors, targets, width: int, levels: tuple, k: int):
    def run(batches):
        q = Rows(anchors.value, width, levels)
        row, uid, low, high = targets.value      # by anchor row
        first, last = np.searchsorted(row, np.arange(len(q.uid))), np.searchsorted(row, np.arange(len(q.uid)), side="right")
        best = Best(len(row), k)
        asked = np.flatnonzero(last > first)
        for b in batches:
            if not b.num_rows or not len(asked):
                continue
            r = Rows(b, width, levels)
            for a in range(0, len(q.uid), BLOCK):
                p = q.part(a, a + BLOCK)
                lo, hi = np.full(len(p.uid), np.iinfo(np.int64).max), np.full(len(p.uid), _NONE)
                mine = np.arange(first[a], last[min(a + BLOCK, len(q.uid)) - 1])
                np.minimum.at(lo, row[mine] - a, np.maximum(low[mine], best.worst[mine]))
                np.maximum.at(hi, row[mine] - a, high[mine])
                i, j, s = scored_pairs(p, r, lo, hi, p.label[:, None] != r.label)
                n = (last - first)[i + a]          # a pair meets each positive of its anchor
                e = np.repeat(np.arange(len(i)), n)
                t = first[i + a][e] + np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
                ok = (s[e] >= np.maximum(low[t], best.worst[t])) & (s[e] <= high[t])
                t, e = t[ok], e[ok]
                best.add(t, s[e], r.id[j[e]], r.uid[j[e]])
        yield best.batch(q.uid[row], uid)
    return run


def stored_vectors(table: DataFrame, id_col: str, vec_col: str, label: Column, scale: int = SCALE, levels: tuple = LEVELS) -> tuple[DataFrame, int]:
    """A written table of the rows that take part (uid, id, label, vec and each level's mean and dev), and the vectors' width."""
    rows = table.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                        F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and label is not null and vec is not null")
    parsed = materialise(rows.mapInArrow(_parse(scale), "uid long, id long, label long, vec binary"), "vectors")
    width = max((parsed.agg(F.max(F.length("vec"))).first()[0] or 0) // 8, 1)
    schema = "uid long, id long, label long, vec binary, " + ", ".join(f"mean{k} binary, dev{k} binary" for k in range(len(levels)))
    return materialise(parsed.mapInArrow(_summarise(width, levels), schema), "summaries"), width


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "uid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(table: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, scale: int = SCALE, levels: tuple = LEVELS, part_rows: int = PART_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the first ``negatives``
    rows of another label with low * positive_score <= 100 * score <= high * positive_score, for the first
    ``positives`` rows of each anchor's label. ``is_anchor`` is a condition on the column ``id``."""
    spark = table.sparkSession
    rows, width = stored_vectors(table, id_col, vec_col, label, scale, levels)
    anchors = rows.where(is_anchor)
    parts = max(1, -(-anchors.count() // part_rows))
    out = None
    for part in range(parts):
        # about ``part_rows`` anchors, at most five positives each
        one = anchors.where(F.pmod(F.xxhash64("uid"), F.lit(parts)) == part).toArrow().combine_chunks()
        batch = one.sort_by("uid").to_batches()[0] if one.num_rows else None
        if batch is None:
            continue
        q = spark.sparkContext.broadcast(batch)
        uids = np.asarray(batch.column("uid"))
        near = _top(rows.mapInArrow(_positives(q, width, levels, positives), _OUT), ["anchor"], positives)
        found = near.select("anchor", "uid", "id", "score").toArrow().sort_by([("anchor", "ascending"), ("score", "descending"), ("id", "ascending"), ("uid", "ascending")])
        anchor, uid, ids, score = (found.column(c).to_numpy() for c in ("anchor", "uid", "id", "score"))
        lows, highs = -((-low * score) // 100), high * score // 100
        some = lows <= highs
        anchor, uid, ids, score, lows, highs = (v[some] for v in (anchor, uid, ids, score, lows, highs))
        place = np.searchsorted(uids, anchor)
        # a positive is named by its place in this part's list
        targets = spark.sparkContext.broadcast((place, np.arange(len(place)), lows, highs))
        hard = _top(rows.mapInArrow(_negatives(q, targets, width, levels, negatives), _OUT), ["anchor", "target"], negatives)
        names = spark.createDataFrame(pa.table({"target": pa.array(np.arange(len(ids)), pa.int64()), "anchor_id": np.asarray(batch.column("id"))[place], "positive_id": ids, "positive_score": score}))
        done = hard.join(names, "target").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                                                "positive_score", F.col("score").alias("negative_score"))
        done = materialise(done, "negatives")
        out = done if out is None else out.unionByName(done)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
