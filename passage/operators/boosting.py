"""Gradient-boosted regression trees grown from histograms.

* Cut points of each feature are exact percentiles of a hash sample of at most
  about BIN_ROWS rows (all rows below that); a row is binned once and written
  with its target to the shared folder. A missing value lies in the lowest bin.
* A level of a tree is one aggregate: sums of residuals and row counts per
  (node, feature, bin), combined before the exchange. The driver gets these
  numbers (at most 2**level * features * bins), whose cumulative sums give each
  split's gain and the sums of both children. Leaves are shrunk by L2.
* Once no node of a level has more than NODE_ROWS rows, one job grows the rest:
  the rows meet by node and each group makes its levels' histograms by itself
  and splits them by the same rule.
* After each tree the rows are written with their new prediction, and the
  validation error is observed in that same pass. Training stops after a run
  of ``patience`` trees without a lower error and keeps the first best ones:
  nothing is refitted.
* Rows and features of a tree are drawn by hashes of the row's key, the tree
  and the seed, so the model does not depend on how rows are partitioned.

Trees are stored as heaps (children of i are 2i+1 and 2i+2); scoring walks
them with higher-order functions inside the JVM.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from passage.session import scratch_path

#: Bins of a feature, and rows that place the cut points, about.
BINS = 32
BIN_ROWS = 200_000
#: Rows of a node whose whole subtree one group may grow (some 50 bytes a row).
NODE_ROWS = 1 << 16
#: Added to a node's row count: shrinks leaves and gains.
L2 = 1.0
#: Gains are compared to so many decimals, so that equal splits tie wherever their sums were made.
GAIN_DIGITS = 6


@dataclass
class Tree:
    """feature, threshold and cut bin of each inner node (an unsplit one sends all rows left) and the value of each node."""
    feature: list[int]
    threshold: list[float]
    cut: list[int]
    value: list[float]


@dataclass
class Boosted:
    features: list[str]
    depth: int
    base: float
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {"features": self.features, "depth": self.depth, "base": self.base, "errors": self.errors,
                "trees": [[t.feature, t.threshold, t.cut, t.value] for t in self.trees]}

    @staticmethod
    def from_dict(d: dict) -> "Boosted":
        return Boosted(d["features"], d["depth"], d["base"], [Tree(*t) for t in d["trees"]], d["errors"])

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Adds the sum of the trees' values; columns of the names of ``features`` must be there."""
        if not self.trees:
            return df.withColumn(out, F.lit(self.base))
        x = F.array(*[F.col(c).cast("double") for c in self.features])
        trees = _given([{"f": t.feature, "t": t.threshold, "v": t.value} for t in self.trees],
                       "array<struct<f: array<int>, t: array<double>, v: array<double>>>")

        def leaf(t: Column) -> Column:
            return _walk(self.depth, lambda i: F.coalesce(F.get("_x", F.get(t["f"], i)) > F.get(t["t"], i), F.lit(False)))

        d = df.withColumn("_x", x).withColumn("_trees", trees)
        total = F.aggregate("_trees", F.lit(self.base), lambda s, t: s + F.get(t["v"], leaf(t)))
        return d.withColumn(out, total).drop("_x", "_trees")


def _given(values, kind: str) -> Column:
    """A nested value as one literal text, read once when the plan is made (a literal a number takes a call of the JVM each)."""
    return F.from_json(F.lit(json.dumps(values)), kind, {"mode": "FAILFAST"})


def _walk(levels: int, right) -> Column:
    """The heap number of the node that a row reaches after ``levels`` steps."""
    if levels == 0:
        return F.lit(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(0), lambda i, _: i * 2 + 1 + right(i).cast("int"))


def _draw(share: float, *salt) -> Column:
    return F.pmod(F.xxhash64("_k", *[F.lit(s) for s in salt]), F.lit(1_000_000)) < F.lit(int(round(share * 1_000_000)))


def _drawn_features(n: int, share: float, tree: int, seed: int) -> list[int]:
    """The features of a tree: those with the smallest mixed numbers."""
    take = max(1, round(n * share))
    mix = lambda j: ((j + 1) * 2654435761 ^ (tree + 1) * 40503 ^ (seed + 1) * 2246822519) * 3266489917 % (1 << 32)
    return sorted(sorted(range(n), key=lambda j: (mix(j), j))[:take])


def cut_points(df: DataFrame, features, bins: int = BINS, bin_rows: int = BIN_ROWS) -> list[list[float]]:
    """Distinct percentiles of each feature, in order; ``_k`` is the row's key."""
    every = max(1, -(-df.count() // bin_rows))
    some = df.where(F.pmod(F.xxhash64("_k", F.lit(7)), F.lit(every)) == 0) if every > 1 else df
    probs = [i / bins for i in range(1, bins)]
    row = some.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(q or [])) for q in row]


def _bin(cuts: list[float], x: Column) -> Column:
    """How many cut points lie below a value; 0 for a missing one."""
    below = F.size(F.filter(F.array(*[F.lit(t) for t in cuts]), lambda t: t < x)) if cuts else F.lit(0)
    return F.when(x.isNull(), 0).otherwise(below).cast("tinyint")


def _histogram(rows: DataFrame, node: Column, drawn: list[int]) -> DataFrame:
    """Residual sum and rows of each (node, feature, bin): one aggregate, combined before the exchange."""
    each = F.explode(F.transform(_given(drawn, "array<int>"), lambda j: F.struct(j.alias("f"), F.get("_b", j).alias("bin")))).alias("c")
    # the node is found once a row, below the explode
    cells = rows.select(node.alias("node"), (F.col("_y") - F.col("_p")).alias("g"), "_b").select("node", "g", each)
    return cells.groupBy("node", "c.f", "c.bin").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n"))


def _subtrees(rows: DataFrame, node: Column, drawn: list[int], level: int, depth: int) -> DataFrame:
    """Sums and best split (``cut`` is null where none gains) of each node from ``level`` on: a group a node of that level."""
    best, out_schema = _best_splits, _SPLIT

    def grow(table: pa.Table) -> pa.Table:
        b, g = np.stack([np.asarray(table.column(f"b{k}")) for k in range(len(drawn))], 1).astype(np.int64), np.asarray(table.column("g"))
        at, out = np.asarray(table.column("node")).astype(np.int64), []
        top = at[0] + 1      # the leftmost node k levels below it has number top * 2**k - 1
        for k in range(depth - level):
            first, nodes = int(top * 2 ** k - 1), 2 ** k
            place = (((at - first)[:, None] * len(drawn) + np.arange(len(drawn))) * 128 + b).ravel()
            n = np.bincount(place, minlength=nodes * len(drawn) * 128)
            sums, some = np.bincount(place, np.repeat(g, len(drawn)), len(n)), np.flatnonzero(n)
            cells = pa.table({"node": some // (len(drawn) * 128) + first, "f": np.take(drawn, some // 128 % len(drawn)), "bin": some % 128,
                              "g": sums[some], "n": n[some]})
            feature, cut = np.zeros(nodes, np.int64), np.full(nodes, 127)
            for i, total, split in best(cells, drawn, first, nodes):
                out.append((i, *total, *(split or (None,) * 4)))
                if split:
                    feature[i - first], cut[i - first] = drawn.index(split[0]), split[1]
            mine = at - first
            at = 2 * at + 1 + (b[np.arange(len(g)), feature[mine]] > cut[mine])
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), out_schema.types)], schema=out_schema)
    each = rows.select(node.alias("node"), (F.col("_y") - F.col("_p")).alias("g"), *[F.get("_b", F.lit(j)).alias(f"b{k}") for k, j in enumerate(drawn)])
    return each.groupBy("node").applyInArrow(grow, "node int, g double, n double, feature int, cut int, gl double, nl double")


_SPLIT = pa.schema([("node", pa.int32()), ("g", pa.float64()), ("n", pa.float64()), ("feature", pa.int32()), ("cut", pa.int32()), ("gl", pa.float64()), ("nl", pa.float64())])


def _splitter():
    """The rule of both ways of growing; as a local function it travels to the workers whole."""
    def best(cells, drawn: list[int], first: int, nodes: int):
        """Of a level's histogram: for each node with rows its sums, and its best split with the sums left of it, or None
        where no split gains. The highest gain wins, then the first feature and bin."""
        node, f, at = (cells.column(c).to_numpy() for c in ("node", "f", "bin"))
        where = (node - first, np.searchsorted(drawn, f), at)
        g, n = np.zeros((2, nodes, len(drawn), 128))
        g[where], n[where] = cells.column("g").to_numpy(), cells.column("n").to_numpy()
        gl, nl = g.cumsum(2), n.cumsum(2)
        ga, na = gl[:, :1, -1:], nl[:, :1, -1:]      # equal for all features but for rounding: those of the first one
        gain = gl * gl / (nl + L2) + (ga - gl) * (ga - gl) / (na - nl + L2) - ga * ga / (na + L2)
        gain = np.where(nl < na, np.round(gain, GAIN_DIGITS), 0.0).reshape(nodes, -1)
        for i in np.flatnonzero(na[:, 0, 0]).tolist():
            k = int(gain[i].argmax())
            j, c = divmod(k, 128)
            yield first + i, (ga[i, 0, 0], na[i, 0, 0]), ((drawn[j], c, gl[i, j, c], nl[i, j, c]) if gain[i, k] > 0 else None)
    return best


_best_splits = _splitter()


def fit_boosted(df: DataFrame, features, label: str, row_key, is_val: str | None = None, trees: int = 200, depth: int = 6, rate: float = 0.1,
                subsample: float = 1.0, colsample: float = 1.0, patience: int | None = None, seed: int = 42, bins: int = BINS) -> Boosted:
    """Trees on the rows of ``df`` where ``is_val`` is false (all, with None); ``row_key`` columns name a row. Rows without a target
    are left out."""
    spark, features = df.sparkSession, list(features)
    base_path = scratch_path(spark, f"boosting/{uuid.uuid4().hex[:12]}")
    val = F.coalesce(F.col(is_val), F.lit(False)) if is_val else F.lit(False)
    src = df.where(F.col(label).isNotNull()).select(F.xxhash64(*row_key).alias("_k"), F.col(label).cast("double").alias("_y"), val.alias("_v"),
                                                    *[F.col(c).cast("double").alias(c) for c in features])
    src.write.parquet(f"{base_path}/rows")
    src = spark.read.parquet(f"{base_path}/rows")
    fit_rows = src.where("NOT _v")
    cuts = cut_points(fit_rows, features, bins)
    start = fit_rows.agg(F.avg("_y")).first()[0]
    model = Boosted(features, depth, float(start or 0.0))
    if start is None or not features:
        return model
    binned = src.select("_k", "_y", "_v", F.array(*[_bin(q, F.col(c)) for q, c in zip(cuts, features)]).alias("_b"))
    rows = binned.withColumn("_p", F.lit(model.base))
    rows.write.parquet(f"{base_path}/0")
    n_rows = fit_rows.count()
    best, best_at, spent = float("inf"), 0, None
    for t in range(trees):
        rows = spark.read.schema(rows.schema).parquet(f"{base_path}/{t}")
        mine = rows.where("NOT _v")
        mine = mine.where(_draw(subsample, seed, t)) if subsample < 1 else mine
        tree = _grow(mine, cuts, depth, rate, _drawn_features(len(features), colsample, t, seed), n_rows)
        if tree is None:
            break
        model.trees.append(tree)
        leaf = _walk(depth, _right(tree))
        after = rows.withColumn("_p", F.col("_p") + F.get(_given(tree.value, "array<double>"), leaf))
        seen = Observation(f"boosting-{uuid.uuid4().hex[:8]}")
        error = F.when(F.col("_v"), (F.col("_y") - F.col("_p")) * (F.col("_y") - F.col("_p")))
        after.observe(seen, F.avg(error).alias("mse")).write.parquet(f"{base_path}/{t + 1}")
        if spent:
            _remove(spark, spent)
        spent = f"{base_path}/{t}"
        mse = seen.get["mse"] if is_val else None
        if mse is not None:
            model.errors.append(mse)
            if mse < best:
                best, best_at = mse, t
            elif patience and t - best_at >= patience:
                break
    if patience and model.errors:
        model.trees = model.trees[:best_at + 1]
    return model


def _remove(spark, path: str) -> None:
    """A table of this fit that the next one replaced."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _right(tree: Tree):
    f, c = _given(tree.feature, "array<int>"), _given(tree.cut, "array<int>")
    return lambda i: F.get("_b", F.get(f, i)) > F.get(c, i)


def _grow(rows: DataFrame, cuts: list[list[float]], depth: int, rate: float, drawn: list[int], n_rows: int) -> Tree | None:
    """A tree on the residuals of ``rows``, ``n_rows`` at most; values are scaled by ``rate``. None without rows."""
    inner, last = 2 ** depth - 1, 2 ** (depth + 1) - 1
    tree = Tree([0] * inner, [float("inf")] * inner, [127] * inner, [0.0] * last)
    sums: dict[int, tuple[float, float]] = {}
    drawn = [j for j in drawn if cuts[j]] or drawn[:1]

    def take(i, g, n, split):
        sums[i] = sums[2 * i + 1] = (g, n)
        if split:
            tree.feature[i], tree.cut[i], gl, nl = split
            tree.threshold[i] = cuts[tree.feature[i]][tree.cut[i]]
            sums[2 * i + 1], sums[2 * i + 2] = (gl, nl), (g - gl, n - nl)

    for level in range(depth):
        first, node = 2 ** level - 1, _walk(level, _right(tree))
        if max((sums[i][1] for i in range(first, 2 * first + 1) if i in sums), default=n_rows) <= NODE_ROWS:
            # a row a node below this level
            for r in sorted(_subtrees(rows, node, drawn, level, depth).toArrow().to_pylist(), key=lambda r: r["node"]):
                take(r["node"], r["g"], r["n"], None if r["cut"] is None else (r["feature"], r["cut"], r["gl"], r["nl"]))
            break
        # at most 2**level * features * bins numbers
        for i, total, split in _best_splits(_histogram(rows, node, drawn).toArrow(), drawn, first, 2 ** level):
            take(i, *total, split)
    if not sums:
        return None
    for i in range(last):   # a node that no row of this draw reaches takes its parent's value
        if i in sums:
            tree.value[i] = float(rate * sums[i][0] / (sums[i][1] + L2))
        elif i:
            tree.value[i] = tree.value[(i - 1) // 2]
    return tree
