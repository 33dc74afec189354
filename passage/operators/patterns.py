"""Traffic patterns: percentile tiers, mixture-model clusters ordered into
Quiet / Moderate / Busy, cluster-quality metrics.

Features are z-scored per key (population std), so one distributed
Gaussian-mixture fit serves every site and a busy site does not swamp a
quiet one (``mixture.py``). Quality metrics are aggregates: per-cluster statistics (k rows)
are combined with each point through one k-element array, so no pairwise
point distances are ever formed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passage.config import Config
from passage.functions.labels import PATTERN_LABELS, pattern_label
from passage.operators import DEFAULT_KEYS
from passage.operators.features import cyclic_features
from passage.operators.mixture import Mixture, fit_mixture
from passage.session import scratch_path

V = "avg_devices"
PATTERN_FEATURES = (V, "hour_sin", "hour_cos", "dow_sin", "dow_cos")


# ------------------------------------------------------------------ tiers ---

def percentile_tiers(df: DataFrame, keys=DEFAULT_KEYS, value: str = V,
                     low: float = 0.10, high: float = 0.70) -> DataFrame:
    """Tier 0 (Quiet) below the key's ``low`` percentile, 2 (Busy) above the
    ``high`` percentile, else 1 (Moderate). Exact, linearly interpolated
    percentiles; per-key window aggregate (no join)."""
    part = Window.partitionBy(*keys)
    p_lo = F.percentile(value, low).over(part)
    p_hi = F.percentile(value, high).over(part)
    v = F.col(value)
    d = df.withColumn("p_low", p_lo).withColumn("p_high", p_hi)
    tier = (F.when(v < F.col("p_low"), 0).when(v > F.col("p_high"), 2).otherwise(1)).cast("int")
    return d.withColumn("tier", tier).withColumn("tier_label", pattern_label(F.col("tier")))


# ---------------------------------------------------------------- scaling ---

def zscore_stats(df: DataFrame, cols, keys=DEFAULT_KEYS) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return df.groupBy(*keys).agg(*aggs)


def zscore_window(df: DataFrame, cols, keys=DEFAULT_KEYS, suffix: str = "_z") -> DataFrame:
    """Per-key z-scores as window aggregates: no join, and no shuffle when
    the input is already partitioned by the keys."""
    part = Window.partitionBy(*keys)
    out = []
    for c in cols:
        sd = F.stddev_pop(c).over(part)
        out.append(F.when(sd > 0, (F.col(c) - F.avg(c).over(part)) / sd).otherwise(0.0).alias(f"{c}{suffix}"))
    return df.select("*", *out)


def apply_zscore(df: DataFrame, stats: DataFrame, cols, keys=DEFAULT_KEYS, suffix: str = "_z") -> DataFrame:
    d = df.join(stats, list(keys), "left")
    for c in cols:
        sd = F.col(f"{c}__std")
        d = d.withColumn(f"{c}{suffix}", F.when(sd > 0, (F.col(c) - F.col(f"{c}__mean")) / sd).otherwise(0.0))
    return d.drop(*[f"{c}__{s}" for c in cols for s in ("mean", "std")])


# ---------------------------------------------------------------- quality ---

def _cluster_table(df: DataFrame, cols, label: str) -> DataFrame:
    """One row per cluster: n, centroid (array), mean distance to centroid
    (s), within sum of squares (w), sum of squared norms (q)."""
    cen = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    cen = cen.withColumn("centroid", F.array(*[F.col(f"_c{i}") for i in range(len(cols))]))
    d = df.join(cen.select(label, "centroid"), label)
    sq = sum((F.col(c) - F.col("centroid")[i]) * (F.col(c) - F.col("centroid")[i]) for i, c in enumerate(cols))
    norm2 = sum(F.col(c) * F.col(c) for c in cols)
    per = d.groupBy(label).agg(F.avg(F.sqrt(sq)).alias("s"), F.sum(sq).alias("w"), F.sum(norm2).alias("q"))
    return cen.select(label, "n", "centroid").join(per, label)


def _dist2(a: Column, b: Column, dims: int) -> Column:
    return sum((a[i] - b[i]) * (a[i] - b[i]) for i in range(dims))


def cluster_quality(df: DataFrame, cols, label: str) -> DataFrame:
    """Davies–Bouldin and Calinski–Harabasz indices over feature columns
    ``cols`` for the given cluster labels (one row). With fewer than two
    clusters both are NULL; clusters with one centroid are left out of each
    other's comparison; without spread inside clusters the second is NULL."""
    dims = len(cols)
    ct = _cluster_table(df, cols, label)
    one = ct.agg(F.collect_list(F.struct(F.col(label).alias("l"), "n", "centroid", "s", "w")).alias("cl"),
                 F.sum("n").alias("N"), F.sum("w").alias("W"), F.count(F.lit(1)).alias("k"),
                 *[(F.sum(F.col("n") * F.col("centroid")[i]) / F.sum("n")).alias(f"_g{i}") for i in range(dims)])
    g = F.array(*[F.col(f"_g{i}") for i in range(dims)])
    cl = F.col("cl")
    ratio = F.transform(cl, lambda a: F.array_max(F.transform(
        F.filter(cl, lambda b: b["l"] != a["l"]),
        lambda b: F.try_divide(a["s"] + b["s"], F.sqrt(_dist2(a["centroid"], b["centroid"], dims))))))
    db = F.aggregate(ratio, F.lit(0.0), lambda acc, x: acc + x) / F.size(ratio)
    b_ss = F.aggregate(cl, F.lit(0.0), lambda acc, a: acc + a["n"] * _dist2(a["centroid"], g, dims))
    ch = F.try_divide(F.try_divide(b_ss, F.col("k") - 1), F.try_divide(F.col("W"), F.col("N") - F.col("k")))
    return one.select(F.col("k").alias("clusters"), F.col("N").alias("n"),
                      db.alias("davies_bouldin"), ch.alias("calinski_harabasz"))


def silhouette_sq(df: DataFrame, cols, label: str) -> DataFrame:
    """Mean silhouette with *squared* Euclidean distances (the measure Spark
    ML's ``ClusteringEvaluator`` reports), computed from per-cluster sums:
    mean ||x-y||² over cluster C = ||x||² - 2 x·mean_C + mean_C(||y||²).
    A point alone in its cluster, or at no distance from any point, scores
    0; with a single cluster the mean is NULL."""
    dims = len(cols)
    # one pass: n, centroid and sum of squared norms per cluster (k rows)
    norm2 = sum(F.col(c) * F.col(c) for c in cols)
    ct = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(norm2).alias("q"),
                               F.array(*[F.avg(c) for c in cols]).alias("centroid"))
    # the k cluster rows as one array, a scalar subquery evaluated once
    cl = ct.agg(F.collect_list(F.struct(F.col(label).alias("l"), "n", "centroid", "q")).alias("cl")).scalar()
    d = df.withColumn("cl", cl)
    x = F.array(*[F.col(c).cast("double") for c in cols])
    x2 = sum(F.col(c) * F.col(c) for c in cols)

    def mean_d2(c):  # mean squared distance from x to the points of cluster c
        dot = sum(x[i] * c["centroid"][i] for i in range(dims))
        return x2 - F.lit(2.0) * dot + c["q"] / c["n"]

    own = F.filter(F.col("cl"), lambda c: c["l"] == F.col(label))[0]
    a = F.try_divide(mean_d2(own) * own["n"], own["n"] - 1)
    b = F.array_min(F.transform(F.filter(F.col("cl"), lambda c: c["l"] != F.col(label)), mean_d2))
    s = F.when(b.isNotNull(), F.when(own["n"] <= 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))))
    return d.agg(F.avg(s).alias("silhouette_sq"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ mixture model --

@dataclass
class PatternModel:
    """Fitted pattern model: per-key scaler table, mixture, mapping of its
    components → ordered cluster (0 = quietest)."""
    scaler: DataFrame
    mixture: Mixture
    mapping: dict
    keys: tuple = DEFAULT_KEYS
    features: tuple = PATTERN_FEATURES
    labels: tuple = field(default=PATTERN_LABELS)
    covariance_type: str = "full"

    def label(self, df: DataFrame) -> DataFrame:
        """Adds ``cluster`` (0…k-1 ordered by traffic), ``cluster_label`` and
        ordered probabilities ``p_<label>``; all NULL where a feature or the
        row's key is unknown. Ties go to the quieter cluster."""
        d = df if "hour_sin" in df.columns else cyclic_features(df)
        z = apply_zscore(d, self.scaler, self.features, self.keys)
        # a key without a scaler row has no z-scores
        cols = [f"{c}_z" for c in self.features]
        z = z.select("*", *[F.when(F.col(c).isNotNull(), F.col(f"{c}_z")).alias(f"_x{i}") for i, c in enumerate(self.features)]).drop(*cols)
        out = self.mixture.responsibilities(z, [f"_x{i}" for i in range(len(cols))])
        inv = {v: k for k, v in self.mapping.items()}
        ordered = [F.col(f"_r{inv[j]}") for j in sorted(inv)]
        cluster = F.when(F.col("_ll").isNotNull(), F.array_position(F.array(*ordered), F.greatest(*ordered) if len(ordered) > 1 else ordered[0]) - 1).cast("int")
        probs = [p.alias(f"p_{name.lower()}") for p, name in zip(ordered, self.labels)]
        return out.select(*df.columns, cluster.alias("cluster"), *probs).withColumn("cluster_label", pattern_label(F.col("cluster")))


def fit_patterns(df: DataFrame, cfg: Config, keys=DEFAULT_KEYS, features=PATTERN_FEATURES) -> PatternModel:
    """Gaussian mixture (k = ``cfg.n_components``, ``cfg.covariance_type``) on
    the per-key z-scored features, started from the percentile tiers of each
    key's traffic (with other than three components, from its quantiles). Components are ordered by the mean z-scored traffic of the rows
    they win; those that win none come last. The z-scored points are written
    once to the shared folder and read by every round."""
    k = cfg.n_components
    d = df if "hour_sin" in df.columns else cyclic_features(df)
    stats = zscore_stats(d, features, keys)
    z = apply_zscore(d.select(*keys, *dict.fromkeys([features[0], *features])), stats, features, keys)
    if k == 3:
        start = percentile_tiers(z, keys, features[0]).withColumn("_start", F.col("tier"))
    else:
        part = Window.partitionBy(*keys)
        over = [(F.col(features[0]) > F.percentile(features[0], j / k).over(part)).cast("int") for j in range(1, k)]
        start = z.withColumn("_start", sum(over, F.lit(0)))
    cols = [f"{c}_z" for c in features]
    path = scratch_path(df.sparkSession, f"patterns/points-{uuid.uuid4().hex[:12]}")
    known = start.na.drop(subset=list(features))
    known.select(*cols, "_start").write.parquet(path)
    points = df.sparkSession.read.parquet(path)
    model = fit_mixture(points, cols, "_start", k, cfg.covariance_type, cfg.gmm_max_iter, cfg.gmm_tol)
    r = [F.col(f"_r{j}") for j in range(k)]
    best = F.array_position(F.array(*r), F.greatest(*r) if k > 1 else r[0]) - 1
    # k rows come back to the driver: the mean traffic of each component's rows
    means = {int(x["c"]): x["m"] for x in model.responsibilities(points, cols).groupBy(best.alias("c")).agg(F.avg(cols[0]).alias("m")).collect()}
    order = sorted(range(k), key=lambda j: (j not in means, means.get(j, 0.0), j))
    return PatternModel(scaler=stats, mixture=model, mapping={j: i for i, j in enumerate(order)}, keys=tuple(keys), features=tuple(features),
                        covariance_type=cfg.covariance_type)
