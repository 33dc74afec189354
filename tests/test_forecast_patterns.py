import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passage.config import Config
from passage.operators import features, forecast, patterns


def structured(spark, days=60, sites=3, seed=42):
    """Hourly windows with a daily and weekly cycle and ±20 % noise, made
    with spark.range (fixture only; the engine never needs it)."""
    hours = days * 24
    base = F.expr("CASE WHEN h < 6 THEN 2 WHEN h < 8 THEN 10 WHEN h < 10 THEN 25 WHEN h < 12 THEN 15 "
                  "WHEN h < 14 THEN 28 WHEN h < 17 THEN 14 WHEN h < 19 THEN 26 WHEN h < 22 THEN 10 ELSE 4 END")
    day = F.expr("CASE WHEN dow = 5 THEN 0.7 WHEN dow = 6 THEN 0.5 ELSE 1.0 END")
    df = (spark.range(hours * sites)
          .withColumn("site_id", (F.col("id") % sites).cast("string"))
          .withColumn("timestamp", F.timestamp_seconds(F.lit(1704067200) + (F.col("id") / sites).cast("long") * 3600))
          .withColumn("h", F.hour("timestamp")).withColumn("dow", F.weekday("timestamp")))
    noise = F.lit(1.0) + (F.rand(seed) - 0.5) * 0.4
    df = df.withColumn("avg_devices", base * day * noise * (F.col("site_id").cast("int") + 1))
    df = df.select("site_id", "timestamp", "avg_devices", "h", "dow")
    return features.time_features(df, Config()).drop("h", "dow")


def test_metrics_match_numpy(spark):
    rnd = np.random.default_rng(3)
    y = rnd.normal(10, 2, 200)
    p = y + rnd.normal(0, 1, 200)
    y[5] = 0.0
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    m = forecast.metrics(df, "y", "p").first()
    mse = np.mean((y - p) ** 2)
    assert math.isclose(m.mse, mse, rel_tol=1e-9)
    assert math.isclose(m.rmse, math.sqrt(mse), rel_tol=1e-9)
    assert math.isclose(m.mae, np.mean(np.abs(y - p)), rel_tol=1e-9)
    r2 = 1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2)
    assert math.isclose(m.r2, r2, rel_tol=1e-9)
    nz = y != 0
    assert math.isclose(m.mape, np.mean(np.abs((y[nz] - p[nz]) / y[nz])) * 100, rel_tol=1e-9)
    assert m.zero_actuals == 1


def test_folds_are_expanding_and_disjoint(spark):
    df = structured(spark, days=10, sites=2)
    f = forecast.expanding_folds(df, 4).collect()
    for fold in range(1, 5):
        tr = [r.timestamp for r in f if r.fold == fold and r.role == "train" and r.site_id == "0"]
        te = [r.timestamp for r in f if r.fold == fold and r.role == "test" and r.site_id == "0"]
        assert tr and te and max(tr) < min(te)


def test_silhouette_matches_spark_evaluator(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler
    df = spark.range(400).select(F.rand(1).alias("a"), F.rand(2).alias("b"), (F.rand(3) * 3).cast("int").alias("lab"))
    df = df.withColumn("a", F.col("a") + F.col("lab"))
    ours = patterns.silhouette_sq(df, ["a", "b"], "lab").first().silhouette_sq
    v = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    ev = ClusteringEvaluator(predictionCol="lab", distanceMeasure="squaredEuclidean").evaluate(
        v.withColumn("lab", F.col("lab").cast("double")))
    assert abs(ours - ev) < 1e-9


def test_cluster_quality_matches_formulas(spark):
    rnd = np.random.default_rng(0)
    X = np.vstack([rnd.normal(c, 0.3, (50, 2)) for c in (0, 2, 5)])
    lab = np.repeat([0, 1, 2], 50)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(X, lab)], "a double, b double, l int")
    q = patterns.cluster_quality(df, ["a", "b"], "l").first()
    cents = np.array([X[lab == k].mean(0) for k in range(3)])
    s = np.array([np.linalg.norm(X[lab == k] - cents[k], axis=1).mean() for k in range(3)])
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(cents[i] - cents[j]) for j in range(3) if j != i)
                  for i in range(3)])
    g = X.mean(0)
    B = sum(50 * np.sum((cents[k] - g) ** 2) for k in range(3))
    W = sum(np.sum((X[lab == k] - cents[k]) ** 2) for k in range(3))
    ch = (B / 2) / (W / (150 - 3))
    assert math.isclose(q.davies_bouldin, db, rel_tol=1e-9)
    assert math.isclose(q.calinski_harabasz, ch, rel_tol=1e-9)


def test_mixture_patterns_on_structured_fixture(spark):
    df = features.cyclic_features(structured(spark, days=30))
    cfg = Config()
    model = patterns.fit_patterns(df, cfg)
    out = model.label(df).cache()
    probs = out.select((F.col("p_quiet") + F.col("p_moderate") + F.col("p_busy")).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-6 for r in probs)
    # ordered: quiet windows are quieter on average than busy ones, per site
    for site in ("0", "1", "2"):
        means = {r.cluster: r.m for r in out.where(F.col("site_id") == site)
                 .groupBy("cluster").agg(F.avg("avg_devices").alias("m")).collect()}
        present = sorted(means)
        assert [means[c] for c in present] == sorted(means[c] for c in present)
    assert set(r.cluster_label for r in out.select("cluster_label").distinct().collect()) <= {"Quiet", "Moderate", "Busy"}
    out.unpersist()


def test_tiers(spark):
    df = structured(spark, days=20, sites=1)
    t = patterns.percentile_tiers(df).toPandas()
    p10, p70 = np.percentile(t["avg_devices"], [10, 70])
    assert math.isclose(t["p_low"].iloc[0], p10) and math.isclose(t["p_high"].iloc[0], p70)
    assert ((t["tier"] == 0) == (t["avg_devices"] < p10)).all()
    assert ((t["tier"] == 2) == (t["avg_devices"] > p70)).all()


@pytest.mark.slow
def test_forecaster_quality_on_structured_fixture(spark):
    cfg = Config(window_hours=1, n_estimators=20)
    ml = features.target(features.ml_dataset(structured(spark, days=45), cfg), cfg)
    d = features.split_flags(ml, cfg)
    train = d.where("is_train").drop("row_index", "is_train")
    test = d.where("NOT is_train").drop("row_index", "is_train")
    fc = forecast.fit_forecaster(train, cfg, feature_cols=None)
    m = forecast.metrics(fc.predict(test), "avg_devices_future", "prediction").first()
    assert m.r2 > 0.7, m
    assert 1 <= fc.best_iterations <= 20
