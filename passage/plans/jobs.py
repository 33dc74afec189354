"""End-to-end jobs: processing (scan logs → window table + ML dataset),
training (patterns + forecaster + metrics), serving (read models).

All paths are explicit parameters on shared storage; every step is a Spark
job, nothing passes through the driver except k-row model summaries."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from passage.config import Config
from passage.operators import DEFAULT_KEYS, features, forecast, patterns, reports, snapshot
from passage.plans.batch import process_scans
from passage.sinks import files
from passage.sources import scans as scan_source


def processing_job(spark: SparkSession, raw_path: str, out_path: str, cfg: Config, start=None, end=None,
                   capture_clean: bool = False, keys=DEFAULT_KEYS,
                   glob: str | None = scan_source.SCAN_GLOB, site_id: str | None = None) -> dict:
    """Read scan logs, build the window table and the ML dataset, write both
    (partitioned by site) with metadata; returns the output paths and the
    numbers of dropped rows, which are also written (``dropped_rows``). The ML
    dataset is built from the written windows, so the logs are read once;
    an empty one (too short a history) is a warning.
    ``glob=None`` reads logs written by ``sinks.files.append_scans``;
    ``site_id`` names the site of logs that carry none. Records without a
    site are an error: no window could be attributed to them."""
    if scan_source.read_scans(spark, raw_path, start, end, site_id=site_id, glob=glob).where(
            F.col("site_id").isNull()).limit(1).count():
        raise ValueError("scan records without site_id: pass site_id")
    # the capture steps read the records twice (sightings and scan instants), so lines are not counted with them
    lines, feats = (None if capture_clean else Observation()), Observation()
    scans = scan_source.read_scans(spark, raw_path, start, end, site_id=site_id, glob=glob, seen=lines)
    win, _ = process_scans(scans, cfg, keys, capture_clean=capture_clean)
    files.write_dataset(win, f"{out_path}/windows")
    win_back = scan_source.read_dataset(spark, f"{out_path}/windows").select(*win.columns)
    files.write_dataset(features.ml_dataset(win_back, cfg, keys, seen=feats), f"{out_path}/ml_dataset")
    ml_back = scan_source.read_dataset(spark, f"{out_path}/ml_dataset")
    files.write_one_row_json(reports.metadata(ml_back), f"{out_path}/ml_dataset_metadata")
    files.write_one_row_json(reports.dataset_stats(ml_back, keys), f"{out_path}/ml_dataset_stats")
    rows, kept = win_back.count(), feats.get["kept"]  # the count is read from the files' footers
    dropped = [("scan_lines", reason, int(n)) for reason, n in (lines.get if lines else {}).items()]
    dropped += [("ml_rows", "rows", rows), ("ml_rows", "dropped", rows - kept)]
    files.write_one_row_json(spark.createDataFrame(dropped, "step string, reason string, number long").coalesce(1),
                             f"{out_path}/dropped_rows")
    if not kept:
        warnings.warn(f"empty ML dataset: all {rows} windows lack a lag or a rolling value", stacklevel=2)
    return {"windows": f"{out_path}/windows", "ml_dataset": f"{out_path}/ml_dataset",
            "dropped": {(step, reason): n for step, reason, n in dropped}}


@dataclass
class TrainingResult:
    pattern_model: patterns.PatternModel
    forecaster: forecast.Forecaster
    pattern_quality: DataFrame
    forecast_metrics: DataFrame


def training_job(spark: SparkSession, ml_path: str, models_path: str, cfg: Config,
                 keys=DEFAULT_KEYS, val_how: str = "chronological") -> TrainingResult:
    """Fit the pattern model (all sites at once), evaluate it, fit the
    forecaster on each site's first ``train_fraction`` of rows, evaluate on
    the rest, save models and metrics."""
    ml = scan_source.read_dataset(spark, ml_path)
    cyc = features.cyclic_features(ml)
    pm = patterns.fit_patterns(cyc, cfg, keys)
    labelled = pm.label(cyc)
    zcols = [f"{c}_z" for c in pm.features]
    z = patterns.apply_zscore(labelled, pm.scaler, pm.features, keys)
    quality = (patterns.cluster_quality(z, zcols, "cluster")
               .withColumn("silhouette_sq", patterns.silhouette_sq(z, zcols, "cluster").select("silhouette_sq").scalar()))
    profile = reports.group_profile(labelled, "cluster_label")
    tgt = features.split_flags(features.target(ml, cfg, keys), cfg, keys)
    fc = forecast.fit_forecaster(tgt.where("is_train").drop("row_index", "is_train"), cfg, keys, val_how=val_how)
    test = fc.predict(tgt.where("NOT is_train").drop("row_index", "is_train"))
    fm = forecast.metrics(test, "avg_devices_future", "prediction")
    files.save_pattern_model(pm, f"{models_path}/patterns")
    files.save_forecaster(fc, f"{models_path}/forecaster", spark)
    files.write_one_row_json(quality, f"{models_path}/pattern_metrics")
    files.write_one_row_json(profile, f"{models_path}/pattern_profile")
    files.write_one_row_json(fm.withColumn("best_iterations", F.lit(fc.best_iterations)),
                             f"{models_path}/forecast_metrics")
    return TrainingResult(pm, fc, quality, fm)


def read_models(spark: SparkSession, ml_path: str, models_path: str, cfg: Config, as_of=None,
                keys=DEFAULT_KEYS) -> dict[str, DataFrame]:
    """The serving read models as DataFrames: current snapshot, history,
    statistics, hourly and weekly patterns."""
    ml = scan_source.read_dataset(spark, ml_path)
    pm = files.load_pattern_model(spark, f"{models_path}/patterns")
    fc = files.load_forecaster(spark, f"{models_path}/forecaster")
    return {
        "current": snapshot.score_latest(ml, pm, fc, as_of=as_of, horizon_hours=cfg.forecast_horizon, keys=keys),
        "history": reports.history(ml, cfg.history_hours, as_of=as_of, keys=keys),
        "statistics": reports.statistics(ml, keys, today_rows=cfg.today_windows),
        "hourly": reports.hourly_pattern(ml, keys),
        "weekly": reports.weekly_pattern(ml, keys),
    }
