"""Writers. Everything goes through Spark writers to shared storage (no
driver-local files), so jobs survive executor loss and run on a cluster."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passage.operators.clean import drop_empty_scans
from passage.sources.scans import WRITE


def append_scans(scans: DataFrame, path: str, log_empty: bool = False, fmt: str = "json",
                 write_id: str | None = None) -> None:
    """Append scan records, one folder per site and scan date (the daily
    file of the original system); empty scans are skipped unless
    ``log_empty``.

    Inside a day each write has a folder of its own, named by ``write_id``
    (fresh unless given). A write repeated under its name replaces its own
    rows only, so a retried job or a replayed micro-batch adds nothing, and
    batch jobs and streams can share one log.

    The rows of a folder meet before they are written (a large folder is split
    again by its size), so that files grow with the folders and the bytes, not
    with folders times tasks."""
    out = scans if log_empty else drop_empty_scans(scans)
    w = (out.withColumn("scan_date", F.to_date("timestamp")).withColumn(WRITE, F.lit(write_id or f"b{uuid.uuid4().hex}"))
            .hint("rebalance", "site_id", "scan_date")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("site_id", "scan_date", WRITE).format(fmt))
    if fmt == "json":  # naive ISO timestamps with microseconds, like the capture logs
        w = w.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    w.save(path)


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                  partition_by=("site_id",)) -> None:
    """Processed dataset, partitioned by site (CSV with header on request)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(path)


def write_one_row_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metadata / metrics tables (few rows) as JSON lines."""
    df.write.mode(mode).json(path)


def save_pattern_model(model, path: str) -> None:
    """Per-key scaler table, mixture parameters and component mapping."""
    model.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    spark = model.scaler.sparkSession
    meta = {"mapping": {str(k): v for k, v in model.mapping.items()}, "keys": list(model.keys),
            "features": list(model.features), "labels": list(model.labels),
            "mixture": model.mixture.to_dict(), "covariance_type": model.covariance_type}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
        f"{path}/meta")


def load_pattern_model(spark: SparkSession, path: str):
    """Load a saved pattern model; a missing model raises ``FileNotFoundError``."""
    from pyspark.errors import AnalysisException

    from passage.operators.mixture import Mixture
    from passage.operators.patterns import PatternModel
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    except AnalysisException as e:
        raise FileNotFoundError(f"no pattern model at {path}") from e
    return PatternModel(scaler=spark.read.parquet(f"{path}/scaler"),
                        mixture=Mixture.from_dict(meta["mixture"]), covariance_type=meta["covariance_type"],
                        mapping={int(k): int(v) for k, v in meta["mapping"].items()},
                        keys=tuple(meta["keys"]), features=tuple(meta["features"]),
                        labels=tuple(meta["labels"]))


def save_forecaster(fc, path: str, spark: SparkSession) -> None:
    meta = {"model": fc.model.to_dict(), "feature_cols": fc.feature_cols, "best_iterations": fc.best_iterations, "label": fc.label}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
        f"{path}/meta")


def load_forecaster(spark: SparkSession, path: str):
    """Load a saved forecaster; a missing model raises ``FileNotFoundError``."""
    from pyspark.errors import AnalysisException

    from passage.operators.boosting import Boosted
    from passage.operators.forecast import Forecaster
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    except AnalysisException as e:
        raise FileNotFoundError(f"no forecaster at {path}") from e
    return Forecaster(model=Boosted.from_dict(meta["model"]), feature_cols=meta["feature_cols"],
                      best_iterations=meta["best_iterations"], label=meta["label"])
