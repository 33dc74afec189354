"""Session helpers: time zone, checkpoint folder, tuned defaults."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Scan timestamps are naive wall-clock values; a UTC session keeps them
# unchanged when they are cast between TIMESTAMP and TIMESTAMP_NTZ.
SESSION_ZONE = "UTC"


def ensure_utc(spark: SparkSession) -> SparkSession:
    if spark.conf.get("spark.sql.session.timeZone", None) != SESSION_ZONE:
        spark.conf.set("spark.sql.session.timeZone", SESSION_ZONE)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from ``spark.checkpoint.dir``; only when it is unset (local tests)
    a fresh scratch folder is created and registered on the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on the cluster")
        path = tempfile.mkdtemp(prefix="passage-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    sep = "" if base.endswith("/") else "/"
    return f"{base}{sep}{name}"


def cluster_conf(total_input_bytes: int, advisory_mb: int = 256) -> dict:
    """Suggested settings for a large cluster: AQE with coalescing and skew
    splitting, ~``advisory_mb`` shuffle partitions, file splits of the same
    size. ``total_input_bytes`` sizes the initial shuffle partition count."""
    parts = max(200, int(total_input_bytes // (advisory_mb * 1024 * 1024)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{advisory_mb}m",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": f"{advisory_mb}m",
        "spark.sql.session.timeZone": SESSION_ZONE,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }


def local_session(cores: int | str = "*", app: str = "passage",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", SESSION_ZONE)
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("PASSAGE_DRIVER_MEMORY", "8g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
