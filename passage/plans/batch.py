"""Batch processing job over detections: clean → presence → per-scan
counts → windows → features. One lazy plan; exchanges only on
``(site, device)``, ``(site, scan)`` and ``(site, window)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passage.config import Config
from passage.operators import DEFAULT_KEYS, clean, features, presence, windows
from passage.sources.events import detections_from_events


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections_from_events(spark, sf_dir)


def clean_detections(spark: SparkSession, sf_dir: str, cfg: Config) -> DataFrame:
    return clean.clean_detections(raw_detections(spark, sf_dir), cfg)


def transient_detections(spark: SparkSession, sf_dir: str, cfg: Config,
                         break_rule: str = "scan") -> DataFrame:
    raw = raw_detections(spark, sf_dir)
    det = clean.rssi_filter(clean.fill_defaults(raw), cfg)
    # every logged scan of a site counts as a scan instant, weak or not;
    # de-duplication shares the presence exchange
    return presence.transient_only(det, cfg, DEFAULT_KEYS, break_rule, scans=raw, dedupe=True)


def process_detections(det: DataFrame, cfg: Config, keys=DEFAULT_KEYS, keep_empty: bool = False,
                       window_hours: int | None = None, deduped: bool = False) -> DataFrame:
    """Detections → window table with calendar features. ``deduped``: one
    row per device and scan already (skips the distinct exchange)."""
    counts = windows.scan_counts(det, keys, distinct=not deduped)
    return windows.window_counts(counts, cfg, keys, keep_empty=keep_empty, window_hours=window_hours)


def window_table(spark: SparkSession, sf_dir: str, cfg: Config, window_hours: int | None = None,
                 keep_empty: bool = False) -> DataFrame:
    return process_detections(transient_detections(spark, sf_dir, cfg), cfg,
                              keep_empty=keep_empty, window_hours=window_hours, deduped=True)


def ml_table(spark: SparkSession, sf_dir: str, cfg: Config, window_hours: int = 1) -> DataFrame:
    return features.ml_dataset(window_table(spark, sf_dir, cfg, window_hours), cfg)


def process_scans(scans: DataFrame, cfg: Config, keys=DEFAULT_KEYS, capture_clean: bool = False,
                  break_rule: str = "scan", window_hours: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan records (``sources.scans.read_scans``) → (window table, ML dataset).

    Logged records were already cleaned by the capture side; with
    ``capture_clean=True`` the capture steps (threshold, de-duplication,
    stationary filter) are applied here, the records giving the scan
    instants."""
    det = windows.explode_devices(scans)
    if capture_clean:
        det = clean.rssi_filter(clean.fill_defaults(det), cfg)
        # de-duplication shares the presence exchange; the records give the scan instants
        det = presence.transient_only(det, cfg, keys, break_rule, scans=scans.select(*keys, "timestamp"),
                                      dedupe=True)
    win = process_detections(det, cfg, keys, window_hours=window_hours)
    return win, features.ml_dataset(win, cfg, keys)
