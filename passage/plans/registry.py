"""Named queries: ``name → (spark_fn(spark, sf_dir) → DataFrame, sql | None)``.

Every query reads the ``events`` test table through the detections adapter
(``sources.events``) so its work grows with the table; outputs go through
``present`` (rounded doubles, naive timestamps) to compare with the SQL twin.
Entries without SQL are checked on rows only (model fits, streams).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passage.config import Config
from passage.functions.present import present
from passage.operators import clean, features, presence, windows
from passage.plans import batch
from passage.plans import sqltwins as sq

from passage.plans.catalog import CFG1, CFG4, QUERIES, SQL, _gap_sql, _with, register  # noqa: F401


# ----------------------------------------------------------- capture side --

@register("clean_detections", _with(sq.base_ctes(CFG4)) + """
SELECT site_id, timestamp, scan_id, mac_hash, rssi, protocol FROM det""")
def q_clean_detections(spark, sf_dir):
    det = batch.clean_detections(spark, sf_dir, CFG4)
    return present(det.select("site_id", "timestamp", "scan_id", "mac_hash", "rssi", "protocol"))


@register("transient_detections", _with(sq.base_ctes(CFG4)) + """
SELECT site_id, timestamp, scan_id, mac_hash, rssi, protocol FROM transient""")
def q_transient(spark, sf_dir):
    tr = batch.transient_detections(spark, sf_dir, CFG4)
    return present(tr.select("site_id", "timestamp", "scan_id", "mac_hash", "rssi", "protocol"))


@register("transient_detections_tick", _gap_sql(CFG4, "tick"))
def q_transient_tick(spark, sf_dir):
    tr = batch.transient_detections(spark, sf_dir, CFG4, break_rule="tick")
    return present(tr.select("site_id", "timestamp", "scan_id", "mac_hash", "rssi", "protocol"))


@register("transient_detections_gap", _gap_sql(CFG4, "gap"))
def q_transient_gap(spark, sf_dir):
    tr = batch.transient_detections(spark, sf_dir, CFG4, break_rule="gap")
    return present(tr.select("site_id", "timestamp", "scan_id", "mac_hash", "rssi", "protocol"))


@register("presence_sessions", _with(sq.base_ctes(CFG4)) + f"""
SELECT site_id, mac_hash, session_start AS first_seen, max(timestamp) AS last_seen,
       count(*) AS sightings,
       CAST(sum(CASE WHEN dwell_s <= {float(CFG4.stationary_threshold)} THEN 1 ELSE 0 END) AS BIGINT) AS transient_sightings,
       {sq.r("(epoch_us(max(timestamp)) - epoch_us(session_start)) / 1e6")} AS dwell_s,
       (epoch_us(max(timestamp)) - epoch_us(session_start)) / 1e6 > {float(CFG4.stationary_threshold)} AS is_stationary
FROM fs GROUP BY site_id, mac_hash, session_start""")
def q_sessions(spark, sf_dir):
    raw = batch.raw_detections(spark, sf_dir)
    det = clean.rssi_filter(clean.fill_defaults(raw), CFG4)
    return present(presence.sessions(det, CFG4, scans=raw, dedupe=True))


@register("scan_presence_counts", _with(sq.base_ctes(CFG4)) + f"""
SELECT site_id, scan_id, timestamp, count(*) AS total_devices,
       count(*) FILTER (WHERE dwell_s <= {float(CFG4.stationary_threshold)}) AS transient_devices
FROM fs GROUP BY site_id, scan_id, timestamp""")
def q_scan_presence(spark, sf_dir):
    raw = batch.raw_detections(spark, sf_dir)
    det = clean.rssi_filter(clean.fill_defaults(raw), CFG4)
    return present(presence.scan_presence_counts(det, CFG4, scans=raw, dedupe=True))


# ------------------------------------------------------------- aggregation --

@register("scan_counts", _with(sq.base_ctes(CFG4)) + """
SELECT * FROM counts""")
def q_scan_counts(spark, sf_dir):
    tr = batch.transient_detections(spark, sf_dir, CFG4)
    return present(windows.scan_counts(tr, distinct=False))  # tr is de-duplicated per device and scan


@register("window_counts_4h", _with(sq.base_ctes(CFG4), sq.window_cte("win", CFG4, 4)) + f"""
{sq.with_time("win")}""",
          doubles=sq.WINDOW_DOUBLES)
def q_windows_4h(spark, sf_dir):
    return present(batch.window_table(spark, sf_dir, CFG4))


@register("window_counts_1h", _with(sq.base_ctes(CFG1), sq.window_cte("win", CFG1, 1)) + f"""
{sq.with_time("win")}""",
          doubles=sq.WINDOW_DOUBLES)
def q_windows_1h(spark, sf_dir):
    return present(batch.window_table(spark, sf_dir, CFG1))


CFG1_FULL = CFG1.with_(min_scans_per_window=4)  # only hours in which all four scans saw a device


@register("window_counts_1h_min_scans", _with(sq.base_ctes(CFG1_FULL), sq.window_cte("win", CFG1_FULL, 1)) + f"""
{sq.with_time("win")}""",
          doubles=sq.WINDOW_DOUBLES)
def q_windows_min_scans(spark, sf_dir):
    return present(batch.window_table(spark, sf_dir, CFG1_FULL))


@register("window_counts_1h_with_empty", _with(sq.base_ctes(CFG1), sq.window_cte("win", CFG1, 1).replace(
    f"HAVING count(*) >= {CFG1.min_scans_per_window}", "")) + """,
bounds AS (SELECT site_id, min(timestamp) AS lo, max(timestamp) AS hi FROM win GROUP BY site_id),
spine AS (SELECT site_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS timestamp FROM bounds),
filled AS (
  SELECT s.site_id, s.timestamp, w.avg_devices, w.std_devices, w.min_devices, w.max_devices,
         COALESCE(w.total_devices, 0) AS total_devices, COALESCE(w.num_scans, 0) AS num_scans
  FROM spine s LEFT JOIN win w ON s.site_id = w.site_id AND s.timestamp = w.timestamp)
""" + sq.with_time("filled"), doubles=sq.WINDOW_DOUBLES)
def q_windows_empty(spark, sf_dir):
    return present(batch.window_table(spark, sf_dir, CFG1, keep_empty=True))


@register("unique_devices_4h", _with(sq.base_ctes(CFG4)) + f"""
SELECT site_id, {sq.ts_bin('timestamp', 4 * 3600)} AS timestamp,
       count(DISTINCT mac_hash) AS unique_devices, count(*) AS detections
FROM transient GROUP BY ALL""")
def q_unique(spark, sf_dir):
    tr = batch.transient_detections(spark, sf_dir, CFG4)
    return present(windows.unique_devices(tr, CFG4))


@register("sliding_window_counts_4h_1h", _with(sq.base_ctes(CFG4)) + f"""
, starts AS (
  SELECT c.*, unnest(generate_series(
           (epoch_us(timestamp) // 3600000000) - 3, (epoch_us(timestamp) // 3600000000))) AS start_hour
  FROM counts c)
SELECT site_id, make_timestamp(start_hour * 3600000000) AS timestamp,
       avg(device_count) AS avg_devices, stddev_samp(device_count) AS std_devices,
       CAST(min(device_count) AS BIGINT) AS min_devices, CAST(max(device_count) AS BIGINT) AS max_devices,
       CAST(sum(device_count) AS BIGINT) AS total_devices, count(*) AS num_scans
FROM starts GROUP BY site_id, start_hour HAVING count(*) >= 1""", doubles=sq.WINDOW_DOUBLES)
def q_sliding(spark, sf_dir):
    tr = batch.transient_detections(spark, sf_dir, CFG4)
    return present(windows.sliding_window_counts(windows.scan_counts(tr, distinct=False), CFG4,
                                                 window_hours=4, slide_hours=1))


# ---------------------------------------------------------------- features --

def _ml_sql(cfg: Config, hours: int) -> str:
    return _with(sq.base_ctes(cfg), sq.window_cte("win0", cfg, hours),
                 f"\nwin AS ({sq.with_time('win0')})", sq.ml_cte("ml", cfg, "win"))


@register("ml_dataset_1h", _ml_sql(CFG1, 1) + """
SELECT * FROM ml""",
          doubles=[*sq.WINDOW_DOUBLES, *sq.feature_doubles(CFG1)])
def q_ml(spark, sf_dir):
    return present(batch.ml_table(spark, sf_dir, CFG1, 1))


@register("forecast_target_1h", _ml_sql(CFG1, 1) + f"""
, tgt AS (SELECT *, lead(avg_devices, {CFG1.forecast_horizon}) OVER (PARTITION BY site_id ORDER BY timestamp)
                 AS avg_devices_future FROM ml)
SELECT * FROM tgt WHERE avg_devices_future IS NOT NULL""",
          doubles=[*sq.WINDOW_DOUBLES, *sq.feature_doubles(CFG1), "avg_devices_future"])
def q_target(spark, sf_dir):
    return present(features.target(batch.ml_table(spark, sf_dir, CFG1, 1), CFG1))


@register("lag_features_4h", _with(sq.base_ctes(CFG4), sq.window_cte("win0", CFG4, 4),
                                   f"\nwin AS ({sq.with_time('win0')})") + f"""
SELECT *, {", ".join(f"lag(avg_devices, {n}) OVER (PARTITION BY site_id ORDER BY timestamp) AS avg_devices_lag_{n}h"
                     for n in CFG4.lag_periods)} FROM win""",
          doubles=[*sq.WINDOW_DOUBLES, *sq.feature_doubles(CFG4, rolling=False)])
def q_lags(spark, sf_dir):
    return present(features.lags(batch.window_table(spark, sf_dir, CFG4), CFG4))


@register("rolling_features_4h", _with(sq.base_ctes(CFG4), sq.window_cte("win0", CFG4, 4),
                                       f"\nwin AS ({sq.with_time('win0')})") + f"""
SELECT *, {sq.feature_cols_sql(CFG4.with_(lag_periods=()))} FROM win""",
          doubles=[*sq.WINDOW_DOUBLES, *sq.feature_doubles(CFG4, lags=False)])
def q_rolling(spark, sf_dir):
    return present(features.rolling(batch.window_table(spark, sf_dir, CFG4), CFG4))


@register("cyclic_features_4h", _with(sq.base_ctes(CFG4), sq.window_cte("win0", CFG4, 4),
                                      f"\nwin AS ({sq.with_time('win0')})") + """
SELECT *, sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos,
       sin(2 * pi() * day_of_week / 7) AS dow_sin, cos(2 * pi() * day_of_week / 7) AS dow_cos FROM win""",
          doubles=[*sq.WINDOW_DOUBLES, "hour_sin", "hour_cos", "dow_sin", "dow_cos"])
def q_cyclic(spark, sf_dir):
    return present(features.cyclic_features(batch.window_table(spark, sf_dir, CFG4)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# the other query groups register themselves on import
from passage.plans import registry_reports  # noqa: E402,F401
from passage.plans import registry_models  # noqa: E402,F401
from passage.plans import registry_streams  # noqa: E402,F401
from passage.plans import registry_stored  # noqa: E402,F401
