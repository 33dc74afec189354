"""SQL twins (DuckDB dialect) of the registered queries.

They re-state each query's semantics independently of the DataFrame code —
e.g. presence sessions by one site-wide lag and a running sum instead of
the bucketed two-level scan — over the same ``events`` adapter.
"""

from __future__ import annotations

from passage.config import Config
from passage.sources.events import EVENTS_DETECTIONS_SQL


def r(x: str) -> str:
    """Comparison rounding, same as ``functions.present.rounded``."""
    return f"round(({x}) + 1e-9, 6)"


def rounded(sql: str, doubles) -> str:
    """Wrap a query so its DOUBLE columns are rounded like ``present``."""
    doubles = list(doubles)
    if not doubles:
        return sql
    rep = ", ".join(f"{r(c)} AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"


WINDOW_DOUBLES = ("avg_devices", "std_devices")


def feature_doubles(cfg: Config, v: str = "avg_devices", lags: bool = True, rolling: bool = True) -> list[str]:
    out = []
    if lags:
        out += [f"{v}_lag_{n}h" for n in cfg.lag_periods]
    if rolling:
        out += [f"{v}_rolling_{n}h_{s}" for n in cfg.rolling_windows for s in cfg.rolling_stats]
    return out


def ts_bin(col: str, seconds: int) -> str:
    us = seconds * 1_000_000
    return f"make_timestamp((epoch_us({col}) // {us}) * {us})"


def time_cols(ts: str = "timestamp") -> str:
    return (f"CAST(hour({ts}) AS INTEGER) AS hour, CAST(isodow({ts}) - 1 AS INTEGER) AS day_of_week, "
            f"CAST(month({ts}) AS INTEGER) AS month, isodow({ts}) >= 6 AS is_weekend")


def base_ctes(cfg: Config) -> str:
    """raw → det (clean) → scans → prev → brk → sess → fs (session start)."""
    timeout_us = int(cfg.device_timeout * 1_000_000)
    return f"""
raw AS ({EVENTS_DETECTIONS_SQL}),
det AS (
  SELECT site_id, timestamp, scan_id, mac_hash, rssi, protocol, arrival FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id, scan_id, timestamp, mac_hash
                                 ORDER BY rssi DESC NULLS LAST, arrival) AS rn
    FROM raw
    WHERE (rssi IS NULL AND protocol = 'classic') OR rssi >= {cfg.rssi_threshold}) t
  WHERE rn = 1),
scans AS (SELECT DISTINCT site_id, timestamp FROM raw),
prev AS (SELECT site_id, timestamp, lag(timestamp) OVER (PARTITION BY site_id ORDER BY timestamp) AS prev_scan
         FROM scans),
brk AS (
  SELECT d.*, p.prev_scan,
         lag(d.timestamp) OVER (PARTITION BY d.site_id, d.mac_hash ORDER BY d.timestamp, d.scan_id) AS prev_seen
  FROM det d LEFT JOIN prev p ON d.site_id = p.site_id AND d.timestamp = p.timestamp),
sess AS (
  SELECT *, sum(CASE WHEN prev_seen IS NULL OR epoch_us(prev_scan) - epoch_us(prev_seen) > {timeout_us}
                     THEN 1 ELSE 0 END)
            OVER (PARTITION BY site_id, mac_hash ORDER BY timestamp, scan_id ROWS UNBOUNDED PRECEDING) AS sid
  FROM brk),
fs AS (
  SELECT *, min(timestamp) OVER (PARTITION BY site_id, mac_hash, sid) AS session_start,
         (epoch_us(timestamp) - epoch_us(min(timestamp) OVER (PARTITION BY site_id, mac_hash, sid))) / 1e6 AS dwell_s
  FROM sess),
transient AS (
  SELECT site_id, timestamp, scan_id, mac_hash, rssi, protocol, arrival FROM fs
  WHERE dwell_s <= {float(cfg.stationary_threshold)}),
counts AS (
  SELECT site_id, scan_id, timestamp, count(DISTINCT mac_hash) AS device_count
  FROM transient GROUP BY site_id, scan_id, timestamp)"""


def window_cte(name: str, cfg: Config, hours: int, src: str = "counts") -> str:
    return f"""
{name} AS (
  SELECT site_id, {ts_bin('timestamp', hours * 3600)} AS timestamp,
         avg(device_count) AS avg_devices, stddev_samp(device_count) AS std_devices,
         CAST(min(device_count) AS BIGINT) AS min_devices, CAST(max(device_count) AS BIGINT) AS max_devices,
         CAST(sum(device_count) AS BIGINT) AS total_devices, count(*) AS num_scans
  FROM {src} GROUP BY ALL HAVING count(*) >= {cfg.min_scans_per_window})"""


def with_time(src: str) -> str:
    return f"SELECT *, {time_cols()} FROM {src}"


def feature_cols_sql(cfg: Config, v: str = "avg_devices") -> str:
    w = "PARTITION BY site_id ORDER BY timestamp"
    cols = [f"lag({v}, {n}) OVER ({w}) AS {v}_lag_{n}h" for n in cfg.lag_periods]
    fns = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    for n in cfg.rolling_windows:
        for s in cfg.rolling_stats:
            cols.append(f"{fns[s]}({v}) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) "
                        f"AS {v}_rolling_{n}h_{s}")
    return ", ".join(cols)


def not_null_all(cols: list[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


def ml_columns(cfg: Config, v: str = "avg_devices") -> list[str]:
    base = ["site_id", "timestamp", "avg_devices", "std_devices", "min_devices", "max_devices",
            "total_devices", "num_scans", "hour", "day_of_week", "month", "is_weekend"]
    base += [f"{v}_lag_{n}h" for n in cfg.lag_periods]
    base += [f"{v}_rolling_{n}h_{s}" for n in cfg.rolling_windows for s in cfg.rolling_stats]
    return base


def ml_cte(name: str, cfg: Config, src: str) -> str:
    cols = ml_columns(cfg)
    return f"""
{name}_wide AS (SELECT *, {feature_cols_sql(cfg)} FROM {src}),
{name} AS (SELECT * FROM {name}_wide WHERE {not_null_all(cols)})"""
