"""Registered queries through stored tables: the scan log (written, read
back, restricted, exploded, cleaned row by row), days processed one part at
a time, panes, device sketches, counted drops and retention by folder.

Each writes what it derives from ``events`` to the session's shared folder,
under a fresh name, and reads it back.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from passage.functions.present import present
from passage.operators import clean, declared, features, windows
from passage.plans import batch, incremental
from passage.plans import sqltwins as sq
from passage.plans.catalog import CFG1, CFG4, _with, register
from passage.session import ensure_utc, scratch_path
from passage.sinks import files, folders
from passage.sources import scans as scan_source
from passage.sources.events import events_to_detections, read_table

#: Parts in which the incremental query processes the days of the table.
PARTS = 3
FIRST_DAYS = 10


def _fresh(spark, name: str) -> str:
    return scratch_path(ensure_utc(spark), f"stored/{name}-{uuid.uuid4().hex[:12]}")


def scan_records(raw):
    """Raw detections as scan records: a row a scan, devices in arrival order."""
    dev = F.struct("arrival", "mac_hash", "rssi", "protocol")
    devices = F.transform(F.array_sort(F.collect_list(dev)),
                          lambda d: F.struct(d["mac_hash"].alias("mac_hash"), d["rssi"].alias("rssi"),
                                             d["protocol"].alias("protocol")))
    return (raw.groupBy("site_id", "timestamp", "scan_id").agg(devices.alias("devices"))
               .withColumn("device_count", F.size("devices").cast("int")))


# --------------------------------------------------------------- scan log --

@register("scan_log_clean", _with(sq.base_ctes(CFG4)) + """
SELECT site_id, timestamp, scan_id, mac_hash, rssi, protocol FROM det""")
def q_scan_log_clean(spark, sf_dir):
    """Scans cleaned row by row, the empty ones skipped, written as JSON lines
    by site and day, read back and exploded."""
    path = _fresh(spark, "scan_log")
    files.append_scans(clean.clean_nested(scan_records(batch.raw_detections(spark, sf_dir)), CFG4), path)
    det = windows.explode_devices(scan_source.read_scans(spark, path, glob=None))
    return present(det.select("site_id", "timestamp", "scan_id", "mac_hash", "rssi", "protocol"))


@register("scan_log_range_counts", _with(sq.base_ctes(CFG4)) + """,
n AS (SELECT site_id, timestamp, scan_id, count(*) AS logged_devices, count(DISTINCT mac_hash) AS device_count
      FROM raw GROUP BY ALL)
SELECT site_id, timestamp, scan_id, logged_devices, device_count FROM n
WHERE timestamp >= TIMESTAMP '2024-01-08 06:00:00' AND timestamp <= TIMESTAMP '2024-01-15 00:00:00'""")
def q_scan_log_range(spark, sf_dir):
    """Uncleaned scans of a range of dates from the log (a bare end date is its
    midnight), with stored and recomputed device counts."""
    path = _fresh(spark, "scan_log")
    files.append_scans(scan_records(batch.raw_detections(spark, sf_dir)), path)
    scans = scan_source.read_scans(spark, path, start="2024-01-08 06:00:00", end="2024-01-15", glob=None)
    out = windows.scan_counts_nested(scans.withColumn("logged_devices", F.col("device_count").cast("long")))
    return present(out.select("site_id", "timestamp", "scan_id", "logged_devices", "device_count"))


@register("scan_log_retained", _with(sq.base_ctes(CFG4)) + f""",
days AS (SELECT site_id, CAST(timestamp AS DATE) AS scan_date, count(DISTINCT (timestamp, scan_id)) AS scans
         FROM raw GROUP BY ALL),
cut AS (SELECT max(scan_date) + INTERVAL {CFG4.raw_retention_days // 2} DAY
               - INTERVAL {CFG4.raw_retention_days} DAY AS cutoff FROM days)
SELECT site_id, scan_date, scans FROM days, cut WHERE scan_date + INTERVAL 1 DAY > cutoff""")
def q_scan_log_retained(spark, sf_dir):
    """What the retention job leaves of the log half a retention period after
    the newest day: scans by site and date folder."""
    path = _fresh(spark, "scan_log")
    files.append_scans(scan_records(batch.raw_detections(spark, sf_dir)), path)
    days = [folders.partition_value(p, "scan_date") for p in folders.matching(spark, f"{path}/site_id=*/scan_date=*")]
    newest = max(days, default="1970-01-01")
    now = dt.datetime.fromisoformat(newest) + dt.timedelta(days=CFG4.raw_retention_days // 2)
    declared.retention_job(spark, path, f"{path}-none", CFG4, now, listed_at=f"{path}-gone")
    scans = scan_source.read_scans(spark, path, glob=None)
    return scans.groupBy("site_id", "scan_date").agg(F.count(F.lit(1)).alias("scans"))


# -------------------------------------------------------------- increments --

def _days_table(spark, sf_dir, table: str):
    """The table of the incremental job after running the days in parts."""
    ensure_utc(spark)
    events = read_table(spark, sf_dir, "events")
    lo, hi = events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    raw = events_to_detections(events)
    like = clean.fill_defaults(raw)
    path = _fresh(spark, "days")
    if lo is None:
        lo = hi = dt.date(1970, 1, 1)
    span = (hi - lo).days + 1
    cuts = sorted({lo + dt.timedelta(days=span * i // PARTS) for i in range(PARTS + 1)})
    for start, end in zip(cuts, cuts[1:]):
        incremental.run_days(raw, path, CFG4, start, end)
    if table == "windows":
        like = batch.process_detections(like, CFG4, deduped=True)
    return incremental.read_days(spark, path, table, like).drop("scan_date")


@register("incremental_transient_detections", _with(sq.base_ctes(CFG4)) + """
SELECT site_id, timestamp, scan_id, mac_hash, rssi, protocol FROM transient""")
def q_incremental(spark, sf_dir):
    """The stationary filter over the days in parts, open sessions carried."""
    return present(_days_table(spark, sf_dir, "transient").select(
        "site_id", "timestamp", "scan_id", "mac_hash", "rssi", "protocol"))


@register("incremental_window_counts_4h", _with(sq.base_ctes(CFG4), sq.window_cte("win", CFG4, 4)) + f"""
{sq.with_time("win")}""", doubles=sq.WINDOW_DOUBLES)
def q_incremental_windows(spark, sf_dir):
    """Windows that the incremental job wrote by date."""
    return present(_days_table(spark, sf_dir, "windows"))


# -------------------------------------------------- panes, sketches, drops --

@register("sliding_window_counts_24h_1h", _with(sq.base_ctes(CFG4)) + """
, starts AS (
  SELECT c.*, unnest(generate_series(
           (epoch_us(timestamp) // 3600000000) - 23, (epoch_us(timestamp) // 3600000000))) AS start_hour
  FROM counts c)
SELECT site_id, make_timestamp(start_hour * 3600000000) AS timestamp,
       avg(device_count) AS avg_devices, stddev_samp(device_count) AS std_devices,
       CAST(min(device_count) AS BIGINT) AS min_devices, CAST(max(device_count) AS BIGINT) AS max_devices,
       CAST(sum(device_count) AS BIGINT) AS total_devices, count(*) AS num_scans
FROM starts GROUP BY site_id, start_hour HAVING count(*) >= 1""", doubles=sq.WINDOW_DOUBLES)
def q_sliding_24h(spark, sf_dir):
    """A day's window at every hour, merged from hourly panes."""
    tr = batch.transient_detections(spark, sf_dir, CFG4)
    return present(windows.sliding_window_counts(windows.scan_counts(tr, distinct=False), CFG4,
                                                 window_hours=24, slide_hours=1))


SPANS = {"4h": 4, "day": 24, "week": 168}


@register("unique_devices_sketched", _with(sq.base_ctes(CFG4)) + "\n" + "\nUNION ALL\n".join(f"""
SELECT site_id, '{name}' AS span, {sq.ts_bin('timestamp', h * 3600)} AS timestamp,
       count(DISTINCT mac_hash) AS unique_devices, count(*) AS detections, TRUE AS within_bound
FROM transient GROUP BY ALL""" for name, h in SPANS.items()))
def q_sketched(spark, sf_dir):
    """Hourly device sketches, written, and united over 4 hours, days and
    weeks; each estimate is held against the exact count and its bound."""
    tr = batch.transient_detections(spark, sf_dir, CFG4).select("site_id", "timestamp", "mac_hash")
    path = _fresh(spark, "sketches")
    windows.device_sketches(tr).write.parquet(path)
    stored = spark.read.parquet(path)
    out = None
    for name, h in SPANS.items():
        exact = windows.unique_devices(tr, CFG4, window_hours=h)
        est = windows.unite_sketches(stored, h).select("site_id", "timestamp", F.col("unique_devices").alias("_est"),
                                                       F.col("detections").alias("_det"))
        off = F.abs(F.col("_est") - F.col("unique_devices"))
        row = exact.join(est, ["site_id", "timestamp"], "full").select(
            "site_id", F.lit(name).alias("span"), "timestamp", "unique_devices", "detections",
            ((off <= F.greatest(F.lit(1.0), F.lit(windows.sketch_error()) * F.col("unique_devices")))
             & (F.col("_det") == F.col("detections"))).alias("within_bound"))
        out = row if out is None else out.unionByName(row)
    return present(out)


@register("ml_dropped_rows", _with(sq.base_ctes(CFG1), sq.window_cte("win0", CFG1, 1),
                                   f"\nwin AS ({sq.with_time('win0')})", sq.ml_cte("ml", CFG1, "win")) + """
SELECT w.n AS rows_read, m.n AS rows_kept, w.n - m.n AS rows_dropped
FROM (SELECT count(*) AS n FROM win) w, (SELECT count(*) AS n FROM ml) m""")
def q_ml_dropped(spark, sf_dir):
    """Windows that don't reach the ML dataset, counted while it is written."""
    path, seen = _fresh(spark, "ml"), Observation()
    win = batch.window_table(spark, sf_dir, CFG1, 1)
    files.write_dataset(win, f"{path}/windows")
    stored = scan_source.read_dataset(spark, f"{path}/windows").select(*win.columns)
    features.ml_dataset(stored, CFG1, seen=seen).write.parquet(f"{path}/ml")
    kept = int(seen.get["kept"])
    return stored.agg(F.count(F.lit(1)).alias("rows_read")).select(
        "rows_read", F.lit(kept).cast("long").alias("rows_kept"), (F.col("rows_read") - F.lit(kept)).alias("rows_dropped"))
