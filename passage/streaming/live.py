"""Live operators on Structured Streaming.

* ``live_clean``            — threshold + strongest-signal de-duplication on
  scan records, row-local (higher-order functions), append.
* ``live_transient``        — stationary filter with keyed state per
  ``(site, device)`` and event-time eviction (``applyInPandasWithState``);
  the *gap* break rule (a stream sees no empty scans).
* ``live_window_counts``    — watermarked tumbling windows of per-scan
  device counts (row-local ``device_count`` on scan records).
* ``live_detection_windows``— the same from flat detections: duplicates
  dropped within the watermark, per-scan counts, then windows (chained
  time-window aggregations).
* ``live_sessions``         — presence sessions by ``session_window``.
* ``start_snapshot_refresh``— periodic re-scoring into versioned snapshots
  (``foreachBatch``, published by a manifest).
Checkpoints live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from passage.config import Config
from passage.functions.signal import passes_rssi
from passage.operators import DEFAULT_KEYS
from passage.operators.clean import clean_nested, drop_empty_scans
from passage.operators.windows import _stats, scan_counts_nested
from passage.session import scratch_path
from passage.sinks import folders
from passage.sinks.files import append_scans


def live_clean(scans: DataFrame, cfg: Config, log_empty: bool | None = None) -> DataFrame:
    out = clean_nested(scans, cfg)
    keep_empty = cfg.log_empty_scans if log_empty is None else log_empty
    return out if keep_empty else drop_empty_scans(out)


TRANSIENT_STATE = "first_seen_us long, last_seen_us long, seen_us array<long>"


def _transient_fn(cfg: Config, out_cols: list[str]):
    timeout_us = int(cfg.device_timeout * 1_000_000)
    threshold_us = int(cfg.stationary_threshold * 1_000_000)

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frames = [p for p in pdfs if len(p)]
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        first, last, seen = state.get if state.exists else (None, None, [])
        us = pdf["timestamp"].astype("datetime64[us]").astype("int64").to_numpy()
        reading = pdf["rssi"].astype("float64").fillna(-np.inf).to_numpy()
        arrival = pdf["arrival"].to_numpy() if "arrival" in pdf.columns else np.zeros(len(pdf))
        # one sighting per scan: strongest reading of the batch, then first arrival; a scan
        # that an earlier batch has passed on keeps that batch's reading
        order = np.lexsort((arrival, -reading, us))
        t = us[order]
        keep = np.ones(len(t), bool)
        keep[1:] = t[1:] != t[:-1]
        keep &= ~np.isin(t, np.array(seen, dtype="int64"))
        order, t = order[keep], t[keep]
        if not len(t):
            return
        low = np.iinfo(np.int64).min
        latest = np.maximum.accumulate(np.concatenate([[low if last is None else last], t]))
        breaks = np.zeros(len(t), bool)
        breaks[0] = first is None
        breaks |= (latest[:-1] != low) & (t - np.where(latest[:-1] == low, t, latest[:-1]) > timeout_us)
        at = np.maximum.accumulate(np.where(breaks, np.arange(len(t)), -1))
        start = np.where(at >= 0, t[np.maximum(at, 0)], 0 if first is None else first)
        last = int(latest[-1])
        # scans a repeat could still arrive for before the state is evicted
        recent = [int(x) for x in [*seen, *t.tolist()] if x >= last - timeout_us]
        state.update((int(start[-1]), last, recent))
        state.setTimeoutTimestamp(last // 1000 + timeout_us // 1000)
        out = pdf.iloc[order[t - start <= threshold_us]]
        if len(out):
            yield out[out_cols]

    return fn


def live_transient(det: DataFrame, cfg: Config, watermark: str = "6 hours",
                   keys=DEFAULT_KEYS) -> DataFrame:
    """Transient sightings from a stream of clean detections. State per
    ``(keys, mac_hash)`` = (first_seen, last_seen); a sighting more than
    ``device_timeout`` after the last one starts a new session; state is
    evicted once the watermark passes ``last_seen + device_timeout``. Rows
    later than the watermark are dropped by Spark."""
    cols = list(det.columns)
    d = det.withWatermark("timestamp", watermark)
    return d.groupBy(*keys, "mac_hash").applyInPandasWithState(
        _transient_fn(cfg, cols), outputStructType=det.schema, stateStructType=TRANSIENT_STATE,
        outputMode="append", timeoutConf=GroupStateTimeout.EventTimeTimeout)


def live_window_counts(scans: DataFrame, cfg: Config, watermark: str = "1 hour",
                       keys=DEFAULT_KEYS, window_hours: int | None = None) -> DataFrame:
    """Windows of clean scan records; a window is emitted once the watermark
    passes its end (append)."""
    h = window_hours or cfg.window_hours
    c = scan_counts_nested(scans).withWatermark("timestamp", watermark)
    return (c.groupBy(*keys, F.window("timestamp", f"{h} hours").alias("w")).agg(*_stats())
             .select(*keys, F.col("w.start").alias("timestamp"), "avg_devices", "std_devices", "min_devices",
                     "max_devices", "total_devices", "num_scans")
             .where(F.col("num_scans") >= F.lit(cfg.min_scans_per_window)))


def live_detection_windows(det: DataFrame, cfg: Config, watermark: str = "1 hour", keys=DEFAULT_KEYS,
                           window_hours: int | None = None) -> DataFrame:
    """Windows from flat detections: devices de-duplicated per scan within
    the watermark, counted per scan (15-minute scan bins of the events
    adapter use the scan timestamp), then aggregated into windows."""
    h = window_hours or cfg.window_hours
    d = (det.where(passes_rssi(F.col("rssi"), F.col("protocol"), cfg.rssi_threshold))
            .withWatermark("timestamp", watermark)
            .dropDuplicatesWithinWatermark([*keys, "timestamp", "mac_hash"]))
    per_scan = (d.groupBy(*keys, F.window("timestamp", f"{cfg.scan_interval} seconds").alias("scan"))
                 .agg(F.count(F.lit(1)).alias("device_count")))
    return (per_scan.groupBy(*keys, F.window("scan", f"{h} hours").alias("w")).agg(*_stats())
                    .select(*keys, F.col("w.start").alias("timestamp"), "avg_devices", "std_devices",
                            "min_devices", "max_devices", "total_devices", "num_scans")
                    .where(F.col("num_scans") >= F.lit(cfg.min_scans_per_window)))


def live_sessions(det: DataFrame, cfg: Config, watermark: str = "6 hours", keys=DEFAULT_KEYS) -> DataFrame:
    """Presence sessions closed by a silence longer than ``device_timeout``.
    Sessions are merged before the exchange, so a chatty device sends a row a
    session and task instead of all its sightings."""
    det.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    gap = f"{cfg.device_timeout} seconds"
    return (det.withWatermark("timestamp", watermark)
               .groupBy(*keys, "mac_hash", F.session_window("timestamp", gap).alias("s"))
               .agg(F.count(F.lit(1)).alias("sightings"), F.min("timestamp").alias("first_seen"),
                    F.max("timestamp").alias("last_seen"))
               .select(*keys, "mac_hash", "first_seen", "last_seen", "sightings",
                       ((F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6).alias("dwell_s")))


def start_scan_log(scans: DataFrame, out_path: str, name: str, fmt: str = "json",
                   trigger: str | None = None):
    """Streaming twin of ``sinks.files.append_scans``, into the same log:
    each micro-batch is a write named by the query and its epoch, so a batch that
    is replayed after a failure replaces what it had written."""
    spark = scans.sparkSession
    ckpt = scratch_path(spark, f"streams/{name}/checkpoint")

    def write(batch: DataFrame, epoch_id: int) -> None:
        append_scans(batch, out_path, log_empty=True, fmt=fmt,
                     write_id=f"s{query_id(batch.sparkSession, ckpt)}-{epoch_id}")

    w = scans.writeStream.foreachBatch(write).option("checkpointLocation", ckpt)
    return w.trigger(processingTime=trigger).start() if trigger else w.trigger(availableNow=True).start()


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the query a checkpoint belongs to: the same after a restart,
    another one for a new checkpoint (whose epochs count from 0 again)."""
    return json.loads(folders.read_small(spark, f"{checkpoint}/metadata"))["id"]


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, available_now: bool = True,
                 fmt: str = "parquet"):
    """Run a stream into a fresh ``<checkpoint dir>/streams/<name>-<id>``
    folder (append) with its own checkpoint; with ``available_now`` process what is there and
    stop. Returns the output path."""
    run = f"streams/{name}-{uuid.uuid4().hex[:12]}"
    out = scratch_path(spark, f"{run}/data")
    ckpt = scratch_path(spark, f"{run}/checkpoint")
    w = stream.writeStream.format(fmt).option("path", out).option("checkpointLocation", ckpt).outputMode("append")
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    if available_now:
        q.awaitTermination()
    return out, q


#: Published snapshots that stay for readers that hold an older one.
KEPT_SNAPSHOTS = 3


def _published(spark: SparkSession, path: str) -> list[dict]:
    """Manifests of the published snapshots, oldest first."""
    return [json.loads(folders.read_small(spark, f)) for f in folders.matching(spark, f"{path}/manifest/v*")]


def read_snapshot(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The newest published snapshot, or None before the first one."""
    known = _published(spark, path)
    if not known:
        return None
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(f"{path}/data/{known[-1]['folder']}")


def publish_snapshot(new: DataFrame, path: str, query: str, epoch_id: int, keys=DEFAULT_KEYS) -> bool:
    """One epoch into the snapshot table: the keys in ``new`` are renewed, all
    others keep their rows.

    The whole version is written to a folder named by query and epoch, then
    a manifest with the next number makes it the current one in one rename;
    old versions go last. Stopped before the rename, readers and the replay
    see the version before; stopped after it, the replay finds its epoch
    published and does nothing (False)."""
    spark = new.sparkSession
    known = _published(spark, path)
    if any(m["query"] == query and m["epoch"] >= epoch_id for m in known):
        return False
    old = read_snapshot(spark, path, new.schema)
    merged = new
    if old is not None:  # one pass over the scored rows: a key's new rows hide its old ones
        both = new.withColumn("_new", F.lit(True)).unionByName(old.withColumn("_new", F.lit(False)))
        renewed = F.max("_new").over(Window.partitionBy(*keys))
        merged = both.withColumn("_renewed", renewed).where(F.col("_new") | ~F.col("_renewed")).drop("_new", "_renewed")
    folder = f"{query}-{epoch_id}"
    merged.write.mode("overwrite").parquet(f"{path}/data/{folder}")
    number = known[-1]["version"] + 1 if known else 0
    folders.publish(spark, f"{path}/manifest/v{number:012d}",
                    json.dumps({"version": number, "query": query, "epoch": epoch_id, "folder": folder}))
    for m in known[:max(0, len(known) + 1 - KEPT_SNAPSHOTS)]:  # a manifest goes before its rows
        folders.remove(spark, f"{path}/manifest/v{m['version']:012d}")
        folders.remove(spark, f"{path}/data/{m['folder']}")
    return True


def start_snapshot_refresh(windows_stream: DataFrame, score, out_path: str, name: str,
                           interval: str = "60 seconds", keys=DEFAULT_KEYS):
    """Every ``interval``: score the newest windows with ``score(batch_df)``
    (e.g. ``snapshot.score_latest`` with fitted models) and renew those sites
    in the snapshot table at ``out_path`` (``read_snapshot`` reads it); sites
    without news keep their row. Each trigger writes one version."""
    ckpt = scratch_path(windows_stream.sparkSession, f"streams/{name}/checkpoint")

    def refresh(batch: DataFrame, epoch_id: int) -> None:
        if not batch.isEmpty():
            publish_snapshot(score(batch), out_path, query_id(batch.sparkSession, ckpt), epoch_id, keys)

    return (windows_stream.writeStream.foreachBatch(refresh).option("checkpointLocation", ckpt)
            .trigger(processingTime=interval).start())
