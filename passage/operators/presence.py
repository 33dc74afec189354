"""Stationary-device filtering (presence sessions).

Semantics of the live filter, re-stated for batch: a device's first
sighting opens a session; a later sighting stays in the session unless the
device was evicted in between; eviction happens at scan instants, when
``scan_time - last_seen > device_timeout``. A sighting is *transient* (kept)
iff ``timestamp - session_start <= stationary_threshold``.

Because eviction is only checked at scan instants (after the update of the
current scan), a session breaks at sighting ``t`` iff

    prev_scan(t) - prev_seen > device_timeout          (break_rule="scan")

where ``prev_scan(t)`` is the site's previous scan (empty ones included)
and ``prev_seen`` the device's previous sighting. ``break_rule="tick"`` takes
``prev_scan(t) = t - scan_interval`` (scanner running continuously, empty
scans not logged); ``break_rule="gap"`` uses ``t - prev_seen`` (no scan
instants known).

Scale: one device that never leaves may hold a large share of all rows, so a
device history is never sorted as a whole. Rows are windowed per
``(keys, mac_hash, bucket)`` (bucket = ``presence_bucket_seconds``), each
bucket is summarised to one row, the summaries are scanned per device (one
row per bucket — tiny), and the carried-in session start is joined back.
``prev_scan`` is a lag over a site's scans per bucket, with the previous
bucket's last scan patched in, so no site-long sort either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passage.config import Config
from passage.functions.timecols import seconds_between
from passage.operators import DEFAULT_KEYS
from passage.operators.clean import dedupe_strongest

BREAK_RULES = ("scan", "tick", "gap")


def _bucket(ts: str, seconds: int):
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)).cast("long")


def previous_scans(scans: DataFrame, cfg: Config, keys=DEFAULT_KEYS) -> DataFrame:
    """``(keys, timestamp, prev_scan)`` for every scan instant of a site."""
    keys = list(keys)
    sc = (scans.where(F.col("timestamp").isNotNull())
               .select(*keys, "timestamp", _bucket("timestamp", cfg.presence_bucket_seconds).alias("_b"))
               .distinct())
    w = Window.partitionBy(*keys, "_b").orderBy("timestamp")
    sc = sc.select("*", F.lag("timestamp").over(w).alias("_prev"))
    last = sc.groupBy(*keys, "_b").agg(F.max("timestamp").alias("_last"))
    last = last.select(*keys, "_b", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("_prev_last"))
    return (sc.join(last, [*keys, "_b"], "left")
              .select(*keys, "timestamp",
                      F.coalesce("_prev", "_prev_last").alias("prev_scan")))


def session_starts(det: DataFrame, cfg: Config, keys=DEFAULT_KEYS, break_rule: str = "scan",
                   scans: DataFrame | None = None, dedupe: bool = False,
                   carried: DataFrame | None = None) -> DataFrame:
    """Adds ``session_start`` (= first_seen of the sighting's session),
    ``dwell_s`` and ``is_transient`` to clean detections.

    ``carried`` (keys, mac_hash, first_seen, last_seen) holds the sessions
    still open when the detections begin (``open_sessions`` of the part
    before); with the ``scan`` rule, ``scans`` then needs the site's last scan
    of that part too.

    ``dedupe=True`` also applies the strongest-signal de-duplication; it
    then shares the ``(keys, mac_hash, bucket)`` exchange with the session
    windows (the bucket is a function of the scan time), so detections are
    shuffled once for both."""
    if break_rule not in BREAK_RULES:
        raise ValueError(f"break_rule must be one of {BREAK_RULES}")
    keys = list(keys)
    dev = [*keys, "mac_hash"]
    timeout = float(cfg.device_timeout)

    # detections without site / device / time cannot be attributed
    known = F.col("timestamp").isNotNull() & F.col("mac_hash").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    d = det.where(known).select("*", _bucket("timestamp", cfg.presence_bucket_seconds).alias("_b"))
    d = d.where(F.col("_b").isNotNull())  # stated, so both uses of d carry the same filters
    if break_rule == "scan":
        src = scans if scans is not None else det
        d = d.join(previous_scans(src, cfg, keys), [*keys, "timestamp"], "left")
        ref = F.col("prev_scan")
    elif break_rule == "tick":
        ref = F.timestamp_micros(F.unix_micros("timestamp") - F.lit(int(cfg.scan_interval * 1_000_000)))
    else:
        ref = F.col("timestamp")
    d = d.select("*", ref.alias("_ref")).repartition(*dev, "_b")
    if dedupe:
        # the pass-through columns close the tie-break order (arrival is
        # unique, so they never decide); both uses of d below then read the
        # same columns and Spark reuses this exchange for both
        kinds = dict(d.dtypes)
        rest = [c for c in d.columns if c not in {*dev, "_b", "_ref", "timestamp", "scan_id", "rssi", "arrival"}
                and kinds[c] != "binary" and not kinds[c].startswith(("array", "map", "struct"))]
        d = dedupe_strongest(d, [*keys, "_b"], then=rest)

    # level 1: inside one (device, bucket)
    wb = Window.partitionBy(*keys, "_b", "mac_hash").orderBy("timestamp", "scan_id")
    prev_seen = F.lag("timestamp").over(wb)
    d = d.select("*", (prev_seen.isNotNull() & (seconds_between("_ref", prev_seen) > F.lit(timeout)))
                 .alias("_brk"))
    d = d.select("*", F.max(F.when(F.col("_brk"), F.col("timestamp"))).over(
        wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_run_start"))

    # level 2: one row per (device, bucket), scanned per device
    summ = d.groupBy(*keys, "_b", "mac_hash").agg(
        F.min("timestamp").alias("_first"),
        F.max("timestamp").alias("_last"),
        F.min_by("_ref", "timestamp").alias("_first_ref"),
        F.max(F.when(F.col("_brk"), F.col("timestamp"))).alias("_last_brk"))
    if carried is not None:  # an open session is one more bucket before all others
        summ = summ.unionByName(carried.select(
            *keys, F.lit(-(1 << 63)).cast("long").alias("_b"), "mac_hash", F.col("first_seen").alias("_first"),
            F.col("last_seen").alias("_last"), F.lit(None).cast("timestamp").alias("_first_ref"),
            F.col("first_seen").alias("_last_brk")))
    wd = Window.partitionBy(*dev).orderBy("_b")
    prev_last = F.lag("_last").over(wd)
    head_brk = prev_last.isNull() | (seconds_between("_first_ref", prev_last) > F.lit(timeout))
    summ = summ.select("*", head_brk.alias("_head_brk"))
    summ = summ.select("*", F.coalesce(F.col("_last_brk"), F.when(F.col("_head_brk"), F.col("_first")))
                       .alias("_end_start"))  # latest session start in the bucket
    carry = F.last("_end_start", ignorenulls=True).over(wd.rowsBetween(Window.unboundedPreceding, -1))
    summ = summ.select(*dev, "_b", F.when(F.col("_head_brk"), F.col("_first")).otherwise(carry)
                       .alias("_head_start"))

    # every (device, bucket) of d has its summary row: the inner join is exact
    out = d.join(summ, [*keys, "_b", "mac_hash"], "inner")
    start = F.coalesce("_run_start", "_head_start")
    dwell = seconds_between("timestamp", start)
    keep = [c for c in det.columns if c not in ("_b", "prev_scan")]
    return out.select(*keep, start.alias("session_start"), dwell.alias("dwell_s"),
                      (dwell <= F.lit(float(cfg.stationary_threshold))).alias("is_transient"))


def open_sessions(starts: DataFrame, cfg: Config, keys=DEFAULT_KEYS, break_rule: str = "scan", cut=None,
                  last_scans: DataFrame | None = None, carried: DataFrame | None = None) -> DataFrame:
    """(keys, mac_hash, first_seen, last_seen) of the sessions that a later
    sighting could still continue, from rows with ``session_start`` that end
    at ``cut`` (``datetime``; rows from then on are the next part's).

    A session is over once the earliest instant that can stand against its
    last sighting is more than the timeout away: the site's last scan
    (``last_scans``: keys, last_scan), or the cut for the other two rules.
    What is carried therefore holds the devices of one timeout, not all
    devices ever seen."""
    keys = list(keys)
    dev = [*keys, "mac_hash"]
    seen = starts.groupBy(*dev).agg(F.max_by("session_start", "timestamp").alias("first_seen"),
                                    F.max("timestamp").alias("last_seen"))
    if carried is not None:  # a device that was seen again comes with its later sighting
        both = seen.unionByName(carried.select(*seen.columns))
        seen = both.groupBy(*dev).agg(F.max_by("first_seen", "last_seen").alias("first_seen"),
                                      F.max("last_seen").alias("last_seen"))
    if break_rule == "scan":
        seen = seen.join(last_scans.select(*keys, F.col("last_scan").alias("_ref")), keys, "left")
    else:
        back = cfg.scan_interval if break_rule == "tick" else 0
        seen = seen.withColumn("_ref", F.timestamp_micros(
            F.unix_micros(F.lit(cut).cast("timestamp")) - F.lit(int(back * 1_000_000))))
    over = seconds_between("_ref", "last_seen") > F.lit(float(cfg.device_timeout))
    return seen.where(~F.coalesce(over, F.lit(False))).select(*dev, "first_seen", "last_seen")


def transient_only(det: DataFrame, cfg: Config, keys=DEFAULT_KEYS, break_rule: str = "scan",
                   scans: DataFrame | None = None, dedupe: bool = False) -> DataFrame:
    """Sightings of devices passing by (stationary ones removed)."""
    s = session_starts(det, cfg, keys, break_rule, scans, dedupe)
    return s.where(F.col("is_transient")).select(*[c for c in s.columns
                                                   if c not in ("session_start", "dwell_s", "is_transient")])


def sessions(det: DataFrame, cfg: Config, keys=DEFAULT_KEYS, break_rule: str = "scan",
             scans: DataFrame | None = None, dedupe: bool = False) -> DataFrame:
    """One row per presence session: first/last seen, dwell, sightings,
    stationary flag (dwell beyond the threshold)."""
    keys = list(keys)
    s = session_starts(det, cfg, keys, break_rule, scans, dedupe)
    return (s.groupBy(*keys, "mac_hash", F.col("session_start").alias("first_seen"))
             .agg(F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("sightings"),
                  F.sum(F.col("is_transient").cast("long")).alias("transient_sightings"))
             .withColumn("dwell_s", seconds_between("last_seen", "first_seen"))
             .withColumn("is_stationary", F.col("dwell_s") > F.lit(float(cfg.stationary_threshold))))


def scan_presence_counts(det: DataFrame, cfg: Config, keys=DEFAULT_KEYS, break_rule: str = "scan",
                         scans: DataFrame | None = None, dedupe: bool = False) -> DataFrame:
    """Per scan: devices seen and devices kept as transient."""
    keys = list(keys)
    s = session_starts(det, cfg, keys, break_rule, scans, dedupe)
    return (s.groupBy(*keys, "scan_id", "timestamp")
             .agg(F.count(F.lit(1)).alias("total_devices"),
                  F.count_if(F.col("is_transient")).alias("transient_devices")))
