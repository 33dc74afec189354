"""The stationary filter carried from day to day.

A run reads the sightings of its days and the sessions left open by the day
before, never the history: it rewrites the date folders of its days and
leaves the open sessions for the next run. Any split of the days gives the
rows of one run over all of them, with devices open across the cuts.

Below ``path``:

* ``transient/site_id=…/scan_date=…`` — sightings of devices passing by;
* ``windows/site_id=…/scan_date=…``   — their windows (a window lies in a day);
* ``open/as_of=<date>``               — sessions open at that midnight;
* ``last_scan/as_of=<date>``          — each site's last scan before it;
* ``done/<date>``                     — marker: the state of that midnight is whole.

The marker is set last. A run that was stopped is repeated and replaces what
it had written; a run over days that were done before withdraws the markers
after its first day, as all later days depend on it (they are run again).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passage.config import Config
from passage.operators import DEFAULT_KEYS, clean, presence
from passage.plans.batch import process_detections
from passage.session import ensure_utc
from passage.sinks import folders

DEVICE = "mac_hash string, first_seen timestamp, last_seen timestamp"


def _keyed(keys, rest: str) -> str:
    return ", ".join([*[f"{k} string" for k in keys], rest])


def marks(spark: SparkSession, path: str) -> list[dt.date]:
    """The midnights whose state is whole, in order."""
    return [dt.date.fromisoformat(p.rsplit("/", 1)[-1]) for p in folders.matching(spark, f"{path}/done/*-*-*")]


def next_day(spark: SparkSession, path: str) -> dt.date | None:
    """The first day that has not been processed (None: no day has)."""
    known = marks(spark, path)
    return known[-1] if known else None


def run_days(raw: DataFrame, path: str, cfg: Config, start: dt.date, end: dt.date, keys=DEFAULT_KEYS,
             break_rule: str = "scan") -> None:
    """Process the sightings of ``start <= day < end``.

    ``raw`` are uncleaned detections with ``timestamp`` (their filter on the
    days is pushed to the source); every one of them counts as a scan of its
    site. The first run of a path may start anywhere. A later one must start
    at a midnight that has a marker, so that no day is left out or counted
    twice; days without sightings are passed over by running them. Rows without
    site, device or time can't be attributed and are left out."""
    spark = ensure_utc(raw.sparkSession)
    if end <= start:
        raise ValueError("end must lie after start")
    if 24 % cfg.window_hours:
        raise ValueError("windows must divide a day to be rewritten by date")
    keys = list(keys)
    known = marks(spark, path)
    if known and start not in known:
        raise ValueError(f"no state at {start}: start at one of {known[0]} to {known[-1]}")
    for mark in known:  # what depends on the days to come is no longer valid
        if mark > start:
            folders.remove(spark, f"{path}/done/{mark}")
    for table in ("transient", "windows"):
        for old in folders.matching(spark, "/".join([path, table, *[f"{k}=*" for k in keys], "scan_date=*"])):
            if str(start) <= (folders.partition_value(old, "scan_date") or "") < str(end):
                folders.remove(spark, old)

    day = F.to_date("timestamp")
    part = raw.where((F.col("timestamp") >= F.lit(str(start)).cast("timestamp"))
                     & (F.col("timestamp") < F.lit(str(end)).cast("timestamp")))
    for k in keys:
        part = part.where(F.col(k).isNotNull())
    carried, scans = None, part.select(*keys, "timestamp")
    if known:
        carried = spark.read.schema(_keyed(keys, DEVICE)).parquet(f"{path}/open/as_of={start}")
        before = spark.read.schema(_keyed(keys, "last_scan timestamp")).parquet(f"{path}/last_scan/as_of={start}")
        scans = scans.unionByName(before.select(*keys, F.col("last_scan").alias("timestamp")))

    det = clean.rssi_filter(clean.fill_defaults(part), cfg)
    starts = presence.session_starts(det, cfg, keys, break_rule, scans=scans, dedupe=True, carried=carried)
    # sessions are found once: the sightings, the windows and the state below read this table
    work = f"{path}/work/{start}_{end}"
    starts.write.mode("overwrite").parquet(work)
    starts = spark.read.schema(starts.schema).parquet(work)
    transient = starts.where(F.col("is_transient")).drop("session_start", "dwell_s", "is_transient")
    _by_date(transient.withColumn("scan_date", day), f"{path}/transient", keys)
    windows = process_detections(transient, cfg, keys, deduped=True)
    _by_date(windows.withColumn("scan_date", day), f"{path}/windows", keys)

    last = scans.groupBy(*keys).agg(F.max("timestamp").alias("last_scan"))
    last.write.mode("overwrite").parquet(f"{path}/last_scan/as_of={end}")
    last = spark.read.schema(_keyed(keys, "last_scan timestamp")).parquet(f"{path}/last_scan/as_of={end}")
    still = presence.open_sessions(starts, cfg, keys, break_rule, dt.datetime.combine(end, dt.time()), last, carried)
    still.write.mode("overwrite").parquet(f"{path}/open/as_of={end}")
    if not known:
        _empty_state(spark, path, start, keys)
        folders.publish(spark, f"{path}/done/{start}", "start")
    folders.publish(spark, f"{path}/done/{end}", "whole")
    folders.remove(spark, work)


def _empty_state(spark: SparkSession, path: str, start: dt.date, keys) -> None:
    """Before the first day no session is open, so that day can be run again."""
    spark.createDataFrame([], _keyed(keys, DEVICE)).write.mode("overwrite").parquet(f"{path}/open/as_of={start}")
    spark.createDataFrame([], _keyed(keys, "last_scan timestamp")).write.mode("overwrite").parquet(
        f"{path}/last_scan/as_of={start}")


def _by_date(df: DataFrame, path: str, keys) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*keys, "scan_date").parquet(path))


def read_days(spark: SparkSession, path: str, table: str, like: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    """``transient`` or ``windows`` with the columns of ``like`` (a
    ``scan_date`` filter on the result prunes folders)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    return spark.read.schema(f"{fields}, scan_date date").parquet(f"{path}/{table}").select(*like.columns, "scan_date")
