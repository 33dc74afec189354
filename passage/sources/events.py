"""``events`` → detections adapter.

The test tables carry no radio logs, so detections are derived from
``events(event_id, ts, user_id, event_type, value, props)`` with a fixed
mapping (the same expressions are used by the SQL twins):

* a scan is a 15-minute tick: ``scan_id = floor(epoch(ts) / 900)`` and the
  scan timestamp is ``scan_id * 900`` seconds;
* a user is a device of site ``user_id % 4``; its identifier is the salted
  SHA-256 of the user id;
* ``click`` / ``view`` events are classic-radio sightings, others BLE;
* classic sightings with ``props.k % 10 = 0`` report no RSSI, all others
  ``-40 - floor(value) % 60`` dBm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passage.functions.ids import salted_sha256
from passage.session import ensure_utc

# fixed values
SCAN_SECONDS = 900
N_SITES = 4
EVENTS_SALT = "salt"
CLASSIC_EVENT_TYPES = ("click", "view")


# the driver table's schema, so reads skip footer inference
EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
SCHEMAS = {"events": EVENTS_SCHEMA}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as it is now (a file or a folder of part files)."""
    r = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return r.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_to_detections(events: DataFrame, salt: str = EVENTS_SALT) -> DataFrame:
    """Raw (unfiltered, not de-duplicated) detections in arrival order.

    ``arrival`` (the event id) orders sightings inside a scan for the
    strongest-signal de-duplication.
    """
    ts = F.col("ts").cast("timestamp")
    scan_id = F.floor(F.unix_micros(ts) / F.lit(SCAN_SECONDS * 1_000_000)).cast("long")
    classic = F.col("event_type").isin(*CLASSIC_EVENT_TYPES)
    k = F.get_json_object("props", "$.k").try_cast("int")
    rssi = (F.when(classic & (k % 10 == 0), F.lit(None).cast("int"))
            .otherwise(F.lit(-40) - (F.floor("value").cast("int") % 60)))
    return events.select(
        (F.col("user_id") % N_SITES).cast("string").alias("site_id"),
        F.timestamp_seconds(scan_id * SCAN_SECONDS).alias("timestamp"),
        scan_id.alias("scan_id"),
        salted_sha256(F.col("user_id"), salt).alias("mac_hash"),
        rssi.cast("int").alias("rssi"),
        F.when(classic, F.lit("classic")).otherwise(F.lit("ble")).alias("protocol"),
        F.col("event_id").alias("arrival"),
    )


def detections_from_events(spark: SparkSession, sf_dir: str, salt: str = EVENTS_SALT) -> DataFrame:
    ensure_utc(spark)
    return events_to_detections(read_table(spark, sf_dir, "events"), salt)


# SQL twin of ``events_to_detections`` (DuckDB dialect), used by oracles.
EVENTS_DETECTIONS_SQL = f"""
SELECT CAST(user_id % {N_SITES} AS VARCHAR) AS site_id,
       make_timestamp(CAST(floor(epoch_us(ts) / {SCAN_SECONDS * 1_000_000}) AS BIGINT) * {SCAN_SECONDS * 1_000_000}) AS timestamp,
       CAST(floor(epoch_us(ts) / {SCAN_SECONDS * 1_000_000}) AS BIGINT) AS scan_id,
       sha256(CAST(user_id AS VARCHAR) || '{EVENTS_SALT}') AS mac_hash,
       CASE WHEN event_type IN ('click', 'view')
                 AND TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0 THEN NULL
            ELSE -40 - (CAST(floor(value) AS INTEGER) % 60) END AS rssi,
       CASE WHEN event_type IN ('click', 'view') THEN 'classic' ELSE 'ble' END AS protocol,
       event_id AS arrival
FROM events
"""
