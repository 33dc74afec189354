"""Clean-up of sightings: signal threshold, hashing, protocol union,
strongest-signal de-duplication, defaults.

Two equivalent shapes are supported:

* flat detections (one row per sighting) — de-duplication is a ranking
  window on ``(keys, scan, mac_hash)``;
* nested scan records (one row per scan, ``devices`` array) — everything is
  row-local through higher-order functions, no shuffle at all (used by the
  stream path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passage.config import Config
from passage.functions.ids import salted_sha256
from passage.functions.signal import passes_rssi
from passage.operators import DEFAULT_KEYS

SCAN_KEYS = ("scan_id", "timestamp")


# ---------------------------------------------------------------- flat rows --

def rssi_filter(det: DataFrame, cfg: Config) -> DataFrame:
    """Keep sightings whose signal reaches ``cfg.rssi_threshold``; classic
    sightings without a reading are kept."""
    return det.where(passes_rssi(F.col("rssi"), F.col("protocol"), cfg.rssi_threshold))


def hash_ids(df: DataFrame, salt: str | Column, col: str = "mac", out: str = "mac_hash",
             drop: bool = True) -> DataFrame:
    """Replace a raw identifier by its salted SHA-256 hex digest."""
    df = df.withColumn(out, salted_sha256(F.col(col), salt))
    return df.drop(col) if drop and col != out else df


def union_protocols(classic: DataFrame, ble: DataFrame) -> DataFrame:
    """Classic sightings first, then BLE (arrival order matters for ties)."""
    return classic.unionByName(ble, allowMissingColumns=True)


def fill_defaults(det: DataFrame) -> DataFrame:
    """Missing protocol → 'unknown'; missing RSSI stays NULL."""
    cols = det.columns
    out = [F.col(c) for c in cols if c != "protocol"]
    if "rssi" not in cols:
        out.append(F.lit(None).cast("int").alias("rssi"))
    proto = F.col("protocol") if "protocol" in cols else F.lit(None).cast("string")
    return det.select(*out, F.coalesce(proto, F.lit("unknown")).alias("protocol"))


def dedupe_strongest(det: DataFrame, keys=DEFAULT_KEYS, order_col: str = "arrival", then=()) -> DataFrame:
    """One row per device per scan: the strongest reported RSSI wins, a
    missing RSSI never replaces a reading, ties keep the first arrival.

    ``order_col`` gives arrival order; without it ties are broken by
    protocol ('classic' < 'ble' in arrival order) then RSSI. ``then`` adds
    further tie-breakers after the arrival order.
    """
    # (keys, device, time, scan): the sort this window needs also serves a
    # later per-device window ordered by time (one sort instead of two)
    part = [*keys, "mac_hash", "timestamp", "scan_id"]
    order = [F.col("rssi").desc_nulls_last()]
    if order_col in det.columns:
        order.append(F.col(order_col).asc())
    else:
        order.append(F.when(F.col("protocol") == "classic", 0).otherwise(1))
    order += [F.col(c).asc() for c in then]
    w = Window.partitionBy(*part).orderBy(*order)
    cols = det.columns
    return det.select("*", F.row_number().over(w).alias("_rank")).where(F.col("_rank") == 1).select(*cols)


def clean_detections(det: DataFrame, cfg: Config, keys=DEFAULT_KEYS) -> DataFrame:
    """Defaults → RSSI threshold → strongest-signal de-duplication."""
    return dedupe_strongest(rssi_filter(fill_defaults(det), cfg), keys)


# ----------------------------------------------------------- nested records --

def clean_nested(scans: DataFrame, cfg: Config) -> DataFrame:
    """Row-local twin of ``clean_detections`` on scan records.

    Per scan: default the protocol, drop weak sightings, then keep per
    ``mac_hash`` the first element of maximal RSSI (reading beats none).
    Array position is the arrival order and is preserved in the output.
    ``device_count`` is recomputed.
    """
    thr = cfg.rssi_threshold
    devs = F.transform(
        F.coalesce(F.col("devices"), F.array()),
        lambda d, i: F.struct(
            d["mac_hash"].alias("mac_hash"), d["rssi"].alias("rssi"),
            F.coalesce(d["protocol"], F.lit("unknown")).alias("protocol"),
            i.alias("pos")))
    kept = F.filter(devs, lambda d: passes_rssi(d["rssi"], d["protocol"], thr))
    # sort by (hash, strongest first with no reading last, arrival); the first
    # element of each hash run wins — O(n log n) per scan, no pairwise work: the
    # sorted array is bound to a lambda variable, as an expression used inside
    # another's lambda would be sorted again for each element
    keyed = F.sort_array(F.transform(kept, lambda d: F.struct(
        d["mac_hash"].alias("h"),
        F.coalesce(-d["rssi"], F.lit(1 << 20)).alias("k"),
        d["pos"].alias("pos"), d["rssi"].alias("rssi"), d["protocol"].alias("protocol"))))
    best = F.flatten(F.transform(F.array(keyed), lambda a: F.filter(
        a, lambda d, i: (i == 0) | ~F.get(a, i - 1)["h"].eqNullSafe(d["h"]))))
    by_arrival = F.sort_array(F.transform(best, lambda d: F.struct(
        d["pos"].alias("pos"), d["h"].alias("mac_hash"), d["rssi"].alias("rssi"),
        d["protocol"].alias("protocol"))))
    out = F.transform(by_arrival, lambda d: F.struct(d["mac_hash"].alias("mac_hash"),
                                                      d["rssi"].alias("rssi"),
                                                      d["protocol"].alias("protocol")))
    return (scans.withColumn("devices", out)
                 .withColumn("device_count", F.size("devices").cast("int")))


def drop_empty_scans(scans: DataFrame) -> DataFrame:
    """Skip scans that saw nothing (``log_empty_scans = false``)."""
    return scans.where(F.size("devices") > 0)
