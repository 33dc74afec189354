import datetime as dt

from pyspark.sql import functions as F

from passage.config import Config
from passage.operators import clean
from passage.schemas import SCAN

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)
CFG = Config()


def det_df(spark, rows):
    # rows: (scan_id, mac, rssi, protocol, arrival)
    data = [("s", T0 + dt.timedelta(seconds=3 * r[0]), r[0], r[1], r[2], r[3], r[4]) for r in rows]
    return spark.createDataFrame(
        data, "site_id string, timestamp timestamp, scan_id long, mac_hash string, rssi int, protocol string, arrival long")


def test_dedupe_rules(spark):
    rows = [
        (0, "a", None, "classic", 0), (0, "a", -50, "ble", 1),      # reading beats none
        (1, "b", -50, "classic", 0), (1, "b", None, "ble", 1),      # none never replaces
        (2, "c", -50, "classic", 0), (2, "c", -50, "ble", 1),       # tie keeps first arrival
        (3, "d", -70, "classic", 0), (3, "d", -50, "ble", 1),       # stronger wins
        (4, "e", None, "classic", 0), (4, "e", None, "classic", 1),  # both none: first
    ]
    out = {(r.scan_id, r.mac_hash): (r.rssi, r.protocol, r.arrival)
           for r in clean.dedupe_strongest(det_df(spark, rows)).collect()}
    assert out == {(0, "a"): (-50, "ble", 1), (1, "b"): (-50, "classic", 0), (2, "c"): (-50, "classic", 0),
                   (3, "d"): (-50, "ble", 1), (4, "e"): (None, "classic", 0)}


def test_rssi_threshold_and_defaults(spark):
    rows = [(0, "a", -80, "ble", 0), (0, "b", -81, "ble", 1), (0, "c", None, "classic", 2),
            (0, "d", None, "ble", 3), (0, "e", -81, None, 4), (0, "f", -10, None, 5)]
    out = clean.clean_detections(det_df(spark, rows), CFG).collect()
    assert {r.mac_hash for r in out} == {"a", "c", "f"}
    assert [r.protocol for r in out if r.mac_hash == "f"] == ["unknown"]


def test_nested_twin_equals_flat(spark):
    import random
    rnd = random.Random(7)
    scans = []
    flat = []
    for s in range(40):
        devs = []
        for i in range(rnd.randint(0, 8)):
            mac = f"m{rnd.randint(0, 5)}"
            proto = rnd.choice(["classic", "ble", None])
            rssi = None if proto == "classic" and rnd.random() < 0.3 else rnd.randint(-90, -30)
            devs.append((mac, rssi, proto))
            flat.append(("s", T0 + dt.timedelta(seconds=3 * s), s, mac, rssi, proto, i))
        scans.append(("s", T0 + dt.timedelta(seconds=3 * s), s, len(devs), devs))
    sdf = spark.createDataFrame(scans, SCAN)
    nested = clean.clean_nested(sdf, CFG)
    got = sorted((r.scan_id, d.mac_hash, d.rssi, d.protocol)
                 for r in nested.collect() for d in r.devices)
    fdf = spark.createDataFrame(flat, "site_id string, timestamp timestamp, scan_id long, mac_hash string, "
                                      "rssi int, protocol string, arrival long")
    want = sorted((r.scan_id, r.mac_hash, r.rssi, r.protocol)
                  for r in clean.clean_detections(fdf, CFG).collect())
    assert got == want
    # device_count recomputed, empty scans dropped on request
    assert all(r.device_count == len(r.devices) for r in nested.collect())
    assert clean.drop_empty_scans(nested).where(F.size("devices") == 0).count() == 0


def test_nested_scan_is_sorted_once(spark):
    """A scan of many devices: its list is sorted once, not again for each device; a missing hash is a device too."""
    n = 4000
    devs = [(f"m{i % (n // 2):05d}" if i % 7 else None, -40 - i % 30, "ble") for i in range(n)]
    sdf = spark.createDataFrame([("s", T0, 0, n, devs)], SCAN)
    nested = clean.clean_nested(sdf, CFG)
    # the default protocol is filled in where the list is made: more mentions, more sorts of the list
    assert nested.select("devices")._jdf.queryExecution().optimizedPlan().toString().count("unknown") == 1
    flat = sdf.select("site_id", "timestamp", "scan_id", F.posexplode("devices").alias("arrival", "d")).select("*", "d.*").drop("d")
    key = lambda r: (r[0] or "", r[1], r[2])
    want = [tuple(r) for r in clean.clean_detections(flat, CFG).select("mac_hash", "rssi", "protocol").collect()]
    assert sorted((tuple(d) for d in nested.first().devices), key=key) == sorted(want, key=key)


def test_hash_ids(spark):
    import hashlib
    df = spark.createDataFrame([("AA:BB",)], "mac string")
    got = clean.hash_ids(df, "pepper").first().mac_hash
    assert got == hashlib.sha256(b"AA:BBpepper").hexdigest()
