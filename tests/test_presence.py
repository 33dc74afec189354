import datetime as dt
import random

import pytest

from passage.config import Config
from passage.operators import presence

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def state_machine(scan_times, sightings, threshold, timeout, rule, interval):
    """Plain-Python replay of the capture loop: update, then evict after
    every scan (empty ones too)."""
    hist = {}
    kept = set()
    by_scan = {}
    for t, mac in sightings:
        by_scan.setdefault(t, []).append(mac)
    prev_t = None
    for t in sorted(scan_times):
        if rule == "gap":
            pass
        for mac in by_scan.get(t, []):
            if rule == "gap" and mac in hist and (t - hist[mac]["last"]).total_seconds() > timeout:
                del hist[mac]
            if mac not in hist:
                hist[mac] = {"first": t, "last": t}
                kept.add((t, mac))
            else:
                hist[mac]["last"] = t
                if (t - hist[mac]["first"]).total_seconds() <= threshold:
                    kept.add((t, mac))
        if rule == "scan":
            for mac in [m for m, h in hist.items() if (t - h["last"]).total_seconds() > timeout]:
                del hist[mac]
        prev_t = t
    return kept


def random_log(seed, n_scans=300, interval=60, p_scan=0.7):
    rnd = random.Random(seed)
    scans, sightings = [], []
    for i in range(n_scans):
        t = T0 + dt.timedelta(seconds=i * interval)
        if rnd.random() > p_scan:
            continue  # this tick was not logged
        scans.append(t)
        for mac in ("a", "b", "c", "d"):
            if rnd.random() < {"a": 0.9, "b": 0.3, "c": 0.05, "d": 0.6}[mac]:
                sightings.append((t, mac))
    return scans, sightings


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("rule", ["scan", "gap"])
def test_transient_equals_state_machine(spark, seed, rule):
    scans, sightings = random_log(seed)
    cfg = Config(stationary_threshold=900, device_timeout=240, scan_interval=60,
                 presence_bucket_seconds=1800)  # small buckets: many bucket borders
    det = spark.createDataFrame([("s", t, int((t - T0).total_seconds()), m) for t, m in sightings],
                                "site_id string, timestamp timestamp, scan_id long, mac_hash string")
    sc = spark.createDataFrame([("s", t) for t in scans], "site_id string, timestamp timestamp")
    got = {(r.timestamp, r.mac_hash) for r in presence.transient_only(det, cfg, break_rule=rule, scans=sc).collect()}
    want = state_machine(scans, sightings, 900, 240, rule, 60)
    assert got == want


def test_bucket_size_does_not_change_result(spark):
    scans, sightings = random_log(11, n_scans=500)
    det = spark.createDataFrame([("s", t, 0, m) for t, m in sightings],
                                "site_id string, timestamp timestamp, scan_id long, mac_hash string")
    sc = spark.createDataFrame([("s", t) for t in scans], "site_id string, timestamp timestamp")
    res = []
    for b in (600, 3600, 86400):
        cfg = Config(stationary_threshold=1200, device_timeout=300, presence_bucket_seconds=b)
        res.append(sorted(presence.session_starts(det, cfg, scans=sc)
                          .select("timestamp", "mac_hash", "session_start").collect()))
    assert res[0] == res[1] == res[2]


def test_sessions_and_counts(spark):
    scans, sightings = random_log(5)
    cfg = Config(stationary_threshold=900, device_timeout=240)
    det = spark.createDataFrame([("s", t, int((t - T0).total_seconds()), m) for t, m in sightings],
                                "site_id string, timestamp timestamp, scan_id long, mac_hash string")
    sess = presence.sessions(det, cfg).collect()
    assert sum(r.sightings for r in sess) == len(sightings)
    assert all((r.dwell_s > 900) == r.is_stationary for r in sess)
    cnt = presence.scan_presence_counts(det, cfg).collect()
    assert sum(r.total_devices for r in cnt) == len(sightings)
    assert sum(r.transient_devices for r in cnt) == presence.transient_only(det, cfg).count()
