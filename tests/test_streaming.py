import json
import os
import time


from passage.config import Config
from passage.operators import clean
from passage.plans import batch
from passage.plans.registry_streams import _clean, event_stream
from passage.sources import scans as S
from passage.streaming import live
from tests.conftest import SF_SMALL

CFG = Config.for_events()


def test_live_transient_equals_batch_gap_rule(spark):
    out, _ = live.run_to_table(spark, live.live_transient(_clean(event_stream(spark, SF_SMALL)), CFG), "t")
    got = sorted((r.site_id, r.timestamp, r.mac_hash) for r in spark.read.parquet(out).collect())
    want = sorted((r.site_id, r.timestamp, r.mac_hash)
                  for r in batch.transient_detections(spark, SF_SMALL, CFG, break_rule="gap").collect())
    assert got == want


def test_live_windows_subset_of_batch(spark):
    out, _ = live.run_to_table(spark, live.live_detection_windows(event_stream(spark, SF_SMALL), CFG), "w")
    streamed = {(r.site_id, r.timestamp, r.num_scans) for r in spark.read.parquet(out).collect()}
    det = clean.clean_detections(batch.raw_detections(spark, SF_SMALL), CFG)
    full = {(r.site_id, r.timestamp, r.num_scans) for r in batch.process_detections(det, CFG).collect()}
    assert streamed and streamed <= full
    assert len(full) - len(streamed) <= 4 * 2  # only the windows still open at the watermark


def test_live_clean_on_scan_files(spark, tmpdir_str):
    src = os.path.join(tmpdir_str, "in")
    os.makedirs(src)
    recs = [{"site_id": "s", "timestamp": f"2024-01-01T10:00:0{i}", "scan_id": i, "device_count": 2,
             "devices": [{"mac_hash": "a", "rssi": -85, "protocol": "ble"},
                         {"mac_hash": "b", "rssi": -40 - i, "protocol": "ble"}] if i % 2 else []}
            for i in range(6)]
    with open(os.path.join(src, "scan_20240101.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs) + "\n")
    stream = live.live_clean(S.stream_scans(spark, src), CFG)
    out, _ = live.run_to_table(spark, stream, "clean")
    rows = spark.read.parquet(out).collect()
    assert sorted(r.scan_id for r in rows) == [1, 3, 5]
    assert all([d.mac_hash for d in r.devices] == ["b"] for r in rows)
    win, _ = live.run_to_table(spark, live.live_window_counts(S.stream_scans(spark, src), CFG), "win")
    assert spark.read.parquet(win).count() == 0  # the only window is still open


def test_live_sessions_close_after_timeout(spark):
    out, _ = live.run_to_table(spark, live.live_sessions(_clean(event_stream(spark, SF_SMALL)), CFG), "s")
    rows = spark.read.parquet(out).collect()
    assert rows and all(r.last_seen >= r.first_seen for r in rows)


def test_snapshot_refresh_overwrites_table(spark, tmpdir_str):
    """foreachBatch refresh: each trigger rescores the newest windows into
    the snapshot table (here with a trivial scorer)."""
    from passage.operators import reports
    src = os.path.join(tmpdir_str, "win")
    wins = batch.window_table(spark, SF_SMALL, CFG)
    wins.write.parquet(src)
    stream = spark.readStream.schema(wins.schema).parquet(src)
    out = os.path.join(tmpdir_str, "snapshot")
    q = live.start_snapshot_refresh(stream, lambda b: reports.latest(b), out, "snap", interval="1 second")
    try:
        deadline = time.time() + 120
        while time.time() < deadline and live.read_snapshot(spark, out) is None:
            time.sleep(1)
    finally:
        q.stop()
    snap = live.read_snapshot(spark, out)
    assert snap.count() == 4  # one latest window per site


def test_union_protocols_keeps_classic_first(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    c = spark.createDataFrame([("s", t, 0, "a", None, "classic", 0)],
                              "site_id string, timestamp timestamp, scan_id long, mac_hash string, rssi int, protocol string, arrival long")
    b = spark.createDataFrame([("s", t, 0, "a", -70, "ble", 1)],
                              "site_id string, timestamp timestamp, scan_id long, mac_hash string, rssi int, protocol string, arrival long")
    out = clean.dedupe_strongest(clean.union_protocols(c, b)).collect()
    assert [(r.protocol, r.rssi) for r in out] == [("ble", -70)]


def test_streaming_scan_log_sink(spark, tmpdir_str):
    src = os.path.join(tmpdir_str, "in")
    os.makedirs(src)
    recs = [{"site_id": "s", "timestamp": f"2024-01-0{d}T10:00:00", "scan_id": d, "device_count": 1,
             "devices": [{"mac_hash": "a", "rssi": -50, "protocol": "ble"}]} for d in (1, 2)]
    with open(os.path.join(src, "scan_20240101.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs) + "\n")
    out = os.path.join(tmpdir_str, "log")
    q = live.start_scan_log(live.live_clean(S.stream_scans(spark, src), CFG), out, "log")
    q.awaitTermination()
    back = S.read_scans(spark, out, glob=None)
    assert back.count() == 2
    assert os.path.isdir(os.path.join(out, "site_id=s", "scan_date=2024-01-02"))
