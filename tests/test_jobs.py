import os

import pytest

from passage.config import Config
from passage.plans import jobs
from passage.sources.events import detections_from_events
from passage.operators import clean
from pyspark.sql import functions as F
from tests.conftest import SF_ORACLE


@pytest.mark.slow
def test_processing_training_serving(spark, tmpdir_str):
    """Scan logs written from the events adapter → processing job →
    training job → read models."""
    from passage.sinks import files
    cfg = Config.for_events(window_hours=1).with_(n_estimators=10, lag_periods=(1, 2, 24), rolling_windows=(6, 24))
    det = clean.clean_detections(detections_from_events(spark, SF_ORACLE), cfg)
    # one scan record per (site, scan) written as JSON lines (fixture only)
    scans = (det.groupBy("site_id", "scan_id", "timestamp")
                .agg(F.collect_list(F.struct("mac_hash", "rssi", "protocol")).alias("devices"))
                .withColumn("device_count", F.size("devices")))
    raw = os.path.join(tmpdir_str, "raw")
    files.append_scans(scans, raw)
    out = jobs.processing_job(spark, raw, os.path.join(tmpdir_str, "processed"), cfg, glob=None)
    ml = spark.read.parquet(out["ml_dataset"])
    assert ml.count() > 0
    res = jobs.training_job(spark, out["ml_dataset"], os.path.join(tmpdir_str, "models"), cfg)
    q = res.pattern_quality.first()
    assert q.clusters >= 2 and -1 <= q.silhouette_sq <= 1
    rm = jobs.read_models(spark, out["ml_dataset"], os.path.join(tmpdir_str, "models"), cfg)
    cur = rm["current"].collect()
    assert len(cur) == 4 and all(r.current_cluster in ("Quiet", "Moderate", "Busy") for r in cur)
    assert rm["weekly"].count() == 28


def test_process_scans_capture_clean_matches_flat_path(spark, tmpdir_str):
    """Scan records with capture-side cleaning give the same windows as the
    flat detections path on the same sightings."""
    from passage.plans import batch
    from passage.schemas import SCAN
    cfg = Config.for_events()
    raw = batch.raw_detections(spark, "/root/testdata/sf0.001")
    rows = raw.collect()
    recs = {}
    for r in sorted(rows, key=lambda r: r.arrival):
        recs.setdefault((r.site_id, r.scan_id, r.timestamp), []).append((r.mac_hash, r.rssi, r.protocol))
    scans = spark.createDataFrame([(k[0], k[2], k[1], len(v), v) for k, v in recs.items()], SCAN)
    win, _ = batch.process_scans(scans, cfg, capture_clean=True)
    got = sorted((r.site_id, r.timestamp, r.num_scans, r.total_devices) for r in win.collect())
    flat = batch.window_table(spark, "/root/testdata/sf0.001", cfg)
    want = sorted((r.site_id, r.timestamp, r.num_scans, r.total_devices) for r in flat.collect())
    assert got == want
