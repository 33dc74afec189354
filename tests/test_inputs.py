"""Inputs that small single-file test tables do not show: folders of part
files, sites named with leading zeros or missing, constant series, several
micro-batches."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from passage.config import Config
from passage.operators import declared, forecast, patterns, windows
from passage.plans import jobs, registry_streams
from passage.sinks import files
from passage.sources import events, scans
from passage.streaming import live
from tests.conftest import SF_SMALL

T0 = dt.datetime(2024, 1, 1)


def _folder(spark, root, parts=4):
    out = os.path.join(root, "events.parquet")
    spark.read.schema(events.EVENTS_SCHEMA).parquet(f"{SF_SMALL}/events.parquet").repartition(parts).write.parquet(out)
    return root


def test_folder_table_equals_file_in_batch_and_stream(spark, tmpdir_str):
    root = _folder(spark, tmpdir_str)
    n = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert events.read_table(spark, root, "events").count() == n
    for sf in (root, SF_SMALL):
        out, _ = live.run_to_table(spark, registry_streams.event_stream(spark, sf), "rows")
        assert spark.read.parquet(out).count() == n


def test_appended_part_file_is_seen(spark, tmpdir_str):
    root = _folder(spark, tmpdir_str)
    n = events.read_table(spark, root, "events").count()
    spark.read.schema(events.EVENTS_SCHEMA).parquet(f"{SF_SMALL}/events.parquet").limit(5).write.mode("append").parquet(f"{root}/events.parquet")
    assert events.read_table(spark, root, "events").count() == n + 5


def test_site_names_stay_text(spark, tmpdir_str):
    df = spark.createDataFrame([("007", 1.0), ("7", 2.0)], "site_id string, x double")
    files.write_dataset(df, f"{tmpdir_str}/ds")
    back = scans.read_dataset(spark, f"{tmpdir_str}/ds")
    assert dict(back.dtypes)["site_id"] == "string"
    assert {tuple(r) for r in back.select("site_id", "x").collect()} == {("007", 1.0), ("7", 2.0)}


def test_empty_windows_keep_statistics_without_site(spark):
    rows = [(None, T0, 3.0, 0.0, 1, 5, 9, 3), (None, T0 + dt.timedelta(hours=2), 2.0, 0.0, 1, 3, 4, 2)]
    agg = spark.createDataFrame(rows, "site_id string, timestamp timestamp, avg_devices double, std_devices double, "
                                      "min_devices long, max_devices long, total_devices long, num_scans long")
    got = {r.timestamp: (r.avg_devices, r.num_scans) for r in windows.fill_empty_windows(agg, 1).collect()}
    assert len(got) == 3 and sorted(got.values(), key=str) == sorted([(3.0, 3), (2.0, 2), (None, 0)], key=str)


def test_logs_without_site_need_one(spark, tmpdir_str):
    log = os.path.join(tmpdir_str, "log")
    os.makedirs(log)
    with open(os.path.join(log, "scans_20240101.jsonl"), "w") as f:
        for i in range(48):
            t = (T0 + dt.timedelta(minutes=30 * i)).strftime("%Y-%m-%dT%H:%M:%S.%f")
            f.write(json.dumps({"scan_id": i, "timestamp": t, "device_count": 1,
                                "devices": [{"mac_hash": f"d{i}", "rssi": -50, "protocol": "ble"}]}) + "\n")
    cfg = Config().with_(min_scans_per_window=1, window_hours=1, lag_periods=(1,), rolling_windows=(2,))
    with pytest.raises(ValueError, match="site_id"):
        jobs.processing_job(spark, log, f"{tmpdir_str}/a", cfg, glob=None)
    n = {}
    for clean in (False, True):
        out = jobs.processing_job(spark, log, f"{tmpdir_str}/{clean}", cfg, glob=None, site_id="007", capture_clean=clean)
        win = scans.read_dataset(spark, out["windows"])
        assert {r.site_id for r in win.select("site_id").distinct().collect()} == {"007"}
        n[clean] = win.count()
    assert n[False] == n[True] == 24


def test_constant_actuals_do_not_fail_other_sites(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 1.0), ("b", 3.0, 2.0), ("c", 2.0, 2.0)], "site_id string, y double, p double")
    got = {r.site_id: r for r in forecast.metrics(df, "y", "p", ["site_id"]).collect()}
    assert got["a"].r2 is None and got["c"].r2 is None and got["b"].r2 == pytest.approx(0.5)


def test_quality_of_degenerate_clusters(spark):
    one = spark.createDataFrame([(0, 1.0), (0, 2.0)], "c int, x double")
    r = patterns.cluster_quality(one, ["x"], "c").first()
    assert r.davies_bouldin is None and r.calinski_harabasz is None
    assert patterns.silhouette_sq(one, ["x"], "c").first().silhouette_sq is None
    same = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0), (1, 1.0)], "c int, x double")
    assert patterns.cluster_quality(same, ["x"], "c").first().davies_bouldin is None
    assert patterns.silhouette_sq(same, ["x"], "c").first().silhouette_sq == 0.0


def test_all_holiday_names_of_a_date(spark):
    cal = spark.createDataFrame([("2024-01-01", "New Year"), ("2024-01-01", "Founders")], "date string, holiday string")
    df = spark.createDataFrame([(T0,), (T0 + dt.timedelta(days=1),)], "timestamp timestamp")
    got = [(r.holiday, r.is_holiday) for r in declared.holiday_flags(df, cal).orderBy("timestamp").collect()]
    assert got == [("Founders, New Year", True), (None, False)]


def test_bad_property_is_missing_not_fatal(spark):
    row = spark.createDataFrame([(1, T0, 3, "click", 5.0, '{"k":"x"}')], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    assert events.events_to_detections(row).count() == 1


def test_missing_pattern_model(spark, tmpdir_str):
    with pytest.raises(FileNotFoundError):
        files.load_pattern_model(spark, f"{tmpdir_str}/none")


DET = "site_id string, timestamp timestamp, scan_id long, mac_hash string, rssi int, protocol string, arrival long"


def _live(spark, root, batches, cfg, per_trigger):
    """Transient sightings of detections that arrive in the given files."""
    os.makedirs(root)
    for i, rows in enumerate(batches):
        part = spark.createDataFrame(rows, DET).coalesce(1)
        part.write.parquet(f"{root}/b{i}")
        os.utime(f"{root}/b{i}", (1_700_000_000 + i, 1_700_000_000 + i))
        for f in os.listdir(f"{root}/b{i}"):
            os.utime(f"{root}/b{i}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(DET).option("maxFilesPerTrigger", per_trigger).parquet(f"{root}/b*")
    out, _ = live.run_to_table(spark, live.live_transient(stream, cfg), "t")
    return sorted((r.mac_hash, r.timestamp, r.rssi) for r in spark.read.parquet(out).collect())


def test_live_filter_over_several_batches(spark, tmpdir_str):
    cfg = Config.for_events()
    step = dt.timedelta(minutes=15)

    def row(k, rssi, dev="d", arrival=0):
        return ("s", T0 + k * step, k, dev, rssi, "ble", arrival)

    # the second file repeats scan 1, and scan 2 arrives after scan 3
    batches = [[row(0, -60), row(1, -70)], [row(1, -50, arrival=1), row(3, -60)], [row(2, -65), row(3, -40, arrival=2)]]
    got = _live(spark, f"{tmpdir_str}/many", batches, cfg, 1)
    assert [(t, r) for _, t, r in got] == [(T0, -60), (T0 + step, -70), (T0 + 2 * step, -65), (T0 + 3 * step, -60)]
    whole = _live(spark, f"{tmpdir_str}/one", [sum(batches, [])], cfg, 10)
    assert [(t, r) for _, t, r in whole] == [(T0, -60), (T0 + step, -50), (T0 + 2 * step, -65), (T0 + 3 * step, -40)]


def test_live_filter_equals_batch_query_for_any_batching(spark, tmpdir_str):
    """The registered stream gives one result for one and for many micro-batches in time order."""
    cfg = Config.for_events()
    det = events.events_to_detections(events.read_table(spark, SF_SMALL, "events")).where("rssi is not null").select(
        "site_id", F.col("timestamp").cast("timestamp").alias("timestamp"), "scan_id", "mac_hash", "rssi", "protocol", "arrival")
    rows = sorted((tuple(r) for r in det.collect()), key=lambda r: r[1])
    cuts = [0] + [next(i for i in range(k, len(rows)) if rows[i][1] != rows[i - 1][1]) for k in (len(rows) // 3, 2 * len(rows) // 3)] + [len(rows)]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    assert _live(spark, f"{tmpdir_str}/p", parts, cfg, 1) == _live(spark, f"{tmpdir_str}/w", [rows], cfg, 10)


def test_snapshot_keeps_sites_without_news(spark, tmpdir_str):
    schema = "site_id string, v int"
    for i, site in enumerate(("a", "b")):
        spark.createDataFrame([(site, i)], schema).coalesce(1).write.mode("append").parquet(f"{tmpdir_str}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmpdir_str}/in")
    q = live.start_snapshot_refresh(stream, lambda b: b, f"{tmpdir_str}/snap", "keep", interval="0 seconds")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r.site_id for r in live.read_snapshot(spark, f"{tmpdir_str}/snap").collect()} == {"a", "b"}
