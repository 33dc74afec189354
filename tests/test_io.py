import json
import os

import pytest

from passage.config import Config
from passage.operators import features, patterns
from passage.sinks import files
from passage.sources import scans as S

LINES = [
    {"timestamp": "2024-01-01T10:00:00.123456", "scan_id": 0, "device_count": 2,
     "devices": [{"mac_hash": "a", "rssi": None, "protocol": "classic"}, {"mac_hash": "a", "rssi": -50, "protocol": "ble"}]},
    {"timestamp": "2024-01-01T10:00:03", "scan_id": 1, "device_count": 0, "devices": []},
    "not json {",
    {"timestamp": "2024-01-02T00:00:00", "scan_id": 2, "device_count": 1, "devices": [{"mac_hash": "b", "rssi": -81}]},
    {"timestamp": "2024-01-02T09:00:00", "scan_id": 0, "device_count": 1, "devices": [{"mac_hash": "c", "rssi": -60, "protocol": "ble"}]},
]


def write_log(d):
    with open(os.path.join(d, "scan_20240101.jsonl"), "w") as f:
        for x in LINES:
            f.write((x if isinstance(x, str) else json.dumps(x)) + "\n")
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("ignored\n")


def test_corrupt_line_dropped_rest_kept(spark, tmpdir_str):
    write_log(tmpdir_str)
    df = S.read_scans(spark, tmpdir_str, site_id="s1")
    assert sorted(r.scan_id for r in df.collect()) == [0, 0, 1, 2]
    assert S.corrupt_lines(spark, tmpdir_str).count() == 1
    r0 = [r for r in df.collect() if r.scan_id == 0 and r.timestamp.day == 1][0]
    assert r0.timestamp.microsecond == 123456


def test_date_range_end_is_midnight(spark, tmpdir_str):
    write_log(tmpdir_str)
    df = S.read_scans(spark, tmpdir_str, start="2024-01-01", end="2024-01-02", site_id="s1")
    assert sorted(r.scan_id for r in df.collect()) == [0, 1, 2]  # 2024-01-02 09:00 is after the end


def test_append_round_trip_and_pruning(spark, tmpdir_str):
    write_log(tmpdir_str)
    df = S.read_scans(spark, tmpdir_str, site_id="s1")
    out = os.path.join(tmpdir_str, "logs")
    files.append_scans(df, out)  # empty scan skipped
    files.append_scans(df, out, log_empty=True)
    back = S.read_scans(spark, out, glob=None)
    assert back.count() == 3 + 4
    assert os.path.isdir(os.path.join(out, "site_id=s1", "scan_date=2024-01-02"))
    day = S.date_range(back, "2024-01-02", "2024-01-02 23:59:59")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "scan_date" in plan
    assert day.count() == 4
    assert {r.timestamp.microsecond for r in back.collect()} >= {123456}


def test_dataset_and_metadata_writers(spark, tmpdir_str):
    from passage.operators import reports
    df = spark.createDataFrame([("s", "2024-01-01 00:00:00", 1.0)], "site_id string, timestamp string, avg_devices double")
    df = df.withColumn("timestamp", df.timestamp.cast("timestamp"))
    files.write_dataset(df, os.path.join(tmpdir_str, "ds"))
    assert S.read_dataset(spark, os.path.join(tmpdir_str, "ds")).count() == 1
    files.write_dataset(df, os.path.join(tmpdir_str, "csv"), fmt="csv", partition_by=())
    assert S.read_dataset(spark, os.path.join(tmpdir_str, "csv"), fmt="csv").count() == 1
    files.write_one_row_json(reports.metadata(df), os.path.join(tmpdir_str, "meta"))
    meta = spark.read.json(os.path.join(tmpdir_str, "meta")).first()
    assert meta.num_records == 1 and meta.columns == ["site_id", "timestamp", "avg_devices"]


@pytest.mark.slow
def test_model_round_trip(spark, tmpdir_str):
    from tests.test_forecast_patterns import structured
    from passage.operators import forecast
    df = features.cyclic_features(structured(spark, days=10, sites=1))
    pm = patterns.fit_patterns(df, Config())
    files.save_pattern_model(pm, os.path.join(tmpdir_str, "pm"))
    pm2 = files.load_pattern_model(spark, os.path.join(tmpdir_str, "pm"))
    a = sorted((r.timestamp, r.cluster) for r in pm.label(df).collect())
    b = sorted((r.timestamp, r.cluster) for r in pm2.label(df).collect())
    assert a == b
    cfg = Config(window_hours=1, n_estimators=5, lag_periods=(1, 2), rolling_windows=(3,))
    ml = features.target(features.ml_dataset(structured(spark, days=10, sites=1), cfg), cfg)
    fc = forecast.fit_forecaster(ml, cfg)
    files.save_forecaster(fc, os.path.join(tmpdir_str, "fc"), spark)
    fc2 = files.load_forecaster(spark, os.path.join(tmpdir_str, "fc"))
    assert fc2.feature_cols == fc.feature_cols
    assert fc2.predict(ml).count() == ml.count()
    with pytest.raises(FileNotFoundError):
        files.load_forecaster(spark, os.path.join(tmpdir_str, "missing"))
