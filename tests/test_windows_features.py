import datetime as dt
import random

import numpy as np
import pandas as pd

from passage.config import Config
from passage.operators import features, windows
from passage.schemas import SCAN

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def scan_counts_pdf(seed=3, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if rnd.random() < 0.4:
            continue
        t = T0 + dt.timedelta(minutes=17 * i)
        rows.append(("s", i, t, rnd.randint(0, 9)))
    return pd.DataFrame(rows, columns=["site_id", "scan_id", "timestamp", "device_count"])


def reference_windows(pdf, hours):
    """pandas resample as the original processor does it."""
    s = pdf.set_index("timestamp")[["device_count"]]
    agg = s.resample(f"{hours}h").agg({"device_count": ["mean", "std", "min", "max", "sum", "count"]})
    agg.columns = ["avg_devices", "std_devices", "min_devices", "max_devices", "total_devices", "num_scans"]
    return agg.reset_index()


def test_windows_match_pandas_resample(spark):
    pdf = scan_counts_pdf()
    cfg = Config(window_hours=4)
    sdf = spark.createDataFrame(pdf)
    got = windows.window_counts(sdf, cfg, with_time_features=False).toPandas().sort_values("timestamp")
    want = reference_windows(pdf, 4)
    want = want[want["num_scans"] >= 1]
    assert len(got) == len(want)
    np.testing.assert_allclose(got["avg_devices"], want["avg_devices"])
    np.testing.assert_allclose(got["std_devices"].astype(float), want["std_devices"], equal_nan=True)
    assert list(got["num_scans"]) == list(want["num_scans"])
    # keep_empty = the full resample grid
    full = windows.window_counts(sdf, cfg, keep_empty=True, with_time_features=False).toPandas()
    assert len(full) == len(reference_windows(pdf, 4))
    assert (full.loc[full["num_scans"] == 0, "total_devices"] == 0).all()


def test_explode_and_scan_counts(spark):
    scans = spark.createDataFrame([
        ("s", T0, 0, 2, [("a", -50, "ble"), ("a", -60, "classic")]),
        ("s", T0 + dt.timedelta(seconds=3), 1, 0, []),
        ("s", T0 + dt.timedelta(seconds=6), 2, 1, [("b", None, None)]),
    ], SCAN)
    det = windows.explode_devices(scans)
    assert det.count() == 3  # empty scan vanishes
    assert {r.protocol for r in det.collect()} == {"ble", "classic", "unknown"}
    cnt = {r.scan_id: r.device_count for r in windows.scan_counts(det).collect()}
    assert cnt == {0: 1, 2: 1}
    nested = {r.scan_id: r.device_count for r in windows.scan_counts_nested(scans).collect()}
    assert nested == {0: 1, 1: 0, 2: 1}
    assert windows.explode_devices(scans, keep_empty=True).count() == 4


def test_time_features(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6, 13, 0),), (dt.datetime(2024, 1, 8, 0, 0),)],
                               "timestamp timestamp")
    rows = features.time_features(df, Config()).collect()
    assert [(r.hour, r.day_of_week, r.month, r.is_weekend) for r in rows] == [(13, 5, 1, True), (0, 0, 1, False)]


def test_lags_and_rolling_match_pandas(spark):
    rnd = np.random.default_rng(0)
    n = 400
    pdf = pd.DataFrame({"site_id": "s", "timestamp": pd.date_range("2024-01-01", periods=n, freq="4h"),
                        "avg_devices": rnd.normal(5, 2, n)})
    cfg = Config()
    got = features.rolling(features.lags(spark.createDataFrame(pdf), cfg), cfg).toPandas().sort_values("timestamp")
    for lag in cfg.lag_periods:
        np.testing.assert_allclose(got[f"avg_devices_lag_{lag}h"], pdf["avg_devices"].shift(lag), equal_nan=True)
    for w in cfg.rolling_windows:
        r = pdf["avg_devices"].rolling(window=w, min_periods=1)
        for stat, ref in (("mean", r.mean()), ("std", r.std()), ("min", r.min()), ("max", r.max())):
            np.testing.assert_allclose(got[f"avg_devices_rolling_{w}h_{stat}"].astype(float), ref,
                                       equal_nan=True, rtol=1e-9, atol=1e-9)
    ml = features.ml_dataset(spark.createDataFrame(pdf), cfg)
    assert ml.count() == n - 168  # warm-up rows dropped
    tgt = features.target(ml, cfg)
    assert tgt.count() == n - 168 - cfg.forecast_horizon


def test_sequences_exclude_current_row(spark):
    n = 40
    pdf = pd.DataFrame({"site_id": "s", "timestamp": pd.date_range("2024-01-01", periods=n, freq="1h"),
                        "avg_devices": np.arange(n, dtype=float), "hour": 0, "day_of_week": 0,
                        "is_weekend": False, "avg_devices_future": np.arange(n, dtype=float) + 4})
    cfg = Config(lookback_window=5)
    seq = features.scaled_sequences(spark.createDataFrame(pdf), cfg).orderBy("timestamp").collect()
    assert len(seq) == n - 5
    lo, hi = 0.0, float(int(n * 0.8) - 1)  # min-max of the training rows only
    first = seq[0]
    assert [round(v[0] * (hi - lo) + lo, 9) for v in first.sequence] == [0, 1, 2, 3, 4]
    assert first.avg_devices_future == 9.0


def test_legacy_scan_key_merges_restarted_ids(spark):
    det = spark.createDataFrame([
        ("s", T0, 0, "a"), ("s", T0, 0, "b"),
        ("s", T0 + dt.timedelta(hours=1), 0, "a"),  # capture restarted: id 0 again
    ], "site_id string, timestamp timestamp, scan_id long, mac_hash string")
    assert windows.scan_counts(det).count() == 2
    legacy = windows.scan_counts(det, legacy_key=True).collect()
    assert [(r.timestamp, r.device_count) for r in legacy] == [(T0, 2)]


def test_hour_lags_skip_missing_windows(spark):
    pdf = pd.DataFrame({"site_id": "s", "timestamp": pd.to_datetime(
        ["2024-01-01 00:00", "2024-01-01 01:00", "2024-01-01 03:00"]), "avg_devices": [1.0, 2.0, 3.0]})
    cfg = Config(lag_periods=(1, 2))
    rows = features.lags(spark.createDataFrame(pdf), cfg, unit="hours").orderBy("timestamp").collect()
    assert [(r.avg_devices_lag_1h, r.avg_devices_lag_2h) for r in rows] == [(None, None), (1.0, None), (None, 2.0)]
    by_rows = features.lags(spark.createDataFrame(pdf), cfg).orderBy("timestamp").collect()
    assert by_rows[2].avg_devices_lag_1h == 2.0


def test_unique_devices_approx_close_to_exact(spark):
    from passage.operators import declared
    rows = [("s", T0 + dt.timedelta(minutes=m % 240), m, f"d{m % 500}") for m in range(3000)]
    det = spark.createDataFrame(rows, "site_id string, timestamp timestamp, scan_id long, mac_hash string")
    cfg = Config(window_hours=4)
    exact = windows.unique_devices(det, cfg).first().unique_devices
    approx = windows.unique_devices(det, cfg, approx=True, rsd=0.02).first().unique_devices
    assert exact == 500 and abs(approx - exact) <= 0.1 * exact
    kept = declared.retain(det, "2024-01-01 03:00:00", days=0)
    assert kept.count() == sum(1 for r in rows if r[1] >= dt.datetime(2024, 1, 1, 3))
