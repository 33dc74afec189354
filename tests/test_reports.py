import datetime as dt

import numpy as np
import pandas as pd

from passage.operators import reports


def wins(spark, n=100, seed=1):
    rnd = np.random.default_rng(seed)
    pdf = pd.DataFrame({"site_id": "s", "timestamp": pd.date_range("2024-01-01", periods=n, freq="4h"),
                        "avg_devices": rnd.gamma(2.0, 2.0, n)})
    pdf["hour"] = pdf["timestamp"].dt.hour
    pdf["day_of_week"] = pdf["timestamp"].dt.dayofweek
    return pdf, spark.createDataFrame(pdf)


def test_histogram_matches_numpy(spark):
    pdf, df = wins(spark, 500)
    got = reports.histogram(df, "avg_devices", 30).orderBy("bin").toPandas()
    counts, edges = np.histogram(pdf["avg_devices"], bins=30)
    assert list(got["count"]) == list(counts)
    np.testing.assert_allclose(got["bin_lo"], edges[:-1])
    const = spark.createDataFrame([(1.0,), (1.0,)], "avg_devices double")
    c = reports.histogram(const, "avg_devices", 4).orderBy("bin").toPandas()
    np.testing.assert_allclose(c["bin_lo"], np.histogram([1.0, 1.0], bins=4)[1][:-1])
    assert list(c["count"]) == list(np.histogram([1.0, 1.0], bins=4)[0])


def test_statistics_like_api(spark):
    pdf, df = wins(spark)
    r = reports.statistics(df).first()
    tail = pdf.tail(24)["avg_devices"]
    assert abs(r.today_mean - tail.mean()) < 1e-9 and r.today_max == tail.max()
    assert abs(r.all_time_std - pdf["avg_devices"].std()) < 1e-9
    assert r.current_traffic == pdf["avg_devices"].iloc[-1]


def test_patterns_and_history(spark):
    pdf, df = wins(spark)
    hourly = {r.hour: r.mean for r in reports.hourly_pattern(df).collect()}
    want = pdf.groupby("hour")["avg_devices"].mean()
    assert all(abs(hourly[h] - want[h]) < 1e-9 for h in want.index)
    weekly = reports.weekly_pattern(df).collect()
    assert {r.day for r in weekly if r.day_of_week == 0} == {"Monday"}
    hist = reports.history(df, hours=48).collect()
    assert len(hist) == 13  # 48 h back from the last 4-hour window, both ends included
    as_of = reports.history(df, hours=24, as_of="2024-01-02 00:00:00").collect()
    assert min(r.timestamp for r in as_of) == dt.datetime(2024, 1, 1, 0, 0)


def test_latest_and_last_rows(spark):
    pdf, df = wins(spark)
    assert reports.latest(df).first().timestamp == pdf["timestamp"].max().to_pydatetime()
    assert reports.last_rows(df, 5).count() == 5
