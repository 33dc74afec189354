"""Stored tables: days processed in parts, snapshots that survive a failure,
one scan log for batch and stream, retention by folder, counted drops."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from passage.config import Config
from passage.operators import clean, presence, windows
from passage.plans import incremental
from passage.schemas import SCAN
from passage.sinks import files, folders
from passage.sources import scans as S
from passage.streaming import live

CFG = Config(scan_interval=3600, stationary_threshold=30 * 3600, device_timeout=7 * 3600, window_hours=4)
D0 = dt.date(2024, 1, 1)
RAW = "site_id string, timestamp timestamp, scan_id long, mac_hash string, rssi int, protocol string, arrival long"


def sightings(spark):
    """Six days: ``stay`` is open across every midnight, ``shift`` leaves and
    returns within the timeout across one, the others come and go."""
    rows, t0 = [], dt.datetime(2024, 1, 1)
    for h in range(6 * 24):
        t = t0 + dt.timedelta(hours=h)
        seen = {"stay": True, "shift": 20 <= h < 24 or 28 <= h < 60, "night": t.hour in (22, 23, 0, 1),
                "rare": h % 37 == 0, "late": h > 100 and h % 6 == 0}
        for i, (mac, here) in enumerate(seen.items()):
            if here and not (60 <= h < 72 and mac == "stay"):
                rows.append(("a" if mac != "rare" else "b", t, h, mac, -50 - i, "ble", 10 * h + i))
    return spark.createDataFrame(rows, RAW).cache()


def whole(raw, rule):
    det = clean.rssi_filter(clean.fill_defaults(raw), CFG)
    out = presence.transient_only(det, CFG, break_rule=rule, scans=raw.select("site_id", "timestamp"), dedupe=True)
    return sorted((r.site_id, r.timestamp, r.mac_hash) for r in out.collect())


def stored(spark, path, raw):
    out = incremental.read_days(spark, path, "transient", clean.fill_defaults(raw))
    return sorted((r.site_id, r.timestamp, r.mac_hash) for r in out.collect())


@pytest.mark.parametrize("rule,cuts", [("scan", (1, 2, 3, 4, 5)), ("gap", (2, 3)), ("tick", (1, 5))])
def test_any_split_of_the_days_gives_the_full_run(spark, tmpdir_str, rule, cuts):
    raw = sightings(spark)
    at = [0, *cuts, 6]
    for a, b in zip(at, at[1:]):
        incremental.run_days(raw, tmpdir_str, CFG, D0 + dt.timedelta(a), D0 + dt.timedelta(b), break_rule=rule)
    want = whole(raw, rule)
    assert stored(spark, tmpdir_str, raw) == want and 0 < len(want) < raw.count()


def test_days_are_run_again_and_stopped_runs_repeat(spark, tmpdir_str, monkeypatch):
    raw = sightings(spark)
    day = [D0 + dt.timedelta(i) for i in range(7)]
    incremental.run_days(raw, tmpdir_str, CFG, day[0], day[2])
    real = folders.publish
    monkeypatch.setattr(folders, "publish", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        incremental.run_days(raw, tmpdir_str, CFG, day[2], day[4])
    monkeypatch.setattr(folders, "publish", real)
    assert incremental.next_day(spark, tmpdir_str) == day[2]  # the stopped run left no marker
    with pytest.raises(ValueError):
        incremental.run_days(raw, tmpdir_str, CFG, day[4], day[6])
    incremental.run_days(raw, tmpdir_str, CFG, day[2], day[6])
    # an earlier part again: what came after depends on it and is run once more
    incremental.run_days(raw, tmpdir_str, CFG, day[0], day[2])
    assert incremental.next_day(spark, tmpdir_str) == day[2]
    incremental.run_days(raw, tmpdir_str, CFG, day[2], day[6])
    assert stored(spark, tmpdir_str, raw) == whole(raw, "scan")
    carried = spark.read.parquet(f"{tmpdir_str}/open/as_of={day[6]}")
    # a device gone for longer than the timeout is not carried; the only scans of site b are those of "rare"
    assert {r.mac_hash for r in carried.collect()} == {"stay", "night", "late", "rare"}


def test_snapshot_survives_a_stop_between_any_two_writes(spark, tmpdir_str, monkeypatch):
    def rows(*r):
        return spark.createDataFrame(list(r), "site_id string, v int")

    def state():
        snap = live.read_snapshot(spark, tmpdir_str)
        return None if snap is None else sorted(tuple(r) for r in snap.collect())

    assert state() is None
    assert live.publish_snapshot(rows(("a", 1), ("b", 1)), tmpdir_str, "q", 0)
    real = folders.publish
    monkeypatch.setattr(folders, "publish", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):  # the rows are written, the manifest is not
        live.publish_snapshot(rows(("a", 2)), tmpdir_str, "q", 1)
    monkeypatch.setattr(folders, "publish", real)
    assert state() == [("a", 1), ("b", 1)]
    assert live.publish_snapshot(rows(("a", 2)), tmpdir_str, "q", 1)
    assert not live.publish_snapshot(rows(("a", 9)), tmpdir_str, "q", 1)  # replayed after the manifest
    assert state() == [("a", 2), ("b", 1)]
    for i in range(2, 7):  # a new checkpoint counts its epochs from 0 again
        assert live.publish_snapshot(rows(("c", i)), tmpdir_str, "r", i - 2)
    assert state() == [("a", 2), ("b", 1), ("c", 6)]
    assert len(os.listdir(f"{tmpdir_str}/data")) == live.KEPT_SNAPSHOTS


def scan_rows(spark, n, day=1):
    dev = [("m", -50, "ble")]
    return spark.createDataFrame([("s", dt.datetime(2024, 1, day, i), i, 1, dev) for i in range(n)], SCAN)


def test_batch_and_stream_share_one_scan_log(spark, tmpdir_str):
    src, out = f"{tmpdir_str}/in", f"{tmpdir_str}/log"
    os.makedirs(src)
    with open(f"{src}/scan_20240102.jsonl", "w") as f:
        for i in range(3):
            f.write(json.dumps({"site_id": "s", "timestamp": f"2024-01-02T0{i}:00:00", "scan_id": i, "device_count": 1,
                                "devices": [{"mac_hash": "m", "rssi": -50, "protocol": "ble"}]}) + "\n")
    files.append_scans(scan_rows(spark, 2), out)
    live.start_scan_log(S.stream_scans(spark, src), out, f"log-{os.path.basename(tmpdir_str)}").awaitTermination()
    files.append_scans(scan_rows(spark, 4), out, write_id="again")
    files.append_scans(scan_rows(spark, 4), out, write_id="again")  # a repeated write replaces its own rows
    assert S.read_scans(spark, out, glob=None).count() == 2 + 3 + 4
    assert "write_id" not in S.read_scans(spark, out, glob=None).columns


def test_a_write_makes_a_file_a_day_not_one_a_task_and_day(spark, tmpdir_str):
    days, rows = 5, None
    for day in range(1, days + 1):
        rows = scan_rows(spark, 20, day) if rows is None else rows.unionByName(scan_rows(spark, 20, day))
    files.append_scans(rows.repartition(16), f"{tmpdir_str}/log")
    made = [f for _, _, names in os.walk(f"{tmpdir_str}/log") for f in names if f.endswith(".json")]
    assert len(made) == days
    assert S.read_scans(spark, f"{tmpdir_str}/log", glob=None).count() == 20 * days


def test_retention_removes_folders_before_the_cut_off_day(spark, tmpdir_str):
    for day in (1, 2, 3):
        files.append_scans(scan_rows(spark, 2, day), f"{tmpdir_str}/raw")
    # 30 days before this is 2024-01-02 12:00: the second day has rows on both sides and stays
    gone = folders.expire(spark, f"{tmpdir_str}/raw", "2024-02-01 12:00:00", 30, listed_at=f"{tmpdir_str}/gone")
    assert [r.date.day for r in gone.collect()] == [1]
    left = {r.timestamp.day for r in S.read_scans(spark, f"{tmpdir_str}/raw", glob=None).collect()}
    assert left == {2, 3}
    assert spark.read.json(f"{tmpdir_str}/gone").count() == 1
    assert folders.expire(spark, f"{tmpdir_str}/raw", "2024-02-02 00:00:00", 30).count() == 1  # its end is the cut-off
    assert folders.expire(spark, f"{tmpdir_str}/raw", "2024-12-31 00:00:00", 365).count() == 0
    assert folders.expire(spark, f"{tmpdir_str}/none", "2024-02-02", 30).count() == 0


def test_corrupt_and_undated_lines_are_counted_as_they_are_read(spark, tmpdir_str):
    with open(f"{tmpdir_str}/scan_1.jsonl", "w") as f:
        f.write('{"site_id": "s", "timestamp": "2024-01-01T00:00:00", "scan_id": 1}\nnot json {\n{"site_id": "s", "scan_id": 2}\n')
    seen = Observation()
    assert len(S.read_scans(spark, tmpdir_str, seen=seen).collect()) == 1
    assert seen.get == {"rows": 3, "dropped": 2, "corrupt": 1, "undated": 1}
    assert S.corrupt_lines(spark, tmpdir_str).count() == 2


def test_late_rows_of_the_live_filter_are_counted(spark, tmpdir_str):
    from passage.operators.counted import late_rows
    cols = "site_id string, timestamp timestamp, scan_id long, mac_hash string, rssi int, protocol string"
    batches = [[12], [30, 31], [2, 3, 29], [1]]  # hours; the watermark is six hours back
    for i, hours in enumerate(batches):
        rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), h, f"m{h}", -50, "ble") for h in hours]
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(f"{tmpdir_str}/in")
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(f"{tmpdir_str}/in")
    out, q = live.run_to_table(spark, live.live_transient(stream, CFG), "late")
    kept = spark.read.parquet(out).count()
    assert late_rows(q) == 3 and kept + late_rows(q) == sum(map(len, batches))


def test_panes_give_the_windows_of_every_scan(spark):
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * i * (1 + 20 * (i % 11 == 0))), (i * i) % 23)
            for i in range(120) for s in ("a", "b") if (i + len(s)) % 5]
    counts = spark.createDataFrame(rows, "site_id string, timestamp timestamp, device_count long")
    got = windows.sliding_window_counts(counts, Config(), window_hours=24, slide_hours=3)
    plain = counts.groupBy("site_id", windows._window_start("timestamp", 24, 3).alias("timestamp")).agg(*windows._stats())

    def rounded(df):
        return sorted((r.site_id, r.timestamp, round(r.avg_devices, 9), r.std_devices and round(r.std_devices, 9),
                       r.min_devices, r.max_devices, r.total_devices, r.num_scans) for r in df.collect())
    assert rounded(got) == rounded(plain)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan.split("Exchange")[-1]  # no scan is multiplied before the exchange


def test_united_sketches_equal_one_sketch_over_the_span(spark):
    det = spark.range(40_000).select(
        F.lit("s").alias("site_id"), F.concat(F.lit("m"), F.col("id") % 9000).alias("mac_hash"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 86_400).alias("timestamp"))
    day = windows.unite_sketches(windows.unite_sketches(windows.device_sketches(det), 4), 24).first()
    assert day.detections == 40_000
    assert abs(day.unique_devices - 9000) <= windows.sketch_error() * 9000
