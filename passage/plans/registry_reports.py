"""Registered read-model, pattern-tier, forecast-baseline and declared
queries (imported by ``registry``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from passage.functions.present import present
from passage.operators import declared, features, forecast, patterns, reports
from passage.plans import batch
from passage.plans import sqltwins as sq
from passage.plans.catalog import CFG1, CFG4, _with, register

W = sq.WINDOW_DOUBLES
ML_DOUBLES = [*W, *sq.feature_doubles(CFG1)]


def win4(spark, sf_dir):
    return batch.window_table(spark, sf_dir, CFG4)


def ml1(spark, sf_dir):
    return batch.ml_table(spark, sf_dir, CFG1, 1)


def target1(spark, sf_dir):
    return features.target(ml1(spark, sf_dir), CFG1)


WIN4_SQL = (sq.base_ctes(CFG4), sq.window_cte("win0", CFG4, 4), f"\nwin AS ({sq.with_time('win0')})")
ML1_SQL = (sq.base_ctes(CFG1), sq.window_cte("win0", CFG1, 1), f"\nwin AS ({sq.with_time('win0')})",
           sq.ml_cte("ml", CFG1, "win"))
TGT1_SQL = (*ML1_SQL, f"""
tgt AS (SELECT * FROM (SELECT *, lead(avg_devices, {CFG1.forecast_horizon})
                                  OVER (PARTITION BY site_id ORDER BY timestamp) AS avg_devices_future FROM ml) t
        WHERE avg_devices_future IS NOT NULL)""")


# ------------------------------------------------------------- read models --

@register("dataset_stats", _with(*ML1_SQL) + """
SELECT site_id, count(*) AS total_records, min(timestamp) AS start, max(timestamp) AS "end",
       avg(avg_devices) AS mean_devices, stddev_samp(avg_devices) AS std_devices,
       min(avg_devices) AS min_devices, max(avg_devices) AS max_devices,
       CAST(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400e6) AS BIGINT) AS days
FROM ml GROUP BY site_id""", doubles=("mean_devices", "std_devices", "min_devices", "max_devices"))
def q_dataset_stats(spark, sf_dir):
    return present(reports.dataset_stats(ml1(spark, sf_dir)))


@register("dataset_metadata", _with(*ML1_SQL) + f"""
SELECT count(*) AS num_records, min(timestamp) AS start, max(timestamp) AS "end",
       [{", ".join(repr(c) for c in sq.ml_columns(CFG1))}] AS columns
FROM ml""")
def q_metadata(spark, sf_dir):
    return present(reports.metadata(ml1(spark, sf_dir)).drop("processing_date"))


@register("traffic_statistics", _with(*ML1_SQL) + f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp DESC) AS rn FROM ml)
SELECT site_id, arg_max(avg_devices, timestamp) AS current_traffic, max(timestamp) AS current_timestamp,
       avg(avg_devices) FILTER (WHERE rn <= {CFG1.today_windows}) AS today_mean,
       max(avg_devices) FILTER (WHERE rn <= {CFG1.today_windows}) AS today_max,
       min(avg_devices) FILTER (WHERE rn <= {CFG1.today_windows}) AS today_min,
       avg(avg_devices) AS all_time_mean, max(avg_devices) AS all_time_max,
       min(avg_devices) AS all_time_min, stddev_samp(avg_devices) AS all_time_std
FROM ranked GROUP BY site_id""", doubles=("current_traffic", "today_mean", "today_max", "today_min",
                                          "all_time_mean", "all_time_max", "all_time_min", "all_time_std"))
def q_statistics(spark, sf_dir):
    return present(reports.statistics(ml1(spark, sf_dir), today_rows=CFG1.today_windows))


@register("hourly_pattern", _with(*ML1_SQL) + """
SELECT site_id, hour, avg(avg_devices) AS mean, stddev_samp(avg_devices) AS std FROM ml GROUP BY site_id, hour""",
          doubles=("mean", "std"))
def q_hourly(spark, sf_dir):
    return present(reports.hourly_pattern(ml1(spark, sf_dir)))


@register("weekly_pattern", _with(*ML1_SQL) + """
SELECT site_id, day_of_week, avg(avg_devices) AS mean, stddev_samp(avg_devices) AS std,
       ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][day_of_week + 1] AS day
FROM ml GROUP BY site_id, day_of_week""", doubles=("mean", "std"))
def q_weekly(spark, sf_dir):
    return present(reports.weekly_pattern(ml1(spark, sf_dir)))


@register("history_48h", _with(*ML1_SQL) + f"""
SELECT site_id, timestamp, avg_devices AS traffic, hour, day_of_week FROM (
  SELECT *, max(timestamp) OVER (PARTITION BY site_id) AS now FROM ml) t
WHERE timestamp >= now - INTERVAL {CFG1.history_hours} HOUR""", doubles=("traffic",))
def q_history(spark, sf_dir):
    return present(reports.history(ml1(spark, sf_dir), CFG1.history_hours))


@register("latest_window", _with(*WIN4_SQL) + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp DESC) AS rn FROM win) t
WHERE rn = 1""".replace("SELECT * FROM (SELECT *", "SELECT * EXCLUDE (rn) FROM (SELECT *"), doubles=W)
def q_latest(spark, sf_dir):
    return present(reports.latest(win4(spark, sf_dir)))


@register("last_24_windows", _with(*WIN4_SQL) + """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp DESC) AS rn
                            FROM win) t WHERE rn <= 24""", doubles=W)
def q_last24(spark, sf_dir):
    return present(reports.last_rows(win4(spark, sf_dir), 24))


@register("scan_summary", _with(sq.base_ctes(CFG4)) + """
SELECT site_id, count(DISTINCT (scan_id, timestamp)) AS total_scans, count(*) AS total_detections,
       min(timestamp) AS start, max(timestamp) AS "end",
       count(*) / count(DISTINCT (scan_id, timestamp)) AS avg_devices_per_scan
FROM raw GROUP BY site_id""", doubles=("avg_devices_per_scan",))
def q_scan_summary(spark, sf_dir):
    return present(reports.scan_summary(batch.raw_detections(spark, sf_dir)))


# ---------------------------------------------------------------- tiers -----

TIERS_SQL = (*WIN4_SQL, """
tiers AS (
  SELECT *, CAST(CASE WHEN avg_devices < p_low THEN 0 WHEN avg_devices > p_high THEN 2 ELSE 1 END AS INTEGER) AS tier
  FROM (SELECT *, quantile_cont(avg_devices, 0.1) OVER (PARTITION BY site_id) AS p_low,
                  quantile_cont(avg_devices, 0.7) OVER (PARTITION BY site_id) AS p_high FROM win) t),
tiered AS (SELECT *, ['Quiet', 'Moderate', 'Busy'][tier + 1] AS tier_label FROM tiers)""")


def tiers4(spark, sf_dir):
    return patterns.percentile_tiers(win4(spark, sf_dir))


@register("percentile_tiers", _with(*TIERS_SQL) + """
SELECT * FROM tiered""", doubles=(*W, "p_low", "p_high"))
def q_tiers(spark, sf_dir):
    return present(tiers4(spark, sf_dir))


@register("tier_profile", _with(*TIERS_SQL) + """
SELECT site_id, tier_label, count(*) AS count, avg(avg_devices) AS mean, stddev_samp(avg_devices) AS std
FROM tiered GROUP BY site_id, tier_label""", doubles=("mean", "std"))
def q_tier_profile(spark, sf_dir):
    return present(reports.group_profile(tiers4(spark, sf_dir), "tier_label", ["site_id"]))


@register("tier_hour_means", _with(*TIERS_SQL) + """
SELECT site_id, hour,
       avg(avg_devices) FILTER (WHERE tier_label = 'Quiet') AS Quiet,
       avg(avg_devices) FILTER (WHERE tier_label = 'Moderate') AS Moderate,
       avg(avg_devices) FILTER (WHERE tier_label = 'Busy') AS Busy
FROM tiered GROUP BY site_id, hour""", doubles=("Quiet", "Moderate", "Busy"))
def q_tier_hour(spark, sf_dir):
    return present(reports.pivot_means(tiers4(spark, sf_dir), "hour", "tier_label",
                                       ["Quiet", "Moderate", "Busy"], keys=["site_id"]))


@register("tier_weekday_means", _with(*TIERS_SQL) + """
SELECT site_id, day_of_week,
       avg(avg_devices) FILTER (WHERE tier_label = 'Quiet') AS Quiet,
       avg(avg_devices) FILTER (WHERE tier_label = 'Moderate') AS Moderate,
       avg(avg_devices) FILTER (WHERE tier_label = 'Busy') AS Busy
FROM tiered GROUP BY site_id, day_of_week""", doubles=("Quiet", "Moderate", "Busy"))
def q_tier_day(spark, sf_dir):
    return present(reports.pivot_means(tiers4(spark, sf_dir), "day_of_week", "tier_label",
                                       ["Quiet", "Moderate", "Busy"], keys=["site_id"]))


def _hist_sql(src: str, value: str, bins: int, by: list[str]) -> str:
    g = ", ".join(by) if by else "1"
    on = " AND ".join(f"t.{b} = r.{b}" for b in by) if by else "TRUE"
    sel_by = ", ".join(f"r.{b}" for b in by) + (", " if by else "")
    return f"""
, rng0 AS (SELECT {g + ',' if by else ''} min({value}) AS mn, max({value}) AS mx FROM {src}
           WHERE {value} IS NOT NULL {'GROUP BY ' + g if by else ''}),
rng AS (SELECT *, CASE WHEN mx > mn THEN mn ELSE mn - 0.5 END AS lo, CASE WHEN mx > mn THEN mx ELSE mx + 0.5 END AS hi
        FROM rng0 WHERE mn IS NOT NULL),
cnt AS (SELECT {sel_by} CAST(least(floor((t.{value} - r.lo) / (r.hi - r.lo) * {bins}), {bins - 1}) AS INTEGER) AS bin,
               count(*) AS c
        FROM {src} t JOIN rng r ON {on} WHERE t.{value} IS NOT NULL GROUP BY ALL),
spine AS (SELECT r.*, CAST(unnest(range(0, {bins})) AS INTEGER) AS bin FROM rng r)
SELECT {", ".join(f"s.{b}" for b in by) + ", " if by else ""} s.bin,
       s.lo + s.bin * ((s.hi - s.lo) / {float(bins)}) AS bin_lo,
       s.lo + (s.bin + 1) * ((s.hi - s.lo) / {float(bins)}) AS bin_hi,
       CAST(COALESCE(c.c, 0) AS BIGINT) AS count
FROM spine s LEFT JOIN cnt c ON s.bin = c.bin {''.join(f' AND s.{b} = c.{b}' for b in by)}"""


@register("tier_traffic_histogram", _with(*TIERS_SQL) + _hist_sql("tiered", "avg_devices", 30,
                                                                   ["site_id", "tier_label"]),
          doubles=("bin_lo", "bin_hi"))
def q_tier_hist(spark, sf_dir):
    return present(reports.histogram(tiers4(spark, sf_dir), "avg_devices", 30, ["site_id", "tier_label"]))


# ------------------------------------------------------- forecast baselines --

BASE_SQL = (*TGT1_SQL, f"""
split AS (
  SELECT *, row_index <= floor(n * {CFG1.train_fraction}) AS is_train FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp) AS row_index,
           count(*) OVER (PARTITION BY site_id) AS n FROM tgt) t),
fit AS (
  SELECT site_id, regr_slope(avg_devices, CAST(row_index AS DOUBLE)) AS b,
         regr_intercept(avg_devices, CAST(row_index AS DOUBLE)) AS a
  FROM split WHERE is_train GROUP BY site_id),
base AS (
  SELECT s.* EXCLUDE (n),
         lag(s.avg_devices, {24 - CFG1.forecast_horizon}) OVER (PARTITION BY s.site_id ORDER BY s.timestamp) AS pred_naive,
         avg(s.avg_devices) OVER (PARTITION BY s.site_id ORDER BY s.timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)
           AS pred_moving_avg,
         f.a + f.b * (CAST(s.row_index AS DOUBLE) + {float(CFG1.forecast_horizon)}) AS pred_linear
  FROM split s LEFT JOIN fit f ON s.site_id = f.site_id)""")
BASE_DOUBLES = [*ML_DOUBLES, "avg_devices_future", "pred_naive", "pred_moving_avg", "pred_linear"]


def base1(spark, sf_dir):
    return forecast.baselines(target1(spark, sf_dir), CFG1)


@register("train_test_split", _with(*BASE_SQL) + """
SELECT site_id, timestamp, row_index, is_train FROM split""")
def q_split(spark, sf_dir):
    d = features.split_flags(target1(spark, sf_dir), CFG1)
    return present(d.select("site_id", "timestamp", F.col("row_index").cast("long").alias("row_index"), "is_train"))


@register("baseline_forecasts", _with(*BASE_SQL) + """
SELECT * FROM base""", doubles=BASE_DOUBLES)
def q_baselines(spark, sf_dir):
    d = base1(spark, sf_dir)
    return present(d.withColumn("row_index", F.col("row_index").cast("long")))


def _metrics_sql(actual: str, pred: str, by: str, src: str, where: str = "TRUE") -> str:
    return f"""
SELECT {by}, count(({actual}) - ({pred})) AS n,
       sum((({actual}) - ({pred})) ^ 2) / count(({actual}) - ({pred})) AS mse,
       sqrt(sum((({actual}) - ({pred})) ^ 2) / count(({actual}) - ({pred}))) AS rmse,
       avg(abs(({actual}) - ({pred}))) AS mae,
       1 - sum((({actual}) - ({pred})) ^ 2)
           / (var_pop(CASE WHEN ({actual}) - ({pred}) IS NOT NULL THEN {actual} END) * count(({actual}) - ({pred}))) AS r2,
       avg(abs((({actual}) - ({pred})) / CASE WHEN {actual} <> 0 THEN {actual} END)) * 100 AS mape,
       count(*) FILTER (WHERE ({actual}) - ({pred}) IS NOT NULL AND {actual} = 0) AS zero_actuals
FROM {src} WHERE {where} GROUP BY {by}"""


METRIC_DOUBLES = ("mse", "rmse", "mae", "r2", "mape")


@register("baseline_metrics", _with(*BASE_SQL) + """
, long AS (
  SELECT site_id, 'naive' AS method, avg_devices_future AS y, pred_naive AS p FROM base WHERE NOT is_train
  UNION ALL SELECT site_id, 'moving_avg', avg_devices_future, pred_moving_avg FROM base WHERE NOT is_train
  UNION ALL SELECT site_id, 'linear', avg_devices_future, pred_linear FROM base WHERE NOT is_train)
""" + _metrics_sql("y", "p", "site_id, method", "long"), doubles=METRIC_DOUBLES)
def q_baseline_metrics(spark, sf_dir):
    d = base1(spark, sf_dir).where(~F.col("is_train"))
    long = None
    for m in ("naive", "moving_avg", "linear"):
        part = d.select("site_id", F.lit(m).alias("method"), F.col("avg_devices_future").alias("y"),
                        F.col(f"pred_{m}").alias("p"))
        long = part if long is None else long.unionByName(part)
    return present(forecast.metrics(long, "y", "p", ["site_id", "method"]))


@register("directional_accuracy", _with(*BASE_SQL) + """
SELECT site_id, avg(CAST(sign(pred_moving_avg - avg_devices) = sign(avg_devices_future - avg_devices) AS DOUBLE))
         AS directional_accuracy,
       count(sign(pred_moving_avg - avg_devices) = sign(avg_devices_future - avg_devices)) AS n
FROM base WHERE NOT is_train GROUP BY site_id""", doubles=("directional_accuracy",))
def q_directional(spark, sf_dir):
    d = base1(spark, sf_dir).where(~F.col("is_train"))
    return present(forecast.directional_accuracy(d, "avg_devices_future", "pred_moving_avg", keys=["site_id"]))


@register("blended_forecast", _with(*BASE_SQL) + """
SELECT site_id, timestamp, avg_devices_future, pred_naive, pred_moving_avg,
       0.6 * pred_naive + 0.4 * pred_moving_avg AS pred_blend
FROM base""", doubles=("avg_devices_future", "pred_naive", "pred_moving_avg", "pred_blend"))
def q_blend(spark, sf_dir):
    d = forecast.blend(base1(spark, sf_dir), "pred_naive", "pred_moving_avg", 0.6)
    return present(d.select("site_id", "timestamp", "avg_devices_future", "pred_naive", "pred_moving_avg",
                            "pred_blend"))


@register("residual_histogram", _with(*BASE_SQL) + """
, res AS (SELECT avg_devices_future - pred_moving_avg AS residual FROM base WHERE NOT is_train)
""" + _hist_sql("res", "residual", 50, []), doubles=("bin_lo", "bin_hi"))
def q_residual_hist(spark, sf_dir):
    d = reports.residuals(base1(spark, sf_dir).where(~F.col("is_train")), "avg_devices_future", "pred_moving_avg")
    return present(reports.histogram(d, "residual", 50))


@register("cv_linear_trend", _with(*ML1_SQL) + f"""
, d AS (SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY timestamp) AS DOUBLE) AS x,
               lead(avg_devices, {CFG1.forecast_horizon}) OVER (PARTITION BY site_id ORDER BY timestamp) AS y,
               ntile(5) OVER (PARTITION BY site_id ORDER BY timestamp) AS tile FROM ml),
folds AS (SELECT *, unnest(range(1, 5)) AS fold FROM d),
fits AS (SELECT site_id, fold, regr_slope(avg_devices, x) AS b, regr_intercept(avg_devices, x) AS a
         FROM folds WHERE tile <= fold GROUP BY site_id, fold),
test AS (SELECT f.site_id, f.fold, f.y, t.a + t.b * (f.x + {float(CFG1.forecast_horizon)}) AS p
         FROM folds f JOIN fits t ON f.site_id = t.site_id AND f.fold = t.fold
         WHERE f.tile = f.fold + 1 AND f.y IS NOT NULL)
""" + _metrics_sql("y", "p", "site_id, fold", "test"), doubles=METRIC_DOUBLES)
def q_cv(spark, sf_dir):
    out = forecast.cv_linear_trend(ml1(spark, sf_dir), CFG1, n_folds=4)
    return present(out.withColumn("fold", F.col("fold").cast("long")))


# --------------------------------------------------------------- declared ---

@register("rotating_hashes", _with(sq.base_ctes(CFG4)) + f"""
SELECT site_id, timestamp, scan_id, rssi, protocol,
       CAST(floor(date_diff('day', DATE '1970-01-01', CAST(timestamp AS DATE)) / {CFG4.salt_rotation_days}) AS BIGINT) AS salt_epoch,
       sha256(mac_hash || sha256('rotation-secret' || CAST(CAST(floor(date_diff('day', DATE '1970-01-01',
              CAST(timestamp AS DATE)) / {CFG4.salt_rotation_days}) AS BIGINT) AS VARCHAR))) AS rotated_hash
FROM det""")
def q_rotating(spark, sf_dir):
    det = batch.clean_detections(spark, sf_dir, CFG4)
    out = declared.rotating_hash(det, "rotation-secret", CFG4, id_col="mac_hash", out="rotated_hash")
    return present(out.select("site_id", "timestamp", "scan_id", "rssi", "protocol", "salt_epoch", "rotated_hash"))


# fixed values: the public holidays inside the test data's month
HOLIDAYS_2024_01 = (("2024-01-01", "New Year's Day"), ("2024-01-15", "Martin Luther King Jr. Day"))


@register("holiday_windows", _with(*WIN4_SQL) + f"""
, cal AS (SELECT * FROM (VALUES {", ".join(f"(DATE '{d}', '{n.replace(chr(39), chr(39) * 2)}')" for d, n in HOLIDAYS_2024_01)})
          AS c(date, holiday))
SELECT w.*, c.holiday, c.holiday IS NOT NULL AS is_holiday
FROM win w LEFT JOIN cal c ON CAST(w.timestamp AS DATE) = c.date""", doubles=W)
def q_holidays(spark, sf_dir):
    cal = spark.createDataFrame(list(HOLIDAYS_2024_01), "date string, holiday string")
    return present(declared.holiday_flags(win4(spark, sf_dir), cal))


@register("interpolated_windows_1h", _with(sq.base_ctes(CFG1), sq.window_cte("win", CFG1, 1).replace(
    f"HAVING count(*) >= {CFG1.min_scans_per_window}", "")) + """,
bounds AS (SELECT site_id, min(timestamp) AS lo, max(timestamp) AS hi FROM win GROUP BY site_id),
spine AS (SELECT site_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS timestamp FROM bounds),
filled AS (
  SELECT s.site_id, s.timestamp, w.avg_devices, w.std_devices, w.min_devices, w.max_devices,
         COALESCE(w.total_devices, 0) AS total_devices, COALESCE(w.num_scans, 0) AS num_scans
  FROM spine s LEFT JOIN win w ON s.site_id = w.site_id AND s.timestamp = w.timestamp),
nb AS (SELECT *, lag(avg_devices) OVER (PARTITION BY site_id ORDER BY timestamp) AS pv,
              lead(avg_devices) OVER (PARTITION BY site_id ORDER BY timestamp) AS nx FROM filled)
SELECT site_id, timestamp, CASE WHEN avg_devices IS NULL AND pv IS NOT NULL AND nx IS NOT NULL
                                THEN (pv + nx) / 2 ELSE avg_devices END AS avg_devices,
       std_devices, min_devices, max_devices, total_devices, num_scans,
       """ + sq.time_cols() + """,
       avg_devices IS NULL AND pv IS NOT NULL AND nx IS NOT NULL AS interpolated
FROM nb""", doubles=W)
def q_interp(spark, sf_dir):
    d = batch.window_table(spark, sf_dir, CFG1, keep_empty=True)
    return present(declared.interpolate_single_gaps(d))


@register("retrain_gate", _with(*ML1_SQL) + f"""
SELECT site_id, count(*) AS samples, max(timestamp) AS latest, count(*) >= {CFG1.retrain_min_samples} AS retrain_due
FROM ml GROUP BY site_id""")
def q_retrain(spark, sf_dir):
    return present(declared.retrain_due(ml1(spark, sf_dir), CFG1))


# sites last trained 0, 4, 8 and 12 days before their newest row: those of 7 days and more are due
CFG1_DUE = CFG1.with_(retrain_min_samples=100)  # the default of 1,000 hides the age test on small tables


@register("retrain_gate_trained", _with(*ML1_SQL) + f"""
SELECT *, samples >= {CFG1_DUE.retrain_min_samples} AND epoch_us(latest) - epoch_us(last_trained) >= {CFG1_DUE.retrain_every_days} * 86400000000 AS retrain_due
FROM (SELECT site_id, count(*) AS samples, max(timestamp) AS latest,
             max(timestamp - 4 * CAST(right(CAST(site_id AS VARCHAR), 1) AS INTEGER) * INTERVAL 1 DAY) AS last_trained FROM ml GROUP BY site_id) t""")
def q_retrain_trained(spark, sf_dir):
    days = F.substring(F.col("site_id").cast("string"), -1, 1).cast("int") * 4
    d = ml1(spark, sf_dir).withColumn("trained", F.timestamp_micros(F.unix_micros("timestamp") - days.cast("long") * 86_400_000_000))
    return present(declared.retrain_due(d, CFG1_DUE, last_trained="trained"))


@register("retained_windows", _with(*WIN4_SQL) + """
SELECT * EXCLUDE (now) FROM (SELECT *, max(timestamp) OVER (PARTITION BY site_id) AS now FROM win) t
WHERE timestamp >= now - INTERVAL 7 DAY""", doubles=W)
def q_retained(spark, sf_dir):
    from pyspark.sql import Window
    d = win4(spark, sf_dir)
    now = F.max("timestamp").over(Window.partitionBy("site_id"))
    return present(declared.retain(d, now, 7))


@register("detection_rate", _with(sq.base_ctes(CFG4)) + f"""
SELECT site_id, CAST(timestamp AS DATE) AS date, count(DISTINCT (scan_id, timestamp)) AS logged_scans,
       {86400.0 / CFG4.scan_interval} AS possible_scans,
       count(DISTINCT (scan_id, timestamp)) / {86400.0 / CFG4.scan_interval} AS detection_rate
FROM transient GROUP BY site_id, CAST(timestamp AS DATE)""", doubles=("possible_scans", "detection_rate"))
def q_detection_rate(spark, sf_dir):
    return present(declared.detection_rate(batch.transient_detections(spark, sf_dir, CFG4), CFG4))


@register("city_rollup", _with(*WIN4_SQL) + """
SELECT timestamp, sum(avg_devices) AS total_avg_devices, sum(total_devices) AS total_devices,
       sum(num_scans) AS num_scans, count(*) AS sites
FROM win GROUP BY timestamp""", doubles=("total_avg_devices",))
def q_city(spark, sf_dir):
    return present(declared.city_rollup(win4(spark, sf_dir)))


@register("lag_features_hours_1h", _with(sq.base_ctes(CFG1), sq.window_cte("win0", CFG1, 1),
                                         f"\nwin AS ({sq.with_time('win0')})") + f"""
SELECT *, {", ".join(
    f"first(avg_devices) OVER (PARTITION BY site_id ORDER BY timestamp RANGE BETWEEN INTERVAL {n} HOUR PRECEDING "
    f"AND INTERVAL {n} HOUR PRECEDING) AS avg_devices_lag_{n}h" for n in CFG1.lag_periods)}
FROM win""", doubles=[*W, *sq.feature_doubles(CFG1, rolling=False)])
def q_hour_lags(spark, sf_dir):
    """Lags by elapsed hours: a missing window gives NULL instead of
    shifting the lag onto an older window."""
    return present(features.lags(batch.window_table(spark, sf_dir, CFG1), CFG1, unit="hours"))
