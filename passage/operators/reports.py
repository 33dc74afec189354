"""Read models and summaries: dataset statistics, traffic statistics,
hourly / weekly patterns, history, latest rows, histograms, profiles.

All are per-key aggregates or per-key window functions over the window
table (small per key); "now" is an explicit ``as_of`` or, when omitted, each
key's latest window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passage.functions.labels import day_name
from passage.functions.timecols import seconds_between
from passage.operators import DEFAULT_KEYS

V = "avg_devices"


def dataset_stats(df: DataFrame, keys=DEFAULT_KEYS, value: str = V) -> DataFrame:
    """Rows, first/last timestamp, whole days covered, mean/std/min/max."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"),
        F.avg(value).alias("mean_devices"), F.stddev_samp(value).alias("std_devices"),
        F.min(value).alias("min_devices"), F.max(value).alias("max_devices"))
    return out.withColumn("days", F.floor(seconds_between("end", "start") / F.lit(86400.0)).cast("long"))


def metadata(df: DataFrame, keys=(), processing_time: Column | str | None = None) -> DataFrame:
    """Dataset metadata: record count, date range, column list, processing
    time (``current_timestamp()`` unless given)."""
    cols = F.array(*[F.lit(c) for c in df.columns])
    pt = (F.current_timestamp() if processing_time is None else
          (F.lit(processing_time).cast("timestamp") if isinstance(processing_time, str) else processing_time))
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_records"),
                                  F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
              .withColumn("columns", cols).withColumn("processing_date", pt))


def statistics(df: DataFrame, keys=DEFAULT_KEYS, value: str = V, today_rows: int = 24) -> DataFrame:
    """Current value (latest row), 'today' = the last ``today_rows`` rows
    (mean/max/min), all-time mean/max/min/std — one row per key."""
    w = Window.partitionBy(*keys).orderBy(F.col("timestamp").desc())
    ranked = df.withColumn("_rn", F.row_number().over(w))
    recent = F.col("_rn") <= F.lit(today_rows)
    v = F.col(value)
    return ranked.groupBy(*keys).agg(
        F.max_by(v, "timestamp").alias("current_traffic"),
        F.max("timestamp").alias("current_timestamp"),
        F.avg(F.when(recent, v)).alias("today_mean"),
        F.max(F.when(recent, v)).alias("today_max"),
        F.min(F.when(recent, v)).alias("today_min"),
        F.avg(v).alias("all_time_mean"), F.max(v).alias("all_time_max"),
        F.min(v).alias("all_time_min"), F.stddev_samp(v).alias("all_time_std"))


def hourly_pattern(df: DataFrame, keys=DEFAULT_KEYS, value: str = V) -> DataFrame:
    return df.groupBy(*keys, "hour").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def weekly_pattern(df: DataFrame, keys=DEFAULT_KEYS, value: str = V) -> DataFrame:
    return (df.groupBy(*keys, "day_of_week")
              .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
              .withColumn("day", day_name(F.col("day_of_week"))))


def history(df: DataFrame, hours: int = 48, as_of=None, keys=DEFAULT_KEYS, value: str = V) -> DataFrame:
    """Rows with ``timestamp >= as_of - hours`` projected to timestamp,
    traffic, hour, day_of_week (plus keys). ``as_of`` defaults to each key's
    latest timestamp."""
    if as_of is None:
        now = F.max("timestamp").over(Window.partitionBy(*keys))
    else:
        now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    cutoff = F.timestamp_micros(F.unix_micros(now) - F.lit(int(hours) * 3_600_000_000))
    out = df.withColumn("_cutoff", cutoff).where(F.col("timestamp") >= F.col("_cutoff"))
    return out.select(*keys, "timestamp", F.col(value).alias("traffic"), "hour", "day_of_week")


def latest(df: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    """The latest row per key (``max_by`` — no sort, partial aggregation)."""
    others = [c for c in df.columns if c not in keys]
    s = F.max_by(F.struct(*others), "timestamp").alias("_last")
    return df.groupBy(*keys).agg(s).select(*keys, "_last.*")


def last_rows(df: DataFrame, n: int, keys=DEFAULT_KEYS) -> DataFrame:
    """The last ``n`` rows per key (per-key top-k, planned as a group limit)."""
    w = Window.partitionBy(*keys).orderBy(F.col("timestamp").desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def histogram(df: DataFrame, value: str, bins: int, by=()) -> DataFrame:
    """Equal-width histogram per group between the group's min and max (the
    last bin is closed; a constant group spans value ± 0.5). Empty bins are
    emitted with count 0. Output: by…, bin, bin_lo, bin_hi, count."""
    by = list(by)
    if not by:
        return _histogram_global(df, value, bins)
    rng = (df.where(F.col(value).isNotNull()).groupBy(*by)
             .agg(F.min(value).alias("_mn"), F.max(value).alias("_mx")))
    rng = (rng.withColumn("_lo", F.when(F.col("_mx") > F.col("_mn"), F.col("_mn")).otherwise(F.col("_mn") - 0.5))
              .withColumn("_hi", F.when(F.col("_mx") > F.col("_mn"), F.col("_mx")).otherwise(F.col("_mx") + 0.5))
              .select(*by, "_lo", "_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    idx = F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(bins)),
                  F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).join(rng, by)
    counts = counts.groupBy(*by, idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = rng.select(*by, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = spine.join(counts, [*by, "bin"], "left")
    return out.select(*by, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
                      (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def _histogram_global(df: DataFrame, value: str, bins: int) -> DataFrame:
    """One histogram over all rows: the range is a scalar subquery (one
    row, evaluated once), so no join with the data is planned."""
    v = F.col(value)
    mn, mx = F.min(v), F.max(v)
    rng = df.agg(F.struct(F.when(mx > mn, mn).otherwise(mn - 0.5).alias("lo"),
                          F.when(mx > mn, mx).otherwise(mx + 0.5).alias("hi")).alias("r")).scalar()
    lo, hi = rng["lo"], rng["hi"]
    width = (hi - lo) / F.lit(float(bins))
    idx = F.least(F.floor((v - lo) / (hi - lo) * F.lit(bins)), F.lit(bins - 1)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = (df.where(v.isNotNull()).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 0)
               .select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")))
    out = spine.join(counts, "bin", "left")
    return out.select("bin", (lo + F.col("bin") * width).alias("bin_lo"), (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def group_profile(df: DataFrame, label: str, keys=(), value: str = V) -> DataFrame:
    """count, mean, sample std of ``value`` per label."""
    return df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"),
                                        F.stddev_samp(value).alias("std"))


def pivot_means(df: DataFrame, index: str, label: str, labels, value: str = V, keys=()) -> DataFrame:
    """Mean of ``value`` by ``index`` (rows) × ``label`` (columns); the label
    values are given, so Spark does not scan for them."""
    return df.groupBy(*keys, index).pivot(label, list(labels)).agg(F.avg(value))


def scan_summary(det: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    """Scans, detections, devices per scan and date range of raw
    detections (one row per key)."""
    return (det.groupBy(*keys).agg(
                F.count_distinct("scan_id", "timestamp").alias("total_scans"),
                F.count(F.lit(1)).alias("total_detections"),
                F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
              .withColumn("avg_devices_per_scan", F.col("total_detections") / F.col("total_scans")))


def residuals(df: DataFrame, actual: str, predicted: str, out: str = "residual") -> DataFrame:
    return df.withColumn(out, F.col(actual) - F.col(predicted))
