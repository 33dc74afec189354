"""Operators the original system declares in its documents and settings
without code: salt rotation, holiday flags, single-gap interpolation,
retention and retraining gates, detection rate, multi-site roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passage.config import Config
from passage.operators import DEFAULT_KEYS

V = "avg_devices"


def salt_epoch(ts, days: int, origin: str = "1970-01-01"):
    """Index of the ``days``-long salt period containing ``ts``."""
    return F.floor(F.datediff(F.to_date(ts), F.lit(origin).cast("date")) / F.lit(days)).cast("long")


def rotating_hash(df: DataFrame, secret: str, cfg: Config, id_col: str = "mac", ts: str = "timestamp",
                  out: str = "mac_hash") -> DataFrame:
    """Hash identifiers with a salt that changes every
    ``cfg.salt_rotation_days``: salt = SHA-256(secret || period), so hashes
    link within a period and not across periods. The secret never leaves
    the job configuration; no salt table is materialised."""
    epoch = salt_epoch(F.col(ts), cfg.salt_rotation_days)
    salt = F.sha2(F.concat(F.lit(secret), epoch.cast("string")), 256)
    return (df.withColumn("salt_epoch", epoch)
              .withColumn(out, F.sha2(F.concat(F.col(id_col).cast("string"), salt), 256)))


def holiday_flags(df: DataFrame, calendar: DataFrame, ts: str = "timestamp") -> DataFrame:
    """``is_holiday`` (and ``holiday`` name) from a calendar
    ``(date, holiday)``; several holidays of a date are listed by name."""
    cal = (calendar.groupBy(F.col("date").cast("date").alias("_date"))
                   .agg(F.concat_ws(", ", F.array_sort(F.collect_set("holiday"))).alias("holiday"), F.lit(True).alias("_known")))
    d = df.withColumn("_date", F.to_date(ts)).join(cal, "_date", "left")
    return d.withColumn("is_holiday", F.col("_known").isNotNull()).drop("_date", "_known")


def interpolate_single_gaps(df: DataFrame, keys=DEFAULT_KEYS, value: str = V) -> DataFrame:
    """On a gap-filled window table (``keep_empty``), a missing value whose
    neighbours both exist becomes their mean; longer gaps stay missing.
    ``interpolated`` flags filled rows."""
    w = Window.partitionBy(*keys).orderBy("timestamp")
    prev, nxt = F.lag(value).over(w), F.lead(value).over(w)
    fill = F.col(value).isNull() & prev.isNotNull() & nxt.isNotNull()
    return (df.withColumn("interpolated", fill)
              .withColumn(value, F.when(F.col("interpolated"), (prev + nxt) / 2).otherwise(F.col(value))))


def retain(df: DataFrame, as_of, days: int, ts: str = "timestamp") -> DataFrame:
    """Rows younger than ``days`` at ``as_of`` (a literal or a column)."""
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    cutoff = F.timestamp_micros(F.unix_micros(now) - F.lit(int(days) * 86_400_000_000))
    return df.withColumn("_cutoff", cutoff).where(F.col(ts) >= F.col("_cutoff")).drop("_cutoff")


def retention_job(spark, raw_path: str, processed_path: str, cfg: Config, as_of, listed_at: str | None = None):
    """Remove date folders beyond the configured retention: raw scans after
    ``raw_retention_days``, processed tables after
    ``processed_retention_days``; returns the list of what went."""
    from passage.sinks import folders
    raw = folders.expire(spark, raw_path, as_of, cfg.raw_retention_days, listed_at=listed_at)
    return raw.unionByName(folders.expire(spark, processed_path, as_of, cfg.processed_retention_days,
                                          listed_at=listed_at))


def retrain_due(df: DataFrame, cfg: Config, keys=DEFAULT_KEYS, last_trained: str | None = None,
                as_of=None) -> DataFrame:
    """Per key: samples, newest row and whether retraining is due (enough
    samples, and the last training older than ``retrain_every_days`` or
    unknown). ``last_trained`` names a column of ``df`` if known."""
    agg = [F.count(F.lit(1)).alias("samples"), F.max("timestamp").alias("latest")]
    if last_trained:
        agg.append(F.max(last_trained).alias("last_trained"))
    out = df.groupBy(*keys).agg(*agg)
    now = F.col("latest") if as_of is None else (F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of)
    enough = F.col("samples") >= F.lit(cfg.retrain_min_samples)
    if last_trained:
        age_days = (F.unix_micros(now) - F.unix_micros("last_trained")) / F.lit(86_400_000_000.0)
        stale = F.col("last_trained").isNull() | (age_days >= F.lit(float(cfg.retrain_every_days)))
    else:
        stale = F.lit(True)
    return out.withColumn("retrain_due", enough & stale)


def detection_rate(scans: DataFrame, cfg: Config, keys=DEFAULT_KEYS) -> DataFrame:
    """Per key and day: logged scans over the scans possible at
    ``cfg.scan_interval`` (share of ticks in which something was logged)."""
    possible = 86400.0 / cfg.scan_interval
    return (scans.groupBy(*keys, F.to_date("timestamp").alias("date"))
                 .agg(F.count_distinct("scan_id", "timestamp").alias("logged_scans"))
                 .withColumn("possible_scans", F.lit(possible))
                 .withColumn("detection_rate", F.col("logged_scans") / F.lit(possible)))


def city_rollup(windows: DataFrame, value: str = V) -> DataFrame:
    """All sites together per window: summed mean traffic, summed devices
    and scans, sites reporting."""
    return windows.groupBy("timestamp").agg(
        F.sum(value).alias("total_avg_devices"), F.sum("total_devices").alias("total_devices"),
        F.sum("num_scans").alias("num_scans"), F.count(F.lit(1)).alias("sites"))
