"""Calendar, cyclic, lag, rolling, target and sequence features.

Lags, rolling frames and the forecast horizon count *rows* of the window
table (one row per kept window), as in the original system: with 4-hour
windows ``lag_24h`` is 24 windows back. All window functions of one call
share a single ``partitionBy(keys).orderBy(timestamp)`` spec, so Spark
plans one exchange and one sort for all of them. Rows per key are window
aggregates (a few per day per site), so per-key partitions stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from passage.config import Config
from passage.functions import timecols as tc
from passage.operators import DEFAULT_KEYS
from passage.operators.counted import kept_rows

TARGET = "avg_devices_future"
SEQUENCE_FEATURES = ("avg_devices", "hour", "day_of_week", "is_weekend")


def _spec(keys, ts: str = "timestamp"):
    keys = list(keys)
    if not keys:
        raise ValueError("window features need partition keys (a global window runs in one task)")
    return Window.partitionBy(*keys).orderBy(ts)


def time_features(df: DataFrame, cfg: Config, ts: str = "timestamp") -> DataFrame:
    cols = []
    if cfg.include_hour:
        cols.append(tc.hour_of_day(ts).alias("hour"))
    if cfg.include_day_of_week:
        cols.append(tc.day_of_week(ts).alias("day_of_week"))
    if cfg.include_month:
        cols.append(tc.month_of_year(ts).alias("month"))
    if cfg.include_is_weekend:
        cols.append(tc.is_weekend(ts).alias("is_weekend"))
    return df.select("*", *cols)


def cyclic_features(df: DataFrame) -> DataFrame:
    """sin/cos encodings of hour of day (period 24) and day of week (7)."""
    cols = []
    if "hour" in df.columns:
        s, c = tc.cyclic("hour", 24)
        cols += [s.alias("hour_sin"), c.alias("hour_cos")]
    if "day_of_week" in df.columns:
        s, c = tc.cyclic("day_of_week", 7)
        cols += [s.alias("dow_sin"), c.alias("dow_cos")]
    return df.select("*", *cols)


def lag_columns(cfg: Config, keys=DEFAULT_KEYS, value: str | None = None, unit: str = "rows"):
    """``unit="rows"``: n rows back (the original semantics). ``unit="hours"``:
    the value exactly n hours earlier (NULL when that window is missing), a
    one-point range frame on epoch seconds."""
    v = value or cfg.value_col
    if unit == "hours":
        w = Window.partitionBy(*keys).orderBy(F.unix_seconds("timestamp"))
        return [F.first(v).over(w.rangeBetween(-n * 3600, -n * 3600)).alias(f"{v}_lag_{n}h")
                for n in cfg.lag_periods]
    if unit != "rows":
        raise ValueError("unit must be 'rows' or 'hours'")
    w = _spec(keys)
    return [F.lag(v, n).over(w).alias(f"{v}_lag_{n}h") for n in cfg.lag_periods]


def rolling_columns(cfg: Config, keys=DEFAULT_KEYS, value: str | None = None):
    v = value or cfg.value_col
    base = _spec(keys)
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    out = []
    for n in cfg.rolling_windows:
        w = base.rowsBetween(-(n - 1), Window.currentRow)
        for stat in cfg.rolling_stats:
            out.append(fns[stat](v).over(w).alias(f"{v}_rolling_{n}h_{stat}"))
    return out


def lags(df: DataFrame, cfg: Config, keys=DEFAULT_KEYS, value: str | None = None, unit: str = "rows") -> DataFrame:
    return df.select("*", *lag_columns(cfg, keys, value, unit))


def rolling(df: DataFrame, cfg: Config, keys=DEFAULT_KEYS, value: str | None = None) -> DataFrame:
    """Rolling mean/std/min/max over the last n rows including the current
    one (partial frames at the start; std of one row is NULL)."""
    return df.select("*", *rolling_columns(cfg, keys, value))


def ml_dataset(windows: DataFrame, cfg: Config, keys=DEFAULT_KEYS, value: str | None = None,
               seen: Observation | None = None) -> DataFrame:
    """Window table + lags + rolling statistics, rows with any NULL removed
    (warm-up rows, single-scan windows). ``seen`` gets the number of rows kept
    when the result is first read: of every window one row is made, so the rest
    of the windows were dropped."""
    wide = windows.select("*", *lag_columns(cfg, keys, value), *rolling_columns(cfg, keys, value)).na.drop()
    return wide if seen is None else kept_rows(wide, seen)


def target(df: DataFrame, cfg: Config, keys=DEFAULT_KEYS, value: str | None = None,
           horizon: int | None = None) -> DataFrame:
    """``<value>_future`` = value ``horizon`` rows ahead; rows without it dropped."""
    v = value or cfg.value_col
    h = cfg.forecast_horizon if horizon is None else horizon
    return (df.withColumn(f"{v}_future", F.lead(v, h).over(_spec(keys)))
              .where(F.col(f"{v}_future").isNotNull()))


def split_flags(df: DataFrame, cfg: Config, keys=DEFAULT_KEYS) -> DataFrame:
    """Chronological split per key: the first ``floor(n * train_fraction)``
    rows are training rows (``is_train``), the rest test rows."""
    w = _spec(keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return (df.withColumn("row_index", F.row_number().over(w))
              .withColumn("is_train", F.col("row_index") <= F.floor(n * F.lit(cfg.train_fraction))))


def feature_columns(df: DataFrame, keys=DEFAULT_KEYS, exclude=("timestamp", TARGET)) -> list[str]:
    """Every numeric or boolean column except the timestamp, the target and
    the keys (34 with the shipped configuration)."""
    skip = set(exclude) | set(keys) | {"row_index", "is_train", "prediction", "residual"}
    num = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")
    return [f.name for f in df.schema.fields
            if f.name not in skip and f.dataType.simpleString() in num]


def scaled_sequences(df: DataFrame, cfg: Config, keys=DEFAULT_KEYS,
                     features=SEQUENCE_FEATURES, lookback: int | None = None,
                     target_col: str = TARGET) -> DataFrame:
    """Look-back sequences for a sequence model.

    Features are min-max scaled with the minimum and maximum of each key's
    *training* rows (``split_flags``), then for row i the previous
    ``lookback`` rows (i-L … i-1, current excluded) form ``sequence``
    (array of arrays, oldest first); the target is row i's. Rows without a
    full history are dropped. Needs ``is_train`` (added when missing).
    """
    L = lookback or cfg.lookback_window
    if "is_train" not in df.columns:
        df = split_flags(df, cfg, keys)
    part = Window.partitionBy(*keys)
    scaled = []
    for f in features:
        x = F.col(f).cast("double")
        lo = F.min(F.when(F.col("is_train"), x)).over(part)
        hi = F.max(F.when(F.col("is_train"), x)).over(part)
        span = hi - lo
        scaled.append(F.when(span > 0, (x - lo) / span).otherwise(F.lit(0.0)))
    w = _spec(keys).rowsBetween(-L, -1)
    seq = F.collect_list(F.array(*scaled)).over(w)
    out = df.select(*keys, "timestamp", "is_train", F.col(target_col), seq.alias("sequence"))
    return out.where(F.size("sequence") == L)
