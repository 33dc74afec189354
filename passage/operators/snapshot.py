"""Per-site prediction snapshot: the latest window of each site scored by
the forecaster and the pattern model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passage.operators import DEFAULT_KEYS
from passage.operators.reports import latest


def score_latest(ml: DataFrame, pattern_model, forecaster, as_of=None, horizon_hours: int = 4,
                 keys=DEFAULT_KEYS) -> DataFrame:
    """One row per key: timestamp (``as_of`` or the latest window),
    current_traffic, predicted_traffic, forecast_time, current_cluster and
    the ordered cluster probabilities. ``latest`` is a ``max_by`` per key,
    so only one row per site reaches the models."""
    last = latest(ml, keys)
    scored = forecaster.predict(last)
    scored = pattern_model.label(scored)
    now = (F.col("timestamp") if as_of is None else
           (F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of))
    probs = [c for c in scored.columns if c.startswith("p_")]
    return scored.select(
        *keys, now.alias("timestamp"), F.col("avg_devices").alias("current_traffic"),
        F.col("prediction").alias("predicted_traffic"),
        F.timestamp_micros(F.unix_micros(now) + F.lit(horizon_hours * 3_600_000_000)).alias("forecast_time"),
        F.col("cluster_label").alias("current_cluster"), *probs)
