"""Calendar and epoch expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts) -> Column:
    """Seconds since the epoch as DOUBLE, sub-second part kept."""
    return F.unix_micros(col(ts)) / F.lit(1_000_000.0)


def seconds_between(later, earlier) -> Column:
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / F.lit(1_000_000.0)


def hour_of_day(ts) -> Column:
    return F.hour(col(ts)).cast("int")


def day_of_week(ts) -> Column:
    """Monday = 0 … Sunday = 6 (``weekday``, not ``dayofweek``)."""
    return F.weekday(col(ts)).cast("int")


def month_of_year(ts) -> Column:
    return F.month(col(ts)).cast("int")


def is_weekend(ts) -> Column:
    return F.weekday(col(ts)) >= 5


def bin_start(ts, seconds: int, offset_seconds: int = 0) -> Column:
    """Start of the tumbling bin of ``seconds`` containing ``ts`` (epoch origin
    shifted by ``offset_seconds``)."""
    e = F.unix_seconds(col(ts)) - F.lit(offset_seconds)
    return F.timestamp_seconds(F.floor(e / F.lit(seconds)) * F.lit(seconds) + F.lit(offset_seconds))


def cyclic(c, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * col(c).cast("double") / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
