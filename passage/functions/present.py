"""Presentation for comparison: stable doubles and naive timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(c, digits: int = 6):
    # the 1e-9 nudge makes ties round the same way in every engine
    return F.round(c + F.lit(1e-9), digits)


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round DOUBLE columns and cast TIMESTAMP to TIMESTAMP_NTZ."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = rounded(c.cast("double"), digits)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)
