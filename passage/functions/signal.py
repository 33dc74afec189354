"""Signal-strength predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def passes_rssi(rssi: Column, protocol: Column, threshold: int) -> Column:
    """Classic devices may report no RSSI and are kept then; a reported RSSI
    must reach ``threshold`` for every protocol."""
    return rssi.isNull() & (protocol == F.lit("classic")) | (rssi >= F.lit(threshold))
