"""Lookup tables.

Fixed values (must equal the original system's): day names Monday..Sunday
for day_of_week 0..6, and pattern labels Quiet, Moderate, Busy for ordered
cluster 0..2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
PATTERN_LABELS = ("Quiet", "Moderate", "Busy")


def lookup(index: Column, names: tuple[str, ...]) -> Column:
    """0-based index → name; NULL outside the table."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), index.cast("int") + F.lit(1))


def day_name(dow: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), dow.cast("int") + F.lit(1))


def pattern_label(cluster: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in PATTERN_LABELS]), cluster.cast("int") + F.lit(1))
