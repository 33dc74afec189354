"""Rows that a step drops, counted in the pass that drops them.

A count is an observed metric (``DataFrame.observe``): it is gathered by the
tasks that run the step and arrives with the action, so nothing is read a
second time. An ``Observation`` holds the figures of the first action over
the frame; a frame that is written and then read back is counted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def keep_counted(df: DataFrame, keep: Column, seen: Observation, reasons: dict[str, Column] | None = None) -> DataFrame:
    """Rows for which ``keep`` holds. ``seen`` gets ``rows``, ``dropped`` and
    a count a reason (rows with several reasons count under each). A
    condition that is NULL drops its row, as a filter does.

    Filters put after this step are not pushed below it, or the counts would
    depend on them: restrict partitions and dates first."""
    kept = F.coalesce(keep, F.lit(False))
    metrics = [F.count(F.lit(1)).alias("rows"), F.count_if(~kept).alias("dropped")]
    metrics += [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in (reasons or {}).items()]
    return df.observe(seen, *metrics).where(keep)


def kept_rows(df: DataFrame, seen: Observation) -> DataFrame:
    """The same rows; ``seen`` gets their number as ``kept``. For wide, deep
    plans: it stands above the filter, where it hinders no optimization, and
    the number before the filter comes from the stored input."""
    return df.observe(seen, F.count(F.lit(1)).alias("kept"))


def stream_counts(progress) -> dict:
    """Of one progress report of a stream: batch, rows read, and rows dropped
    as later than the watermark (over its stateful operators)."""
    return {"batch": progress["batchId"], "rows": progress["numInputRows"],
            "late": sum(op.get("numRowsDroppedByWatermark", 0) for op in progress["stateOperators"]),
            **{name: row.asDict() if hasattr(row, "asDict") else dict(row)
               for name, row in (progress.get("observedMetrics") or {}).items()}}


def late_rows(query) -> int:
    """Rows a stream dropped as late, over the progress reports it still has
    (``spark.sql.streaming.numRecentProgressUpdates``; a job that runs for
    longer adds up ``stream_counts`` as it goes).

    A filter by keyed state counts rows; an aggregation counts its partial
    rows, as Spark does."""
    import json
    return sum(stream_counts(json.loads(p.json) if hasattr(p, "json") else p)["late"] for p in query.recentProgress)
