"""Explode, per-scan distinct counts and time-window aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passage.config import Config
from passage.operators import DEFAULT_KEYS
from passage.operators.features import time_features

WINDOW_STATS = ("avg_devices", "std_devices", "min_devices", "max_devices", "total_devices", "num_scans")


def explode_devices(scans: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Scan records → one row per sighting, ``arrival`` = position in the
    scan's device list. Scans without devices vanish unless ``keep_empty``
    (then they give one row with NULL device fields)."""
    others = [c for c in scans.columns if c not in ("devices", "device_count", "_corrupt_record")]
    gen = F.posexplode_outer("devices") if keep_empty else F.posexplode("devices")
    out = scans.select(*others, gen.alias("arrival", "_d"))
    out = out.select(*others, F.col("_d.mac_hash").alias("mac_hash"), F.col("_d.rssi").alias("rssi"),
                     F.col("_d.protocol").alias("protocol"), F.col("arrival").cast("long").alias("arrival"))
    if not keep_empty:
        out = out.withColumn("protocol", F.coalesce("protocol", F.lit("unknown")))
    return out


def scan_counts(det: DataFrame, keys=DEFAULT_KEYS, distinct: bool = True, legacy_key: bool = False) -> DataFrame:
    """Distinct devices per scan (the stored ``device_count`` is ignored).

    Keyed by ``(keys, scan_id, timestamp)``: the capture counter restarts
    with the process, so the id alone would merge unrelated scans.
    ``distinct=False`` counts rows — only for input already de-duplicated per
    device and scan (``clean.dedupe_strongest``); it saves one exchange."""
    n = F.count_distinct("mac_hash") if distinct else F.count("mac_hash")
    if legacy_key:  # group by the id alone, earliest timestamp (original merge of restarted ids)
        return (det.groupBy(*keys, "scan_id")
                   .agg(F.min("timestamp").alias("timestamp"), F.count_distinct("mac_hash").alias("device_count")))
    return det.groupBy(*keys, "scan_id", "timestamp").agg(n.alias("device_count"))


def scan_counts_nested(scans: DataFrame) -> DataFrame:
    """Row-local twin of ``scan_counts`` on scan records (no shuffle)."""
    return scans.withColumn("device_count",
                            F.size(F.array_distinct(F.col("devices.mac_hash"))).cast("long"))


def _window_start(ts: str, hours: int, slide_hours: int = 0, offset_hours: int = 0):
    size = f"{hours} hours"
    start = f"{offset_hours} hours" if offset_hours else None
    if slide_hours and slide_hours != hours:
        return F.window(ts, size, f"{slide_hours} hours", start).start if start else \
            F.window(ts, size, f"{slide_hours} hours").start
    return F.window(ts, size, size, start).start if start else F.window(ts, size).start


def _stats(value: str = "device_count"):
    v = F.col(value)
    return [F.avg(v).alias("avg_devices"),
            F.stddev_samp(v).alias("std_devices"),
            F.min(v).cast("long").alias("min_devices"),
            F.max(v).cast("long").alias("max_devices"),
            F.sum(v).cast("long").alias("total_devices"),
            F.count(v).alias("num_scans")]


def window_counts(counts: DataFrame, cfg: Config, keys=DEFAULT_KEYS, keep_empty: bool = False,
                  window_hours: int | None = None, offset_hours: int = 0,
                  with_time_features: bool = True) -> DataFrame:
    """Tumbling windows of per-scan device counts: mean, sample std, min,
    max, sum and number of scans; windows with fewer than
    ``cfg.min_scans_per_window`` scans are dropped. ``keep_empty`` emits the
    empty windows between a site's first and last window (count 0, sum 0,
    other statistics NULL) and keeps them."""
    keys = list(keys)
    h = window_hours or cfg.window_hours
    agg = (counts.groupBy(*keys, _window_start("timestamp", h, 0, offset_hours).alias("timestamp"))
                 .agg(*_stats()))
    if keep_empty:
        agg = fill_empty_windows(agg, h, keys)
    else:
        agg = agg.where(F.col("num_scans") >= F.lit(cfg.min_scans_per_window))
    return time_features(agg, cfg) if with_time_features else agg


def fill_empty_windows(agg: DataFrame, hours: int, keys=DEFAULT_KEYS) -> DataFrame:
    """Left-join window aggregates onto a per-key spine of all window starts
    between the key's first and last window."""
    keys = list(keys)
    spine = (agg.groupBy(*keys).agg(F.min("timestamp").alias("_lo"), F.max("timestamp").alias("_hi"))
                .select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {hours} HOURS")))
                        .alias("timestamp")))
    # null-safe: a window without a site keeps its statistics
    known = agg.select(*[F.col(c).alias(f"_k_{c}") for c in [*keys, "timestamp"]], *[c for c in agg.columns if c not in {*keys, "timestamp"}])
    on = F.col("timestamp") == F.col("_k_timestamp")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = spine.join(known, on, "left").select(*agg.columns)
    return (out.withColumn("num_scans", F.coalesce("num_scans", F.lit(0)).cast("long"))
               .withColumn("total_devices", F.coalesce("total_devices", F.lit(0)).cast("long")))


def sliding_window_counts(counts: DataFrame, cfg: Config, keys=DEFAULT_KEYS,
                          window_hours: int | None = None, slide_hours: int | None = None) -> DataFrame:
    """Overlapping windows (size ``window_hours``, step ``slide_hours``), by
    panes where the step divides the size. A size that is no multiple of the
    step has no panes: there every scan is given to each of its windows."""
    keys = list(keys)
    h = window_hours or cfg.window_hours
    s = slide_hours or cfg.slide_hours or h
    if h % s == 0:
        agg = merge_panes(window_panes(counts, s, keys), h, s, keys)
    else:
        agg = (counts.groupBy(*keys, _window_start("timestamp", h, s).alias("timestamp"))
                     .agg(*_stats()))
    return agg.where(F.col("num_scans") >= F.lit(cfg.min_scans_per_window))


PANE_STATS = ("n", "total", "squares", "low", "high")


def window_panes(counts: DataFrame, step_hours: int, keys=DEFAULT_KEYS) -> DataFrame:
    """Per key and step: partial statistics of ``device_count`` that add up
    (``n``, ``total``, ``squares``, ``low``, ``high``). They can be stored, and
    panes of the same step from several runs merge by the same sums."""
    v = F.col("device_count")
    return (counts.groupBy(*keys, _window_start("timestamp", step_hours).alias("timestamp"))
                  .agg(F.count(v).alias("n"), F.sum(v).cast("long").alias("total"),
                       F.sum(v.cast("decimal(19,0)") * v).cast("decimal(38,0)").alias("squares"),
                       F.min(v).cast("long").alias("low"), F.max(v).cast("long").alias("high")))


def merge_panes(panes: DataFrame, hours: int, step_hours: int, keys=DEFAULT_KEYS) -> DataFrame:
    """Windows of ``hours`` at each step from panes: a range frame over the
    panes of a key, which are few (one a step). A window starts at every step
    whose window holds a pane; steps without a pane of their own become rows
    only where they are needed, so each window is one row throughout.

    Counts are whole numbers and their sums exact, so the standard deviation
    does not depend on the order in which panes come."""
    keys = list(keys)
    k, step_us = hours // step_hours, step_hours * 3_600_000_000
    step = F.floor(F.unix_micros("timestamp") / F.lit(step_us)).cast("long")
    p = panes.select(*keys, step.alias("_p"), *PANE_STATS)
    prev = F.lag("_p").over(Window.partitionBy(*keys).orderBy("_p"))
    lead_in = F.col("_p") - F.lit(k - 1)  # the first window that reaches this pane
    p = p.select("*", F.when(prev.isNull(), lead_in).otherwise(F.greatest(prev + F.lit(1), lead_in)).alias("_from"))
    own = F.col("_s") == F.col("_p")
    rows = (p.select("*", F.explode(F.sequence("_from", "_p")).alias("_s"))
             .select(*keys, "_s", *[F.when(own, F.col(c)).alias(c) for c in PANE_STATS]))
    w = Window.partitionBy(*keys).orderBy("_s").rangeBetween(0, k - 1)
    n, total, squares = F.sum("n").over(w), F.sum("total").over(w), F.sum("squares").over(w)
    rows = rows.select(*keys, F.timestamp_micros(F.col("_s") * F.lit(step_us)).alias("timestamp"),
                       n.alias("n"), total.alias("total"), squares.alias("squares"),
                       F.min("low").over(w).alias("low"), F.max("high").over(w).alias("high"))
    nd, td = F.col("n").cast("double"), F.col("total").cast("double")
    # n * squares - total^2 in whole numbers where they fit, else as doubles
    exact = (F.try_subtract(F.try_multiply(F.col("squares").cast("decimal(28,0)"), F.col("n").cast("decimal(10,0)")),
                            F.try_multiply(F.col("total").cast("decimal(19,0)"), F.col("total").cast("decimal(19,0)"))))
    spread = F.coalesce(exact.cast("double"), nd * F.col("squares").cast("double") - td * td)
    std = F.when(F.col("n") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (nd * (nd - 1))))
    return rows.select(*keys, "timestamp", (td / nd).alias("avg_devices"), std.alias("std_devices"),
                       F.col("low").alias("min_devices"), F.col("high").alias("max_devices"),
                       F.col("total").alias("total_devices"), F.col("n").alias("num_scans"))


#: log2 of the registers of a device sketch: 4096 registers, some 4 KB at most.
SKETCH_LG_K = 12


def sketch_error(lg_k: int = SKETCH_LG_K, sigmas: float = 3.0) -> float:
    """Relative error that a united sketch keeps within: ``sigmas`` times its
    standard error 1.04 / sqrt(registers)."""
    return sigmas * 1.04 / (1 << lg_k) ** 0.5


def device_sketches(det: DataFrame, keys=DEFAULT_KEYS, hours: int = 1, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """Per key and ``hours``: a HyperLogLog sketch of the devices seen, and the
    detections. Stored, it answers distinct devices over any longer span
    without the sightings."""
    return (det.groupBy(*keys, _window_start("timestamp", hours).alias("timestamp"))
               .agg(F.hll_sketch_agg("mac_hash", lg_k).alias("devices"), F.count(F.lit(1)).alias("detections")))


def unite_sketches(sketches: DataFrame, hours: int, keys=DEFAULT_KEYS) -> DataFrame:
    """Sketches of ``hours`` (a multiple of theirs) united from shorter ones;
    ``unique_devices`` is the estimate. The result can be united further.
    Spans are aligned as windows are (weeks begin on a Thursday)."""
    agg = (sketches.groupBy(*keys, _window_start("timestamp", hours).alias("timestamp"))
                   .agg(F.hll_union_agg("devices").alias("devices"), F.sum("detections").cast("long").alias("detections")))
    return agg.withColumn("unique_devices", F.hll_sketch_estimate("devices"))


def unique_devices(det: DataFrame, cfg: Config, keys=DEFAULT_KEYS, window_hours: int | None = None,
                   approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct devices per window (exact by default; HyperLogLog opt-in)."""
    keys = list(keys)
    h = window_hours or cfg.window_hours
    distinct = (F.approx_count_distinct("mac_hash", rsd) if approx else F.count_distinct("mac_hash"))
    return (det.groupBy(*keys, _window_start("timestamp", h).alias("timestamp"))
               .agg(distinct.alias("unique_devices"), F.count(F.lit(1)).alias("detections")))
