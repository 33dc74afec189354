"""Raw scan logs (JSON lines) and processed datasets.

Scan records are read with a fixed schema (no inference pass over the
data). A malformed line becomes a corrupt record and only that line is
dropped (the rest of its file is kept); ``corrupt_lines`` counts them.
Logs written by ``sinks.files.append_scans`` are laid out
``site_id=…/scan_date=…/``, so a date range prunes folders before any
file is opened and the ``timestamp`` predicate is checked per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passage.operators import DEFAULT_KEYS
from passage.operators.counted import keep_counted
from passage.schemas import SCAN, SCAN_WITH_CORRUPT
from passage.session import ensure_utc

SCAN_GLOB = "scan_*.jsonl"
WRITE = "write_id"  # folder of one write of the scan log (``sinks.files``)


def _reader(spark: SparkSession, glob: str | None):
    r = (spark.read.schema(SCAN_WITH_CORRUPT)
         .option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_corrupt_record")
         .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
         .option("recursiveFileLookup", "false"))
    return r.option("pathGlobFilter", glob) if glob else r


def _usable():
    return F.col("_corrupt_record").isNull() & F.col("timestamp").isNotNull()


def read_scans_raw(spark: SparkSession, path: str, glob: str | None = SCAN_GLOB) -> DataFrame:
    """All lines, corrupt ones included (``_corrupt_record`` not NULL)."""
    ensure_utc(spark)
    return _reader(spark, glob).json(path)


def date_range(df: DataFrame, start=None, end=None, ts: str = "timestamp") -> DataFrame:
    """``start <= ts <= end``; a bare date as ``end`` means its midnight.
    With a ``scan_date`` partition column the same bounds prune folders."""
    out = _folders(df, start, end) if "scan_date" in df.columns else df
    if start is not None:
        out = out.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col(ts) <= F.lit(end).cast("timestamp"))
    return out


def _folders(df: DataFrame, start, end) -> DataFrame:
    if start is not None:
        df = df.where(F.col("scan_date") >= F.to_date(F.lit(start).cast("timestamp")))
    if end is not None:
        df = df.where(F.col("scan_date") <= F.to_date(F.lit(end).cast("timestamp")))
    return df


def read_scans(spark: SparkSession, path: str, start=None, end=None, site_id: str | None = None,
               glob: str | None = SCAN_GLOB, seen: Observation | None = None) -> DataFrame:
    """Scan records (corrupt lines dropped), optionally within ``[start, end]``.

    A usable record parsed cleanly and has a timestamp (the predicate also
    keeps Spark from planning a read of the corrupt column alone).
    ``site_id`` fills the site of single-site logs that do not carry one.
    ``seen`` gets the lines read and those dropped as ``corrupt`` or
    ``undated``, counted as they are read (in the date folders of the range;
    a line without a date lies in none of them)."""
    df = read_scans_raw(spark, path, glob)
    if seen is None:
        df = df.where(_usable())
    else:
        if "scan_date" in df.columns:
            df = _folders(df, start, end)
        bad = F.col("_corrupt_record").isNotNull()
        df = keep_counted(df, _usable(), seen, {"corrupt": bad, "undated": ~bad & F.col("timestamp").isNull()})
    df = df.drop("_corrupt_record", WRITE)
    if site_id is not None:
        df = df.withColumn("site_id", F.coalesce("site_id", F.lit(site_id)))
    return date_range(df, start, end)


def corrupt_lines(spark: SparkSession, path: str, glob: str | None = SCAN_GLOB) -> DataFrame:
    """Lines ``read_scans`` drops (malformed, or without a timestamp), with
    their file, for reporting."""
    df = read_scans_raw(spark, path, glob).withColumn("file", F.input_file_name())
    return df.where(~_usable()).select("file", "scan_id", "_corrupt_record")


def stream_scans(spark: SparkSession, path: str, glob: str | None = SCAN_GLOB,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Scan records as a stream: each new file is picked up exactly once
    (tracked in the query checkpoint) instead of re-reading all history."""
    ensure_utc(spark)
    r = (spark.readStream.schema(SCAN_WITH_CORRUPT).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_corrupt_record"))
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path).where(_usable()).drop("_corrupt_record", WRITE)


def read_dataset(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, keys=DEFAULT_KEYS) -> DataFrame:
    """A processed dataset written by ``sinks.files.write_dataset``. The keys
    are text: a site "007" in a folder's name stays "007"."""
    ensure_utc(spark)
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", "true")
        r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
    elif schema is not None:
        r = r.schema(schema)
    df = r.load(path)
    if schema is None and any(t != "string" for c, t in df.dtypes if c in keys):
        typed = T.StructType([T.StructField(f.name, T.StringType()) if f.name in keys else f for f in df.schema.fields])
        df = r.schema(typed).load(path)
    return df


__all__ = ["SCAN", "read_scans", "read_scans_raw", "corrupt_lines", "date_range", "stream_scans", "read_dataset"]
