"""Folders of the shared file system, through Hadoop's own client: partition
folders listed and removed, small marker files published.

Only names pass through the driver (a folder a site and day, a marker a
version), never rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order; none if the folder is missing."""
    _, p, fs = _fs(spark, pattern)
    found = fs.globStatus(p)
    return sorted(s.getPath().toString() for s in found) if found else []


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder with all it holds; False if it was not there."""
    _, p, fs = _fs(spark, path)
    return bool(fs.delete(p, True))


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that readers see whole or not at all: it is written
    beside its place and renamed. An earlier file of that name is replaced."""
    jvm, p, fs = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(p.getParent(), "." + p.getName() + ".tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if not fs.rename(tmp, p):  # some file systems do not rename onto a file
        fs.delete(p, False)
        if not fs.rename(tmp, p):
            raise OSError(f"could not publish {path}")


def read_small(spark: SparkSession, path: str) -> str:
    """The first line of a marker file."""
    jvm, p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return str(jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine())
    finally:
        stream.close()


def partition_value(path: str, column: str) -> str | None:
    """The value of ``column`` in a path ``…/column=value/…``."""
    for part in path.split("/"):
        if part.startswith(f"{column}="):
            return part[len(column) + 1:]
    return None


def expire(spark: SparkSession, path: str, as_of: str | dt.datetime, days: int, column: str = "scan_date",
           listed_at: str | None = None, keys=("site_id",)) -> DataFrame:
    """Remove the date folders whose rows are all older than ``days`` at
    ``as_of``: a folder goes if its day has ended at or before the cut-off, so
    the cut-off's own day stays whole. Folders lie at ``path/<key>=…/…/<column>=…``.

    Returns (path, date, cutoff) of what goes, and writes that list to
    ``listed_at`` before the first folder is removed: a run that is stopped half way
    has listed all it removed, and the next run removes the rest. Folders that
    are not dates stay, the null date included."""
    now = dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    cutoff = now - dt.timedelta(days=days)
    gone = []
    for folder in matching(spark, "/".join([path.rstrip("/"), *[f"{k}=*" for k in keys], f"{column}=*"])):
        try:
            day = dt.date.fromisoformat(partition_value(folder, column) or "")
        except ValueError:
            continue
        if dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1) <= cutoff:
            gone.append((folder, day, cutoff))
    out = spark.createDataFrame(gone, "path string, date date, cutoff timestamp")
    if listed_at and gone:
        out.coalesce(1).write.mode("append").json(listed_at)
    for folder, _, _ in gone:
        remove(spark, folder)
    return out
