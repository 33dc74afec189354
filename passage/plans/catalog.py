"""Query catalog core: ``register`` and the shared configurations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passage.config import Config
from passage.plans import sqltwins as sq

CFG4 = Config.for_events(window_hours=4)
CFG1 = Config.for_events(window_hours=1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, doubles=()):
    """Register a query; ``doubles`` lists the DOUBLE output columns that the
    SQL twin rounds like ``present`` does on the Spark side."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sq.rounded(sql.strip(), doubles)
        return fn
    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)



def _gap_sql(cfg: Config, rule: str) -> str:
    """Session breaks without known scan instants (gap) or with a fixed scan
    tick (tick)."""
    base = sq.base_ctes(cfg)
    ref = "timestamp" if rule == "gap" else f"timestamp - INTERVAL {cfg.scan_interval} SECOND"
    timeout_us = int(cfg.device_timeout * 1_000_000)
    base = base.replace(
        f"epoch_us(prev_scan) - epoch_us(prev_seen) > {timeout_us}",
        f"epoch_us({ref}) - epoch_us(prev_seen) > {timeout_us}")
    return _with(base) + """
SELECT site_id, timestamp, scan_id, mac_hash, rssi, protocol FROM transient"""


