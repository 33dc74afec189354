"""Registered queries vs their SQL twins (DuckDB) on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from passage.plans import registry
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, digest

FAST = [n for n in registry.oracle_sql() if not n.startswith(("forecast", "prediction", "pattern"))]


@pytest.fixture(scope="module")
def con():
    from pathlib import Path
    c = duckdb.connect()
    for t in TABLES:
        p = Path(SF_SMALL) / f"{t}.parquet"
        if p.exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql_twin(spark, con, name):
    sdf = registry.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(registry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows) == digest(dcols, drows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "avg_devices" in df.columns
