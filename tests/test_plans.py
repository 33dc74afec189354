"""Plan-shape tests: the physical plans we want at scale."""

from passage.config import Config
from passage.operators import features
from passage.plans import batch
from tests.conftest import SF_SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_is_keyed_and_jvm_only(spark):
    cfg = Config.for_events()
    p = plan_of(batch.window_table(spark, SF_SMALL, cfg))
    assert "SinglePartition" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    # the events scan reads only the columns the adapter needs
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string>" in p


def test_window_features_share_one_exchange(spark):
    cfg = Config.for_events(1)
    win = batch.window_table(spark, SF_SMALL, cfg)
    p = plan_of(features.ml_dataset(win, cfg))
    tail = p.split("Window [")[0] if "Window [" in p else p
    # lags and rolling frames of one spec are planned over a single sort
    assert p.count("Window [") >= 1 and "SinglePartition" not in p


def test_filter_pushdown_to_parquet(spark):
    from pyspark.sql import functions as F
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").where(F.col("value") > 50).select("user_id")
    p = plan_of(ev)
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,50.0)]" in p
    assert "ReadSchema: struct<user_id:bigint,value:double>" in p


def test_presence_shuffles_detections_once(spark):
    """The bucket summary and the main branch read one shared exchange."""
    cfg = Config.for_events()
    df = batch.window_table(spark, SF_SMALL, cfg)
    df.collect()  # final adaptive plan
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "Reused" in p


def test_no_cross_join_in_registered_queries(spark):
    """Every registered batch query: no Cartesian product and no nested-loop
    join (one-row global results merge partial aggregates in one partition,
    which is fine; windows never run without keys — see the flagship test)."""
    from passage.plans import registry
    skip = ("stream_", "forecast_predictions_shipped")
    bad = {}
    for name, fn in registry.queries().items():
        if name.startswith(skip):
            continue
        p = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        hits = [t for t in ("CartesianProduct", "BroadcastNestedLoopJoin") if t in p]
        if hits:
            bad[name] = hits
    assert not bad, bad
