"""Property tests (Hypothesis): the row-local nested clean-up equals the
flat ranking-window clean-up on arbitrary scans."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from passage.config import Config
from passage.operators import clean
from passage.schemas import SCAN

T0 = dt.datetime(2024, 1, 1)
device = st.tuples(st.sampled_from(["a", "b", "c"]), st.one_of(st.none(), st.integers(-95, -30)),
                   st.sampled_from(["classic", "ble", None]))
scans_st = st.lists(st.lists(device, max_size=6), min_size=1, max_size=6)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(scans=scans_st, threshold=st.integers(-90, -40))
def test_nested_equals_flat(spark, scans, threshold):
    cfg = Config(rssi_threshold=threshold)
    recs, flat = [], []
    for i, devs in enumerate(scans):
        t = T0 + dt.timedelta(seconds=3 * i)
        recs.append(("s", t, i, len(devs), devs))
        flat += [("s", t, i, m, r, p, j) for j, (m, r, p) in enumerate(devs)]
    nested = clean.clean_nested(spark.createDataFrame(recs, SCAN), cfg).collect()
    got = sorted((r.scan_id, d.mac_hash, d.rssi, d.protocol) for r in nested for d in r.devices)
    fdf = spark.createDataFrame(flat, "site_id string, timestamp timestamp, scan_id long, mac_hash string, "
                                      "rssi int, protocol string, arrival long")
    want = sorted((r.scan_id, r.mac_hash, r.rssi, r.protocol) for r in clean.clean_detections(fdf, cfg).collect())
    assert got == want
