"""The mixture and the boosted trees against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passage.operators import boosting, mixture


def _blobs(n=300, seed=1):
    rng = np.random.default_rng(seed)
    who = rng.integers(0, 3, n)
    x = np.array([[0, 0], [3, 1], [-2, 4]])[who] + rng.normal(size=(n, 2)) @ np.array([[1.0, 0.4], [0.0, 0.6]])
    return x, who


def _em(x, start, kind, rounds):
    """EM by loops over components, covariances from centred points."""
    n, d = x.shape
    r = np.eye(3)[start]
    total = None
    for step in range(rounds + 1):
        nk = r.sum(0) + mixture.LEAST_POINTS
        mean = (r.T @ x) / nk[:, None]
        cov = np.array([((x - m).T * r[:, j]) @ (x - m) / nk[j] for j, m in enumerate(mean)])
        if kind == "tied":
            cov = np.repeat((np.einsum("k,kab->ab", nk, cov) / nk.sum())[None], 3, 0)
        elif kind == "diag":
            cov = np.array([np.diag(np.diag(c)) for c in cov])
        elif kind == "spherical":
            cov = np.array([np.eye(d) * np.diag(c).mean() for c in cov])
        cov = cov + mixture.REGULARISATION * np.eye(d)
        if step == rounds:
            return nk / n, mean, cov, total
        log = np.stack([np.log(nk[j] / n) - 0.5 * np.linalg.slogdet(2 * np.pi * cov[j])[1]
                        - 0.5 * np.einsum("na,ab,nb->n", x - mean[j], np.linalg.inv(cov[j]), x - mean[j]) for j in range(3)], 1)
        each = np.logaddexp.reduce(log, axis=1)
        r, total = np.exp(log - each[:, None]), each.mean()


@pytest.mark.parametrize("kind", mixture.COVARIANCE_TYPES)
def test_mixture_rounds_equal_numpy(spark, kind):
    x, who = _blobs()
    start = np.where(np.arange(len(who)) % 7 == 0, (who + 1) % 3, who)
    df = spark.createDataFrame([(float(a), float(b), int(s)) for (a, b), s in zip(x, start)] + [(None, 1.0, 0)], "a double, b double, s int").repartition(5)
    m = mixture.fit_mixture(df, ["a", "b"], "s", covariance_type=kind, max_iter=4, tol=0)
    w, mean, cov, ll = _em(x, start, kind, 4)
    assert np.allclose(m.weights, w) and np.allclose(m.means, mean) and np.allclose(m.covariances, cov) and math.isclose(m.log_likelihood, ll)
    out = m.responsibilities(df, ["a", "b"]).collect()
    assert all(abs(r._r0 + r._r1 + r._r2 - 1) < 1e-9 for r in out if r.a is not None)
    assert [r._r0 for r in out if r.a is None] == [None]
    back = mixture.Mixture.from_dict(m.to_dict())
    assert np.array_equal(back.covariances, m.covariances)


def test_mixture_stops_finds_the_groups_and_bears_empty_components(spark):
    x, who = _blobs(seed=2)
    df = spark.createDataFrame([(float(a), float(b), int(s)) for (a, b), s in zip(x, np.minimum(who, 2))], "a double, b double, s int")
    m = mixture.fit_mixture(df, ["a", "b"], "s", max_iter=100, tol=1e-3)
    assert m.rounds < 100
    got = np.array([[r._r0, r._r1, r._r2] for r in m.responsibilities(df, ["a", "b"]).collect()]).argmax(1)
    assert (got == who).mean() > 0.9
    one = mixture.fit_mixture(df.withColumn("s", F.lit(1)), ["a", "b"], "s", max_iter=2, tol=0)
    assert one.weights[1] > 0.999 and np.isfinite(one.covariances).all()
    with pytest.raises(ValueError):
        mixture.fit_mixture(df, ["a", "b"], "s", covariance_type="round")
    with pytest.raises(ValueError):
        mixture.fit_mixture(df.where("false"), ["a", "b"], "s")


def test_a_round_is_one_aggregate_without_python(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    m = mixture.Mixture(np.array([0.5, 0.5]), np.zeros((2, 2)), np.array([np.eye(2)] * 2))
    plan = m.responsibilities(df, ["a", "b"]).agg(F.sum("_r0"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") == 1


# ---------------------------------------------------------------- boosting

def _rows(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = np.where(x[:, 0] > 0.3, 5.0, 1.0) + x[:, 1] + rng.normal(size=n) * 0.1
    return x, y


def _table(spark, x, y, val=None):
    rows = [(i, *(float(v) for v in r), float(t), bool(val[i]) if val is not None else False) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, v boolean")


def _plain_trees(x, y, trees, depth, rate, bins):
    """Greedy trees over the same cut points, node by node."""
    cuts = [np.unique(np.percentile(x[:, j], [100 * i / bins for i in range(1, bins)])) for j in range(x.shape[1])]
    pred = np.full(len(y), y.mean())
    for _ in range(trees):
        node = np.zeros(len(y), int)
        for _ in range(depth):
            nxt = 2 * node + 1
            for k in np.unique(node):
                me = np.flatnonzero(node == k)
                g, best = (y - pred)[me], None
                for j, q in enumerate(cuts):
                    for t in q:
                        left = x[me, j] <= t
                        if left.all() or not left.any():
                            continue
                        score = lambda m: g[m].sum() ** 2 / (m.sum() + boosting.L2)
                        gain = round(score(left) + score(~left) - g.sum() ** 2 / (len(g) + boosting.L2), boosting.GAIN_DIGITS)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = gain, j, t
                if best:
                    nxt[me] += x[me, best[1]] > best[2]
            node = nxt
        for k in np.unique(node):
            me = node == k
            pred[me] += rate * (y - pred)[me].sum() / (me.sum() + boosting.L2)
    return pred


def test_trees_equal_plain_greedy_trees(spark):
    x, y = _rows()
    df = _table(spark, x, y)
    m = boosting.fit_boosted(df, ["a", "b", "c"], "y", ["id"], trees=3, depth=3, rate=0.3)
    got = [r.prediction for r in m.predict(df).orderBy("id").collect()]
    assert np.allclose(got, _plain_trees(x, y, 3, 3, 0.3, boosting.BINS))


def test_trees_do_not_depend_on_partitions_and_stop_early(spark):
    x, y = _rows()
    val = np.arange(len(y)) % 5 == 0
    df = _table(spark, x, np.random.default_rng(0).permutation(y), val)     # nothing to learn
    kw = dict(is_val="v", trees=12, depth=3, subsample=0.7, colsample=0.7, patience=3, rate=0.5)
    one = boosting.fit_boosted(df.repartition(1), ["a", "b", "c"], "y", ["id"], **kw)
    many = boosting.fit_boosted(df.repartition(40), ["a", "b", "c"], "y", ["id"], **kw)
    assert [(t.feature, t.cut) for t in one.trees] == [(t.feature, t.cut) for t in many.trees]
    assert np.allclose([t.value for t in one.trees], [t.value for t in many.trees]) and np.allclose(one.errors, many.errors)
    assert len(one.trees) == int(np.argmin(one.errors)) + 1 and len(one.errors) < 12
    # the error kept is that of the kept trees
    mse = one.predict(df.where("v")).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    assert math.isclose(mse, min(one.errors), rel_tol=1e-9)


def test_subtrees_in_groups_are_the_levels_trees(spark, monkeypatch):
    """Grown by levels only, by some levels and then groups, or in one group: the same trees."""
    x, y = _rows()
    df, made = _table(spark, x, y, np.arange(len(y)) % 5 == 0), []
    for most in (0, 100, 1 << 16):
        monkeypatch.setattr(boosting, "NODE_ROWS", most)
        made.append(boosting.fit_boosted(df, ["a", "b", "c"], "y", ["id"], is_val="v", trees=2, depth=4, subsample=0.8, colsample=0.7))
    for m in made[1:]:
        assert [(t.feature, t.cut, t.threshold) for t in m.trees] == [(t.feature, t.cut, t.threshold) for t in made[0].trees]
        assert np.allclose([t.value for t in m.trees], [t.value for t in made[0].trees]) and np.allclose(m.errors, made[0].errors)


def test_jobs_of_a_tree_do_not_grow_with_its_depth(spark):
    x, y = _rows(200)
    df, sc, jobs = _table(spark, x, y), spark.sparkContext, []
    for trees in (1, 3):
        sc.setJobGroup(f"boosting-{trees}", "")
        boosting.fit_boosted(df, ["a", "b", "c"], "y", ["id"], trees=trees, depth=6)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"boosting-{trees}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 2 * 5


def test_trees_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 2.0, 1.0), (2, 1.0, None, 3.0), (3, 1.0, 2.0, None), (3, 1.0, 2.0, 5.0)], "id long, a double, b double, y double")
    m = boosting.fit_boosted(df, ["a", "b"], "y", ["id"], trees=2, depth=2)
    assert [r.prediction is not None for r in m.predict(df).collect()] == [True] * 4 and m.base == 3.0
    none = boosting.fit_boosted(df.where("false"), ["a", "b"], "y", ["id"], trees=2)
    assert none.trees == [] and none.predict(df).first().prediction == 0.0
    again = boosting.Boosted.from_dict(m.to_dict())
    assert [r.prediction for r in again.predict(df).collect()] == [r.prediction for r in m.predict(df).collect()]
