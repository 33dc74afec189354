"""Registered cluster-quality queries (SQL twins on percentile tiers) and
model queries (mixture, boosted trees, snapshot), whose SQL twins repeat the
fits by a fixed number of rounds or trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from passage.functions.present import present
from passage.operators import boosting, features, forecast, mixture, patterns, snapshot
from passage.operators.features import cyclic_features
from passage.plans import sqltwins as sq
from passage.plans.catalog import CFG1, CFG4, _with, register
from passage.plans.registry_reports import METRIC_DOUBLES, ML1_SQL, TIERS_SQL, _metrics_sql, ml1, target1, tiers4, win4

Z = [f"{c}_z" for c in patterns.PATTERN_FEATURES]


def _z_points(spark, sf_dir):
    return patterns.zscore_window(cyclic_features(tiers4(spark, sf_dir)), patterns.PATTERN_FEATURES)


def _z_sql() -> str:
    feats = {"avg_devices": "avg_devices", "hour_sin": "sin(2 * pi() * hour / 24)",
             "hour_cos": "cos(2 * pi() * hour / 24)", "dow_sin": "sin(2 * pi() * day_of_week / 7)",
             "dow_cos": "cos(2 * pi() * day_of_week / 7)"}
    cyc = ", ".join(f"{e} AS f_{n}" for n, e in feats.items())
    zs = ", ".join(
        f"CASE WHEN stddev_pop(f_{n}) OVER (PARTITION BY site_id) > 0 THEN "
        f"(f_{n} - avg(f_{n}) OVER (PARTITION BY site_id)) / stddev_pop(f_{n}) OVER (PARTITION BY site_id) "
        f"ELSE 0 END AS {n}_z" for n in feats)
    return f"""
cyc AS (SELECT *, {cyc} FROM tiered),
pts AS (SELECT site_id, tier, {zs} FROM cyc)"""


def _d2(a: str, b: str) -> str:
    return " + ".join(f"({a}{i} - {b}{i}) ^ 2" for i in range(5))


CLUSTER_SQL = f"""
cl AS (SELECT tier, count(*) AS n, {", ".join(f"avg({z}) AS c{i}" for i, z in enumerate(Z))} FROM pts GROUP BY tier),
pd AS (SELECT p.tier, {" + ".join(f"(p.{z} - c.c{i}) ^ 2" for i, z in enumerate(Z))} AS d2,
              {" + ".join(f"p.{z} ^ 2" for z in Z)} AS x2
       FROM pts p JOIN cl c ON p.tier = c.tier),
ct AS (SELECT c.*, s.s, s.w, s.q FROM cl c JOIN (SELECT tier, avg(sqrt(d2)) AS s, sum(d2) AS w, sum(x2) AS q
                                                 FROM pd GROUP BY tier) s ON c.tier = s.tier)"""


@register("tier_quality", _with(*TIERS_SQL, _z_sql(), CLUSTER_SQL) + f"""
, ratio AS (SELECT a.tier, max((a.s + b.s) / sqrt({_d2('a.c', 'b.c')})) AS r
            FROM ct a JOIN ct b ON a.tier <> b.tier GROUP BY a.tier),
g AS (SELECT {", ".join(f"sum(n * c{i}) / sum(n) AS g{i}" for i in range(5))}, sum(n) AS nn, sum(w) AS ww,
             count(*) AS k FROM ct)
SELECT g.k AS clusters, g.nn AS n, (SELECT avg(r) FROM ratio) AS davies_bouldin,
       ((SELECT sum(ct.n * ({_d2('ct.c', 'g.g')})) FROM ct) / (g.k - 1)) / (g.ww / (g.nn - g.k)) AS calinski_harabasz
FROM g""", doubles=("davies_bouldin", "calinski_harabasz"))
def q_tier_quality(spark, sf_dir):
    return present(patterns.cluster_quality(_z_points(spark, sf_dir), Z, "tier"))


@register("tier_silhouette", _with(*TIERS_SQL, _z_sql(), CLUSTER_SQL) + f"""
, md AS (SELECT p.*, c.tier AS ctier, c.n AS cn,
                ({" + ".join(f"p.{z} ^ 2" for z in Z)}) - 2 * ({" + ".join(f"p.{z} * c.c{i}" for i, z in enumerate(Z))})
                + c.q / c.n AS m
         FROM (SELECT row_number() OVER () AS pid, * FROM pts) p JOIN ct c ON TRUE),
per AS (SELECT pid, max(CASE WHEN ctier = tier THEN m * cn / (cn - 1) END) AS a,
               min(CASE WHEN ctier <> tier THEN m END) AS b, max(CASE WHEN ctier = tier THEN cn END) AS own_n
        FROM md GROUP BY pid)
SELECT avg(CASE WHEN own_n <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette_sq, count(*) AS n
FROM per""", doubles=("silhouette_sq",))
def q_tier_silhouette(spark, sf_dir):
    return present(patterns.silhouette_sq(_z_points(spark, sf_dir), Z, "tier"))


@register("lookback_sequences", _with(sq.base_ctes(CFG1), sq.window_cte("win0", CFG1, 1),
                                     f"\nwin AS ({sq.with_time('win0')})", sq.ml_cte("ml", CFG1, "win")) + f"""
, tgt AS (SELECT * FROM (SELECT *, lead(avg_devices, {CFG1.forecast_horizon})
                                   OVER (PARTITION BY site_id ORDER BY timestamp) AS avg_devices_future FROM ml) t
          WHERE avg_devices_future IS NOT NULL),
split AS (SELECT *, row_index <= floor(n * {CFG1.train_fraction}) AS is_train FROM (
            SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp) AS row_index,
                   count(*) OVER (PARTITION BY site_id) AS n FROM tgt) t),
sc AS (
  SELECT *, {", ".join(
      f"CASE WHEN max({c}) FILTER (WHERE is_train) OVER (PARTITION BY site_id) - min({c}) FILTER (WHERE is_train) OVER (PARTITION BY site_id) > 0 "
      f"THEN ({c} - min({c}) FILTER (WHERE is_train) OVER (PARTITION BY site_id)) / (max({c}) FILTER (WHERE is_train) OVER (PARTITION BY site_id) - min({c}) FILTER (WHERE is_train) OVER (PARTITION BY site_id)) "
      f"ELSE 0.0 END AS s_{c}" for c in ("avg_devices", "hour", "day_of_week", "is_weekend"))}
  FROM (SELECT * REPLACE (CAST(hour AS DOUBLE) AS hour, CAST(day_of_week AS DOUBLE) AS day_of_week,
                          CAST(is_weekend AS DOUBLE) AS is_weekend) FROM split) t),
sq AS (SELECT site_id, timestamp, is_train, avg_devices_future,
              list([round(s_avg_devices + 1e-9, 6), round(s_hour + 1e-9, 6), round(s_day_of_week + 1e-9, 6),
                    round(s_is_weekend + 1e-9, 6)])
                OVER (PARTITION BY site_id ORDER BY timestamp ROWS BETWEEN {CFG1.lookback_window} PRECEDING AND 1 PRECEDING)
                AS sequence
       FROM sc)
SELECT * FROM sq WHERE len(sequence) = {CFG1.lookback_window}""", doubles=("avg_devices_future",))
def q_sequences(spark, sf_dir):
    d = features.scaled_sequences(features.target(ml1(spark, sf_dir), CFG1), CFG1)
    seq = F.transform("sequence", lambda a: F.transform(a, lambda x: F.round(x + F.lit(1e-9), 6)))
    return present(d.withColumn("sequence", seq))


# ------------------------------------------------------------ model fits ----

#: Trees and depth of the registered boosted fits that SQL follows: whole rows and features, no early stop.
TREES, DEPTH = 3, 3
CFG_TREES = CFG1.with_(n_estimators=TREES, max_depth=DEPTH, subsample=1.0, colsample=1.0, early_stopping_rounds=0)


def _forecaster(spark, sf_dir, cfg=CFG_TREES):
    d = features.split_flags(target1(spark, sf_dir), cfg)
    return forecast.fit_forecaster(d.where(F.col("is_train")).drop("row_index", "is_train"), cfg)


def _patterns1(spark, sf_dir):
    return patterns.fit_patterns(cyclic_features(ml1(spark, sf_dir)), CFG1.with_(gmm_max_iter=ROUNDS, gmm_tol=0.0))


def _boosted_sql() -> str:
    """CTEs that grow the trees and end in ``scored``: every row of ``ml`` with its target (or NULL), is_train and prediction."""
    feats = sq.ml_columns(CFG1)[2:]
    n, lam, digits = len(feats), boosting.L2, boosting.GAIN_DIGITS
    probs = ", ".join(str(i / boosting.BINS) for i in range(1, boosting.BINS))
    known = "avg_devices_future IS NOT NULL"
    ctes = [f"""feat AS MATERIALIZED (
  SELECT *, is_train AND rn <= floor(nt * {1.0 - CFG_TREES.validation_fraction}) AS fit FROM (
    SELECT *, count(*) FILTER (WHERE is_train) OVER (PARTITION BY site_id) AS nt FROM (
      SELECT *, {known} AND rn <= floor(nk * {CFG_TREES.train_fraction}) AS is_train FROM (
        SELECT row_number() OVER (ORDER BY site_id, timestamp) AS id, *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp) AS rn,
               count(avg_devices_future) OVER (PARTITION BY site_id) AS nk, [{", ".join(f"CAST({c} AS DOUBLE)" for c in feats)}] AS x
        FROM (SELECT *, lead(avg_devices, {CFG_TREES.forecast_horizon}) OVER (PARTITION BY site_id ORDER BY timestamp) AS avg_devices_future FROM ml) t) t) t) t)""",
            f"cell AS MATERIALIZED (SELECT id, fit, unnest(x) AS v, unnest(range(0, {n})) AS f FROM feat)",
            f"cut AS MATERIALIZED (SELECT f, list_sort(list_distinct(quantile_cont(v, [{probs}]))) AS q FROM cell WHERE fit GROUP BY f)",
            "binned AS MATERIALIZED (SELECT id, f, len(list_filter(q, lambda t: t < v)) AS bin FROM cell JOIN cut USING (f))",
            "s0 AS MATERIALIZED (SELECT id, fit, avg_devices_future AS y, avg(avg_devices_future) FILTER (WHERE fit) OVER () AS p FROM feat)"]
    for t in range(TREES):
        ctes.append(f"n{t}_0 AS (SELECT id, 0 AS node FROM feat)")
        for d in range(DEPTH):
            ctes += [f"""h{t}_{d} AS MATERIALIZED (
  SELECT node, f, bin, sum(g) OVER l AS gl, sum(n) OVER l AS nl, sum(g) OVER w AS ga, sum(n) OVER w AS na FROM (
    SELECT node, f, bin, sum(y - p) AS g, count(*) AS n FROM s{t} JOIN n{t}_{d} USING (id) JOIN binned USING (id) WHERE fit GROUP BY ALL) t
  WINDOW l AS (PARTITION BY node, f ORDER BY bin ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY node, f))""",
                     f"""b{t}_{d} AS MATERIALIZED (
  SELECT node, f, bin FROM (SELECT *, round(gl * gl / (nl + {lam}) + (ga - gl) * (ga - gl) / (na - nl + {lam}) - ga * ga / (na + {lam}), {digits}) AS gain
                            FROM h{t}_{d} WHERE nl < na) t
  WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) = 1)""",
                     f"""n{t}_{d + 1} AS MATERIALIZED (
  SELECT a.id, 2 * a.node + CASE WHEN c.bin > b.bin THEN 2 ELSE 1 END AS node
  FROM n{t}_{d} a LEFT JOIN b{t}_{d} b ON a.node = b.node LEFT JOIN binned c ON c.id = a.id AND c.f = b.f)"""]
        ctes += [f"v{t} AS MATERIALIZED (SELECT node, {CFG_TREES.learning_rate} * sum(y - p) / (count(*) + {lam}) AS v FROM s{t} JOIN n{t}_{DEPTH} USING (id) WHERE fit GROUP BY node)",
                 f"s{t + 1} AS MATERIALIZED (SELECT id, fit, y, p + v AS p FROM s{t} JOIN n{t}_{DEPTH} USING (id) JOIN v{t} USING (node))"]
    ctes.append(f"scored AS (SELECT feat.*, s{TREES}.p AS prediction FROM feat JOIN s{TREES} USING (id))")
    return ",\n".join(ctes)


BOOSTED_SQL = (*ML1_SQL, _boosted_sql())


#: Rounds of the registered mixture fits: a fixed number, so that SQL can follow them.
ROUNDS = 5
_D = range(len(patterns.PATTERN_FEATURES))


def _mixture_sql(src: str, start: str, kind: str = "full") -> str:
    """CTEs that fit the mixture on ``src`` by ROUNDS rounds from ``start`` and end in ``lab``: id, cluster and the
    ordered probabilities q0, q1, q2."""
    feats = {"avg_devices": "avg_devices", "hour_sin": "sin(2 * pi() * hour / 24)", "hour_cos": "cos(2 * pi() * hour / 24)",
             "dow_sin": "sin(2 * pi() * day_of_week / 7)", "dow_cos": "cos(2 * pi() * day_of_week / 7)"}
    std = lambda n: f"stddev_pop(f_{n}) OVER (PARTITION BY site_id)"
    z = ", ".join(f"CASE WHEN {std(n)} > 0 THEN (f_{n} - avg(f_{n}) OVER (PARTITION BY site_id)) / {std(n)} ELSE 0 END AS x{i}" for i, n in enumerate(feats))
    pairs = [(a, b) for a in _D for b in _D if a <= b]
    eps, reg, half = mixture.LEAST_POINTS, mixture.REGULARISATION, len(_D) / 2
    ctes = [f"pt AS MATERIALIZED (SELECT *, {z} FROM (SELECT row_number() OVER (ORDER BY site_id, timestamp) AS id, *, "
            + ", ".join(f"{e} AS f_{n}" for n, e in feats.items()) + f", {start} AS s FROM {src}) t)",
            "r0 AS MATERIALIZED (SELECT id, j, CASE WHEN s = j THEN 1.0::DOUBLE ELSE 0.0 END AS r FROM pt CROSS JOIN (SELECT unnest([0, 1, 2]) AS j) t)"]
    for n in range(ROUNDS + 1):
        sums = ", ".join([f"sum(r * x{a}) / (sum(r) + {eps}) AS m{a}" for a in _D] + [f"sum(r * x{a} * x{b}) / (sum(r) + {eps}) AS e{a}{b}" for a, b in pairs])
        if kind == "full":
            cov = [f"e{a}{b} - m{a} * m{b}{f' + {reg}' if a == b else ''} AS c{a}{b}" for a, b in pairs]
        elif kind == "tied":
            cov = [f"sum(nk * (e{a}{b} - m{a} * m{b})) OVER () / sum(nk) OVER (){f' + {reg}' if a == b else ''} AS c{a}{b}" for a, b in pairs]
        else:
            var = [f"greatest(e{a}{a} - m{a} * m{a}, 0)" for a in _D]
            if kind == "spherical":
                var = [f"({' + '.join(var)}) / {len(_D)}"] * len(_D)
            cov = [f"{var[a]} + {reg} AS c{a}{b}" if a == b else f"0.0::DOUBLE AS c{a}{b}" for a, b in pairs]
        chol = []
        for j in _D:      # columns of the lower triangular root, one after the other
            chol.append(f"sqrt(c{j}{j}{''.join(f' - l{j}{m} * l{j}{m}' for m in range(j))}) AS l{j}{j}")
            chol += [f"(c{j}{i}{''.join(f' - l{i}{m} * l{j}{m}' for m in range(j))}) / l{j}{j} AS l{i}{j}" for i in _D if i > j]
        solve = [f"(x{i} - m{i}{''.join(f' - l{i}{m} * y{m}' for m in range(i))}) / l{i}{i} AS y{i}" for i in _D]
        log = f"ln(w) - ({' + '.join(f'ln(l{i}{i})' for i in _D)}) - {half} * ln(2 * pi()) - 0.5 * ({' + '.join(f'y{i} * y{i}' for i in _D)})"
        ctes += [f"p{n} AS MATERIALIZED (SELECT *, {', '.join(cov)} FROM (SELECT j, sum(r) + {eps} AS nk, (sum(r) + {eps}) / count(*) AS w, {sums} FROM r{n} JOIN pt USING (id) GROUP BY j) t)",
                 f"h{n} AS MATERIALIZED (SELECT *, {', '.join(chol)} FROM p{n})",
                 f"l{n} AS MATERIALIZED (SELECT id, j, {', '.join(solve)}, {log} AS l FROM pt CROSS JOIN h{n})",
                 f"r{n + 1} AS MATERIALIZED (SELECT id, j, exp(l - t) / sum(exp(l - t)) OVER (PARTITION BY id) AS r FROM (SELECT id, j, l, max(l) OVER (PARTITION BY id) AS t FROM l{n}) t)"]
    last = f"r{ROUNDS + 1}"
    ctes += [f"won AS (SELECT id, arg_max(j, r) AS j FROM {last} GROUP BY id)",
             "place AS (SELECT t.j, row_number() OVER (ORDER BY m NULLS LAST, t.j) - 1 AS c FROM (SELECT unnest([0, 1, 2]) AS j) t "
             "LEFT JOIN (SELECT won.j, avg(x0) AS m FROM won JOIN pt USING (id) GROUP BY won.j) a USING (j))",
             "lab AS (SELECT id, CAST(arg_max(c, r) AS INTEGER) AS cluster, " + ", ".join(f"max(r) FILTER (WHERE c = {c}) AS q{c}" for c in range(3))
             + f" FROM {last} JOIN place USING (j) GROUP BY id)"]
    return ",\n".join(ctes)


_LABEL = "['Quiet', 'Moderate', 'Busy'][lab.cluster + 1]"


def _clusters_sql(kind: str) -> str:
    return _with(*TIERS_SQL, _mixture_sql("tiered", "tier", kind)) + f"""
SELECT pt.site_id, pt.timestamp, pt.avg_devices, lab.cluster, q0 AS p_quiet, q1 AS p_moderate, q2 AS p_busy, {_LABEL} AS cluster_label
FROM pt JOIN lab USING (id)"""


def _clusters(spark, sf_dir, kind: str):
    """Mixture fitted on the 4-hour windows of all sites; every window
    labelled Quiet / Moderate / Busy with ordered probabilities."""
    d = win4(spark, sf_dir)
    cfg = CFG4.with_(gmm_max_iter=ROUNDS, gmm_tol=0.0, covariance_type=kind)
    out = patterns.fit_patterns(d, cfg).label(d)
    return present(out.select("site_id", "timestamp", "avg_devices", "cluster", "p_quiet", "p_moderate", "p_busy", "cluster_label"))


_PROBS = ("avg_devices", "p_quiet", "p_moderate", "p_busy")


@register("pattern_clusters", _clusters_sql("full"), doubles=_PROBS)
def q_pattern_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir, "full")


@register("pattern_clusters_tied", _clusters_sql("tied"), doubles=_PROBS)
def q_pattern_clusters_tied(spark, sf_dir):
    return _clusters(spark, sf_dir, "tied")


@register("pattern_clusters_diag", _clusters_sql("diag"), doubles=_PROBS)
def q_pattern_clusters_diag(spark, sf_dir):
    return _clusters(spark, sf_dir, "diag")


@register("pattern_clusters_spherical", _clusters_sql("spherical"), doubles=_PROBS)
def q_pattern_clusters_spherical(spark, sf_dir):
    return _clusters(spark, sf_dir, "spherical")


@register("forecast_predictions", _with(*BOOSTED_SQL) + """
SELECT site_id, timestamp, avg_devices, avg_devices_future, prediction, avg_devices_future - prediction AS residual
FROM scored WHERE avg_devices_future IS NOT NULL AND NOT is_train""", doubles=("avg_devices", "avg_devices_future", "prediction", "residual"))
def q_forecast(spark, sf_dir):
    """Boosted trees fitted on each site's first 80 % of hourly rows less
    their last 20 %; predictions and residuals on the test rows."""
    return present(_forecasts(spark, sf_dir, CFG_TREES))


def _forecasts(spark, sf_dir, cfg):
    d = features.split_flags(target1(spark, sf_dir), cfg)
    model = _forecaster(spark, sf_dir, cfg)
    test = d.where(~F.col("is_train")).drop("row_index", "is_train")
    out = model.predict(test).withColumn("residual", F.col("avg_devices_future") - F.col("prediction"))
    return out.select("site_id", "timestamp", "avg_devices", "avg_devices_future", "prediction", "residual")


@register("forecast_predictions_shipped")
def q_forecast_shipped(spark, sf_dir):
    """The same with the shipped configuration: up to 200 trees of depth 6 on
    drawn rows and features, stopped early on the validation rows."""
    return present(_forecasts(spark, sf_dir, CFG1))


@register("forecast_metrics", _with(*BOOSTED_SQL) + _metrics_sql("avg_devices_future", "prediction", "site_id", "scored",
                                                                 "avg_devices_future IS NOT NULL AND NOT is_train"), doubles=METRIC_DOUBLES)
def q_forecast_metrics(spark, sf_dir):
    return present(forecast.metrics(_forecasts(spark, sf_dir, CFG_TREES), "avg_devices_future", "prediction", ["site_id"]))


@register("prediction_snapshot", _with(*BOOSTED_SQL, _mixture_sql(
    "ml", "CASE WHEN avg_devices < quantile_cont(avg_devices, 0.1) OVER (PARTITION BY site_id) THEN 0 "
          "WHEN avg_devices > quantile_cont(avg_devices, 0.7) OVER (PARTITION BY site_id) THEN 2 ELSE 1 END")) + f"""
SELECT site_id, timestamp, scored.avg_devices AS current_traffic, prediction AS predicted_traffic,
       timestamp + INTERVAL {CFG1.forecast_horizon} HOUR AS forecast_time, {_LABEL} AS current_cluster, q0 AS p_quiet, q1 AS p_moderate, q2 AS p_busy
FROM scored JOIN pt USING (site_id, timestamp) JOIN lab ON lab.id = pt.id
QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY timestamp DESC) = 1""", doubles=("current_traffic", "predicted_traffic", "p_quiet", "p_moderate", "p_busy"))
def q_snapshot(spark, sf_dir):
    """Latest hourly window per site scored by both models."""
    fc = _forecaster(spark, sf_dir)
    pm = _patterns1(spark, sf_dir)
    snap = snapshot.score_latest(ml1(spark, sf_dir), pm, fc, horizon_hours=CFG1.forecast_horizon)
    return present(snap)
