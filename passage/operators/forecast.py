"""Forecasting: baselines, metrics, blending, cross-validation folds and the
gradient-boosted forecaster (``boosting.py``).

Deterministic parts (baselines, metrics, folds) are window functions and
aggregates per key. The boosted model is one distributed fit over all keys
(keys can enter as features)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passage.config import Config
from passage.operators import DEFAULT_KEYS
from passage.operators.boosting import Boosted, fit_boosted
from passage.operators.features import TARGET, feature_columns, split_flags

V = "avg_devices"


# ---------------------------------------------------------------- baselines --

def baselines(df: DataFrame, cfg: Config, keys=DEFAULT_KEYS, value: str = V,
              season_rows: int = 24, avg_rows: int = 24) -> DataFrame:
    """Baseline forecasts of ``value`` ``cfg.forecast_horizon`` rows ahead:

    * ``pred_naive``: same time one season earlier (``season_rows`` rows
      before the target row, i.e. ``lag(season_rows - horizon)``);
    * ``pred_moving_avg``: mean of the last ``avg_rows`` rows;
    * ``pred_linear``: least-squares line of value on row index, fitted on
      each key's training rows (``is_train``), extrapolated to the target row.
    """
    h = cfg.forecast_horizon
    if season_rows <= h:
        raise ValueError("season_rows must exceed the forecast horizon")
    if "is_train" not in df.columns:
        df = split_flags(df, cfg, keys)
    w = Window.partitionBy(*keys).orderBy("timestamp")
    part = Window.partitionBy(*keys)
    x = F.col("row_index").cast("double")
    y = F.col(value)
    slope = F.regr_slope(F.when(F.col("is_train"), y), F.when(F.col("is_train"), x)).over(part)
    icept = F.regr_intercept(F.when(F.col("is_train"), y), F.when(F.col("is_train"), x)).over(part)
    return df.select(
        "*",
        F.lag(value, season_rows - h).over(w).alias("pred_naive"),
        F.avg(value).over(w.rowsBetween(-(avg_rows - 1), 0)).alias("pred_moving_avg"),
        (icept + slope * (x + F.lit(float(h)))).alias("pred_linear"))


def blend(df: DataFrame, a: str, b: str, weight_a: float = 0.6, out: str = "pred_blend") -> DataFrame:
    """Weighted ensemble ``weight_a * a + (1 - weight_a) * b``."""
    return df.withColumn(out, F.lit(weight_a) * F.col(a) + F.lit(1.0 - weight_a) * F.col(b))


# ------------------------------------------------------------------ metrics --

def metric_columns(actual: str, predicted: str):
    y, p = F.col(actual), F.col(predicted)
    err = y - p
    n = F.count(err)
    sse = F.sum(err * err)
    sst = F.var_pop(F.when(err.isNotNull(), y)) * n
    return [
        n.alias("n"),
        F.try_divide(sse, n).alias("mse"),
        F.sqrt(F.try_divide(sse, n)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (F.lit(1.0) - F.try_divide(sse, sst)).alias("r2"),
        (F.avg(F.abs(F.try_divide(err, F.when(y != 0, y)))) * F.lit(100.0)).alias("mape"),
        F.count_if(err.isNotNull() & (y == 0)).alias("zero_actuals"),
    ]


def metrics(df: DataFrame, actual: str, predicted: str, keys=()) -> DataFrame:
    """mse, rmse, mae, r2 and mape (%) of ``predicted`` vs ``actual`` per key
    (rows with a NULL prediction are skipped; zero actuals are left out of
    mape and counted in ``zero_actuals``; r2 is NULL where the actuals do
    not vary, as with a single row)."""
    return df.groupBy(*keys).agg(*metric_columns(actual, predicted))


def directional_accuracy(df: DataFrame, actual: str, predicted: str, current: str = V,
                         keys=()) -> DataFrame:
    """Share of rows where the forecast moves in the same direction (up,
    down, flat) as the actual value, relative to the current value."""
    same = F.signum(F.col(predicted) - F.col(current)) == F.signum(F.col(actual) - F.col(current))
    return df.groupBy(*keys).agg(F.avg(same.cast("double")).alias("directional_accuracy"),
                                 F.count(same).alias("n"))


# ------------------------------------------------------------- CV folds -----

def expanding_folds(df: DataFrame, n_folds: int, keys=DEFAULT_KEYS) -> DataFrame:
    """Expanding-window folds: rows are cut per key into ``n_folds + 1``
    chronological tiles; fold f (1…n_folds) trains on tiles ≤ f and tests on
    tile f + 1. Each row is emitted once per fold it takes part in, with
    ``fold`` and ``role`` ('train' / 'test')."""
    tile = F.ntile(n_folds + 1).over(Window.partitionBy(*keys).orderBy("timestamp"))
    d = df.withColumn("_tile", tile)
    folds = F.sequence(F.lit(1), F.lit(n_folds))
    memb = F.filter(F.transform(folds, lambda f: F.struct(
        f.alias("fold"),
        F.when(d["_tile"] <= f, F.lit("train")).when(d["_tile"] == f + 1, F.lit("test")).alias("role"))),
        lambda s: s["role"].isNotNull())
    return d.select("*", F.explode(memb).alias("_m")).select(
        *[c for c in d.columns if c != "_tile"], "_m.fold", "_m.role")


def cv_linear_trend(df: DataFrame, cfg: Config, n_folds: int = 4, keys=DEFAULT_KEYS,
                    value: str = V) -> DataFrame:
    """Per fold and key: fit the value-on-row-index line on the training
    tiles, forecast ``horizon`` rows ahead on the test tile, report metrics."""
    h = cfg.forecast_horizon
    w = Window.partitionBy(*keys).orderBy("timestamp")
    d = (df.withColumn("_x", F.row_number().over(w).cast("double"))
           .withColumn("_y", F.lead(value, h).over(w)))
    f = expanding_folds(d, n_folds, keys)
    fits = (f.where(F.col("role") == "train").groupBy(*keys, "fold")
             .agg(F.regr_slope(value, "_x").alias("_b"), F.regr_intercept(value, "_x").alias("_a")))
    test = (f.where((F.col("role") == "test") & F.col("_y").isNotNull())
             .join(fits, [*keys, "fold"])
             .withColumn("_p", F.col("_a") + F.col("_b") * (F.col("_x") + F.lit(float(h)))))
    return metrics(test, "_y", "_p", [*keys, "fold"])


# --------------------------------------------------------- boosted trees ----

@dataclass
class Forecaster:
    model: Boosted
    feature_cols: list
    best_iterations: int
    label: str = TARGET

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.predict(df)


def validation_flags(train: DataFrame, cfg: Config, keys=DEFAULT_KEYS, how: str = "chronological") -> DataFrame:
    """``is_val``: the last ``validation_fraction`` of each key's training
    rows (chronological, default) or a deterministic hash sample of rows."""
    if how == "hash":
        u = (F.xxhash64(*keys, "timestamp", F.lit(cfg.seed)) % 1000 + 1000) % 1000
        return train.withColumn("is_val", u < F.lit(int(cfg.validation_fraction * 1000)))
    w = Window.partitionBy(*keys).orderBy("timestamp")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rn = F.row_number().over(w)
    return train.withColumn("is_val", rn > F.floor(n * F.lit(1.0 - cfg.validation_fraction)))


def fit_forecaster(train: DataFrame, cfg: Config, keys=DEFAULT_KEYS, label: str = TARGET,
                   feature_cols=None, val_how: str = "chronological") -> Forecaster:
    """Gradient-boosted trees (``boosting.py``) on the rows that are not
    validation rows; training stops after ``early_stopping_rounds`` trees
    without a lower validation error (0: never) and keeps the first best ones.
    The same rows give the same model however they are partitioned."""
    feats = feature_cols or feature_columns(train, keys, exclude=("timestamp", label))
    d = validation_flags(train, cfg, keys, val_how)
    model = fit_boosted(d, feats, label, [*keys, "timestamp"], is_val="is_val", trees=cfg.n_estimators, depth=cfg.max_depth, rate=cfg.learning_rate,
                        subsample=cfg.subsample, colsample=cfg.colsample, patience=cfg.early_stopping_rounds or None, seed=cfg.seed)
    return Forecaster(model=model, feature_cols=feats, best_iterations=len(model.trees), label=label)
