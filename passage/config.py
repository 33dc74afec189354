"""Operator parameters.

One frozen dataclass replaces the YAML file of the original system. Defaults
are the shipped configuration values; ``Config.for_events()`` gives the scaled
values used with the 15-minute scans derived from the ``events`` test table.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Config:
    # fixed values: the defaults below are the original system's shipped
    # configuration (capture, privacy, aggregation, features, models,
    # retention); the remaining fields are this engine's own parameters.

    # --- capture (seconds / dBm) -------------------------------------------
    scan_interval: int = 3
    scan_duration: int = 8
    stationary_threshold: int = 180
    rssi_threshold: int = -80
    device_timeout: int = 180
    log_empty_scans: bool = False

    # --- privacy -----------------------------------------------------------
    salt_rotation_days: int = 7

    # --- aggregation -------------------------------------------------------
    window_hours: int = 4
    slide_hours: int = 0  # 0 = tumbling
    min_scans_per_window: int = 1

    # --- features ----------------------------------------------------------
    include_hour: bool = True
    include_day_of_week: bool = True
    include_month: bool = True
    include_is_weekend: bool = True
    lag_periods: tuple[int, ...] = (1, 2, 3, 4, 6, 12, 24, 168)
    rolling_windows: tuple[int, ...] = (6, 12, 24, 168)
    rolling_stats: tuple[str, ...] = ("mean", "std", "min", "max")
    value_col: str = "avg_devices"

    # --- patterns (mixture model) ------------------------------------------
    n_components: int = 3
    gmm_max_iter: int = 100
    gmm_tol: float = 1e-3  # rise of the mean log likelihood that ends the rounds; 0 = never
    covariance_type: str = "full"  # full, tied, diag, spherical
    seed: int = 42

    # --- forecasting -------------------------------------------------------
    forecast_horizon: int = 4
    lookback_window: int = 168
    train_fraction: float = 0.8
    validation_fraction: float = 0.2
    n_estimators: int = 200
    max_depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.8
    early_stopping_rounds: int = 20

    # --- retention / retraining -------------------------------------------
    raw_retention_days: int = 30
    processed_retention_days: int = 365
    retrain_every_days: int = 7
    retrain_min_samples: int = 1000

    # --- presence: device histories are split into buckets of this many
    # seconds so that one always-present device never lands in one task
    presence_bucket_seconds: int = 86400

    # --- read models -------------------------------------------------------
    history_hours: int = 48
    today_windows: int = 24

    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def with_(self, **kw) -> "Config":
        return replace(self, **kw)

    @staticmethod
    def for_events(window_hours: int = 4) -> "Config":
        """Scaled parameters for detections derived from ``events``:
        15-minute scans, 6 h device timeout, 12 h stationary threshold."""
        return Config(
            scan_interval=900,
            stationary_threshold=12 * 3600,
            device_timeout=6 * 3600,
            window_hours=window_hours,
        )
