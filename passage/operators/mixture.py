"""Gaussian mixtures by expectation-maximisation on sufficient statistics.

A round is one aggregate over the points: log densities of all components are
column expressions of the current parameters, responsibilities follow by
log-sum-exp, and the sums of r, r·x and r·x·xᵀ (k · (1 + d + d(d+1)/2) numbers)
give the next weights, means and covariances on the driver. Nothing but these
sums leaves the executors, partial sums are combined before the exchange, and
the points are read anew each round from wherever ``points`` comes from, so a
lost executor costs its tasks only.

Covariances are ``full`` (one matrix a component), ``tied`` (one matrix for
all), ``diag`` (variances) or ``spherical`` (one variance); ``REGULARISATION``
is added to their diagonals. The start is a given assignment of points to
components. A component without points keeps a vanishing weight.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COVARIANCE_TYPES = ("full", "tied", "diag", "spherical")
REGULARISATION = 1e-6
#: Added to the points of each component, so that one without points divides.
LEAST_POINTS = 10 * float(np.finfo(float).eps)


@dataclass
class Mixture:
    """weights (k), means (k × d), covariances (k × d × d, whatever the type)."""
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    rounds: int = 0
    log_likelihood: float | None = None  # mean, of the points under the parameters before the last round

    def to_dict(self) -> dict:
        return {"weights": self.weights.tolist(), "means": self.means.tolist(), "covariances": self.covariances.tolist(),
                "rounds": self.rounds, "log_likelihood": self.log_likelihood}

    @staticmethod
    def from_dict(d: dict) -> "Mixture":
        return Mixture(np.array(d["weights"]), np.array(d["means"]), np.array(d["covariances"]), d["rounds"], d["log_likelihood"])

    def log_joint(self, x: list[Column]) -> list[Column]:
        """log(weight · density) of each component."""
        out = []
        for w, mean, cov in zip(self.weights, self.means, self.covariances):
            u = np.linalg.inv(np.linalg.cholesky(cov))  # lower triangular: |u (x - mean)|² is the Mahalanobis distance
            off = [c - F.lit(float(m)) for c, m in zip(x, mean)]
            square = None
            for i, row in enumerate(u):
                terms = [F.lit(float(row[j])) * off[j] for j in range(i + 1) if row[j] != 0.0]
                y = terms[0]
                for t in terms[1:]:
                    y = y + t
                square = y * y if square is None else square + y * y
            const = math.log(w) + float(np.log(np.diag(u)).sum()) - 0.5 * len(mean) * math.log(2 * math.pi)
            out.append(F.lit(const) - F.lit(0.5) * square)
        return out

    def responsibilities(self, df: DataFrame, features, prefix: str = "_r") -> DataFrame:
        """Adds ``_r0`` … (sum 1) and ``_ll``, the point's log likelihood; NULL where a feature is."""
        k = len(self.weights)
        x = [F.col(c) for c in features]
        known = x[0].isNotNull()
        for c in x[1:]:
            known = known & c.isNotNull()
        d = df.select("*", *[F.when(known, c).alias(f"{prefix}l{j}") for j, c in enumerate(self.log_joint(x))])
        top = F.greatest(*[F.col(f"{prefix}l{j}") for j in range(k)]) if k > 1 else F.col(f"{prefix}l0")
        d = d.select("*", top.alias(f"{prefix}t"))
        total = sum((F.exp(F.col(f"{prefix}l{j}") - F.col(f"{prefix}t")) for j in range(k)), F.lit(0.0))
        d = d.select("*", (F.col(f"{prefix}t") + F.log(total)).alias("_ll"))
        return d.select(*df.columns, "_ll", *[F.exp(F.col(f"{prefix}l{j}") - F.col("_ll")).alias(f"{prefix}{j}") for j in range(k)])


def _sums(df: DataFrame, features, k: int, prefix: str):
    """Points, their log likelihood and the sums of r, r·x and r·x·xᵀ: one aggregate."""
    d, cols = len(features), []
    for j in range(k):
        r = F.col(f"{prefix}{j}")
        cols.append(F.sum(r))
        cols += [F.sum(r * F.col(c)) for c in features]
        cols += [F.sum(r * F.col(features[a]) * F.col(features[b])) for a in range(d) for b in range(a, d)]
    ll = F.sum("_ll") if "_ll" in df.columns else F.lit(None).cast("double")
    row = df.agg(F.count(F.lit(1)).alias("n"), ll.alias("ll"), *[c.alias(f"s{i}") for i, c in enumerate(cols)]).first()
    flat = np.array([0.0 if v is None else v for v in row[2:]]).reshape(k, -1)
    second = np.zeros((k, d, d))
    up = np.triu_indices(d)
    second[:, up[0], up[1]] = flat[:, 1 + d:]
    second[:, up[1], up[0]] = flat[:, 1 + d:]
    return row["n"], row["ll"], flat[:, 0], flat[:, 1:1 + d], second


def maximised(n: int, r: np.ndarray, first: np.ndarray, second: np.ndarray, kind: str) -> Mixture:
    """Parameters from the sums of r, r·x and r·x·xᵀ."""
    if kind not in COVARIANCE_TYPES:
        raise ValueError(f"covariance_type must be one of {COVARIANCE_TYPES}")
    r = r + LEAST_POINTS
    k, d = first.shape
    means = first / r[:, None]
    if kind == "tied":
        one = (second.sum(0) - np.einsum("k,ka,kb->ab", r, means, means)) / r.sum()
        cov = np.repeat(one[None], k, axis=0)
    else:
        cov = second / r[:, None, None] - np.einsum("ka,kb->kab", means, means)
    if kind in ("diag", "spherical"):
        var = np.maximum(np.einsum("kaa->ka", cov), 0.0)
        if kind == "spherical":
            var = np.repeat(var.mean(1, keepdims=True), d, axis=1)
        cov = np.einsum("ka,ab->kab", var, np.eye(d))
    return Mixture(r / max(n, 1), means, cov + REGULARISATION * np.eye(d))


def fit_mixture(points: DataFrame, features, start: str, k: int = 3, covariance_type: str = "full", max_iter: int = 100, tol: float = 1e-3) -> Mixture:
    """Mixture of ``k`` components of the feature columns of ``points`` (a stored table; rows with a NULL feature are
    left out), started from the component numbers 0 … k-1 in column ``start``. Rounds end when the mean log
    likelihood rises by less than ``tol`` (0: never) or after ``max_iter`` rounds."""
    features = list(features)
    known = points.na.drop(subset=features)
    first = known.select(*features, *[(F.col(start) == j).cast("double").alias(f"_r{j}") for j in range(k)])
    n, _, *sums = _sums(first, features, k, "_r")
    if not n:
        raise ValueError("no points to fit the mixture on")
    model, before = maximised(n, *sums, covariance_type), None
    for done in range(1, max_iter + 1):
        n, ll, *sums = _sums(model.responsibilities(known.select(*features), features), features, k, "_r")
        model = maximised(n, *sums, covariance_type)
        model.rounds, model.log_likelihood = done, ll / n
        if tol and before is not None and abs(model.log_likelihood - before) < tol:
            break
        before = model.log_likelihood
    return model
