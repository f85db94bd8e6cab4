"""Gaussian mixtures by EM over DataFrame aggregates.

An iteration is one pass over the rows, shared by all models that are fitted at once (see
``em``); only the sufficient statistics of the components reach the driver.  Scoring is by column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplexa.functions import simplex as sx
from simplexa.operators import em, kernel
from simplexa.operators.confusion import log_density, moments_local


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray


@dataclass
class Fit:
    model: Mixture
    loglik: float  #: mean over rows
    n: int
    n_iter: int
    converged: bool

    @property
    def parameters(self) -> int:
        k, d = self.model.means.shape
        return k - 1 + k * d + k * d * (d + 1) // 2

    @property
    def bic(self) -> float:
        return -2 * self.loglik * self.n + self.parameters * math.log(self.n)

    @property
    def aic(self) -> float:
        return -2 * self.loglik * self.n + 2 * self.parameters


def _coords(vector: str, d: int) -> list:
    return [F.get(vector, F.lit(i)) for i in range(d)]


def log_joint(model: Mixture, vector: str):
    """Array of log(weight) + log density of each component."""
    d = model.means.shape[1]
    x = _coords(vector, d)
    return F.array(*[F.lit(float(math.log(max(w, 1e-300)))) + log_density(x, m, c) for w, m, c in zip(model.weights, model.means, model.covs, strict=True)])


def _log_sum(v):
    top = F.array_max(v)
    return top + F.ln(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def predict(df: DataFrame, model: Mixture, vector: str = "x") -> DataFrame:
    """Adds resp, label and the row's log likelihood (M3)."""
    t = df.withColumn("_l", log_joint(model, vector)).withColumn("loglik", _log_sum(F.col("_l")))
    t = t.withColumn("resp", F.transform("_l", lambda x: F.exp(x - F.col("loglik"))))
    return t.withColumn("label", sx.argmax(F.col("_l"))).drop("_l")


def _from_hard(df: DataFrame, vector: str, d: int, k: int, label: str, reg: float) -> Mixture:
    """Weights, means and covariances of the hard classes; an empty class gets the overall ones."""
    stats = moments_local(df, label, vector, d)
    n = sum(s[0] for s in stats.values())
    mean = sum(s[0] * s[1] for s in stats.values()) / n
    cov = sum((s[0] - 1) * np.nan_to_num(s[2]) + s[0] * np.outer(s[1] - mean, s[1] - mean) for s in stats.values()) / n + reg * np.eye(d)
    weights, means, covs = np.full(k, 1e-3), np.tile(mean, (k, 1)), np.tile(cov, (k, 1, 1))
    for c, (m, mu, s) in stats.items():
        if 0 <= c < k and m > d:
            weights[c], means[c], covs[c] = m / n, mu, s + reg * np.eye(d)
    return Mixture(weights / weights.sum(), means, covs)


def sample(df: DataFrame, vector: str, seed: int, key: str = "uid") -> np.ndarray:
    """At most 2,000 rows, the first by a hash."""
    return np.array([r[0] for r in df.select(vector).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(2000).collect()])


def seeded(x: np.ndarray, d: int, k: int, seed: int, reg: float) -> Mixture:
    """Spread-out starting means from a ``sample``."""
    rng = np.random.default_rng(seed)
    means = [x[rng.integers(len(x))]]
    while len(means) < k:
        gap = np.min([((x - m) ** 2).sum(1) for m in means], axis=0)
        means.append(x[rng.choice(len(x), p=gap / gap.sum())] if gap.sum() > 0 else x[rng.integers(len(x))])
    cov = np.atleast_2d(np.cov(x.T)) / max(k, 1) ** (2 / d) + reg * np.eye(d)
    return Mixture(np.full(k, 1 / k), np.array(means), np.tile(cov, (k, 1, 1)))


def _starts(df: DataFrame, vector: str, d: int, ks: Sequence[int], init: str | Mixture, reg: float, seed: int, key: str) -> list[Mixture]:
    """A start for each number of components; those by seed share one sample."""
    if isinstance(init, Mixture):
        return [init for _ in ks]
    if init != "seed":
        return [_from_hard(df, vector, d, k, init, reg) for k in ks]
    x = sample(df, vector, seed, key)
    return [seeded(x, d, k, seed, reg) for k in ks]


def fit_all(df: DataFrame, vector: str, d: int, starts: Sequence[Mixture], **options) -> list[Fit]:
    """Mixtures from several starts, all in the same passes over the rows; see ``em.fit`` for the options."""
    found = em.fit(df, vector, d, [(m.weights, m.means, m.covs) for m in starts], **options)
    return [Fit(Mixture(*f["model"]), float(f["loglik"]), int(round(f["n"])), f["n_iter"], f["converged"]) for f in found]


def fit(df: DataFrame, vector: str, d: int, k: int, *, init: str | Mixture = "hard", reg: float = 1e-6, max_iter: int = 500, tol: float = 1e-5, seed: int = 0, n_init: int = 1, weight: str | None = None, key: str = "uid") -> Fit:
    """Full-covariance mixture (M1): ``init`` names a label column, is "seed", or is a mixture to start from; of ``n_init`` seeds the best."""
    starts = [_starts(df, vector, d, [k], init, reg, seed + i, key)[0] for i in range(n_init if init == "seed" else 1)]
    return max(fit_all(df, vector, d, starts, reg=reg, max_iter=max_iter, tol=tol, weight=weight, key=key), key=lambda f: f.loglik)


def diagnostics(f: Fit) -> dict:
    """Convergence, criteria, weights and condition numbers."""
    return {"converged": f.converged, "n_iter": f.n_iter, "bic": f.bic, "aic": f.aic, "loglik": f.loglik, "weights": f.model.weights.tolist(), "cond": [float(np.linalg.cond(c)) for c in f.model.covs]}


def bic_sweep(df: DataFrame, vector: str, d: int, ks: range, *, reg: float = 1e-6, seed: int = 0, key: str = "uid", init: str = "seed", **options) -> list[dict]:
    """Criteria for a range of component numbers, fitted in the same passes (M4, M5)."""
    starts = _starts(df, vector, d, ks, init, reg, seed, key)
    fits = fit_all(df, vector, d, starts, reg=reg, key=key, **options)
    return [{"k": k, "bic": f.bic, "aic": f.aic, "loglik": f.loglik, "converged": f.converged, "min_weight": float(f.model.weights.min())} for k, f in zip(ks, fits, strict=True)]


def best_k(sweep: list[dict]) -> int:
    return min(sweep, key=lambda r: r["bic"])["k"]


def repetition(df: DataFrame, vector: str, d: int, k: int, extra: range = range(4), seed: int = 0, **options) -> list[dict]:
    """k + r components, spare ones seeded beside existing means; weights by nearest base mean."""
    base = fit(df, vector, d, k, **options)
    rng = np.random.default_rng(seed)
    starts = []
    for r in extra:
        pick = [i % k for i in range(r)]
        starts.append(
            Mixture(
                np.append(base.model.weights, base.model.weights[pick]) / (1 + base.model.weights[pick].sum()),
                np.vstack([base.model.means, base.model.means[pick] + 0.05 * rng.standard_normal((r, d))]),
                np.concatenate([base.model.covs, base.model.covs[pick]]),
            )
        )
    spare = [i for i, r in enumerate(extra) if r]
    fits = dict(zip(spare, fit_all(df, vector, d, [starts[i] for i in spare], **{n: v for n, v in options.items() if n in ("reg", "max_iter", "tol", "weight", "key")}), strict=True)) if spare else {}
    out = []
    for i, r in enumerate(extra):
        f = fits.get(i, base)
        near = ((f.model.means[:, None] - base.model.means[None]) ** 2).sum(2).argmin(1)
        out.append({"r": r, "weights": np.bincount(near, f.model.weights, k).tolist(), "bic": f.bic})
    return out


def continuity(df: DataFrame, column: str, key: str = "uid", seed: int = 0) -> dict:
    """One or two Gaussians on an axis: discrete if BIC gains over 10, means lie over 2 deviations apart, weights exceed 0.10 (M7)."""
    t = df.select(key, F.array(column).alias("x"))
    one, two = (fit(t, "x", 1, k, init="seed", seed=seed, key=key) for k in (1, 2))
    sd = math.sqrt(float(two.model.covs.mean()))
    gain, sep = one.bic - two.bic, abs(float(two.model.means[0, 0] - two.model.means[1, 0])) / sd
    return {"delta_bic": gain, "separation": sep, "min_weight": float(two.model.weights.min()), "discrete": bool(gain > 10 and sep > 2 and two.model.weights.min() > 0.10)}


def held_out(df: DataFrame, vector: str, d: int, ks: range, seed: int = 0, key: str = "uid", **options) -> list[dict]:
    """Mean log likelihood of the 30 % of rows that were not fitted."""
    train, test = kernel.halves(df, key=key, seed=seed)
    fits = fit_all(train, vector, d, _starts(train, vector, d, ks, "seed", 1e-6, seed, key), key=key, **options)
    scores = em.expectation(em.columns(test, vector, d), {i: (f.model.weights, f.model.means, f.model.covs) for i, f in enumerate(fits)}, d)
    return [{"k": k, "held_out": float(scores[i][1] / scores[i][0])} for i, k in enumerate(ks)]


def back_projected(spark: SparkSession, model: Mixture, n: int, k: int, *, ref: int = -1, mean: np.ndarray | None = None, scale: np.ndarray | None = None, seed: int = 0) -> DataFrame:
    """(id, component, posterior): ``n`` draws from a mixture in log-ratio space, back in probabilities.

    Components are drawn by weight; ``mean`` and ``scale`` undo a standardisation first.  A draw
    depends on its number and the seed only.
    """
    from simplexa.operators.confusion import _noise

    d = model.means.shape[1]
    chol = np.linalg.cholesky(model.covs)
    u = F.xxhash64("id", F.lit(seed), F.lit("component")).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    c = F.lit(0)
    for edge in np.cumsum(model.weights)[:-1]:
        c = c + F.when(u >= float(edge), 1).otherwise(0)
    rows = spark.range(n).withColumn("component", c).withColumns({f"e{a}": e for a, e in enumerate(_noise("component", seed, d))})
    pick = lambda f: F.element_at(F.array(*[F.lit(float(f(i))) for i in range(len(model.weights))]), F.col("component") + 1)
    y = []
    for a in range(d):
        v = pick(lambda i, a=a: model.means[i, a]) + sum(pick(lambda i, a=a, b=b: chol[i, a, b]) * F.col(f"e{b}") for b in range(a + 1))
        y.append(v * float(scale[a]) + float(mean[a]) if scale is not None else v)
    return rows.withColumn("y", F.array(*y)).select("id", "component", "y", sx.inverse_alr(F.col("y"), k, ref).alias("posterior"))


def expected_max_responsibility(separation: float, n: int = 200_000, seed: int = 0) -> float:
    """Mean largest responsibility of two unit Gaussians so far apart."""
    x = np.random.default_rng(seed).standard_normal(n) + separation / 2
    return float(np.mean(1 / (1 + np.exp(-np.abs(separation * x)))))


def overconfident(scored: DataFrame, model: Mixture, gap: float = 0.15) -> dict:
    """Whether rows are surer than the separation of the components allows."""
    from simplexa.operators.confusion import separation

    sep = separation(model.means, model.covs)["min"]
    seen = scored.agg(F.avg(F.array_max("resp")).alias("m")).first().m
    expected = expected_max_responsibility(sep)
    return {"separation": sep, "mean_max": seen, "expected": expected, "flag": bool(seen - expected > gap)}


Fitter = Callable[[DataFrame], Fit]  #: a caller may supply its own (X1)
