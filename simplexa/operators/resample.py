"""Bootstrap by Poisson weights.

Every row gets a weight for each replicate as a function of (row, replicate, seed).  All
replicates are summed in one pass over the rows (see ``em``), without copies of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexa.operators import confusion, em, gmm, joins, populations


def poisson(rep: int | Column, seed: int = 0, key: str = "uid") -> Column:
    """A Poisson(1) draw as a column, by inversion of a hash; for fitters that read a weight column."""
    rep = F.lit(rep) if isinstance(rep, int) else rep
    u = F.xxhash64(F.col(key), rep, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    out = F.lit(0)
    for cum in em.CUMULATIVE[:-1]:
        out = out + F.when(u >= float(cum), 1).otherwise(0)
    return out


def replicate_populations(df: DataFrame, k: int, reps: int = 200, correct: bool = True, key: str = "uid", seed: int = 0) -> np.ndarray:
    """(reps, 3, k): hard, soft and confusion-corrected populations of each replicate."""
    sums = em.replicate_moments(df, "posterior", k, k, reps, key=key, seed=seed)
    n, s = sums[:, :, 0], sums[:, :, 1:].transpose(0, 2, 1)  # s[rep, component, class]
    out = np.zeros((reps, 3, k))
    for b in range(reps):
        out[b, 0] = n[b] / max(n[b].sum(), 1)
        out[b, 1] = s[b].sum(1) / max(s[b].sum(), 1e-12)
        out[b, 2] = populations.deconvolve(out[b, 0], populations.sanitise(s[b] / np.maximum(s[b].sum(1, keepdims=True), 1e-12))) if correct else out[b, 1]
    return out


def summary(samples: np.ndarray, ci: float = 0.95) -> dict[str, np.ndarray]:
    """Mean, deviation and percentile interval over the first axis."""
    a = (1 - ci) / 2 * 100
    return {"mean": samples.mean(0), "std": samples.std(0), "lo": np.percentile(samples, a, axis=0), "hi": np.percentile(samples, 100 - a, axis=0)}


def population_ci(df: DataFrame, k: int, reps: int = 200, ci: float = 0.95) -> DataFrame:
    """kind, class, mean, std, lo, hi."""
    s = summary(replicate_populations(df, k, reps), ci)
    rows = [(kind, c, *(float(s[x][i, c]) for x in ("mean", "std", "lo", "hi"))) for i, kind in enumerate(("hard", "soft", "corrected")) for c in range(k)]
    return df.sparkSession.createDataFrame(rows, "kind string, class int, mean double, std double, lo double, hi double")


def refit(df: DataFrame, vector: str, d: int, base: gmm.Mixture, reps: int = 30, fitter: gmm.Fitter | None = None, **options) -> dict[str, np.ndarray]:
    """Parameters of mixtures fitted to resampled rows, components aligned with the base by distance.

    All replicates start at the base and share their passes; a caller's own ``fitter`` gets the
    rows of one replicate at a time, with their weights in a column ``w``.
    """
    if fitter:
        fits = [fitter(df.withColumn("w", poisson(b).cast("double")).where("w > 0")) for b in range(reps)]
    else:
        fits = gmm.fit_all(df, vector, d, [base] * reps, reps=True, **options)
    w, m, c = [], [], []
    for f in fits:
        order = joins.hungarian(np.sqrt(((base.means[:, None] - f.model.means[None]) ** 2).sum(2)))
        w.append(f.model.weights[order])
        m.append(f.model.means[order])
        c.append(f.model.covs[order])
    return {"weights": np.array(w), "means": np.array(m), "covs": np.array(c), "n_iter": np.array([f.n_iter for f in fits])}


def class_moments_bootstrap(df: DataFrame, k: int, reps: int = 20, key: str = "uid", seed: int = 0) -> np.ndarray:
    """(reps, k, k): the analytic pairwise confusion of each replicate."""
    sums = em.replicate_moments(df, "posterior", k, k, reps, key=key, seed=seed, second=True)
    out = []
    for rep in sums:
        stats = {}
        for c, row in enumerate(rep):
            n = row[0]
            if n >= 2:
                mean = row[1 : 1 + k] / n
                stats[c] = (n, mean, (row[1 + k :].reshape(k, k) - n * np.outer(mean, mean)) / (n - 1))
        out.append(confusion.analytical_pairwise(stats, k))
    return np.array(out)
