"""Mixtures of latent spaces put to use: model selection, axis classes, junk filter, quality."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.functions import simplex as sx
from simplexa.operators import agreement, filters, gmm, joins, quantiles
from simplexa.operators.confusion import separation


def curves(df: DataFrame, vector: str, d: int, ks: Sequence[int], *, rows: int = 8000, n_init: int = 2, seed: int = 0, key: str = "uid", **options) -> list[dict]:
    """BIC and silhouette by number of components; all starts of all numbers share their passes (M5).

    The silhouette is that of a sample of ``rows`` rows; with one component there is none.
    """
    samples = [gmm.sample(df, vector, seed + i, key) for i in range(n_init)]
    starts = [(k, gmm.seeded(x, d, k, seed + i, 1e-6)) for k in ks for i, x in enumerate(samples)]
    fits = gmm.fit_all(df, vector, d, [m for _, m in starts], key=key, **options)
    best = {k: max((f for (j, _), f in zip(starts, fits, strict=True) if j == k), key=lambda f: f.loglik) for k in ks}
    out = []
    for k, f in best.items():
        s = agreement.silhouette(gmm.predict(df, f.model, vector).select(key, vector, "label"), vector, "label", rows, seed, key).first().silhouette if k > 1 else None
        out.append({"k": k, "bic": f.bic, "aic": f.aic, "silhouette": s, "converged": f.converged})
    return out


def aligned(scored: DataFrame, reference: str, k: int) -> DataFrame:
    """``label`` and ``resp`` of a mixture under the numbers of a reference labelling that they agree with best.

    ``resp`` is in the order of the new numbers; with more classes than components some numbers are not used.
    """
    cells = agreement.contingency(scored, reference, "label").collect()  # classes x components
    counts = np.zeros((1 + max((r.i for r in cells), default=0), k))
    for r in cells:
        counts[r.i, r.j] = r.n
    new = [int(v) for v in joins.align(counts)]
    order = [new.index(c) for c in sorted(new)]  # components by their new numbers
    return joins.relabel(scored, "label", new).withColumn("resp", F.array(*[F.get("resp", F.lit(i)) for i in order]))


def axis_mixture(df: DataFrame, axis: str, k: int, *, label: str = "hard", confident: float = 0.5, n_init: int = 10, seed: int = 0, key: str = "uid") -> DataFrame:
    """Adds label, resp, conf and confident: a mixture of an axis with its components named as the classes they match (M8)."""
    t = df.withColumn("_a", F.array(F.col(axis)))
    fit = gmm.fit(t, "_a", 1, k, init="seed", n_init=n_init, max_iter=1000, tol=1e-6, seed=seed, key=key)
    out = aligned(gmm.predict(t, fit.model, "_a"), label, k).withColumn("conf", F.array_max("resp"))
    return out.withColumn("confident", F.col("conf") >= confident).drop("_a", "loglik")


def junk_filter(df: DataFrame, vector: str, d: int, *, n: int = 5, n_init: int = 3, seed: int = 0, key: str = "uid") -> DataFrame:
    """Adds label and junk: rows of the component of ``n`` with the largest mean norm (M9)."""
    fit = gmm.fit(df, vector, d, n, init="seed", n_init=n_init, seed=seed, key=key)
    scored = gmm.predict(df, fit.model, vector)
    junk = filters.junk_component(scored, "label", vector).first().junk
    return scored.withColumn("junk", F.col("label") == F.lit(junk)).drop("resp", "loglik")


def quality(df: DataFrame, fit: gmm.Fit, vector: str, *, rows: int = 10_000, seed: int = 0, key: str = "uid") -> dict:
    """How sure a mixture is of its rows and how far its components lie apart."""
    t = gmm.predict(df, fit.model, vector).select(key, vector, "label", F.array_max("resp").alias("m"), sx.entropy(F.col("resp")).alias("h"))
    one = t.agg(F.count("*").alias("n"), F.avg("m").alias("mean_max"), F.avg((F.col("m") > 0.8).cast("double")).alias("share_08"), F.avg((F.col("m") > 0.9).cast("double")).alias("share_09"), F.avg("h").alias("mean_entropy")).first()
    apart = separation(fit.model.means, fit.model.covs)
    return {
        **one.asDict(),
        "dim": int(fit.model.means.shape[1]),
        "converged": fit.converged,
        "median_max": quantiles.quantiles(t, "m", [0.5])[0],
        "uniform_entropy": math.log(len(fit.model.weights)),
        "silhouette": agreement.silhouette(t, vector, "label", rows, seed, key).first().silhouette,
        "min_separation": apart["min"],
        "mean_separation": apart["mean"],
        "weights": np.round(fit.model.weights, 4).tolist(),
    }
