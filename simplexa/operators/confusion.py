"""Confusion, overlap and contingency matrices in long form i, j, value."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simplexa.functions import simplex as sx


def _grid(spark: SparkSession, k: int, m: int | None = None) -> DataFrame:
    a = spark.range(k).select(F.col("id").cast("int").alias("i"))
    return a.crossJoin(spark.range(m or k).select(F.col("id").cast("int").alias("j")))  # k * m cells


def soft_posterior_confusion(df: DataFrame, k: int, hard: str = "hard", posterior: str = "posterior") -> DataFrame:
    """C[i, j] = sum of p_i over rows assigned to j / sum of p_i (A3); one pass, k sums a class."""
    by = df.groupBy(F.col(hard).alias("j")).agg(*[F.sum(F.get(posterior, F.lit(i))).alias(f"s{i}") for i in range(k)])
    cells = by.select("j", F.posexplode(F.array(*[f"s{i}" for i in range(k)])).alias("i", "s"))
    dense = _grid(df.sparkSession, k).join(cells, ["i", "j"], "left").select("i", "j", F.coalesce("s", F.lit(0.0)).alias("s"))
    w = Window.partitionBy("i")
    return dense.select("i", "j", (F.col("s") / F.greatest(F.sum("s").over(w), F.lit(1e-12))).alias("value"))


def hard_confusion(df: DataFrame, a: str, b: str, k: int, m: int | None = None) -> DataFrame:
    """Row-normalised crosstab of two labels; an empty row stays 0 (A4, A5)."""
    n = df.groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count("*").alias("n"))
    dense = _grid(df.sparkSession, k, m).join(n, ["i", "j"], "left").select("i", "j", F.coalesce("n", F.lit(0)).alias("n"))
    return dense.select("i", "j", "n", (F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("i")), F.lit(1))).alias("value"))


def soft_crosstab(df: DataFrame, p: str, r: str, k: int, m: int) -> DataFrame:
    """T = P'R (A6)."""
    sums = [F.sum(F.get(p, F.lit(i)) * F.get(r, F.lit(j))).alias(f"t{i}_{j}") for i in range(k) for j in range(m)]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"t{i}_{j}").alias("value")) for i in range(k) for j in range(m)])
    return df.agg(*sums).select(F.explode(cells).alias("c")).select("c.*")


def soft_occupancy(df: DataFrame, basin: str, posterior: str, k: int, basins: int) -> DataFrame:
    """Share of each class's posterior mass in each basin."""
    by = df.groupBy(F.col(basin).alias("j")).agg(*[F.sum(F.get(posterior, F.lit(i))).alias(f"s{i}") for i in range(k)])
    cells = by.select("j", F.posexplode(F.array(*[f"s{i}" for i in range(k)])).alias("i", "s"))
    dense = _grid(df.sparkSession, k, basins).join(cells, ["i", "j"], "left").select("i", "j", F.coalesce("s", F.lit(0.0)).alias("s"))
    return dense.select("i", "j", (F.col("s") / F.greatest(F.sum("s").over(Window.partitionBy("i")), F.lit(1e-12))).alias("value"))


def mean_posterior_by_class(df: DataFrame, k: int) -> DataFrame:
    """Mean of each component over the rows of each hard class."""
    by = df.groupBy(F.col("hard").alias("i")).agg(*[F.avg(F.get("posterior", F.lit(j))).alias(f"m{j}") for j in range(k)])
    return by.select("i", F.posexplode(F.array(*[f"m{j}" for j in range(k)])).alias("j", "value"))


def moments(df: DataFrame, group: str, vector: str, d: int) -> DataFrame:
    """Count, mean vector and sample covariance (upper triangle) of each group."""
    v = [F.get(vector, F.lit(i)) for i in range(d)]
    aggs = [F.count("*").alias("n"), *[F.avg(v[i]).alias(f"m{i}") for i in range(d)]]
    aggs += [F.covar_samp(v[i], v[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    return df.groupBy(group).agg(*aggs)


def moments_local(df: DataFrame, group: str, vector: str, d: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """The moments of a bounded number of classes, on the driver."""
    out = {}
    for r in moments(df, group, vector, d).collect():
        cov = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                x = r[f"c{i}_{j}"]
                cov[i, j] = cov[j, i] = np.nan if x is None else x
        out[r[group]] = (r.n, np.array([r[f"m{i}"] for i in range(d)]), cov)
    return out


def analytical_pairwise(stats: dict[int, tuple[int, np.ndarray, np.ndarray]], k: int, minimum: int = 10) -> np.ndarray:
    """Error rates of each pair of classes along p_i - p_j, composed to a matrix."""
    out = np.full((k, k), np.nan)
    for i in range(k):
        n, mean, cov = stats.get(i, (0, np.zeros(k), np.zeros((k, k))))
        if n < minimum:
            continue
        err = np.zeros(k)
        for j in range(k):
            if j != i:
                a = np.zeros(k)
                a[i], a[j] = 1 / math.sqrt(2), -1 / math.sqrt(2)
                var = a @ cov @ a
                err[j] = 0.5 - 0.5 * math.erf(a @ mean / math.sqrt(2 * var)) if var > 0 else 0.0
        stay = np.prod(1 - np.delete(err, i))
        out[i] = err / err.sum() * (1 - stay) if err.sum() > 0 else 0.0
        out[i, i] = stay
    return out


def bhattacharyya(m1, s1, m2, s2) -> float:
    """Distance of two Gaussians by log determinants."""
    s = (s1 + s2) / 2
    d = m1 - m2
    ld = lambda x: np.linalg.slogdet(x)[1]
    return float(d @ np.linalg.solve(s, d) / 8 + 0.5 * (ld(s) - 0.5 * (ld(s1) + ld(s2))))


def bhattacharyya_pinv(m1, s1, m2, s2, floor: float = 1e-300) -> float:
    """The same for near-singular covariances: pseudo-inverse and clipped determinants."""
    s = (s1 + s2) / 2
    d = m1 - m2
    det = lambda x: max(np.linalg.det(x), floor)
    return float(d @ np.linalg.pinv(s) @ d / 8 + 0.5 * np.log(det(s) / np.sqrt(det(s1) * det(s2))))


def pairwise(means: np.ndarray, covs: np.ndarray, distance=bhattacharyya) -> np.ndarray:
    k = len(means)
    return np.array([[0.0 if i == j else distance(means[i], covs[i], means[j], covs[j]) for j in range(k)] for i in range(k)])


def overlap(distances: np.ndarray) -> np.ndarray:
    """exp(-D) with a zero diagonal."""
    o = np.exp(-distances)
    np.fill_diagonal(o, 0)
    return o


def separation(means: np.ndarray, covs: np.ndarray) -> dict[str, float]:
    """Centre distances in units of the mean spread: smallest and mean."""
    k, d = means.shape
    s = [np.linalg.norm(means[a] - means[b]) / math.sqrt(0.5 * (np.trace(covs[a]) + np.trace(covs[b])) / d) for a in range(k) for b in range(a + 1, k)]
    return {"min": float(min(s)), "mean": float(np.mean(s))}


def _noise(component: str, seed: int, d: int):
    """Standard normal draws as a function of (component, sample, seed): independent of partitioning."""
    unit = lambda salt: (F.xxhash64(F.col(component), F.col("id"), F.lit(seed), F.lit(salt)).bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / float(1 << 53)
    return [F.sqrt(-2 * F.ln(unit(2 * i))) * F.cos(2 * math.pi * unit(2 * i + 1)) for i in range(d)]


def _root(cov: np.ndarray) -> np.ndarray:
    """A matrix whose square is ``cov``: Cholesky's, or of a singular one that of its eigenvectors."""
    try:
        return np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(cov)
        return vectors * np.sqrt(np.maximum(values, 0))


def sampled_confusion(spark: SparkSession, weights: np.ndarray, means: np.ndarray, covs: np.ndarray, n: int = 50_000, seed: int = 0, use_weights: bool = True) -> DataFrame:
    """Sample every component, classify by posterior (R1) or, without weights, by likelihood (R2)."""
    k, d = means.shape
    chol = np.array([_root(c) for c in covs])
    base = spark.range(k).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(n)).select("i", "id", *[e.alias(f"e{a}") for a, e in enumerate(_noise("i", seed, d))])
    pick = lambda f: F.element_at(F.array(*[F.lit(float(f(c))) for c in range(k)]), F.col("i") + 1)
    x = [pick(lambda c, a=a: means[c, a]) + sum(pick(lambda c, a=a, b=b: chol[c, a, b]) * F.col(f"e{b}") for b in range(d) if chol[:, a, b].any()) for a in range(d)]
    pts = base.select("i", *[v.alias(f"x{a}") for a, v in enumerate(x)])
    dens = F.array(*[log_density([F.col(f"x{a}") for a in range(d)], means[c], covs[c]) + F.lit(math.log(weights[c]) if use_weights else 0.0) for c in range(k)])
    return hard_confusion(pts.select("i", sx.argmax(dens).alias("pred")), "i", "pred", k).select("i", "j", "value")


def log_density(x: list, mean: np.ndarray, cov: np.ndarray):
    """Gaussian log density as a column expression; of a singular covariance the distance alone, by pseudo-inverse."""
    d = len(mean)
    try:
        np.linalg.cholesky(cov)
        inv, constant = np.linalg.inv(cov), -0.5 * (d * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1])
    except np.linalg.LinAlgError:
        inv, constant = np.linalg.pinv(cov), 0.0
    diff = [x[a] - F.lit(float(mean[a])) for a in range(d)]
    quad = F.lit(0.0)
    for a in range(d):
        for b in range(a, d):
            quad = quad + F.lit(float(inv[a, b] * (1 if a == b else 2))) * diff[a] * diff[b]
    return F.lit(float(constant)) - quad * 0.5


def monte_carlo_confusion(spark: SparkSession, model, n: int = 50_000, seed: int = 0) -> DataFrame:
    """Confusion of a fitted mixture by draws from each component, classified by posterior."""
    return sampled_confusion(spark, model.weights, model.means, model.covs, n, use_weights=True, seed=seed)


def equal_prior_confusion(spark: SparkSession, model, n: int = 50_000, seed: int = 0) -> DataFrame:
    """The same, classified by likelihood (R2)."""
    return sampled_confusion(spark, model.weights, model.means, model.covs, n, use_weights=False, seed=seed)


def analytical_multiclass(spark: SparkSession, stats: dict[int, tuple[int, np.ndarray, np.ndarray]], k: int, n: int = 50_000, minimum: int = 10, reg: float = 1e-6, seed: int = 0) -> DataFrame:
    """Each class as one Gaussian in posterior space, samples classified by their largest component; NaN rows for small classes."""
    ok = [c for c in range(k) if stats.get(c, (0,))[0] >= minimum]
    chol = {}
    for c in ok:
        for extra in (reg, 1e-3):
            try:
                chol[c] = np.linalg.cholesky(stats[c][2] + extra * np.eye(k))
                break
            except np.linalg.LinAlgError:
                continue
    ok = [c for c in ok if c in chol]
    base = spark.range(k).select(F.col("id").cast("int").alias("i")).where(F.col("i").isin(ok)).crossJoin(spark.range(n)).select("i", "id", *[e.alias(f"e{a}") for a, e in enumerate(_noise("i", seed, k))])
    pick = lambda f: F.element_at(F.array(*[F.lit(float(f(c)) if c in chol else 0.0) for c in range(k)]), F.col("i") + 1)
    x = F.array(*[pick(lambda c, a=a: stats[c][1][a]) + sum(pick(lambda c, a=a, b=b: chol[c][a, b]) * F.col(f"e{b}") for b in range(a + 1)) for a in range(k)])
    conf = hard_confusion(base.select("i", sx.argmax(x).alias("pred")), "i", "pred", k)
    return conf.select("i", "j", F.when(F.col("i").isin(ok), F.col("value")).otherwise(float("nan")).alias("value"))
