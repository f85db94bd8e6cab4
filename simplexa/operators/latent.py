"""Latent vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simplexa.functions import simplex as sx
from simplexa.operators import agreement, ordered
from simplexa.session import Written, ship


def mean_cov(df: DataFrame, vector: str, d: int, ddof: int = 1) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance, from one aggregation."""
    v = [F.get(vector, F.lit(i)) for i in range(d)]
    f = F.covar_samp if ddof else F.covar_pop
    r = df.agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(v)], *[f(v[i], v[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float)
    return r.n, np.array([r[f"m{i}"] for i in range(d)]), cov


def standardise(df: DataFrame, vector: str, d: int, name: str = "x") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(x - mean) / population deviation (M11); also the mean and scale."""
    _, mean, cov = mean_cov(df, vector, d, ddof=0)
    scale = np.sqrt(np.diag(cov))
    scale[scale == 0] = 1.0
    x = F.array(*[(F.get(vector, F.lit(i)) - float(mean[i])) / float(scale[i]) for i in range(d)])
    return df.withColumn(name, x), mean, scale


def unscale(points: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Back to latent units."""
    return points * scale + mean


def project(df: DataFrame, vector: str, axes: np.ndarray, mean: np.ndarray, prefix: str = "pc") -> DataFrame:
    """Coordinates along rows of ``axes``, as columns prefix1, prefix2, ..."""
    cols = {f"{prefix}{a + 1}": sum((F.get(vector, F.lit(i)) - float(mean[i])) * float(w) for i, w in enumerate(axis)) for a, axis in enumerate(axes)}
    return df.withColumns(cols)


def pca(df: DataFrame, vector: str, d: int, n: int = 2) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Scores, axes, explained shares and mean; each axis points to its largest loading."""
    _, mean, cov = mean_cov(df, vector, d)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    axes = vectors[:, order[:n]].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return project(df, vector, axes, mean), axes, values[order[:n]] / values.sum(), mean


def oriented_pca(df: DataFrame, vector: str, d: int, label: str = "hard") -> DataFrame:
    """pc1, pc2 with pc1 rising along the class number."""
    scored = pca(df, vector, d, 2)[0]
    return scored if ordered.orientation(scored, "pc1", label).first().sign > 0 else scored.withColumn("pc1", -F.col("pc1"))


def project_gaussian(mean: np.ndarray, cov: np.ndarray, axes: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A Gaussian seen along some axes."""
    return axes @ (mean - centre), axes @ cov @ axes.T


def ellipse(cov: np.ndarray, sds: float = 1.0) -> tuple[float, float, float]:
    """Full axes and angle in degrees of a covariance ellipse."""
    values, vectors = np.linalg.eigh(cov)
    major = vectors[:, -1]
    return 2 * sds * float(np.sqrt(values[-1])), 2 * sds * float(np.sqrt(max(values[0], 0))), float(np.degrees(np.arctan2(major[1], major[0])))


def canonical_correlations(df: DataFrame, x: str, dx: int, y: str, dy: int, ridge: float = 1e-4) -> np.ndarray:
    """Singular values of the whitened cross covariance; with a ridge (L10) or, at 0, by pseudo-inverse."""
    both = df.withColumn("_b", F.concat(x, y))
    _, _, c = mean_cov(both, "_b", dx + dy)
    cx, cy, cxy = c[:dx, :dx], c[dx:, dx:], c[:dx, dx:]

    def root(m: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(m + ridge * np.eye(len(m)))
        keep = values > 1e-10 * values.max()
        return vectors[:, keep] / np.sqrt(values[keep])

    return np.clip(np.linalg.svd(root(cx).T @ cxy @ root(cy), compute_uv=False), 0, 1)[: min(dx, dy)]


def triangle(df: DataFrame, vector: str, d: int, mean: np.ndarray, fan: int = 32) -> np.ndarray:
    """R of a QR factorisation of the centred rows: one small triangle a task, merged as a tree."""

    def fold(r: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.concatenate((r, x)), mode="r")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, rows = np.zeros((0, d)), 0
        for b in batches:
            if b.num_rows:
                r, rows = fold(r, np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(d)]) - mean), rows + b.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r.tolist()], pa.list_(pa.list_(pa.float64())))], ["r"])

    def merge(t: pa.Table) -> pa.Table:
        r = np.zeros((0, d))
        for m in t.column("r").to_pylist():
            r = fold(r, np.array(m))
        return pa.table([pa.array([r.tolist()], pa.list_(pa.list_(pa.float64())))], ["r"])

    ship(df.sparkSession)
    written = Written(df.sparkSession, "qr")
    rows = df.where(F.col(vector).isNotNull()).select(*[F.get(vector, F.lit(i)).cast("double").alias(f"x{i}") for i in range(d)])
    level = written(rows.mapInArrow(task, "r array<array<double>>").withColumn("n", F.monotonically_increasing_id()))
    while (count := level.count()) > 1:
        place = F.row_number().over(Window.orderBy("n")) - 1  # a row a task
        merged = level.withColumn("g", F.floor(place / fan)).groupBy("g").applyInArrow(merge, "r array<array<double>>")
        level = written(merged.withColumn("n", F.monotonically_increasing_id()))
        if count <= fan:
            break
    found = level.select("r").first()
    written.drop()
    out = np.zeros((d, d))
    if found:
        r = np.array(found.r)
        out[: len(r)] = r
    return out


def canonical_correlations_qr(df: DataFrame, x: str, dx: int, y: str, dy: int) -> np.ndarray:
    """Canonical correlations from orthonormal bases of the centred columns, which squares no singular value."""
    both = df.withColumn("_b", F.concat(x, y))
    r = triangle(both, "_b", dx + dy, mean_cov(both, "_b", dx + dy)[1])
    qx, qy = np.linalg.qr(r[:, :dx])[0], np.linalg.qr(r[:, dx:])[0]
    return np.clip(np.linalg.svd(qx.T @ qy, compute_uv=False), 0, 1)


def lda(df: DataFrame, vector: str, d: int, label: str = "hard", ridge: float = 1e-9) -> tuple[np.ndarray, np.ndarray, dict]:
    """Discriminant axes, overall mean and class statistics, from per-class moments."""
    from simplexa.operators.confusion import moments_local

    stats = moments_local(df, label, vector, d)
    n = sum(s[0] for s in stats.values())
    mean = sum(s[0] * s[1] for s in stats.values()) / n
    within = sum((s[0] - 1) * np.nan_to_num(s[2]) for s in stats.values()) / max(n - len(stats), 1) + ridge * np.eye(d)
    between = sum(s[0] * np.outer(s[1] - mean, s[1] - mean) for s in stats.values()) / n
    values, vectors = np.linalg.eigh(within)
    white = vectors / np.sqrt(np.maximum(values, 1e-12))
    bv, bw = np.linalg.eigh(white.T @ between @ white)
    axes = (white @ bw[:, np.argsort(bv)[::-1]]).T[: max(1, min(d, len(stats) - 1))]
    return axes, mean, {"stats": stats, "within": within, "n": n}


def lda_predict(df: DataFrame, vector: str, fitted: dict, name: str = "pred") -> DataFrame:
    """The most probable class under equal covariances."""
    inv = np.linalg.inv(fitted["within"])
    d = len(inv)
    labels = sorted(fitted["stats"])
    scores = []
    for c in labels:
        n, mu, _ = fitted["stats"][c]
        w = inv @ mu
        scores.append(sum(F.get(vector, F.lit(i)) * float(w[i]) for i in range(d)) + float(-0.5 * mu @ w + np.log(n / fitted["n"])))
    return df.withColumn(name, F.element_at(F.array(*[F.lit(int(c)) for c in labels]), sx.argmax(F.array(*scores)) + 1))


def separability(df: DataFrame, vector: str, d: int, label: str = "hard", k: int = 5, seed: int = 0, key: str = "uid") -> DataFrame:
    """Cross-validated recall of each class and balanced accuracy."""
    t = ordered.folds(df, k, seed, key, label)
    parts = [lda_predict(t.where(F.col("fold") == i), vector, lda(t.where(F.col("fold") != i), vector, d, label)[2]) for i in range(k)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return agreement.recall_by_class(whole, label, "pred")


def best_axis(scored: DataFrame, a: int, b: int, axes: list[str], label: str = "hard") -> str:
    """The axis with the largest Fisher ratio between two classes."""
    t = scored.where(F.col(label).isin(a, b)).groupBy(label).agg(*[x for c in axes for x in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))])
    r = {x[label]: x for x in t.collect()}  # two rows
    return max(axes, key=lambda c: (r[a][f"m_{c}"] - r[b][f"m_{c}"]) ** 2 / max(r[a][f"v_{c}"] + r[b][f"v_{c}"], 1e-12))


def r_squared(df: DataFrame, y: str, xs: list[str]) -> float:
    """Share of variance that a linear model explains, from covariances."""
    t = df.withColumn("_v", F.array(*[F.col(c).cast("double") for c in [*xs, y]]))
    _, _, c = mean_cov(t, "_v", len(xs) + 1)
    cxx, cxy = c[:-1, :-1], c[:-1, -1]
    return float(cxy @ np.linalg.lstsq(cxx, cxy, rcond=None)[0] / c[-1, -1])


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Cluster numbers and centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    t = df.withColumn("_f", array_to_vector(vector))
    m = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cluster").fit(t)
    return m.transform(t).drop("_f"), np.array(m.clusterCenters())


def centroid_axis(df: DataFrame, vector: str, d: int, a: int, b: int, label: str = "hard", name: str = "t") -> DataFrame:
    """Projection on the line between two class means: 0 at a, 1 at b."""
    r = {x[label]: np.array([x[f"m{i}"] for i in range(d)]) for x in df.where(F.col(label).isin(a, b)).groupBy(label).agg(*[F.avg(F.get(vector, F.lit(i))).alias(f"m{i}") for i in range(d)]).collect()}
    u = r[b] - r[a]
    w = u / max(float(u @ u), 1e-12)
    return df.withColumn(name, sum((F.get(vector, F.lit(i)) - float(r[a][i])) * float(w[i]) for i in range(d)))
