"""Class populations and their correction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.functions import simplex as sx


def _classes(df: DataFrame, k: int) -> DataFrame:
    return df.sparkSession.range(k).select(F.col("id").cast("int").alias("class"))


def observed(df: DataFrame, k: int, hard: str = "hard") -> DataFrame:
    """Share of rows of each class, zero classes kept (A1)."""
    n = df.groupBy(F.col(hard).alias("class")).agg(F.count("*").alias("n"))
    dense = _classes(df, k).join(n, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))
    total = dense.agg(F.sum("n").alias("total"))
    return dense.crossJoin(total).select("class", "n", (F.col("n") / F.greatest("total", F.lit(1))).alias("fraction"))


def soft(df: DataFrame, k: int, posterior: str = "posterior") -> DataFrame:
    """Mean of each posterior component (A2)."""
    means = df.agg(*[F.avg(F.get(posterior, F.lit(i))).alias(f"m{i}") for i in range(k)])
    return means.select(F.posexplode(F.array(*[f"m{i}" for i in range(k)])).alias("class", "fraction"))


def occupancy(df: DataFrame, k: int, dummies: int) -> DataFrame:
    """Rows of every class, decoys included, with kind and label."""
    h = df.select(sx.argmax(F.col("posterior")).alias("hard"))
    kind = F.when(F.col("class") < dummies, "dummy").otherwise("protein")
    return observed(h, k).select(F.col("class").alias("class_index"), sx.class_label(F.col("class")).alias("label"), kind.alias("kind"), F.col("n").alias("hard_count"), F.col("fraction").alias("hard_fraction"))


def effective_n(df: DataFrame, k: int, betas: Sequence[float], posterior: str = "posterior") -> DataFrame:
    """Sum over rows of p^beta / sum p^beta, by class and beta, in one pass."""
    sums = [F.sum(F.get(sx.sharpen_sum_clip(F.col(posterior), F.lit(float(b))), F.lit(i))).alias(f"s{j}_{i}") for j, b in enumerate(betas) for i in range(k)]
    cells = F.array(*[F.struct(F.lit(float(b)).alias("beta"), F.lit(i).alias("class"), F.col(f"s{j}_{i}").alias("effective_n")) for j, b in enumerate(betas) for i in range(k)])
    return df.agg(*sums).select(F.explode(cells).alias("c")).select("c.*")


def sanitise(c: np.ndarray) -> np.ndarray:
    """Rows that are not finite or have no positive sum become rows of the identity; others sum to 1 (L1)."""
    c = np.array(c, float)
    for i in range(len(c)):
        s = c[i].sum()
        c[i] = c[i] / s if np.isfinite(c[i]).all() and s > 0 else np.eye(len(c))[i]
    return c


def project_to_simplex(v: np.ndarray) -> np.ndarray:
    """Nearest point of the probability simplex; uniform for input without support (L3)."""
    v = np.asarray(v, float)
    u = np.sort(v)[::-1]
    css = np.cumsum(u) - 1
    ok = np.flatnonzero(u - css / np.arange(1, len(v) + 1) > 0)
    if not len(ok) or not np.isfinite(v).all():
        return np.full(len(v), 1 / len(v))
    return np.maximum(v - css[ok[-1]] / (ok[-1] + 1), 0)


def deconvolve(pi: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Populations x with C'x = pi, on the simplex (L2)."""
    return project_to_simplex(np.linalg.lstsq(c.T, pi, rcond=None)[0])


def corrected(df: DataFrame, k: int) -> DataFrame:
    """Observed, soft and confusion-corrected populations of every class, from one aggregation by hard class."""
    by = df.groupBy("hard").agg(F.count("*").alias("n"), *[F.sum(F.get("posterior", F.lit(i))).alias(f"s{i}") for i in range(k)])
    n, mass = np.zeros(k), np.zeros((k, k))  # mass[i, j]: of component i in the rows of hard class j
    for r in by.collect():  # a row a class
        n[r.hard] = r.n
        mass[:, r.hard] = [r[f"s{i}"] for i in range(k)]
    rows = max(n.sum(), 1.0)
    confusion = mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-12)
    x = deconvolve(n / rows, sanitise(confusion))
    out = [(i, float(n[i] / rows), float(mass[i].sum() / rows), float(x[i])) for i in range(k)]
    return df.sparkSession.createDataFrame(out, "class int, observed_hard double, observed_soft double, corrected_soft double")


def simplex_projection(df: DataFrame, group: str, index: str, value: str) -> DataFrame:
    """The projection as a running sum over descending values, for many vectors at once."""
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    down = w.orderBy(F.col(value).desc(), index)
    ranked = df.withColumn("css", F.sum(value).over(down.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("r", F.row_number().over(down))
    theta = F.max_by(F.when(F.col(value) - F.col("css") / F.col("r") > 0, F.col("css") / F.col("r")), F.when(F.col(value) - F.col("css") / F.col("r") > 0, F.col("r"))).over(w)
    return ranked.withColumn("projected", F.greatest(F.col(value) - theta, F.lit(0.0))).drop("css", "r")
