"""Three-dimensional grids in long form (map, z, y, x, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.operators.quantiles import quantiles
from simplexa.session import ship

AXES = ["x", "y", "z"]


def shared_mask(maps: DataFrame, q: float = 0.9) -> DataFrame:
    """Voxels whose mean over all maps exceeds its q-th quantile (V1)."""
    mean = maps.groupBy(*AXES).agg(F.avg("v").alias("m"))
    return mean.where(F.col("m") > F.lit(quantiles(mean, "m", [q])[0]).cast("double")).select(*AXES)


def correlation(pair: DataFrame, a: str = "va", b: str = "vb", undefined: float = 0.0) -> DataFrame:
    """Pearson correlation of two columns; ``undefined`` where one is constant (V2)."""
    return pair.agg(F.corr(a, b).alias("c")).select(F.when(F.col("c").isNull() | F.isnan("c"), undefined).otherwise(F.col("c")).alias("cc"))


def correlation_matrix(maps: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Correlation of every two maps."""
    m = maps.join(mask, AXES, "left_semi") if mask is not None else maps
    a, b = m.select(*AXES, F.col("map").alias("a"), F.col("v").alias("va")), m.select(*AXES, F.col("map").alias("b"), F.col("v").alias("vb"))
    return a.join(b, AXES).where("a < b").groupBy("a", "b").agg(F.corr("va", "vb").alias("cc"))


def difference(pair: DataFrame, mask: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Difference of two maps and its root mean square inside a mask (V4)."""
    d = pair.withColumn("d", F.col("va") - F.col("vb"))
    inside = d.join(mask, AXES, "left_semi") if mask is not None else d
    return d, inside.agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"))


def localisation(diff: DataFrame, share: float = 0.05) -> DataFrame:
    """Share of the squared difference held by the top voxels (V6, W13); ties at the cut count fully."""
    s = diff.select((F.col("d") * F.col("d")).alias("s"))
    cut = F.lit(quantiles(s, "s", [1 - share])[0]).cast("double")
    return s.agg((F.sum(F.when(F.col("s") >= cut, F.col("s")).otherwise(0.0)) / F.sum("s")).alias("top_share"))


def core_density(maps: DataFrame, core: DataFrame) -> DataFrame:
    """Each map over its mean in the core: integrated density and voxels above half the core (V5)."""
    level = maps.join(core, AXES, "left_semi").groupBy("map").agg(F.avg("v").alias("level"))
    n = maps.join(level, "map").withColumn("u", F.col("v") / F.col("level"))
    return n.groupBy("map").agg(F.sum("u").alias("integrated"), F.sum((F.col("u") > 0.5).cast("long")).alias("volume"))


def zscore(maps: DataFrame, mask: DataFrame) -> DataFrame:
    """(v - mean) / deviation, both inside a mask (V8)."""
    s = maps.join(mask, AXES, "left_semi").groupBy("map").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return maps.join(s, "map").withColumn("v", (F.col("v") - F.col("m")) / F.greatest("s", F.lit(1e-12))).drop("m", "s")


def best_flip(pair: DataFrame, n: int) -> DataFrame:
    """Largest correlation over the eight axis flips of the second map."""
    b = pair.select(*AXES, "vb")
    flips = F.array(*[F.struct(*[F.lit(bool(f >> i & 1)).alias(c) for i, c in enumerate(AXES)]) for f in range(8)])
    moved = b.withColumn("f", F.explode(flips)).select("f", *[F.when(F.col(f"f.{c}"), n - 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in AXES], "vb")
    per = pair.select(*AXES, "va").join(moved, AXES).groupBy("f").agg(F.corr("va", "vb").alias("cc"))
    return per.agg(F.max("cc").alias("cc"), F.max_by("f", "cc").alias("flip"))


def reproducibility(halves: DataFrame, mask: DataFrame) -> DataFrame:
    """Correlation of two half maps after z-scoring."""
    z = zscore(halves, mask).join(mask, AXES, "left_semi")
    return z.groupBy(*AXES).agg(F.max(F.when(F.col("map") == "a", F.col("v"))).alias("va"), F.max(F.when(F.col("map") == "b", F.col("v"))).alias("vb")).agg(F.corr("va", "vb").alias("cc"))


def dense(pdf: pd.DataFrame, column: str) -> np.ndarray:
    n = int(pdf[AXES].to_numpy().max()) + 1
    out = np.zeros((n, n, n))
    out[pdf["z"], pdf["y"], pdf["x"]] = pdf[column]
    return out


def shells(a: np.ndarray, b: np.ndarray, voxel: float = 1.0, whole: bool = False) -> pd.DataFrame:
    """Fourier shell correlation by rounded radius up to n / 2, or by the ``whole`` part of the radius below n / 2."""
    n = a.shape[0]
    fa, fb = np.fft.fftn(a), np.fft.fftn(b)
    k = np.fft.fftfreq(n) * n
    radius = np.sqrt(k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2)
    r = (np.floor(radius) if whole else np.rint(radius)).astype(int).ravel()
    top = n // 2 if whole else n // 2 + 1
    add = lambda v: np.bincount(r, v.ravel(), top)[:top]
    num, den = add((fa * fb.conj()).real), np.sqrt(add(np.abs(fa) ** 2) * add(np.abs(fb) ** 2))
    freq = np.arange(top) / (n * voxel)
    return pd.DataFrame({"shell": np.arange(top), "freq": freq, "fsc": np.where(den > 0, num / np.where(den > 0, den, 1), 0.0)})


def fsc(pairs: DataFrame, voxel: float = 1.0, whole: bool = False) -> DataFrame:
    """Shell correlation of each pair (pair, x, y, z, va, vb); a pair's two grids meet in one task (V3, V7)."""
    ship(pairs.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = shells(dense(pdf, "va"), dense(pdf, "vb"), voxel, whole)
        out.insert(0, "pair", pdf["pair"].iloc[0])
        return out

    return pairs.groupBy("pair").applyInPandas(run, "pair string, shell long, freq double, fsc double")


def resolution_table(curves: DataFrame, threshold: float = 0.143) -> DataFrame:
    """Resolution at which each pair's curve first falls below a threshold, interpolated."""
    from pyspark.sql import Window

    w = Window.partitionBy("pair").orderBy("freq")
    t = curves.withColumn("pf", F.lag("freq").over(w)).withColumn("pv", F.lag("fsc").over(w)).where(F.col("fsc") < threshold)
    at = F.when(F.col("pv").isNotNull(), F.col("pf") + (F.col("pv") - threshold) / (F.col("pv") - F.col("fsc")) * (F.col("freq") - F.col("pf"))).otherwise(F.col("freq"))
    return t.groupBy("pair").agg(F.min_by(at, "freq").alias("freq")).select("pair", (1 / F.col("freq")).alias("resolution"))


def _shift(a: np.ndarray, axis: int, by: int) -> np.ndarray:
    out = np.zeros_like(a)
    src, dst = [slice(None)] * 3, [slice(None)] * 3
    src[axis], dst[axis] = (slice(None, -1), slice(1, None)) if by > 0 else (slice(1, None), slice(None, -1))
    out[tuple(dst)] = a[tuple(src)]
    return out


def dilate(m: np.ndarray, steps: int = 1) -> np.ndarray:
    for _ in range(steps):
        m = m | np.logical_or.reduce([_shift(m, ax, s) for ax in range(3) for s in (1, -1)])
    return m


def close(m: np.ndarray, steps: int = 1) -> np.ndarray:
    return ~dilate(~dilate(m, steps), steps)


def largest_component(m: np.ndarray) -> np.ndarray:
    """The largest 6-connected part, by spreading the largest index."""
    label = np.where(m, np.arange(1, m.size + 1).reshape(m.shape), 0)
    while True:
        new = np.where(m, np.maximum.reduce([label, *[_shift(label, ax, s) for ax in range(3) for s in (1, -1)]]), 0)
        if (new == label).all():
            break
        label = new
    if not m.any():
        return m
    ids, n = np.unique(label[m], return_counts=True)
    return label == ids[n.argmax()]


def soft_edge(m: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian-blurred mask, at least the mask itself."""
    r = int(3 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = m.astype(float)
    for ax in range(3):
        out = np.apply_along_axis(lambda v: np.convolve(v, k, "same"), ax, out)
    return np.maximum(out, m)


def focus_masks(maps: DataFrame, level: float, closing: int = 1, growth: int = 1, sigma: float = 1.5) -> DataFrame:
    """A soft mask for each map: threshold, close, largest part, dilate, blur (V11); one map a task."""
    ship(maps.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = dense(pdf, "v")
        soft = soft_edge(dilate(largest_component(close(v > level, closing)), growth), sigma)
        z, y, x = np.nonzero(soft > 1e-6)
        return pd.DataFrame({"map": pdf["map"].iloc[0], "x": x, "y": y, "z": z, "w": soft[z, y, x]})

    return maps.groupBy("map").applyInPandas(run, "map string, x int, y int, z int, w double")


def to_long(name: str, volume: np.ndarray) -> Iterator[tuple]:
    for z, y, x in np.ndindex(volume.shape):
        yield name, z, y, x, float(volume[z, y, x])
