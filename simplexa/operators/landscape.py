"""Densities, free energies and basins.

Densities over a fixed grid are sums over rows, so rows are first counted into fine bins
by a shuffle of bin counts, and the kernel is applied to the bins; what follows works on
the grid, whose size does not grow with the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.operators import joins


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins, the last one closed; rows outside are left out."""
    b = F.least(F.floor((F.col(column) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return df.where((F.col(column) >= lo) & (F.col(column) <= hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, xr: tuple[float, float], yr: tuple[float, float], bins: int) -> DataFrame:
    b = lambda c, r: F.least(F.floor((F.col(c) - r[0]) / (r[1] - r[0]) * bins), F.lit(bins - 1)).cast("int")
    inside = (F.col(x) >= xr[0]) & (F.col(x) <= xr[1]) & (F.col(y) >= yr[0]) & (F.col(y) <= yr[1])
    return df.where(inside).groupBy(b(x, xr).alias("bx"), b(y, yr).alias("by")).agg(F.count("*").alias("n"))


def density_1d(df: DataFrame, column: str, grid: np.ndarray, scale: float = 1.0, fine: int = 8192) -> np.ndarray:
    """Gaussian kernel density at grid points; Scott's width times ``scale``, rows counted into ``fine`` bins."""
    s = df.agg(F.count(column).alias("n"), F.stddev_samp(column).alias("sd"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if not s.n or not s.sd:
        return np.full(len(grid), 1e-300)
    h = s.sd * s.n ** (-1 / 5) * scale
    w = (s.hi - s.lo) / fine
    t = df.groupBy(F.least(F.floor((F.col(column) - s.lo) / w), F.lit(fine - 1)).cast("int").alias("b")).agg(F.count("*").alias("n"), F.avg(column).alias("m")).collect()  # fine bins at most
    m, n = np.array([r.m for r in t]), np.array([r.n for r in t], float)
    return (np.exp(-0.5 * ((grid[:, None] - m) / h) ** 2) @ n) / (s.n * h * np.sqrt(2 * np.pi))


def free_energy(density: np.ndarray) -> np.ndarray:
    """-log density, its smallest value 0 (G1)."""
    f = -np.log(np.maximum(density, 1e-300))
    return f - f.min()


def free_energy_1d(df: DataFrame, column: str, grid: np.ndarray, scale: float = 1.0) -> np.ndarray:
    return free_energy(density_1d(df, column, grid, scale))


def extrema(f: np.ndarray) -> tuple[list[int], list[int]]:
    """Indices of local minima and maxima (G2): where a run of falling steps gives way to one of rising steps, or the
    reverse; level steps belong to the run before them."""
    steps = np.sign(np.diff(f))
    sloped = np.flatnonzero(steps)
    turn = np.diff(steps[sloped])
    return sloped[1:][turn > 0].tolist(), sloped[1:][turn < 0].tolist()


def basins_1d(f: np.ndarray, grid: np.ndarray, barrier: float = 0.5) -> list[dict]:
    """Wells of a persistence of at least ``barrier``.

    Saddles between neighbouring wells are opened from the lowest up; at each the higher of
    the two bottoms it joins ends, and its persistence is the saddle's height above it.
    """
    wells = np.array(extrema(f)[0] or [int(f.argmin())])
    saddles = np.array([f[a : b + 1].max() for a, b in zip(wells[:-1], wells[1:], strict=True)])
    lasting = np.full(len(wells), np.inf)
    first, last = np.arange(len(wells)), np.arange(len(wells))  # the run of opened wells that each end of a run belongs to
    deepest = list(range(len(wells)))  # of the run, kept at its first well
    for s in np.argsort(saddles, kind="stable"):
        left, right = first[s], s + 1
        low, high = sorted((deepest[left], deepest[right]), key=lambda w: (f[wells[w]], w))
        lasting[high] = saddles[s] - f[wells[high]]
        end = last[right]
        first[end], last[left], deepest[left] = left, end, low
    kept = wells[lasting >= barrier]
    walls = [float(f[a : b + 1].max() - f[a]) for a, b in zip(kept[:-1], kept[1:], strict=True)] + [float("nan")]
    return [{"position": float(grid[w]), "depth": float(f[w]), "barrier_right": r} for w, r in zip(kept, walls, strict=True)]


def band(df: DataFrame, column: str, grid: np.ndarray, reps: int = 200, scale: float = 1.0, fine: int = 2048, seed: int = 0) -> np.ndarray:
    """5th, 50th and 95th percentile of the free energy over multinomial replicates of the bin counts."""
    s = df.agg(F.count(column).alias("n"), F.stddev_samp(column).alias("sd"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    h, w = s.sd * s.n ** (-1 / 5) * scale, (s.hi - s.lo) / fine
    t = df.groupBy(F.least(F.floor((F.col(column) - s.lo) / w), F.lit(fine - 1)).cast("int").alias("b")).agg(F.count("*").alias("n"), F.avg(column).alias("m")).collect()
    m, n = np.array([r.m for r in t]), np.array([r.n for r in t], float)
    kernel = np.exp(-0.5 * ((grid[:, None] - m) / h) ** 2)
    draws = np.random.default_rng(seed).multinomial(int(s.n), n / n.sum(), size=reps)
    return np.percentile([free_energy(kernel @ d) for d in draws], [5, 50, 95], axis=0)


def density_2d(df: DataFrame, x: str, y: str, nx: int = 140, ny: int = 140, scale: float = 1.0, pad: float = 0.05, fine: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernel density on a grid with the data's covariance and Scott's width (G4); also the axes."""
    s = df.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max), ("v", F.var_samp))], F.covar_samp(x, y).alias("c")).first()
    axes = []
    for c, n in ((x, nx), (y, ny)):
        lo, hi = s[f"lo_{c}"], s[f"hi_{c}"]
        axes.append(np.linspace(lo - pad * (hi - lo), hi + pad * (hi - lo), n))
    cov = np.array([[s[f"v_{x}"], s.c], [s.c, s[f"v_{y}"]]]) * (s.n ** (-1 / 6) * scale) ** 2
    inv = np.linalg.inv(cov + 1e-12 * np.eye(2))
    key = lambda c: F.least(F.floor((F.col(c) - s[f"lo_{c}"]) / max((s[f"hi_{c}"] - s[f"lo_{c}"]) / fine, 1e-300)), F.lit(fine - 1)).cast("int")
    t = df.groupBy(key(x).alias("a"), key(y).alias("b")).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my")).collect()  # fine * fine bins at most
    mx, my, n = (np.array([r[i] for r in t], float) for i in ("mx", "my", "n"))
    gx, gy = axes
    out = np.zeros((ny, nx))
    for j, v in enumerate(gy):
        dx, dy = gx[:, None] - mx[None], (v - my)[None]
        out[j] = np.exp(-0.5 * (inv[0, 0] * dx * dx + 2 * inv[0, 1] * dx * dy + inv[1, 1] * dy * dy)) @ n
    return out / (s.n * 2 * np.pi * np.sqrt(np.linalg.det(cov + 1e-12 * np.eye(2)))), gx, gy


def flood(f: np.ndarray, threshold: float) -> tuple[np.ndarray, list[int], list[float]]:
    """Watershed of a surface over the edges of its grid, by their higher ends.

    Cells are known by their rank in height, so that a basin's least member is its bottom
    and stands for it.  An edge can open only when its higher end is reached; that cell
    joins the lowest of the basins its edges lead to, and those of the others that are
    shallower than ``threshold`` there drain into it too.  Returns the basin of every
    cell, the cells of the bottoms, and the depths at which basins met, largest first.
    """
    order = np.argsort(f, axis=None, kind="stable")
    level = f.ravel()[order]
    rank = np.empty(f.size, np.int64)
    rank[order] = np.arange(f.size)
    g = rank.reshape(f.shape)
    sides = ((g[:, 1:], g[:, :-1]), (g[1:], g[:-1]), (g[1:, 1:], g[:-1, :-1]), (g[1:, :-1], g[:-1, 1:]))
    ends = np.sort(np.concatenate([np.stack((a.ravel(), b.ravel()), axis=1) for a, b in sides]), axis=1)
    ends = ends[np.argsort(ends[:, 1], kind="stable")]
    drains = list(range(f.size))
    depths: dict[int, float] = {}

    def bottom(cell: int) -> int:
        path = []
        while drains[cell] != cell:
            path.append(cell)
            cell = drains[cell]
        for p in path:
            drains[p] = cell
        return cell

    reached, starts = np.unique(ends[:, 1], return_index=True)
    for cell, lower in zip(reached.tolist(), np.split(ends[:, 0], starts[1:]), strict=True):
        lowest, *rest = sorted({bottom(c) for c in lower.tolist()})
        drains[cell] = lowest
        for b in rest:
            depths.setdefault(b, float(level[cell] - level[b]))
            if level[cell] - level[b] < threshold:
                drains[b] = lowest
    names, labels = np.unique([bottom(c) for c in rank.tolist()], return_inverse=True)
    # basins are numbered by the height of their bottoms
    return labels.reshape(f.shape), order[names].tolist(), sorted(depths.values(), reverse=True)


def basin_counts(f: np.ndarray, thresholds: list[float]) -> list[tuple[float, int]]:
    """Number of basins at each threshold."""
    return [(t, len(flood(f, t)[1])) for t in thresholds]


def assign(df: DataFrame, labels: np.ndarray, gx: np.ndarray, gy: np.ndarray, x: str = "pc1", y: str = "pc2") -> DataFrame:
    return joins.grid_lookup(df, labels, gx, gy, x, y)


def populated_counts(df: DataFrame, f: np.ndarray, gx: np.ndarray, gy: np.ndarray, thresholds: list[float], minimum: int, x: str = "pc1", y: str = "pc2") -> list[tuple[float, int]]:
    """Basins with at least ``minimum`` rows (G6); rows are counted by cell once."""
    t = df.groupBy(joins.grid_cell(x, gx[0], gx[1] - gx[0], len(gx)).alias("cx"), joins.grid_cell(y, gy[0], gy[1] - gy[0], len(gy)).alias("cy")).agg(F.count("*").alias("n")).collect()  # cells of a fixed grid
    out = []
    for th in thresholds:
        labels, bottoms, _ = flood(f, th)
        n = np.zeros(len(bottoms))
        for r in t:
            n[labels[r.cy, r.cx]] += r.n
        out.append((th, int((n >= minimum).sum())))
    return out


def merge_minor(labels: np.ndarray, bottoms: list[int], counts: np.ndarray, gx: np.ndarray, gy: np.ndarray, minimum: float) -> tuple[np.ndarray, list[int]]:
    """Basins with too few rows join the nearest that has enough (G7, J13); renumbered from left to right."""
    row, col = np.divmod(np.asarray(bottoms), len(gx))
    x, y = np.asarray(gx)[col], np.asarray(gy)[row]
    enough = np.asarray(counts) >= minimum
    if not enough.any():
        enough[np.argmax(counts)] = True
    kept = np.flatnonzero(enough)
    kept = kept[np.argsort(x[kept], kind="stable")]
    target = np.hypot(x[:, None] - x[kept], y[:, None] - y[kept]).argmin(axis=1)
    target[kept] = np.arange(len(kept))
    return target[labels], [bottoms[k] for k in kept]


def landscape(df: DataFrame, vector: str, d: int, label: str = "hard", *, nx: int = 140, ny: int = 140, barrier: float = 0.5, min_share: float = 0.02) -> tuple[DataFrame, dict]:
    """Rows with pc1, pc2 and basin, and the surface."""
    from simplexa.operators import latent

    z, _, _ = latent.standardise(df, vector, d)
    scored = latent.oriented_pca(z, "x", d, label)
    density, gx, gy = density_2d(scored, "pc1", "pc2", nx, ny)
    f = free_energy(density)
    labels, bottoms, met = flood(f, barrier)
    placed = assign(scored, labels, gx, gy)
    counts = np.zeros(len(bottoms))
    for r in placed.groupBy("basin").count().collect():
        counts[r.basin] = r["count"]
    labels, bottoms = merge_minor(labels, bottoms, counts, gx, gy, min_share * counts.sum())
    return assign(scored, labels, gx, gy), {"f": f, "gx": gx, "gy": gy, "labels": labels, "bottoms": bottoms, "persistence": met[:6]}


def substate_plan(occupancy: DataFrame) -> DataFrame:
    """Dominant basin of each class (i, j, value) and the classes of each basin."""
    best = occupancy.groupBy("i").agg(F.max_by("j", F.struct("value", -F.col("j"))).alias("basin"), F.max("value").alias("share"))
    return best.groupBy("basin").agg(F.sort_array(F.collect_list("i")).alias("classes"), F.count("*").alias("recommended_k"))


def barrier_between(df: DataFrame, axis: str, a: float, b: float, scale: float = 1.0, n: int = 400) -> dict:
    """Barrier on a projected axis between two centres, and the overlap of the two classes' densities."""
    s = df.agg(F.min(axis).alias("lo"), F.max(axis).alias("hi")).first()
    grid = np.linspace(s.lo, s.hi, n)
    f = free_energy_1d(df, axis, grid, scale)
    i, j = sorted((int(np.abs(grid - a).argmin()), int(np.abs(grid - b).argmin())))
    top = float(f[i : j + 1].max())
    return {"barrier_from_a": top - float(f[np.abs(grid - a).argmin()]), "barrier_from_b": top - float(f[np.abs(grid - b).argmin()])}


def class_overlap(df: DataFrame, axis: str, label: str, a: int, b: int, n: int = 400) -> float:
    """Integral of the smaller over that of the larger of two class densities."""
    s = df.where(F.col(label).isin(a, b)).agg(F.min(axis).alias("lo"), F.max(axis).alias("hi")).first()
    grid = np.linspace(s.lo, s.hi, n)
    da, db = (density_1d(df.where(F.col(label) == c), axis, grid) for c in (a, b))
    return float(np.trapezoid(np.minimum(da, db), grid) / np.trapezoid(np.maximum(da, db), grid))


def mixture_surface(weights: np.ndarray, means: np.ndarray, covs: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """Negative log likelihood of a two-dimensional mixture on a grid."""
    x, y = np.meshgrid(gx, gy)
    p = np.zeros(x.shape)
    for w, m, c in zip(weights, means, covs, strict=True):
        inv = np.linalg.inv(c)
        dx, dy = x - m[0], y - m[1]
        p += w * np.exp(-0.5 * (inv[0, 0] * dx * dx + 2 * inv[0, 1] * dx * dy + inv[1, 1] * dy * dy)) / (2 * np.pi * np.sqrt(np.linalg.det(c)))
    return -np.log(np.maximum(p, 1e-300))


def marginal_curves(weights: np.ndarray, means: np.ndarray, variances: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Component curves of a one-dimensional mixture."""
    return np.array([w * np.exp(-0.5 * (grid - m) ** 2 / v) / np.sqrt(2 * np.pi * v) for w, m, v in zip(weights, means, variances, strict=True)])


def axis_gaussians(df: DataFrame, k: int, axis: int, label: str = "hard", bins: int = 60) -> tuple[DataFrame, DataFrame]:
    """Class-wise mean and deviation of one posterior component, and its histogram."""
    t = df.withColumn("_p", F.get("posterior", F.lit(axis)))
    return t.groupBy(label).agg(F.count("*").alias("n"), F.avg("_p").alias("mean"), F.stddev_samp("_p").alias("sd")), histogram(t, "_p", 0.0, 1.0, bins)
