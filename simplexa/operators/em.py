"""Many mixtures and many bootstrap replicates over one pass of the rows.

Equal vectors are one row with their number (or summed weights) before a fit begins.
Rows stream through tasks as Arrow batches of scalar columns.  A task holds the sufficient
statistics of every live model or replicate and sends one row each at its end; Spark sums
them, so that rows are never copied and what is shuffled does not grow with them.  Replicate
weights are Poisson(1) draws from a hash of key, replicate and seed: the same however the
rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.session import ship

#: P(X <= k) of a Poisson(1) variable
CUMULATIVE = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
#: rows that are weighted at once
ROWS = 8192
#: rows that are worth a task of their own
SHARE = 32_768
#: up to so many tasks, their sums are added up on the driver
FEW = 64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_weights(keys: np.ndarray, reps: Sequence[int], seed: int = 0) -> np.ndarray:
    """(rows, replicates): how often each row is drawn in each replicate."""
    with np.errstate(over="ignore"):
        salt = _mix(np.array(reps, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03) + np.uint64(1))
        h = _mix(_mix(keys.astype(np.int64).view(np.uint64))[:, None] + salt[None, :])
    return np.searchsorted(CUMULATIVE, (h >> np.uint64(11)).astype(np.float64) / (1 << 53), side="right").astype(np.float64)


def summed(rows: DataFrame, run, width: int, tasks: int | None = None) -> dict[int, np.ndarray]:
    """Vectors (model, stats) of all tasks, added up by model; ``run`` maps batches to {model: vector}."""
    ship(rows.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = run(b for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["model", "stats"])

    partial = rows.mapInArrow(task, "model int, stats array<double>")
    out: dict[int, np.ndarray] = {}
    if (tasks or rows.rdd.getNumPartitions()) <= FEW:  # so few rows need no shuffle of their own
        found = partial.toArrow()
        for m, v in zip(found.column("model").to_pylist(), found.column("stats").to_pylist(), strict=True):
            out.setdefault(m, np.zeros(width))[: len(v)] += v
        return out
    long = partial.select("model", F.posexplode("stats").alias("at", "v"))
    for r in long.groupBy("model", "at").agg(F.sum("v").alias("v")).collect():  # models x statistics
        out.setdefault(r.model, np.zeros(width))[r["at"]] = r.v
    return out


def columns(df: DataFrame, vector: str, d: int, *others: str, label: str | None = None) -> DataFrame:
    """The vector as scalar columns x0, x1, ..., then others."""
    extra = [F.col(label).cast("int").alias("label")] if label else []
    return df.select(*[F.get(vector, F.lit(i)).cast("double").alias(f"x{i}") for i in range(d)], *[F.col(c) for c in others], *extra)


def _x(b: pa.RecordBatch, d: int) -> np.ndarray:
    return np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(d)])


def log_joint(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """(rows, components): log weight plus log density."""
    out = np.empty((len(x), len(weights)))
    for c, (w, m, s) in enumerate(zip(weights, means, covs, strict=True)):
        diff = x - m
        quad = ((diff @ np.linalg.inv(s)) * diff).sum(1)
        out[:, c] = math.log(max(w, 1e-300)) - 0.5 * (len(m) * math.log(2 * math.pi) + np.linalg.slogdet(s)[1] + quad)
    return out


def _statistics(x: np.ndarray, w: np.ndarray, model: tuple) -> np.ndarray:
    """n, log likelihood, then by component weight, first and second moments."""
    lj = log_joint(x, *model)
    top = lj.max(1)
    r = np.exp(lj - top[:, None])
    total = r.sum(1)
    ll = top + np.log(total)
    r *= (w / total)[:, None]
    second = np.einsum("nk,ni,nj->kij", r, x, x, optimize=True)
    return np.concatenate(([w.sum(), (w * ll).sum()], np.concatenate((r.sum(0)[:, None], r.T @ x, second.reshape(len(second), -1)), 1).ravel()))


def expectation(rows: DataFrame, models: dict[int, tuple], d: int, weight: str | None = None, reps: bool = False, seed: int = 0, tasks: int | None = None, drawn: bool = False) -> dict[int, np.ndarray]:
    """Sufficient statistics of each model over ``rows`` (see ``columns``); with ``reps`` the model's number is its replicate.

    The last column is the key where replicates are weighted, or the weight; with ``drawn`` a column of weights a replicate
    (see ``collapsed_replicates``) stands there instead.
    """
    sizes = {m: 2 + len(p[0]) * (1 + d + d * d) for m, p in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = {m: np.zeros(n) for m, n in sizes.items()}
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                b = whole.slice(a, ROWS)
                x = _x(b, d)
                if reps:
                    w = np.column_stack([b.column(d + m).to_numpy(zero_copy_only=False) for m in models]) if drawn else poisson_weights(b.column(d).to_numpy(zero_copy_only=False), list(models), seed)
                for i, (m, p) in enumerate(models.items()):
                    if reps:
                        at = w[:, i] > 0
                        total[m] += _statistics(x[at], w[at, i], p)
                    else:
                        total[m] += _statistics(x, b.column(d).to_numpy(zero_copy_only=False).astype(float) if weight else np.ones(len(x)), p)
        return total

    return summed(rows, run, max(sizes.values()), tasks)


def maximisation(stats: np.ndarray, k: int, d: int, reg: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s = stats[2 : 2 + k * (1 + d + d * d)].reshape(k, -1)
    r = np.maximum(s[:, 0], 1e-12)
    means = s[:, 1 : 1 + d] / r[:, None]
    covs = s[:, 1 + d :].reshape(k, d, d) / r[:, None, None] - means[:, :, None] * means[:, None, :] + reg * np.eye(d)
    weights = r / stats[0]
    return weights / weights.sum(), means, covs


def collapsed(rows: DataFrame, d: int, weight: str | None = None) -> DataFrame:
    """Equal vectors as one row, the last column their summed weight (or their number): measured data repeat, and a fit
    then passes over different vectors only."""
    return rows.groupBy(*[f"x{i}" for i in range(d)]).agg((F.sum(F.col(weight).cast("double")) if weight else F.count("*").cast("double")).alias("w"))


def collapsed_replicates(rows: DataFrame, d: int, reps: int, seed: int, least: float = 4.0, live: int = 20_000) -> DataFrame | None:
    """Equal vectors as one row with their summed Poisson weights, a column a replicate; None where they would be more numbers than
    ``least`` times the rows.

    The last column of ``rows`` is the key.  A task holds at most ``live`` vectors before it passes their sums on.
    """
    one = rows.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(*[f"x{i}" for i in range(d)])).alias("distinct")).first()
    if one.distinct * reps > least * one.n:
        return None
    ship(rows.sparkSession)
    names = [*[f"x{i}" for i in range(d)], *[f"r{i}" for i in range(reps)]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.empty((0, d)), np.empty((0, reps))

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (*keys.T, *sums.T)], names)

        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                b = whole.slice(a, ROWS)
                x = np.concatenate((keys, _x(b, d)))
                w = np.concatenate((sums, poisson_weights(b.column(d).to_numpy(zero_copy_only=False), range(reps), seed)))
                keys, at = np.unique(x, axis=0, return_inverse=True)
                order = np.argsort(at.ravel(), kind="stable")
                sums = np.add.reduceat(w[order], np.searchsorted(at.ravel()[order], np.arange(len(keys))), axis=0)
                if len(keys) > live:
                    yield packed()
                    keys, sums = np.empty((0, d)), np.empty((0, reps))
        if len(keys):
            yield packed()

    partial = rows.mapInArrow(task, ", ".join(f"{c} double" for c in names))
    return partial.groupBy(*names[:d]).agg(*[F.sum(c).alias(c) for c in names[d:]])


def fit(df: DataFrame, vector: str, d: int, starts: Sequence[tuple], *, reg: float = 1e-6, max_iter: int = 500, tol: float = 1e-5, weight: str | None = None, reps: bool = False, key: str = "uid", seed: int = 0) -> list[dict]:
    """EM from each start at once; a model leaves the passes when its mean log likelihood moves by less than ``tol``.

    With ``reps`` the i-th start is fitted to the i-th bootstrap replicate.
    """
    rows = columns(df, vector, d, *([key] if reps else [weight] if weight else []))
    drawn = False  # whether the replicates' weights are columns already
    if reps:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        if (summed_up := collapsed_replicates(rows, d, len(starts), seed)) is not None:
            whole, rows, drawn = rows, summed_up.persist(StorageLevel.MEMORY_AND_DISK), True
    else:
        rows, weight = collapsed(rows, d, weight).persist(StorageLevel.MEMORY_AND_DISK), "w"
    kept = rows
    try:
        tasks = min(rows.rdd.getNumPartitions(), max(1, math.ceil(rows.count() / SHARE)))
        rows = rows.coalesce(tasks)  # a pass over few rows is not worth many tasks
        if drawn:
            whole.unpersist()
        models = {i: tuple(np.asarray(p, float) for p in s) for i, s in enumerate(starts)}
        last, live, done = dict.fromkeys(models, -math.inf), dict(models), {}
        for it in range(1, max_iter + 1):
            for m, s in expectation(rows, live, d, weight, reps, seed, tasks, drawn).items():
                ll = s[1] / s[0]
                models[m] = maximisation(s, len(models[m][0]), d, reg)
                if abs(ll - last[m]) < tol:
                    done[m] = it
                last[m] = ll
            live = {m: models[m] for m in models if m not in done}
            if not live:
                break
        final = expectation(rows, models, d, weight, reps, seed, tasks, drawn)
        return [{"model": models[m], "loglik": final[m][1] / final[m][0], "n": final[m][0], "n_iter": done.get(m, max_iter), "converged": m in done} for m in models]
    finally:
        kept.unpersist()


def replicate_moments(df: DataFrame, vector: str, d: int, k: int, reps: int, *, label: str = "hard", key: str = "uid", seed: int = 0, second: bool = False) -> np.ndarray:
    """(reps, k, 1 + d [+ d d]): weighted count, sums and, if asked, products of each class in each replicate, in one pass."""
    width = 1 + d + (d * d if second else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = np.zeros((k, reps, width))
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                b = whole.slice(a, ROWS)
                x, w = _x(b, d), poisson_weights(b.column(d).to_numpy(zero_copy_only=False), range(reps), seed)
                parts = [np.ones((len(x), 1)), x]
                if second:
                    parts.append((x[:, :, None] * x[:, None, :]).reshape(len(x), -1))
                values, label_ = np.concatenate(parts, 1), b.column(d + 1).to_numpy(zero_copy_only=False)
                for c in range(k):
                    at = label_ == c
                    total[c] += w[at].T @ values[at]
        return {c: t.ravel() for c, t in enumerate(total)}

    found = summed(columns(df, vector, d, key, label=label), run, reps * width)
    return np.stack([found.get(c, np.zeros(reps * width)).reshape(reps, width) for c in range(k)], 1)
