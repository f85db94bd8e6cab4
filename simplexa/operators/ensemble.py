"""Pooling two experts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexa.functions import simplex as sx
from simplexa.operators import agreement, populations
from simplexa.session import ship

#: Pool functions by name: weight of a class from (a, b, ln a, ln b, lambda); weights are normalised after.
POOLS: dict[str, Callable[..., Column]] = {
    "linear": lambda a, b, la, lb, lam: lam * a + (F.lit(1.0) - lam) * b,
    "log": lambda a, b, la, lb, lam: F.exp(lam * la + (F.lit(1.0) - lam) * lb),
}


def mean_entropies(df: DataFrame, temperatures: Sequence[float], posterior: str = "posterior") -> list[float]:
    """Mean entropy of the softened posteriors for several temperatures, in one pass."""
    return _mean_entropies(_logs(df, posterior), temperatures)


def _logs(df: DataFrame, posterior: str) -> DataFrame:
    """Logarithms of the clipped components less their largest, which softening does not change."""
    logs = F.transform(sx.clip_low(F.col(posterior)), lambda x: F.ln(x))
    return df.select(sx.once(logs, lambda v: sx.once(F.array_max(v), lambda top: F.transform(v, lambda x: x - top))).alias("logs"))


def _mean_entropies(logs: DataFrame, temperatures: Sequence[float]) -> list[float]:
    """Tasks sum the entropies of all temperatures in numpy, and pass on a sum each."""
    ship(logs.sparkSession)
    ts = [float(t) for t in temperatures]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(ts)), 0
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(0)
            if column.null_count:
                column = column.drop_null()
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            for k in np.unique(sizes[sizes > 0]):  # vectors of one size at once
                x = flat[np.repeat(sizes == k, sizes)].reshape(-1, k)
                n += len(x)
                for i, t in enumerate(ts):
                    w = np.exp(x / t)
                    p = np.maximum(w / np.maximum(w.sum(1, keepdims=True), sx.TINY), sx.TINY)
                    total[i] -= (p * np.log(p)).sum()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "h"])

    found = logs.mapInArrow(task, "n long, h array<double>").agg(F.sum("n").alias("n"), *[F.sum(F.get("h", F.lit(i))).alias(f"h{i}") for i in range(len(ts))]).first()
    return [found[f"h{i}"] / found.n if found.n else None for i in range(len(ts))]


def temperature(df: DataFrame, target: float, lo: float = 1e-3, hi: float = 1e3, xtol: float = 1e-4, posterior: str = "posterior", width: int = 8) -> float:
    """Temperature at which the mean entropy meets a target; clamped to the bracket.

    The mean entropy grows with T.  Each pass over the rows evaluates ``width``
    temperatures and narrows the bracket ``width + 1``-fold.
    """
    df = _logs(df, posterior).persist()
    try:
        a, b = _mean_entropies(df, [lo, hi])
        if target <= a:
            return lo
        if target >= b:
            return hi
        while hi - lo > xtol:
            ratio = (hi / lo) ** (1 / (width + 1))
            ts = [lo * ratio ** (i + 1) for i in range(width)]
            hs = _mean_entropies(df, ts)
            below = [t for t, h in zip(ts, hs, strict=True) if h < target]
            above = [t for t, h in zip(ts, hs, strict=True) if h >= target]
            lo, hi = max([lo, *below]), min([hi, *above])
        return (lo + hi) / 2
    finally:
        df.unpersist()


def _pooled(joined: DataFrame, lambdas: Sequence[float], k: int, pools: Sequence[str], *others: str) -> DataFrame:
    """A row for each row and setting: pool, lam, components p0, p1, ..., m, hard, h and ``others``."""
    one = [c for i in range(k) for c in (F.get("p_a", F.lit(i)).alias(f"a{i}"), F.get("p_b", F.lit(i)).alias(f"b{i}"))]
    logs = [F.ln(F.greatest(f"{x}{i}", F.lit(sx.TINY))).alias(f"l{x}{i}") for i in range(k) for x in "ab"]
    grid = F.array(*[F.struct(F.lit(p).alias("pool"), F.lit(float(x)).alias("lam")) for p in pools for x in lambdas])
    rows = joined.select(*one, *others).select("*", *logs).withColumn("g", F.explode(grid))

    def weight(i: int) -> Column:
        out = F.lit(None).cast("double")
        for p in pools:
            out = F.when(F.col("g.pool") == p, POOLS[p](*[F.col(f"{x}{i}") for x in ("a", "b", "la", "lb")], F.col("g.lam"))).otherwise(out)
        return out.alias(f"w{i}")

    rows = rows.select(F.col("g.pool").alias("pool"), F.col("g.lam").alias("lam"), *[weight(i) for i in range(k)], *others)
    total = F.greatest(sum((F.col(f"w{i}") for i in range(1, k)), F.col("w0")), F.lit(sx.TINY))
    rows = rows.select("pool", "lam", *[(F.col(f"w{i}") / total).alias(f"p{i}") for i in range(k)], *others)
    top = F.greatest(*[f"p{i}" for i in range(k)]) if k > 1 else F.col("p0")
    hard = F.coalesce(*[F.when(F.col(f"p{i}") >= top - F.lit(sx.TINY), i) for i in range(k)])  # equal up to rounding: the first
    clipped = [F.greatest(f"p{i}", F.lit(sx.TINY)) for i in range(k)]
    return rows.select("*", top.alias("m"), hard.alias("hard"), (-sum((c * F.ln(c) for c in clipped[1:]), clipped[0] * F.ln(clipped[0]))).alias("h"))


def _summary(k: int) -> list[Column]:
    return [
        F.count("*").alias("n"), F.avg("m").alias("mean_maxpost"), F.avg("h").alias("mean_entropy"),
        *[F.avg((F.col("hard") == i).cast("double")).alias(f"hard_{i}") for i in range(k)],
        *[F.avg(f"p{i}").alias(f"soft_{i}") for i in range(k)],
    ]


def lambda_sweep(joined: DataFrame, lambdas: Sequence[float], k: int, pools: Sequence[str] = ("linear", "log")) -> DataFrame:
    """Hard and soft populations, sharpness and entropy of pooled posteriors.

    ``joined`` has p_a and p_b.  The rows are multiplied by the grid of settings and
    summed at once; nothing but (settings x classes) sums is shuffled.  Components are
    scalar columns here, so that the whole computation is one stage of generated code.
    """
    return _pooled(joined, lambdas, k, pools).groupBy("pool", "lam").agg(*_summary(k))


def ensemble_sweep(joined: DataFrame, lambdas: Sequence[float], k: int, t: float, pools: Sequence[str] = ("linear", "log"), referee: str | None = None) -> DataFrame:
    """``lambda_sweep`` with confusion-corrected populations, agreement with a referee's label column, and a last row
    ``linear_cal`` at 0.5 whose second expert is softened by ``t`` (M21).

    The k x k sums that the correction and the agreement need come from the same aggregation.
    """
    cells = [(i, j) for i in range(k) for j in range(k)]
    sums = [F.sum(F.when(F.col("hard") == j, F.col(f"p{i}")).otherwise(0.0)).alias(f"c{i}_{j}") for i, j in cells]
    if referee:
        sums += [F.sum(((F.col(referee) == i) & (F.col("hard") == j)).cast("long")).alias(f"r{i}_{j}") for i, j in cells]
    others = [referee] if referee else []
    cal = joined.withColumn("p_b", sx.soften(F.col("p_b"), t))
    whole = _pooled(joined, lambdas, k, pools, *others).unionByName(_pooled(cal, [0.5], k, ["linear"], *others).withColumn("pool", F.lit("linear_cal")))
    base = ["pool", "lam", "n", "mean_maxpost", "mean_entropy", *[f"{kind}_{i}" for kind in ("hard", "soft") for i in range(k)]]
    rows = []
    for r in whole.groupBy("pool", "lam").agg(*_summary(k), *sums).collect():  # a row a setting
        c = np.array([[r[f"c{i}_{j}"] for j in range(k)] for i in range(k)])
        corrected = populations.deconvolve(np.array([r[f"hard_{i}"] for i in range(k)]), populations.sanitise(c / np.maximum(c.sum(1, keepdims=True), 1e-12)))
        same = agreement.ari_of(np.array([[r[f"r{i}_{j}"] for j in range(k)] for i in range(k)], float)) if referee else None
        rows.append((*[r[c] for c in base], *map(float, corrected), same))
    schema = ", ".join(f"{c} {'string' if c == 'pool' else 'long' if c == 'n' else 'double'}" for c in [*base, *[f"deconv_{i}" for i in range(k)], "ari"])
    return joined.sparkSession.createDataFrame(rows, schema)


def ensemble_export(joined: DataFrame, lam: float, k: int, t: float | None = None, key: str = "uid") -> tuple[DataFrame, DataFrame, dict]:
    """Rows, populations and diagnostics of the calibrated, pooled and refereed posteriors.

    Without ``t`` the second expert is softened until its mean entropy is the first one's.
    Rows: key, hard (of the pool), class and resp of the mixture under the pool's class numbers, weight (largest
    responsibility).  Populations by class: pooled hard and soft, of the mixture, and corrected.
    """
    from simplexa.operators import gmm, selection

    if t is None:
        t = temperature(joined, joined.agg(F.avg(sx.entropy(F.col("p_a"))).alias("h")).first().h, posterior="p_b")
    p = sx.linear_pool(F.col("p_a"), sx.soften(F.col("p_b"), t), F.lit(float(lam)))
    base = joined.select(key, p.alias("posterior")).withColumn("hard", sx.argmax(F.col("posterior"))).withColumn("x", sx.alr(F.col("posterior"), k))
    fit = gmm.fit(base, "x", k - 1, k, init="hard", key=key)
    rows = selection.aligned(gmm.predict(base, fit.model, "x"), "hard", k).select(key, "posterior", "hard", F.col("label").alias("class"), "resp", F.array_max("resp").alias("weight"))
    by = rows.groupBy("hard", "class").agg(F.count("*").alias("n"), *[F.sum(F.get("posterior", F.lit(i))).alias(f"p{i}") for i in range(k)]).collect()  # k x k rows
    n = sum(r.n for r in by)
    c, own, other = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for r in by:
        own[r.hard] += r.n
        other[r["class"]] += r.n
        c[:, r.hard] += [r[f"p{i}"] for i in range(k)]
    corrected = populations.deconvolve(own / n, populations.sanitise(c / np.maximum(c.sum(1, keepdims=True), 1e-12)))
    table = [(i, float(own[i] / n), float(other[i] / n), float(c[i].sum() / n), float(corrected[i])) for i in range(k)]
    spark = joined.sparkSession
    return rows, spark.createDataFrame(table, "class int, ensemble_hard double, gmm_hard double, ensemble_soft double, deconvolved double"), {"temperature": t, **gmm.diagnostics(fit)}


def export_weights(joined: DataFrame, lam: float, t: float, k: int, referee_iter: int = 20) -> DataFrame:
    """The whole pooled export: soften B, pool, fit a referee on log ratios, align it, weigh rows."""
    from simplexa.operators import agreement, gmm, joins

    p = sx.linear_pool(F.col("p_a"), sx.soften(F.col("p_b"), t), F.lit(float(lam)))
    base = joined.select("uid", p.alias("posterior")).withColumn("hard", sx.argmax(F.col("posterior"))).withColumn("x", sx.alr(F.col("posterior"), k))
    fit = gmm.fit(base, "x", k - 1, k, init="hard", max_iter=referee_iter)
    scored = gmm.predict(base, fit.model, "x")
    new = joins.align(agreement.contingency_local(scored, "hard", "label"))
    return joins.relabel(scored, "label", new).select("uid", F.col("label").alias("class"), F.array_max("resp").alias("weight"))
