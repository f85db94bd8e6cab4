"""Agreement of labellings and quality of posteriors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.functions import simplex as sx
from simplexa.operators.quantiles import quantiles
from simplexa.operators.joins import align
from simplexa.session import ship


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count("*").alias("n"))


def contingency_local(df: DataFrame, a: str, b: str) -> np.ndarray:
    """The table of a bounded number of labels, rows and columns in order of label."""
    rows = contingency(df, a, b).collect()
    ri, ci = sorted({r.i for r in rows}), sorted({r.j for r in rows})
    out = np.zeros((len(ri), len(ci)))
    for r in rows:
        out[ri.index(r.i), ci.index(r.j)] = r.n
    return out


def ari(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index, by pair counts over the crosstab."""
    c2 = lambda x: x * (x - 1) / 2
    t = contingency(df, a, b)
    cells = t.agg(F.sum(c2(F.col("n").cast("double"))).alias("s"), F.sum("n").cast("double").alias("total"))
    rows = t.groupBy("i").agg(F.sum("n").cast("double").alias("n")).agg(F.sum(c2(F.col("n"))).alias("sa"))
    cols = t.groupBy("j").agg(F.sum("n").cast("double").alias("n")).agg(F.sum(c2(F.col("n"))).alias("sb"))
    one = cells.crossJoin(rows).crossJoin(cols)  # one row each
    expected = F.col("sa") * F.col("sb") / c2(F.col("total"))
    top = (F.col("sa") + F.col("sb")) / 2
    return one.select(F.when(top == expected, 1.0).otherwise((F.col("s") - expected) / (top - expected)).alias("ari"))


def ari_of(counts: np.ndarray) -> float:
    """The same from a table of counts."""
    c2 = lambda x: float((x * (x - 1) / 2).sum())
    sa, sb = c2(counts.sum(1)), c2(counts.sum(0))
    total = c2(counts.sum(keepdims=True))
    expected, top = (sa * sb / total if total else 0.0), (sa + sb) / 2
    return 1.0 if top == expected else (c2(counts) - expected) / (top - expected)


def v_measures(df: DataFrame, a: str, b: str) -> DataFrame:
    """Homogeneity, completeness, V-measure and arithmetic-mean NMI."""
    t = contingency(df, a, b)
    total = t.agg(F.sum("n").cast("double").alias("total"))
    h = lambda key, name: t.groupBy(key).agg(F.sum("n").alias("n")).crossJoin(total).agg((-F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") / F.col("total")))).alias(name))
    joint = t.crossJoin(total).agg((-F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") / F.col("total")))).alias("hab"))
    one = h("i", "ha").crossJoin(h("j", "hb")).crossJoin(joint)
    mi = F.greatest(F.col("ha") + F.col("hb") - F.col("hab"), F.lit(0.0))
    hom = F.when(F.col("ha") == 0, 1.0).otherwise(mi / F.col("ha"))
    com = F.when(F.col("hb") == 0, 1.0).otherwise(mi / F.col("hb"))
    out = one.select(hom.alias("homogeneity"), com.alias("completeness"), F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(2 * mi / (F.col("ha") + F.col("hb"))).alias("nmi"))
    return out.withColumn("v_measure", F.when(F.col("homogeneity") + F.col("completeness") == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness"))))


def _expected_cell(x: float, y: float, n: float, block: int = 65_536) -> float:
    """One cell's share of the expected mutual information, over every count m it can take.

    Probabilities follow from that of the mode by their ratios; from the mode outwards they fall, in both
    directions faster and faster, so a direction ends where what is left adds nothing to a double.  That is after a few
    deviations, so that the work grows with the root of n.
    """
    lo, hi = max(1.0, x + y - n), min(x, y)
    if lo > hi:
        return 0.0
    mode = min(max(math.floor((x + 1) * (y + 1) / (n + 2)), lo), hi)
    # relative weights, so that the large logarithms cancel in the sum instead of the exponent
    weight = value = 0.0
    part = lambda m, w: (w.sum(), (w * m / n * np.log(n * m / (x * y))).sum())
    for up in (True, False):
        m, last = mode, 1.0
        if up:
            weight, value = 1.0, mode / n * math.log(n * mode / (x * y))
        while (m < hi if up else m > lo) and last > 1e-40:
            steps = np.arange(1, min(block, (hi - m) if up else (m - lo)) + 1)
            at = m + steps if up else m - steps
            ratio = (x - at + 1) * (y - at + 1) / (at * (n - x - y + at)) if up else (at + 1) * (n - x - y + at + 1) / ((x - at) * (y - at))
            w = last * np.cumprod(ratio)
            s, v = part(at, w)
            weight, value, m, last = weight + s, value + v, float(at[-1]), float(w[-1])
    if lo == 1 and x + y <= n:  # m = 0 has a weight too, though it adds nothing
        weight += math.exp(_log_ratio_to(0.0, mode, x, y, n))
    return value / weight


def _log_ratio_to(m: float, mode: float, x: float, y: float, n: float) -> float:
    """Logarithm of the probability of m over that of the mode."""
    lg = math.lgamma
    at = lambda v: lg(v + 1) + lg(x - v + 1) + lg(y - v + 1) + lg(n - x - y + v + 1)
    return at(mode) - at(m)


def ami(counts: np.ndarray) -> float:
    """Adjusted mutual information, arithmetic mean; expectation under the hypergeometric model."""
    a, b, n = counts.sum(1), counts.sum(0), counts.sum()
    if len(a) == len(b) == 1 or n == 0:
        return 1.0
    h = lambda x: -sum(v / n * math.log(v / n) for v in x if v > 0)
    mi = sum(counts[i, j] / n * math.log(n * counts[i, j] / (a[i] * b[j])) for i in range(len(a)) for j in range(len(b)) if counts[i, j] > 0)
    emi = sum(_expected_cell(float(x), float(y), float(n)) for x in a for y in b)
    top = (h(a) + h(b)) / 2
    return 1.0 if abs(top - emi) < 1e-15 else float((mi - emi) / (top - emi))


def purity(df: DataFrame, a: str, b: str) -> DataFrame:
    """Sum of column maxima over the total."""
    return contingency(df, a, b).groupBy("j").agg(F.max("n").alias("m"), F.sum("n").alias("s")).agg((F.sum("m") / F.sum("s")).alias("purity"))


def hungarian_confusion(df: DataFrame, ref: str, pred: str) -> tuple[np.ndarray, list[int]]:
    """Count crosstab with columns in order of the best assignment, spare columns last."""
    m = contingency_local(df, ref, pred)
    new = align(m)
    order = sorted(range(m.shape[1]), key=lambda j: new[j])
    return m[:, order], order


def silhouette(df: DataFrame, vector: str, label: str, n: int = 2000, seed: int = 0, key: str = "uid") -> DataFrame:
    """Mean Euclidean silhouette of a deterministic sample of n rows.

    The sample, no longer than n, goes to all tasks; each measures a share of its rows against it.
    Rows alone in their class count 0; rows without a vector or a class take no part.
    """
    spark = df.sparkSession
    ship(spark)
    chosen = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n).select(F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("l")).toArrow()
    x = np.array(chosen.column("v").to_pylist()).reshape(chosen.num_rows, -1)
    names, code = np.unique(np.array(chosen.column("l").to_pylist()), return_inverse=True)
    if len(names) < 2:
        return spark.createDataFrame([(0.0 if len(names) else None,)], "silhouette double")
    sizes = np.bincount(code)
    held = spark.sparkContext.broadcast((x, code, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, code, sizes = held.value
        member = np.eye(len(sizes))[code]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at in range(0, len(ids), 256):
                i = ids[at : at + 256]
                d = np.zeros((len(i), len(x)))
                for c in x.T:
                    d += (c[i][:, None] - c[None, :]) ** 2
                sums = np.sqrt(d) @ member
                own, r = code[i], np.arange(len(i))
                a = sums[r, own] / np.maximum(sizes[own] - 1, 1)
                means = sums / sizes
                means[r, own] = np.inf
                b = means.min(1)
                s = np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(s)], ["s"])

    return spark.range(len(x)).repartition(max(1, len(x) // 512)).mapInArrow(run, "s double").agg(F.avg("s").alias("silhouette"))


def posterior_quality(df: DataFrame, k: int, posterior: str = "posterior") -> DataFrame:
    """One row: largest component, margin and entropy of all posteriors."""
    t = df.select(F.array_max(posterior).alias("m"), sx.top2_margin(F.col(posterior)).alias("g"), sx.entropy(F.col(posterior)).alias("h"))
    return t.agg(
        F.count("*").alias("n"), F.avg("m").alias("mean_max"), F.stddev_pop("m").alias("sd_max"), F.lit(quantiles(t, "m", [0.5])[0]).cast("double").alias("median_max"),
        F.avg((F.col("m") > 0.5).cast("double")).alias("share_05"), F.avg((F.col("m") > 0.8).cast("double")).alias("share_08"), F.avg((F.col("m") > 0.9).cast("double")).alias("share_09"),
        F.avg("g").alias("mean_margin"), F.stddev_pop("g").alias("sd_margin"), F.avg("h").alias("mean_entropy"),
        F.avg((F.col("h") > 0.95 * math.log(k)).cast("double")).alias("share_near_uniform"),
    )


def within_class_confidence(df: DataFrame, label: str = "hard", vector: str = "posterior") -> DataFrame:
    """Mean largest component and count by class, with an overall row of class -1."""
    t = df.select(F.col(label).alias("class"), F.array_max(vector).alias("m")).rollup("class").agg(F.count("*").alias("n"), F.avg("m").alias("mean_max"), F.grouping("class").alias("g"))
    return t.select(F.when(F.col("g") == 1, -1).otherwise(F.col("class")).alias("class"), "n", "mean_max")


def disagreement(df: DataFrame) -> DataFrame:
    """Rows on which two experts differ, how sure the first is there, and whom a referee sides with."""
    differ = F.col("hard_a") != F.col("hard_b")
    m, h = F.array_max("p_a"), sx.entropy_eps(F.col("p_a"))
    share = lambda cond: F.avg(F.when(differ, cond.cast("double")))
    return df.agg(
        F.count("*").alias("n_total"), F.sum(differ.cast("long")).alias("n_disagree"), F.avg(differ.cast("double")).alias("frac_disagree"),
        F.avg(F.when(differ, m)).alias("disagree_mean_maxpost"), F.avg(F.when(~differ, m)).alias("agree_mean_maxpost"),
        F.avg(F.when(differ, h)).alias("disagree_mean_entropy"), F.avg(F.when(~differ, h)).alias("agree_mean_entropy"),
        share(F.col("referee") == F.col("hard_a")).alias("sides_a"), share(F.col("referee") == F.col("hard_b")).alias("sides_b"),
        share((F.col("referee") != F.col("hard_a")) & (F.col("referee") != F.col("hard_b"))).alias("sides_neither"),
    )


def calibration(df: DataFrame, edges: Sequence[float] = (0.0, 0.5, 0.7, 0.9, 1.01)) -> DataFrame:
    """Agreement and distance of two experts by the first one's confidence; empty bins are absent."""
    m = F.array_max("p_a")
    which = F.coalesce(*[F.when((m >= lo) & (m < hi), i) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])
    t = df.select(which.alias("bin"), (F.col("hard_a") == F.col("hard_b")).cast("double").alias("same"), sx.distance(F.col("p_a"), F.col("p_b")).alias("d")).where("bin is not null")
    total = df.agg(F.count("*").alias("total"))
    by = t.groupBy("bin").agg(F.count("*").alias("n"), F.avg("same").alias("agreement"), F.avg("d").alias("mean_distance"))
    return by.crossJoin(total).select("bin", "n", (F.col("n") / F.col("total")).alias("share"), "agreement", "mean_distance")


def label_confidence(df: DataFrame, column: str) -> DataFrame:
    """Mean, median and tails of an external confidence; NaN left out."""
    c = F.col(column)
    ok = df.where(c.isNotNull() & ~F.isnan(c))
    tail = lambda t: F.avg((c > t).cast("double"))
    return ok.agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.lit(quantiles(ok, c, [0.5])[0]).cast("double").alias("median"), tail(0.5).alias("share_05"), tail(0.9).alias("share_09"), tail(0.99).alias("share_099"))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], k: int, label: str = "hard", vector: str = "posterior") -> DataFrame:
    """Rows above each threshold by class, zeros kept, with totals."""
    spark = df.sparkSession
    ts = sorted(set(float(t) for t in thresholds))
    m = F.array_max(vector)
    by = df.groupBy(F.col(label).alias("class")).agg(*[F.sum((m > t).cast("long")).alias(f"n{i}") for i, t in enumerate(ts)])
    cells = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n")) for i, t in enumerate(ts)])
    long = by.select("class", F.explode(cells).alias("c")).select("class", "c.*")
    grid = spark.range(k).select(F.col("id").cast("int").alias("class")).crossJoin(spark.createDataFrame([(t,) for t in ts], "threshold double"))
    dense = grid.join(long, ["class", "threshold"], "left").select("class", "threshold", F.coalesce("n", F.lit(0)).alias("n_particles"))
    totals = dense.groupBy("threshold").agg(F.sum("n_particles").alias("n_total_pass"))
    return dense.join(totals, "threshold").select("threshold", sx.threshold_tag(F.col("threshold")).alias("threshold_tag"), "class", "n_particles", "n_total_pass")


def threshold_totals(df: DataFrame, thresholds: Sequence[float], vector: str = "posterior") -> DataFrame:
    """Rows above each threshold and their share."""
    ts = sorted(set(float(t) for t in thresholds))
    m = F.array_max(vector)
    one = df.agg(F.count("*").alias("total"), *[F.sum((m > t).cast("long")).alias(f"n{i}") for i, t in enumerate(ts)])
    cells = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n_particles_pass"), (F.col(f"n{i}") / F.col("total")).alias("fraction_total_pass")) for i, t in enumerate(ts)])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def recall_by_class(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Recall of each class and the balanced accuracy."""
    per = df.groupBy(F.col(true).alias("class")).agg(F.count("*").alias("n"), F.avg((F.col(true) == F.col(pred)).cast("double")).alias("recall"))
    return per.crossJoin(per.agg(F.avg("recall").alias("balanced_accuracy")))


def stability(df: DataFrame) -> DataFrame:
    """Mean and largest bootstrap deviation by model (A28); model, std."""
    return df.groupBy("model").agg(F.avg("std").alias("mean_std"), F.max("std").alias("max_std"))


def referee_metrics(labellings: dict[str, DataFrame], referee: DataFrame, key: str = "uid") -> list[dict]:
    """ARI, AMI and confidence of several labellings against one referee, labels aligned first."""
    out = []
    for name, df in labellings.items():
        both = df.select(key, F.col("hard").alias("own")).join(referee.select(key, F.col("label").alias("ref"), F.array_max("resp").alias("m")), key)
        counts = contingency_local(both, "own", "ref")
        r = ari(both, "own", "ref").first()
        conf = both.agg(F.avg("m").alias("m")).first()
        out.append({"labelling": name, "ari": r.ari, "ami": ami(counts), "mean_max": conf.m, "agreement": float(sum(counts[i, j] for j, i in enumerate(align(counts)) if i < counts.shape[0]) / counts.sum())})
    return out
