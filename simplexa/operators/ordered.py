"""Ordered analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simplexa.operators.quantiles import by_group, quantiles
from simplexa.operators.ranks import permutation, running


def quantile_cut(df: DataFrame, column: str, k: int, name: str = "cut") -> DataFrame:
    """Equal-population classes by interpolated quantile edges; ties stay together."""
    cut = F.lit(0)
    for edge in quantiles(df, column, [i / k for i in range(1, k)]):
        cut = cut + F.when(F.col(column) >= F.lit(edge).cast("double"), 1).otherwise(0)
    return df.withColumn(name, cut)


def turning_points(grid: DataFrame, order: str, value: str) -> DataFrame:
    """Local minima and maxima of a curve; flats carry the last slope forward."""
    w = Window.orderBy(order)  # a curve of a few hundred points
    sign = F.signum(F.col(value) - F.lag(value).over(w))
    s = grid.withColumn("s", F.last(F.when(sign != 0, sign), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nxt = F.lead("s").over(w)
    kind = F.when((F.col("s") < 0) & (nxt > 0), "min").when((F.col("s") > 0) & (nxt < 0), "max")
    return s.withColumn("kind", kind).where("kind is not null").drop("s")


def modes(grid: DataFrame, order: str, value: str, share: float = 0.02) -> DataFrame:
    """Local maxima above a share of the largest value."""
    w = Window.orderBy(order)
    peak = (F.col(value) > F.lag(value).over(w)) & (F.col(value) >= F.lead(value).over(w))
    return grid.withColumn("peak", peak).crossJoin(grid.agg(F.max(value).alias("top"))).where(F.col("peak") & (F.col(value) > share * F.col("top"))).drop("peak", "top")


def first_below(curve: DataFrame, order: str, value: str, threshold: float, interpolate: bool = True) -> DataFrame:
    """Where a curve first falls below a threshold."""
    w = Window.orderBy(order)
    t = curve.withColumn("pv", F.lag(value).over(w)).withColumn("po", F.lag(order).over(w)).where(F.col(value) < threshold)
    at = F.when(F.lit(interpolate) & F.col("pv").isNotNull(), F.col("po") + (F.col("pv") - threshold) / (F.col("pv") - F.col(value)) * (F.col(order) - F.col("po"))).otherwise(F.col(order))
    return t.agg(F.min_by(at, order).alias("crossing"))


def first_stable(series: DataFrame, epoch: str = "epoch", corr: str = "corr", level: float = 0.95) -> DataFrame:
    """First epoch at or above a level."""
    return series.agg(F.min(F.when(F.col(corr) >= level, F.col(epoch))).alias("first_epoch"))


def loss_tail(log: DataFrame, n: int = 20, epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """Relative change of the loss over its last n epochs."""
    tail = log.orderBy(F.col(epoch).desc()).limit(n)
    agg = tail.agg(F.min_by(loss, epoch).alias("first"), F.max_by(loss, epoch).alias("last"), F.min(loss).alias("lo"), F.max(loss).alias("hi"), F.count("*").alias("n"))
    return agg.select("n", "first", "last", ((F.col("hi") - F.col("lo")) / F.abs("last")).alias("relative_range"))


def conditional_means(df: DataFrame, axis: str, vector: str, d: int, centres: Sequence[float], half: float, minimum: int = 200) -> DataFrame:
    """Mean vector in bins closed on both ends around each centre; where a bin is sparse, of the nearest ``minimum`` rows."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(c)) for i, c in enumerate(centres)], "bin int, centre double")
    means = [F.avg(F.get(vector, F.lit(i))).alias(f"m{i}") for i in range(d)]
    hit = df.join(F.broadcast(bins), F.col(axis).between(F.col("centre") - half, F.col("centre") + half))  # a few dozen bins
    full = hit.groupBy("bin").agg(F.count("*").alias("n"), *means).where(F.col("n") >= minimum)
    out = full.select("bin", F.array(*[f"m{i}" for i in range(d)]).alias("mean"), "n")
    have = {r.bin for r in out.select("bin").collect()}
    for i, c in enumerate(centres):
        if i not in have:
            near = df.orderBy(F.abs(F.col(axis) - float(c))).limit(minimum)
            out = out.unionByName(near.agg(F.count("*").alias("n"), *means).select(F.lit(i).alias("bin"), F.array(*[f"m{j}" for j in range(d)]).alias("mean"), "n"))
    return out


def class_order(df: DataFrame, axis: str = "pc1", label: str = "hard") -> DataFrame:
    """Mean, median and deviation of an axis by class, and the classes' order along it."""
    t = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"), F.avg(axis).alias("mean"), F.stddev_pop(axis).alias("sd"))
    medians = df.sparkSession.createDataFrame([(c, m[0]) for c, m in by_group(df, axis, [0.5], label).items()], f"_c {t.schema['class'].dataType.simpleString()}, median double")
    t = t.join(F.broadcast(medians), F.col("class").eqNullSafe(F.col("_c")), "left").select("class", "n", "mean", "median", "sd")  # a row a class
    return t.withColumn("order", (F.row_number().over(Window.orderBy("mean", "class")) - 1).cast("int"))  # one row a class


def split_half(df: DataFrame, seed: int = 0, key: str = "uid") -> DataFrame:
    """Alternating places of a seeded permutation: halves that differ by at most one row."""
    return permutation(df, key=key, seed=seed, name="_place").withColumn("half", (F.col("_place") % 2).cast("int")).drop("_place")


def folds(df: DataFrame, k: int = 5, seed: int = 0, key: str = "uid", label: str | None = None) -> DataFrame:
    """k folds that differ by at most one row, with ``label`` in every class."""
    return permutation(df, key=key, seed=seed, by=label, name="_place").withColumn("fold", (F.col("_place") % k).cast("int")).drop("_place")


def orientation(df: DataFrame, axis: str = "pc1", label: str = "hard") -> DataFrame:
    """-1 where class means fall along the class number, else 1."""
    means = df.groupBy(F.col(label).cast("double").alias("c")).agg(F.avg(axis).alias("m"))
    return means.agg(F.when(F.regr_slope("m", "c") < 0, -1).otherwise(1).alias("sign"))


def same_direction(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of two axes and the sign that aligns them."""
    return df.agg(F.corr(a, b).alias("corr")).withColumn("sign", F.when(F.col("corr") < 0, -1).otherwise(1))


def correlations(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns."""
    cells = df.agg(*[F.corr(a, b).alias(f"r{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right)])
    return cells.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}_{j}").alias("corr")) for i, a in enumerate(left) for j, b in enumerate(right)])).alias("c")).select("c.*")


def epoch_stability(df: DataFrame, epoch: str = "epoch", value: str = "pc1", final: str = "final") -> DataFrame:
    """Absolute correlation of each epoch's axis with the final one."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(epoch).agg(F.abs(F.corr(value, final)).alias("corr"), F.count("*").alias("n"))


def evenly_spaced(df: DataFrame, n: int, key: str = "uid") -> DataFrame:
    """About n rows, evenly spaced in order of key."""
    from simplexa.operators.setops import positions

    p = positions(df, key)
    total = p.count()
    step = max(total / n, 1.0)
    return df.join(p.where(F.floor(F.col("position") / step) != F.floor((F.col("position") - 1) / step)), key)


def top(df: DataFrame, column: str, n: int, key: str = "uid") -> DataFrame:
    """The n largest; of equal ones those with the smaller key."""
    return df.orderBy(F.col(column).desc(), key).limit(n)


def latest(df: DataFrame, name: str = "name", pattern: str = r"(\d+)") -> DataFrame:
    """The entry with the largest number in its name."""
    return df.agg(F.max_by(name, F.regexp_extract(name, pattern, 1).cast("long")).alias(name))


def ecdf_gap(df: DataFrame, column: str) -> DataFrame:
    """Largest gap of the empirical distribution from the uniform one on its range."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    b = n.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.sum("n").alias("total"))
    run = running(n, column, "n")
    return run.crossJoin(b).agg(F.max(F.abs(F.col("cum") / F.col("total") - (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")))).alias("gap"))
