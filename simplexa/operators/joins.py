"""Joins of class tables. Strategies are left to Catalyst and AQE.

Keys are 64-bit patterns; order, where it matters, travels as an explicit ``row_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.functions import simplex as sx


def select_rows(selection: DataFrame, table: DataFrame, key: str = "uid") -> DataFrame:
    """Rows of ``table`` that are selected, others skipped."""
    return selection.select(key, *[c for c in selection.columns if c != key]).join(table, key)


def two_experts(a: DataFrame, b: DataFrame, key: str = "uid") -> DataFrame:
    """Posteriors and labels of two jobs on shared rows."""
    side = lambda df, s: df.select(key, F.col("posterior").alias(f"p_{s}"), F.col("hard").alias(f"hard_{s}"))
    return side(a, "a").join(side(b, "b"), key)


def assigned(df: DataFrame, assignment: DataFrame, column: str, key: str = "uid", missing: int = -1) -> DataFrame:
    """Left join of a label, ``missing`` where there is none."""
    return df.join(assignment.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(missing)))


def three_way(weights: DataFrame, passthrough: DataFrame, stack: DataFrame, key: str = "uid") -> DataFrame:
    """Rows present in all three tables."""
    return weights.join(passthrough, key).join(stack, key)


def by_position(left: DataFrame, right: DataFrame, strict: bool = False, row_id: str = "row_id") -> DataFrame:
    """Zip two tables by explicit row number; the shorter one decides, or with ``strict`` lengths must agree."""
    if strict and left.count() != right.count():
        raise ValueError("tables of different lengths")
    return left.join(right, row_id)


def official_or_own(df: DataFrame, official: DataFrame, key: str = "uid") -> DataFrame:
    """The official class where there is one, else the row's own."""
    o = official.select(key, F.col("class").alias("official"))
    return df.join(o, key, "left").withColumn("hard", F.coalesce("official", "hard")).withColumn("is_official", F.col("official").isNotNull()).drop("official")


def covering(df: DataFrame, partition: DataFrame, key: str = "uid") -> DataFrame | None:
    """The join, or None unless the partition covers every row."""
    if not df.join(partition, key, "left_anti").isEmpty():
        return None
    return df.join(partition, key)


def members(df: DataFrame, other: DataFrame, key: str = "uid", inside: bool = True) -> DataFrame:
    """Semi or anti join."""
    return df.join(other, key, "left_semi" if inside else "left_anti")


def with_missing_nan(df: DataFrame, other: DataFrame, column: str, key: str = "uid") -> DataFrame:
    """Left join of a number, NaN where missing; finite rows are kept by the caller."""
    return df.join(other.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(float("nan"))))


def all_pairs(df: DataFrame, index: str) -> DataFrame:
    """Pairs i < j of a class-sized table."""
    a = df.select(*[F.col(c).alias(f"{c}_i") for c in df.columns])
    b = df.select(*[F.col(c).alias(f"{c}_j") for c in df.columns])
    return a.join(F.broadcast(b), F.col(f"{index}_i") < F.col(f"{index}_j"))  # at most a few dozen classes


def nearest_centre(df: DataFrame, centres: np.ndarray, vector: str = "z", name: str = "nearest") -> DataFrame:
    """Number of the nearest of a bounded set of centres."""
    d = F.array(*[sx.distance(F.col(vector), F.array(*[F.lit(float(v)) for v in c])) for c in centres])
    return df.withColumn(name, sx.argmin(d))


def on_data(df: DataFrame, centres: np.ndarray, vector: str = "z", key: str = "uid") -> DataFrame:
    """For each centre the row nearest to it."""
    dist = [sx.distance(F.col(vector), F.array(*[F.lit(float(v)) for v in c])) for c in centres]
    best = df.agg(*[F.min_by(F.struct(key, vector), F.struct(d, F.col(key))).alias(f"b{i}") for i, d in enumerate(dist)])
    cells = F.array(*[F.struct(F.lit(i).alias("centre"), F.col(f"b{i}.{key}").alias(key), F.col(f"b{i}.{vector}").alias(vector)) for i in range(len(centres))])
    return best.select(F.explode(cells).alias("c")).select("c.*")


def grid_cell(x: str, start: float, step: float, n: int):
    """Nearest cell of a grid, halves to even, clipped."""
    return F.greatest(F.least(F.rint((F.col(x) - start) / step), F.lit(float(n - 1))), F.lit(0.0)).cast("int")


def grid_lookup(df: DataFrame, labels: np.ndarray, gx: np.ndarray, gy: np.ndarray, x: str = "pc1", y: str = "pc2", name: str = "basin") -> DataFrame:
    """The label of each row's grid cell (J15); the label table has one row a cell."""
    spark = df.sparkSession
    cells = [(int(j), int(i), int(labels[j, i])) for j in range(labels.shape[0]) for i in range(labels.shape[1])]
    table = spark.createDataFrame(cells, f"cy int, cx int, {name} int")
    keyed = df.withColumn("cx", grid_cell(x, gx[0], gx[1] - gx[0], len(gx))).withColumn("cy", grid_cell(y, gy[0], gy[1] - gy[0], len(gy)))
    return keyed.join(F.broadcast(table), ["cy", "cx"]).drop("cx", "cy")  # a fixed grid


def hungarian(cost: np.ndarray) -> list[int]:
    """Column of each row in the cheapest one-to-one assignment of a square matrix."""
    n = len(cost)
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], np.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    cur = cost[i0 - 1, j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def align(counts: np.ndarray) -> list[int]:
    """New label of each column so that the trace of the padded contingency is largest."""
    n = max(counts.shape)
    square = np.zeros((n, n))
    square[: counts.shape[0], : counts.shape[1]] = counts
    rows = hungarian(-square)
    out = [0] * n
    for i, j in enumerate(rows):
        out[j] = i
    return out[: counts.shape[1]]


def relabel(df: DataFrame, column: str, new: Sequence[int]) -> DataFrame:
    return df.withColumn(column, F.element_at(F.array(*[F.lit(int(x)) for x in new]), F.col(column) + 1))


def cross_job_axis(a: DataFrame, b: DataFrame, i: int, j: int, beta: float = 1.0, key: str = "uid") -> DataFrame:
    """Hard labels of one job with the (sharpened) posterior coordinates of another."""
    p = sx.sharpen(F.col("posterior"), beta)
    return a.select(key, "hard").join(b.select(key, F.get(p, F.lit(i)).alias("x"), F.get(p, F.lit(j)).alias("y")), key)
