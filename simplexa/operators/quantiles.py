"""Exact quantiles without sorting and without holding a column.

Each wanted rank has an interval that holds it.  A pass counts the rows of all intervals in
equal bins, with the smallest and largest value of each bin; the bin that holds the rank
becomes its interval, tightened to these values.  A rank is found once its interval is one value or
its bin is that small that the ends are the values.  Intervals shrink by the number of bins
in a pass, so that few passes are enough; only bin counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 512


def _ranks(n: int, q: float) -> tuple[int, int, float]:
    """The two neighbouring ranks and the way between them."""
    h = (n - 1) * q
    low = min(math.floor(h), n - 1)
    return low, min(low + 1, n - 1), h - low


def select(values: DataFrame, wanted: dict, start: dict, bins: int = BINS) -> dict:
    """{(group, rank): value} of ``values`` (g, x); ``start`` has (min, max, count) of each group.

    A group's rows are read again by each pass; bins of all groups and ranks, at most
    ``bins`` each, are collected, so groups are classes, not keys.
    """
    found: dict = {}
    todo = {}
    for g, ranks in wanted.items():
        lo, hi, _ = start[g]
        for r in ranks:
            todo[g, r] = (lo, hi, 0)
    spark = values.sparkSession
    while True:
        for (g, r), (lo, hi, _) in list(todo.items()):
            if lo == hi:
                found[g, r] = lo
                del todo[g, r]
        if not todo:
            return found
        intervals = sorted({(g, lo, hi) for (g, _), (lo, hi, _) in todo.items()}, key=str)
        number = {t: i for i, t in enumerate(intervals)}
        table = spark.createDataFrame([(i, *t) for i, t in enumerate(intervals)], f"i int, ig {values.schema['g'].dataType.simpleString()}, lo double, hi double")
        # halves, so that the width of the widest range is finite
        wide = F.col("hi") / 2 - F.col("lo") / 2
        at = F.when(wide > 0, F.floor((F.col("x") / 2 - F.col("lo") / 2) / wide * bins)).when(F.col("x") > F.col("lo"), bins).otherwise(0)
        inside = values.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("ig")) & F.col("x").between(F.col("lo"), F.col("hi")))  # a row a class and rank
        rows = inside.groupBy("i", F.least(at, F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i", "b").collect()
        by: dict[int, list] = {}
        for row in rows:
            by.setdefault(row.i, []).append(row)
        for (g, r), (lo, hi, below) in list(todo.items()):
            for row in by[number[g, lo, hi]]:
                if below + row.n > r:
                    if r == below or r == below + row.n - 1:  # an end of the bin
                        found[g, r] = row.lo if r == below else row.hi
                        del todo[g, r]
                    else:
                        todo[g, r] = (row.lo, row.hi, below)
                    break
                below += row.n


def by_group(df: DataFrame, column: str | Column, qs: Sequence[float], by: str | None = None) -> dict:
    """{group: [values]}: linearly interpolated quantiles; nulls and NaN are left out, a group without values has none."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    g = F.col(by) if by else F.lit(0)
    values = df.select(g.alias("g"), c.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        start = {r.g: (r.lo, r.hi, r.n) for r in values.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).collect()}
        wanted = {g: {r for q in qs for r in _ranks(n, q)[:2]} for g, (_, _, n) in start.items()}
        found = select(values, wanted, start)
    finally:
        values.unpersist()
    out = {}
    for g, (_, _, n) in start.items():
        parts = [_ranks(n, q) for q in qs]
        out[g] = [found[g, a] + (found[g, b] - found[g, a]) * t if t else found[g, a] for a, b, t in parts]
    return out


def quantiles(df: DataFrame, column: str | Column, qs: Sequence[float]) -> list[float | None]:
    """Quantiles of one column; None where it holds no value."""
    return by_group(df, column, qs).get(0, [None] * len(qs))
