"""Exact ranks without a global sort in one task.

Rows fall into ranges by their order value alone, so that a row's range never depends on how
it was read.  Rows are counted by range, the counts are summed over the ranges before (a
table of a row a range and class), and a window ranks within a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows of a range, about
RANGE_ROWS = 250_000


def _before(sizes: DataFrame, *by: str) -> DataFrame:
    """Rows in the ranges before each, by class."""
    w = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")


def permutation(df: DataFrame, *, key: str = "uid", seed: int = 0, by: str | None = None, name: str = "rank", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``name``: each row's place, from 0, in a random order that depends on key and seed only; with ``by``, within its class.

    Keys are distinct; rows of one key have neighbouring places in no stated order.
    """
    bits = max(0, (df.count() - 1) // range_rows).bit_length()
    h = F.xxhash64(key, F.lit(seed))
    t = df.withColumn("_h", h).withColumn("range", F.shiftrightunsigned("_h", 64 - bits).cast("int") if bits else F.lit(0)).withColumn("_by", F.col(by) if by else F.lit(0))
    sizes = t.groupBy("_by", "range").agg(F.count("*").alias("n"))
    # unsigned order of the hash, as the ranges have it
    local = F.row_number().over(Window.partitionBy("_by", "range").orderBy(F.col("_h") < 0, "_h", key)) - 1
    before = _before(sizes, "_by").select(F.col("_by").alias("_b"), F.col("range").alias("_r"), "before")
    ranked = t.withColumn("_n", local).join(before, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("range") == F.col("_r")))
    return ranked.withColumn(name, F.col("before") + F.col("_n")).select(*[F.col(f"`{c}`") for c in df.columns], name)


def running(df: DataFrame, order: str, value: str | Column, name: str = "cum", ranges: int | None = None) -> DataFrame:
    """``name``: the sum of ``value`` over all rows up to this one in the order of a numeric column without ties."""
    n = ranges or df.count() // RANGE_ROWS + 1
    cuts = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10_000).alias("c")).first().c if n > 1 else []
    place = F.lit(0)
    for c in sorted(set(cuts or [])):
        place = place + F.when(F.col(order) >= F.lit(c), 1).otherwise(0)
    t = df.withColumn("range", place).withColumn("_v", F.col(value) if isinstance(value, str) else value)
    before = _before(t.groupBy(F.lit(0).alias("_one"), "range").agg(F.sum("_v").alias("n")), "_one").select("range", "before")  # a row a range
    local = F.sum("_v").over(Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("_s", local).join(F.broadcast(before), "range").withColumn(name, F.col("before") + F.col("_s")).drop("range", "before", "_v", "_s")
