"""Unions, complements and selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack(parts: dict[str, DataFrame], reset_weight: bool = False, check: bool = True) -> DataFrame:
    """Disjoint per-class tables as one, with a class column."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("class", F.lit(c)) for c, df in parts.items()])
    if check and (n := duplicates(whole).first().n_duplicates):
        raise ValueError(f"{n} rows of stacked tables share a uid")
    return whole.withColumn("weight", F.lit(1.0)) if reset_weight and "weight" in whole.columns else whole


def duplicates(df: DataFrame, key: str = "uid") -> DataFrame:
    """Rows beyond the first of each key."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def membership(parts: dict[str, DataFrame], key: str = "uid") -> DataFrame:
    """uid and class of per-class files; of a uid in several, the last class wins."""
    ordered = [df.select(key).withColumn("class", F.lit(c)).withColumn("place", F.lit(i)) for i, (c, df) in enumerate(parts.items())]
    return reduce(DataFrame.unionByName, ordered).groupBy(key).agg(F.max_by("class", "place").alias("class"))


def complement(df: DataFrame, selection: DataFrame, key: str = "uid") -> DataFrame:
    """Rows that are not selected."""
    return df.join(selection.select(key), key, "left_anti")


def combine(a: DataFrame, b: DataFrame, kind: str, key: str = "row_id") -> DataFrame:
    """Union or intersection of two selections (U4)."""
    if kind not in ("union", "intersection"):
        raise ValueError(kind)
    a, b = a.select(key), b.select(key)
    return a.union(b).distinct() if kind == "union" else a.intersect(b)


def rebase(selection: DataFrame, earlier: DataFrame) -> DataFrame:
    """Numbers within a filtered selection as original row numbers (U5); ``earlier``: position, row_id."""
    return earlier.join(selection.select(F.col("row_id").alias("position")), "position").select("row_id")


def positions(selection: DataFrame, key: str = "row_id") -> DataFrame:
    """Position of each selected row in order of row number, without a global sort in one task."""
    parts = selection.repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    from pyspark.sql import Window

    w = Window.partitionBy("part").orderBy(key)
    local = parts.withColumn("nth", F.row_number().over(w) - 1)
    sizes = parts.groupBy("part").count()
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("before"))
    return local.join(before, "part").select(F.col(key), (F.col("before") + F.col("nth")).alias("position"))


def core_voxels(maps: DataFrame, level: str = "level") -> DataFrame:
    """Voxels above each map's level in every map."""
    return maps.groupBy("x", "y", "z").agg(F.bool_and(F.col("v") > F.col(level)).alias("core")).where("core").select("x", "y", "z")


def pair_mask(df: DataFrame, a: str, b: str, column: str = "class") -> DataFrame:
    """Rows of either class (U8)."""
    return df.where(F.col(column).isin(a, b))
