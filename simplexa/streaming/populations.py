"""Class sums kept up by a stream (an extension: the sums behind A1-A3 are additive)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_sums(stream: DataFrame, k: int, *, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window and hard class: rows and posterior sums, late rows within the watermark included."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window), "hard")
        .agg(F.count("*").alias("n"), *[F.sum(F.get("posterior", F.lit(i))).alias(f"s{i}") for i in range(k)])
    )


def confusion_of(sums: DataFrame, k: int) -> DataFrame:
    """Soft confusion i, j, value from accumulated sums."""
    cells = sums.groupBy(F.col("hard").alias("j")).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]).select("j", F.posexplode(F.array(*[f"s{i}" for i in range(k)])).alias("i", "s"))
    total = cells.groupBy("i").agg(F.sum("s").alias("t"))
    return cells.join(total, "i").select("i", "j", (F.col("s") / F.greatest("t", F.lit(1e-12))).alias("value"))
