"""Session helpers."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the package from where it lies.

    On a cluster pass the package with ``--py-files``; the path is then merely unused.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":") if env.get("PYTHONPATH") else []
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])


class Written:
    """Intermediate tables as Parquet under ``spark.checkpoint.dir``, which driver and executors share; ``drop`` removes them.

    Only where that is unset (tests on one machine) a folder of the warehouse is used.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_simplexa"
        self.spark, self.base, self.n = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:04d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
