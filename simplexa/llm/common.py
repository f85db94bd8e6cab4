"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simplexa.session import ship


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent (tests on one machine) the warehouse
    folder is used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_simplexa"
    return base.rstrip("/")


class Scratch:
    """Written intermediate tables in the shared folder, removed by ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        # what is written needs its shuffle files no longer
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[str] = []

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:04d}-{name}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` as Parquet and read it again."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """Write ``df`` dealt by ``key``, so that joins on it read it without a shuffle."""
        self.tables.append(table := f"{name}_{uuid.uuid4().hex}")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(buckets, key).option("path", self.path(name)).format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def forget(self, table: str) -> None:
        """Drop one bucketed table with its files."""
        self.tables.remove(table)
        location = self.spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").first().data_type
        self.spark.sql(f"DROP TABLE {table}")
        self.remove(location)

    def remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.remove(self.base)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_expr(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the Arrow batches, so that long texts stay within a worker's memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    ship(spark)
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def only(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for n in names])
