"""Shared intermediate storage: written tables in the folder the cluster names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.session import BATCH, BATCH_BYTES, small_batches  # noqa: F401
from quillstream.session import shared_folder as shared_dir

#: Spark's setting to drop a query's shuffle files as soon as the query has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame as a table in the shared folder, read again: later plans start from its files, and its shuffles are gone."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
