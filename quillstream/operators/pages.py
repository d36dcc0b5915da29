"""Pages by key: a range-clustered table whose deep pages cost what its first one does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cluster(rows: DataFrame, time: str, id: str, folder: str, ranges: int | None = None) -> None:
    """Write ``rows`` newest first in ranges of (time descending, id), each a folder, and a list of them.

    Null times come last.  ``ranges``: how many, else the session's number of shuffle partitions.
    """
    order = [F.col(time).desc_nulls_last(), F.col(id).asc_nulls_first()]
    ranged = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    ranged.withColumn("range", F.spark_partition_id()).write.partitionBy("range").parquet(f"{folder}/rows")
    listed = rows.sparkSession.read.parquet(f"{folder}/rows").groupBy("range").agg(F.count("*").alias("n"), F.min(time).alias("oldest"), F.max(time).alias("newest"), F.count_if(F.col(time).isNull()).alias("nulls"))
    listed.coalesce(1).write.parquet(f"{folder}/ranges")


def page(spark: SparkSession, folder: str, time: str, id: str, size: int, after: tuple | None = None) -> DataFrame:
    """The ``size`` rows after the one whose (time, id) is ``after`` (None: the first ones), newest first.

    Only the ranges are read that may hold them: those from the cursor's on, as many as have ``size`` rows beyond the
    first few, which the cursor's time may fill.  Rows without a time follow a cursor of None as its time.
    """
    listed = spark.read.parquet(f"{folder}/ranges")
    if after is not None and after[0] is not None:
        listed = listed.where((F.col("oldest") <= F.lit(after[0])) | (F.col("nulls") > 0))
    elif after is not None:
        listed = listed.where("nulls > 0")
    most = 2
    while True:
        some = listed.orderBy("range").limit(most).collect()
        # ranges that the cursor's time fills, or begins, may have nothing left
        whole = sum(r.n for r in some if after is None or (after[0] is not None and (r.newest is None or r.newest < after[0])))
        if whole >= size or len(some) < most:
            break
        most *= 2
    rows = spark.read.parquet(f"{folder}/rows").where(F.col("range").isin([r.range for r in some])).drop("range")
    if after is not None:
        t, i = after
        later = F.col(time).isNull() & (F.col(id) > F.lit(i)) if t is None else (F.col(time) < F.lit(t)) | F.col(time).isNull() | ((F.col(time) == F.lit(t)) & (F.col(id) > F.lit(i)))
        rows = rows.where(later)
    return rows.orderBy(F.col(time).desc_nulls_last(), F.col(id).asc_nulls_first()).limit(size)
