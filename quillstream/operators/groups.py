"""Duplicate groups: connected components of pairs, and survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.session import shared_folder


def written(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the cluster's shared folder."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for all nodes of the pairs, root the least of its component.

    Large and small stars in turn: the number of rounds is logarithmic, each is one shuffle of edges.
    What the edges are joined with is dealt anew first, so both sides of a join are plain shuffles and
    Spark can split the one key that a large component's root is.
    """
    now = written(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if not state[0] or state == mark:
            break
        mark = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = written(small)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def star_pairs(rows: DataFrame, key: str, id: str) -> DataFrame:
    """Pairs (a, b) that connect all ids of one key: each with the key's least, so as many as rows."""
    return rows.where(F.col(key).isNotNull()).select(F.col(id).alias("a"), F.min(id).over(Window.partitionBy(key)).alias("b")).where("a <> b").distinct()


def survivors(members: DataFrame, group: str, id: str, *order: Column) -> DataFrame:
    """(dup, canonical): each group's first row in ``order`` survives the others."""
    first = F.first(id).over(Window.partitionBy(group).orderBy(*order))
    return members.select(F.col(id).alias("dup"), first.alias("canonical")).where("dup <> canonical")
