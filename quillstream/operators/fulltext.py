"""An inverted index as a table, and searches for any of some words that read only those words' blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import values as V

#: Shorter words aren't indexed; so many folders; ids of one block differ in this many lower bits.
LEAST, BUCKETS, BLOCK_BITS = 3, 64, 16
_OPERATORS = r"""[+\-~<>()@*"]"""


def terms(text: Column, least: int = LEAST) -> Column:
    """The distinct words of a text that are indexed: lower case, ``least`` letters or more, no stop words."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda w: F.length(w) >= least)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*V.INDEX_STOPWORDS)))


def build(docs: DataFrame, folder: str, least: int = LEAST, buckets: int = BUCKETS) -> None:
    """Write the index of ``docs`` (id, text) below ``folder``: a row for each word and block of ids.

    Words are dealt to folders by hash and sorted there, so a search opens its words' folders and, by the
    files' statistics, their row groups only.  A block holds the ids of a word that differ in their lower 16 bits,
    as gaps: a word that all documents have makes rows of 65,536 ids at most.  Null ids aren't indexed.
    """
    words = docs.where("id is not null").select("id", F.explode(terms(F.col("text"), least)).alias("term"))
    block = F.shiftright("id", BLOCK_BITS)
    rows = words.groupBy("term", block.alias("block")).agg(F.sort_array(F.collect_set(F.col("id").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int"))).alias("ids"))
    gaps = F.zip_with("ids", F.concat(F.array(F.lit(0)), F.slice("ids", F.lit(1), F.size("ids") - 1)), lambda x, before: x - before)
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    dealt = rows.select("term", "block", gaps.alias("gaps"), bucket.alias("bucket")).repartition("bucket", "block")
    dealt.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(folder)


def parse(query: str, least: int = LEAST) -> list[str]:
    """The words that a query asks for: operators are stripped; short and stop words don't count."""
    words = re.split(r"\W+", re.sub(_OPERATORS, " ", query).lower())
    return sorted({w for w in words if len(w) >= least and w not in V.INDEX_STOPWORDS})


def postings(spark: SparkSession, folder: str, words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(term, id) of the words, from their blocks."""
    asked = spark.createDataFrame([(w,) for w in words], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("b"))
    folders = sorted({r.b for r in asked.collect()})  # of the query's words
    rows = spark.read.schema("term string, block bigint, gaps array<int>, bucket int").parquet(folder).where(F.col("bucket").isin(folders) & F.col("term").isin(words))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = batch.column("gaps")
            size, flat = gaps.value_lengths().to_numpy(), gaps.flatten().to_numpy().astype(np.int64)
            total = np.cumsum(flat)
            first = np.cumsum(size) - size
            start = np.where(first > 0, total[np.maximum(first, 1) - 1] if len(total) else 0, 0)
            base = (batch.column("block").to_numpy() << BLOCK_BITS) - start
            at = np.repeat(np.arange(len(size)), size)
            yield pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(at)), pa.array(total + base[at])], names=["term", "id"])

    return rows.select("term", "block", "gaps").mapInArrow(ids, "term string, id long")


def search(spark: SparkSession, folder: str, query: str, docs: DataFrame | None = None) -> DataFrame:
    """id of the documents that have any of the query's words.

    A query of short words only is looked for as a part of the texts of ``docs`` (id, text), without regard to case;
    an empty one, or where there are no ``docs``, finds none.
    """
    words = parse(query)
    if words:
        return postings(spark, folder, words).select("id").distinct()
    bare = re.sub(_OPERATORS, " ", query).strip().lower()
    if docs is None or not bare:
        return spark.createDataFrame([], "id long")
    return docs.where(F.contains(F.lower("text"), F.lit(bare))).select(F.col("id").cast("long").alias("id"))
