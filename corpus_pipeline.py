"""The corpus pipeline: toxicity, line dedup, near-duplicate documents, personal data, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents, whatever their names.

Repeated rows, null texts and ids, and empty tables, in every stage: a null text is empty to all rules and stays
null until the stage that drops it; rows of a null doc_id are the last of all; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import columns, line_dedup, ngram_join, packing, pii, storage
from quillstream.llm import toxicity as tox


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores 0.5 or more go; texts that are null or empty stay.

    Each of repeated rows is scored alike; without documents or labels nothing goes.
    """
    labels = storage.table(spark, sf_dir, "labels")
    lexicon = tox.learn(docs, labels.where(~tox.held_out(F.col("doc_id"))))
    name = columns.unused("_toxicity", docs.columns)
    return tox.score(docs, lexicon, name).where(F.col(name) < 0.5).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of which an earlier one is similar go; documents stay, if need be empty.

    Repeated rows are equally early, so both stay whole; a null text stays null; no rows give none.
    """
    return line_dedup.dedup(docs, counts=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 on five-word shingles stays; so do those without words.

    Of repeated rows one stays, of null and other ids one with an id; no rows give none.
    """
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers, disguised ones too, are replaced by their kinds.

    Each of repeated rows is treated alike; a null text stays null; no rows give none.
    """
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token slices of documents in batches of length buckets; empty and null documents have none.

    Repeated rows are packed each; no rows give none.
    """
    import public_tokenizers

    return packing.pack(packing.tokenised(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("ngram_join", near_duplicates), ("pii", personal_data), ("packing", pack)]

#: SQL can't learn the lexicon, nor can it choose the buckets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
