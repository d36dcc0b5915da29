"""Tables of a data folder, and the readers of outside formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: SRC-4: columns of a people import.
PEOPLE_SCHEMA = "first_name string, last_name string, position string, affiliation string, page_type string, url string"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_people_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV of six columns; rows with fewer are dropped, as are a byte order mark and blanks around values."""
    rows = spark.read.csv(path, header=True, schema=f"{PEOPLE_SCHEMA}, _corrupt string", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True, encoding="UTF-8")
    names = [f.name for f in StructType.fromDDL(PEOPLE_SCHEMA)]
    return rows.where(F.col("_corrupt").isNull()).select(*(F.trim(F.regexp_replace(c, "﻿", "")).alias(c) for c in names))


def read_person_files(spark: SparkSession, path: str, pattern: str = "*.rdf") -> DataFrame:
    """One row for each person file (``Key: value`` lines) below ``path``; those without names or a homepage are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)

    def field(key: str):
        return F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{key}:[ \t]*(.*)$", 1)), F.lit(""))

    keys = {"first_name": "Name-First", "last_name": "Name-Last", "full_name": "Name-Full", "workplace": "Workplace-Name", "homepage": "Homepage", "handle": "Short-Id|Handle"}
    rows = files.select(*(field(k if "|" not in k else f"(?:{k})").alias(n) for n, k in keys.items()))
    return rows.where("homepage is not null and first_name is not null and last_name is not null")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken ones are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")
