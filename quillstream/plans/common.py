"""What plans share: registration, and money as decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2024-01-31 00:00:00"


class Plans:
    """Named queries with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        """Register a function of a table loader: ``t("orders")`` is that table."""

        def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.queries[name] = lambda spark, sf_dir: f(lambda table: load(spark, sf_dir, table))
            if sql is not None:
                self.sql[name] = sql
            return f

        return register


def money(c: Column | str) -> Column:
    """Sums of decimals don't depend on the order of rows."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,4)")


def total(c: Column | str) -> Column:
    return F.sum(money(c)).cast("double")
