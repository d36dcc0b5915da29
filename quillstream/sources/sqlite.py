"""SQLite tables as a Spark data source: one file, or a folder of files that a distributed write made.

``register(spark)`` once a session; then ``format("sqlite_rows")`` with the options
``path`` and ``table``, for reads ``partitions`` (of each file's row ids, 4 unless given).
"""

from __future__ import annotations

import json
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as Y
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_KINDS = {"INTEGER": "bigint", "BIGINT": "bigint", "INT": "bigint", "REAL": "double", "DOUBLE": "double", "BLOB": "binary", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}
#: Rows of one insert.
BATCH = 5000


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _local(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError("SQLite files need a mounted folder that all executors share")
    return path.removeprefix("file://")


def files(path: str) -> list[str]:
    """The file itself, or those of a folder that were committed."""
    if not os.path.isdir(path):
        return [path]
    lists = sorted(f for f in os.listdir(path) if f.startswith("_committed-"))
    return [os.path.join(path, name) for f in lists for name in json.loads(open(os.path.join(path, f)).read())]


def _stored(v):
    return v.isoformat(" ") if isinstance(v, datetime) else v.isoformat() if isinstance(v, date) else str(v) if isinstance(v, Decimal) else int(v) if isinstance(v, bool) else v


def _loaded(v, kind: Y.DataType):
    if v is None:
        return None
    if isinstance(kind, Y.TimestampType | Y.TimestampNTZType):
        return datetime.fromisoformat(v)
    if isinstance(kind, Y.DateType):
        return date.fromisoformat(v)
    if isinstance(kind, Y.DecimalType):
        return Decimal(v)
    return bool(v) if isinstance(kind, Y.BooleanType) else v


@dataclass
class Range(InputPartition):
    file: str
    low: int
    high: int  # exclusive


class SqliteReader(DataSourceReader):
    """Reads ranges of row ids; comparisons of columns with plain values run in SQLite, by its indexes."""

    def __init__(self, path: str, table: str, partitions: int, schema: Y.StructType):
        self.path, self.table, self.partitions_, self.schema = path, table, partitions, schema
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Gives back the filters that Spark has to apply itself."""
        plain = {f.name for f in self.schema if isinstance(f.dataType, Y.IntegralType | Y.StringType | Y.DoubleType)}
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name not in plain:
                yield f
            elif type(f) in _COMPARED:
                self.where.append(f"{_quoted(name)} {_COMPARED[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, In) and None not in f.value:
                self.where.append(f"{_quoted(name)} in ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif isinstance(f, IsNull | IsNotNull):
                self.where.append(f"{_quoted(name)} is {'not ' if isinstance(f, IsNotNull) else ''}null")
            else:
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for file in files(self.path):
            with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as con:
                low, high = con.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
            if low is not None:
                step = -(-(high + 1 - low) // self.partitions_)
                out += [Range(file, a, min(a + step, high + 1)) for a in range(low, high + 1, step)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.file:
            return
        where = " and ".join(["rowid >= ? and rowid < ?", *self.where])
        kinds = [f.dataType for f in self.schema]
        with sqlite3.connect(f"file:{partition.file}?mode=ro", uri=True) as con:
            for row in con.execute(f"select {', '.join(_quoted(f.name) for f in self.schema)} from {_quoted(self.table)} where {where}", [partition.low, partition.high, *self.values]):
                yield tuple(_loaded(v, kind) for v, kind in zip(row, kinds, strict=True))


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class SqliteWriter(DataSourceWriter):
    """Each task writes a file of its own; a list of the files is put beside them when all are there.

    A task that runs twice leaves two files, of which the list names one; readers see listed files only.
    """

    def __init__(self, path: str, table: str, schema: Y.StructType, overwrite: bool):
        self.path, self.table, self.schema, self.overwrite = path, table, schema, overwrite
        os.makedirs(path, exist_ok=True)

    def _kind(self, kind: Y.DataType) -> str:
        known = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
        return known.get(kind.simpleString(), "TEXT")

    def write(self, iterator: Iterator[Row]) -> Written:
        name = f"part-{uuid.uuid4().hex}.sqlite"
        columns = ", ".join(f"{_quoted(f.name)} {self._kind(f.dataType)}" for f in self.schema)
        n, held = 0, []
        con = sqlite3.connect(os.path.join(self.path, name))
        try:
            con.execute(f"create table {_quoted(self.table)} ({columns})")
            insert = f"insert into {_quoted(self.table)} values ({', '.join('?' * len(self.schema))})"
            for row in iterator:
                held.append(tuple(map(_stored, row)))
                if len(held) == BATCH:
                    con.executemany(insert, held)
                    n, held = n + len(held), []
            con.executemany(insert, held)
            con.commit()
        finally:
            con.close()
        return Written(name, n + len(held))

    def commit(self, messages: list[Written | None]) -> None:
        before = [f for f in os.listdir(self.path) if f.startswith("_committed-")]
        number = 1 + max((int(f.split("-")[1]) for f in before), default=0)
        draft = os.path.join(self.path, f".draft-{uuid.uuid4().hex}")
        with open(draft, "w") as out:
            out.write(json.dumps(sorted(m.file for m in messages if m is not None and m.rows)))
        os.rename(draft, os.path.join(self.path, f"_committed-{number:06d}"))
        for f in before if self.overwrite else []:
            os.remove(os.path.join(self.path, f))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                os.remove(os.path.join(self.path, m.file))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def _at(self) -> tuple[str, str]:
        return _local(self.options["path"]), self.options["table"]

    def schema(self) -> str:
        path, table = self._at()
        with sqlite3.connect(f"file:{files(path)[0]}?mode=ro", uri=True) as con:
            return ", ".join(f"`{name}` {_KINDS.get(kind.upper(), 'string')}" for _, name, kind, *_ in con.execute(f"pragma table_info({_quoted(table)})"))

    def reader(self, schema: Y.StructType) -> SqliteReader:
        return SqliteReader(*self._at(), int(self.options.get("partitions", 4)), schema)

    def writer(self, schema: Y.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(*self._at(), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known, and let Spark hand it filters."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
