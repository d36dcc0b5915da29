"""Numpy columns dealt among tasks by key: a shuffle of blobs in place of rows.

A task splits its columns by part and sends one blob for each part; the task that gets a part has
its columns back as arrays.  A blob keeps each column's bytes as planes, which compress well for
sorted and small numbers, and costs no work for each row.  Several tables may share a blob.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstream.llm import text as tx

BLOB = "part int, blob binary"
SCHEMA = pa.schema([("part", pa.int32()), ("blob", pa.binary())])
Columns = dict[str, np.ndarray]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    total = np.cumsum(count)
    return np.repeat(start - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)


def packed(columns: Columns) -> bytes:
    n = len(next(iter(columns.values())))
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T.tobytes() for c in columns.values()]
    return struct.pack("<q", n) + b"".join(planes)


def unpacked(blob: bytes | pa.Buffer, at: int, kinds: dict[str, str], rows: np.ndarray | None = None) -> tuple[Columns, int]:
    """A table's columns (of ``rows`` only), and where the next table begins."""
    n, out = struct.unpack_from("<q", blob, at)[0], {}
    at += 8
    for name, kind in kinds.items():
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n)
        planes = planes if rows is None else planes[:, rows]
        out[name] = np.ascontiguousarray(planes.T).view(kind).ravel()
        at += n * size
    return out, at


def deal(columns: Columns, part: np.ndarray, order: np.ndarray, count: np.ndarray | None = None, more: Columns | None = None) -> dict[int, bytes]:
    """A blob for each part; ``order`` sorts the rows by part (and may go on).

    ``more``: a second table's columns, ``count`` rows for each row of the first, in the same order.
    """
    if not len(part):
        return {}
    part = part[order]
    names, first = np.unique(part, return_index=True)
    ends = np.append(first[1:], len(part)).tolist()
    columns = {k: c[order] for k, c in columns.items()}
    blobs = [packed({k: c[a:b] for k, c in columns.items()}) for a, b in zip(first.tolist(), ends, strict=True)]
    if more is not None:
        own = count[order]
        at = ranges((np.cumsum(count) - count)[order], own)
        more = {k: c[at] for k, c in more.items()}
        edge = np.concatenate([[0], np.cumsum(own)])
        blobs = [blob + packed({k: c[edge[a] : edge[b]] for k, c in more.items()}) for blob, a, b in zip(blobs, first.tolist(), ends, strict=True)]
    return dict(zip(names.tolist(), blobs, strict=True))


def beside(*tables: tuple[dict[int, bytes], list[dict[str, str]]]) -> dict[int, bytes]:
    """Blobs of several deals (each with its tables' kinds) as one for each part."""
    none = [packed({k: np.zeros(0, kind) for k, kind in kinds[0].items()}) + b"".join(packed({k: np.zeros(0, x) for k, x in kind.items()}) for kind in kinds[1:]) for _, kinds in tables]
    return {name: b"".join(blobs.get(name, empty) for (blobs, _), empty in zip(tables, none, strict=True)) for name in sorted(set().union(*(blobs for blobs, _ in tables)))}


def rows(blobs: dict[int, bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(blobs), pa.int32()), pa.array(list(blobs.values()), pa.binary())], schema=SCHEMA)


def unused(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that none of ``taken`` has, in any case."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def gathered(blobs: DataFrame, parts: int | None, kinds: list[dict[str, str]], then: Callable[..., Iterator[pa.RecordBatch]], schema: str, most: int | None = None) -> DataFrame:
    """``then`` applied to the tables of each part, a dict of columns for each of ``kinds``.

    ``parts``: as many tasks; None if there may be so little that Spark had better choose, up to ``most``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, list[np.ndarray]]] = [{k: [] for k in kind} for kind in kinds]
        name = None

        def done() -> Iterator[pa.RecordBatch]:
            yield from then(*({k: np.concatenate(c) for k, c in table.items()} for table in held))

        for batch in batches:
            blobs_here = batch.column("blob")
            for k, own in enumerate(batch.column("part").to_pylist()):
                blob = blobs_here[k].as_buffer()  # no copy
                if name is not None and own != name:
                    yield from done()
                    held = [{k: [] for k in kind} for kind in kinds]
                name, at = own, 0
                for kind, table in zip(kinds, held, strict=True):
                    columns, at = unpacked(blob, at, kind)
                    for column, c in columns.items():
                        table[column].append(c)
        if name is not None:
            yield from done()
        held = []
        tx.release()

    dealt = blobs.repartitionById(parts, "part") if parts else blobs.repartition("part")
    return (dealt.coalesce(most) if most and not parts else dealt).sortWithinPartitions("part").mapInArrow(run, schema)
