"""A bitmap of a table's hashes, sized by the table, to skip rows early before an exact join."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.text import mix

#: A row's cell has so many bits; a bitmap uses the upper ones, as many as its table needs.  Beyond
#: some 2^26 keys it is full size (64 MB) and lets ever more rows through, which costs only time.
CELL_BITS, LEAST_BITS, RANGE_BITS = 29, 16, 8
#: Rows that are worth a task to pack them, and bytes of bitmaps that are worth one to merge them.
TASK_ROWS, TASK_BYTES = 1 << 17, 1 << 18


@dataclass
class Flags:
    """The flags of cells in which a row lies."""

    bits: int
    flags: np.ndarray

    def inside(self, cells: np.ndarray) -> np.ndarray:
        cells = cells >> (CELL_BITS - self.bits)
        return (self.flags[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def cell(*columns: str) -> Column:
    """A row's cell, from the hash of its key."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - CELL_BITS).cast("int")


def bitmap(rows: DataFrame, *columns: str) -> Flags:
    """Of the keys in ``columns``."""
    return _collected(rows.select(cell(*columns).alias("cell")), [lambda batch: batch.column(0).to_numpy()])[0]


def pair_cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cells of pairs of integers, for keys that tasks make themselves."""
    mixed = mix(mix(a.astype(np.int64).view(np.uint64)) + b.astype(np.int64).view(np.uint64))
    return (mixed >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def pair_bitmap(rows: DataFrame) -> Flags:
    """The flags of a table of two integer columns, by ``pair_cells``."""
    return _collected(rows, [_ends(0)])[0]


def end_bitmaps(pairs: DataFrame) -> list[Flags]:
    """Of a table (x, x line, y, y line) in one pass: ``pair_cells`` of the x ends, those of the y ends, and ``cell`` of x or y."""
    a, _, b, _ = pairs.columns
    rows = pairs.withColumns({"cell_x": cell(a), "cell_y": cell(b)})
    return _collected(rows, [_ends(0), _ends(2), lambda batch: np.concatenate([batch.column(4).to_numpy(), batch.column(5).to_numpy()])])


def _ends(k: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    return lambda batch: pair_cells(batch.column(k).to_numpy(), batch.column(k + 1).to_numpy())


def _collected(rows: DataFrame, kinds: list[Callable[[pa.RecordBatch], np.ndarray]]) -> list[Flags]:
    """A bitmap for each of ``kinds``, which give cells of a batch; few rows are packed and merged in few tasks."""
    n = rows.count()
    bits = min(CELL_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    size, shift = 1 << (bits - RANGE_BITS), CELL_BITS - bits

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: dict[int, np.ndarray] = {}
        for batch in batches:
            for kind, cells_of in enumerate(kinds):
                cells = np.unique(cells_of(batch) >> shift)
                names, first = np.unique(cells >> (bits - RANGE_BITS), return_index=True)
                for name, inner in zip(names.tolist(), np.split(cells & (size - 1), first[1:]), strict=True):
                    own = flags.setdefault(kind << RANGE_BITS | name, np.zeros(size >> 3, np.uint8))
                    np.bitwise_or.at(own, inner >> 3, (1 << (inner & 7)).astype(np.uint8))
        if flags:
            yield pa.RecordBatch.from_arrays([pa.array(list(flags), pa.int32()), pa.array([f.tobytes() for f in flags.values()], pa.binary())], names=["range", "flags"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flags[name] = flags.get(name, 0) | np.frombuffer(raw, np.uint8)
        if flags:
            yield pa.RecordBatch.from_arrays([pa.array(list(flags), pa.int32()), pa.array([f.tobytes() for f in flags.values()], pa.binary())], names=["range", "flags"])

    kind = "range int, flags binary"
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros((len(kinds), 1 << (bits - 3)), dtype=np.uint8)
    merging = min(1 << RANGE_BITS, shuffles, -(-out.size // TASK_BYTES))
    for r in rows.coalesce(-(-n // TASK_ROWS) or 1).mapInArrow(pack, kind).repartitionById(merging, "range").mapInArrow(merge, kind).collect():
        part = np.frombuffer(r["flags"], np.uint8)
        out.reshape(-1)[r["range"] * len(part) : (r["range"] + 1) * len(part)] |= part
    return [Flags(bits, flags) for flags in out]
