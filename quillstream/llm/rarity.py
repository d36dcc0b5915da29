"""How rare tokens are over a whole corpus, for the global order of prefix filters.

Tasks count the 40-bit heads of their tokens' hashes before they send them on: a blob of distinct
heads and counts for each range of heads.  A range is counted by one task; there are more ranges the
larger the corpus is, and a task that holds many blobs of a range adds them up, so it never holds more
than the range's distinct heads, of which there are 2^40 over the number of ranges at most.

Two bounded tables come back to the driver: the ranks (logarithms of frequencies) of the most
frequent heads, and a bitmap that says of every head whether some head of its cell occurs twice or
more.  Both grow with the corpus up to fixed sizes.  Any order keeps a prefix filter right; heads
that share a cell, or a bitmap that fills up, only cost time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.storage import written

HEAD_BITS, FLUSH, HELD = 40, 1 << 20, 1 << 22
#: Bits of the number of cells: of the rank table, and the least and most of the bitmap.
RANK_BITS, LEAST_BITS, MOST_BITS = 22, 20, 28
#: The most heads that have a rank; a sixteenth of the cells, so that few others share theirs.
MOST = 1 << (RANK_BITS - 4)


@dataclass
class Rarity:
    """Ranks of the frequent heads' cells (0: none there), and the bitmap of heads that may occur twice."""

    ranks: np.ndarray
    bitmap: np.ndarray

    def rank(self, tokens: np.ndarray) -> np.ndarray:
        """4 * log2 of the frequency, rounded up, of frequent tokens; of the others 1, or 0 for those that occur once."""
        bits = len(self.ranks).bit_length() - 1
        listed = self.ranks[(tokens >> np.uint64(64 - bits)).astype(np.int64)]
        return np.where(self.may_repeat(tokens), np.maximum(listed, 1), 0).astype(np.uint8)

    def frequency(self, tokens: np.ndarray) -> np.ndarray:
        return frequency(self.rank(tokens))

    def ordered(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ascending ``tokens`` by rank, then hash; and their frequencies."""
        rank = self.rank(tokens)
        order = np.argsort(rank, kind="stable")
        return tokens[order], frequency(rank[order])

    def may_repeat(self, tokens: np.ndarray) -> np.ndarray:
        bits = len(self.bitmap).bit_length() + 2
        cell = tokens >> np.uint64(64 - bits)
        return (self.bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def frequency(rank: np.ndarray) -> np.ndarray:
    """The frequency that a rank stands for, within a quarter of an octave; it isn't below the true one of a listed token."""
    return np.ceil(np.exp2(rank / 4)).astype(np.int64) + (rank == 1)


def _blob(low: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as differences, and their counts: byte planes, which compress well."""
    both = np.concatenate([np.diff(low, prepend=np.uint32(0)), counts]).astype("<u4")
    return both.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unblob(raw: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").ravel()
    n = len(both) // 2
    return np.cumsum(both[:n], dtype=np.uint64), both[n:].astype(np.int64)


def added(heads: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct heads, ascending, with their counts' sums."""
    if len(heads) and max(int(heads.max()), int(counts.max())) < 1 << 32:  # both in one number
        both = np.sort((heads.astype(np.uint64) << np.uint64(32)) | counts.astype(np.uint64))
        heads, counts = (both >> np.uint64(32)).astype(heads.dtype), (both & np.uint64((1 << 32) - 1)).astype(counts.dtype)
    else:
        order = np.argsort(heads, kind="stable")
        heads, counts = heads[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
    return heads[first], np.add.reduceat(counts, first)


_UNITS = {"": 0, "Ki": 10, "Mi": 20, "Gi": 30, "Ti": 40, "Pi": 50, "Ei": 60}


def n_bytes(rows: DataFrame) -> int:
    """About how many bytes the rows have, by the plan's statistics; where these say nothing, by a scan of ``text``."""
    view = f"rows_{uuid.uuid4().hex}"
    rows.createTempView(view)
    try:
        plan = rows.sparkSession.sql(f"explain cost select * from {view}").head()[0]
    finally:
        rows.sparkSession.catalog.dropTempView(view)
    found = re.search(r"sizeInBytes=([0-9.E+]+) ([KMGTPE]i)?B", plan)
    size = int(float(found[1]) * (1 << _UNITS[found[2] or ""])) if found else 1 << 60
    return size if size < 1 << 44 else int(rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0)


#: Bytes of text for each part that a task holds at once; and those that are worth a task.
PART_BYTES, PIECE_BYTES = 1 << 26, 1 << 21


def n_parts(rows: DataFrame, least: int) -> int:
    """How many parts to deal the rows' words into: the session's number of shuffle partitions, ``least``, or more for large texts."""
    return max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes(rows) // PART_BYTES))


def measure(rows: DataFrame, tokens: Callable[[pa.RecordBatch], Iterator[np.ndarray]], per_token: int = 4, least: int = 3, most: int = MOST) -> Rarity:
    """Frequencies of what ``tokens`` yields for each batch of ``rows`` (64-bit hashes).

    ``per_token``: about how many bytes of the corpus there are for each distinct token.  Heads below the
    frequency ``least`` have no rank of their own.  No rows give empty tables.
    """
    size = max(1, n_bytes(rows))
    bits = min(16, max(8, (size >> 21).bit_length()))  # of the number of ranges: heads' upper bits
    map_bits = min(MOST_BITS, max(LEAST_BITS, (size // per_token).bit_length()))
    wide, low_bits = np.uint64(64 - HEAD_BITS), np.uint64(HEAD_BITS - bits)
    cells = 1 << (map_bits - bits)

    def spill(held: list[np.ndarray]) -> pa.RecordBatch:
        heads = np.sort(np.concatenate(held) >> wide)
        first = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
        counts, heads = np.diff(np.append(first, len(heads))), heads[first]
        edges = np.append(np.searchsorted(heads, np.arange(1 << bits, dtype=np.uint64) << low_bits), len(heads))
        names = np.flatnonzero(edges[1:] > edges[:-1])
        low = (heads & np.uint64((1 << int(low_bits)) - 1)).astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array([_blob(low[a:b], counts[a:b]) for a, b in zip(edges[names].tolist(), edges[names + 1].tolist(), strict=True)], pa.binary())], names=["range", "blob"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for own in tokens(batch):
                if len(own):
                    held.append(own)
                    n += len(own)
                if n >= FLUSH:
                    yield spill(held)
                    held, n = [], 0
        if held:
            yield spill(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, limit, name = 0, HELD, None

        def summed() -> tuple[np.ndarray, np.ndarray]:
            return added(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))

        def done() -> pa.RecordBatch:
            low, times = summed()
            cell = (low[times > 1] >> np.uint64(int(low_bits) - (map_bits - bits))).astype(np.int64)
            flags = np.zeros(cells, dtype=np.uint8)
            flags[cell] = 1
            keep = np.flatnonzero(times >= least)
            if len(keep) > most:  # the most frequent of all are among the most frequent here
                keep = np.sort(keep[np.argsort(-times[keep], kind="stable")[:most]])
            heads = (low[keep] | (np.uint64(name) << low_bits)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([heads], pa.list_(pa.int64())), pa.array([times[keep]], pa.list_(pa.int64())), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["range", "heads", "counts", "bitmap"])

        for batch in batches:
            blobs = batch.column(1)
            for k, own in enumerate(batch.column(0).to_pylist()):
                if own != name and held:
                    yield done()
                    held, n, limit = [], 0, HELD
                name = own
                held.append(_unblob(blobs[k].as_buffer()))
                n += len(held[-1][0])
                if n > limit:
                    held = [summed()]
                    n = len(held[0][0])
                    limit = max(HELD, 2 * n)
        if held:
            yield done()

    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(1 << bits, max(8, min(shuffles, -(-size // PIECE_BYTES))))
    spread = rows.mapInArrow(split, "range int, blob binary").repartitionById(tasks, "range").sortWithinPartitions("range")
    counted = written(spread.mapInArrow(count, "range int, heads array<bigint>, counts array<bigint>, bitmap binary"), "frequencies")
    each = counted.select(F.explode(F.arrays_zip("heads", "counts")).alias("x")).select("x.heads", F.ceil(4 * F.log2("x.counts")).cast("int").alias("rank"))
    bar, total = 0, 0
    for rank, n in sorted(((r["rank"], r["n"]) for r in each.groupBy("rank").agg(F.count("*").alias("n")).collect()), reverse=True):
        total += n
        if total > most:
            break
        bar = rank
    # of the rank that doesn't fit as a whole, none
    kept = each.where(F.col("rank") >= bar if bar else F.lit(False)).toArrow()
    ranks = np.zeros(1 << RANK_BITS, dtype=np.uint8)
    at = (kept.column("heads").to_numpy().astype(np.uint64) >> np.uint64(HEAD_BITS - RANK_BITS)).astype(np.int64)
    np.maximum.at(ranks, at, kept.column("rank").to_numpy().astype(np.uint8))
    bitmap = np.zeros(1 << (map_bits - 3), dtype=np.uint8)
    for r in counted.select("range", "bitmap").collect():
        part = np.frombuffer(r["bitmap"], np.uint8)
        bitmap[r["range"] * len(part) : (r["range"] + 1) * len(part)] = part
    return Rarity(ranks, bitmap)
