"""Periodic runs of words: Karp-Miller-Rosenberg naming, one batch of documents at a time.

Names of level l tell the stretches of 2**l words of one document apart: level 0 names words, and a
level's names are the ranks of pairs of names of the level below.  A stretch that occurs once in its
document has no name (-1), so ever fewer places are named as levels rise, and levels end when none is left.

A run of period q and length 4 * q or more covers the first multiple i of q inside it so that the words
from i and those from i + q agree for 2 * q + 1 words at least.  So places i = 0, q, 2q, ... of each
document are candidates if their names at the level of 2 * q + 1 words agree.  Each candidate is
extended to both sides by descending levels, a power of two words at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import text as tx
from quillstream.llm.columns import ranges

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal exactly for equal words."""
    size = ends - starts
    edges = np.concatenate([[0], np.cumsum(size)])
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(data[ranges(starts, size)].tobytes())])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def levels(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Names of all levels that have any; ``first``: each document's first word (m + 1 entries)."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out: list[np.ndarray] = []
    at, key, width = np.arange(len(words)), doc * (int(words.max(initial=0)) + 1) + words, 1
    while len(at):
        _, name, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = count[name] > 1
        at, name = at[twice], name[twice]
        if not len(at):
            break
        named = np.full(len(words), -1, np.int32)
        named[at] = name
        out.append(named)
        at = at[at + width < len(words)]
        at = at[(named[at + width] >= 0) & (doc[np.minimum(at + width, len(words) - 1)] == doc[at])]
        key = named[at].astype(np.int64) * len(words) + named[at + width]
        width *= 2
    return out


def _agree(named: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (named[a] >= 0) & (named[a] == named[b])


def runs(words: np.ndarray, first: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start (in it), length and period of every run, by document, start and period.

    A run is a stretch with the smallest period q and of max(least_words, least_periods * q) words or more
    that no neighbouring word extends keeping the period; ``least_periods`` is 4 or more.
    """
    named = levels(words, first)
    count = np.diff(first)
    found: list[tuple[np.ndarray, ...]] = []
    for level in range(1, len(named)):
        own, width = named[level], 1 << level
        live = np.bincount(np.searchsorted(first, np.flatnonzero(own >= 0), "right") - 1, minlength=len(count)) > 0
        # periods of this level: 2**l <= 2q + 1 < 2**(l + 1)
        low, high = width // 2, np.minimum(width - 1, count // least_periods)
        docs = np.flatnonzero(live & (high >= low))
        if not len(docs):
            continue
        n_periods = high[docs] - low + 1
        q, d = ranges(np.full(len(docs), low), n_periods), np.repeat(docs, n_periods)
        grid = np.maximum(0, (count[d] - q - width) // q + 1)
        step = ranges(np.zeros(len(q), np.int64), grid)
        q, d = np.repeat(q, grid), np.repeat(d, grid)
        i = first[d] + step * q
        hit = _agree(own, i, i + q)
        if hit.any():
            found.append((d[hit], i[hit], q[hit]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    d, i, q = (np.concatenate(c) for c in zip(*found, strict=True))
    ahead, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for level in range(len(named) - 1, -1, -1):
        own, width = named[level], 1 << level
        at = np.flatnonzero(i + q + ahead < first[d + 1])
        ahead[at[_agree(own, (i + ahead)[at], (i + q + ahead)[at])]] += width
        at = np.flatnonzero(i - back - width >= first[d])
        back[at[_agree(own, (i - back - width)[at], (i + q - back - width)[at])]] += width
    start, length = i - back - first[d], back + ahead + q
    long = length >= np.maximum(least_words, least_periods * q)
    d, start, length, q = d[long], start[long], length[long], q[long]
    # candidates of one run meet, and so do multiples of its period: the smallest is the run's
    order = np.lexsort((q, length, start, d))
    d, start, length, q = d[order], start[order], length[order], q[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    d, start, length, q = d[new], start[new], length[new], q[new]
    order = np.lexsort((q, start, d))
    return d[order], start[order], length[order], q[order]


def collapsed(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    n = len(first) - 1
    last = np.full(n, -1)
    doc = np.repeat(np.arange(n), np.diff(first))
    kept = np.flatnonzero(keep)
    last[doc[kept]] = kept  # of repeated places, the last one stays
    edge = np.zeros(len(data) + 2, np.int8)
    edge[starts[kept]] += 1
    between = kept != last[doc[kept]]  # a white space follows, as another word does
    np.subtract.at(edge, ends[kept] + between, 1)
    out = data.copy()
    out[ends[kept[between]]] = 0x20
    inside = np.cumsum(edge[: len(data)]) > 0
    total = np.concatenate([[0], np.cumsum(inside)])
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(total[offsets].astype(np.int64)), pa.py_buffer(out[inside].tobytes())])


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed: the words, joined by one space, without
    those that a run has after its first period.

    Words are runs of other characters than white space, told apart by case and numbered from 0.  One row for
    each row of ``docs``, repeated ones too; a null text is empty (no words, no runs, an empty text); a null
    doc_id stays null; other columns are left out; no rows give none.  A text of any length is taken as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                data, offsets = tx.buffers(part.column("text"))
                starts, ends, first = tx.word_bounds(data, offsets)
                d, start, length, period = runs(word_names(data, starts, ends), first, least_words, least_periods)
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, first[d] + start + period, 1)
                np.subtract.at(edge, first[d] + start + length, 1)
                text = collapsed(data, offsets, starts, ends, first, np.cumsum(edge[:-1]) == 0)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=part.num_rows))]).astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(bounds), each), text.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def strongest(runs: str) -> F.Column:
    """The run of the greatest length / period, compared exactly; of ties the first, then the shortest period."""
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(F.col(runs), F.get(F.col(runs), 0), lambda best, x: F.when(better(x, best), x).otherwise(best))
