"""How filters of documents interact: what each removes, alone and after others, by part of the corpus.

A document's failures are a mask of one bit a filter.  Four filters are counts over its text; the fifth
fails texts that an earlier document has.  For that, rows are range-sorted by fingerprint, full text and
doc_id and compared with their predecessors; a run of equal texts that goes on over a boundary of ranges
is settled by a few numbers of each range.  Masks then are counted by part: at most 32 additive counters
a part, from which the rows of all 120 orders of the filters follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm import text as tx
from quillstream.llm.storage import written

FILTERS = "ABCDE"
_REPEATED = 1 << FILTERS.index("E")
_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Limits:
    """A: under ``words`` words.  B: under ``distinct`` percent of them distinct.  C: over ``upper`` percent of
    the code points A-Z.  D: any of ``symbols`` (ASCII)."""

    words: int = 200
    distinct: int = 50
    upper: int = 2
    symbols: str = "#$%&*|"


def failures(column: pa.Array, limits: Limits) -> np.ndarray:
    """The bits of filters A to D of each text."""
    data, offsets = tx.buffers(column)
    n = len(offsets) - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    starts, ends, first = tx.word_bounds(data, offsets)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    # a word's hash mixed with its text's number: equal inside a text exactly for equal words
    _, at = np.unique(tx.word_hashes(data, starts, ends, fold=False) ^ tx.mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True)
    distinct = np.bincount(owner[at], minlength=n)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(limits.symbols.encode())] = True
    bits = (words < limits.words) * 1
    bits += (100 * distinct < limits.distinct * words) * 2
    bits += (100 * per_text((data >= ord("A")) & (data <= ord("Z"))) > limits.upper * per_text((data & 0xC0) != 0x80)) * 4
    bits += (per_text(symbol[data]) > 0) * 8
    return bits


def masks(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, part (source; null: empty) and mask, the bits of the filters that each row of ``docs`` fails.

    A null text is empty, and equal to empty ones.  E fails a text that a row of a smaller doc_id has;
    rows of equal ids don't fail each other, and a null doc_id is larger than all others.  Repeated rows
    are counted as often as they occur; other columns are left out; no rows give none.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # the place splits rows of one text and id (nulls, say) among ranges
    rows = rows.select("*", F.xxhash64("text").alias("f"), F.xxhash64(F.lit("second"), "text").alias("f2"), F.monotonically_increasing_id().alias("place"))
    ranged = rows.repartitionByRange("f", "f2", "id", "place").sortWithinPartitions("f", "f2", "text", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        range_no = TaskContext.get().partitionId()
        text, least, head, heads, n = None, 0, None, True, 0  # the run that goes on, and whether it is the range's first
        for batch in batches:
            for part in tx.slices(batch, "text"):
                texts, ids = part.column("text"), part.column("id").to_numpy()
                new = np.ones(len(ids), dtype=bool)
                new[1:] = ~np.asarray(pc.equal(texts[1:], texts[:-1]))
                new[0] = texts[0].as_py() != text
                start = np.flatnonzero(new)
                run = np.cumsum(new) - 1
                first = np.where(run < 0, least, ids[start[run]] if len(start) else 0)
                in_head = (run < 0) & heads if n else run == 0
                n += len(ids)
                heads = heads and bool(in_head[-1])
                text, least = texts[-1].as_py(), int(first[-1])
                head = head or (part.column("f")[0].as_py(), part.column("f2")[0].as_py())
                tail = (part.column("f")[-1].as_py(), part.column("f2")[-1].as_py())
                bits = failures(texts, limits) + np.where(first < ids, _REPEATED, 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), pa.array(bits.astype(np.int32)), pa.array(np.where(in_head, range_no, -1).astype(np.int32)), *(pa.nulls(len(ids), pa.int64()) for _ in range(5)), pa.nulls(len(ids), pa.bool_())], schema=_COMPARED)
        if n:
            edge = [pa.array([x], pa.int64()) for x in (*head, *tail, least)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.array([range_no], pa.int32()), *edge, pa.array([heads])], schema=_COMPARED)

    kind = "doc_id long, part string, mask int, range int, f long, f2 long, g long, g2 long, least long, whole boolean"
    compared = written(ranged.mapInArrow(compare, kind), "masks")
    # six numbers of each range
    edges = sorted(compared.where("least is not null").select("range", "f", "f2", "g", "g2", "least", "whole").collect())
    earlier: dict[int, int] = {}
    for before, own in zip(edges, edges[1:], strict=False):
        if (before.g, before.g2) == (own.f, own.f2):
            earlier[own.range] = earlier.get(before.range, before.least) if before.whole else before.least
    found = compared.where("least is null")
    if earlier:
        carried = spark.createDataFrame(sorted(earlier.items()), "range int, earlier long")
        found = found.join(F.broadcast(carried), "range", "left")
        late = F.coalesce(F.col("earlier") < F.coalesce("doc_id", F.lit(_LAST)), F.lit(False))
        found = found.withColumn("mask", F.when(late, F.col("mask").bitwiseOR(_REPEATED)).otherwise(F.col("mask")))
    return found.select("doc_id", "part", "mask")


_COMPARED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("range", pa.int32()), *((c, pa.int64()) for c in ("f", "f2", "g", "g2", "least")), ("whole", pa.bool_())])


def counters(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """How many documents (n), good and toxic ones each part has of each mask: numbers that add up over any split.

    A document is good or toxic if any row of ``labels`` of its doc_id says so; a null doc_id has no label.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    marked = failed.join(marks.hint("rebalance"), "doc_id", "left")
    return marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def report(counted: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; see ``audit``."""
    bits = [1 << k for k in range(len(FILTERS))]
    steps = [(before, bit) for before in range(1 << len(bits)) for bit in bits if not before & bit]
    which = F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(x).alias("bit")) for b, x in steps))).alias("s")
    each = counted.select("*", which).select("part", "mask", "n", "good", "toxic", "s.before", "s.bit")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(condition: Column, what: str | Column = "n") -> Column:
        return F.sum(F.when(condition, F.col(what) if isinstance(what, str) else what).otherwise(0)).cast("long")

    # of the orders of k failing filters, each comes first in one of k
    share = F.col("n") * F.floor(F.lit(120) / F.greatest(F.bit_count("mask"), F.lit(1)))
    summed = each.groupBy("part", "before", "bit").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"), total(fails, share).alias("shapley"),
    )
    orders = [("".join(o), k + 1, sum(1 << FILTERS.index(x) for x in o[:k]), 1 << FILTERS.index(o[k])) for o in permutations(FILTERS) for k in range(len(FILTERS))]
    listed = counted.sparkSession.createDataFrame(orders, "filter_order string, step int, before int, bit int")  # 600 rows
    return summed.join(F.broadcast(listed), ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per part, filter_order (each permutation of A to E) and step (1 to 5): documents kept after the step,
    removed by its filter, redundant (failing it, removed before), unique_fails (failing it only), good_lost and
    toxic_lost (removed here and so labelled), shapley (removed by the filter, summed over all orders).

    Each part has all 600 rows, zeros included; no documents give none.  See ``masks`` and ``counters`` for
    nulls, ties and repeated rows.
    """
    return report(counters(masks(docs, limits), labels))
