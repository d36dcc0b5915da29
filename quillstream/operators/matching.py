"""Greedy one-to-one matching, best pairs first, and the likeness of a page's titles that it starts from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators.groups import written
from quillstream.session import shared_folder, small_batches

#: Pairs of a group that one task reads in order; what a larger group has beyond them goes in rounds of joins.
IN_ORDER = 1 << 22


def _in_order(pairs: DataFrame, group: str, a: str, b: str, score: str) -> DataFrame:
    """The greedy choice where a group's pairs are read in order by one task, which keeps the ends that are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, (set(), set())
        for batch in batches:
            kept = []
            for g, x, y in zip(*(batch.column(c).to_pylist() for c in (group, a, b)), strict=True):
                if g != now:
                    now, used = g, (set(), set())
                kept.append(x not in used[0] and y not in used[1])
                if kept[-1]:
                    used[0].add(x)
                    used[1].add(y)
            yield batch.filter(pa.array(kept, pa.bool_()))

    small_batches(pairs.sparkSession)
    return pairs.repartition(group).sortWithinPartitions(group, -F.col(score), a, b).mapInArrow(run, pairs.schema)


def greedy(pairs: DataFrame, group: str, a: str, b: str, score: str, in_order: int = IN_ORDER) -> DataFrame:
    """The pairs that a greedy choice takes in each group: by score descending, then a, then b, each a and each b once.

    Groups of up to ``in_order`` pairs are read in that order, whatever their ties.  In larger ones a pair that is the
    first of all its a's and of all its b's pairs is taken whatever happens before it; so a round takes all of these, and
    drops what they rule out, until so many pairs are left.  At least one pair of each large group goes in a round,
    mostly a large share of them.  Nulls are left out.
    """
    spark, paths = pairs.sparkSession, [shared_folder(pairs.sparkSession) for _ in range(2)]
    rank = F.struct((-F.col(score)).alias("s"), F.col(a).alias("a"), F.col(b).alias("b"))
    rest, rounds = written(pairs.where(" and ".join(f"`{c}` is not null" for c in (group, a, b, score)))), 0
    while True:
        large = written(rest.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > in_order).select(group))
        rest.join(large, group, "left_anti").select(pairs.columns).write.mode("append").parquet(paths[0])
        if not large.head(1):
            break
        rest = rest.join(large.hint("rebalance"), group, "left_semi").withColumn("rank", rank)
        firsts = [rest.groupBy(group, end).agg(F.min("rank").alias(f"best_{k}")) for k, end in enumerate((a, b))]
        best = rest.join(firsts[0].hint("rebalance"), [group, a]).join(firsts[1].hint("rebalance"), [group, b])
        wins = written(best.where("rank = best_0 and rank = best_1").select(pairs.columns))
        wins.write.mode("append").parquet(paths[1])
        rounds += 1
        rest = written(rest.drop("rank").join(wins.select(group, a), [group, a], "left_anti").join(wins.select(group, b), [group, b], "left_anti"))
    few, taken = (spark.read.schema(pairs.schema).parquet(p) for p in (paths if rounds else paths[:1] * 2))
    found = _in_order(few, group, a, b, score)
    return found.unionByName(taken) if rounds else found


def alike(sets: DataFrame, page: str, words: str, least: float) -> DataFrame:
    """(page, i, j, score): the pairs i < j of a page's sets whose common words are a share of ``least`` of all of theirs.

    ``words``: the page's array of arrays of distinct words.  Words are numbered, and each set is held against all
    later ones at once, so a task keeps one batch of pages and a set's row of numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner = batch.column(words).flatten()
            ids = inner.flatten().dictionary_encode()
            code, seen = ids.indices.to_numpy(zero_copy_only=False), np.zeros(len(ids.dictionary), bool)
            count = inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(count)
            last = 0
            for row, n in enumerate(batch.column(words).value_lengths().fill_null(0).to_pylist()):
                first, last = last, last + n
                filled = first + np.flatnonzero(count[first:last])  # sets without words are like none
                out, rows = [], 0
                for at, k in enumerate(filled):
                    later = filled[at + 1 :]
                    if len(later):
                        own = code[ends[k] - count[k] : ends[k]]
                        seen[own] = True
                        both = np.add.reduceat(seen[code[ends[k] : ends[later[-1]]]], ends[later] - count[later] - ends[k], dtype=np.int64)
                        seen[own] = False
                        score = both / (count[k] + count[later] - both)
                        like = score >= least
                        out.append((np.full(like.sum(), k - first), later[like] - first, score[like]))
                        rows += len(out[-1][0])
                    if out and (rows >= 1 << 16 or not len(later)):
                        i, j, score = (np.concatenate(x) for x in zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([batch.column(page).take(pa.array([row] * rows, pa.int64())), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(score)], names=[page, "i", "j", "score"])
                        out, rows = [], 0

    small_batches(sets.sparkSession)
    return sets.select(page, words).mapInArrow(run, f"`{page}` {sets.schema[page].dataType.simpleString()}, i int, j int, score double")
