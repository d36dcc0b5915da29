"""Connected components of an edge table: inside partitions first, then by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.storage import written

#: Edges that a task holds before it replaces them by their components' stars; and those that are worth a task.
HELD, TASK_EDGES = 1 << 20, 1 << 17


def stars(edges: pa.Table) -> pa.Table:
    """(a, b) of every node but the least of each component, and that least node."""
    n = edges.num_rows
    ends = pa.chunked_array([*edges.column("a").chunks, *edges.column("b").chunks], edges.schema.field("a").type).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(ends.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = rank[ends.indices.to_numpy()]
    a, b, root = at[:n], at[n:], np.arange(len(order))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    node = np.flatnonzero(root != np.arange(len(root)))
    names = ends.dictionary.take(pa.array(order))
    return pa.table({"a": names.take(pa.array(node)), "b": names.take(pa.array(root[node]))}, schema=edges.schema)


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars of the same components, a > b."""
    held: list[pa.RecordBatch] = []
    n, limit = 0, HELD
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n > limit:
            held = stars(pa.Table.from_batches(held)).to_batches()
            n = sum(x.num_rows for x in held)
            limit = max(HELD, 2 * n)
    if held:
        yield from stars(pa.Table.from_batches(held)).to_batches(max_chunksize=1 << 16)


def contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars of the same components, a > b."""
    return edges.mapInArrow(contract, edges.schema)


def _few(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges of a written table in as few tasks as they are worth, and how many these are at most."""
    tasks = -(-edges.count() // TASK_EDGES) or 1
    return edges.coalesce(tasks), tasks


def _ended(edges: DataFrame) -> bool:
    """Whether each node has one edge to a lower one at most, and none if it is such a lower one."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("up")).unionAll(edges.select("b", F.lit(None).cast(edges.schema["b"].dataType)))
    each = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), (F.count("*") > F.count("up")).alias("below"))
    return not each.where("low < high or (low is not null and below)").head(1)


def components(edges: DataFrame, settled: bool = False) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the least node of its component.

    ``settled``: each partition's edges are ``contract``ed already, by the Python step that made them: one more
    would be one more worker, with its memory, beside each task's own.

    Every table of edges is first replaced by the stars of its partitions, twice, each time in as few tasks as its
    rows are worth: edges of one partition's components are settled there, and tables of ``TASK_EDGES`` need nothing
    else, however many parts they were made in (``edges`` is counted first, so it had better be written already).
    Each round then points all of a node's larger neighbours at its least one, then all its smaller
    ones, until all components are stars: about the logarithm of the largest component's size in rounds.
    Rounds are written tables, so a lost executor costs one round's work at most.  What the edges are
    joined with is dealt anew first: both sides of a join are then plain shuffles, of which Spark can
    split the one key that a large component's root is.
    """
    edges = edges.select("a", "b")
    now, tasks = _few(written(edges, "edges") if settled else edges.where("a <> b"))
    now = written(contracted(now), "edges")
    if tasks > 1:
        now, tasks = _few(now)
        now = written(contracted(now), "edges")
    while tasks > 1 and not _ended(now):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).hint("rebalance")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m")).hint("rebalance")
        small = down.join(lowest, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now, tasks = _few(written(small, "edges"))
        now = written(contracted(now), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
