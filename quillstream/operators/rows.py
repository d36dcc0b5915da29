"""Writes as table-to-table operators, windows, and the joins and searches built on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import values as V


def insert_if_absent(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """Rows of ``old`` and those of ``new`` whose key it lacks; of new rows with one key, the first in ``order``."""
    first = new.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*(order or key)))).where("__n = 1").drop("__n")
    return old.unionByName(first.join(old.select(*key), list(key), "left_anti").select(old.columns))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks."""
    return new.unionByName(old.join(new.select(*key).distinct(), list(key), "left_anti").select(new.columns))


def replace_set(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """All of a key's rows replaced by those of ``new``; the same plan as an upsert, with many rows a key."""
    return upsert(old, new, key)


def backfill(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``old`` with nulls in ``columns`` filled from the row of ``new`` with its key."""
    other = new.select(*key, *(F.col(c).alias(f"__{c}") for c in columns))
    filled = {c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in columns}
    return old.join(other, list(key), "left").withColumns(filled).select(old.columns)


def reparent(children: DataFrame, survivors: DataFrame, column: str, unique: Sequence[str]) -> DataFrame:
    """Children of merged rows given to the survivor (``survivors``: dup, canonical); of rows that then share
    ``unique``, the survivor's own stays."""
    moved = children.join(survivors, children[column] == survivors["dup"], "left")
    moved = moved.withColumn("__own", F.col("canonical").isNull().cast("int")).withColumn(column, F.coalesce("canonical", F.col(column))).drop("dup", "canonical")
    rank = F.row_number().over(Window.partitionBy(*unique).orderBy(F.desc("__own"), *(c for c in children.columns if c not in unique)))
    return moved.withColumn("__n", rank).where("__n = 1").select(children.columns)


def latest(rows: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """The last row of each key in descending ``order``."""
    return top(rows, key, 1, *order)


def top(rows: DataFrame, key: Sequence[str], n: int, *order: Column) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def changes(rows: DataFrame, key: Sequence[str], value: str, *order: str) -> DataFrame:
    """Rows whose value differs from the key's row before; the first of a key always does."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1
    return rows.withColumn("__new", first | ~F.col(value).eqNullSafe(before)).where("__new").drop("__new")


def status_rank(c: Column, order: Sequence[str] = V.STATUS_ORDER) -> Column:
    """1 for the lowest status; 0 for unknown ones and null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), c), F.lit(0)).cast("int")


def status_of(rank: Column, order: Sequence[str] = V.STATUS_ORDER) -> Column:
    return F.when(rank > 0, F.element_at(F.array(*map(F.lit, order)), rank))


def advances(rows: DataFrame, key: Sequence[str], rank: Column, *order: str) -> DataFrame:
    """Rows whose rank exceeds all earlier ones of the key; those of rank 0 stay."""
    earlier = F.max("__rank").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__rank", rank).withColumn("__before", earlier).where("__before is null or __rank > __before or __rank = 0").drop("__rank", "__before")


def effective_status(rows: DataFrame, key: Sequence[str], rank: Column, *order: str) -> DataFrame:
    """Adds ``effective`` (greatest rank so far) and ``before`` (the same without this row, null at first)."""
    so_far = Window.partitionBy(*key).orderBy(*order)
    ranked = rows.withColumn("__rank", rank)
    return ranked.withColumn("effective", F.max("__rank").over(so_far.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.max("__rank").over(so_far.rowsBetween(Window.unboundedPreceding, -1))).drop("__rank")


def status_changes(rows: DataFrame, key: Sequence[str], status: Column, year: Column, now: int, *order: str) -> DataFrame:
    """``rows`` that raise their key's status by one of V.TRANSITIONS, with ``old`` and ``new``.

    The old status is the highest so far, whatever came last.  Papers of a year (digits only) more than V.STALE_YEARS
    before ``now`` have no changes; other years, and none, don't keep one back.
    """
    found = effective_status(rows.withColumn("__rank_of", status_rank(status)), key, F.col("__rank_of"), *order)
    raised = found.where((F.col("before") > 0) & (F.col("__rank_of") > F.col("before"))).withColumn("old", status_of(F.col("before"))).withColumn("new", status)
    worth = F.struct("old", "new").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in V.TRANSITIONS])
    stale = F.coalesce(year.rlike("^[0-9]+$") & (F.lit(now) - year.try_cast("int") > V.STALE_YEARS), F.lit(False))
    return raised.where(worth & ~stale).drop("__rank_of", "before", "effective")


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` (model, prompt, completion, batch, ...) with ``cost``, by ``prices`` (model, in_price, out_price, of a million tokens).

    A batch costs half; a model without a price has no cost.  A model's first price in order counts.
    """
    one = prices.groupBy("model").agg(F.min(F.struct("in_price", "out_price")).alias("p"))
    cost = (F.col("prompt") * F.col("p.in_price") / 1e6 + F.col("completion") * F.col("p.out_price") / 1e6) * F.when(F.col("batch"), 0.5).otherwise(1.0)
    return usage.join(one, "model", "left").withColumn("cost", cost).drop("p")


def mutual_unique(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs in which either side has no other partner."""
    counted = pairs.withColumn("__a", F.count("*").over(Window.partitionBy(a))).withColumn("__b", F.count("*").over(Window.partitionBy(b)))
    return counted.where("__a = 1 and __b = 1").drop("__a", "__b")


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], at: str, when: str, value: str, name: str) -> DataFrame:
    """``left`` with the right side's value of the latest row strictly before ``at`` (null without one).

    Both sides are merged and sorted once per key, and the last value is carried on; no row meets all
    rows of its key, so a hot key costs a sort and not a square.
    """
    columns = [c for c in left.columns if c not in key]
    # at one time, left rows come first: what comes at the same time isn't before
    l_side = left.withColumn("__t", F.col(at)).withColumn("__s", F.lit(0)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__has", F.lit(None).cast("timestamp"))
    r_side = right.select(*key, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns), F.col(when).alias("__t"), F.lit(1).alias("__s"), F.col(value).alias("__v"), F.col(when).cast("timestamp").alias("__has"))
    order = Window.partitionBy(*key).orderBy("__t", "__s", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last(F.when(F.col("__has").isNotNull(), F.struct("__v")), ignorenulls=True).over(order)["__v"]
    return l_side.unionByName(r_side).withColumn(name, carried).where("__s = 0").select(*left.columns, name)


def conjunction(conditions: Sequence[Column | None]) -> Column:
    """All given conditions; none is true."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number`` from 1; the order must be total."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def nested(rows: DataFrame, key: Sequence[str], order: str, *columns: str) -> DataFrame:
    """(key, items): each key's rows as an ordered array of structs."""
    return rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("items"))


def pareto(rows: DataFrame, cost: str, score: str, *ties: str) -> DataFrame:
    """Rows with a better score than all cheaper ones (of equal cost, those before them by score, then ``ties``).

    Rows are range-sorted by cost; each range needs its own rows, and of the ranges before it the best score only.
    """
    from quillstream.operators.groups import written

    order = [F.col(cost), F.desc(score), *map(F.col, ties)]
    ranged = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    best = ranged.groupBy("__range").agg(F.max(score).alias("__top"))
    before = best.withColumn("__before", F.max("__top").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).drop("__top")  # a row a range
    inside = F.max(score).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    found = ranged.withColumn("__inside", inside).join(before, "__range").withColumn("__best", F.greatest("__inside", "__before"))
    return found.where(F.col("__best").isNull() | (F.col(score) > F.col("__best"))).select(rows.columns)
