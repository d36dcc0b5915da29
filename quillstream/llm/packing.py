"""Packing into length buckets of least padding, and batches of a token budget.

The histogram of all lengths is exact and has at most ``longest`` bars, as longer documents
are cut into pieces of ``longest`` tokens.  Dynamic programming over it finds the bucket
limits for which padding every piece to its bucket's limit adds the fewest tokens.  Inside a
bucket, batches hold as many rows as the budget allows at that length.

Batches form inside shards of a bucket of about ``shard_rows`` rows or ``SHARD_TOKENS`` tokens, so no
task ever holds a bucket; one batch of a shard, its last, may be short.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm import bpe
from quillstream.llm.storage import written

LONGEST, BUCKETS, BUDGET, SHARD_ROWS = 4096, 16, 65_536, 200_000
#: Tokens of a shard at its bucket's length, 64 MB: what one task sorts.
SHARD_TOKENS = 1 << 24
SHAPE = "doc_id long, piece long, first_token long, n_tokens long, bucket_length long, batch string, slot int, tokens array<int>"


def limits(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The (at most ``buckets``) limits, ascending, that minimise the sum of limit - length.

    ``cost(i, j)`` pads lengths i..j-1 to the j-1st.  The least cost of k buckets up to j is the least
    over i of k - 1 buckets up to i plus cost(i, j); the best i never falls as j rises, so each layer
    is found by divide and conquer.  Of equally good limits, those with the smaller last ones.
    """
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    keep = c > 0
    x, c = x[keep], c[keep]
    n = len(x)
    if not n:
        return []
    rows, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        return x[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])

    far = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, far)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        new, at = np.full(n + 1, far), np.zeros(n + 1, dtype=np.int64)
        new[0] = 0
        todo = [(1, n, 0, n - 1)]
        while todo:
            a, b, low, high = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(low, min(high, j - 1) + 1)
            total = best[i] + cost(i, j)
            k = int(np.argmin(total))
            new[j], at[j] = total[k], i[k]
            todo += [(a, j - 1, low, int(i[k])), (j + 1, b, int(i[k]), high)]
        best = new
        cuts.append(at)
    out, j = [], n
    for at in reversed(cuts):
        if j <= 0:
            break
        out.append(int(x[j - 1]))
        j = int(at[j])
    return sorted(out)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and their number of every text, as a written table: the tokeniser runs once."""
    return written(bpe.tokenise(docs, path).withColumn("n_ids", F.size("ids").cast("long")), "tokens")


def histogram(tokens: DataFrame, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of pieces and how many have each: ``longest`` numbers at most."""
    whole = F.expr(f"n_ids div {longest}")
    each = tokens.where("n_ids > 0").groupBy("n_ids").count()
    lengths = each.select(F.expr(f"n_ids % {longest}").alias("n"), "count").unionAll(each.select(F.lit(longest).cast("long").alias("n"), (whole * F.col("count")).alias("count")))
    rows = lengths.where("n > 0 and count > 0").groupBy("n").agg(F.sum("count")).collect()
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)


def pack(tokens: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each piece of ``tokens`` (doc_id, ids, n_ids; see ``tokenised``): SHAPE.

    A document of more than ``longest`` tokens has several pieces, in order; joined, a document's pieces
    are its ids.  ``batch`` names bucket, shard and number; it has max(1, budget // bucket_length) slots,
    all full but in a shard's last.  Order in a shard is by doc_id (nulls first), piece, length and a hash
    of the ids; shards are hashes of all of these and of the row's place in ``tokens``, a written table, so copies of
    one row spread, too.  Documents without tokens aren't packed; repeated rows are packed each; no rows give none.
    """
    lengths, counts = histogram(tokens, longest)
    ends = limits(lengths, counts, buckets)
    if not ends:
        return tokens.sparkSession.createDataFrame([], SHAPE)
    bucket, shards = F.lit(ends[-1]), F.lit(1)
    for low, end in sorted(zip([0, *ends], ends, strict=False), reverse=True):
        inside = F.col("n_tokens") <= end
        bucket = F.when(inside, F.lit(end)).otherwise(bucket)
        own = int(counts[(lengths > low) & (lengths <= end)].sum())
        shards = F.when(inside, F.lit(max(1, math.ceil(own / shard_rows), math.ceil(own * end / SHARD_TOKENS)))).otherwise(shards)
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_ids - 1) div {longest}")))
    spotted = tokens.where("n_ids > 0").withColumn("spot", F.monotonically_increasing_id())
    cut = spotted.select("doc_id", "ids", "n_ids", "spot", number.alias("piece")).withColumn("first_token", F.col("piece") * longest)
    cut = cut.withColumn("n_tokens", F.least(F.col("n_ids") - F.col("first_token"), F.lit(longest)))
    cut = cut.withColumn("tokens", F.slice("ids", (F.col("first_token") + 1).cast("int"), F.col("n_tokens").cast("int"))).withColumn("tie", F.xxhash64("tokens"))
    placed = cut.withColumn("bucket_length", bucket.cast("long")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "tie", "spot"), shards).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket_length", "shard").orderBy("doc_id", "piece", "n_tokens", "tie")) - 1
    slots = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget} div bucket_length"))
    kept = placed.select("doc_id", "piece", "first_token", "n_tokens", "bucket_length", "shard", "tie", "tokens")
    numbered = kept.withColumn("place", place.cast("long")).withColumn("slots", slots)
    batch = F.concat_ws("-", "bucket_length", "shard", F.expr("place div slots"))
    return numbered.select("doc_id", "piece", "first_token", "n_tokens", "bucket_length", batch.alias("batch"), F.expr("cast(place % slots as int)").alias("slot"), "tokens")
