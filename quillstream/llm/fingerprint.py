"""Bottom-k sketches of documents' shingle hashes.

A sketch holds the k smallest distinct hashes of a text's five-word shingles (see ``text``
for words and hashes), each cut to 48 bits.  It is exact while a text has at most k
shingles.  Sketches merge: the k smallest of two sketches' union are the sketch of the joined
parts.  They estimate resemblance, containment and the number of distinct shingles.

As text, a sketch is the base64 of its hashes, ascending, six big-endian bytes each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import text as tx

WORDS, K, BITS = 5, 128, 48
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    most = 4 * k
    if len(hashes) > 2 * most:
        near = np.unique(np.partition(hashes, most)[:most])
        if len(near) >= k:
            return near[:k]
    return np.unique(hashes)[:k]


def sketches(column: pa.Array, n: int = WORDS, k: int = K) -> list[np.ndarray]:
    shingles, bounds, _ = tx.texts_shingles(column, n)
    shingles >>= np.uint64(64 - BITS)
    return [bottom(shingles[a:b], k) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; of two empty sketches 1, of an empty and another 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(least, both, assume_unique=True).sum()) / len(least)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles (exact below k)."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << BITS) / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has: resemblance times the union's size, over a's."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.reshape(-1).view(">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, n: int = WORDS, k: int = K) -> DataFrame:
    """doc_id, ``fingerprint`` and estimated ``n_distinct`` shingles of every text.

    A null text is empty; a null doc_id stays null; each of repeated rows has a row; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                own = sketches(part.column("text"), n, k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([to_text(s) for s in own], pa.string()), pa.array([distinct(s, k) for s in own], pa.float64())], names=["doc_id", "fingerprint", "n_distinct"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string, n_distinct double")


#: Sampled rows for each range of ids.
SAMPLED = 16
_LEAST = -(1 << 63)


def _places(k: np.ndarray, tie: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the bounds (rows k, tie, ascending) aren't above each (k, tie)."""
    low, high = (np.searchsorted(bounds[:, 0], k, side) for side in ("left", "right"))
    for own in np.unique(k[low < high]).tolist():
        at = np.flatnonzero(k == own)
        a, b = low[at[0]], high[at[0]]
        low[at] = a + np.searchsorted(bounds[a:b, 1], tie[at], "right")
    return low


def with_next(docs: DataFrame, places: int) -> DataFrame:
    """Rows (k, no_id, text, tie, place, ghost, times) such that each place, sorted by ghost, k and tie, lists
    documents in order and ends with the one that follows them.

    The order is by descending doc_id (k: its bits turned over; null: as the least possible), then by the text's
    hash.  Places are ranges of that order of about equal size, whose bounds come from SAMPLED random rows a
    range; a frequent doc_id (or null) has many.  The first document of a range also goes, as a ghost, to the
    end of the range before, and the very first to the last.  Rows of one doc_id and text are one row of
    several ``times``, once a batch.  The driver holds some numbers for each range.
    """
    no_id = F.col("doc_id").isNull()
    rows = docs.select(F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))).alias("k"), no_id.alias("no_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("no_id", "text"))
    sample = sorted((r.k, r.tie) for r in rows.select("k", "tie").orderBy(F.rand(7)).limit(SAMPLED * places).collect())
    bounds = np.array(sorted(set(sample[len(sample) * i // places] for i in range(1, places) if sample)), dtype=np.int64).reshape(-1, 2)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int]] = {}
        for batch in batches:
            k, tie = batch.column("k").to_numpy(), batch.column("tie").to_numpy()
            place = _places(k, tie, bounds)
            at = np.lexsort((tie, k, place))
            at = at[np.concatenate([[True], place[at[1:]] != place[at[:-1]]])] if len(at) else at
            for p, own in zip(place[at].tolist(), zip(k[at].tolist(), tie[at].tolist(), strict=True), strict=True):
                seen[p] = min(seen.get(p, own), own)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1))], names=["place", "k", "tie"])

    found = rows.select("k", "tie").mapInArrow(firsts, "place int, k long, tie long").groupBy("place").agg(F.min(F.struct("k", "tie")).alias("at")).collect()
    heads = {r.place: (r["at"].k, r["at"].tie) for r in sorted(found)}
    before = dict(zip(heads, [list(heads)[-1], *heads], strict=False)) if heads else {}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            k, tie = batch.column("k").to_numpy(), batch.column("tie").to_numpy()
            at = np.lexsort((tie, k))
            new = np.flatnonzero(np.concatenate([[True], (k[at[1:]] != k[at[:-1]]) | (tie[at[1:]] != tie[at[:-1]])])) if len(at) else at
            times = np.diff(np.append(new, len(at)))
            at = at[new]
            place = _places(k[at], tie[at], bounds).astype(np.int32)
            own = batch.take(pa.array(at))
            yield own.append_column("place", pa.array(place)).append_column("ghost", pa.array(np.zeros(len(at), bool))).append_column("times", pa.array(times.astype(np.int32)))
            ghosts = [i for i, p in enumerate(place.tolist()) if p not in sent and heads[p] == (int(k[at[i]]), int(tie[at[i]]))]
            if ghosts:
                sent.update(place[ghosts].tolist())
                to = np.array([before[p] for p in place[ghosts].tolist()], dtype=np.int32)
                yield own.take(pa.array(ghosts)).append_column("place", pa.array(to)).append_column("ghost", pa.array(np.ones(len(to), bool))).append_column("times", pa.array(np.ones(len(to), np.int32)))

    routed = rows.mapInArrow(route, "k long, no_id boolean, text string, tie long, place int, ghost boolean, times int")
    return routed.repartition(max(1, places // 2), "place").sortWithinPartitions("place", "ghost", "k", "tie")


def edited_pairs(docs: DataFrame, places: int, n: int = WORDS, k: int = K) -> DataFrame:
    """Each text's sketch, that of its edited text, and their and the next text's likeness.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document in descending doc_id; after the last comes the first.  One row
    for each row of ``docs`` (doc_id and text are read); a null text counts as empty, a null
    doc_id comes last and stays null; equal doc_ids go by their texts' hashes, and rows equal in both follow
    each other; an only document is its own next; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before: (doc_id or None, place, text, sketch)
        for batch in batches:
            for part in tx.slices(batch, "text"):
                own = sketches(part.column("text"), n, k)
                ids, no_id, place, ghost, times = (part.column(c).to_pylist() for c in ("k", "no_id", "place", "ghost", "times"))
                texts = part.column("text").to_pylist()
                done, edits = [], []

                def pair(before: tuple, text: str, sketch: np.ndarray, count: int, done=done, edits=edits) -> None:
                    half = len(before[2]) // 2
                    done.append((before[0], len(before[2]), before[3], sketch, count))
                    edits.append(before[2][: len(before[2]) - half] + text[:half])

                for i in range(len(texts)):
                    if held is not None and held[1] == place[i]:
                        pair(held, texts[i], own[i], 1)
                    held = None if ghost[i] else (None if no_id[i] else ~ids[i], place[i], texts[i], own[i])
                    if held is not None and times[i] > 1:
                        pair(held, texts[i], own[i], times[i] - 1)
                if done:
                    altered = sketches(pa.array(edits, pa.large_string()), n, k)
                    rows = [
                        {"doc_id": doc, "n_chars": size, "edited_sha256": hashlib.sha256(e.encode()).hexdigest(), "fingerprint": to_text(a), "edited_fingerprint": to_text(b), "near_edited": resemblance(a, b, k), "near_next": resemblance(a, c, k)}
                        for (doc, size, a, c, _), e, b in zip(done, edits, altered, strict=True)
                    ]
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW).take(pa.array(np.repeat(np.arange(len(rows)), [d[4] for d in done])))

    return with_next(docs, places).mapInArrow(run, SCHEMA)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
