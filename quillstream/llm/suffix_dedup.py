"""Byte strings of a given length that occur at two places or more of a corpus.

A window is ``length`` bytes of one text.  Windows are dealt so that equal ones meet:

1. A window's core is the one of its 64-byte strings with the least hash.  Neighbouring windows mostly share
   theirs, so a text is cut into segments, runs of windows of one core.  Equal windows have equal cores.
2. Cores are counted (``rarity``); segments whose core occurs once hold no repeated window and go.
3. Segments of equal bytes, told by 128 bits, are repeated as a whole.  Those that a task meets twice are settled
   there, and one of them stands for all; so a text that a third of the corpus has makes a row for some
   megabytes of text.
4. What is left are different segments of one core: copies' edges and variants.  Their bytes are fetched,
   dealt by core and packed in blocks; each block's Burrows-Wheeler transform is searched (``suffix_blocks``).
   Where over ``GROUP`` different segments share a core, their windows are compared one by one by name
   instead, dealt by that, so that no task ever holds more than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm import membership
from quillstream.llm import rarity as rare
from quillstream.llm import text as tx
from quillstream.llm.columns import ranges
from quillstream.llm.storage import written
from quillstream.llm.suffix_blocks import END, repeated

LENGTH, CORE = 200, 64
#: Most windows of a segment, most segments of a core in one block, bytes of a block, rows held before they are dealt.
SEGMENT, GROUP, BLOCK, DEAL_ROWS = 512, 4096, 1 << 20, 1 << 18
_CHUNK, _PLACE = 1 << 16, 24
_LAST = (1 << 63) - 1
_BYTES = tx.mix(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (width - span)], keys[width - span :]) if span < width else keys


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start (in ``data``), number of windows and core of all segments, and whether the core occurs in it twice.

    They depend on their text only.  Long segments are cut; ``length`` is 64 or more.
    """
    first_bits = np.uint64(((1 << 64) - 1) ^ ((1 << _PLACE) - 1))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pieces: list[tuple[np.ndarray, ...]] = []
    for c in range(0, len(data) - length + 1, _CHUNK):
        own = data[c : c + _CHUNK + length - 1]
        h = _BYTES[own]
        for k in range(CORE.bit_length() - 1):
            m = 1 << k
            h = h[:-m] * np.uint64(0xD1342543DE82EF95 + 2 * k) + h[m:]
            h ^= h >> np.uint64(31)
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h &= first_bits
        place = np.arange(len(h), dtype=np.uint64)
        left = _least(h | place, length - CORE + 1)
        right = _least(h | (np.uint64((1 << _PLACE) - 1) - place), length - CORE + 1)
        core = left & first_bits
        inside = row[c : c + len(core)] == row[c + length - 1 : c + length - 1 + len(core)]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (core[1:] != core[:-1])
        start = np.flatnonzero(new)
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | (core[1:] != core[:-1])
        stop = np.flatnonzero(stop)
        one, other = (left[start] & ~first_bits).astype(np.int64), (1 << _PLACE) - 1 - (right[stop] & ~first_bits).astype(np.int64)
        pieces.append((c + start, c + stop + 1, core[start], c + one, c + other))
    if not pieces:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    start, stop, core, one, other = (np.concatenate(p) for p in zip(*pieces, strict=True))
    # pieces of one segment on both sides of a chunk's edge
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != stop[:-1]) | (core[1:] != core[:-1]) | (row[start[1:]] != row[start[:-1]])
    lead = np.flatnonzero(new)
    end = np.append(lead[1:], len(start)) - 1 if len(start) else lead
    start, stop, core, twice = start[lead], stop[end], core[lead], other[end] > one[lead]
    parts = -(-(stop - start) // SEGMENT)
    of = np.repeat(np.arange(len(start)), parts)
    cut = start[of] + SEGMENT * ranges(np.zeros(len(parts), np.int64), parts)
    return row[cut], cut, np.minimum(cut + SEGMENT, stop[of]) - cut, core[of], twice[of]


def _names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of each stretch, as two columns of 64-bit integers."""
    raw, digest = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    out = b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


_SEGMENT = "h1 long, h2 long, core long, doc long, key long, start long, n long, twice boolean, times int"
_SPAN = "doc long, key long, start long, n long"


def _spans(flags: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, start and length of all runs of set flags, cut at the edges of stretches."""
    new = flags.copy()
    new[1:] &= ~flags[:-1]
    new[edges[:-1]] = flags[edges[:-1]]
    stop = flags.copy()
    stop[:-1] &= ~flags[1:]
    stop[edges[1:] - 1] = flags[edges[1:] - 1]
    a, b = np.flatnonzero(new), np.flatnonzero(stop) + 1
    return np.searchsorted(edges, a, "right") - 1, a, b - a


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, key, start, n): n windows from byte ``start`` on of texts that start anywhere else, too.

    doc: doc_id, null as the last; key: the text's xxhash64.  Rows of equal doc_id and text share theirs.
    """
    spark = docs.sparkSession
    read = docs.where(F.octet_length("text") >= length).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("key"), "text")

    def cores(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in tx.slices(batch, "text"):
            *_, core, twice = segments(*tx.buffers(part.column("text")), length)
            yield np.concatenate([core, core[twice]])

    order = spark.sparkContext.broadcast(rare.measure(read.select("text"), cores, per_token=64))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments that may repeat, one for each name; what repeats here has ``times`` 0, and the one that stands for it 2."""
        held: list[list[np.ndarray]] = []
        n = 0

        def dealt() -> pa.RecordBatch:
            h1, h2, core, doc, key, start, size, twice = (np.concatenate(c) for c in zip(*held, strict=True))
            at = np.lexsort((start, key, doc, h2, h1))
            h1, h2, core, doc, key, start, size, twice = (c[at] for c in (h1, h2, core, doc, key, start, size, twice))
            new = np.ones(len(at), dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            count = np.diff(np.append(np.flatnonzero(new), len(at)))
            times = np.where(new, np.minimum(count[np.cumsum(new) - 1], 2), 0)
            # rows of one document share their segments
            keep = new.copy()
            keep[1:] |= (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1])
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (h1, h2, core, doc, key, start, size, twice)] + [pa.array(times[keep].astype(np.int32))], names=["h1", "h2", "core", "doc", "key", "start", "n", "twice", "times"])

        for batch in batches:
            for part in tx.slices(batch, "text"):
                data, offsets = tx.buffers(part.column("text"))
                row, start, size, core, twice = segments(data, offsets, length)
                live = np.flatnonzero(order.value.may_repeat(core))
                row, start, size = row[live], start[live], size[live]
                name = _names(data, start, start + size + length - 1)
                held.append([name[:, 0], name[:, 1], core[live].view(np.int64), part.column("doc").to_numpy()[row], part.column("key").to_numpy()[row], start - offsets[row], size, twice[live]])
                n += len(live)
                if n >= DEAL_ROWS:
                    yield dealt()
                    held, n = [], 0
        if n:
            yield dealt()

    described = written(read.mapInArrow(describe, _SEGMENT), "segments")
    name = Window.partitionBy("h1", "h2")
    counted = described.where("times > 0").select("*", F.sum("times").over(name).alias("total"), F.row_number().over(name.orderBy("doc", "key", "start")).alias("place"))
    named = written(counted, "named")
    span = ["doc", "key", "start", "n"]
    whole = described.where("times = 0").select(span).unionAll(named.where("total > 1").select(span))
    # one segment of each name; of cores with several names, or twice in the only one, the bytes are needed
    single = named.where("place = 1").select("core", *span, "twice", (F.col("total") > 1).alias("settled"))
    shared = single.groupBy("core").agg(F.count("*").alias("names"), F.min("settled").alias("all_settled")).where("names > 1")
    met = single.join(shared.hint("rebalance"), "core", "left").where("names > 1 or (twice and not settled)").where("not coalesce(all_settled, false)")
    wanted = written(met.select("core", *span, "settled", F.coalesce(F.col("names") > GROUP, F.lit(False)).alias("wide")), "wanted")
    asked = written(wanted.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "n", "core", "settled", "wide")).alias("asked")), "asked")
    flags = spark.sparkContext.broadcast(membership.bitmap(asked, "doc", "key"))

    @F.arrow_udf("boolean")
    def may_be_asked(cells: pa.Array) -> pa.Array:
        return pa.array(flags.value.inside(cells.to_numpy()))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of segments, and of wide ones the names of the windows."""
        before = None
        for batch in batches:
            for part in tx.slices(batch, "text"):
                data, offsets = tx.buffers(part.column("text"))
                doc, key, lists = part.column("doc").to_numpy(), part.column("key").to_numpy(), part.column("asked")
                each = lists.flatten()
                of = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                # rows of one document are neighbours, and ask the same
                new = np.ones(part.num_rows, dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
                new[0] = before != (doc[0], key[0])
                before = (doc[-1], key[-1])
                start, n, core, settled, wide = (each.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n", "core", "settled", "wide"))
                for rows, one_by_one in ((new[of] & ~wide, False), (new[of] & wide, True)):
                    at = np.flatnonzero(rows)
                    if not len(at):
                        continue
                    o, s, m = of[at], start[at], n[at]
                    if one_by_one:
                        o, s, m = np.repeat(o, m), ranges(s, m), np.ones(int(m.sum()), np.int64)
                        names = _names(data, offsets[o] + s, offsets[o] + s + length)
                        more = [pa.array(names[:, 0]), pa.array(names[:, 1]), pa.nulls(len(o), pa.bool_()), pa.nulls(len(o), pa.binary())]
                    else:
                        size = m + length - 1
                        raw = data[ranges(offsets[o] + s, size)].tobytes()
                        edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                        more = [pa.array(core[at]), pa.nulls(len(o), pa.int64()), pa.array(settled[at]), pa.Array.from_buffers(pa.binary(), len(o), [None, pa.py_buffer(edges), pa.py_buffer(raw)])]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[o]), pa.array(key[o]), pa.array(s), pa.array(m), *more], names=["doc", "key", "start", "n", "h1", "h2", "settled", "bytes"])

    texts = read.withColumn("cell", membership.cell("doc", "key")).where(may_be_asked("cell")).drop("cell")
    fetched = written(texts.join(asked, ["doc", "key"]).mapInArrow(fetch, f"{_SPAN}, h1 long, h2 long, settled boolean, bytes binary"), "bytes")
    times = Window.partitionBy("h1", "h2")
    # a document's row may have been read twice
    windows = fetched.where("bytes is null").select(*span, "h1", "h2").withColumn("again", (F.min(F.struct("doc", "key", "start")).over(times) != F.struct("doc", "key", "start")) | (F.max(F.struct("doc", "key", "start")).over(times) != F.struct("doc", "key", "start")))
    by_name = windows.where("again").select(span)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done() -> pa.RecordBatch:
            block = pa.Table.from_batches(held).combine_chunks()
            doc, key, start, core = (block.column(c).to_numpy() for c in ("doc", "key", "start", "h1"))
            by = np.lexsort((start, key, doc, core))
            new = np.ones(len(by), dtype=bool)
            new[1:] = np.any([c[by[1:]] != c[by[:-1]] for c in (core, doc, key, start)], axis=0)
            block = block.take(pa.array(by[new]))
            doc, key, start, n, settled = (block.column(c).to_numpy() for c in ("doc", "key", "start", "n", "settled"))
            raw, offsets = tx.buffers(block.column("bytes"))
            edges = offsets + np.arange(len(offsets))
            data = np.full(edges[-1], END, np.uint8)
            data[np.arange(len(raw)) + np.repeat(np.arange(len(n)), np.diff(offsets))] = raw
            hit = repeated(data, length)
            of, at, count = _spans(hit, edges)
            own = ~settled.astype(bool)[of]
            of, at, count = of[own], at[own], count[own]
            return pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(key[of]), pa.array(start[of] + at - edges[of]), pa.array(count)], names=span)

        for batch in batches:
            if not batch.num_rows:
                continue
            core = batch.column("h1").to_numpy()
            ends = np.cumsum(np.diff(tx.buffers(batch.column("bytes"))[1]))
            cuts = np.append(np.flatnonzero(core[1:] != core[:-1]) + 1, len(core))
            a = 0
            for b in cuts.tolist():
                # a block ends between two cores
                other = bool(held) and held[-1].column("h1")[-1].as_py() != int(core[a])
                if other and size > BLOCK:
                    yield done()
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += int(ends[b - 1] - (ends[a - 1] if a else 0))
                a = b
        if held:
            yield done()
        held = []
        tx.release()

    dealt = fetched.where("bytes is not null").select(*span, "h1", "settled", "bytes").repartition("h1").sortWithinPartitions("h1")
    by_block = written(dealt.mapInArrow(search, _SPAN), "found")
    return whole.unionAll(by_name).unionAll(by_block)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (array of start and end, the maximal runs of removed bytes) and kept (the bytes
    that stay) of each row of ``docs``: each byte that a string of ``length`` bytes covers that starts
    anywhere else too, in the same text or another one, is removed.

    Strings are judged on the input, whole, and don't cross texts; characters may be cut, so kept is binary.
    A null or short text has no such string; repeated rows are copies of each other; a null doc_id stays null;
    other columns are left out, whatever their names; no rows give none.
    """
    found = repeated_windows(docs, length)
    spans = found.select("doc", "key", F.col("start").alias("a"), (F.col("start") + F.col("n") + (length - 1)).alias("b"))
    grouped = written(spans.groupBy(F.col("doc").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("a", "b")).alias("found")), "spans")
    flags = docs.sparkSession.sparkContext.broadcast(membership.bitmap(grouped, "_doc", "_key"))

    @F.arrow_udf("boolean")
    def may_have(cells: pa.Array) -> pa.Array:
        return pa.array(flags.value.inside(cells.to_numpy()))

    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(_LAST))).withColumn("key", F.xxhash64("text")).withColumn("cell", membership.cell("doc", "key"))
    hit = rows.where(may_have("cell")).join(grouped, (F.col("doc") == F.col("_doc")) & (F.col("key") == F.col("_key")), "left").select("doc_id", "text", "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                data, offsets = tx.buffers(part.column("text"))
                lists = part.column("found")
                of = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy())
                a, b = (offsets[of] + lists.flatten().field(c).to_numpy() for c in ("a", "b"))
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, a, 1)
                np.subtract.at(edge, b, 1)
                gone = np.cumsum(edge[:-1]) > 0
                # runs end with their texts
                full = np.flatnonzero(np.diff(offsets) > 0)
                row, start, size = _spans(gone, np.append(offsets[full], len(data))) if len(data) else (np.zeros(0, np.int64),) * 3
                row = full[row]
                bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array(start - offsets[row]), pa.array(start - offsets[row] + size)], names=["start", "end"])
                total = np.concatenate([[0], np.cumsum(~gone)])[offsets]
                kept = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(data[~gone].tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(bounds), each), kept], names=["doc_id", "n_bytes", "spans", "kept"])

    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    same = rows.where(~may_have("cell")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("spans"), F.col("text").cast("binary").alias("kept"))
    return hit.mapInArrow(cut, schema).unionByName(same)
