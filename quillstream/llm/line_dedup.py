"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words.  Of two lines with 100 * intersection >= percent * union, the
later one in the order of doc_id and line number goes; so a line stays exactly if no earlier
line is that similar, whether that one stays or not.  Lines without a word are left alone.

Lines of equal sets are one class, at its first line's place; later lines of a class go.  What
is left to know is whether a class has an earlier similar one:

* Short sets (up to three words at 80 percent) are similar to equal ones only, so their classes are all.
* Words are ordered by frequency over all texts (``rarity``).  Two similar sets share a word among
  each other's rarest n - ceil(percent * n / 100) + 1; those words (less the ones that occur once)
  are dealt by word.
* Where classes meet, three exact bounds are applied: on their sizes, on the overlap that the
  word's positions still allow, and on the difference that 128 parity bits of the sets prove.
* Survivors are verified on the full sets.  Each class first tries its earliest candidates; only
  classes that none of these settled, and that had more, try all of them.

Of a class's lines that a task holds at a time only the first is dealt on, so a line that a third
of the corpus repeats makes a row for some megabytes of text.  A word met by very many lines is dealt in blocks, each pair of
which meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillstream.llm import columns as C
from quillstream.llm import membership
from quillstream.llm import rarity as rare
from quillstream.llm import text as tx
from quillstream.llm.line_sets import Lines, bounds, by_owner, line_sets, of_buffers
from quillstream.llm.storage import written

PERCENT, LEAST_WORDS = 80, 1
#: Earliest candidates tried first, and the rows of a word's block.
TRIES, BLOCK_ROWS = 4, 8192
#: Lines and prefix words that a task holds before it deals them.
DEAL_ROWS = 1 << 18
_LAST = (1 << 63) - 1


def _meets(size: np.ndarray, percent: int, least: int) -> np.ndarray:
    """Lines that another set may be similar to: n words have n / (n + 1) in common with n + 1 at most."""
    return (size >= least) & (100 * size >= percent * (size + 1))


def _words(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for part in tx.slices(batch, "text"):
        data, offsets = tx.buffers(part.column("text"))
        yield tx.word_hashes(data, *tx.word_bounds(data, offsets)[:2])


def _prefixes(lines: Lines, order: rare.Rarity, percent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, token, place in the line's order and rank of all prefix words that may occur in a second line."""
    rank, first = order.rank(lines.tokens), lines.first
    place = np.arange(len(lines.tokens)) - np.repeat(first[:-1], lines.size)
    # sorted by line, each still has its places, of which the first are its prefix
    count = np.where(_meets(lines.size, percent, least), lines.size - (-(-percent * lines.size // 100)) + 1, 0)
    prefix = place < np.repeat(count, lines.size)
    if lines.size.max(initial=0) < 1 << 24 and len(lines.size) < 1 << 31:  # all three in one number
        key = np.sort((lines.owner << 32) | (rank.astype(np.int64) << 24) | place)[prefix]
        at = first[lines.owner[prefix]] + (key & ((1 << 24) - 1))
    else:
        at = np.lexsort((place, rank, lines.owner))[prefix]
    keep = rank[at] > 0
    at = at[keep]
    return lines.owner[at], lines.tokens[at], place[prefix][keep], rank[at]


def _postings(token: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A token's group and its number of blocks."""
    return token >> np.uint64(64 - rare.HEAD_BITS), np.minimum(-(-rare.frequency(rank) // BLOCK_ROWS), 1 << 20)


def signatures(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each line, whether an even or odd number of its words fall on each: a word that only one of two
    lines has turns one bit, so they differ in as many words at least as their bits do, however long they are."""
    token = lines.tokens >> np.uint64(22)
    bit = np.uint64(1) << (token & np.uint64(63))
    low = (token & np.uint64(64)) == 0
    first = lines.first[:-1]
    return np.bitwise_xor.reduceat(np.where(low, bit, np.uint64(0)), first), np.bitwise_xor.reduceat(np.where(low, np.uint64(0), bit), first)


def _earliest(x: np.ndarray, y: np.ndarray, doc: np.ndarray, line: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (later, earlier) of rows: the ``most`` earliest of each later one, and whether it had more."""
    order = np.lexsort((line[y], doc[y], x))
    x, y = x[order], y[order]
    if most is None or not len(x):
        return x, y, np.zeros(len(x), dtype=bool)
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    count = np.diff(np.append(start, len(x)))
    rank = np.arange(len(x)) - np.repeat(start, count)
    keep = rank < most
    return x[keep], y[keep], np.repeat(count > most, count)[keep]


def meet(grp: np.ndarray, side: np.ndarray, doc: np.ndarray, line: np.ndarray, size: np.ndarray, place: np.ndarray, sign: np.ndarray, sign2: np.ndarray, probe: np.ndarray, percent: int, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (later row, earlier row) of one group each that pass all bounds, and for each whether its later row had more.

    Rows are sorted by group and size.  Step d compares each row with the d-th after it, as long as
    that one is of its group and not too long: all groups at once.
    """
    new = np.concatenate([[True], grp[1:] != grp[:-1]])
    end = np.append(np.flatnonzero(new), len(grp))[np.cumsum(new)]
    later, earlier, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(0, bool)
    held, had_more = 0, np.zeros(len(doc), dtype=bool)
    i = np.flatnonzero(np.arange(len(grp)) + 1 < end)
    d = 1
    while len(i):
        j = i + d
        near = 100 * size[i] >= percent * size[j]
        i, j = i[near], j[near]
        total = size[i] + size[j]
        need = -(-percent * total // (100 + percent))
        good = np.minimum(size[i] - place[i], size[j] - place[j]) >= need
        good &= np.bitwise_count(sign[i] ^ sign[j]).astype(np.int64) + np.bitwise_count(sign2[i] ^ sign2[j]) <= total - 2 * need
        good &= (doc[i] != doc[j]) | (line[i] != line[j])
        good &= (side[i] == 0) | (side[i] != side[j])
        if good.any():
            a, b = i[good], j[good]
            first = (doc[a] < doc[b]) | ((doc[a] == doc[b]) & (line[a] < line[b]))
            x, y = np.where(first, b, a), np.where(first, a, b)
            wanted = probe[x]
            later.append(x[wanted])
            earlier.append(y[wanted])
            held += int(wanted.sum())
            if held > 1 << 20 and most is not None:
                x, y, more = _earliest(np.concatenate(later), np.concatenate(earlier), doc, line, most)
                had_more[x[more]] = True
                later, earlier, held = [x], [y], 0
        d += 1
        i = i[i + d < end[i]]
    x, y, more = _earliest(np.concatenate(later), np.concatenate(earlier), doc, line, most)
    return x, y, more | had_more[x]


_PAIR = "x_doc long, x_line int, y_doc long, y_line int, more boolean"
_LINE = {"h1": "<u8", "h2": "<u8", "doc": "<i8", "key": "<i8", "line": "<i4", "size": "<i4", "sign": "<u8", "sign2": "<u8", "words": "<i4"}
_WORD = {"token": "<u8", "place": "<i4", "blocks": "<i4"}
_LATER = {"doc": "<i8", "line": "<i4", "key": "<i8"}
_POSTING = {"grp": "<u8", "doc": "<i8", "line": "<i4", "size": "<i4", "place": "<i4", "sign": "<u8", "sign2": "<u8", "side": "<i1"}
_GROUP_BITS = rare.HEAD_BITS


def _repeats(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Which lines have one of the same name at an earlier place here."""
    at = np.lexsort((line, doc, h2, h1))
    new = np.concatenate([[True], (h1[at[1:]] != h1[at[:-1]]) | (h2[at[1:]] != h2[at[:-1]])])
    first = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.zeros(len(at), dtype=bool)
    out[at] = (doc[at] != doc[first]) | (line[at] != line[first])
    return out


def _spread(columns: dict[str, np.ndarray], blocks: np.ndarray) -> dict[str, np.ndarray]:
    """Postings by group: the token, or for a token of several blocks each pair of them.

    A row of a token with b blocks goes to b groups.  ``side`` tells a pair's blocks apart (1, 2); 0 is
    for rows that meet all others of their group.
    """
    if (blocks == 1).all():
        return columns
    at = np.repeat(np.arange(len(blocks)), blocks)
    out = {k: c[at] for k, c in columns.items()}
    several = blocks[at] > 1
    if several.any():
        own = (tx.mix(tx.mix(out["doc"].view(np.uint64)) + out["line"].astype(np.uint64)) % blocks[at].astype(np.uint64)).astype(np.int64)
        other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        pair = tx.mix(out["grp"] + tx.mix((np.minimum(own, other) << 32 | np.maximum(own, other)).astype(np.uint64)))
        out["grp"] = np.where(several, pair >> np.uint64(64 - _GROUP_BITS), out["grp"])
        out["side"] = np.where(several & (own != other), np.where(own < other, 1, 2), 0).astype(np.int8)
    return out


def later_lines(docs: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_key, line) of the lines to remove; text_key is the text's xxhash64, doc_id null as the last.

    Lines of rows with equal doc_id and number are equally early: neither removes the other.
    """
    spark = docs.sparkSession
    read = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    # no more parts than there are pieces of PIECE_BYTES, so that small tables aren't dealt among tasks of a few rows
    parts = 2 * max(4, min(rare.n_parts(read.select("text"), 4), -(-rare.n_bytes(read.select("text")) // rare.PIECE_BYTES)))
    order = spark.sparkContext.broadcast(rare.measure(read.select("text"), _words, per_token=32))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines with their sets' names, dealt by name; with each, its prefix words.  Repeats go by document."""
        held: list[tuple[C.Columns, C.Columns, C.Columns]] = []
        n = 0

        def dealt() -> pa.RecordBatch:
            head, words, gone = ({k: np.concatenate([c[k] for c in several]) for k in several[0]} for several in zip(*held, strict=True))
            again = _repeats(head["h1"], head["h2"], head["doc"], head["line"])
            gone = {k: np.concatenate([gone[k], head[k][again]]) for k in gone}
            words = {k: c[np.repeat(~again, head["words"])] for k, c in words.items()}
            head = {k: c[~again] for k, c in head.items()}
            to = (head["h1"] % np.uint64(parts)).astype(np.int32)
            lines = C.deal(head, to, np.argsort(to, kind="stable"), head["words"], words)
            to = (tx.mix(tx.mix(gone["doc"].view(np.uint64)) + gone["line"].astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
            return C.rows(C.beside((lines, [_LINE, _WORD]), (C.deal(gone, to, np.argsort(to, kind="stable")), [_LATER])))

        for batch in batches:
            for part in tx.slices(batch, "text"):
                lines = line_sets(part.column("text"))
                first = lines.first[:-1]
                if not len(first):
                    continue
                # a set's name: two sums over its words, in any order
                h1 = np.add.reduceat(tx.mix(lines.tokens + np.uint64(1)), first)
                h2 = np.add.reduceat(tx.mix(lines.tokens ^ np.uint64(0x5851F42D4C957F2D)), first)
                ids, keys = (part.column(c).to_numpy()[lines.row] for c in ("doc_id", "text_key"))
                again = _repeats(h1, h2, ids, lines.number)
                long = lines.size >= least
                keep, repeat = np.flatnonzero(long & ~again), np.flatnonzero(long & again)
                sign, sign2 = signatures(lines)
                owner, token, place, rank = _prefixes(lines, order.value, percent, least)
                own = ~again[owner]
                owner, token, place, rank = owner[own], token[own], place[own], rank[own]
                count = np.bincount(owner, minlength=len(lines.size))[keep]
                group, blocks = _postings(token, rank)
                held.append((
                    {"h1": h1[keep], "h2": h2[keep], "doc": ids[keep], "key": keys[keep], "line": lines.number[keep].astype(np.int32), "size": lines.size[keep].astype(np.int32), "sign": sign[keep], "sign2": sign2[keep], "words": count.astype(np.int32)},
                    {"token": group, "place": place.astype(np.int32), "blocks": blocks.astype(np.int32)},
                    {"doc": ids[repeat], "line": lines.number[repeat].astype(np.int32), "key": keys[repeat]},
                ))
                n += len(token) + len(ids)
                if n >= DEAL_ROWS:
                    yield dealt()
                    held, n = [], 0
        if held:
            yield dealt()

    def classify(line: C.Columns, words: C.Columns, gone: C.Columns) -> Iterator[pa.RecordBatch]:
        """Later lines of each class (kind 0), lines at the same place as its first (1), and the first's postings (2)."""
        n = len(gone["doc"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(gone["doc"]), pa.array(gone["line"]), pa.array(gone["key"]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_CLASSED)
        if not len(line["doc"]):
            return
        start = np.cumsum(line["words"], dtype=np.int64) - line["words"]
        at = np.lexsort((line["key"], line["line"], line["doc"], line["h2"], line["h1"]))
        line, start = {k: v[at] for k, v in line.items()}, start[at]
        new = np.concatenate([[True], (line["h1"][1:] != line["h1"][:-1]) | (line["h2"][1:] != line["h2"][:-1])])
        lead = np.flatnonzero(new)
        first = lead[np.cumsum(new) - 1]
        same = (line["doc"] == line["doc"][first]) & (line["line"] == line["line"][first])
        for kind, rows in ((0, ~same), (1, same & (line["key"] != line["key"][first]))):
            hit = np.flatnonzero(rows)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), kind, np.int32)), pa.array(line["doc"][hit]), pa.array(line["line"][hit]), pa.array(line["key"][hit]), pa.array(line["key"][first[hit]]), pa.nulls(len(hit), pa.int32()), pa.nulls(len(hit), pa.binary())], schema=_CLASSED)
        own = C.ranges(start[lead], line["words"][lead].astype(np.int64))
        of = np.repeat(lead, line["words"][lead])
        rows = {"grp": words["token"][own], "doc": line["doc"][of], "line": line["line"][of], "size": line["size"][of], "place": words["place"][own], "sign": line["sign"][of], "sign2": line["sign2"][of], "side": np.zeros(len(of), np.int8)}
        rows = _spread(rows, words["blocks"][own].astype(np.int64))
        to = (tx.mix(rows["grp"]) % np.uint64(parts)).astype(np.int64)
        by = np.argsort((to << _GROUP_BITS).astype(np.uint64) | rows["grp"]) if parts < 1 << (63 - _GROUP_BITS) else np.lexsort((rows["grp"], to))
        blobs = C.deal(rows, to, by)
        n = len(blobs)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 2, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(list(blobs), pa.int32()), pa.array(list(blobs.values()), pa.binary())], schema=_CLASSED)

    classed = written(C.gathered(read.mapInArrow(describe, C.BLOB), parts, [_LINE, _WORD, _LATER], classify, "kind int, doc_id long, line int, text_key long, first_key long, part int, blob binary"), "classes")
    later = classed.where("kind = 0").select("doc_id", "text_key", "line")
    twins = classed.where("kind = 1").select("doc_id", "line", "text_key", "first_key")

    def pairs(most: int | None, probes: DataFrame | None = None) -> DataFrame:
        """Candidates (x later, y earlier); with ``probes`` (their sets), of these later lines only."""
        blobs, wanted = classed.where("kind = 2").select("part", "blob"), None
        if probes is not None:  # only groups that such a line is in are dealt
            wanted = spark.sparkContext.broadcast(membership.pair_bitmap(probes.select("doc_id", "line")))

            def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        lines = _unpacked(batch.column("words"))
                        owner, token, _, rank = _prefixes(lines, order.value, percent, least)
                        grp, blocks = _postings(token, rank)
                        own = np.unique(_spread({"grp": grp, "doc": batch.column("doc_id").to_numpy()[owner], "line": batch.column("line").to_numpy()[owner]}, blocks)["grp"]).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(own), np.int64))], names=["grp", "zero"])

            live = spark.sparkContext.broadcast(membership.pair_bitmap(written(probes.mapInArrow(groups, "grp long, zero long"), "groups")))

            def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    out = {}
                    for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                        raw = blob.as_buffer()
                        grp = C.unpacked(raw, 0, {"grp": _POSTING["grp"]})[0]["grp"]
                        keep = np.flatnonzero(live.value.inside(membership.pair_cells(grp, np.zeros(len(grp), np.int64))))
                        if len(keep):
                            out.setdefault(part, []).append(C.unpacked(raw, 0, _POSTING, keep)[0])
                    if out:
                        yield C.rows({part: C.packed({k: np.concatenate([c[k] for c in several]) for k in _POSTING}) for part, several in out.items()})

            blobs = blobs.mapInArrow(thinned, C.BLOB)

        def run(c: C.Columns) -> Iterator[pa.RecordBatch]:
            at = np.argsort((c["grp"] << np.uint64(23)) | np.minimum(c["size"], (1 << 23) - 1).astype(np.uint64)) if c["size"].max(initial=0) < 1 << 23 else np.lexsort((c["size"], c["grp"]))
            c = {k: v[at] for k, v in c.items()}
            probe = np.ones(len(at), bool) if wanted is None else wanted.value.inside(membership.pair_cells(c["doc"], c["line"]))
            x, y, more = meet(c["grp"], c["side"], c["doc"], c["line"], c["size"].astype(np.int64), c["place"].astype(np.int64), c["sign"], c["sign2"], probe, percent, most)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (c["doc"][x], c["line"][x], c["doc"][y], c["line"][y], more)], names=["x_doc", "x_line", "y_doc", "y_line", "more"])

        met = C.gathered(blobs, parts if probes is None else None, [_POSTING], run, _PAIR, parts)
        if most is None:
            each = met.groupBy("x_doc", "x_line", "y_doc", "y_line").agg(F.max("more").alias("more"))
        else:  # the earliest of all groups; a group has named ``most`` at most
            each = met.groupBy("x_doc", "x_line").agg(F.array_sort(F.collect_set(F.struct("y_doc", "y_line"))).alias("ys"), F.max("more").alias("more"))
            each = each.select("x_doc", "x_line", F.explode(F.slice("ys", 1, most)).alias("y"), (F.col("more") | (F.size("ys") > most)).alias("more")).select("x_doc", "x_line", "y.*", "more")
        return written(each.coalesce(parts), "pairs")

    def verified(found: DataFrame, few: bool = False) -> tuple[DataFrame, DataFrame]:
        """The later lines of pairs whose sets are similar (x_doc, x_line, text_key); and the sets of later lines.

        ``few``: so few texts have such lines that the others had better not go to Python.
        """
        flags = spark.sparkContext.broadcast(membership.end_bitmaps(found.select("x_doc", "x_line", "y_doc", "y_line")))

        def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            xs, ys, texts = flags.value
            for batch in batches:
                batch = batch.filter(pa.array(texts.inside(batch.column("cell").to_numpy())))
                for part in tx.slices(batch, "text"):
                    data, offsets = tx.buffers(part.column("text"))
                    start, end, row, number = bounds(data, offsets)
                    ids = part.column("doc_id").to_numpy()[row]
                    # only lines that are an end of a pair are parsed
                    cells = membership.pair_cells(ids, number)
                    later, earlier = xs.inside(cells), ys.inside(cells)
                    at = np.flatnonzero(later | earlier)
                    size = end[at] - start[at]
                    own = of_buffers(data[C.ranges(start[at], size)], np.concatenate([[0], np.cumsum(size)]))
                    own = own.where(own.size >= least)
                    if len(own.size):
                        at = at[own.row]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), part.column("text_key").take(pa.array(row[at])), pa.array(number[at].astype(np.int32)), pa.array(later[at]), pa.array(earlier[at]), _packed(own)], names=["doc_id", "text_key", "line", "later", "earlier", "words"])

        @F.arrow_udf("boolean")
        def asked(cells: pa.Array) -> pa.Array:
            return pa.array(flags.value[2].inside(cells.to_numpy()))

        celled = read.withColumn("cell", membership.cell("doc_id"))
        sets = (celled.where(asked("cell")) if few else celled).mapInArrow(read_sets, "doc_id long, text_key long, line int, later boolean, earlier boolean, words binary")
        held = written(sets, "sets")

        def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    a, b = _unpacked(batch.column("a")), _unpacked(batch.column("b"))
                    both = _common(a, b)
                    hits = 100 * both >= percent * (a.size + b.size - both)
                    yield batch.drop_columns(["a", "b"]).filter(pa.array(hits))

        # later and earlier lines are two tables, of a line only where it may be one
        left = held.where("later").select(F.col("doc_id").alias("x_doc"), F.col("line").alias("x_line"), "text_key", F.col("words").alias("a"))
        right = held.where("earlier").select(F.col("doc_id").alias("y_doc"), F.col("line").alias("y_line"), F.col("words").alias("b"))
        both = found.drop("more").join(left, ["x_doc", "x_line"]).join(right, ["y_doc", "y_line"]).select("x_doc", "x_line", "text_key", "a", "b")
        return both.coalesce(parts).mapInArrow(similar, "x_doc long, x_line int, text_key long").distinct().coalesce(parts), held.where("later")

    early = pairs(TRIES)
    found, sets = verified(early)
    settled = written(found, "settled")
    x = ["x_doc", "x_line"]
    # texts of one id share a place: it is settled if all of them are
    open_x = early.where("more").select(x).distinct()
    flags = spark.sparkContext.broadcast(membership.bitmap(open_x, *x))

    # only sets of lines that had more candidates are dealt
    @F.arrow_udf("boolean")
    def may_be_open(cells: pa.Array) -> pa.Array:
        return pa.array(flags.value.inside(cells.to_numpy()))

    at = sets.select(F.col("doc_id").alias("x_doc"), F.col("line").alias("x_line"), "text_key", "words").where(may_be_open(membership.cell(*x)))
    rest = written(open_x.join(at, x).join(settled, [*x, "text_key"], "left_anti").select(F.col("x_doc").alias("doc_id"), F.col("x_line").alias("line"), "words").coalesce(parts), "rest")
    if rest.head(1):
        settled = settled.unionAll(written(verified(pairs(None, rest), few=True)[0], "settled"))
    going = settled.select(F.col("x_doc").alias("doc_id"), "text_key", F.col("x_line").alias("line")).distinct()
    beside = twins.join(going.withColumnRenamed("text_key", "first_key"), ["doc_id", "line", "first_key"]).select("doc_id", "text_key", "line")
    return later.unionByName(going).unionByName(beside)


_CLASSED = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("line", pa.int32()), ("text_key", pa.int64()), ("first_key", pa.int64()), ("part", pa.int32()), ("blob", pa.binary())])


def _packed(lines: Lines) -> pa.Array:
    """Each line's words, eight bytes a word."""
    return pa.Array.from_buffers(pa.binary(), len(lines.size), [None, pa.py_buffer((8 * lines.first).astype(np.int32)), pa.py_buffer(lines.tokens.tobytes())])


def _unpacked(words: pa.Array) -> Lines:
    data, offsets = tx.buffers(words)
    size = np.diff(offsets) // 8
    row = np.arange(len(size))
    return Lines(row, row, size, np.frombuffer(data.tobytes(), "<u8"), np.repeat(row, size))


def _common(a: Lines, b: Lines) -> np.ndarray:
    """How many words the k-th line of one has in common with the k-th of the other."""
    owner, words = np.concatenate([a.owner, b.owner]), np.concatenate([a.tokens, b.tokens])
    order = by_owner(owner, words)
    owner, words = owner[order], words[order]
    twice = (owner[1:] == owner[:-1]) & (words[1:] == words[:-1])
    return np.bincount(owner[1:][twice], minlength=len(a.size))


def dedup(docs: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, counts: bool = True) -> DataFrame:
    """``docs`` without later similar lines in ``text``; with ``counts``, plus ``n_lines`` and ``n_removed``.

    Rows stay, if need be with an empty text; n_chars, where there is one, is counted anew.  A null
    text stays null (0 lines); no rows give none.  With ``counts``, columns of the two names are
    replaced; other columns stay as they are, whatever their names.  ``least``: lines of fewer distinct
    words stay, and take part in nothing (1: none does).
    """
    gone = later_lines(docs, percent, least).groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("gone"))
    taken = [*docs.columns, "n_lines", "n_removed"]
    doc, key, cell, lost, removed, lines = (C.unused(c, taken) for c in ("_doc", "_key", "_cell", "_gone", "_removed", "_lines"))
    gone = written(gone.select(F.col("doc_id").alias(C.unused("_doc2", taken)), F.col("text_key").alias(C.unused("_key2", taken)), F.col("gone").alias(lost)), "gone")
    flags = docs.sparkSession.sparkContext.broadcast(membership.bitmap(gone, *gone.columns[:2]))

    # only the cells go to Python; texts stay
    @F.arrow_udf("boolean")
    def may_lose(cells: pa.Array) -> pa.Array:
        return pa.array(flags.value.inside(cells.to_numpy()))

    columns = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_removed")]
    kept = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias(doc), F.xxhash64("text").alias(key)).withColumn(cell, membership.cell(doc, key))
    losing = kept.where(may_lose(cell)).join(gone, (F.col(doc) == F.col(gone.columns[0])) & (F.col(key) == F.col(gone.columns[1])), "left").select(*columns, lost)
    schema = StructType([*docs.select(columns).schema.fields, StructField(lines, IntegerType()), StructField(removed, IntegerType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                at = part.schema.get_field_index("text")
                text, *numbers = without(part.column("text"), part.column(lost))
                out = part.set_column(at, part.schema.field(at), text.cast(part.schema.field(at).type)).drop_columns([lost])
                for name, values in zip((lines, removed), numbers, strict=True):
                    out = out.append_column(name, pa.array(values, pa.int32()))
                yield out

    changed = losing.mapInArrow(cut, schema)
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n")))
    same = kept.where(~may_lose(cell)).select(*columns, F.coalesce(breaks + 1, F.lit(0)).alias(lines), F.lit(0).alias(removed))
    out = changed.unionByName(same)
    return out.select(*columns, F.col(lines).alias("n_lines"), F.col(removed).alias("n_removed")) if counts else out.select(docs.columns)


def without(column: pa.Array, gone: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts without the lines whose numbers ``gone`` lists (null: none), how many lines each had, and how many it lost.

    A null text stays null, without lines.
    """
    data, offsets = tx.buffers(column)
    start, end, row, _ = bounds(data, offsets)
    n = len(column)
    first = np.searchsorted(row, np.arange(n))
    of = np.repeat(np.arange(n), gone.value_lengths().fill_null(0).to_numpy())
    lost = np.zeros(len(start), dtype=bool)
    lost[first[of] + gone.flatten().to_numpy().astype(np.int64)] = True
    keep = np.ones(len(data), dtype=bool)
    keep[C.ranges(start[lost], (end - start)[lost])] = False
    # of the line feeds, those after lines that stay are kept, but for that after a text's last such line
    breaks = np.flatnonzero(data == 10)
    of_break = np.searchsorted(offsets, breaks, "right") - 1
    line = np.arange(len(breaks)) + of_break
    left = np.bincount(row[~lost], minlength=n)
    place = np.cumsum(~lost)
    place -= (place - ~lost)[first][row]
    keep[breaks[lost[line] | (place[line] >= left[of_break])]] = False
    total = np.concatenate([[0], np.cumsum(keep)])
    null = column.is_null().to_numpy(zero_copy_only=False)
    valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()) if null.any() else None
    out = pa.Array.from_buffers(pa.large_string(), n, [valid, pa.py_buffer(total[offsets].astype(np.int64)), pa.py_buffer(data[keep].tobytes())])
    return out, np.where(null, 0, np.bincount(row, minlength=n)), np.bincount(of, minlength=n)
