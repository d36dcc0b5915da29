"""N-gram Jaccard join by adaptive multi-match prefixes.

A document is the set of its word n-grams.  Documents of equal sets are one class; the work
is on classes.  Two classes link when 100 * intersection >= percent * union.

1. Frequencies of all n-grams (``rarity``) give one global order: rare first.
2. Linked sets share an n-gram among each other's rarest n - ceil(percent * n / 100) + 1.  These
   prefixes, less the n-grams that no second document has, are range-sorted by n-gram and size.
   Neighbours there whose sizes still allow a link are joined, which joins all pairs whose sizes do;
   components of these chains are blocks.  No link crosses blocks.
3. Inside a block each class lengthens its prefix by m - 1, where m minimises the estimated cost of
   scanning the prefix's n-grams plus verifying the candidates that they leave: linked sets share
   min(m, m') n-grams of their lengthened prefixes, so candidates must have that many in common.
   Those are verified exactly.  A pair that is connected already isn't verified again.
4. Blocks over ``CHUNK`` classes (or ``CHUNK_TOKENS`` n-grams) are first split: sets that share a prefix n-gram
   meet there, and those whose ``sketch``es allow a link make smaller blocks (``_refined``).  Chance meetings, which
   join ever more sets as a corpus grows, end there, without the sets themselves.
5. Blocks that are still over ``CHUNK`` classes (or ``CHUNK_TOKENS`` n-grams) are dealt into chunks by hash, joined
   within chunks, dealt and joined anew, and then chunk by chunk against each other, without pairs of
   chunks that lie in one component already.

Components of the verified links are those of the full link graph, as only pairs known to be
connected are left out.  All steps but the texts' own reading are on tables of one row a class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import membership
from quillstream.llm import rarity as rare
from quillstream.llm import text as tx
from quillstream.llm.columns import unused
from quillstream.llm.graph import components, contract
from quillstream.llm.storage import written

CHUNK, CHUNK_TOKENS = 256, 400_000
#: Rows of a token that meet in one task; a more frequent one is dealt in pairs of blocks of about as many.
MEET = 4096
LEVELS = np.array([1, 2, 4, 8, 16])
#: Rows of small tables (classes, members), and n-grams of tables of sets, that are worth a task and a file.
TASK_ROWS, TASK_TOKENS = 1 << 16, 1 << 19


def least_overlap(n: int, percent: int) -> int:
    """The least intersection of a set of n with any linked one."""
    return -(-percent * n // 100)


def level(frequency: np.ndarray, n: int, percent: int) -> int:
    """How many shared prefix n-grams to ask for, given the frequencies of the set's n-grams in order.

    At level m the prefix has n - overlap + m n-grams.  Scanning costs the sum of their frequencies; of
    the sets met, one in m can have m of them at most, and each of these costs a merge of two sets.
    """
    base = n - least_overlap(n, percent)
    reach = np.cumsum(frequency)
    levels = LEVELS[LEVELS <= max(1, n - base)]
    met = reach[base + levels - 1].astype(float)
    others = met - (base + levels)
    return int(levels[np.argmin(met + others / levels * (8 + n / 16))])


def sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's n-grams as ascending distinct hashes."""
    shingles, bounds, _ = tx.texts_shingles(column, n)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.unique(shingles[a:b])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(own: np.ndarray) -> bytes:
    """Parities of the set's hashes by cell, a bit a cell: two sets differ in as many n-grams at least as their bits do.

    There are 64 bits at least, and about half to one a member, in a power of two: folded, a longer sketch is that of fewer bits.
    """
    bits = max(64, 1 << (max(1, len(own) - 1).bit_length() - 1))
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """A sketch as 64-bit words, of ``size`` bytes."""
    words = np.frombuffer(raw, np.uint64)
    while len(words) * 8 > size:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def allowed(sizes: np.ndarray, sketches: list[bytes], sides: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs that connect all sets whose sizes and sketches allow a link; sides 0 meet all, others the other side."""
    width = min(len(x) for x in sketches)
    bits = np.array([folded(x, width) for x in sketches])
    left = np.arange(len(sizes))
    while len(left):
        # from one set on, those met become the next to meet the rest
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            total = sizes[i] + sizes[left]
            near = 100 * np.minimum(sizes[i], sizes[left]) >= percent * np.maximum(sizes[i], sizes[left])
            near &= (sides[i] == 0) | (sides[left] != sides[i])
            at = np.flatnonzero(near)
            apart = np.bitwise_count(bits[left[at]] ^ bits[i]).sum(axis=1, dtype=np.int64)
            hit = at[apart <= total[at] - 2 * -(-percent * total[at] // (100 + percent))]
            for j in left[hit].tolist():
                yield i, j
                todo.append(j)
            left = np.delete(left, hit)


class _Index:
    """Which sets hold a token: postings in one array."""

    def __init__(self, parts: list[np.ndarray]):
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        names, self.first = np.unique(tokens[order], return_index=True)
        self.names, self.end = names, np.append(self.first[1:], len(tokens))

    def owners(self, tokens: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.names, tokens)
        a, b = self.first[at], self.end[at]
        size = b - a
        total = int(size.sum())
        step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        return self.owner[np.repeat(a, size) + step]


def forest(own: list[np.ndarray], percent: int, order: rare.Rarity, group: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the sets' links connect: at most one fewer than there are sets.

    ``group``: sets known to be connected.  ``side``: only pairs of different sides are looked at.
    """
    n = len(own)
    group = np.arange(n) if group is None else np.unique(group, return_inverse=True)[1].astype(np.int64)
    sizes = np.array([len(s) for s in own])
    found: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        found.append((i, j))
        group[group == group[j]] = group[i]

    if n <= 6:
        for i in range(n):
            for j in range(i):
                if group[i] != group[j] and (side is None or side[i] != side[j]) and linked(own[i], own[j], percent):
                    join(i, j)
        return found
    prefixes, levels = [], []
    for s in own:
        tokens, frequency = order.ordered(s)
        m = level(frequency, len(s), percent)
        levels.append(m)
        prefixes.append(tokens[: len(s) - least_overlap(len(s), percent) + m])
    base = np.array([len(p) - m for p, m in zip(prefixes, levels, strict=True)])
    level_of = np.array(levels)
    # For each level, prefixes of that level of all sets that have it
    index = {m: _Index([p[: b + m] if q >= m else p[:0] for p, b, q in zip(prefixes, base, levels, strict=True)]) for m in sorted(set(levels))}
    full: _Index | None = None
    for i in np.argsort(sizes, kind="stable").tolist():
        near = np.zeros(n, dtype=bool)
        for m, postings in index.items():
            if m > levels[i]:
                break
            shared = np.bincount(postings.owners(prefixes[i][: base[i] + m]), minlength=n)
            near |= (shared >= m) & ((level_of == m) | (level_of >= m if m == levels[i] else False))
        # each pair from its larger set, ties from the later
        near &= (group != group[i]) & (100 * sizes >= percent * sizes[i]) & ((sizes < sizes[i]) | ((sizes == sizes[i]) & (np.arange(n) < i)))
        if side is not None:
            near &= side != side[i]
        candidates = np.flatnonzero(near)
        if len(candidates) > 6:
            full = full or _Index(own)
            both = np.bincount(full.owners(own[i]), minlength=n)[candidates]
            hits = candidates[100 * both >= percent * (sizes[candidates] + sizes[i] - both)]
            for j in hits.tolist():
                if group[i] != group[j]:
                    join(i, j)
        else:
            for j in candidates.tolist():
                if group[i] != group[j] and linked(own[i], own[j], percent):
                    join(i, j)
    return found


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys (64-bit integers) of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(key)[-1].as_py() != int(keys[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _arrays(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(raw, np.uint64) for raw in table.column("tokens").to_pylist()]


_EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _dealt(rows: DataFrame, run, parts: int) -> DataFrame:
    return rows.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(run, "a binary, b binary")


_CHAIN = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("range", pa.int32()), ("token", pa.int64()), ("n", pa.int64())])


def _chains(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): of each token's sets, sorted by size, the neighbours whose sizes allow a link.

    ``postings``: token, n (the set's size), b (its name).  They are range-sorted, so a frequent token has as many
    tasks as it needs; neighbours in two ranges are found from the ranges' first and last rows.
    """
    spark = postings.sparkSession

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            token, n, b = (batch.column(c).to_numpy() for c in ("token", "n", "b"))
            first = first or (int(token[0]), int(n[0]), int(b[0]))
            if last is not None:
                token, n, b = (np.concatenate([[x], c]) for x, c in zip(last, (token, n, b), strict=True))
            last = (int(token[-1]), int(n[-1]), int(b[-1]))
            hit = np.flatnonzero((token[1:] == token[:-1]) & (b[1:] != b[:-1]) & (100 * n[:-1] >= percent * n[1:]))
            none = pa.nulls(len(hit), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(b[hit]), pa.array(b[hit + 1]), pa.nulls(len(hit), pa.int32()), none, none], schema=_CHAIN)
        if first is not None:
            own = TaskContext.get().partitionId()
            for k, (token, n, b) in enumerate((first, last)):
                yield pa.RecordBatch.from_pylist([{"a": k, "b": b, "range": own, "token": token, "n": n}], schema=_CHAIN)

    by = ["token", "n", "b"]
    found = written(postings.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(chain, "a long, b long, range int, token long, n long"), "chains")
    edges = sorted((r.range, r.a, r.token, r.n, r.b) for r in found.where("range is not null").collect())  # two rows a range
    over = [(x[4], y[4]) for x, y in zip(edges, edges[1:], strict=False) if x[0] != y[0] and x[2] == y[2] and x[4] != y[4] and 100 * x[3] >= percent * y[3]]
    inside = found.where("range is null").select("a", "b")
    return inside.unionAll(spark.createDataFrame(over, "a long, b long")) if over else inside


def _refined(large: DataFrame, percent: int, order, parts: int) -> DataFrame:
    """(node, root): blocks of the sets of ``large`` (short, n, prefix, sketch) that share a prefix n-gram and may link.

    A token's sets meet in one task, those of a very frequent one in pairs of blocks; edges leave a task as stars.
    Each token's sets are dealt by it and their sketches' width, those that a set with a shorter sketch may be linked
    with by that width, too.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                short, n, raw = (batch.column(c)[row].as_py() for c in ("short", "n", "sketch"))
                tokens = batch.column("prefix")[row].values.to_numpy().view(np.uint64)
                blocks = np.minimum(-(-order.value.frequency(tokens) // MEET), 1 << 20)
                grp, side = [], []
                shorter = len(raw) > 8 and least_overlap(n, percent) <= 8 * len(raw)  # sets with shorter sketches may be linked
                for width in (len(raw), len(raw) // 2) if shorter else (len(raw),):
                    at = np.repeat(np.arange(len(tokens)), blocks)
                    own = (tx.mix(np.full(len(at), short, np.int64).view(np.uint64)) % blocks[at].astype(np.uint64)).astype(np.int64)
                    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    pair = (np.minimum(own, other) << 32 | np.maximum(own, other)).astype(np.uint64)
                    grp.append(tx.mix(tokens[at] + tx.mix(pair + np.uint64(width << 24))).view(np.int64))
                    side.append(np.where(own == other, 0, np.where(own < other, 1, 2)))
                grp, side = np.concatenate(grp), np.concatenate(side)
                yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(side.astype(np.int32)), pa.array(np.full(len(grp), short)), pa.array(np.full(len(grp), n)), pa.array([raw] * len(grp), pa.binary())], names=["grp", "side", "short", "n", "sketch"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of many small groups, edges of one batch
        n = 0
        for table in grouped(batches, "grp"):
            if table.num_rows > 1:
                short = table.column("short").to_numpy()
                pairs = list(allowed(table.column("n").to_numpy(), table.column("sketch").to_pylist(), table.column("side").to_numpy(), percent))
                if pairs:
                    held.append(short[np.array(pairs)])
                    n += len(pairs)
                if n >= 1 << 13:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(held).T], names=["a", "b"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(held).T], names=["a", "b"])

    posted = large.mapInArrow(post, "grp long, side int, short long, n long, sketch binary")
    met = posted.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(lambda batches: contract(meet(batches)), "a long, b long")
    return components(met, settled=True)


def link_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row, with the
    text's xxhash64 as text_key and the component's name as root (null without n-grams).

    A null or empty text, or one without words, has no n-gram and is linked with nothing: its component
    is its own doc_id.  Texts of 1 to n - 1 words have one n-gram, all of them.  Rows of equal sets are
    linked, whatever their ids; a null doc_id is never a component's least unless all of it are null.
    Columns besides doc_id and text are left out; no rows give none.
    """
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")

    parts = rare.n_parts(read.select("text"), 8)

    def all_tokens(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in tx.slices(batch, "text"):
            yield from sets(part.column("text"), n)

    order = spark.sparkContext.broadcast(rare.measure(read.select("text"), all_tokens))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in tx.slices(batch, "text"):
                size, names, prefix, sketches = [], [], [], []
                for own in sets(part.column("text"), n):
                    size.append(len(own))
                    name = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
                    names.append(name)
                    if name is None or name in seen:
                        prefix.append(None)
                        sketches.append(None)
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(name)
                    first = order.value.ordered(own)[0][: len(own) - least_overlap(len(own), percent) + 1]
                    prefix.append(first[order.value.may_repeat(first)].view(np.int64))
                    sketches.append(sketch(own) if len(prefix[-1]) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(size, pa.int64()), pa.array(names, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "text_key", "n_shingles", "cls", "prefix", "sketch"])

    described = written(read.mapInArrow(describe, "doc_id long, text_key long, n_shingles long, cls binary, prefix array<bigint>, sketch binary"), "described")
    # 1. classes, and blocks of classes that meet in a prefix.  Short names only group candidates.
    short = F.xxhash64("cls")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("text_key").alias("k"))
    classes = described.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.min(place).alias("at"), F.max("n_shingles").alias("n"))
    blocks = components(_chains(described.where(F.size("prefix") > 0).select(F.explode("prefix").alias("token"), F.col("n_shingles").alias("n"), short.alias("b")), percent))
    # small tables in few files: without Hadoop's native code, each file of a local file system costs processes, too
    few = max(1, -(-described.count() // TASK_ROWS))
    named = written(classes.withColumn("short", short).coalesce(few), "classes")
    members = named.join(blocks.withColumnRenamed("node", "short"), "short").select("cls", "n", "at", "short", F.col("root").alias("block"))

    def chunked(members: DataFrame) -> DataFrame:
        total = members.groupBy("block").agg(F.count("*").alias("k"), F.sum("n").alias("tokens"))
        chunks = F.greatest(F.ceil(F.col("k") / CHUNK), F.ceil(F.col("tokens") / CHUNK_TOKENS))
        return written(members.join(total.hint("rebalance"), "block").select("cls", "n", "at", "short", "block", chunks.cast("int").alias("chunks")).coalesce(few), "members")

    members = chunked(members)
    large = members.where("chunks > 1")
    if large.select("cls").head(1):
        prefixes = described.where(F.size("prefix") > 0).select("cls", "prefix", "sketch").join(large.select("cls", "short", "n"), "cls").dropDuplicates(["cls"])
        smaller = _refined(prefixes.select("short", "n", "prefix", "sketch"), percent, order, parts)
        inner = large.select("cls", "n", "at", "short").join(smaller.withColumnRenamed("node", "short"), "short").select("cls", "n", "at", "short", F.col("root").alias("block"))
        members = members.where("chunks = 1").unionByName(chunked(inner))

    # 2. their sets, from one text of each class; of rows of one id and text, each task gives one
    flags = spark.sparkContext.broadcast(membership.bitmap(members.select("at.d", "at.k"), "d", "k"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            batch = batch.filter(pa.array(flags.value.inside(batch.column("cell").to_numpy())))
            for part in tx.slices(batch, "text"):
                new = {}
                for own in sets(part.column("text"), n):
                    raw = own.tobytes()
                    name = hashlib.blake2b(raw, digest_size=16).digest()
                    if name not in seen:
                        new[name] = raw
                if len(seen) >= 200_000:
                    seen.clear()
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(list(new.values()), pa.binary())], names=["cls", "tokens"])

    keyed = read.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("text_key").alias("k"), "text")
    fetched = keyed.select(membership.cell("d", "k").alias("cell"), "text").mapInArrow(fetch, "cls binary, tokens binary").join(members.select("cls", "block", "chunks"), "cls")
    worth = max(1, -(-(members.agg(F.sum("n")).head()[0] or 0) // TASK_TOKENS))
    held = written(fetched.dropDuplicates(["cls"]).withColumn("grp", F.xxhash64("block", F.pmod(F.xxhash64("cls"), "chunks"))).coalesce(worth), "sets")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "grp"):
            names = table.column("cls").to_pylist()
            if len(names) > 1:
                pairs = forest(_arrays(table), percent, order.value)
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in pairs], pa.binary()), pa.array([names[j] for _, j in pairs], pa.binary())], schema=_EDGE)

    links = [written(_dealt(held.select("cls", "tokens", "grp"), within, parts), "links")]
    large = held.where("chunks > 1")
    if large.select("cls").head(1):
        again = large.select("cls", "tokens", F.xxhash64(F.lit("again"), "block", F.pmod(F.xxhash64(F.lit("again"), "cls"), "chunks")).alias("grp"))
        links.append(written(_dealt(again, within, parts), "links"))
        links.append(_across(large, links[0].unionAll(links[1]), percent, order, parts, worth))
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionAll(more)
    roots = components(edges)
    rooted = named.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = rooted.join(lowest.hint("rebalance"), "root").select("cls", "root", "component_id")
    out = described.select("doc_id", "text_key", "n_shingles", "cls").join(placed, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_key", "root")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the least doc_id (nulls last), then the least text_key.

    Rows without words stay, repeated ones too; columns of any names stay; no rows give none.
    """
    linked = link_components(docs, n, percent).where("root is not null")
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    stays = linked.groupBy("root").agg(F.min(F.struct(last.alias("d"), F.col("text_key").alias("k"))).alias("at")).select("at.*").distinct()
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    doc, key = (unused(c, docs.columns) for c in ("_doc", "_key"))
    keyed = docs.where(wordy).withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn(key, F.xxhash64("text"))
    kept = keyed.join(stays, (keyed[doc] == stays["d"]) & (keyed[key] == stays["k"]), "left_semi").dropDuplicates([doc, key]).drop(doc, key)
    return kept.unionByName(docs.where(~wordy))


def _across(large: DataFrame, edges: DataFrame, percent: int, order, parts: int, worth: int) -> DataFrame:
    """Links between chunks of one block.  A component of a chunk's size or more has chunks of its own, of
    which no two are compared; the other classes share chunks.  ``worth``: tasks that the sets are worth."""
    roots = components(edges)
    known = large.select("cls", "block", "chunks", "tokens").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    size = known.groupBy("block", "root").agg(F.count("*").alias("size"))
    own = known.join(size.hint("rebalance"), ["block", "root"])
    pure = F.col("size") >= CHUNK
    chunk = F.when(pure, F.xxhash64("root", F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / CHUNK)))).otherwise(F.xxhash64("block", F.pmod(F.xxhash64("cls"), "chunks")))
    dealt = written(own.select("cls", "block", "root", "tokens", chunk.alias("chunk"), F.when(pure, F.col("root")).alias("whole")).coalesce(worth), "dealt")
    names = dealt.select("block", "chunk", "whole").distinct()
    left, right = (names.select("block", *(F.col(c).alias(f"{c}_{s}") for c in ("chunk", "whole"))) for s in "xy")
    pairs = left.join(right, "block").where("chunk_x <= chunk_y and not coalesce(whole_x = whole_y, false)").select("block", "chunk_x", "chunk_y", F.xxhash64("block", "chunk_x", "chunk_y").alias("grp"))
    sides = pairs.select("block", F.col("chunk_x").alias("chunk"), "grp", F.lit(0).alias("side")).unionAll(pairs.where("chunk_x <> chunk_y").select("block", F.col("chunk_y").alias("chunk"), "grp", F.lit(1).alias("side")))
    rows = dealt.join(sides, ["block", "chunk"]).select("cls", "root", "tokens", "grp", "side")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "grp"):
            cls, side = table.column("cls").to_pylist(), table.column("side").to_numpy()
            roots_here = {r: k for k, r in enumerate(dict.fromkeys(table.column("root").to_pylist()))}
            group = np.array([roots_here[r] for r in table.column("root").to_pylist()])
            pairs = forest(_arrays(table), percent, order.value, group, side if len(set(side.tolist())) > 1 else None)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([cls[i] for i, _ in pairs], pa.binary()), pa.array([cls[j] for _, j in pairs], pa.binary())], schema=_EDGE)

    return written(_dealt(rows, between, parts), "links")
