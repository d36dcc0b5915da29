"""Byte-pair encoding by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be merged across, so
a text is cut there, its fragments encoded one by one, and the ids joined.  A cut must
also leave the pre-tokeniser's pieces as they were, hence three further conditions, each on
the two bytes at the cut: the left one is printable ASCII and no white space (white space
before a word decides how a run of blanks is split), the right one begins a character, and
it isn't an apostrophe (which opens a contraction).  Then the right fragment starts where
the pre-tokeniser starts a piece, or in the midst of a piece that no merge spans.

Cuts are found with numpy over a whole Arrow batch, and every one is taken.  Fragments are a few
bytes long and repeat, so those of up to 16 bytes are looked up among those met before, all of a slice at
once in arrays (two words and a length say which fragment it is; one that falls on another's place
takes it); the others are split into the pre-tokeniser's pieces and merged here by rank: short pieces of a whole slice side by side,
one merge a piece at a time; long ones (runs of blanks or letters of any length) with all places of a
rank at once.

Everything is read from the tokenizers library's JSON file: vocabulary, merges, added tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillstream.llm import text as tx
from quillstream.llm.columns import ranges

#: Bytes of a fragment that is kept for the next time, its ids, and the number of these; bytes of a piece that is merged beside others.
SHORT, FEW_IDS, KEPT, FEW = 16, 8, 1 << 20, 64
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Fixed value: the pieces that byte-level vocabularies of this kind are merged in.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Fixed value: all characters below it were assigned long ago.
STABLE = "\u0530"
# Bytes of letters for certain: of ASCII, U+00C0 to U+01FF (but for two signs), U+0400 to U+047F, U+5000 to U+8FFF
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xC8), 0xD0, 0xD1, *range(0xE5, 0xE9)]] = True
_SIGNS = (0xC397, 0xC3B7)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself if it can be printed, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def fragment_keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second eight bytes of each fragment as numbers, zeros beyond its end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
    return eight[start] & tx.LOWEST[np.minimum(size, 8)], eight[start + 8] & tx.LOWEST[np.clip(size - 8, 0, 8)] if len(start) else eight[start]


class Known:
    """Short fragments with their ids: arrays with a place for each hash, of the latest fragment there."""

    def __init__(self, most: int, kind: np.dtype):
        self.bits = max(1, (most - 1).bit_length())
        self.low, self.high = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.size, self.count = np.zeros(1 << self.bits, np.uint8), np.zeros(1 << self.bits, np.uint8)
        self.ids = np.zeros((1 << self.bits) * FEW_IDS, kind)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each fragment's place, and whether it is there."""
        slot = (tx.mix(tx.mix(low + size.astype(np.uint64)) ^ high) >> np.uint64(64 - self.bits)).astype(np.int64)
        return slot, (self.low[slot] == low) & (self.size[slot] == size) & (self.high[slot] == high)

    def copy(self, slot: np.ndarray, count: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
        """The ids of the fragments there to ``out`` from ``at`` on."""
        k = 0
        while len(slot):
            out[at + k] = self.ids[slot * FEW_IDS + k]
            k += 1
            more = count > k
            slot, count, at = slot[more], count[more], at[more]

    def keep(self, slot: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, count: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> None:
        slot, one = np.unique(slot, return_index=True)  # one fragment a place
        self.low[slot], self.high[slot], self.size[slot], self.count[slot] = low[one], high[one], size[one], count[one]
        self.ids[ranges(slot * FEW_IDS, count[one])] = ids[ranges(begin[one], count[one])]


class Encoder:
    """Encodes as the tokenizers library does with the file's tokenizer and without added special tokens.

    Added tokens' strings in a text become their ids, as that library has it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.token = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.token[i] = bytes(letters[c] for c in token)
        for raw, i in self.added.items():
            self.token[i] = raw
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # merges by rank, and their pairs in order
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order
        self.of_byte = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pair = np.arange(1 << 16)
        self.byte_ranks = self._ranks(self.of_byte[pair >> 8], self.of_byte[pair & 255])
        self.byte_ranks[self.byte_ranks < 0] = len(self.merged)
        # Versions of Unicode differ in their letters beyond STABLE, so there the file's own pre-tokeniser is asked.
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.piece = regex.compile(PIECE)
        self.known: Known | None = None
        self.marks = regex.compile(b"(" + b"|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + b")" if self.added else b"$^")
        self.certain = np.ones(1 << 16, dtype=bool)
        for token in self.token:
            if len(token) > 1 and token not in self.added:
                raw = np.frombuffer(token, np.uint8).astype(np.int64)
                self.certain[raw[:-1] * 256 + raw[1:]] = False
        pair = np.arange(1 << 16)
        left, right = pair >> 8, pair & 255
        self.certain &= (left > 0x20) & (left < 0x7F) & ((right < 0x80) | (right >= 0xC0)) & (right != 0x27)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions before which the bytes may be cut."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        pair = data[:-1].astype(np.uint16) << np.uint16(8)
        pair |= data[1:]
        return np.flatnonzero(self.certain[pair]) + 1

    def pieces(self, fragment: bytes) -> list[bytes]:
        text = fragment.decode()
        if max(text) < STABLE:
            return [m.encode() for m in self.piece.findall(text)]
        return [text[a:b].encode() for _, (a, b) in self.split(text)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; -1 for those that are never merged."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge_few(self, raw: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the bytes of pieces (``owner``, ascending): merges in each the first pair of least rank, until none has one."""
        never = len(self.merged)
        ids, done = self.of_byte[raw], []
        rank = np.full(len(ids), never)
        if len(ids):
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.byte_ranks[(raw[:-1].astype(np.int64) << 8) | raw[1:]], never)
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            if (over := least == never).any():
                over = np.repeat(over, size)
                done.append((ids[over], owner[over]))
                ids, owner, rank = ids[~over], owner[~over], rank[~over]
                least, size = least[least < never], size[least < never]
            if not len(ids):
                break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])]
            ids[hit] = self.merged[rank[hit]]
            stays = np.ones(len(ids), dtype=bool)
            stays[hit + 1] = False
            at = hit - np.arange(len(hit))  # where they are then
            ids, owner, rank = ids[stays], owner[stays], rank[stays]
            rank[at] = never
            before, after = at[at > 0] - 1, at[at < len(ids) - 1]
            for near in (before[owner[before] == owner[before + 1]], after[owner[after] == owner[after + 1]]):
                new = self._ranks(ids[near], ids[near + 1])
                rank[near] = np.where(new < 0, never, new)
        if not done:
            return ids, owner
        ids, owner = (np.concatenate(c) for c in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def merge_many(self, ids: np.ndarray) -> np.ndarray:
        """The same for long pieces: a linked list in arrays, and for each rank the places where it came up.

        A merge's result is in no pair of a lower rank, so all places of a rank are merged at once; where
        they overlap (runs of one id), every other one from the left.
        """
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, dtype=bool)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(left: np.ndarray) -> None:
            rank = self._ranks(ids[left], ids[after[left]])
            left, rank = left[rank >= 0], rank[rank >= 0]
            if not len(left):
                return
            order = np.argsort(rank, kind="stable")
            names, first = np.unique(rank[order], return_index=True)
            for name, own in zip(names.tolist(), np.split(left[order], first[1:]), strict=True):
                if name not in places:
                    heapq.heappush(queue, name)
                places.setdefault(name, []).append(own)

        note(np.arange(n - 1))
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[alive[at] & (after[at] < n)]
            at = at[self._ranks(ids[at], ids[after[at]]) == rank]
            if not len(at):
                continue
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            start = np.flatnonzero(~chained)
            step = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
            at = at[step % 2 == 0]
            gone = after[at]
            ids[at] = self.merged[rank]
            alive[gone] = False
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            left = before[at[before[at] >= 0]]
            note(np.unique(np.concatenate([left, at[inner]])))
        return ids[alive]

    def encode_fragments(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the fragments data[start:end], one after the other, and how many each has."""
        size = end - start
        raw = data[ranges(start, size)]
        first = np.cumsum(size) - size
        letter = _LETTER[raw]
        letter[first] |= raw[first] == 0x20
        pair = (raw[:-1].astype(np.int64) << 8) | raw[1:]
        letter[np.flatnonzero(np.isin(pair, _SIGNS))] = False
        # a run of letters, perhaps after a blank, is one piece
        one = (np.minimum.reduceat(letter, first) & (size <= FEW)) if len(size) else letter
        few = np.repeat(one, size)
        of = np.repeat(np.arange(len(size)), size)[few]
        ids, of = self.merge_few(raw[few], of)
        found, owner = [ids], [of]
        pieces, belongs = [], []
        for k in np.flatnonzero(~one).tolist():
            own = self.pieces(raw[first[k] : first[k] + size[k]].tobytes())
            pieces += own
            belongs += [k] * len(own)
        lengths, belongs = np.array([len(x) for x in pieces], np.int64), np.array(belongs, np.int64)
        few = np.flatnonzero(lengths <= FEW)
        ids, of = self.merge_few(np.frombuffer(b"".join([pieces[k] for k in few.tolist()]), np.uint8), np.repeat(few, lengths[few]))
        more, piece = [ids], [of]
        for k in np.flatnonzero(lengths > FEW).tolist():
            more.append(self.merge_many(self.of_byte[np.frombuffer(pieces[k], np.uint8)]))
            piece.append(np.full(len(more[-1]), k))
        ids, piece = np.concatenate(more), np.concatenate(piece)
        order = np.argsort(piece, kind="stable")
        found.append(ids[order])
        owner.append(belongs[piece[order]] if len(order) else piece)
        ids, owner = np.concatenate(found), np.concatenate(owner)
        return ids[np.argsort(owner, kind="stable")].astype("<u4"), np.bincount(owner, minlength=len(size))

    def encode_cut(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the fragments between ``edges``, one after the other, and how many each has."""
        if self.known is None:
            self.known = Known(KEPT, np.dtype("<u2") if len(self.token) <= 1 << 16 else np.dtype("<u4"))
        start, size = edges[:-1], np.diff(edges)
        low, high = fragment_keys(data, start, size)
        slot, met = self.known.find(low, high, size)
        count = np.where(met, self.known.count[slot], 0).astype(np.int64)
        new = np.flatnonzero(~met)
        if len(new):
            fresh, own, first, of = self.encode_new(data, start[new], start[new] + size[new])
            count[new] = own[of]
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), "<u4")
        old = np.flatnonzero(met)
        self.known.copy(slot[old], count[old], out, at[old])
        if len(new):
            begin = np.cumsum(own) - own
            out[ranges(at[new], count[new])] = fresh[ranges(begin[of], count[new])]
            short = (size[new[first]] <= SHORT) & (own <= FEW_IDS)
            put = new[first[short]]
            self.known.keep(slot[put], low[put], high[put], size[put], own[short], fresh, begin[short])
        return out, count

    def encode_new(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of fragments that may repeat: the different ones' ids and how many each has, where each is first, and which each is."""
        # fragments are told apart by hashes, then those of one hash compared
        _, first, of = np.unique(tx.word_hashes(data, start, end, fold=False), return_index=True, return_inverse=True)
        size = end - start
        if not ((size == size[first][of]).all() and (data[ranges(start, size)] == data[ranges(start[first][of], size)]).all()):
            first = of = np.arange(len(start))
        return *self.encode_fragments(data, start[first], end[first]), first, of

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each of several texts of UTF-8 bytes."""
        raw = data.tobytes()
        if any(mark in raw for mark in self.added):
            return [self.encode(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        if not len(data):
            return [np.zeros(0, "<u4")] * (len(offsets) - 1)
        edges = np.sort(np.concatenate([self.cuts(data), offsets]))
        edges = edges[np.diff(edges, prepend=-1) > 0]
        ids, count = self.encode_cut(data, edges)
        bounds = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(edges, offsets)]
        return [ids[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode(self, data: np.ndarray) -> np.ndarray:
        """The ids of one text of UTF-8 bytes."""
        out = [np.zeros(0, "<u4")]
        for part in self.marks.split(data.tobytes()):
            if part in self.added:
                out.append(np.array([self.added[part]], "<u4"))
            elif part:
                part = np.frombuffer(part, np.uint8)
                out.append(self.encode_cut(part, np.concatenate([[0], self.cuts(part), [len(part)]]))[0])
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> str:
        """Added tokens as their strings; bytes that are no UTF-8 as U+FFFD."""
        token = self.token
        return b"".join([token[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _texts(batch: pa.RecordBatch, code: Encoder) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Runs of rows with their texts' ids."""
    for part in tx.slices(batch, "text"):
        yield part, code.encode_all(*tx.buffers(part.column("text")))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Token count, id digest and decoded-text digest of every text, with the tokenizer file at ``path``.

    ``docs`` needs doc_id and text; other columns aren't read.  A null text counts as empty
    (0 tokens); rows with equal or null doc_id stay apart; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for part, ids in _texts(batch, code):
                texts = [hashlib.sha256(code.decode(i).encode()).hexdigest() for i in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every text; nulls, repeats and no rows as in ``encode_digests``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for part, ids in _texts(batch, code):
                flat = np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)
                bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
