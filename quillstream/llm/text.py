"""Vectorised word and shingle hashing over Arrow string batches.

A batch of texts is one UTF-8 byte buffer with offsets.  Everything here works on that
buffer with numpy, so that a word costs a few machine words and no Python object.

Words are the runs matched by ``[^\\x20\\x09-\\x0D]+``; letters A-Z are lower-cased first.
Hashes are 64 bits wide.  Two different words or shingles share one with a probability
of about 2**-64 for each pair compared.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_STEP = U64(0xD1342543DE82EF95)
#: Words of more bytes are hashed one by one.
LONG_WORD = 1024

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The lowest k bytes of a number.
LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string or binary array; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if raw else "")
    column = column.cast(pa.large_binary() if raw else pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give back what freed arrays leave behind in the worker, which lives on for later stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text (one row at least)."""
    n, first = batch.num_rows, 0
    if not n:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    while first < n:
        base = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(first, last - first)
        first = last
    release()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each text's first word (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = np.ones(len(data) + 2, dtype=bool)  # one before the first byte and one after the last
    gap[1:-1] = (data == 0x20) | (data - np.uint8(9) <= 4)
    begins, stops = gap[:-2] > gap[1:-1], gap[:-1] < gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    inner = inner[~(gap[inner] | gap[inner + 1])]
    begins[inner] = stops[inner] = True  # one text ends and the next begins without white space
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; with ``fold``, of its A-Z lower-cased form.  Eight bytes of all words at a time."""
    if not len(starts):
        return np.zeros(0, U64)
    padded = np.empty(len(data) + 8, np.uint8)
    padded[len(data) :] = 0
    if fold:
        upper = (data - np.uint8(ord("A")) < 26).view(np.uint8)
        np.bitwise_or(data, upper << 5, out=padded[: len(data)])
    else:
        padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = size.astype(U64) * _STEP
    out ^= eight[starts] & LOWEST[np.minimum(size, 8)]
    out = mix(out)
    live = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    k = 8
    while len(live):
        out[live] = mix((out[live] * _STEP) ^ (eight[starts[live] + k] & LOWEST[np.minimum(size[live] - k, 8)]))
        k += 8
        live = live[size[live] > k]
    for at in np.flatnonzero(size > LONG_WORD).tolist():
        out[at] = int.from_bytes(hashlib.blake2b(padded[starts[at] : ends[at]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``n`` words, and each text's first run (m + 1 entries).

    A text of 1 to n - 1 words has one run, all of its words; a text without words has none.
    """
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(runs)])
    if len(words) >= n:
        wide = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            wide *= _STEP
            wide += words[k : len(words) - n + 1 + k]
        owner = np.repeat(np.arange(len(count)), count)
        keep = owner[: len(words) - n + 1] == owner[n - 1 :]
        full = mix(wide[keep] + U64(n))
    else:
        full = np.zeros(0, U64)
    if not len(short):
        return full, out_first
    out = np.empty(out_first[-1], dtype=U64)
    from_full = np.ones(len(out), dtype=bool)
    from_full[out_first[short]] = False
    out[from_full] = full
    for d in short:
        h = 0
        for w in words[first[d] : first[d + 1]].tolist():
            h = (h * int(_STEP) + w) & ((1 << 64) - 1)
        out[out_first[d]] = mix(np.array([h + int(count[d])], dtype=U64))[0]
    return out, out_first


def texts_shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of a string array, their bounds for each text, and word counts."""
    data, offsets = buffers(column)
    starts, ends, first = word_bounds(data, offsets)
    shingles, bounds = shingle_hashes(word_hashes(data, starts, ends), first, n)
    return shingles, bounds, np.diff(first)
