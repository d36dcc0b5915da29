"""Repeated windows of one block of bytes, by a Burrows-Wheeler transform in NumPy."""

from __future__ import annotations

import numpy as np

from quillstream.llm.columns import ranges

#: Ends a text; no UTF-8 text holds it, and it is the largest byte.
END = 0xFF
#: Intervals of more rows are extended character by character, by binary search; others row by row.
ROW_BY_ROW = 128


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``data`` by the ``depth`` bytes (at least) from there on; ties in any order.

    Prefix doubling: eight bytes first, then twice as many; only places that share theirs with others are sorted again.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(key)
    rank = np.zeros(n + 1, np.int64)  # of the end: less than all others

    def regroup(slots: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Give the places in ``slots`` (their keys sorted) their ranks; the slots that share one remain."""
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        lead = np.flatnonzero(new)
        rank[order[slots]] = slots[lead][np.cumsum(new) - 1] + 1
        shared = ~new
        shared[:-1] |= ~new[1:]
        return slots[shared]

    slots = regroup(np.arange(n), key[order])
    width = 8
    while width < depth and len(slots):
        at = order[slots]
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + width, n)].astype(np.uint64)
        by = np.argsort(key)
        order[slots] = at[by]
        slots = regroup(slots, key[by])
        width *= 2
    return order


class Transform:
    """The transform of a block, with each row's place after one backward step and its neighbours of the same byte."""

    def __init__(self, data: np.ndarray, depth: int):
        n = len(data)
        self.order = suffix_order(data, depth)
        self.last = data[self.order - 1]
        by = np.argsort(self.last, kind="stable")  # rows by last byte: the inverse of a step
        self.rows = by
        self.step = np.empty(n, np.int64)
        self.step[by] = np.arange(n)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(data, minlength=256))])
        same = self.last[by[1:]] == self.last[by[:-1]]
        self.after, self.before = np.full(n, n), np.full(n, -1)
        self.after[by[:-1][same]] = by[1:][same]
        self.before[by[1:][same]] = by[:-1][same]
        self.alphabet = [c for c in np.flatnonzero(np.diff(self.first)).tolist() if c != END]

    def extended(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals (low, high exclusive) of all one-byte backward extensions of strings, given theirs."""
        wide = high - low > ROW_BY_ROW
        lows, highs = [], []
        if wide.any():
            a, b = low[wide], high[wide]
            for c in self.alphabet:
                base, end = self.first[c], self.first[c + 1]
                x, y = (base + np.searchsorted(self.rows[base:end], z) for z in (a, b))
                some = y > x
                lows.append(x[some])
                highs.append(y[some])
        a, b = low[~wide], high[~wide]
        if len(a):
            size = b - a
            at = ranges(a, size)
            inside = self.last[at] != END
            begin, end = inside & (self.before[at] < np.repeat(a, size)), inside & (self.after[at] >= np.repeat(b, size))
            # extensions are disjoint, so their ends in order belong to their beginnings in order
            lows.append(np.sort(self.step[at[begin]]))
            highs.append(np.sort(self.step[at[end]]) + 1)
        return (np.concatenate(lows), np.concatenate(highs)) if lows else (low[:0], high[:0])


def repeated(data: np.ndarray, depth: int) -> np.ndarray:
    """Which places of ``data`` begin a string of ``depth`` bytes that begins at another place too.

    ``data``: texts, each followed by END; strings over an END don't count.  Intervals of equal prefixes are
    expanded breadth first: those of length l + 1 settle the borders between neighbours with l bytes in common,
    and only those that settle one are extended.  After ``depth`` rounds just the neighbours with so many bytes
    in common, or more, have no border.
    """
    n = len(data)
    out = np.zeros(n, dtype=bool)
    if not n:
        return out
    of = Transform(data, depth)
    border = np.zeros(n + 1, dtype=bool)
    border[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        low, high = of.extended(low, high)
        new = ~border[high] | (high == n)
        border[high] = True
        low, high = low[new], high[new]
        if not len(low):
            break
    edges = np.flatnonzero(border)
    size = np.diff(edges)
    out[of.order] = np.repeat(size > 1, size)
    ends = np.flatnonzero(data == END)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) if len(ends) and ends[-1] == n - 1 else None
    if left is None:
        raise ValueError("a block must end with END")
    return out & (left >= depth)
