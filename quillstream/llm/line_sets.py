"""Lines of texts as sets of their words' hashes, for a whole batch at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from quillstream.llm import text as tx


@dataclass
class Lines:
    """Lines with a word of a batch, in order: their text's row, number in it, and distinct words (ascending)."""

    row: np.ndarray
    number: np.ndarray
    size: np.ndarray
    tokens: np.ndarray
    owner: np.ndarray  # the line of each token

    @property
    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.size)])

    def where(self, keep: np.ndarray) -> Lines:
        """The lines for which ``keep`` holds."""
        if keep.all():
            return self
        tokens = keep[self.owner]
        return Lines(self.row[keep], self.number[keep], self.size[keep], self.tokens[tokens], (np.cumsum(keep) - 1)[self.owner[tokens]])


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text's row and number (from 0) of all lines of texts; lines are split at line feeds."""
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, offsets)
    count = 1 + np.diff(before)
    row = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    return np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]])), row, number


def line_sets(column: pa.Array) -> Lines:
    """Lines without a word are left out."""
    return of_buffers(*tx.buffers(column))


def of_buffers(data: np.ndarray, offsets: np.ndarray) -> Lines:
    starts, ends, _ = tx.word_bounds(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Lines(none, none, none, np.zeros(0, np.uint64), none)
    words = tx.word_hashes(data, starts, ends)
    begin, _, row, number = bounds(data, offsets)
    count = np.diff(np.append(np.searchsorted(starts, begin), len(starts)))
    has = count > 0
    row, number = row[has], number[has]
    line = np.repeat(np.arange(len(row)), count[has])
    order = by_owner(line, words)
    words, owner = words[order], line  # lines were in order
    keep = np.concatenate([[True], (owner[1:] != owner[:-1]) | (words[1:] != words[:-1])])
    words, owner = words[keep], owner[keep]
    return Lines(row, number, np.bincount(owner, minlength=len(row)), words, owner)


def by_owner(owner: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The order by owner, then word (64 bits).

    Owner and a word's upper 42 bits fit in one number, which sorts several times faster; where they don't
    tell all words of an owner apart, both are sorted in full.
    """
    if len(owner) and owner.max() < 1 << 22:
        key = (owner.astype(np.uint64) << np.uint64(42)) | (words >> np.uint64(22))
        order = np.argsort(key)
        key, own = key[order], words[order]
        if not ((key[1:] == key[:-1]) & (own[1:] != own[:-1])).any():
            return order
    return np.lexsort((words, owner))
