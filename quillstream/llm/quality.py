"""Document statistics and gradient-boosted trees over them.

Statistics come from ``text``'s vectorised words, one pass over each batch.  The trees are
grown here on histograms of a bounded sample of labelled rows, and flattened into numpy node
arrays: scoring moves all rows of a batch down all levels at once.  Features named in
``MONOTONE`` may only push the score one way, whatever the sample says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import text as tx

#: The most labelled rows that a model is grown on, those with the least hash of their id.
LABELLED_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_points", "n_distinct_words", "n_bytes")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "line_words", "upper_share", "digit_share", "point_share", "distinct_share")
#: -1: the score may only fall as the feature rises; 1: only rise.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[list(b".,;:!?")] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _own(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes made distinct between texts."""
    return hashes ^ tx.mix(owner.astype(np.uint64) + np.uint64(1))


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    _, at = np.unique(_own(hashes, owner), return_index=True)
    return np.bincount(owner[at], minlength=n)


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text, as 64-bit integers."""
    data, offsets = tx.buffers(column)
    n = len(offsets) - 1
    starts, ends, first = tx.word_bounds(data, offsets)
    words = tx.word_hashes(data, starts, ends, fold=False)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    begins = (data & 0xC0) != 0x80
    out = {"n_words": count, "n_bytes": np.diff(offsets)}
    out["word_chars"] = _per_text(begins & ~tx.IS_SPACE[data], offsets)
    for name, which in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_points", _POINT)):
        out[name] = _per_text(which[data], offsets)
    out["n_distinct_words"] = _distinct(words, owner, n)

    # Words in windows of three that occur twice or more
    covered = np.zeros(len(words) + 1, dtype=bool)
    if len(words) >= 3:
        at = np.flatnonzero(owner[:-2] == owner[2:])
        step = np.uint64(0xD1342543DE82EF95)
        window = tx.mix((words[at] * step + words[at + 1]) * step + words[at + 2])
        order = np.argsort(window := _own(window, owner[at]), kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        for k in range(3):
            covered[hit + k] = True
    out["n_repeat_words"] = _per_text(covered[:-1], first)

    # Lines with a word: the breaks around each word's start
    newlines = np.flatnonzero(data == 10)
    breaks = np.sort(np.concatenate([newlines, offsets]))
    line = np.unique(np.searchsorted(breaks, starts, "right"))
    begin, end = breaks[line - 1], breaks[line] if len(line) else breaks[:0]
    begin = begin + (data[begin] == 10) if len(line) else begin
    line_owner = np.searchsorted(offsets, begin, "right") - 1
    lines = np.bincount(line_owner, minlength=n)
    out["n_lines"] = lines
    out["n_dup_lines"] = lines - _distinct(tx.word_hashes(data, begin, end, fold=False), line_owner, n)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """A row of FEATURES for each text, all finite."""
    words, size = np.maximum(s["n_words"], 1), np.maximum(s["n_bytes"], 1)
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / np.maximum(s["word_chars"], 1), s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / words,
        words / np.maximum(s["n_lines"], 1), s["n_upper"] / size, s["n_digits"] / size, s["n_points"] / words, s["n_distinct_words"] / words,
    ])


@dataclass
class Trees:
    """Complete binary trees in flat arrays: node i of a tree has the children 2i + 1 and 2i + 2.

    A node that isn't split sends all rows left (threshold infinity).
    """

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (value.shape[0] - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES, monotone: dict[str, int] = MONOTONE, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for 0/1 labels: Newton steps on the logistic loss, splits between quantile bins.

    A split against a feature's direction isn't taken, and values below it are kept on their sides
    of the two children's middle, so the constraint holds for the whole tree.  Without rows or with
    one label only, the result is a constant.
    """
    n, m = x.shape if x.size else (0, len(names))
    inner, leaves = 2**depth - 1, 2**depth
    rate_y = (float(y.sum()) + 0.5) / (n + 1)
    model = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(rate_y / (1 - rate_y))))
    if n < 2 or y.min() == y.max():
        return model
    way = np.array([monotone.get(f, 0) for f in names])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    total = np.full(n, model.base)
    all_f, all_t, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        bounds = {0: (-np.inf, np.inf)}
        node = np.zeros(n, dtype=np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            low, high = bounds[k]
            best = (1e-6, 0, -1, 0.0, 0.0)
            if len(own) > 1:
                G, H = g[own].sum(), h[own].sum()
                for j in range(m):
                    if not len(edges[j]):
                        continue
                    gl = np.cumsum(np.bincount(binned[own, j], g[own], len(edges[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, j], h[own], len(edges[j]) + 1))[:-1]
                    left, right = np.clip(-gl / (hl + ridge), low, high), np.clip(-(G - gl) / (H - hl + ridge), low, high)
                    gain = -(gl * left + (hl + ridge) * left**2 / 2) - ((G - gl) * right + (H - hl + ridge) * right**2 / 2) - G**2 / (H + ridge) / 2
                    gain[(hl < least) | (H - hl < least) | ((right - left) * way[j] < 0)] = -np.inf
                    at = int(np.argmax(gain))
                    if gain[at] > best[0]:
                        best = (float(gain[at]), j, at, float(left[at]), float(right[at]))
            _, j, at, left_v, right_v = best
            mid = (left_v + right_v) / 2
            go = np.zeros(len(own), dtype=np.int64)
            if at >= 0:
                feature[k], threshold[k] = j, edges[j][at]
                go = (binned[own, j] > at).astype(np.int64)
            split = at >= 0 and way[j] != 0
            bounds[2 * k + 1] = (max(low, mid), high) if split and way[j] < 0 else (low, min(high, mid)) if split else (low, high)
            bounds[2 * k + 2] = (low, min(high, mid)) if split and way[j] < 0 else (max(low, mid), high) if split else (low, high)
            node[own] = 2 * k + 1 + go
        for leaf in range(leaves):
            own = np.flatnonzero(node == inner + leaf)
            low, high = bounds[inner + leaf]
            value[leaf] = rate * np.clip(-g[own].sum() / (h[own].sum() + ridge), low, high) if len(own) else 0.0
        # An empty leaf lies beyond every row of the sample: it takes its sibling's value.
        for leaf in range(0, leaves, 2):
            sizes = [(node == inner + leaf + i).sum() for i in (0, 1)]
            if 0 in sizes and sum(sizes):
                value[leaf : leaf + 2] = value[leaf + int(sizes[0] == 0)]
        total += value[node - inner]
        all_f.append(feature)
        all_t.append(threshold)
        all_v.append(value)
    return Trees(np.array(all_f), np.array(all_t), np.array(all_v), model.base)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED_ROWS) -> Trees:
    """Trees for ``label`` on at most ``most`` labelled rows.

    The sample is bounded, so it may be broadcast and its statistics (a few numbers a row) collected; of
    several texts of one id, one (that of least hash) is read.  Null texts count as empty, null ids and
    labels other than 0 and 1 as none; without labels the model is a constant.
    """
    sample = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                x = features(statistics(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "label", "t.text")
    rows = one.mapInArrow(run, "doc_id long, label int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y, ids = rows.column("label").to_numpy().astype(float), rows.column("doc_id").to_numpy()
    order = np.lexsort((*x.T, y, ids))  # rows arrive in any order; sums of floats then differ
    return grow(x[order], y[order])


def judge(docs: DataFrame, model: Trees, least_words: int = 50) -> DataFrame:
    """Statistics, rule verdict, score and ``kept`` of every text.

    ``base_failed``: fewer than ``least_words`` words, or over half of them in repeated windows of
    three.  ``kept``: not base_failed and a score of 0.5 at least.  A null or empty text has no
    words and fails; rows of equal or null doc_id stay apart; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                s = statistics(part.column("text"))
                failed = (s["n_words"] < least_words) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
                score = model.score(features(s))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), *(pa.array(s[k]) for k in COUNTS[:5]), pa.array(failed), pa.array(~failed & (score >= 0.5)), pa.array(score)],
                    names=["doc_id", *COUNTS[:5], "base_failed", "kept", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")
