import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.llm import fingerprint, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_brute_force(sample, odd):
    texts = [t for _, t in [*sample, *odd]]
    got = quality.statistics(pa.array(texts, pa.string()))
    assert list(zip(*(got[k].tolist() for k in quality.COUNTS[:5]), strict=True)) == [brute_counts(t) for t in texts]


def test_trees_hold_their_direction_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 2] < 0.5) ^ (rng.random(3000) < 0.05)).astype(float)
    model = quality.grow(x, y)
    assert ((model.score(x) >= 0.5) == (x[:, 2] < 0.5)).mean() > 0.97
    for name, way in quality.MONOTONE.items():
        j = quality.FEATURES.index(name)
        for row in x[:50]:
            line = np.repeat(row[None], 60, axis=0)
            line[:, j] = np.linspace(-0.1, 1.1, 60)
            assert (np.diff(model.raw(line)) * way >= -1e-12).all()


def test_quality_rows(spark, odd):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in odd], "doc_id long, text string, label int, kept string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    rows = quality.judge(docs, model).collect()
    assert len(rows) == len(odd)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words) for r in rows) == sorted((i is None, i or 0, brute_counts(t)[0]) for i, t in odd)
    assert quality.judge(docs.limit(0), model).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("doc_id % 3 <> 0")
    model = quality.train(docs, known)
    got = quality.judge(docs.join(labels.where("doc_id % 3 = 0").select("doc_id"), "doc_id"), model)
    rows = got.join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert np.mean(good) > 0.98
    assert np.mean([not r.kept for r in rows if r.quality == 0]) > 0.8


def brute_pairs(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        t, nxt = a[1] or "", b[1] or ""
        h = len(t) // 2
        out[a[0]] = (len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest())
    return out


def test_edited_pairs(spark, sample):
    rows = [*sample, (10**12, None), (-5, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, place string")
    for places in (1, 7, 64):
        got = fingerprint.edited_pairs(docs.repartition(5), places).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == brute_pairs(rows) and len(got) == len(rows)
    shingled = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()) else set() for i, t in rows}
    order = sorted(shingled, reverse=True)
    for r in got:
        nxt = order[(order.index(r.doc_id) + 1) % len(order)]
        a, b = shingled[r.doc_id], shingled[nxt]
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.near_next - true) < 0.2


def test_edited_pairs_ties_nulls_and_empty(spark, odd):
    """Ties by the text's hash, so each text of an id with another one's is followed by one of the two."""
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    got = fingerprint.edited_pairs(docs, 8).collect()
    keyed = docs.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(doc_id is null, coalesce(text, '')) as tie").collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.tie))
    wanted = []
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        half = len(a.text) // 2
        wanted.append((a.doc_id, len(a.text), hashlib.sha256((a.text[: len(a.text) - half] + b.text[:half]).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(wanted, key=key)
    assert fingerprint.edited_pairs(docs.limit(0), 8).count() == 0
    one = fingerprint.edited_pairs(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string"), 8).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_edited_pairs_of_one_frequent_id_spread(spark):
    rows = [(None, f"text {k} of none") for k in range(300)] + [(5, "the same text " * 9)] * 400 + [(k, f"other {k}") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    routed = fingerprint.with_next(docs, 16).where("not ghost")
    shares = routed.groupBy("place").agg(F.count("*").alias("n"), F.sum("times").alias("times")).collect()
    assert sum(r["times"] for r in shares) == 800 and max(r["n"] for r in shares) < 150
    got = fingerprint.edited_pairs(docs, 16).collect()
    assert len(got) == 800 and sum(r.doc_id == 5 and r.near_next == 1.0 for r in got) == 399


def test_sketches_merge_and_estimate():
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    sa, sb = fingerprint.sketches(pa.array([a, b]))
    assert (fingerprint.from_text(fingerprint.to_text(sa)) == sa).all()
    assert fingerprint.resemblance(sa, sb) == pytest.approx(0.5, abs=0.15)
    assert fingerprint.containment(sa, sb) == pytest.approx(2 / 3, abs=0.2)
    assert fingerprint.distinct(fingerprint.merge(sa, sb)) == pytest.approx(3996, rel=0.3)


def plain_trees(x, y, way, trees, depth, rate, bins, least, ridge):
    """The boosted trees' sums for each row, from the rules: every split of every node is tried, row by row."""
    n, m = len(x), len(x[0])
    share = (sum(y) + 0.5) / (n + 1)
    total = [float(np.log(share / (1 - share)))] * n
    edges = [sorted(set(np.quantile([r[j] for r in x], [k / bins for k in range(1, bins)]).tolist())) for j in range(m)]
    for _ in range(trees):
        p = [1 / (1 + np.exp(-t)) for t in total]
        g, h = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        nodes, values = [(list(range(n)), -np.inf, np.inf)], {}
        for level in range(depth):
            below = []
            for own, low, high in nodes:
                cut = lambda v, low=low, high=high: min(max(v, low), high)
                G, H = sum(g[i] for i in own), sum(h[i] for i in own)
                best = (1e-6, None)
                for j in range(m):
                    for e in edges[j]:
                        left = [i for i in own if x[i][j] <= e]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        a, b = cut(-gl / (hl + ridge)), cut(-(G - gl) / (H - hl + ridge))
                        gain = -(gl * a + (hl + ridge) * a * a / 2) - ((G - gl) * b + (H - hl + ridge) * b * b / 2) - G * G / (H + ridge) / 2
                        if hl >= least and H - hl >= least and (b - a) * way[j] >= 0 and gain > best[0] + 1e-12:
                            best = (gain, (j, e, a, b))
                if best[1] is None:
                    below += [(own, low, high), ([], low, high)]
                    continue
                j, e, a, b = best[1]
                sides = [(low, high), (low, high)]
                if way[j]:
                    mid = (a + b) / 2
                    sides = [(low, min(high, mid)), (max(low, mid), high)] if way[j] > 0 else [(max(low, mid), high), (low, min(high, mid))]
                below += [([i for i in own if x[i][j] <= e], *sides[0]), ([i for i in own if x[i][j] > e], *sides[1])]
            nodes = below
        for own, low, high in nodes:
            v = rate * min(max(-sum(g[i] for i in own) / (sum(h[i] for i in own) + ridge), low), high)
            values |= dict.fromkeys(own, v)
        total = [t + values[i] for i, t in enumerate(total)]
    return total


def test_trees_are_those_of_the_rules():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(90, 3)), 2)
    y = ((x[:, 0] - 0.8 * x[:, 1] + rng.normal(size=90)) > 0).astype(float)
    for monotone in ({}, {"a": 1, "b": -1}, {"a": -1}):
        model = quality.grow(x, y, ("a", "b", "c"), monotone, trees=4, depth=2, rate=0.3, bins=7, least=2.0, ridge=1.0)
        wanted = plain_trees(x.tolist(), y.tolist(), [monotone.get(f, 0) for f in "abc"], 4, 2, 0.3, 7, 2.0, 1.0)
        assert np.allclose(model.raw(x), wanted)


def test_kept_is_the_rule_and_the_score(spark, sample, odd):
    docs = spark.createDataFrame([*sample, *odd], "doc_id long, text string")
    marks = spark.createDataFrame([(d, d % 2) for d, _ in sample], "doc_id long, quality int")
    model = quality.train(docs, marks)
    rows = quality.judge(docs, model).collect()
    scores = model.score(quality.features(quality.statistics(pa.array([t for _, t in [*sample, *odd]]))))
    texts = sorted((d is None, d or 0, t or "", bool(len(WORD.findall(t or "")) >= 50 and 2 * brute_counts(t)[4] <= len(WORD.findall(t or "")) and s >= 0.5)) for (d, t), s in zip([*sample, *odd], scores, strict=True))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.kept) for r in rows) == sorted((a, b, k) for a, b, _, k in texts)
