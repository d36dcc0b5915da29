import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quillstream.llm import interaction, periodic, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least_words=6, least_periods=4):
    """(start, length, period) of all runs, from the definition: every period, every maximal stretch."""
    n, found = len(words), {}
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            if length >= max(least_words, least_periods * q):
                found.setdefault((s, length), q)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_op13(doc, text):
    words = WORDS.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def odd_words(seed):
    """Word lists with nested, touching and interrupted runs."""
    rng = random.Random(seed)
    out = []
    for _ in range(rng.randrange(1, 6)):
        unit = [rng.choice("ab cd e".split() + ["é", "Ab"]) for _ in range(rng.choice([1, 1, 2, 3, 5]))]
        unit = unit * rng.choice([1, 2, 5]) + [rng.choice("xyz")] * rng.choice([0, 0, 1, 7])
        out += (unit * rng.choice([1, 3, 4, 6, 9]))[: rng.randrange(1, 60)]
    return out


def test_runs_against_the_definition():
    texts = [odd_words(seed) for seed in range(300)]
    names = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = list(zip(*(c.tolist() for c in periodic.runs(np.array([names[w] for t in texts for w in t]), first)), strict=True))
    assert got == [(k, *r) for k, t in enumerate(texts) for r in brute_runs(t)]
    assert len(got) > 300


def test_op13_against_brute_force(spark, odd, sample):
    rows = [*odd, *((1000 + k, " ".join(odd_words(k))) for k in range(120)), *((d + 5000, t) for d, t in sample[:60])]
    docs = spark.createDataFrame([(d, t, "x", [1]) for d, t in rows], "doc_id long, text string, runs string, collapsed array<int>")
    docs.createOrReplaceTempView("op13_documents")
    got = _op13(spark, docs)
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((brute_op13(d, t) for d, t in rows), key=key)
    assert got.where("n_runs > 0").count() > 60
    assert _op13(spark, docs.limit(0)).collect() == []


def _op13(spark, docs):
    """The registered query over other documents."""
    import tempfile

    folder = tempfile.mkdtemp()
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return queries.op13_periodic_runs(spark, folder)


def test_a_long_run_and_a_long_text():
    words = np.array([0, 1, 2] * 40_000 + list(range(3, 5000)))
    d, start, length, period = periodic.runs(words, np.array([0, 0, len(words), len(words)]))
    assert [d.tolist(), start.tolist(), length.tolist(), period.tolist()] == [[1], [0], [120_000], [3]]


def brute_audit(rows, labels):
    """All rows of the audit, from the definition: each order applied to each document."""
    first, out = {}, {}
    for d, _, t in rows:
        own = (d is None, d or 0)
        first[t or ""] = min(first.get(t or "", own), own)
    good, toxic = ({d for d, q, x in labels if d is not None and (q, x)[k] == 1} for k in (0, 1))
    failed = []
    for d, source, text in rows:
        text = text or ""
        w = WORDS.findall(text)
        bad = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text)) + "E" * (first[text] < (d is None, d or 0))
        failed.append((source or "", bad, d in good, d in toxic))
    for part in {f[0] for f in failed}:
        own = [f[1:] for f in failed if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [f for f in own if x in f[0] and not before & set(f[0])]
                kept = sum(not (before | {x}) & set(f[0]) for f in own)
                out[part, order, step] = [kept, len(here), sum(x in f[0] and bool(before & set(f[0])) for f in own), sum(f[0] == x for f in own), sum(f[1] for f in here), sum(f[2] for f in here)]
        for x in "ABCDE":
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == x)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == x:
                    v.append(total)
    return sorted((*k, *v) for k, v in out.items())


@pytest.mark.parametrize("parts", [1, 13])
def test_audit_against_brute_force(spark, odd, sample, parts):
    rng = random.Random(5)
    shared = " ".join(["Same text over many rows"] * 50)
    texts = [t for _, t in odd] + [t for _, t in sample[:40]] + [shared] * 60 + [shared + " more"] * 4 + [None, "", ""]
    rows = [(rng.choice([k, k, k, None, 7]), rng.choice(["a", "b", None, ""]), t) for k, t in enumerate(texts)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, len(rows), 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(d, s, t, "m", 1) for d, s, t in rows], "doc_id long, source string, text string, mask string, good int").repartition(parts)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in interaction.audit(docs, marks).collect())
        none = interaction.audit(docs.limit(0), marks).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == brute_audit(rows, labels)
    assert none == []


def test_only_texts_that_turn_leave_the_plan(spark):
    """One scan, and no array of a text's words in the JVM."""
    docs = spark.createDataFrame([(k, f"w{k} a b c " * 40, 1) for k in range(200)] + [(None, "a b", 1)], "doc_id long, text string, x int")
    looped = queries.with_loops(docs)
    with_plan = looped._jdf.queryExecution().toString()
    assert "Union" not in with_plan and "regexp_extract_all" not in with_plan
    got = {r.doc_id: r.text for r in looped.collect()}
    turned = {k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0}
    assert len(turned) > 5 and {k for k, t in got.items() if t != (f"w{k} a b c " * 40 if k is not None else "a b")} == turned
