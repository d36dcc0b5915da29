import random
import re

import numpy as np
import pytest

from quillstream.llm import graph, ngram_join, rarity


def brute(rows, n, percent):
    own = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        own.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and min(len(own[i]), len(own[j])) * 100 >= percent * max(len(own[i]), len(own[j])):
                both = len(own[i] & own[j])
                if 100 * both >= percent * (len(own[i]) + len(own[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((-1 if d is None else d), len(own[i]), -1 if (c := least.get(find(i)) if own[i] else d) is None else c) for i, (d, _) in enumerate(rows))


def families(seed, count, words, changes):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randrange(changes)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "percent", "chunk"), [(4, 85, 256), (5, 80, 5), (4, 85, 7)])
def test_components(spark, sample, odd, monkeypatch, n, percent, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    texts = [t for _, t in odd] + families(1, 40, 120, 6) + families(2, 60, 80, 9) + families(3, 30, 400, 40) + ["same words here again"] * 20
    rows = [*sample, *((10_000 + 3 * k, t) for k, t in enumerate(texts)), (None, "no id here at all"), (None, None), (5, sample[0][1])]
    random.Random(4).shuffle(rows)
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, component_id int, cls string")
    got = ngram_join.link_components(docs.repartition(6), n, percent).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute(rows, n, percent)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.link_components(docs).count() == 0
    alone = spark.createDataFrame([(4, None), (3, "")], "doc_id long, text string")
    assert sorted(r.component_id for r in ngram_join.link_components(alone).collect()) == [3, 4]


def test_forest_finds_every_component_at_every_level(monkeypatch):
    rng = np.random.default_rng(0)
    for trial in range(60):
        pool = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
        sets = []
        for _ in range(int(rng.integers(7, 40))):
            own = pool[: int(rng.integers(20, 60))].copy()
            swap = rng.random(len(own)) < rng.choice([0.0, 0.02, 0.06, 0.1])
            own[swap] = rng.integers(0, 2**63, int(swap.sum()), dtype=np.uint64)
            sets.append(np.unique(own))
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        ranks = np.zeros(1 << rarity.RANK_BITS, np.uint8)
        np.maximum.at(ranks, (tokens >> np.uint64(64 - rarity.RANK_BITS)).astype(np.int64), np.ceil(4 * np.log2(counts)).astype(np.uint8))
        order = rarity.Rarity(ranks, np.full(1 << 24, 255, np.uint8))
        monkeypatch.setattr(ngram_join, "level", lambda f, n, p: int(rng.choice([m for m in (1, 2, 4, 8) if m <= ngram_join.least_overlap(n, p)])))
        group = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                if ngram_join.linked(sets[i], sets[j], 85):
                    group[group == group[j]] = group[i]
        got = np.arange(len(sets))
        for i, j in ngram_join.forest(sets, 85, order):
            assert ngram_join.linked(sets[i], sets[j], 85)
            got[got == got[j]] = got[i]
        same = lambda g: g[:, None] == g[None, :]
        assert (same(group) == same(got)).all(), trial


def test_graph_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000 + k) for k in range(1, 300)] + [(7, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


def test_very_many_rows_of_null_ids(spark, monkeypatch):
    """3,000 rows of null doc_id and two texts are two classes, whose sets are written once."""
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), " ".join([*base[:-1], "changed"])]
    docs = spark.createDataFrame([(None, texts[k % 2]) for k in range(3000)] + [(7, "something else of other words entirely")], "doc_id long, text string").repartition(6)
    tables = {}
    keep = ngram_join.written

    def spied(df, name="table"):
        tables[name] = keep(df, name)
        return tables[name]

    monkeypatch.setattr(ngram_join, "written", spied)
    rows = ngram_join.link_components(docs).collect()
    assert tables["sets"].count() == 2
    assert len(rows) == 3001 and len({r.root for r in rows}) == 2
    assert [r.doc_id for r in ngram_join.one_of_each(docs.withColumn("d", docs.doc_id)).orderBy("doc_id").collect()] == [None, 7]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_chains_over_ranges(spark, parts):
    """A frequent token's sets are chained whatever ranges they fall in."""
    rng = random.Random(4)
    rows = [(0 if k % 3 else rng.randrange(20), rng.choice([10, 11, 20, 21, 40]), k % 97) for k in range(600)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in ngram_join._chains(spark.createDataFrame(rows, "token long, n long, b long"), 85).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    rows.sort()
    assert got == {(x[2], y[2]) for x, y in zip(rows, rows[1:]) if x[0] == y[0] and x[2] != y[2] and 100 * x[1] >= 85 * y[1]}


def test_small_tables_of_edges_need_no_round(spark, monkeypatch):
    """A long chain in four partitions needs one round of joins at most, where its length alone would ask for several."""
    tables = []
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name="table": tables.append(name) or keep(df, name))
    edges = spark.createDataFrame([((7 * k) % 5003, (7 * k + 7) % 5003) for k in range(5000)], "a long, b long").repartition(4)
    assert {r.root for r in graph.components(edges).collect()} == {0}
    assert len(tables) <= 4, tables


def test_edges_in_many_parts_need_no_round(spark, monkeypatch):
    """The parts that edges were made in don't say in how many tasks they are settled, nor into how many files they are written."""
    tables = []
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name="table": tables.append(keep(df, name)) or tables[-1])
    edges = spark.createDataFrame([((7 * k) % 5003, (7 * k + 7) % 5003) for k in range(5000)], "a long, b long").repartition(60)
    assert {r.root for r in graph.components(edges).collect()} == {0}
    assert [len(t.inputFiles()) for t in tables] == [1]
    # several tasks settle what each has, and rounds the rest
    monkeypatch.setattr(graph, "TASK_EDGES", 500)
    assert {r.root for r in graph.components(edges).collect()} == {0}
    assert len(tables) > 2


def test_small_tables_are_few_files(spark, monkeypatch, sample):
    """However many shuffle partitions there are: a file is a task and several processes where Hadoop has no native code."""
    tables = {}
    keep = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name="table": tables.update({name: keep(df, name)}) or tables[name])
    adaptive, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set(adaptive, "false")
    try:
        ngram_join.link_components(spark.createDataFrame(sample, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset(adaptive)
    assert {name: len(tables[name].inputFiles()) for name in ("classes", "members", "sets")} == {"classes": 1, "members": 1, "sets": 1}


def test_sketches_bound_differences():
    """The bits of two sketches differ in no more places than the sets do, at the wider one's width folded."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 900)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, 20, dtype=np.uint64)]))
        x, y = ngram_join.sketch(a), ngram_join.sketch(b)
        width = min(len(x), len(y))
        apart = int(np.bitwise_count(ngram_join.folded(x, width) ^ ngram_join.folded(y, width)).sum())
        assert apart <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("meet", [4096, 16])
def test_chance_meetings_make_no_large_block(spark, monkeypatch, meet):
    """Sets that share single rare n-grams in one long chain aren't compared chunk by chunk; links among them are found."""
    monkeypatch.setattr(ngram_join, "CHUNK", 20)
    monkeypatch.setattr(ngram_join, "MEET", meet)
    texts = []
    for k in range(300):  # each shares a rare passage with the one before and one with the one after
        texts.append(" ".join([*(f"p{k}x{i}" for i in range(6)), *(f"own{k}x{i}" for i in range(60)), *(f"p{k + 1}x{i}" for i in range(6))]))
    texts += [t + " end" for t in texts[::7]] + families(5, 50, 100, 6)
    rows = list(enumerate(texts))
    dealt = []
    keep = ngram_join._across
    monkeypatch.setattr(ngram_join, "_across", lambda large, *a: dealt.append(large.count()) or keep(large, *a))
    got = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 85)
    assert sum(dealt) <= 50  # of the family only


def test_blocks_are_split_by_one_python_step_a_task(spark, monkeypatch):
    """Each task of the split of large blocks has one worker beside it, as the sets' stars are made where they meet."""
    monkeypatch.setattr(ngram_join, "CHUNK", 20)
    steps = []
    keep = graph.written

    def spied(df, name="table"):
        steps.append(df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("Exchange")[0].count("MapInArrow"))
        return keep(df, name)

    monkeypatch.setattr(graph, "written", spied)
    rows = list(enumerate(families(6, 60, 100, 6) + families(7, 60, 100, 30)))
    got = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 85)
    assert max(steps) == 1, steps
