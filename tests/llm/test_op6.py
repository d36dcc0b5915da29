import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillstream.llm import line_dedup
from quillstream.llm import text as tx
from quillstream.llm.line_sets import Lines, by_owner


def brute(rows, percent, least):
    """Texts without each line of which an earlier one is similar; rows in order of doc_id, nulls last."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = [], {}
    for k in order:
        d, t = rows[k]
        if t is None:
            out[k] = (None, 0)
            continue
        kept, gone = [], 0
        for number, line in enumerate(t.split("\n")):
            own = set(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))
            at = (d is None, d or 0, number)
            if len(own) >= least:
                hit = any(a < at and 100 * len(own & s) >= percent * len(own | s) for a, s in seen)
                seen.append((at, own))
            else:
                hit = False
            gone += hit
            kept += [] if hit else [line]
        out[k] = ("\n".join(kept), gone)
    return [(rows[k][0], *out[k]) for k in range(len(rows))]


def variants(seed, count):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 30))] for _ in range(25)]
    out = []
    for _ in range(count):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(300)}"
            lines.append(" ".join(words))
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize(("tries", "block"), [(3, 8192), (1, 5)])
def test_lines_against_brute_force(spark, odd, monkeypatch, tries, block):
    monkeypatch.setattr(line_dedup, "TRIES", tries)
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", block)
    texts = [t for _, t in odd] + variants(1, 150) + ["\n\n", "one two three four five\n\none two three four five\nFIVE four three two one\n"]
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (None, texts[-1])]
    docs = spark.createDataFrame([(d, t, None if t is None else len(t), "n") for d, t in rows], "doc_id long, text string, n_chars int, n_lines string")
    got = line_dedup.dedup(docs.repartition(4), least=5).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got), key=key) == sorted(brute(rows, 80, 5), key=key)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_sample_and_no_rows(spark, sample):
    docs = spark.createDataFrame(sample, "doc_id long, text string")
    got = line_dedup.dedup(docs).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == sorted(brute(sample, 80, 1))
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_repeated_rows_stay(spark):
    same = "a b c d e f\ng h i j k l"
    docs = spark.createDataFrame([(1, same), (1, same), (2, same)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup(docs).collect()) == [(1, same), (1, same), (2, "")]


@pytest.mark.parametrize("percent", [80, 60, 100])
def test_short_lines_against_brute_force(spark, sample, percent):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(7))) for _ in range(4)) for _ in range(40)]
    texts += ["All rights reserved.\n\nx y z w", "w x y z v\nall RIGHTS reserved.\n ", "a a a a a a\na", "\u6f22\u5b57\u6f22\u5b57", "\u6f22\u5b57\u6f22\u5b57"]
    rows = [*enumerate(texts, 10_000), *sample]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent, least=1).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == sorted(brute(rows, percent, 1))


def test_query_has_no_floor(spark, tmp_path):
    from quillstream.llm.queries import op6_line_dedup

    rows = [(1, "All rights reserved.\na b c d"), (2, "all rights reserved.\nd c b a e\n\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got) == [(1, rows[0][1], 2, 0), (2, "\n", 4, 2)]


@pytest.mark.parametrize("ids", [[1, 2, 3, 4, 5, None], [None]])
def test_texts_of_one_id_are_settled_apart(spark, monkeypatch, ids):
    monkeypatch.setattr(line_dedup, "TRIES", 1)
    rng = random.Random(4)
    base = [[f"w{n}_{k}" for k in range(70)] for n in range(3)]

    def near():
        words = list(rng.choice(base))
        for at in rng.sample(range(70), rng.randrange(2, 9)):
            words[at] = f"x{rng.randrange(10_000)}"
        return " ".join(words)

    rows = [(rng.choice(ids), "\n".join(near() for _ in range(4))) for _ in range(60)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), least=1).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    lines = [((d is None, d or 0, k), set(line.split())) for d, t in rows for k, line in enumerate(t.split("\n"))]
    want = []
    for d, t in rows:
        kept = [line for k, line in enumerate(t.split("\n")) if not any(at < (d is None, d or 0, k) and 100 * len(own & set(line.split())) >= 80 * len(own | set(line.split())) for at, own in lines)]
        want.append((d, "\n".join(kept), 4 - len(kept)))
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got), key=key) == sorted(want, key=key)


def test_lines_cut_from_arrow_texts():
    rng = random.Random(9)
    texts = [None, "", "\n", "a", "a\n", "\na", "é\n\n漢", *("".join(rng.choice("ab\n\né") for _ in range(rng.randrange(12))) for _ in range(300))]
    gone = [None if t is None or rng.random() < 0.2 else [k for k in range(t.count("\n") + 1) if rng.random() < rng.choice([0.1, 0.6, 1.0])] for t in texts]
    out, lines, lost = line_dedup.without(pa.array(texts, pa.string())[2:], pa.array(gone, pa.list_(pa.int32()))[2:])
    want = [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in (g or [])) for t, g in zip(texts, gone, strict=True)]
    assert out.to_pylist() == want[2:]
    assert line_dedup.without(pa.array(texts, pa.string()), pa.array(gone, pa.list_(pa.int32())))[0].to_pylist() == want
    assert lines.tolist() == [t.count("\n") + 1 for t in texts[2:]] and lost.tolist() == [len(g or []) for g in gone[2:]]


def test_columns_of_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b\na b", "x", 7, 8), (2, None, None, 9, 10)], "doc_id long, text string, _gone string, n_lines int, _DOC int")
    got = sorted(line_dedup.dedup(docs, counts=False).collect())
    assert got == [(1, "a b", "x", 7, 8), (2, None, None, 9, 10)]


def test_a_line_that_many_texts_repeat(spark):
    rows = [(k, "the same line\nand k%d of its own" % (k % 40)) for k in range(3000)] + [(None, "the same line")] * 50
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {(r.doc_id, r.text) for r in got if r.text} == {(0, rows[0][1])} | {(k, rows[k][1].split("\n")[1]) for k in range(1, 40)}
    assert len(got) == len(rows)


def test_words_that_agree_in_many_bits_are_told_apart(spark):
    # these two have the same upper 42 bits of their hashes
    docs = spark.createDataFrame([(1, "w1336586"), (2, "w2584058"), (3, "w2584058")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup(docs).collect())
    assert got == [(1, "w1336586", 0), (2, "w2584058", 0), (3, "", 1)]


def test_words_whose_upper_bits_clash():
    rng = random.Random(8)
    words = np.array([(7 << 40) + rng.randrange(6) for _ in range(400)], np.uint64)
    owner = np.sort(np.array([rng.randrange(30) for _ in range(400)]))
    order = by_owner(owner, words)
    assert list(zip(owner[order].tolist(), words[order].tolist(), strict=True)) == sorted(zip(owner.tolist(), words.tolist(), strict=True))
    sets = [sorted({rng.randrange(9) for _ in range(rng.randrange(1, 8))}) for _ in range(200)]
    sides = []
    for part in (sets[:100], sets[100:]):
        size = np.array([len(s) for s in part])
        row = np.arange(len(part))
        sides.append(Lines(row, row, size, np.concatenate(part).astype(np.uint64), np.repeat(row, size)))
    assert line_dedup._common(*sides).tolist() == [len(set(a) & set(b)) for a, b in zip(sets[:100], sets[100:], strict=True)]
    back = line_dedup._unpacked(line_dedup._packed(sides[0]))
    assert back.tokens.tolist() == sides[0].tokens.tolist() and back.owner.tolist() == sides[0].owner.tolist()


def test_signatures_tell_long_lines_apart():
    """The bits differ by no more than the sets do, and by much for long lines that share little, of whatever sizes."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))

    def sets(several):
        size = np.array([len(s) for s in several])
        row = np.arange(len(several))
        return Lines(row, row, size, np.concatenate([np.sort(s) for s in several]), np.repeat(row, size))

    def differ(a, b):
        (p, q), (r, s) = line_dedup.signatures(sets(a)), line_dedup.signatures(sets(b))
        return np.bitwise_count(p ^ r).astype(int) + np.bitwise_count(q ^ s)

    a = [base[: rng.integers(1, 400)] for _ in range(200)]
    b = [np.union1d(s[rng.random(len(s)) < rng.random()], base[-5:]) for s in a]
    assert (differ(a, b) <= [len(np.setxor1d(s, t)) for s, t in zip(a, b, strict=True)]).all()
    for n, m in ((150, 150), (150, 165), (200, 190)):
        x, y = ([rng.integers(0, 1 << 63, size, dtype=np.uint64) for _ in range(100)] for size in (n, m))
        bound = n + m - 2 * -(-80 * (n + m) // 180)
        assert (differ(x, y) > bound).mean() > 0.95


def test_small_tables_and_bitmaps_take_few_tasks(spark, monkeypatch):
    """However many shuffle partitions the session has, tasks follow the rows; the results stay."""
    from quillstream.llm import columns, membership

    before = spark.conf.get("spark.sql.shuffle.partitions")
    tasks = []
    keep = columns.gathered
    monkeypatch.setattr(columns, "gathered", lambda blobs, parts, *more: tasks.append(parts) or keep(blobs, parts, *more))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = [*enumerate(variants(6, 60))]
        got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        pairs = spark.createDataFrame([(k, k % 3, k + 1000, k % 5) for k in range(500)], "x long, a int, y long, b int").repartition(40)
        xs, ys, texts = membership.end_bitmaps(pairs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == sorted(brute(rows, 80, 1))
    assert max(n for n in tasks if n) == 8
    k = np.arange(500)
    assert xs.inside(membership.pair_cells(k, k % 3)).all() and ys.inside(membership.pair_cells(k + 1000, k % 5)).all()
    assert xs.inside(membership.pair_cells(k + 1000, k % 5)).mean() < 0.3
    cells = np.array([r[0] for r in pairs.select(membership.cell("y")).collect()])
    assert texts.inside(cells).all()


def test_meeting_texts_cost_no_sort(monkeypatch):
    """Texts that meet without white space are told apart where words are found, not by a sort of all words."""
    texts = ["ab Cd", "e", "", "f g\n", None, " h", "i\x0bjk", "\x1cl", "m "]
    data, offsets = tx.buffers(pa.array(texts))
    want = [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    monkeypatch.setattr(np, "sort", None)
    starts, ends, first = tx.word_bounds(data, offsets)
    got = [data.tobytes()[a:b] for a, b in zip(starts, ends, strict=True)]
    assert [got[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == want
