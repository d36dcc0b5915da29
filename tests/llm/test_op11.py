import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from quillstream.llm import queries, suffix_blocks, suffix_dedup


def brute(rows, length):
    """(doc_id, n_bytes, spans, kept) from the definition: every string of so many bytes of every text."""
    places = defaultdict(list)
    raws = [(t or "").encode() for _, t in rows]
    for k, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            places[raw[i : i + length]].append((k, i))
    gone = [bytearray(len(raw)) for raw in raws]
    for found in places.values():
        if len(found) > 1:
            for k, i in found:
                gone[k][i : i + length] = b"\x01" * length
    out = []
    for (doc, _), raw, g in zip(rows, raws, gone, strict=True):
        runs = [i for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1])]
        spans = [(i, i + (bytes(g[i:]) + b"\x00").index(0)) for i in runs]
        out.append((doc, len(raw), spans, bytes(b for b, x in zip(raw, g, strict=True) if not x)))
    return out


def variants(seed, count):
    """Texts of shared passages, whole copies, edited copies and repeated units."""
    rng = random.Random(seed)
    words = [f"{rng.choice(['ab', 'é', 'Zu', 'q'])}{rng.randrange(900)}" for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages, out = [prose(rng.randrange(20, 90)) for _ in range(6)], []
    for k in range(count):
        kind = rng.randrange(6)
        if kind == 0 and out:
            out.append(rng.choice(out))
        elif kind == 1 and out:
            edited = rng.choice(out).split(" ")
            edited[rng.randrange(len(edited))] = f"edit{k}"
            out.append(" ".join(edited))
        elif kind == 2:
            out.append(prose(rng.randrange(1, 60)) + rng.choice(["", " "]) + rng.choice(["a", "ab ", "one two three "]) * rng.randrange(40, 200) + prose(5))
        else:
            out.append(prose(rng.randrange(0, 40)) + " " + rng.choice(passages) + " " + prose(rng.randrange(0, 40)))
    return out


@pytest.mark.parametrize("wide", [1, 4, 1000])
def test_a_block_against_the_definition(monkeypatch, wide):
    monkeypatch.setattr(suffix_blocks, "ROW_BY_ROW", wide)
    rng = random.Random(3)
    for _ in range(60):
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 40))) * rng.choice([1, 1, 2, 4]) for _ in range(rng.randrange(1, 12))]
        depth = rng.choice([1, 2, 5, 9, 17])
        data = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
        strings = [bytes(data[i : i + depth]) for i in range(len(data))]
        good = [len(s) == depth and b"\xff" not in s and strings.count(s) > 1 for s in strings]
        assert suffix_blocks.repeated(data, depth).tolist() == good
    assert suffix_blocks.repeated(np.zeros(0, np.uint8), 5).tolist() == []


def test_segments_depend_on_their_text_only(monkeypatch):
    texts = [t.encode() for t in variants(9, 40)]
    whole = []
    for chunk in (1 << 16, 333):
        monkeypatch.setattr(suffix_dedup, "_CHUNK", chunk)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        row, start, n, core, twice = suffix_dedup.segments(np.frombuffer(b"".join(texts), np.uint8), offsets, 200)
        whole.append(list(zip(row.tolist(), (start - offsets[row]).tolist(), n.tolist(), core.tolist(), twice.tolist(), strict=True)))
        assert n.max() <= suffix_dedup.SEGMENT
        assert sum(n.tolist()) == sum(max(0, len(t) - 199) for t in texts)
    assert whole[0] == whole[1]


@pytest.mark.parametrize(("group", "deal", "block", "length"), [(4096, 1 << 18, 1 << 20, 200), (2, 64, 2000, 200), (3, 1 << 18, 500, 96)])
def test_removed_bytes_against_brute_force(spark, odd, monkeypatch, group, deal, block, length):
    for name, value in (("GROUP", group), ("DEAL_ROWS", deal), ("BLOCK", block)):
        monkeypatch.setattr(suffix_dedup, name, value)
    texts = variants(group, 160)
    rows = [*odd, *((100 + k, t) for k, t in enumerate(texts)), (None, texts[3]), (None, texts[3]), (None, texts[3]), (120, texts[20]), (130, texts[31] + "x" * 700)]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, start int, key string").repartition(5)
    got = suffix_dedup.without_repeats(docs, length).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got), key=key) == sorted(brute(rows, length), key=key)
    assert suffix_dedup.without_repeats(docs.limit(0), length).collect() == []


def test_op11_over_documents(spark, sample):
    got = queries.op11_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    wanted = [(d, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for d, n, spans, kept in brute(sample, 200)]
    assert sorted(tuple(r) for r in got) == sorted(wanted)
    assert sum(r.n_removed > 0 for r in got) > 3
