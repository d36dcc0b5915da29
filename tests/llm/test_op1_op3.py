import io
import itertools
import random
from collections import Counter
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from quillstream.llm import bpe, packing, storage, text, warc


class Bytes:
    """A seekable file that counts what is read of it."""

    def __init__(self, raw):
        self.raw, self.seen = raw, 0

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        self.seen += n
        return self.raw[at : at + n]


@pytest.mark.parametrize("far", [False, True])
def test_directory_of_zip_and_zip64(far, monkeypatch):
    members = {"a.txt": b"alpha" * 50, "dir/b": b"", "ü.bin": bytes(range(256)) * 400}
    out = io.BytesIO()
    if far:  # write the 64-bit records though the archive is small
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.comment = b"PK\x05\x06 not the end record"
        for name, data in members.items():
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=far) as f:
                f.write(data)
        z.writestr(zipfile.ZipInfo("packed"), b"x" * 1000, zipfile.ZIP_DEFLATED)
    assert (b"PK\x06\x06" in out.getvalue()) == far
    file = Bytes(out.getvalue())
    directory = warc.ZipDirectory(file)
    assert list(directory.members) == [*members, "packed"]
    for name, data in members.items():
        assert directory.whole(name) == data
    file.seen = 0
    assert directory.range("ü.bin", 1000, 16) == members["ü.bin"][1000:1016] and file.seen < 100
    with pytest.raises(ValueError):
        directory.start("packed")
    with pytest.raises(ValueError):
        directory.range("a.txt", 0, 251)
    with pytest.raises(ValueError):
        warc.ZipDirectory(Bytes(out.getvalue()[:-40]))


def test_archives_round_trip(spark, monkeypatch):
    rows = [(1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (5, "u", None), (3, "u\r\nx", ""), (3, "u", ""), (None, "n", "<p>é</p>"), (None, None, "alone"), (9, "z", "WARC/1.1\r\n\r\nHTTP/1.1"), (10, "z", "x" * 200_000), (2, "http://b", "<p>é</p>"), (1, "http://a", "<p>é</p>"), (1, "http://0", "<p>é</p>"), (1, None, "<p>é</p>")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int")
    manifest = warc.write(pages.repartition(3), f"{storage.shared_dir(spark)}/archives")
    assert sum(r.records for r in manifest.collect()) == len(rows)
    got = warc.read(manifest, payloads=True).collect()
    # one response a payload: of the least page_id, then of the least url
    numbered = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is None, r[1] or ""))
    leads = {}
    for r in numbered:
        leads.setdefault(r[2] or "", r)
    want, led = [], set()
    for page, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        html = html or ""
        lead = leads.get(html)
        revisit = lead is not None and (html in led or (page, url) != lead[:2])
        if lead is not None and not revisit:
            led.add(html)
        want.append((page, (url or "").replace("\r", "%0D").replace("\n", "%0A"), len(html.encode()), warc.digest(html.encode()), "revisit" if revisit else "response", lead[0] if revisit else None, None if revisit else html))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[4])
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.html) for r in got), key=key) == sorted(want, key=key)
    assert [r.record_type for r in got if r.page_id == 1 and r.html] == ["response"]
    assert warc.read(warc.write(pages.limit(0), f"{storage.shared_dir(spark)}/none")).count() == 0


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts, strict=True))


def test_limits_are_optimal():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 9)
        lengths = np.array(rng.sample(range(1, 40), n))
        counts = np.array([rng.randrange(1, 20) for _ in range(n)])
        k = rng.randrange(1, 5)
        ends = packing.limits(lengths, counts, k)
        assert len(ends) <= k and max(ends) == lengths.max()
        choices = (set(c) | {int(lengths.max())} for m in range(min(k, n)) for c in itertools.combinations(lengths.tolist(), m))
        assert padding(lengths, counts, ends) == min(padding(lengths, counts, c) for c in choices)
    assert packing.limits(np.array([], int), np.array([], int), 4) == []


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_pack(spark, sample, odd):
    rows = [*sample, *((10_000 + (i or 0), t) for i, t in odd), (None, "one two three"), (None, "four five")]
    docs = spark.createDataFrame([(i, t, 9, "b") for i, t in rows], "doc_id long, text string, piece int, batch string")
    got = packing.pack(packing.tokenised(docs, vocabulary()), longest=300, buckets=5, budget=1500, shard_rows=40).collect()
    code, texts, pieces = bpe.encoder(vocabulary()), {}, {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
        n = len(code.encode(np.frombuffer((t or "").encode(), np.uint8)))
        for k in range(0, n, 300):
            pieces[(i, k // 300)] = pieces.get((i, k // 300), []) + [(k, min(300, n - k))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.first_token, r.n_tokens) for r in got), key=key) == sorted(((*k, *v) for k, vs in pieces.items() for v in vs), key=key)
    assert all(len(r.tokens) == r.n_tokens for r in got)
    for i, own in texts.items():  # slices decode back to the text
        if len(own) == 1:
            ids = [t for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece) for t in r.tokens]
            assert code.decode(np.array(ids, int)) == own[0]
    lengths = np.array([r.n_tokens for r in got])
    values, counts = np.unique(lengths, return_counts=True)
    ends = packing.limits(values, counts, 5)
    batches = {}
    for r in got:
        assert r.bucket_length == min(e for e in ends if e >= r.n_tokens)
        batches.setdefault(r.batch, []).append(r)
    short = {}
    for name, own in batches.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        slots = max(1, 1500 // own[0].bucket_length)
        assert len(own) <= slots and len({r.bucket_length for r in own}) == 1
        if len(own) < slots:
            short[name.rsplit("-", 1)[0]] = short.get(name.rsplit("-", 1)[0], 0) + 1
    assert all(n == 1 for n in short.values())
    assert packing.pack(packing.tokenised(docs.limit(0), vocabulary())).count() == 0


def test_copies_of_one_row_fill_many_shards(spark):
    docs = spark.createDataFrame([(None, "one two three")] * 500, "doc_id long, text string")
    got = packing.pack(packing.tokenised(docs, vocabulary()), buckets=2, shard_rows=50).collect()
    shards = Counter(r.batch.rsplit("-", 1)[0] for r in got)
    assert len(got) == 500 and len(shards) == 10 and max(shards.values()) < 90


def test_byte_pair_encoding_equals_the_library(sample, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    rng = random.Random(2)
    alphabet = [*"abcXYZ019 \n\t.,!?'’-_é漢字ßñ 　 \U0001f600́٣Ⅷ²\x85\x1c", "'s", "'re", "  ", "\n\n", "<|endoftext|>", "<|", "!'", "''", "s'", "http://", "\r\n", "‍", "×", "÷", "ԯ", "Ա", "\u0558", "\ua7d2"]
    texts = [t or "" for _, t in [*sample, *odd]]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(6000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(2000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for kept in (bpe.KEPT, 50):  # also when what was met before is forgotten
        code = bpe.Encoder(vocabulary())
        bpe.KEPT, kept = kept, bpe.KEPT
        got = [ids for k in range(0, len(texts), 500) for ids in code.encode_all(*text.buffers(pa.array(texts[k : k + 500])))]
        bpe.KEPT = kept
        for t, ids, w in zip(texts, got, want, strict=True):
            assert ids.tolist() == w, t
            assert code.decode(ids) == library.decode(w, skip_special_tokens=False)


@pytest.mark.parametrize("long", [" " * 1_000_000 + "a", "\n" * 1_000_000, "a" * 1_000_000, "ab" * 300_000, "é" * 200_000, " \n" * 200_000 + "x", "aab" * 70_000])
def test_long_runs(long):
    from tokenizers import Tokenizer

    ids = bpe.encoder(vocabulary()).encode(np.frombuffer(long.encode(), np.uint8))
    assert ids.tolist() == Tokenizer.from_file(vocabulary()).encode(long, add_special_tokens=False).ids


def test_every_certain_cut_is_taken(sample):
    code = bpe.encoder(vocabulary())
    for _, t in sample[:50]:
        data = np.frombuffer((t or "").encode(), np.uint8)
        apart = [code.encode(part) for part in np.split(data, code.cuts(data))]
        assert np.concatenate(apart).tolist() == code.encode(data).tolist()


def test_byte_pair_rows(spark, odd):
    docs = spark.createDataFrame([(i, t, 1) for i, t in odd], "doc_id long, text string, n_tokens int")
    got = bpe.encode_digests(docs, vocabulary()).collect()
    assert len(got) == len(odd) and {r.n_tokens for r in got if r.doc_id in (0, 1)} == {0}
    assert bpe.tokenise(docs.limit(0), vocabulary()).count() == 0


def test_only_copies_of_pages_are_shuffled(spark, monkeypatch):
    """Pages that are no copies stay where they are; copies, near misses and null ids come out right."""
    shuffled = []
    keep = storage.written

    def spied(df, name="table"):
        if name == "manifest":
            shuffled.append(df._jdf.queryExecution().analyzed().toString())
        return keep(df, name)

    monkeypatch.setattr(storage, "written", spied)
    rows = [(k, f"u{k}", "same" if k % 10 == 3 else f"page {k}") for k in range(200)] + [(None, None, "same"), (None, None, "alone"), (3, "u3", "same"), (7, "u0", "page 7")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = sorted(((-1 if r.page_id is None else r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(warc.write(pages, f"{storage.shared_dir(spark)}/archives")).collect())
    want, seen = [], set()
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first = 3 if html == "same" else page
        new = html not in seen
        seen.add(html)
        want.append((-1 if page is None else page, "response" if new else "revisit", None if new else first, len(html)))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2] or 0))
    assert "NOT may_copy" in shuffled[0]  # rows that go to the archives without a join


def test_fragments_met_before_stay_known(monkeypatch):
    """More fragments than places push out some of those met before, not all; what differs only in its end isn't mistaken."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "KEPT", 1024)
    code, asked = bpe.Encoder(vocabulary()), []
    keep = code.encode_fragments
    monkeypatch.setattr(code, "encode_fragments", lambda data, start, end: asked.append(len(start)) or keep(data, start, end))
    library = Tokenizer.from_file(vocabulary())

    def encoded(texts):
        asked.clear()
        got = code.encode_all(*text.buffers(pa.array(texts)))
        assert [ids.tolist() for ids in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        return sum(asked)

    common = ["".join(x) for x in itertools.product(("an", "en", "ti", "on", "st"), repeat=4)][:600]
    assert encoded(common) > 300
    first = encoded(common)
    encoded(["".join(x) for x in itertools.product(("er", "re", "in", "at", "or", "es"), repeat=4)][:900])
    again = encoded(common)
    assert first < 300 and again < 500
    ends = ["ab", "ab\0", "ab\0\0", "abcdefgh", "abcdefgh\0", "abcdefghabcdefgh", "abcdefghabcdefghi", "abcdefghabcdefg\0", "\0", "\0\0", "", "12345678901234567890"]
    for _ in range(2):
        encoded(ends)
