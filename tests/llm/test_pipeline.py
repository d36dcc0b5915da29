import math

import corpus_pipeline as pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.llm import packing, pii, storage, toxicity
from tests.llm import test_op4, test_op6, test_op8_op10

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's result on documents with odd rows among them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(5001, None, "en", "x", None), (5002, "", None, None, 0), (5003, "call +1 (504) 555-2652 or jo (at) x (dot) org", "en", "x", 3), (None, "no id but words here", "en", "x", 20)], docs.schema)
    got = [docs.unionByName(more)]
    for _, stage in pipeline.STAGES:
        got.append(stage(spark, got[-1], SF))
    return got


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "pii", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_toxicity(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lexicon = toxicity.learn(stages[0], labels.where(~toxicity.held_out(F.col("doc_id"))))
    assert lexicon.weights and by_id(texts(stages[1])) == by_id((d, t) for d, t in texts(stages[0]) if plain_score(lexicon, t or "") < 0.5)


def plain_score(lexicon, text):
    """A text's score from the lexicon's entries, each looked for at every place."""
    text = toxicity.visible(text)
    low = toxicity.fold(text)
    starts = [i for i in range(len(text)) if not (i and text[i - 1].isalnum())]
    ends = lambda b: not (b < len(text) and text[b].isalnum())
    spared = [(i, i + len(p)) for p in map(toxicity.fold, lexicon.exceptions) for i in starts if low.startswith(p, i) and ends(i + len(p))]
    total = 0.0
    for i in starts:
        best = None
        for entry, weight in lexicon.weights.items():
            key = entry.rstrip("*")
            for form in {key, key.replace("l", "i")}:
                if low.startswith(form, i) and (entry.endswith("*") or ends(i + len(form))) and (best is None or weight > best[0]):
                    best = (weight, i + len(form))
        if best and not any(a <= i and best[1] <= b for a, b in spared):
            total += best[0]
    a, b, c = lexicon.coefficients
    z = a + (b * math.log1p(total) + c * total / math.sqrt(text.count(" ") + text.count("\n") + 1) if total else 0.0)
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def test_lines(stages):
    assert by_id(texts(stages[2])) == by_id((d, t) for d, t, _ in test_op6.brute(texts(stages[1]), 80, 1))


def test_near_duplicates(stages):
    rows = texts(stages[2])
    least = {}
    for d, n, c in test_op4.brute(rows, 5, 80):
        least[d] = c if n else d
    assert by_id(texts(stages[3])) == by_id((d, t) for d, t in rows if least[-1 if d is None else d] == (-1 if d is None else d))


def test_personal_data(stages):
    assert by_id(texts(stages[4])) == by_id((d, pii.redacted(t)) for d, t in texts(stages[3]))
    plain = [(t, r) for t, r in zip(*(dict(by_id(texts(s))).values() for s in (stages[3], stages[4])), strict=True) if t and pii.spans(t) == pii.plain(t)]
    for text, redacted in plain:  # where nothing is disguised, by the rules as they are written
        out, at = [], 0
        for a, b, kind in sorted(((a, b, k) for k, found in test_op8_op10.brute(text).items() for a, b in found), key=lambda s: (s[0], -s[1])):
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        assert redacted == "".join([*out, text[at:]])
    assert len(plain) > 50 and sum("[" in r for _, r in plain) > 3
    assert ("[PHONE]" in (t := dict(texts(stages[4]))[5003])) and "[EMAIL]" in t
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in stages[4].where("doc_id = 5003").collect())


def test_packing(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = stages[5].collect()
    want = []
    for d, t in texts(stages[4]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want += [(d, k // packing.LONGEST, ids[k : k + packing.LONGEST]) for k in range(0, len(ids), packing.LONGEST)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.piece, r.tokens) for r in got), key=key) == sorted(want, key=key)
    assert all(r.n_tokens == len(r.tokens) <= r.bucket_length for r in got)


def test_run_and_no_rows(spark, stages):
    assert sorted(map(str, pipeline.run(spark, SF).select("doc_id", "piece", "n_tokens").where("doc_id < 5000").collect())) != []
    docs = stages[0].limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_batches_of_long_texts_are_small(spark):
    """Neither side of a task's pipe holds 10,000 whole texts at once, in a stage's tables and in its result; less that a session asks for stays."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 5000).alias("text")).coalesce(1)
    before = spark.conf.get(storage.BATCH)
    spark.conf.unset(storage.BATCH)
    try:
        for rows in (storage.written(docs.mapInArrow(sizes, "size long")), docs.mapInArrow(sizes, "size long")):
            got = [r["size"] for r in rows.collect()]
            assert sum(got) > 20 << 20 and max(got) < storage.BATCH_BYTES + (1 << 20)
        spark.conf.set(storage.BATCH, "2m")
        storage.written(spark.range(1))
        assert spark.conf.get(storage.BATCH) == "2m"
    finally:
        spark.conf.set(storage.BATCH, before)
