"""Bytes and files from outside: charsets that come back, SQLite reads with conditions, writes that survive a repeat; near titles by bounds."""

import datetime
import decimal
import difflib
import random
import re
import sqlite3

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillstream import session
from quillstream.functions import charset
from quillstream.functions import udfs as U
from quillstream.functions import values as V
from quillstream.operators import identity
from quillstream.sources import sqlite

TEXTS = {
    "cp1252": ["Les élèves français étaient déjà là, où l’été à Orléans finit.", "Über die Größe der Städte: schöne Mädchen, süße Träume", "El niño pequeño está en la montaña, mañana también", "“Quoted” — naïve café à la crème…"],
    "cp1250": ["Příliš žluťoučký kůň úpěl ďábelské ódy", "Zażółć gęślą jaźń, proszę państwa", "Těžký život v české vesnici je často veselý"],
    "cp1251": ["Съешь же ещё этих мягких французских булок", "В чащах юга жил бы цитрус? Да, но фальшивый экземпляр"],
    "koi8-r": ["Съешь же ещё этих мягких французских булок", "Экономический рост и торговля в открытых странах"],
    "cp1253": ["Ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "Η οικονομική ανάπτυξη και το εμπόριο"],
    "utf-8": ["Příliš žluťoučký kůň", "漢字とかな \U0001f600", "plain ascii", ""],
    "utf-8-sig": ["mit Zeichen für die Größe"], "utf-16": ["wide ß текст \U0001f600"],
}


def test_charsets_come_back(spark):
    rows = [(name, text, text.encode(name)) for name, texts in TEXTS.items() for text in texts]
    rows += [("cp1251", t, t.encode("cp1251")) for t in ['<meta charset="windows-1251">Рост <p>и</p> торговля']] + [(None, None, None)]
    pages = spark.createDataFrame([(k, raw, "x") for k, (_, _, raw) in enumerate(rows)], "k int, raw binary, keep string").repartition(2)
    got = {r.k: r for r in charset.decoded(pages).collect()}
    assert [got[k].html for k in range(len(rows))] == [t for _, t, _ in rows]
    assert [got[k].charset for k in range(len(rows)) if rows[k][0] != "utf-8"] == [n for n, _, _ in rows if n != "utf-8"]


def test_a_false_declaration_and_broken_bytes():
    page = '<meta charset="utf-8"><p>Städte und Größe, schöne Träume'.encode("cp1252")
    broken = [b"\xc3", b"\xe2\x82", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\x80", b"a\xc3\xa4\xa4", b"\xf0\x80\x80\x80", b"\xe0\x80\x80"]
    whole = ["é".encode(), "€".encode(), "\U0001f600".encode(), b"", b"a", "퟿".encode(), "\U0010ffff".encode()]
    data = b"".join([page, *broken, *whole])
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in [page, *broken, *whole]])])
    names = charset.detected(np.frombuffer(data, np.uint8), offsets)
    assert names[0] == "cp1252" and "utf-8" not in names[1 : 1 + len(broken)] and set(names[1 + len(broken) :]) == {"utf-8"}
    rng = random.Random(1)
    for _ in range(200):  # against Python's own decoder
        texts = [bytes(rng.choice(b"a\x80\xbf\xc2\xc3\xe0\xe2\x82\xac\xed\x9f\xa0\xf0\x90\xf4\x8f") for _ in range(rng.randrange(6))) for _ in range(5)]
        bad = charset._invalid_utf8(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        for t, n in zip(texts, bad.tolist(), strict=True):
            try:
                t.decode()
                assert n == 0
            except UnicodeDecodeError:
                assert n > 0


SHAPE = "id long, name string, at timestamp_ntz, day date, amount decimal(10,2), ok boolean, raw binary, x double"


def some_rows(n):
    return [(k, None if k % 7 == 0 else f"n{k % 5}", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k), datetime.date(2024, 1, 1 + k % 28), decimal.Decimal(k) / 4, k % 2 == 0, bytes([k % 256]), k / 8) for k in range(n)]


def test_sqlite_round_trip_and_conditions(spark, tmp_path):
    sqlite.register(spark)
    rows, path = some_rows(1000), str(tmp_path / "db")
    spark.createDataFrame(rows, SHAPE).repartition(4).write.format("sqlite_rows").option("path", path).option("table", "t t").mode("append").save()
    back = spark.read.format("sqlite_rows").schema(SHAPE).option("path", path).option("table", "t t").option("partitions", 3).load()
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    assert back.rdd.getNumPartitions() == 12
    found = back.where((F.col("id") >= 10) & (F.col("name") == "n3") & F.col("ok") & (F.col("amount") > 20)).collect()
    assert sorted(tuple(r) for r in found) == sorted(r for r in rows if r[0] >= 10 and r[1] == "n3" and r[5] and r[4] > 20)
    assert back.where("name is null").count() == 143 and back.where("id in (1, 2, 5000)").count() == 2
    spark.createDataFrame(rows[:3], SHAPE).write.format("sqlite_rows").option("path", path).option("table", "t t").mode("overwrite").save()
    assert spark.read.format("sqlite_rows").schema(SHAPE).option("path", path).option("table", "t t").load().count() == 3
    # a file of another program, its types read from it
    file = str(tmp_path / "one.db")
    con = sqlite3.connect(file)
    con.execute("create table r (id integer primary key, score real, note text)")
    con.executemany("insert into r values (?, ?, ?)", [(k * 10, k / 2, None if k % 3 else "x") for k in range(50)])
    con.commit()
    con.close()
    read = spark.read.format("sqlite_rows").option("path", file).option("table", "r").load()
    assert read.dtypes == [("id", "bigint"), ("score", "double"), ("note", "string")] and read.where("note is not null and id < 100").count() == 4


def test_conditions_run_in_sqlite(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    file = str(tmp_path / "one.db")
    con = sqlite3.connect(file)
    con.execute("create table r (id integer, s text)")
    con.executemany("insert into r values (?, ?)", [(k, "ab"[k % 2]) for k in range(100)])
    con.commit()
    con.close()
    reader = sqlite.SqliteReader(file, "r", 4, StructType([StructField("id", LongType()), StructField("s", StringType())]))
    left = list(reader.pushFilters([EqualTo(("s",), "a"), GreaterThan(("id",), 90), StringContains(("s",), "a")]))
    assert [type(f) for f in left] == [StringContains]
    assert [r for p in reader.partitions() for r in reader.read(p)] == [(92, "a"), (94, "a"), (96, "a"), (98, "a")]


def test_a_task_that_runs_twice_writes_once(spark, tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    path, shape = str(tmp_path / "db"), StructType([StructField("id", LongType())])
    writer = sqlite.SqliteWriter(path, "t", shape, False)
    first, again = (writer.write(iter([Row(id=1), Row(id=2)])) for _ in range(2))
    assert first.file != again.file
    other = writer.write(iter([Row(id=3)]))
    assert sqlite.files(path) == []  # nothing is there before the commit
    writer.commit([again, other, None])
    reader = sqlite.SqliteReader(path, "t", 2, shape)
    assert sorted(r for p in reader.partitions() for r in reader.read(p)) == [(1,), (2,), (3,)]
    broken = sqlite.SqliteWriter(path, "t", shape, False)
    broken.abort([broken.write(iter([Row(id=9)])), None])
    assert sorted(r for p in sqlite.SqliteReader(path, "t", 2, shape).partitions() for r in reader.read(p)) == [(1,), (2,), (3,)]


def form(s):
    return re.sub(r"[^\w\s]", "", s.lower().replace("-", "").replace("'s", "").replace("’s", "")).split()


@pytest.mark.parametrize("least", [0.85, 0.6])
def test_fuzzy_pairs_against_all_pairs(spark, least):
    rng = random.Random(12)
    words = "trade wage firm the of and growth tax school a model open".split()
    rows = []
    for k in range(160):
        base = rng.choice(rows)[1].split() if rows and rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(0, 12))]
        base = list(base)
        for _ in range(rng.randrange(3)):
            base.insert(rng.randrange(len(base) + 1), rng.choice(words + [f"u{k}"]))
            if rng.random() < 0.5:
                base.pop(rng.randrange(len(base)))
        rows.append((k, " ".join(base), rng.choice("xy"), rng.choice([None, None, "d1", f"d{k}"])))
    got = identity.fuzzy_pairs(spark.createDataFrame(rows, "id long, title string, authors string, doi string"), U.sequence_ratio, least).collect()
    leads, wanted = {}, set()
    for k, title, authors, doi in rows:
        lead = leads.setdefault((authors, title, doi), k)
        if lead != k and doi is None:
            wanted.add((lead, k))
    own = [r for r in rows if leads[(r[2], r[1], r[3])] == r[0]]
    for i, (a, x, s, d) in enumerate(own):
        for b, y, t, e in own[i + 1 :]:
            if s == t and not (d is not None and d == e):
                p, q = form(x), form(y)
                u, v = ({w for w in z if w not in V.TITLE_STOPWORDS} for z in (p, q))
                seq = difflib.SequenceMatcher(None, p, q).ratio() if p and q else 0.0
                over = len(u & v) / min(len(u), len(v)) if u and v else 0.0
                if (seq if over > seq and seq < 0.5 else max(seq, over)) >= least:
                    wanted.add((a, b))
    assert {(r.a, r.b) for r in got} == wanted and len(got) == len(wanted) > 100
    # the bounds leave few pairs to compare
    T = identity.T
    titles = spark.createDataFrame(rows, "id long, title string, authors string, doi string")
    met = identity.likely_pairs(titles.select("authors", "id", T.words(T.fuzzy_form(F.col("title"))).alias("w"), T.content_words(F.col("title")).alias("c")), least).count()
    assert met < 0.4 * sum(s[2] == r[2] for i, r in enumerate(rows) for s in rows[i + 1 :])


def test_batches_of_pages_are_small(spark):
    """10,000 whole pages at once, of which each byte takes some thirty, were more than an executor has."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    pages = spark.range(400).select(F.col("id").alias("page_id"), F.encode(F.repeat(F.lit("some words "), 5000), "UTF-8").alias("raw")).coalesce(1)
    before = spark.conf.get(session.BATCH)
    spark.conf.unset(session.BATCH)
    try:
        texts = charset.decoded(pages)
        for rows in (pages, texts):  # those it reads, and those it gives on
            got = [r["size"] for r in rows.mapInArrow(sizes, "size long").collect()]
            assert sum(got) > 20 << 20 and max(got) < session.BATCH_BYTES + (1 << 20)
    finally:
        spark.conf.set(session.BATCH, before)


def test_slices_of_pages():
    raw = [b"x" * n for n in (3, 1 << 19, 0, 1 << 19, 1 << 22, 5, (1 << 20) - 5)] + [None]
    batch = pa.RecordBatch.from_pydict({"raw": pa.array(raw, pa.binary())})
    parts = [part.column("raw").to_pylist() for part in charset._slices(batch, "raw")]
    assert [v for part in parts for v in part] == raw and 3 <= len(parts) <= 5
    assert all(sum(len(v or b"") for v in part[1:]) <= 1 << 20 for part in parts)
    assert list(charset._slices(batch.slice(0, 0), "raw"))[0].num_rows == 0
