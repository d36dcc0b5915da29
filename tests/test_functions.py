import difflib

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import udfs as U
from quillstream.functions import urls as W
from quillstream.operators import groups as G
from quillstream.operators import rows as R
from quillstream.sources import tables as S


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr.alias("x")).head()["x"]


@pytest.mark.parametrize(("title", "want"), [
    (None, ""), ("", ""), ("!!", ""), ("  A  Theory:\tof  Money ", "a theory of money"), ("Café-Économie", "cafconomie"), ("x y", "x y"),
])
def test_normalize_title(spark, title, want):
    assert one(spark, T.normalize_title(F.col("t")), t=title) == want


@pytest.mark.parametrize(("title", "want"), [
    ("trade and growth — Working Paper", "Trade and growth"), ("Wages [R&R]", "Wages"), ("Wages (forthcoming) ", "Wages"), ("new methods", "New methods"), ("A — B", "A — B"), ("", ""),
])
def test_clean_title(spark, title, want):
    assert one(spark, T.clean_title(F.col("t")), t=title) == want


def test_normalize_text(spark):
    assert one(spark, T.normalize_text(F.col("t")), t="“Paper”  (202 6 ) Skip to Main Content 1 2 3 ;") == '"Paper" (2026) 12 3;'


@pytest.mark.parametrize(("a", "b", "ok"), [
    ("M.", "Max", True), ("R.A.", "Ronald A.", True), ("Gérard", "Gerard", True), ("Pei-Tha", "Pei Tha", True), ("Michael", "Max", False), ("", "Max", False), (None, "Max", False),
    ("J. K.", "John", True), ("J", "J.", True), ("A.", "B.", False), ("Max", "Max Otto", True), ("John A", "John B", False),
])
def test_compatible_names(spark, a, b, ok):
    assert one(spark, T.compatible_names(F.col("a"), F.col("b")), a=a, b=b) is ok
    assert one(spark, T.compatible_names(F.col("a"), F.col("b")), a=b, b=a) is ok


def test_other_names(spark):
    assert one(spark, T.initial_match(F.col("a"), F.col("b")), a="M.", b="Max") is True
    assert one(spark, T.initial_match(F.col("a"), F.col("b")), a="Max", b="Max") is False
    assert one(spark, T.abbreviation(F.col("a"), F.col("b")), a="Chris", b="Christopher") is True
    assert one(spark, T.longer_name(F.col("a"), F.col("b")), a="M..", b="Ma") == "Ma"
    assert one(spark, T.bad_name(F.col("a"), F.col("b")), a="Ann", b="K.") is True


@pytest.mark.parametrize(("url", "doi"), [
    ("https://doi.org/10.1257/aer.2018#x", "10.1257/aer.2018"), ("https://papers.ssrn.com/sol3/papers.cfm?abstract_id=77", "10.2139/ssrn.77"), ("https://x.org/asset/10.1000/1", None),
    ("https://x.org/doi/10.1000/abc/", "10.1000/abc"), ("https://x.org/10.99/abc", None), (None, None),
])
def test_doi(spark, url, doi):
    assert one(spark, W.doi(F.col("u")), u=url) == doi


@pytest.mark.parametrize(("url", "kind"), [
    ("https://www.nber.org/papers/w1", "nber"), ("https://academic.oup.com/topics/x", None), ("https://academic.oup.com/qje/1", "journal"), ("https://evilnber.org/x", None), ("https://ideas.repec.org/p", "repository"), ("nonsense", None),
])
def test_trusted_type(spark, url, kind):
    assert one(spark, W.trusted_type(F.col("u")), u=url) == kind


def test_years_json_and_topics(spark):
    assert [one(spark, T.coerce_year(F.col("y")), y=y) for y in ("c. 1998", "forthcoming", " ", None, "2024-05")] == ["1998", "fort", None, None, "2024"]
    assert one(spark, T.fenced_json(F.col("t")), t='x\n```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.inverted_index_text(F.col("t")), t='{"b": [1], "a": [0, 2]}') == "a b a"
    assert one(spark, F.array_join(T.topic_codes(F.col("t")), ""), t="Immigration and Fiscal Policy") == "JFEH"


def test_udfs(spark):
    assert one(spark, U.strip_accents(F.col("t")), t="Žižek Ø") == "Zizek Ø"
    a, b = "the cat sat on the mat", "the cat on a mat sat"
    assert one(spark, U.sequence_ratio(F.split("a", " "), F.split("b", " ")), a=a, b=b) == difflib.SequenceMatcher(None, a.split(), b.split()).ratio()
    page = "<html><script>no</script><nav>menu</nav><p>A &amp; B <a href='/x'>link <b>here</b></a></p></html>"
    assert one(spark, U.page_text(F.col("t")), t=page) == "menuA & B link here"
    assert "menu" not in one(spark, U.main_text(F.col("t")), t=page)
    link = one(spark, U.page_links(F.col("t"))[0], t=page)
    assert (link.url, link.anchor, link.block) == ("/x", "link here", "A & B link here")
    assert one(spark, U.match_html(F.col("t")), t="<p>R&amp;D \\u0041 <i>b</i></p>") == "r d a b"
    assert one(spark, U.inflated(U.deflated(F.col("t"))), t="é" * 99) == "é" * 99
    assert one(spark, U.cp1252_repair(F.col("t")), t="cafÃ©") == "café" and one(spark, U.cp1252_repair(F.col("t")), t="Âme") == "Âme"
    assert one(spark, U.compact_diff(F.col("a"), F.col("b")), a="Same.", b="Same.") == ""


@pytest.mark.parametrize(("title", "page", "ok"), [
    ("money and banking theory", "our money and banking theory", True), ("", "x", False), ("one two", "three", False),
    ("monetary policy rules with learning agents", "monetary policy the rules learning agents with", True), ("monetary policy rules with learning agents", "monetary x x x x x x x x policy", False),
])
def test_title_on_page(spark, title, page, ok):
    assert one(spark, U.title_on_page(F.col("a"), F.col("b")), a=title, b=page) is ok


@pytest.mark.parametrize(("old", "new", "ok"), [("a theory of money", "a theory of the money", False), ("a theory of money", "a theory of trade", True), ("money and trade", "wages in the long run", True), ("money", "money and trade today", False), ("co operation games", "cooperation games", False), ("[R&R at AER] A theory", "A theory", False), ("a b c d", "a x c d", True), ("a b c", "x a b c", False), ("a b c d e", "a c d", True), ("", "money", False), (None, "money", False)])
def test_title_renamed(spark, old, new, ok):
    assert one(spark, T.title_renamed(F.col("a"), F.col("b")), a=old, b=new) is ok


def test_components_and_survivors(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (7, 3)], "a long, b long")
    assert {r.node: r.root for r in G.connected(pairs).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 4: 4, 5: 4}
    assert G.connected(pairs.limit(0)).count() == 0
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    assert {r.root for r in G.connected(chain).collect()} == {0}


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k long, at long").withColumn("at", F.timestamp_seconds("at"))
    right = spark.createDataFrame([(1, 10, "a"), (1, 15, None), (1, 20, "c")], "k long, seen long, v string").withColumn("seen", F.timestamp_seconds("seen"))
    got = R.as_of(left, right, ["k"], "at", "seen", "v", "last").orderBy("k", "at").collect()
    assert [r["last"] for r in got] == [None, None, None]
    got = R.as_of(left, right.where("v is not null"), ["k"], "at", "seen", "v", "last").orderBy("k", "at").collect()
    assert [r["last"] for r in got] == [None, "a", None]


def test_status_order(spark):
    rows = spark.createDataFrame([(1, 1, "working_paper"), (1, 2, "accepted"), (1, 3, "revise_and_resubmit"), (1, 4, None), (1, 5, "published")], "p long, t long, s string")
    kept = R.advances(rows, ["p"], R.status_rank(F.col("s")), "t").collect()
    assert [r.t for r in kept] == [1, 2, 4, 5]


def test_sources(spark, tmp_path):
    (tmp_path / "people.csv").write_text("﻿first_name,last_name,position,affiliation,page_type,url\nAnn,Lee,Prof,MIT,home,http://a\nBo,Ng\n", encoding="utf-8")
    assert [(r.first_name, r.url) for r in S.read_people_csv(spark, str(tmp_path / "people.csv")).collect()] == [("Ann", "http://a")]
    (tmp_path / "p" / "q").mkdir(parents=True)
    (tmp_path / "p" / "q" / "a.rdf").write_text("Name-First: Ann\nName-Last: Lee\nWorkplace-Name: MIT\nWorkplace-Name: NBER\nHomepage: http://a\nHandle: x:1\n")
    (tmp_path / "p" / "b.rdf").write_text("Name-First: Bo\nName-Last: Ng\n")
    assert [(r.first_name, r.workplace, r.handle) for r in S.read_person_files(spark, str(tmp_path / "p")).collect()] == [("Ann", "MIT", "x:1")]
    (tmp_path / "e.jsonl").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    assert sorted(r.id for r in S.read_json_lines(spark, str(tmp_path / "e.jsonl"), "id long").collect()) == [1, 2]
