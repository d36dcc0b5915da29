"""Matching rounds, linkage tiers, pages by key and the full-text index, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import values as V
from quillstream.operators import fulltext, linkage, matching, pages
from quillstream.operators import rows as R


def greedy(rows):
    left, right, out = set(), set(), []
    for g, a, b, s in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[0], -r[3], r[1], r[2])):
        if (g, a) not in left and (g, b) not in right:
            left.add((g, a))
            right.add((g, b))
            out.append((g, a, b, s))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_equal_greedy(spark, seed):
    rng = random.Random(seed)
    rows = list({(g, a, b): (g, a, b, rng.choice([0.1, 0.5, 0.5, 0.9, rng.random(), None])) for g in range(4) for a in range(12) for b in range(12) if rng.random() < 0.6}.values())
    # a chain in which each round settles one pair only
    rows += [(9, k, k, float(100 - 2 * k)) for k in range(4)] + [(9, k + 1, k, float(101 - 2 * k)) for k in range(4)]
    pairs = spark.createDataFrame(rows, "g long, a long, b long, score double")
    assert sorted(tuple(r) for r in matching.greedy(pairs, "g", "a", "b", "score").collect()) == greedy(rows)
    assert matching.greedy(pairs.limit(0), "g", "a", "b", "score").collect() == []


RECORDS = [
    ("h1", "Jane", "Doe", "University of X", "https://jane.doe.org/home"), ("h2", "Jim", "Doe", "Y", "https://sites.google.com/site/jim"), ("h3", "Bob", "Lee", "Massachusetts Institute of Technology", "http://a.edu/1"),
    ("h4", "Bob", "Lee", "University of Chicago", "http://b.edu/2"), ("h5", "Al", "Roe", "U1", "http://c.edu"), ("h6", "Al", "Roe", "U2", "http://d.edu"), ("h7", "No", "Page", "Z", None), ("h8", "Em", "Poe", "Z", ""), ("h9", "Jo", "Solo", "Z", "http://e.edu"),
]
PEOPLE = [
    (1, "J.", "DOE", None, ["https://JANE.doe.org/cv"], [("h1", "url_match", "unique")]),  # a domain of one's own and the last name
    (2, "Jim", "Doe", None, ["https://sites.google.com/site/JIM/"], [("h2", "url_match", "unique")]),  # a shared host: the whole address
    (3, "Jim", "Doe", None, ["https://sites.google.com/site/other"], [("h2", "exact_name", "unique")]),
    (4, "Jane", "Roe", None, ["https://jane.doe.org/cv"], []),  # another last name
    (5, " bob", "Lee ", "MIT", ["http://x.y"], [("h3", "exact_name", "affiliation_match")]),
    (6, "Bob", "Lee", "chicago", ["http://x.y"], [("h4", "exact_name", "affiliation_match")]),
    (7, "Bob", "Lee", None, ["http://x.y"], [("h3", "exact_name", "ambiguous"), ("h4", "exact_name", "ambiguous")]),
    (8, "Al", "Roe", "U", ["http://x.y"], [("h5", "exact_name", "ambiguous"), ("h6", "exact_name", "ambiguous")]),  # fits both
    (9, "No", "Page", None, ["http://x.y"], []), (10, "Em", "Poe", None, ["http://x.y"], []),
    (11, "Jo", "Solo", None, [], []), (12, "Jo", "Solo", None, None, []), (13, "Jo", "Solo", None, ["not an address", "http://e.edu/a", "http://e.edu/b"], [("h9", "url_match", "unique")]),
]


def test_linkage_tiers(spark):
    records = spark.createDataFrame(RECORDS, "handle string, first string, last string, workplace string, homepage string")
    people = spark.createDataFrame([p[:5] for p in PEOPLE], "id long, first string, last string, affiliation string, urls array<string>")
    got = sorted(tuple(r) for r in linkage.linked(people, records).collect())
    assert got == sorted((p[0], *m) for p in PEOPLE for m in p[5])
    assert linkage.linked(people, records.limit(0)).collect() == []


def test_a_name_that_many_have(spark, monkeypatch):
    met = spark.sparkContext.accumulator(0)

    def fits(a, w):
        met.add(1)
        return a == w

    monkeypatch.setattr(linkage, "same_workplace", lambda a, w: F.udf(fits, "boolean")(a, w))
    monkeypatch.setattr(linkage, "PAIRS", 64)
    records = spark.createDataFrame([(f"h{k:02}", "Al", "Roe", "only" if k == 7 else f"u{k % 2}", f"http://x.y/{k}") for k in range(60)], "handle string, first string, last string, workplace string, homepage string")
    people = spark.createDataFrame([(k, " AL", "roe", ["only", "u1", None][k % 3], ["http://p.q"]) for k in range(90)], "id long, first string, last string, affiliation string, urls array<string>")
    got = sorted(tuple(r) for r in linkage.linked(people, records).collect())
    assert got == sorted((k, f"h{h:02}", "exact_name", "ambiguous" if k % 3 else "affiliation_match") for k in range(90) for h in (range(60) if k % 3 else [7]))
    assert met.value <= 40  # not once for each of 5,400 pairs


def test_lookup_cascade(spark):
    known = spark.createDataFrame([(1, "Ann", "Roe", "A1"), (2, "ann", "roe", None), (3, "Bob", "Poe", "A3"), (4, "B.", "Lee", None), (5, "Bo", "Lee", None), (6, "Carl", "Lee", None)], "id long, first string, last string, identifier string")
    wanted = spark.createDataFrame([(1, "ANN", "Roe", "A3"), (2, "Zed", "Poe", "A3"), (3, "C.", "Lee", None), (4, "Bob", "Lee", None), (5, "Ben", "Lee", "A9"), (6, "New", "One", None), (7, "Bo", "Li", "")], "k long, first string, last string, identifier string")
    told = spark.createDataFrame([(5, 4), (6, None), (3, 1)], "k long, id long")
    got = sorted((tuple(r) for r in linkage.resolved(wanted, known, told).collect()), key=lambda r: r[0])
    # "Bob" isn't "Bo"; of the two, only the initial fits
    assert got == [(1, 1, "name"), (2, 3, "identifier"), (3, 6, "compatible"), (4, 4, "compatible"), (5, 4, "compatible"), (6, None, "new"), (7, None, "new")]


def test_names_of_a_cascade_meet_once(spark, monkeypatch):
    met = spark.sparkContext.accumulator(0)

    def fits(x, y):
        met.add(1)
        return x[0] == y[0] and (x == y or min(len(x), len(y)) == 2)

    monkeypatch.setattr(T, "compatible_names", lambda a, b: F.udf(fits, "boolean")(a, b))
    known = spark.createDataFrame([(k, ["Bo", "Bob", "Cy"][k % 3], "Lee", None) for k in range(300)] + [(1000, "Dan", "Lee", "A1")], "id long, first string, last string, identifier string")
    people = [(k, ["B.", "D.", "Al", None][k % 4], "lee", None) for k in range(400)]
    people += [(900, "D.", "lee", None)] * 2 + [(901, "Dan", "LEE", None)] * 2 + [(902, "Dan", "lee", "A1"), (902, "Xi", "Wu", "A1")]
    wanted = spark.createDataFrame(people, "k long, first string, last string, identifier string")
    got = sorted((tuple(r) for r in linkage.resolved(wanted, known, spark.createDataFrame([(2, 5)], "k long, id long")).collect()), key=lambda r: r[0])
    # as in SQL, two pairs of one k aren't the only one, and a k has one row of the first two tiers
    want = [(k, 1000, "compatible") if k % 4 == 1 else (2, 5, "told") if k == 2 else (k, None, "new") for k in range(400)]
    assert got == want + [(900, None, "new")] * 2 + [(901, 1000, "name"), (902, 1000, "name")]
    assert met.value <= 20


def test_pages_by_key_are_those_by_offset(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(60)]) if k % 9 == 0 else rng.randrange(60), k) for k in range(1500)]
    folder = str(tmp_path / "pages")
    pages.cluster(spark.createDataFrame(rows, "at long, id long"), "at", "id", folder, 16)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    after, seen = None, []
    for k in range(0, 1500, 250):
        found = pages.page(spark, folder, "at", "id", 250, after)
        plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        filters = re.search(r"PartitionFilters: \[range#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
        assert filters is None or filters[1] is None or len(filters[1].split(",")) <= 8  # whatever the page
        own = [tuple(r) for r in found.collect()]
        assert own == order[k : k + 250]
        seen += own
        after = own[-1]
    assert pages.page(spark, folder, "at", "id", 5, after).collect() == [] and len(seen) == 1500


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(6)
    words = ["the", "license", "a1", "growth", "Été", "x", "of_y", "Trade", "co-op", "ab", "common"]
    rows = [(rng.choice([k, k + 70_000, -k, 10**12 + k]), " ".join(["common"] + [rng.choice(words) for _ in range(rng.randrange(6))]) + rng.choice([".", "", '"'])) for k in range(1, 400)]
    rows += [(None, "license"), (5_000_000, None), (5_000_001, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    folder = str(tmp_path / "index")
    fulltext.build(docs, folder)
    for query in ("license", "+growth -trade", "été", "the of", "op common", '"license" (of_y)', "missing", "common"):
        asked = {w for w in re.findall(r"\w+", query.lower()) if len(w) >= 3 and w not in V.INDEX_STOPWORDS}
        assert set(fulltext.parse(query)) == asked
        got = [r.id for r in fulltext.search(spark, folder, query).collect()]
        assert sorted(got) == sorted({i for i, t in rows if i is not None and asked & set(re.findall(r"\w+", (t or "").lower()))})
    assert sorted(r.id for r in fulltext.search(spark, folder, "+A1*", docs).collect()) == sorted(i for i, t in rows if "a1" in (t or "").lower())
    assert fulltext.search(spark, folder, "+-*", docs).collect() == [] == fulltext.search(spark, folder, "ab").collect()
    # a search opens its words' folders only
    read = fulltext.postings(spark, folder, ["license"]).selectExpr("input_file_name() as f")
    plan = read._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan) and "EqualTo(term,license)" in plan.replace("In(term, [license])", "EqualTo(term,license)")


def test_first_whole_object(spark):
    cases = [
        ('x {"a": 1} {"b": 2}', '{"a": 1}'), ('{"a": {"b": {}}, "c": [{}]} tail }', '{"a": {"b": {}}, "c": [{}]}'), ('```json\n{"a": "}{"}\n```', '{"a": "}{"}'), (r'{"a": "\"}", "b": "\\"} rest', r'{"a": "\"}", "b": "\\"}'),
        ('{"a": {"b": 1}', None), ("none", None), ("", None), (None, None), ('{"a": "open}', None), ("}{}", "{}"), ('{"a": "' + "x" * 100_000 + '"}', '{"a": "' + "x" * 100_000 + '"}'),
    ]
    got = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, c string").select("k", T.first_object(F.col("c")).alias("o")).orderBy("k").collect()
    assert [r.o for r in got] == [o for _, o in cases]


def test_marks_of_distinct_papers(spark):
    cases = [("a b c", "a b c", False), ("trade part ii", "trade", True), ("trade 2", "trade", True), ("trade in 1990s", "trade in the", True), ("trade abroad", "trade", False), ("a reply to b", "a comment to b", True), ("parting", "part", True), ("civic", "", False), ("", "", False)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    got = rows.select("k", T.distinct_markers(F.col("a"), F.col("b")).alias("d")).orderBy("k").collect()
    assert [r.d for r in got] == [d for _, _, d in cases]


@pytest.mark.parametrize("parts", ["1", "9"])
def test_pareto_over_ranges(spark, parts):
    rng = random.Random(7)
    rows = [(k, rng.randrange(40), rng.choice([None, *range(60)])) for k in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted(r.k for r in R.pareto(spark.createDataFrame(rows, "k long, cost int, score int"), "cost", "score", "k").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, best = [], None
    for k, _, score in sorted(rows, key=lambda r: (r[1], r[2] is None, -(r[2] or 0), r[0])):
        if best is None or (score is not None and score > best):
            want.append(k)
            best = score if score is not None else best
    assert got == sorted(want)


def test_titles_alike_against_all_pairs(spark):
    rng = random.Random(4)
    texts = lambda n: [sorted(rng.sample("abcdefgh", rng.randrange(9))) for _ in range(n)]
    rows = [(k, texts(n)) for k, n in enumerate([0, 1, 2, 30, 7, 400])] + [(6, None), (7, [[]] * 3), (8, [["a"]] * 500)]
    got = sorted(tuple(r) for r in matching.alike(spark.createDataFrame(rows, "page long, w array<array<string>>").repartition(2), "page", "w", 0.5).collect())
    want = []
    for page, sets in rows:
        sets = [set(w) for w in sets or []]
        want += [(page, i, j, len(a & b) / len(a | b)) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 2 * len(a & b) >= len(a | b) > 0]
    assert got == sorted(want)


@pytest.mark.parametrize("in_order", [0, 5, 1 << 22])
def test_equal_scores_need_no_rounds(spark, in_order, monkeypatch):
    written = []
    monkeypatch.setattr(matching, "written", lambda df, f=matching.written: written.append(1) or f(df))
    n = 4 if in_order < 9 else 60
    rows = [(1, a, b, 1.0) for b in range(n) for a in range(b)] + [(2, 0, 1, 0.5), (None, 0, 1, 0.5)]
    got = matching.greedy(spark.createDataFrame(rows, "g long, a long, b long, score double"), "g", "a", "b", "score", in_order)
    assert sorted(tuple(r) for r in got.collect()) == greedy([r for r in rows if r[0]])
    assert in_order < 9 or len(written) == 2  # a round for each of the 59 pairs before
