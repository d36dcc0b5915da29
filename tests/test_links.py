"""Links of pages and their titles: each rule, and whole results of the joins against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstream.functions import urls as W
from quillstream.functions import values as V
from quillstream.operators import links as L
from quillstream.operators.identity import link_tiers

LONG = "Incomplete Take-Up of Insurance Benefits"
U = "https://ssrn.com/abstract=99"

CASES = [
    ('<div><a href="https://ssrn.com/1">Paper Title</a></div>', [("https://ssrn.com/1", "Paper Title", "ssrn")]),
    ('<div><a href="https://twitter.com/x">T</a><a href="https://ssrn.com/1">S</a></div>', [("https://ssrn.com/1", "S", "ssrn")]),
    ('<a href="https://www.sciencedirect.com/topics/economics/x">topic</a><a href="https://www.sciencedirect.com/science/article/pii/S1">article</a>', [("https://www.sciencedirect.com/science/article/pii/S1", "article", "journal")]),
    ('<nav><a href="https://ssrn.com/1">X</a></nav><div><a href="https://ssrn.com/2">Yes it is</a></div>', [("https://ssrn.com/2", "Yes it is", "ssrn")]),
    (f'<a href="{U}">"</a><i>x</i><b><a href="{U}">My Great Paper Title</a></b>', [(U, "My Great Paper Title", "ssrn")]),
    (f'<p><a href="/l.pdf"><strong>Paper Title Here</strong></a><a href="{U}"><br></a></p>', [(U, "Paper Title Here", "ssrn")]),
    # through text, comments and inline elements, whatever is inside them, but not through others
    (f'<p><a href="/l.pdf">Paper Title Here</a> , <!-- c --><em>by <a href="/x">An Inner Link Text</a></em><img src=x> <a href="{U}">PDF</a></p>', [(U, "Paper Title Here", "ssrn")]),
    (f'<p><a href="/l.pdf">Paper Title Here</a><div>x</div><a href="{U}">PDF</a></p>', [(U, "Paper Title Here x PDF", "ssrn")]),
    (f'<p><a href="/l.pdf">Paper Title Here</a><script>var a = "<a>"</script><a href="{U}">PDF</a></p>', [(U, "Paper Title Here", "ssrn")]),
    # the nearest link before decides on that side, even if it is a label; then the one after
    (f'<p><a href="/1">First Title of All</a><a href="/2">Slides</a><a href="{U}">PDF</a><a href="/3">Title That Follows</a></p>', [(U, "Title That Follows", "ssrn")]),
    (f'<p>{LONG} (with J. Doe) [ <a href="{U}">SSRN Version</a> ]</p>', [(U, LONG, "ssrn")]),
    (f'<li>x<p>{LONG}, <a href="{U}">paper.PDF</a></p> tail</li>', [(U, f"{LONG}, paper.PDF", "ssrn")]),
    (f'<td>A &amp; B<br>of C [PDF <a href="{U}">PDF</a>]', [(U, "PDF", "ssrn")]),
    (f'<td>Theory of A &amp; B<br>of C [PDF <a href="{U}">PDF</a>]', [(U, "Theory of A & B of C", "ssrn")]),
    (f'<a href="{U}">PDF</a> none </p> here <p>', [(U, "PDF", "ssrn")]),
    (f'<p><a href="{U}">PDF</a><p><a href="{U}">Draft</a>', [(U, "Draft", "ssrn")]),
    (f'<p>short <a href="{U}">Sp<span> a </span>ced</a></p>', [(U, "Spaced", "ssrn")]),
    ("", []), (None, []), ("<a>no</a><a href=x>y</a><a href='https://'>z</a>", []),
]


def test_titles_of_links(spark):
    pages = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(CASES)], "page long, html string").repartition(3)
    got = sorted(tuple(r) for r in L.named_links(pages).collect())
    assert got == sorted((k, *row) for k, (_, rows) in enumerate(CASES) for row in rows)


def test_a_page_of_very_many_links(spark):
    html = "<p>" + "".join(f'<a href="https://ssrn.com/{k}">PDF</a>' for k in range(3000)) + "</p>"
    deep = "<p><b>" * 400 + f'<a href="{U}">PDF</a>'
    pages = spark.createDataFrame([(1, html), (2, deep)], "page long, html string")
    assert L.named_links(pages).groupBy("page").count().orderBy("page").collect() == [(1, 3000), (2, 1)]


def alnum(s):
    return re.sub("[^a-z0-9]", "", s.lower())


def meant(s):
    return {w for w in re.findall(r"[a-z0-9_]+", s.lower()) if len(w) > 1 and w not in V.LINK_STOPWORDS}


def best(anchor, titles, least):
    """The title that an anchor names, from the rule: each title is tried."""
    a, found = alnum(anchor), []
    if len(anchor.strip()) < 5 or len(a) < 5:
        return None
    for paper, title in titles:
        t = alnum(title)
        x, y = meant(anchor), meant(title)
        if t and (t in a or a in t) and min(len(a), len(t)) / max(len(a), len(t)) > 0.75:
            found.append((1.0, -paper))
        elif t and len(x) >= 2 and len(y) >= 2 and (score := min(len(x & y) / len(x), len(x & y) / len(y))) >= least:
            found.append((score, -paper))
    return (-max(found)[1], max(found)[0]) if found else None


@pytest.mark.parametrize("least", [0.75, 0.5])
def test_titled_against_all_pairs(spark, least):
    rng = random.Random(11)
    words = "trade wage firm the of and growth tax school a1 b2 é it".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 8)))
    titles = [(k, rng.choice("xy"), text()) for k in range(150)]
    anchors = []
    for k in range(200):
        base = rng.choice(titles)[2]
        anchors.append((k, rng.choice("xyz"), rng.choice([base, base.replace(" ", ""), base + "s!", base.upper() + " tax", " ".join(reversed(base.split())), text(), base[:9]])))
    links = spark.createDataFrame(anchors, "link long, owner string, anchor string")
    papers = spark.createDataFrame(titles, "paper long, owner string, title string")
    plain = lambda s: s.lower().replace("é", "e")
    got = sorted(tuple(r) for r in L.titled(links, papers, least).collect())
    assert got == sorted((k, *b) for k, owner, a in anchors if (b := best(plain(a), [(p, plain(t)) for p, o, t in titles if o == owner], least)))
    assert 50 < len(got) < 200
    assert L.titled(links.limit(0), papers, least).collect() == [] == L.titled(links, papers.limit(0), least).collect()


def test_texts_of_one_form_meet_once(spark, monkeypatch):
    met = {}
    for name in ("contained", "shared_words"):
        monkeypatch.setattr(L, name, lambda links, titles, *rest, f=getattr(L, name), name=name: met.setdefault(name, (links.count(), titles.count())) and f(links, titles, *rest))
    forms = ["trade and wage growth", "Trade and  WAGE growth!", "tax of the school"]
    links = spark.createDataFrame([(k, "xyz"[k % 3], forms[k % 3] + " s") for k in range(90)] + [(90, "x", forms[0])] * 2, "link long, owner string, anchor string")
    papers = spark.createDataFrame([(200 - k, "xyu"[k // 3 % 3], forms[k % 3]) for k in range(90)], "paper long, owner string, title string")
    got = sorted((r.link, r.paper, r.score) for r in L.titled(links, papers).collect())
    x, y = (min(200 - k for k in range(90) if k // 3 % 3 == o and k % 3 < 2) for o in (0, 1))
    assert got == sorted([(k, (x, y)[k % 3], 1.0) for k in range(90) if k % 3 < 2] + [(90, x, 1.0)])
    assert met == {"contained": (4, 4), "shared_words": (4, 4)}


def test_tiers_of_links(spark):
    papers = spark.createDataFrame([(5, "a", LONG, None), (4, "b", LONG.upper(), "10.1/x"), (3, "a", "Another long title here", "10.1/x"), (9, "a", LONG + " now", None)], "paper long, owner string, title string, doi string")
    links = spark.createDataFrame([(1, "a", LONG.lower(), "10.1/x"), (2, "a", "PDF", "10.1/x"), (3, "a", LONG + " 's", None), (4, "c", LONG + " 's", None), (5, "a", "PDF", None), (6, "a", None, None)], "link long, owner string, anchor string, doi string")
    assert sorted(tuple(r) for r in link_tiers(links, papers).collect()) == [(1, 4, "title"), (2, 3, "doi"), (3, 5, "anchor")]


def test_backfill_leaves_saved_pages_alone(spark):
    html, cited = (f'<p><a href="{u}">{LONG}</a></p>' for u in (U, "https://papers.ssrn.com/sol3/papers.cfm?abstract_id=99"))
    pages = spark.createDataFrame([(1, "a", html), (2, "a", html), (3, "b", cited), (4, "a", None), (5, "b", html)], "page long, owner string, html string")
    saved = spark.createDataFrame([(2,), (2,)], "page long")
    papers = spark.createDataFrame([(7, "a", LONG + " now", None), (8, "b", "Something else entirely here", "10.2139/ssrn.99")], "paper long, owner string, title string, doi string")
    got = sorted((r.page, r.paper, r.tier, r.type) for r in L.backfill(pages, saved, papers).collect())
    assert got == [(1, 7, "anchor", "ssrn"), (3, 8, "doi", "ssrn")]


def test_plans_of_backfill_stay_small(spark):
    pages = spark.createDataFrame([(1, "a", f'<p><a href="{U}">{LONG}</a></p>')], "page long, owner string, html string")
    papers = spark.createDataFrame([(7, "a", LONG + " now", None)], "paper long, owner string, title string, doi string")
    plan = L.backfill(pages, pages.select("page").limit(0), papers)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join ") <= 5  # 58 when each tier planned all that is before it
    assert plan.count("Generate ") == 0


def test_references_are_resolved_as_the_library_does(spark):
    from urllib.parse import urljoin

    rng = random.Random(5)
    bases = ["http://a.org", "http://a.org/", "https://a.org/b/c/d?q=1#f", "http://a.org/b/", "http://a.org/x//y/z", "HTTP://A.org/b"]
    refs = ["", "x", "/x/y", "../x", "../../../../x", "./", ".", "..", "a/./b/../c", "?r=2", "#g", "//h.net/p", "//h.net", "https://k.de/x?y#z", "mailto:a@b.c", "x?", "y#", "/", "a//b", "../", "x/..", "javascript:void(0)"]
    refs += ["/".join(rng.choice(["..", ".", "a", "b", ""]) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    pairs = [(k, b, r) for k, (b, r) in enumerate((b, r) for b in bases for r in refs)]
    rows = spark.createDataFrame(pairs, "k int, b string, r string")
    got = {r.k: r.u for r in rows.select("k", W.absolute(F.col("b"), F.col("r")).alias("u")).collect()}
    assert {k: got[k] for k, _, _ in pairs} == {k: urljoin(b, r) for k, b, r in pairs}
