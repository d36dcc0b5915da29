"""Links of pages: the titles they stand for, and the papers that these name."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions import values as V
from quillstream.operators import identity as I
from quillstream.operators import links as L
from quillstream.plans.common import Plans

P = Plans()

TITLE_SQL = "p_name || ' ' || lower(p_type) || ' study ' || p_partkey"
#: A paper's entry on a page, by its key's rest: the html, and the title that its trusted link stands for (null: it has none).
ENTRIES = (
    ("<li><a href=\"{u}\">{t}</a></li>", "{t}"),
    ("<p><a href=\"/local.pdf\"><strong>{t}</strong></a> <em>and</em> <a href=\"{u}\"><br></a></p>", "{t}"),
    ("<td><a href=\"{u}\">SSRN Version</a> | <a href=\"/t\">{t}</a></td>", "{t}"),
    ("<p>{t} (with J. Doe) [ <a href=\"{u}\">SSRN Version</a> ]</p>", "{t}"),
    ("<p><a href=\"{u}\">&quot;</a></p><p><a href=\"{u}\">{t}</a> in print</p>", "{t}"),
    ("<li>{t} with Ann Lee [PDF: <a href=\"{u}\">pdf</a>]</li>", "{t}"),
    ("<div><a href=\"{u}\">PDF</a></div>", "PDF"),
    ("<p><a href=\"/x\">Another title of mine</a><div>x</div><a href=\"{u}\">Draft</a></p>", "Another title of mine x Draft"),
    ("<nav><a href=\"{u}\">{t}</a></nav><a href=\"https://twitter.com/x\">{t}</a>", None),
)
#: The entry of the seventh kind has a DOI; others a number.
URL_SQL = "case when p_partkey % 9 = 6 then 'https://doi.org/10.1000/x' || p_partkey when p_size % 2 = 1 then 'https://ssrn.com/abstract=' || p_partkey else 'https://www.nber.org/papers/w' || p_partkey end"
TYPE_SQL = "case when p_partkey % 9 = 6 then 'doi' when p_size % 2 = 1 then 'ssrn' else 'nber' end"


def _said(form: str, title: str) -> str:
    return "'" + form.replace("{t}", f"' || {title} || '").replace("{u}", "' || u || '") + "'"


NAMED_SQL = f"""
    select replace(p_brand, 'Brand#', '')::bigint as page, {URL_SQL} as url,
        case p_partkey % 9 {' '.join(f"when {k} then {_said(title, TITLE_SQL)}" for k, (_, title) in enumerate(ENTRIES) if title)} end as title, {TYPE_SQL} as type
    from part where p_partkey % 9 <> 8
"""


def _parts(t):
    return t("part").select("p_partkey", "p_brand", F.expr("cast(replace(p_brand, 'Brand#', '') as bigint)").alias("page"), F.expr(TITLE_SQL).alias("t"), F.expr(URL_SQL).alias("u"))


def _pages(t):
    """A page for each brand, with an entry for each of its parts."""
    k = F.col("p_partkey") % len(ENTRIES)
    entry = F.lit(None)
    for n, (form, _) in enumerate(ENTRIES):
        entry = F.when(k == n, F.expr(_said(form, "t"))).otherwise(entry)
    listed = _parts(t).select("page", "p_brand", "p_partkey", entry.alias("entry")).groupBy("page", "p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "entry"))).alias("all"))
    body = F.array_join(F.transform("all", lambda e: e["entry"]), "\n")
    return listed.select("page", F.col("p_brand").alias("owner"), F.concat(F.lit("<html><body><script>var a='<p>';</script>"), body, F.lit("</body></html>")).alias("html"))


@P.add("html_3_link_titles", NAMED_SQL)
def _(t):
    return L.named_links(_pages(t))


#: Texts of blocks and the titles they begin with.
BLOCKS = (
    ("{t} [ Abstract | PDF ]", "{t}"), ("{t} (with A. B.), forthcoming", "{t}"), ("{t}. ", "{t}"), ("Short [PDF]", "Short [PDF]"), ("{t} with Carl", "{t}"),
    ("Work with {t}", "Work with {t}"), ("tiny", ""), ("{t} [SSRN] [ Draft ]", "{t} [SSRN]"), ("Notes (with X) on {t}; [Link]", "Notes (with X) on {t}"), ("{t},: [NBER] (with Y)", "{t}"),
)


@P.add("html_6_block_titles", f"select p_partkey, case p_partkey % 10 {' '.join(f'when {k} then {_said(title, TITLE_SQL)}' for k, (_, title) in enumerate(BLOCKS))} end as title from part")
def _(t):
    k, block = F.col("p_partkey") % len(BLOCKS), F.lit(None)
    for n, (form, _) in enumerate(BLOCKS):
        block = F.when(k == n, F.expr(_said(form, "t"))).otherwise(block)
    return _parts(t).select("p_partkey", L.block_title(block).alias("title"))


ANCHOR_SQL = "case p_partkey % 5 when 0 then 'Working  Paper' when 1 then p_name || '.pdf' when 2 then p_name when 3 then p_name || ' ' || p_type else 'pdf' end"


@P.add("arr_5_best_anchor", f"""
    with a as (select p_brand, p_size, p_partkey, {ANCHOR_SQL} as title from part), g as (select *, p_partkey % 5 in (0, 1, 4) or length(title) < 5 as generic from a)
    select p_brand, p_size, first(title order by generic, length(title) desc, p_partkey) as title from g group by p_brand, p_size
""")
def _(t):
    anchors = t("part").select("p_brand", "p_size", "p_partkey", F.expr(ANCHOR_SQL).alias("title"), F.lit("nber").alias("type"))
    return L.best_anchors(anchors, ["p_brand", "p_size"], "p_partkey").drop("type")


PAPERS_SQL = f"select p_partkey as paper, p_brand as owner, {TITLE_SQL} as title, case when p_partkey % 18 = 6 then '10.1000/x' || p_partkey end as doi from part"


@P.add("enr_8_link_backfill", f"""
    with links as ({NAMED_SQL}), papers as ({PAPERS_SQL})
    select l.page, l.url, coalesce(a.paper, d.paper) as paper, case when a.paper is not null then 'title' else 'doi' end as tier, l.type
    from links l left join papers a on a.title = l.title left join papers d on l.url = 'https://doi.org/' || d.doi
    where l.page % 2 = 1 and (a.paper is not null or d.paper is not null)
""")
def _(t):
    pages = _pages(t)
    papers = t("part").select(F.col("p_partkey").alias("paper"), F.col("p_brand").alias("owner"), F.expr(TITLE_SQL).alias("title"), F.expr("case when p_partkey % 18 = 6 then '10.1000/x' || p_partkey end").alias("doi"))
    return L.backfill(pages, pages.where("page % 2 = 0").select("page"), papers)


#: Anchors of every kind: the title, a label, the title in the plural, in other order, with a word changed, of its own.
ANCHORS_SQL = """case p_partkey % 6 when 0 then upper(p_name || ' study of ' || p_type) when 1 then 'PDF' when 2 then p_name || ' study of ' || lower(p_type) || 's'
    when 3 then lower(p_type) || ': a study, ' || p_name when 4 then p_name || ' survey of ' || lower(p_type) else 'slides of talks' end"""
TIER_TITLE_SQL = "p_name || ' study of ' || lower(p_type)"
_STOP = ", ".join(f"'{w}'" for w in V.LINK_STOPWORDS)
_WORDS_SQL = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9_]+'), lambda w: length(w) > 1 and w not in ({1})))"


@P.add("enr_3_link_tiers", f"""
    with papers as (select p_partkey as paper, p_brand as owner, {TIER_TITLE_SQL} as title, case when p_partkey % 4 = 1 then '10.1000/' || p_partkey end as doi from part),
    links as (select p_partkey as link, p_brand as owner, {ANCHORS_SQL} as anchor, case when p_partkey % 8 = 1 then '10.1000/' || p_partkey end as doi from part),
    one as (select link, min(paper) as paper, 'title' as tier from links join papers on lower(anchor) = title group by link),
    two as (select link, min(paper) as paper, 'doi' as tier from links join papers on links.doi = papers.doi where link not in (select link from one) group by link),
    near as (select link, paper, {_WORDS_SQL.format('anchor', _STOP)} as x, {_WORDS_SQL.format('title', _STOP)} as y, regexp_replace(lower(anchor), '[^a-z0-9]', '', 'g') as a, regexp_replace(title, '[^a-z0-9]', '', 'g') as b
        from links join papers using (owner) where length(anchor) >= 5 and link not in (select link from one) and link not in (select link from two)),
    s as (select link, paper, case when length(a) < 5 then 0.0 when (contains(a, b) or contains(b, a)) and least(length(a), length(b)) / greatest(length(a), length(b)) > 0.75 then 1.0
        when len(x) >= 2 and len(y) >= 2 then len(list_intersect(x, y)) / greatest(len(x), len(y)) else 0.0 end as score from near)
    select * from one union all select * from two union all select link, first(paper order by score desc, paper) as paper, 'anchor' as tier from s where score >= 0.75 group by link
""")
def _(t):
    k = F.col("p_partkey")
    doi = F.concat(F.lit("10.1000/"), k)
    papers = t("part").select(k.alias("paper"), F.col("p_brand").alias("owner"), F.expr(TIER_TITLE_SQL).alias("title"), F.when(k % 4 == 1, doi).alias("doi"))
    links = t("part").select(k.alias("link"), F.col("p_brand").alias("owner"), F.expr(ANCHORS_SQL).alias("anchor"), F.when(k % 8 == 1, doi).alias("doi"))
    return I.link_tiers(links, papers)


#: A page's address by its number's rest, with the marks of the links below that are its research pages.
BASES = (("https://www.jane-doe.com/", "abdek"), ("https://econ.uni.edu/people/jd", "bde"), ("https://sites.google.com/view/jd/home", "bh"), ("https://econ.uni.edu/~jd/", "abdek"))
#: Links, their texts, and where they lead from each of the addresses.
TARGETS = {
    "a": ("/research", "x", ("https://www.jane-doe.com/research", None, None, "https://econ.uni.edu/research")),
    "b": ("papers.html", "x", ("https://www.jane-doe.com/papers.html", "https://econ.uni.edu/people/papers.html", "https://sites.google.com/view/jd/papers.html", "https://econ.uni.edu/~jd/papers.html")),
    "c": ("https://other.org/research", "Research", ()),
    "d": ("/people/jd/working-papers/", "wp", ("https://www.jane-doe.com/people/jd/working-papers", "https://econ.uni.edu/people/jd/working-papers", None, "https://econ.uni.edu/people/jd/working-papers")),
    "e": ("/people/other/./research", "x", ("https://www.jane-doe.com/people/other/research", "https://econ.uni.edu/people/other/research", None, "https://econ.uni.edu/people/other/research")),
    "f": ("#research", "Research", ()), "g": ("/research/paper.pdf", "Papers", ()), "h": ("https://sites.google.com/view/jd/publications", "x", (None, None, "https://sites.google.com/view/jd/publications", None)),
    "i": ("https://sites.google.com/view/other/publications", "x", ()), "j": ("/a/b/c/d/e", "Papers", ()), "k": ("/cv", " My  Papers ", ("https://www.jane-doe.com/cv", None, None, "https://econ.uni.edu/cv")),
    "l": ("/research?x=1#y", "Research", ()), "m": ("mailto:research@x.org", "Research", ()), "n": ("/news", "the news", ()), "o": ("", "Research", ()),
}
_TO_SQL = ", ".join("[" + ", ".join(f"'{TARGETS[m][2][k]}'" for m in marks) + "]" for k, (_, marks) in enumerate(BASES))


@P.add("url_15_research_links", f"select page_id as page, unnest([{_TO_SQL}][page_id % {len(BASES)} + 1]) as to from pages")
def _(t):
    """Each page of the table at an address of its own kind, with the same links after its own html."""
    k = (F.col("page_id") % len(BASES)).cast("int")
    base = F.get(F.array(*(F.lit(b) for b, _ in BASES)), k)
    own = F.concat(F.lit("<p><a href='"), base, F.lit("'>Research</a>"), *(F.lit(f'<li><a href="{href}">{text}</a></li>') for href, text, _ in TARGETS.values()))
    return L.research_links(t("pages").select(F.col("page_id").alias("page"), base.alias("url"), own.alias("html")))
