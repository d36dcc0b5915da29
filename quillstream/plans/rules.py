"""Rules over publications: which are real, which changes count, what calls cost, presets of lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import udfs as U
from quillstream.functions import values as V
from quillstream.operators import quality as Q
from quillstream.operators import rows as R
from quillstream.plans.common import Plans

P = Plans()

_STATUS_SQL = f"{list(V.STATUS_ORDER)}[(l_orderkey * 3 + l_linenumber) % 8 + 1]"
_RANK_SQL = f"coalesce(list_position({list(V.STATUS_ORDER)}, status), 0)"


@P.add("win_8_transitions", f"""
    with s as (select l_partkey as paper, l_shipdate as day, l_orderkey, l_linenumber, l_suppkey, {_STATUS_SQL} as status, ['2020', '2013', 'n.d.', null, '2014', ' 2001'][l_partkey % 6 + 1] as year from lineitem),
    r as (select *, {_RANK_SQL} as rank from s),
    b as (select *, max(rank) over (partition by paper order by day, l_orderkey, l_linenumber, l_suppkey rows between unbounded preceding and 1 preceding) as before from r),
    o as (select *, {list(V.STATUS_ORDER)}[before] as old from b where before > 0 and rank > before)
    select paper, l_orderkey, l_linenumber, l_suppkey, old, status as new from o
    where (old, status) in ({', '.join(f"('{a}', '{b}')" for a, b in V.TRANSITIONS)}) and not (regexp_full_match(coalesce(year, ''), '[0-9]+') and 2024 - try_cast(year as int) > {V.STALE_YEARS})
""")
def _(t):
    """Status changes worth an event: of the eight kinds, and of papers that aren't ten years old."""
    order = F.array(*map(F.lit, V.STATUS_ORDER))
    at = ((F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 8).cast("int")
    years = F.array(*map(F.lit, ("2020", "2013", "n.d.", None, "2014", " 2001")))
    rows = t("lineitem").select(F.col("l_partkey").alias("paper"), F.col("l_shipdate").alias("at"), "l_orderkey", "l_linenumber", "l_suppkey", F.get(order, at).alias("status"), F.get(years, (F.col("l_partkey") % 6).cast("int")).alias("year"))
    found = R.status_changes(rows, ["paper"], F.col("status"), F.col("year"), 2024, "at", "l_orderkey", "l_linenumber", "l_suppkey")
    return found.select("paper", "l_orderkey", "l_linenumber", "l_suppkey", "old", "new")


def _pub(title="A Study of Trade", authors=(("Ann", "Roe"), ("Bob", "Lee")), venue=None, status=None, url=None):
    return title, authors, venue, status, url


#: Publications, and whether they are real.
PUBLICATIONS = (
    (_pub(), True), (_pub("Abc"), False), (_pub("Abc", venue="AER"), True), (_pub("Abc", status="accepted"), True), (_pub("Teaching."), False), (_pub("Teaching Trade"), True),
    (_pub("Currently, I am at work"), False), (_pub("© 2024 the author"), False), (_pub(" (C) 2024 someone"), False), (_pub(authors=((" ", "Roe"),)), False), (_pub(authors=(("Ann", "R."),)), False),
    (_pub(authors=(("Ann", "Li"),)), True), (_pub(authors=()), True), (_pub(authors=(("Madonna",),)), True), (_pub(venue="GitHub repository"), False), (_pub(url="https://github.com/a/b"), False),
    (_pub(url="https://a.github.io/p.pdf"), True), (_pub(url="https://github.com/x?to=a.github.io"), True), (_pub("An R package for trade"), False),
    (_pub("Roe and Lee on Trade"), False), (_pub("Roe on trade"), True), (_pub("The Lee-Roe debate"), True), (_pub("No and the", authors=(("A", "No"), ("B", "The"))), True), (_pub("A 1 b study", authors=(("Xi", "9"), ("Yo", "8"))), False), (_pub(""), False),
)


@P.add("flt_14_garbage_rules", f"select o_orderkey, [{', '.join(str(ok).lower() for _, ok in PUBLICATIONS)}][o_orderkey % {len(PUBLICATIONS)} + 1] as ok from orders")
def _(t):
    """Publications of every kind, one an order."""
    kinds = F.array(*(
        F.struct(F.lit(title).alias("title"), F.array(*(F.array(*map(F.lit, a)) for a in authors)).cast("array<array<string>>").alias("authors"), *(F.lit(x).cast("string").alias(c) for c, x in (("venue", venue), ("status", status), ("url", url))))
        for (title, authors, venue, status, url), _ in PUBLICATIONS
    ))
    pub = F.get(kinds, (F.col("o_orderkey") % len(PUBLICATIONS)).cast("int"))
    rows = t("orders").select("o_orderkey", pub.alias("p"))
    return rows.select("o_orderkey", Q.real_publication(*(F.col(f"p.{c}") for c in ("title", "authors", "venue", "status", "url"))).alias("ok"))


@P.add("flt_14_text_rules", r"""
    select doc_id, length(trim(text)) >= 5 and not regexp_matches(lower(text), 'no publications|powered by|welcome to my|i am a |i am an |i will be on the job market|my research interests|site last updated|academic webpage|currently, i am')
        and not starts_with(lower(trim(text)), '©') and not starts_with(lower(trim(text)), '(c)') and not regexp_matches(lower(text), 'python package|r package|npm package|pip install|github repository|code repository|open source software')
        and rtrim(lower(trim(text)), '.') not in ('cv', 'feed', 'email', 'follow', 'sitemap', 'teaching', 'publications', 'papers', 'research', 'home', 'contact', 'about', 'links', 'news', 'jmp', 'bio', 'vita') as ok
    from documents where text is not null
""")
def _(t):
    none = F.lit(None).cast("string")
    ok = Q.real_publication(F.col("text"), F.array().cast("array<array<string>>"), none, none, none)
    return t("documents").where("text is not null").select("doc_id", ok.alias("ok"))


USAGE_SQL = "select o_orderkey as call, 'm' || (o_custkey % 10) as model, o_orderkey as prompt, o_custkey as completion, o_orderkey % 2 = 0 as batch from orders"
PRICES_SQL = "select 'm' || n_nationkey as model, n_nationkey * 0.1::double as in_price, n_regionkey * 0.4::double as out_price from nation where n_nationkey < 7"


@P.add("math_1_cost", f"""
    select call, (prompt * in_price / 1e6::double + completion * out_price / 1e6::double) * (case when batch then 0.5::double else 1.0::double end) as cost from ({USAGE_SQL}) left join ({PRICES_SQL}) using (model)
""")
def _(t):
    """SRC-14, MATH-1: calls priced by a table of models; of unknown models null."""
    usage = t("orders").select(F.col("o_orderkey").alias("call"), F.concat(F.lit("m"), F.col("o_custkey") % 10).alias("model"), F.col("o_orderkey").alias("prompt"), F.col("o_custkey").alias("completion"), (F.col("o_orderkey") % 2 == 0).alias("batch"))
    prices = t("nation").where("n_nationkey < 7").select(F.concat(F.lit("m"), "n_nationkey").alias("model"), (F.col("n_nationkey") * 0.1).alias("in_price"), (F.col("n_regionkey") * 0.4).alias("out_price"))
    return R.priced(usage, prices).select("call", "cost")


@P.add("math_3_rounded", "select o_custkey, ceil(count(*) / 20.0)::bigint as pages, round_even(count(*) / 4.0::double, 1)::double as share from orders group by o_custkey")
def _(t):
    """Pages are rounded up, shares to one decimal, halves to the even one."""
    n = F.count("*")
    return t("orders").groupBy("o_custkey").agg(F.ceil(n / 20.0).alias("pages"), F.bround(n / 4.0, 1).alias("share"))


_AFFILIATIONS = ("Dept of Economics, MIT", "university of chicago booth", "Ducal Academy", "Duke Kunshan", "Cornell", "Open University", "uc san diego", "NYU Stern", "Colombia")
_IN_TOP = (True, True, False, True, True, False, True, True, False)


@P.add("flt_5_departments", f"select c_custkey from customer where [{', '.join(str(x).lower() for x in _IN_TOP)}][c_custkey % {len(_IN_TOP)} + 1]")
def _(t):
    """People of a preset's departments."""
    where = F.get(F.array(*map(F.lit, _AFFILIATIONS)), (F.col("c_custkey") % len(_AFFILIATIONS)).cast("int"))
    return t("customer").where(T.contains_any(where, V.DEPARTMENTS)).select("c_custkey")


_VENUES = ("American Economic Review", "aer", "European Journal of Political Economy", "Journal of Political Economy (forthcoming)", "Econometrica", "Journal of Trade", None, "The Review of Economic Studies")
_TOP_VENUE = (True, True, False, True, True, False, False, True)


@P.add("flt_6_top_journals", f"select o_orderkey from orders where [{', '.join(str(x).lower() for x in _TOP_VENUE)}][o_orderkey % {len(_TOP_VENUE)} + 1]")
def _(t):
    """Papers in a preset's journals, without those that only look like one."""
    venue = F.get(F.array(*map(F.lit, _VENUES)), (F.col("o_orderkey") % len(_VENUES)).cast("int"))
    return t("orders").where(T.contains_any(venue, V.TOP5_JOURNALS) & ~T.contains_any(venue, V.TOP5_EXCLUDED)).select("o_orderkey")


@P.add("evt_9_verified_titles")
def _(t):
    """Changes told of pages: removals pass, others if they are publications whose title is on the page.

    The titles are of the page itself, of the one before, and one of their words twice.
    """
    pages = t("pages").select("page_id", U.match_html("html").alias("page"), T.match_form(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)).alias("own"))
    before = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("own").alias("other"))
    told = pages.join(before, "page_id", "left").select("page_id", "page", F.explode(F.array(
        F.struct(F.lit("new").alias("kind"), F.col("own").alias("title")), F.struct(F.lit("status_change").alias("kind"), F.col("other").alias("title")), F.struct(F.lit("removed").alias("kind"), F.lit("Gone").alias("title")),
        F.struct(F.lit("twice").alias("kind"), F.concat_ws(" ", F.reverse(F.split("own", " "))).alias("title")),
    )).alias("c")).select("page_id", "page", "c.kind", "c.title")
    none = F.lit(None).cast("string")
    good = Q.real_publication(F.col("title"), F.array().cast("array<array<string>>"), none, none, none) & U.title_on_page("title", "page")
    return told.where((F.col("kind") == "removed") | F.coalesce(good, F.lit(False))).select("page_id", "kind")
