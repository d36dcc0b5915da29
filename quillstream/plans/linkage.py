"""People linked to a directory's records, full-text search, and pages by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.operators import fulltext as X
from quillstream.operators import linkage as L
from quillstream.operators import pages as G
from quillstream.plans.common import Plans
from quillstream.plans.identity import compatible_sql
from quillstream.session import shared_folder

P = Plans()

#: People (customers) and records (suppliers) as expressions that both engines read.
FIRST_SQL = "case {k} % 5 when 0 then 'Ann' when 1 then ' bob' when 2 then 'Cy' when 3 then 'DI' else 'Ed ' end"
WORKPLACE_SQL = "case when {n} % 3 = 0 then 'Mega Institute of Technology' else 'University of ' || {n} end"
PEOPLE_SQL = f"""
    select c_custkey as id, {FIRST_SQL.format(k='c_custkey')} as first, 'L' || (c_custkey % 70) as last,
        case when c_nationkey % 4 = 0 then null when c_nationkey % 3 = 0 then 'MIT' else 'university of ' || c_nationkey end as affiliation, c_custkey % 6 as kind, c_custkey % 100 as peer from customer
"""
RECORDS_SQL = f"""
    select 's' || s_suppkey as handle, {FIRST_SQL.format(k='s_suppkey')} as first, 'l' || (s_suppkey % 70) as last, {WORKPLACE_SQL.format(n='s_nationkey')} as workplace,
        case s_suppkey % 4 when 0 then 'https://u' || s_suppkey || '.edu/~x' when 1 then 'https://sites.google.com/site/' || s_suppkey when 3 then 'http://shared' || (s_suppkey % 6) || '.org/p' end as homepage from supplier
"""
#: A person's pages by kind.
URLS = ("https://u{p}.edu/home", "https://Sites.google.com/Site/{p}/", "https://sites.google.com/other", None, "http://shared{q}.org/z", None)


def _url_sql() -> str:
    said = [f"when {k} then '{u.replace('{p}', chr(39) + ' || peer || ' + chr(39)).replace('{q}', chr(39) + ' || (peer % 6) || ' + chr(39))}'" for k, u in enumerate(URLS) if u]
    return f"case kind {' '.join(said)} end"


def _people(t):
    t("customer").createOrReplaceTempView("linkage_customer")
    rows = t("customer").sparkSession.sql(PEOPLE_SQL.replace("from customer", "from linkage_customer"))
    url = F.expr(_url_sql())
    return rows.select("id", "first", "last", "affiliation", F.when(url.isNotNull(), F.array(url, F.lit("no address"))).when(F.col("kind") == 3, F.array().cast("array<string>")).alias("urls"))


def _records(t):
    t("supplier").createOrReplaceTempView("linkage_supplier")
    return t("supplier").sparkSession.sql(RECORDS_SQL.replace("from supplier", "from linkage_supplier"))


_DOMAIN_SQL = "nullif(lower(regexp_extract({0}, '^[A-Za-z]+://([^/?#]*)', 1)), '')"
_INDEX_SQL = f"""people as ({PEOPLE_SQL}), records as ({RECORDS_SQL}),
    r as (select handle, lower(trim(first)) as f, lower(trim(last)) as l, workplace, homepage, {_DOMAIN_SQL.format('homepage')} as domain from records where homepage is not null)"""


@P.add("src_6_multimaps", f"""
    with {_INDEX_SQL}
    select 'name' as kind, f || ' ' || l as key, handle, count(*) over (partition by f, l) as n from r
    union all select 'domain', domain, handle, count(*) over (partition by domain) from r where domain is not null
""")
def _(t):
    names, domains = L.index(_records(t))
    by_name = names.select(F.lit("name").alias("kind"), F.concat_ws(" ", "first_key", "last_key").alias("key"), "record.handle", "n")
    return by_name.unionByName(domains.select(F.lit("domain").alias("kind"), F.col("domain").alias("key"), "record.handle", "n"))


@P.add("join_18_linkage_tiers", f"""
    with {_INDEX_SQL},
    p as (select id, lower(trim(first)) as f, lower(last) as l, lower(coalesce(affiliation, '')) as a, {_url_sql()} as url from people),
    one as (select distinct id, handle from p join r on {_DOMAIN_SQL.format('url')} = domain and p.l = r.l where domain not in ('sites.google.com', 'github.io', 'wordpress.com', 'weebly.com', 'wixsite.com', 'blogspot.com', 'squarespace.com', 'netlify.app', 'vercel.app', 'github.com')
        or rtrim(lower(url), '/') = rtrim(lower(homepage), '/')),
    met as (select id, handle, a <> '' and (contains(a, lower(workplace)) or contains(lower(workplace), a) or (a = 'mit' and workplace like 'Mega%')) as fits from p join r using (f, l) where url is not null and id not in (select id from one)),
    told as (select *, count(*) over (partition by id) as n, sum(fits::int) over (partition by id) as n_fits from met)
    select id, handle, 'url_match' as match, 'unique' as confidence from one
    union all select id, handle, 'exact_name', case when n = 1 then 'unique' when n_fits = 1 then 'affiliation_match' else 'ambiguous' end from told where n = 1 or n_fits <> 1 or fits
""")
def _(t):
    return L.linked(_people(t), _records(t))


#: People to look up, and those known; names of many forms.
WANTED_SQL = """
    select c_custkey as k, case c_custkey % 6 when 0 then 'Ann' when 1 then 'a.' when 2 then 'Bo Lee' when 3 then 'B.' when 4 then 'Bo' else 'Zoe' end as first,
        'Fam' || (c_custkey % 37) as last, case when c_custkey % 4 = 0 then 'A' || (c_custkey % 150) end as identifier from customer
"""
KNOWN_SQL = """
    select s_suppkey as id, case s_suppkey % 5 when 0 then 'Ann' when 1 then 'Bo' when 2 then 'B. Lee' when 3 then 'Abe' else 'Carl' end as first,
        'fam' || (s_suppkey % 41) as last, case when s_suppkey % 3 = 0 then 'A' || s_suppkey end as identifier from supplier
"""
TOLD_SQL = "select c_custkey as k, case when c_custkey % 14 = 0 then 1000 + c_custkey end as id from customer where c_custkey % 7 = 0"


@P.add("join_19_lookup_cascade", f"""
    with wanted as ({WANTED_SQL}), known as ({KNOWN_SQL}), told as ({TOLD_SQL}),
    one as (select k, min(id) as id, 'name' as tier from wanted w join known s on lower(trim(w.first)) = lower(trim(s.first)) and lower(w.last) = lower(s.last) group by k),
    two as (select k, min(id) as id, 'identifier' as tier from wanted w join known s using (identifier) where k not in (select k from one) group by k),
    three as (select k, min(id) as id, 'compatible' as tier from (select w.k, s.id, {compatible_sql('w.first', 's.first')} as ok from wanted w join known s on lower(w.last) = lower(s.last)) where ok and k not in (select k from one) and k not in (select k from two) group by k having count(*) = 1),
    four as (select k, id, 'told' as tier from told where id is not null and k not in (select k from one) and k not in (select k from two) and k not in (select k from three))
    select * from one union all select * from two union all select * from three union all select * from four
    union all select k, null, 'new' from wanted where k not in (select k from one union all select k from two union all select k from three union all select k from four)
""")
def _(t):
    for name in ("customer", "supplier"):
        t(name).createOrReplaceTempView(f"linkage_{name}")
    wanted, known, told = (t("customer").sparkSession.sql(q.replace("from customer", "from linkage_customer").replace("from supplier", "from linkage_supplier")) for q in (WANTED_SQL, KNOWN_SQL, TOLD_SQL))
    return L.resolved(wanted, known, told)


@P.add("flt_8_fulltext", r"""
    select doc_id as id from documents where len(list_intersect(string_split_regex(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Pc}]+'), ['license', 'ereath', 'quele'])) > 0
""")
def _(t):
    """The words of a query with operators, short words and stop words, from an index of all documents."""
    docs = t("documents").select(F.col("doc_id").alias("id"), "text")
    folder = f"{shared_folder(docs.sparkSession)}/index"
    X.build(docs, folder)
    return X.search(docs.sparkSession, folder, '+license ereath* ("quele") @of -to')


@P.add("sort_1_keyset", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 25 offset 50")
def _(t):
    """The third page, each from the last row of the one before."""
    orders = t("orders").select("o_orderkey", "o_orderdate")
    spark, folder = orders.sparkSession, f"{shared_folder(orders.sparkSession)}/pages"
    G.cluster(orders, "o_orderdate", "o_orderkey", folder, 32)
    after = None
    for _ in range(2):
        last = G.page(spark, folder, "o_orderdate", "o_orderkey", 25, after).collect()[-1]
        after = (last.o_orderdate, last.o_orderkey)
    return G.page(spark, folder, "o_orderdate", "o_orderkey", 25, after)
