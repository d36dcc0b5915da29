"""Filters, joins, ordering and the feed: serving queries over the star tables.

Stand-ins: events for feed events (user_id for the paper), supplier and nation for people and
affiliations, part for papers, lineitem for authorship, customer and orders for users and follows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators import rows as R
from quillstream.plans.common import Plans, money, total

P = Plans()
_FEED = "event_id, user_id, event_type, ts, value"


def feed_search(events, keys, *, types=None, since=None, until=None, least=None, owners=None):
    """FLT-1: conditions apply only where an argument is given."""
    day_end = None if until is None else F.when(F.date_trunc("day", F.lit(until).cast("timestamp")) == F.lit(until).cast("timestamp"), F.lit(until).cast("timestamp") + F.expr("interval 86399 seconds")).otherwise(F.lit(until).cast("timestamp"))
    conditions = [
        None if not types else F.col("event_type") == types[0] if len(types) == 1 else F.col("event_type").isin(*types),
        None if since is None else F.col("ts") >= F.lit(since).cast("timestamp"),
        None if day_end is None else F.col("ts") <= day_end,
        None if least is None else F.col("value") >= least,
    ]
    found = events.where(R.conjunction(conditions))
    return found if owners is None else found.join(keys.where(owners), F.col("user_id") == F.col("c_custkey"), "left_semi")


@P.add("srv_1_feed", f"""
    select {_FEED} from events where event_type in ('click', 'view', 'purchase') and ts >= '2024-01-05' and ts <= '2024-01-20 23:59:59'
        and user_id in (select c_custkey from customer where c_acctbal > 0)
    order by ts desc, event_id limit 20
""")
def _(t):
    found = feed_search(t("events"), t("customer"), types=["click", "view", "purchase"], since="2024-01-05", until="2024-01-20", owners=F.col("c_acctbal") > 0)
    return R.page(found.selectExpr(*_FEED.split(", ")), 1, 20, F.desc("ts"), F.col("event_id"))


@P.add("flt_1_dynamic_conjunction", f"select {_FEED} from events where event_type = 'view' and value >= 50")
def _(t):
    return feed_search(t("events"), None, types=["view"], least=50).selectExpr(*_FEED.split(", "))


@P.add("flt_2_in_list", "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P')")
def _(t):
    return t("orders").where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus")


@P.add("flt_3_inclusive_dates", "select event_id from events where ts between '2024-01-10' and '2024-01-12 23:59:59'")
def _(t):
    return feed_search(t("events"), None, since="2024-01-10", until="2024-01-12").select("event_id")


@P.add("flt_4_literal_substring", "select c_custkey, c_name from customer where contains(lower(c_name), lower('R#0000001'))")
def _(t):
    return t("customer").where(F.contains(F.lower("c_name"), F.lower(F.lit("R#0000001")))).select("c_custkey", "c_name")


@P.add("flt_5_keyword_set", "select n_nationkey, n_name from nation where lower(n_name) like '%an%' or lower(n_name) like '%ia%' or lower(n_name) like '%1%'")
def _(t):
    return t("nation").where(T.contains_any(F.col("n_name"), ("AN", "ia", "1"))).select("n_nationkey", "n_name")


@P.add("flt_6_include_and_exclude", "select p_partkey, p_type from part where (lower(p_type) like '%brass%' or lower(p_type) like '%e%') and not lower(p_type) like '%small%'")
def _(t):
    return t("part").where(T.contains_any(F.col("p_type"), ("brass", "e")) & ~T.contains_any(F.col("p_type"), ("small",))).select("p_partkey", "p_type")


@P.add("flt_7_negated_conjunction", """
    select l_orderkey, l_linenumber, l_partkey, nullif(l_returnflag, 'N') as old_status, l_linestatus from lineitem
    where not (nullif(l_returnflag, 'N') = 'A' and l_linestatus = 'F')
""")
def _(t):
    old = F.nullif("l_returnflag", F.lit("N"))
    return t("lineitem").where(~((old == "A") & (F.col("l_linestatus") == "F"))).select("l_orderkey", "l_linenumber", "l_partkey", old.alias("old_status"), "l_linestatus")


@P.add("flt_8_any_word", r"select doc_id from documents where len(list_intersect(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), ['license', 'ereath', 'quele'])) > 0")
def _(t):
    tokens = F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " ")
    return t("documents").where(F.arrays_overlap(tokens, F.array(*map(F.lit, ("license", "ereath", "quele"))))).select("doc_id")


@P.add("flt_9_predicate_or_exists", """
    select p_partkey from part where p_name like '%a%' and p_size > 45
        or exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 50)
""")
def _(t):
    busy = t("lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("k")).distinct()
    return t("part").join(busy, F.col("p_partkey") == F.col("k"), "left").where(((F.col("p_name").like("%a%")) & (F.col("p_size") > 45)) | F.col("k").isNotNull()).select("p_partkey")


@P.add("flt_10_regular_expression", "select doc_id from documents where regexp_matches(text, '^[A-D][a-z]+ [a-z]+') and not regexp_matches(text, '[0-9]')")
def _(t):
    return t("documents").where(F.col("text").rlike("^[A-D][a-z]+ [a-z]+") & ~F.col("text").rlike("[0-9]")).select("doc_id")


@P.add("flt_11_blank_test", "select doc_id, trim(coalesce(nullif(lang, 'fr'), '')) = '' as blank from documents")
def _(t):
    return t("documents").select("doc_id", (F.trim(T.text(F.nullif("lang", F.lit("fr")))) == "").alias("blank"))


@P.add("flt_12_null_safe_changed", "select event_id, nullif(event_type, 'view') is distinct from 'click' as changed from events")
def _(t):
    return t("events").select("event_id", (~F.nullif("event_type", F.lit("view")).eqNullSafe(F.lit("click"))).alias("changed"))


@P.add("flt_13_directory_guard", """
    select s_suppkey, s_name from supplier where length(s_name) > 2 and not regexp_matches(s_name, '^[A-Za-z]\\.?$')
        and s_suppkey in (select l_suppkey from lineitem where l_quantity > 40)
""")
def _(t):
    busy = t("lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("s_suppkey"))
    return t("supplier").where((F.length("s_name") > 2) & ~F.col("s_name").rlike(r"^[A-Za-z]\.?$")).join(busy, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@P.add("flt_15_bad_names", r"select c_custkey, trim(c_name) = '' or trim(c_mktsegment[1:c_custkey % 3]) = '' or regexp_matches(trim(c_mktsegment[1:c_custkey % 3]), '^[A-Za-z]\.?$') as bad from customer")
def _(t):
    last = F.expr("left(c_mktsegment, cast(c_custkey % 3 as int))")
    return t("customer").select("c_custkey", T.bad_name(F.col("c_name"), last).alias("bad"))


@P.add("flt_16_response_shape", """
    select event_id as id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as created_at, event_type = 'purchase' as available, coalesce(nullif(event_type, 'view'), 'none') as kind from events
""")
def _(t):
    return t("events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), (F.col("event_type") == "purchase").alias("available"), F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("none")).alias("kind"))


@P.add("flt_17_date_presets", """
    select count(*) filter (where ts >= timestamp '2024-01-31' - interval 7 day) as week, count(*) filter (where ts >= date_trunc('month', timestamp '2024-01-31')) as month,
        count(*) filter (where ts >= date_trunc('quarter', timestamp '2024-01-31')) as quarter from events
""")
def _(t):
    now = F.lit("2024-01-31").cast("timestamp")
    return t("events").agg(F.count_if(F.col("ts") >= now - F.expr("interval 7 days")).alias("week"), F.count_if(F.col("ts") >= F.date_trunc("month", now)).alias("month"), F.count_if(F.col("ts") >= F.date_trunc("quarter", now)).alias("quarter"))


@P.add("flt_18_status_sections", """
    select section, count(*) as n from (select case when s = 'P' then 'in_progress' when s = 'F' then 'published' else 'working' end as section
        from (select nullif(o_orderstatus, 'O') as s from orders)) group by section
""")
def _(t):
    s = F.nullif("o_orderstatus", F.lit("O"))
    return t("orders").select(F.when(s == "P", "in_progress").when(s == "F", "published").otherwise("working").alias("section")).groupBy("section").agg(F.count("*").alias("n"))


# Joins


@P.add("join_1_inner_chain", """
    select o_orderkey, c_name, n_name, r_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    where o_totalprice > 300000
""")
def _(t):
    o = t("orders").where("o_totalprice > 300000").select("o_orderkey", "o_custkey")
    return o.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@P.add("join_2_left_with_condition", """
    select p_partkey, l_orderkey, l_linenumber from part left join lineitem on p_partkey = l_partkey and l_quantity = 50 and l_discount > 0.08
""")
def _(t):
    some = t("lineitem").where("l_quantity = 50 and l_discount > 0.08").select("l_partkey", "l_orderkey", "l_linenumber")
    return t("part").join(some, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "l_orderkey", "l_linenumber")


@P.add("join_3_anti_left", "select c_custkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 100000 where o_orderkey is null")
def _(t):
    return t("customer").join(t("orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@P.add("join_4_anti_not_exists", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def _(t):
    return t("orders").join(t("lineitem").where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@P.add("join_5_semi_exists", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_tax >= 0.07 and l_discount >= 0.09)")
def _(t):
    return t("orders").join(t("lineitem").where("l_tax >= 0.07 and l_discount >= 0.09"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@P.add("join_6_semi_through_chain", """
    select distinct o_custkey from orders join lineitem on l_orderkey = o_orderkey where l_partkey in (
        select l2.l_partkey from lineitem l2 join part on p_partkey = l2.l_partkey where p_size = 50 and l2.l_suppkey <= 20)
""")
def _(t):
    parts = t("lineitem").where("l_suppkey <= 20").join(t("part").where("p_size = 50"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("l_partkey").distinct()
    hit = t("lineitem").join(parts, "l_partkey", "left_semi").select("l_orderkey")
    return t("orders").join(hit, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_custkey").distinct()


@P.add("join_7_semi_having", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 150000 group by o_custkey having count(*) >= 5)")
def _(t):
    often = t("orders").where("o_totalprice > 150000").groupBy("o_custkey").count().where("count >= 5")
    return t("customer").join(often, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@P.add("join_8_coauthors", """
    select a.l_suppkey as a, b.l_suppkey as b, count(distinct a.l_partkey) as shared from lineitem a join lineitem b on a.l_partkey = b.l_partkey and a.l_suppkey < b.l_suppkey
    where a.l_quantity >= 45 and b.l_quantity >= 45 group by all having count(distinct a.l_partkey) >= 2
""")
def _(t):
    pairs = t("lineitem").where("l_quantity >= 45").select("l_suppkey", "l_partkey").distinct()
    other = pairs.select(F.col("l_suppkey").alias("b"), "l_partkey")
    return pairs.select(F.col("l_suppkey").alias("a"), "l_partkey").join(other, "l_partkey").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where("shared >= 2")


@P.add("join_9_same_group_shared", """
    select x.s_suppkey as a, y.s_suppkey as b, count(distinct p.l_partkey) as shared from supplier x join supplier y on x.s_nationkey = y.s_nationkey and x.s_suppkey < y.s_suppkey
        join lineitem p on p.l_suppkey = x.s_suppkey join lineitem q on q.l_suppkey = y.s_suppkey and q.l_partkey = p.l_partkey
    where p.l_quantity >= 30 and q.l_quantity >= 30 group by all having count(distinct p.l_partkey) >= 2
""")
def _(t):
    # From shared parts to pairs of suppliers: an equality join, never a product of a nation's suppliers
    w = t("lineitem").where("l_quantity >= 30").select("l_suppkey", "l_partkey").distinct().join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    y = w.select(F.col("l_suppkey").alias("b"), "l_partkey", "s_nationkey")
    return w.withColumnRenamed("l_suppkey", "a").join(y, ["l_partkey", "s_nationkey"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where("shared >= 2")


@P.add("join_10_dominated_by_earlier", """
    select e.event_id from events e where exists (select 1 from events f where f.user_id = e.user_id and (f.ts < e.ts or f.ts = e.ts and f.event_id < e.event_id) and f.value >= e.value)
""")
def _(t):
    before = F.max("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return t("events").withColumn("best", before).where("best >= value").select("event_id")


@P.add("join_12_first_match", """
    select o_orderkey as paper, min(c_custkey) as owner from (select o_orderkey, 'http://site' || (o_custkey % 300) || '.org' as source from orders)
    join (select c_custkey, 'http://site' || (c_custkey % 200) || '.org' as url from customer where c_custkey % 3 > 0) on source = url group by o_orderkey
""")
def _(t):
    """The first owner of the page that a paper was found on; an address has several owners, or none."""
    papers = t("orders").select(F.col("o_orderkey").alias("paper"), F.concat(F.lit("http://site"), F.col("o_custkey") % 300, F.lit(".org")).alias("url"))
    pages = t("customer").where("c_custkey % 3 > 0").select("c_custkey", F.concat(F.lit("http://site"), F.col("c_custkey") % 200, F.lit(".org")).alias("url"))
    # one row an address before the join, so it doesn't fan out
    owners = pages.groupBy("url").agg(F.min("c_custkey").alias("owner"))
    return papers.join(owners, "url").select("paper", "owner")


@P.add("join_13_as_of", """
    select e.event_id, (select max_by(f.value, struct_pack(a := f.ts, b := f.value)) from events f where f.user_id = e.user_id and f.event_type = 'view' and f.ts < e.ts) as last_view
    from events e where e.event_type = 'purchase'
""")
def _(t):
    e = t("events")
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), "value")
    return R.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "seen", "value", "last_view").select("event_id", "last_view")


@P.add("join_14_interval", """
    select o.o_orderkey, count(*) as late from orders o join lineitem l on l.l_orderkey = o.o_orderkey and l.l_shipdate > o.o_orderdate + interval 90 day group by o.o_orderkey
""")
def _(t):
    o = t("orders").select("o_orderkey", "o_orderdate")
    return o.join(t("lineitem").select("l_orderkey", "l_shipdate"), F.col("l_orderkey") == F.col("o_orderkey")).where(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 90 days")).groupBy("o_orderkey").agg(F.count("*").alias("late"))


@P.add("join_15_json_rows", """select event_id, (props::json->>'k')::int as k from events where (props::json->>'k')::int >= 90""")
def _(t):
    each = t("events").select("event_id", F.explode(F.array(F.from_json("props", "struct<k:int>"))).alias("p"))
    return each.select("event_id", F.col("p.k").alias("k")).where("k >= 90")


@P.add("join_16_batch_lookup", """
    select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as orders, count(*) as n from orders where o_custkey in (select c_custkey from customer where c_acctbal > 9000) group by o_custkey
""")
def _(t):
    wanted = t("customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    items = R.nested(t("orders").join(wanted, "o_custkey", "left_semi").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")
    return items.select("o_custkey", F.array_join(F.transform("items", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"), F.size("items").cast("long").alias("n"))


# Order and pages


@P.add("sort_1_page", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 25 offset 50")
def _(t):
    return R.page(t("orders").select("o_orderkey", "o_orderdate"), 3, 25, F.desc("o_orderdate"), F.col("o_orderkey"))


@P.add("sort_2_by_condition", "select c_custkey from customer order by c_mktsegment = 'BUILDING' desc, c_acctbal desc, c_custkey limit 30")
def _(t):
    return t("customer").orderBy((F.col("c_mktsegment") == "BUILDING").desc(), F.desc("c_acctbal"), "c_custkey").limit(30).select("c_custkey")


@P.add("sort_3_names", "select s_name, s_suppkey from supplier order by s_name, s_suppkey limit 40")
def _(t):
    return t("supplier").orderBy("s_name", "s_suppkey").limit(40).select("s_name", "s_suppkey")


@P.add("sort_4_random_sample", "select c_custkey from customer order by md5(c_custkey || ':42'), c_custkey limit 20")
def _(t):
    """A sample that is the same however the rows are dealt: the least hashes of key and seed."""
    return t("customer").select("c_custkey").orderBy(F.md5(F.concat_ws(":", "c_custkey", F.lit("42"))), "c_custkey").limit(20)


@P.add("sort_5_latest", "select event_id, ts from events order by ts desc, event_id desc limit 50")
def _(t):
    return t("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts")


@P.add("sort_6_facets", "select distinct c_mktsegment, n_name from customer join nation on c_nationkey = n_nationkey")
def _(t):
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_name").distinct()


@P.add("sort_7_by_bytes", "select doc_id, octet_length(encode(text))::bigint as size from documents order by size desc, doc_id limit 20")
def _(t):
    return t("documents").select("doc_id", F.octet_length("text").cast("long").alias("size")).orderBy(F.desc("size"), "doc_id").limit(20)


@P.add("sort_8_most_common", "select p_brand, count(*) as n from part group by p_brand order by n desc, p_brand limit 5")
def _(t):
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(5)


# Serving composites


@P.add("srv_2_detail", """
    select p_partkey, p_name, (select string_agg(s_name, ', ' order by k) from (select s_name, min(l_linenumber) * 100000 + s_suppkey as k from lineitem join supplier on s_suppkey = l_suppkey where l_partkey = p_partkey group by s_name, s_suppkey)) as authors
    from part
""")
def _(t):
    a = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("first"))
    named = a.join(t("supplier").select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey")).withColumn("k", F.expr("first * 100000 + s_suppkey"))
    authors = R.nested(named, ["l_partkey"], "k", "s_name").select(F.col("l_partkey").alias("p_partkey"), F.array_join(F.transform("items", lambda x: x["s_name"]), ", ").alias("authors"))
    return t("part").join(authors, "p_partkey", "left").select("p_partkey", "p_name", "authors")


@P.add("srv_3_people_list", """
    with w as (select l_suppkey, count(distinct l_partkey) as n, sum(l_extendedprice::decimal(18,4))::double as v from lineitem group by l_suppkey),
    f as (select l_suppkey, string_agg(distinct p_type, ',' order by p_type) as fields, string_agg(distinct p_brand, ',' order by p_brand) as codes from lineitem join part on p_partkey = l_partkey group by l_suppkey),
    u as (select page_id % 120 as k, string_agg(url, ' ' order by page_id) as urls from pages group by k)
    select s_suppkey, s_name, coalesce(n, 0) as papers, coalesce(v, 0) as revenue, coalesce(fields, '') as fields, coalesce(codes, '') as codes, coalesce(urls, '') as urls
    from supplier left join w on w.l_suppkey = s_suppkey left join f on f.l_suppkey = s_suppkey left join u on u.k = s_suppkey
""")
def _(t):
    """People with their papers, fields by name, codes by code and addresses; each nested part is aggregated before it is joined."""
    work = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(money("l_extendedprice")).alias("v"))
    named = work.join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand"), "l_partkey", "left")
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    per = named.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("v"), listed("p_type").alias("fields"), listed("p_brand").alias("codes"))
    urls = t("pages").groupBy((F.col("page_id") % 120).alias("k")).agg(F.sort_array(F.collect_list(F.struct("page_id", "url"))).alias("u"))
    people = t("supplier").join(per, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(urls, F.col("k") == F.col("s_suppkey"), "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    return people.select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("papers"), F.coalesce("v", F.lit(0.0)).alias("revenue"), text(F.col("fields")).alias("fields"), text(F.col("codes")).alias("codes"), text(F.array_join(F.transform("u", lambda x: x["url"]), " ")).alias("urls"))


@P.add("srv_5_filter_options", """
    select 'affiliation' as kind, n_name as label from nation union all select 'position', r_name from region union all select distinct 'segment', c_mktsegment from customer
""")
def _(t):
    return t("nation").select(F.lit("affiliation").alias("kind"), F.col("n_name").alias("label")).unionAll(t("region").select(F.lit("position"), "r_name")).unionAll(t("customer").select(F.lit("segment"), "c_mktsegment").distinct())


@P.add("srv_8_atom_entries", """
    select event_id, '<entry><id>evt_' || event_id || '</id><summary>' || concat_ws(' | ', event_type, nullif(props, '')) || '</summary></entry>' as xml from events order by ts desc, event_id limit 50
""")
def _(t):
    body = F.concat(F.lit("<entry><id>evt_"), F.col("event_id"), F.lit("</id><summary>"), F.concat_ws(" | ", "event_type", F.nullif("props", F.lit(""))), F.lit("</summary></entry>"))
    return t("events").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", body.alias("xml"))


@P.add("srv_9_metrics", "select (select count(*) from supplier) as people, (select count(*) from part) as papers, (select count(*) from events) as events")
def _(t):
    counts = [t(n).agg(F.count("*").alias(a)) for n, a in (("supplier", "people"), ("part", "papers"), ("events", "events"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # three single rows


@P.add("srv_12_review_list", "select doc_id, quality, toxic from labels where toxic = 1 order by quality desc, doc_id limit 40")
def _(t):
    return t("labels").where("toxic = 1").orderBy(F.desc("quality"), "doc_id").limit(40).select("doc_id", "quality", "toxic")


@P.add("evt_6_digest", """
    select c_custkey, count(*) as n, max(o_orderdate) as latest from customer join orders on o_custkey = c_custkey
    where o_orderdate > timestamp '1998-01-01' - interval (c_custkey % 30) day and c_acctbal > 0 group by c_custkey
""")
def _(t):
    since = F.expr("timestamp '1998-01-01' - make_dt_interval(cast(c_custkey % 30 as int))")
    return t("customer").where("c_acctbal > 0").join(t("orders").select("o_custkey", "o_orderdate"), F.col("o_custkey") == F.col("c_custkey")).where(F.col("o_orderdate") > since).groupBy("c_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))


@P.add("key_1_point_lookup", "select * from part where p_partkey = 17")
def _(t):
    return t("part").where("p_partkey = 17")


@P.add("key_2_latest_history", "select event_id, ts from events where user_id = 7 order by ts desc, event_id desc limit 20")
def _(t):
    return t("events").where("user_id = 7").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts")
