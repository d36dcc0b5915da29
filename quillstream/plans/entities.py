"""Duplicate groups, survivors, linkage by titles, and enrichment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import udfs as U
from quillstream.operators import groups as G
from quillstream.operators import matching as M
from quillstream.operators import rows as R
from quillstream.plans.common import Plans, total

P = Plans()

@P.add("er_6_merge_into_earliest", """
    select p_name, min(p_partkey) as canonical, first(p_brand order by p_partkey) filter (where p_brand <> 'Brand#11') as brand, first(p_type order by p_partkey) filter (where p_size > 25) as type from part group by p_name
""")
def _(t):
    pick = lambda c, cond: F.min_by(F.when(cond, F.col(c)), F.when(cond, F.col("p_partkey")))
    return t("part").groupBy("p_name").agg(F.min("p_partkey").alias("canonical"), pick("p_brand", F.col("p_brand") != "Brand#11").alias("brand"), pick("p_type", F.col("p_size") > 25).alias("type"))


@P.add("er_9_exact_name_merge", """
    select p_partkey as dup, c as canonical from (select p_partkey, first_value(p_partkey) over (partition by lower(p_name), p_brand order by p_retailprice desc, p_partkey) as c from part) where p_partkey <> c
""")
def _(t):
    members = t("part").withColumn("g", F.concat_ws("|", F.lower("p_name"), "p_brand"))
    return G.survivors(members, "g", "p_partkey", F.desc("p_retailprice"), F.col("p_partkey"))


@P.add("er_10_owner_backfill", """
    select distinct o_custkey as owner, l_partkey as paper from orders join lineitem on l_orderkey = o_orderkey where l_quantity >= 48
        and not exists (select 1 from lineitem b where b.l_suppkey = o_custkey and b.l_partkey = lineitem.l_partkey)
""")
def _(t):
    pairs = t("orders").join(t("lineitem").where("l_quantity >= 48"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("owner"), F.col("l_partkey").alias("paper")).distinct()
    known = t("lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("paper"))
    return pairs.join(known, ["owner", "paper"], "left_anti")


@P.add("er_8_sorted_neighbours")
def _(t):
    """Neighbours in order of their normal form, of one beginning and nearly one word order, that differ in no mark of another paper."""
    w = Window.partitionBy("p_brand").orderBy("form", "p_partkey")
    marks = F.when(F.col("p_partkey") % 5 == 1, " Part").when(F.col("p_partkey") % 5 == 2, " 2").when(F.col("p_partkey") % 5 == 3, " abroad").otherwise("")
    forms = t("part").select("p_partkey", "p_brand", T.normalize_title(F.concat(F.concat_ws(" ", "p_name", "p_type", F.lit("in long run models of trade and of growth in open areas")), marks)).alias("form"))
    pairs = forms.select(F.col("p_partkey").alias("b"), F.lag("p_partkey").over(w).alias("a"), F.col("form").alias("y"), F.lag("form").over(w).alias("x"))
    near = pairs.where(F.left("x", F.lit(20)) == F.left("y", F.lit(20))).withColumn("score", U.sequence_ratio(T.words(F.col("x")), T.words(F.col("y"))))
    return near.where("score >= 0.92").where(~T.distinct_markers(F.col("x"), F.col("y"))).select("a", "b", "score")


@P.add("win_3_greedy_best_match")
def _(t):
    """Each old title of a page used once, best pairs first."""
    pieces = F.slice(F.split("html", "<p>"), 2, 1 << 30)
    sets = t("pages").select("page_id", F.transform(pieces, lambda p: F.array_distinct(T.words(T.normalize_title(p)))).alias("w"))
    scored = M.alike(sets.where("page_id is not null"), "page_id", "w", 0.2)
    return M.greedy(scored, "page_id", "i", "j", "score")


@P.add("enr_1_queue", """
    select p_partkey, d is not null as has_doi from part left join (select l_partkey, min(l_orderkey) as d from lineitem where l_discount = 0.1 group by l_partkey) on l_partkey = p_partkey
    where p_size > 25 and (d is not null or p_type like '%a%') order by d is not null desc, p_partkey limit 100
""")
def _(t):
    d = t("lineitem").where("l_discount = 0.1").groupBy("l_partkey").agg(F.min("l_orderkey").alias("d"))
    q = t("part").where("p_size > 25").join(d, F.col("l_partkey") == F.col("p_partkey"), "left").where("d is not null or p_type like '%a%'")
    return q.orderBy(F.col("d").isNotNull().desc(), "p_partkey").limit(100).select("p_partkey", F.col("d").isNotNull().alias("has_doi"))


@P.add("enr_2_budget", "select event_id from (select event_id, row_number() over (partition by ts::date order by ts, event_id) as n from events) where n <= 50")
def _(t):
    return R.top(t("events").withColumn("day", F.to_date("ts")), ["day"], 50, F.col("ts"), F.col("event_id")).select("event_id")


@P.add("enr_4_topic_codes", """
    with topics as (select p_partkey, case p_size % 6 when 0 then 'Labor market and wage' when 1 then 'Fiscal policy' when 2 then 'Climate and energy' when 3 then 'Urban housing' when 4 then 'Game theory' else 'Poetry' end as topic, p_retailprice from part),
    codes as (select p_partkey, unnest(case topic when 'Labor market and wage' then ['J'] when 'Fiscal policy' then ['E', 'H'] when 'Climate and energy' then ['Q'] when 'Urban housing' then ['R'] when 'Game theory' then ['C', 'D'] else [] end) as code, p_retailprice from topics)
    select code, count(*) as n, sum(p_retailprice::decimal(18,4))::double as weight from codes group by code
""")
def _(t):
    names = F.array(*map(F.lit, ("Labor market and wage", "Fiscal policy", "Climate and energy", "Urban housing", "Game theory", "Poetry")))
    topic = F.element_at(names, F.col("p_size") % 6 + 1)
    each = t("part").select(F.explode(T.topic_codes(topic)).alias("code"), "p_retailprice")
    return each.groupBy("code").agg(F.count("*").alias("n"), total("p_retailprice").alias("weight"))


@P.add("enr_5_candidates", """
    select distinct b.l_suppkey as candidate from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_suppkey <> b.l_suppkey
    where a.l_suppkey in (select l_suppkey from lineitem where l_quantity = 50 group by l_suppkey having count(*) >= 14)
        and not exists (select 1 from supplier where s_suppkey = b.l_suppkey and s_acctbal > 0)
""")
def _(t):
    strong = t("lineitem").where("l_quantity = 50").groupBy("l_suppkey").count().where("count >= 14").select("l_suppkey")
    work = t("lineitem").select("l_orderkey", "l_suppkey").distinct()
    seeds = work.join(strong, "l_suppkey", "left_semi").select("l_orderkey", F.col("l_suppkey").alias("seed"))
    beside = work.join(seeds, "l_orderkey").where("l_suppkey <> seed").select(F.col("l_suppkey").alias("candidate")).distinct()
    return beside.join(t("supplier").where("s_acctbal > 0"), F.col("s_suppkey") == F.col("candidate"), "left_anti")


@P.add("enr_6_home_page", "select host, coalesce(first(page_id order by page_id) filter (where page_id % 3 = 0), min(page_id)) as page from (select *, regexp_extract(url, '//([^/?#:]+)', 1) as host from pages) group by host")
def _(t):
    home = F.min(F.when(F.col("page_id") % 3 == 0, F.col("page_id")))
    return t("pages").groupBy(F.regexp_extract("url", "//([^/?#:]+)", 1).alias("host")).agg(F.coalesce(home, F.min("page_id")).alias("page"))


@P.add("rvw_1_actions", """select event_id, case event_type when 'purchase' then 'hide_event' when 'view' then 'fix_title' else 'none' end as action from events where (props::json->>'k')::int > 80""")
def _(t):
    k = F.from_json("props", "struct<k:int>")["k"]
    return t("events").where(k > 80).select("event_id", F.when(F.col("event_type") == "purchase", "hide_event").when(F.col("event_type") == "view", "fix_title").otherwise("none").alias("action"))


@P.add("set_1_difference_both_ways", """
    select l_partkey as k, 'gone' as way from (select l_partkey from lineitem where l_shipdate < '1997-01-01' and l_quantity > 45 except select l_partkey from lineitem where l_shipdate >= '1997-01-01' and l_quantity > 45)
    union all select l_partkey, 'new' from (select l_partkey from lineitem where l_shipdate >= '1997-01-01' and l_quantity > 45 except select l_partkey from lineitem where l_shipdate < '1997-01-01' and l_quantity > 45)
""")
def _(t):
    # one aggregation instead of two anti joins
    early = F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    sides = t("lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("k")).agg(F.bool_or(early).alias("was"), F.bool_or(~early).alias("is"))
    return sides.where("was <> is").select("k", F.when(F.col("was"), "gone").otherwise("new").alias("way"))


@P.add("set_4_symmetric_difference", r"""
    with w as (select doc_id, list_distinct(string_split(text, ' ')) as a, list_distinct(string_split(text[41:], ' ')) as b from documents)
    select doc_id, (len(a) + len(b) - 2 * len(list_intersect(a, b)))::bigint as n from w
""")
def _(t):
    a, b = F.array_distinct(F.split("text", " ")), F.array_distinct(F.split(F.substring("text", 41, 1 << 30), " "))
    return t("documents").select("doc_id", (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))).cast("long").alias("n"))


@P.add("set_5_union_all", "select c_custkey as k, 'c' as side from customer where c_acctbal < 0 union all select s_suppkey, 's' from supplier where s_acctbal < 0")
def _(t):
    return t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.lit("c").alias("side")).unionByName(t("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("k"), F.lit("s").alias("side")))


@P.add("set_6_disjoint_labels", """
    select label, count(*) as n from (select case when o is null then 'never' when m < 50000 then 'small' else 'regular' end as label
        from customer left join (select o_custkey as o, max(o_totalprice) as m from orders group by o_custkey) on o = c_custkey) group by label
""")
def _(t):
    m = t("orders").groupBy(F.col("o_custkey").alias("o")).agg(F.max("o_totalprice").alias("m"))
    label = F.when(F.col("o").isNull(), "never").when(F.col("m") < 50000, "small").otherwise("regular")
    return t("customer").join(m, F.col("o") == F.col("c_custkey"), "left").groupBy(label.alias("label")).agg(F.count("*").alias("n"))
