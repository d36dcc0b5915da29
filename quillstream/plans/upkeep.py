"""Writes as resulting tables, data-quality invariants and repairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import urls as W
from quillstream.operators import groups as G
from quillstream.operators import quality as Q
from quillstream.operators import rows as R
from quillstream.plans.common import Plans

P = Plans()
_OLD = "with old as (select c_custkey as k, c_name as name, c_acctbal as v, c_mktsegment as s from customer where c_custkey % 3 <> 0)"
_NEW = ", new as (select c_custkey + 1 as k, 'new ' || c_custkey as name, -c_acctbal as v, case when c_custkey % 2 = 0 then c_mktsegment end as s from customer where c_custkey % 5 = 0)"


def _old(t):
    return t("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("s"))


def _new(t):
    return t("customer").where("c_custkey % 5 = 0").select((F.col("c_custkey") + 1).alias("k"), F.concat(F.lit("new "), "c_custkey").alias("name"), (-F.col("c_acctbal")).alias("v"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("s"))


@P.add("dml_1_insert_if_absent", _OLD + _NEW + " select * from old union all select * from new where k not in (select k from old)")
def _(t):
    return R.insert_if_absent(_old(t), _new(t), ["k"])


@P.add("dml_2_upsert", _OLD + _NEW + " select * from new union all select * from old where k not in (select k from new)")
def _(t):
    return R.upsert(_old(t), _new(t), ["k"])


@P.add("dml_3_replace_set", """
    select l_orderkey, l_partkey, l_suppkey from lineitem where l_orderkey % 10 = 0 and l_quantity > 25
    union all select l_orderkey, l_partkey, l_suppkey from lineitem where l_orderkey not in (select l_orderkey from lineitem where l_orderkey % 10 = 0 and l_quantity > 25)
""")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return R.replace_set(rows.drop("l_quantity"), rows.where("l_orderkey % 10 = 0 and l_quantity > 25").drop("l_quantity"), ["l_orderkey"])


@P.add("dml_4_add_known_only", """
    with have as (select distinct l_suppkey as s, l_partkey % 40 as code from lineitem where l_quantity > 40), more as (select distinct l_suppkey as s, l_partkey % 60 as code from lineitem where l_quantity < 5)
    select * from have union select * from more where code in (select n_nationkey from nation)
""")
def _(t):
    have = t("lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("s"), F.expr("l_partkey % 40").alias("code")).distinct()
    more = t("lineitem").where("l_quantity < 5").select(F.col("l_suppkey").alias("s"), F.expr("l_partkey % 60").alias("code")).distinct()
    known = more.join(t("nation").select(F.col("n_nationkey").cast("long").alias("code")), "code", "left_semi").select("s", "code")
    return R.insert_if_absent(have, known, ["s", "code"])


@P.add("dml_5_backfill", _OLD + _NEW + " select o.k, o.name, o.v, coalesce(nullif(o.s, 'BUILDING'), n.s) as s from old o left join new n on n.k = o.k")
def _(t):
    gaps = _old(t).withColumn("s", F.nullif("s", F.lit("BUILDING")))
    return R.backfill(gaps, _new(t), ["k"], ["s"])


@P.add("dml_6_update_from_aggregate", "select p_partkey, coalesce(m, p_size) as size from part left join (select l_partkey, max(l_quantity)::int as m from lineitem group by l_partkey) on l_partkey = p_partkey")
def _(t):
    m = t("lineitem").groupBy("l_partkey").agg(F.max("l_quantity").cast("int").alias("m"))
    return t("part").join(m, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce("m", "p_size").alias("size"))


@P.add("dml_7_earlier_date", "select o_orderkey, least(o_orderdate, coalesce(min(l_shipdate) - interval 100 day, o_orderdate)) as moved_to from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderdate")
def _(t):
    first = t("lineitem").groupBy("l_orderkey").agg((F.min("l_shipdate") - F.expr("interval 100 days")).alias("f"))
    return t("orders").join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.least("o_orderdate", F.coalesce("f", "o_orderdate")).alias("moved_to"))


@P.add("dml_8_delete", "select event_id from events where not (event_type = 'view' and value < 20)")
def _(t):
    return t("events").where("not (event_type = 'view' and value < 20)").select("event_id")


@P.add("dml_9_reparent", """
    with m as (select s_suppkey as dup, min(s_suppkey) over (partition by s_nationkey) as canonical from supplier), links as (select distinct l_suppkey, l_partkey from lineitem)
    select distinct m.canonical as l_suppkey, l_partkey from links join m on dup = l_suppkey
""")
def _(t):
    merged = G.survivors(t("supplier"), "s_nationkey", "s_suppkey", F.col("s_suppkey"))
    return R.reparent(t("lineitem").select("l_suppkey", "l_partkey").distinct(), merged, "l_suppkey", ["l_suppkey", "l_partkey"])


@P.add("dml_10_failure_counter", """
    with f as (select user_id, event_id, value < 40 as failed, sum(case when value >= 40 then 1 else 0 end) over (partition by user_id order by ts, event_id) as run from events),
    c as (select *, sum(case when failed then 1 else 0 end) over (partition by user_id, run order by event_id rows between unbounded preceding and current row) as strikes from (
        select f.*, e.ts from f join events e using (event_id)))
    select user_id, count(*) filter (where failed) as failures, max(n)::bigint as longest from (select *, count(*) filter (where failed) over (partition by user_id, run) as n from f) group by user_id
""")
def _(t):
    run = F.sum(F.when(F.col("value") >= 40, 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    f = t("events").select("user_id", (F.col("value") < 40).alias("failed"), run.alias("run"))
    each = f.groupBy("user_id", "run").agg(F.count_if("failed").alias("n"))
    return each.groupBy("user_id").agg(F.sum("n").alias("failures"), F.max("n").alias("longest"))


@P.add("dml_11_guard", """
    select e.event_id from events e where e.event_type = 'purchase' and coalesce((select count(*) from events f where f.user_id = e.user_id and f.event_type = 'view'), 0) >= 8
""")
def _(t):
    seen = t("events").where("event_type = 'view'").groupBy("user_id").count().where("count >= 8")
    return t("events").where("event_type = 'purchase'").join(seen, "user_id", "left_semi").select("event_id")


@P.add("dml_16_flag", "select s_suppkey, exists (select 1 from lineitem where l_suppkey = s_suppkey and l_extendedprice > 90000) as flag from supplier")
def _(t):
    top = t("lineitem").where("l_extendedprice > 90000").select(F.col("l_suppkey").alias("k")).distinct()
    return t("supplier").join(top, F.col("k") == F.col("s_suppkey"), "left").select("s_suppkey", F.col("k").isNotNull().alias("flag"))


@P.add("dml_18_insert_with_state", "select doc_id, case when n_chars > 500 then 'pending' else 'no_result' end as status from documents")
def _(t):
    return t("documents").select("doc_id", F.when(F.col("n_chars") > 500, "pending").otherwise("no_result").alias("status"))


@P.add("dml_20_run_log", "select user_id, min(ts) as started_at, max(ts) as finished_at, count(*) as urls, sum(event_id)::bigint as tokens from events group by user_id")
def _(t):
    return t("events").groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.count("*").alias("urls"), F.sum("event_id").alias("tokens"))


# Invariants


@P.add("dq_papers", r"""
    with r as (select doc_id, text from documents)
    select doc_id, 'lowercase' as rule from r where regexp_matches(text, '^[a-z]') union all select doc_id, 'blank' from r where trim(text) = ''
    union all select doc_id, 'untrimmed' from r where text <> trim(text) union all select doc_id, 'markup' from r where regexp_matches(text, '<[a-zA-Z/][^>]*>')
    union all select doc_id, 'entities' from r where regexp_matches(text, '&(#[0-9]+|#x[0-9a-fA-F]+|[a-zA-Z]+);') union all select doc_id, 'truncated' from r where regexp_matches(text, '(\.\.\.|…)\s*$')
    union all select doc_id, 'short' from r where length(text) < 40
""")
def _(t):
    c = F.col("text")
    return Q.violations(t("documents"), "doc_id", {"lowercase": Q.lowercase_start(c), "blank": Q.blank(c), "untrimmed": Q.untrimmed(c), "markup": Q.markup(c), "entities": Q.entities(c), "truncated": Q.truncated(c), "short": F.length(c) < 40})


@P.add("dq_page_markup", r"select page_id, 'entities' as rule from pages where regexp_matches(html, '&(#[0-9]+|#x[0-9a-fA-F]+|[a-zA-Z]+);') union all select page_id, 'scheme' from pages where not regexp_matches(url, '^https?://')")
def _(t):
    return Q.violations(t("pages"), "page_id", {"entities": Q.entities(F.col("html")), "scheme": ~F.col("url").rlike("^https?://")})


@P.add("dq_orphans", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 30)")
def _(t):
    return t("part").join(t("lineitem").where("l_quantity > 30"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@P.add("dq_shared_identifier", "select p_brand, count(distinct p_type) as owners from part group by p_brand having count(distinct p_type) > 1")
def _(t):
    return Q.shared_by_several(t("part"), "p_brand", "p_type")


@P.add("dq_hash_drift", "select doc_id, md5(text) <> md5(trim(text)) as drift from documents")
def _(t):
    return t("documents").select("doc_id", (F.md5("text") != F.md5(F.trim("text"))).alias("drift"))


@P.add("dq_null_rate", "select count(*) filter (where nullif(o_orderstatus, 'P') is null) / count(*) as rate from orders")
def _(t):
    return t("orders").agg((F.count_if(F.nullif("o_orderstatus", F.lit("P")).isNull()) / F.count("*")).alias("rate"))


@P.add("dq_regressions", """
    select event_id from (select event_id, value, lag(value) over (partition by user_id, event_type order by ts, event_id) as b from events) where value < b
""")
def _(t):
    b = F.lag("value").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return t("events").withColumn("b", b).where("value < b").select("event_id")


@P.add("dq_duplicate_events", "select user_id, event_type, ts::date as day, count(*) as n from events group by all having count(*) > 2")
def _(t):
    return t("events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).where("n > 2")


@P.add("dq_future_or_early", "select event_id from events where ts > '2024-01-30 12:00:00' or ts < '2024-01-01 12:00:00'")
def _(t):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return t("events").where((F.col("ts") > at("2024-01-30 12:00:00")) | (F.col("ts") < at("2024-01-01 12:00:00"))).select("event_id")


@P.add("dq_totals", "select o_orderkey from orders where o_totalprice < 0 or o_totalprice is null or o_orderdate is null or o_custkey not in (select c_custkey from customer)")
def _(t):
    bad = t("orders").where("o_totalprice < 0 or o_totalprice is null or o_orderdate is null").select("o_orderkey")
    return bad.union(t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("o_orderkey")).distinct()


@P.add("dq_doi_format", "select p_partkey from part where not regexp_matches('10.' || (1000 + p_size) || '/' || p_brand, '^10\\.[0-9]{4,}/[^#]+$')")
def _(t):
    return t("part").where(~F.concat(F.lit("10."), F.col("p_size") + 1000, F.lit("/"), F.col("p_brand")).rlike("^10\\.[0-9]{4,}/[^#]+$")).select("p_partkey")


# Repairs


@P.add("rep_1_too_many_authors", "select l_orderkey, l_partkey, l_suppkey from lineitem where l_orderkey not in (select l_orderkey from lineitem group by l_orderkey having count(*) > 6)")
def _(t):
    many = t("lineitem").groupBy("l_orderkey").count().where("count > 6")
    return t("lineitem").join(many, "l_orderkey", "left_anti").select("l_orderkey", "l_partkey", "l_suppkey")


@P.add("rep_2_odd_names_without_pages", "select c_custkey from customer where not (regexp_matches(c_name, '[0-9@/]') and c_custkey not in (select o_custkey from orders))")
def _(t):
    odd = t("customer").where(F.col("c_name").rlike("[0-9@/]")).join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")
    return t("customer").join(odd, "c_custkey", "left_anti").select("c_custkey")


@P.add("rep_3_trim", "select c_custkey, trim(' ' || c_name || '  ') as name from customer")
def _(t):
    return t("customer").select("c_custkey", F.trim(F.concat(F.lit(" "), "c_name", F.lit("  "))).alias("name"))


@P.add("rep_4_fix_schemes", "select page_id, url from pages where regexp_matches(url, '^https?://')")
def _(t):
    broken = t("pages").select("page_id", F.regexp_replace("url", "://", ":///").alias("url"))
    return broken.select("page_id", W.fix_scheme(F.col("url")).alias("url")).where(F.col("url").rlike("^https?://"))


@P.add("rep_9_earliest_owner", """
    select l_orderkey, l_partkey, l_suppkey, l_linenumber from (select *, min(l_suppkey) over (partition by l_partkey, l_orderkey) <> max(l_suppkey) over (partition by l_partkey, l_orderkey) as several,
        row_number() over (partition by l_partkey, l_orderkey order by l_linenumber, l_suppkey) as n from lineitem) where not several or n = 1
""")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").withColumn("k", F.struct("l_partkey", "l_orderkey"))
    return Q.keep_earliest_of_shared(rows, "k", "l_suppkey", F.col("l_linenumber"), F.col("l_suppkey")).drop("k")


@P.add("rep_10_merge_by_identifier", """
    select p_partkey as dup, c as canonical from (select p_partkey, first_value(p_partkey) over (partition by p_brand, p_type, p_size order by length(p_name) desc, p_partkey) as c from part) where p_partkey <> c
""")
def _(t):
    return G.survivors(t("part").withColumn("g", F.concat_ws("|", "p_brand", "p_type", "p_size")), "g", "p_partkey", F.length("p_name").desc(), F.col("p_partkey"))


@P.add("rep_13_doi_junk", "select p_partkey, '10.1000/' || p_partkey as doi from part")
def _(t):
    messy = t("part").select("p_partkey", F.concat(F.lit("10.1000/"), "p_partkey", F.lit("/full/html")).alias("doi"))
    return messy.select("p_partkey", F.regexp_replace("doi", "/(full|abstract|pdf|epdf)(/.*)?$", "").alias("doi"))


@P.add("rep_14_null_bad_years", "select o_orderkey, case when year(o_orderdate) between 1993 and 1997 then year(o_orderdate)::varchar end as year from orders")
def _(t):
    rows = t("orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("year"))
    return Q.null_where(rows, "year", ~F.col("year").rlike("^199[3-7]$"))


#: Venues, and whether they say a state only.
VENUES = (
    (" Working Paper ", True), ("draft", True), ("Under Review", True), ("submitted", True), ("R&R", True), ("Revise and Resubmit", True), ("reject and resubmit", True), ("work in progress", True), ("Job Market Paper", True), ("JMP", True),
    ("Forthcoming", False), ("accepted", False), ("in progress", False), ("Working Paper Series", False), ("Econometrica", False),
)
_VENUE_SQL = f"[{', '.join(repr(v) for v, _ in VENUES)}][o_orderkey % {len(VENUES)} + 1]"


@P.add("rep_15_state_venues", f"select o_orderkey, case when not [{', '.join(str(s).lower() for _, s in VENUES)}][o_orderkey % {len(VENUES)} + 1] then {_VENUE_SQL} end as venue from orders")
def _(t):
    venue = F.get(F.array(*(F.lit(v) for v, _ in VENUES)), (F.col("o_orderkey") % len(VENUES)).cast("int"))
    return Q.null_where(t("orders").select("o_orderkey", venue.alias("venue")), "venue", Q.state_venue(F.col("venue")))


@P.add("rep_16_short_abstracts", "select doc_id, case when length(trim(text)) >= 400 then text end as abstract from documents")
def _(t):
    return Q.null_where(t("documents").select("doc_id", F.col("text").alias("abstract")), "abstract", F.length(F.trim("abstract")) < 400)


@P.add("rep_17_draft_is_source", "select page_id, case when page_id % 4 <> 0 then url end as draft from pages")
def _(t):
    rows = t("pages").select("page_id", "url", F.when(F.col("page_id") % 4 == 0, F.col("url")).otherwise(F.concat("url", F.lit(""))).alias("draft"), (F.col("page_id") % 4 == 0).alias("same"))
    return Q.null_where(rows, "draft", F.col("same") & (F.col("draft") == F.col("url"))).select("page_id", "draft")


@P.add("rep_18_mojibake_columns", "select doc_id, text as head, lang from documents")
def _(t):
    garbled = t("documents").select("doc_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("head"), "lang")
    return garbled.withColumns({c: T.latin1_repair(F.col(c)) for c in ("head", "lang")})


@P.add("rep_19_seed_events", "select event_id from events where not (event_type = 'purchase' and user_id in (select user_id from events group by user_id having count(*) < 60))")
def _(t):
    seeds = t("events").groupBy("user_id").count().where("count < 60").select("user_id")
    gone = t("events").where("event_type = 'purchase'").join(seeds, "user_id", "left_semi").select("event_id")
    return t("events").join(gone, "event_id", "left_anti").select("event_id")


@P.add("rep_20_attach_orphans", "select o_orderkey, coalesce(min(l_suppkey), -1) as owner from orders left join lineitem on l_orderkey = o_orderkey and l_quantity > 20 group by o_orderkey")
def _(t):
    owner = t("lineitem").where("l_quantity > 20").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("m"))
    return t("orders").join(owner, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("m", F.lit(-1)).alias("owner"))


@P.add("rep_21_reset_hash", "select page_id, case when page_id % 6 <> 0 then md5(html) end as hash from pages")
def _(t):
    rows = t("pages").select("page_id", F.when(F.col("page_id") % 6 != 0, F.col("html")).alias("body"), F.md5("html").alias("hash"))
    return Q.null_where(rows, "hash", F.col("body").isNull()).select("page_id", "hash")


@P.add("rep_22_ordered_steps", """
    select o_orderkey, case when length(trim(v)) >= 4 and lower(trim(v)) <> 'submitted' then trim(v) end as venue from (select o_orderkey, case o_orderstatus when 'F' then ' Submitted' when 'P' then ' x ' else o_orderpriority || ' ' end as v from orders)
""")
def _(t):
    rows = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", " Submitted").when(F.col("o_orderstatus") == "P", " x ").otherwise(F.concat("o_orderpriority", F.lit(" "))).alias("venue"))
    steps = [lambda d: d.withColumn("venue", F.trim("venue")), lambda d: Q.null_where(d, "venue", Q.state_venue(F.col("venue"))), lambda d: Q.null_where(d, "venue", F.length("venue") < 4)]
    return Q.repaired(rows, steps)


@P.add("rep_23_false_events", "select event_id from events e where (select count(*) from events f where f.user_id = e.user_id and f.ts < e.ts) >= 2")
def _(t):
    before = F.count("*").over(Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.count("*").over(Window.partitionBy("user_id", "ts"))
    return t("events").withColumn("b", before).where("b >= 2").select("event_id")
