"""Remaining scans, lookups, composites and dashboards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import udfs as U
from quillstream.functions import urls as W
from quillstream.operators import rows as R
from quillstream.plans.common import AS_OF, Plans, total

P = Plans()


@P.add("src_1_table_scan", "select * from nation")
def _(t):
    return t("nation")


@P.add("src_2_first_row", "select s_suppkey, s_name from supplier order by s_suppkey limit 1")
def _(t):
    return t("supplier").orderBy("s_suppkey").limit(1).select("s_suppkey", "s_name")


@P.add("src_10_alias_fallback", """select event_id, coalesce(props::json->>'organic', props::json->>'items', props::json->>'k') as item from events""")
def _(t):
    first = F.coalesce(*(F.get_json_object("props", f"$.{k}") for k in ("organic", "items", "k")))
    return t("events").select("event_id", first.alias("item"))


@P.add("dml_15_get_or_create", "select c_custkey as k, case when c_custkey % 10 = 0 then c_name || '!' else c_name end as name from customer")
def _(t):
    old = t("customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    seen = t("customer").where("c_custkey % 4 = 0 or c_custkey % 10 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 10 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("name"))
    return R.upsert(old, seen, ["k"])


@P.add("dml_17_seed_dimension", "select n_nationkey as k, n_name as label from nation union select 100, 'Other'")
def _(t):
    have = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("label"))
    return R.insert_if_absent(have, have.unionByName(have.sparkSession.createDataFrame([(100, "Other")], "k int, label string")), ["k"])


@P.add("dml_19_only_if_null", "select o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') as p from orders")
def _(t):
    return t("orders").select("o_orderkey", F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("none")).alias("p"))


@P.add("dml_21_unfollow", "select distinct o_custkey, l_suppkey from orders join lineitem on l_orderkey = o_orderkey where l_quantity >= 49 and (o_custkey + l_suppkey) % 5 <> 0")
def _(t):
    follows = t("orders").join(t("lineitem").where("l_quantity >= 49"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    gone = follows.where("(o_custkey + l_suppkey) % 5 = 0")
    return follows.join(gone, ["o_custkey", "l_suppkey"], "left_anti")


@P.add("dml_22_import_matches", """
    select s_suppkey, coalesce(case when s_suppkey % 3 <> 0 then n_name end, 'Institute ' || (s_suppkey % 7)) as affiliation from supplier join nation on n_nationkey = s_nationkey
""")
def _(t):
    people = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("n_name")).alias("affiliation"))
    found = t("supplier").select("s_suppkey", F.concat(F.lit("Institute "), F.col("s_suppkey") % 7).alias("affiliation"))
    return R.backfill(people, found, ["s_suppkey"], ["affiliation"])


@P.add("str_11_title_similarity")
def _(t):
    x, y = F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")
    seq = U.sequence_ratio(T.words(T.fuzzy_form(x)), T.words(T.fuzzy_form(y)))
    scored = t("part").select("p_partkey", seq.alias("seq"), T.overlap(T.content_words(x), T.content_words(y)).alias("over"))
    return scored.select("p_partkey", F.when((F.col("over") > F.col("seq")) & (F.col("seq") < 0.5), F.col("seq")).otherwise(F.greatest("seq", "over")).alias("score"))


@P.add("str_18_link_match")
def _(t):
    return t("part").select("p_partkey", T.link_score(F.concat_ws(" ", "p_name", "p_brand"), F.col("p_name")).alias("score"))


@P.add("str_28_meaningful_words", r"""
    select doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9_]+'), lambda w: length(w) > 1 and not list_contains(
        ['a', 'an', 'the', 'of', 'and', 'in', 'on', 'to', 'for', 'is', 'are', 'was', 'with', 'by', 'from', 'or', 'at', 'as', 'it', 'its', 'be', 'do', 'does', 'did', 'not', 'no', 'but', 'if', 'so', 'can', 'how'], w)))), ' ') as words
    from documents
""")
def _(t):
    return t("documents").select("doc_id", F.array_join(F.array_sort(T.meaningful_words(F.col("text"))), " ").alias("words"))


@P.add("str_29_generic_anchor", "select p_partkey, p_size % 3 = 0 as generic from part")
def _(t):
    anchor = F.when(F.col("p_size") % 3 == 0, "Working Paper").otherwise(F.concat(F.lit("On "), "p_name"))
    return t("part").select("p_partkey", T.generic_anchor(anchor).alias("generic"))


@P.add("str_31_capitalise", "select p_partkey, upper(p_name[1]) || p_name[2:] as title from part")
def _(t):
    return t("part").select("p_partkey", T.capitalised(F.col("p_name")).alias("title"))


@P.add("str_37_text_blocks", "select l_orderkey, string_agg('#' || l_linenumber || ' ' || l_returnflag, '; ' order by l_linenumber, l_returnflag) as block from lineitem group by l_orderkey having count(*) >= 2")
def _(t):
    items = R.nested(t("lineitem"), ["l_orderkey"], "l_linenumber", "l_returnflag").where(F.size("items") >= 2)
    return items.select("l_orderkey", F.array_join(F.transform("items", lambda x: F.concat(F.lit("#"), x["l_linenumber"], F.lit(" "), x["l_returnflag"])), "; ").alias("block"))


@P.add("str_38_prompts", "select p_partkey, 'Title: ' || p_name || chr(10) || 'Venue: ' || p_type as prompt from part")
def _(t):
    return t("part").select("p_partkey", F.format_string("Title: %s\nVenue: %s", "p_name", "p_type").alias("prompt"))


@P.add("str_39_codes", "select c_custkey, upper(trim(' ' || lower(c_mktsegment) || ' ')) as code from customer")
def _(t):
    return t("customer").select("c_custkey", F.upper(F.trim(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" ")))).alias("code"))


@P.add("url_5_same_site", "select page_id, regexp_replace(lower(regexp_extract(url, '//([^/?#:]+)', 1)), '^www[.]', '') = 'ththre.example.com' as same from pages")
def _(t):
    return t("pages").select("page_id", W.same_site(F.col("url"), F.lit("https://www.ththre.example.com/x")).alias("same"))


@P.add("url_6_page_kind", "select page_id, case when regexp_matches(url, '(?i)/(fr|de|es)/') then 'foreign' when regexp_matches(url, '(?i)/en/') then 'english' else 'other' end as kind from pages")
def _(t):
    u = F.col("url")
    return t("pages").select("page_id", F.when(u.rlike("(?i)/(fr|de|es)/"), "foreign").when(u.rlike("(?i)/en/"), "english").otherwise("other").alias("kind"))


@P.add("url_13_resolve", "select p_partkey, coalesce(case when p_size % 2 = 0 then '10.1000/' || p_partkey end, '10.2000/S' || p_partkey) as doi from part")
def _(t):
    url = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://doi.org/10.1000/"), "p_partkey")).otherwise(F.concat(F.lit("https://www.sciencedirect.com/science/article/pii/S"), "p_partkey"))
    links = t("part").select("p_partkey", url.alias("url")).withColumn("pii", W.pii(F.col("url")))
    known = t("part").select(F.concat(F.lit("S"), "p_partkey").alias("pii"), F.concat(F.lit("10.2000/S"), "p_partkey").alias("found"))
    return links.join(known, "pii", "left").select("p_partkey", F.coalesce(W.doi(F.col("url")), "found").alias("doi"))


@P.add("url_14_first_subpages")
def _(t):
    links = t("pages").select("page_id", F.posexplode(U.page_links("html")).alias("k", "l")).select("page_id", "k", F.lower("l.url").alias("url"))
    kind = F.when(F.col("url").rlike("^/t"), "research").when(F.col("url").rlike("^/a"), "teaching").otherwise("other")
    return R.top(links.withColumn("kind", kind), ["page_id", "kind"], 1, F.col("k")).select("page_id", "kind", "url")


@P.add("evt_2_status_events", """
    with h as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, list_position(['A', 'N', 'R'], l_returnflag) as r from lineitem),
    m as (select *, max(r) over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding) as b from h)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, b::int as old, r::int as new from m where r > b
""")
def _(t):
    h = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", R.status_rank(F.col("l_returnflag"), ("A", "N", "R")).alias("r"))
    e = R.effective_status(h, ["l_orderkey"], F.col("r"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return e.where("r > before").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("before").alias("old"), F.col("r").alias("new"))


@P.add("evt_3_title_changes", "select event_id, b as old_title, event_type as new_title from (select event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is not null and b <> event_type")
def _(t):
    b = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").withColumn("b", b).where("b is not null and b <> event_type").select("event_id", F.col("b").alias("old_title"), F.col("event_type").alias("new_title"))


@P.add("enr_7_nested_affiliation", "select s_suppkey, case when s_suppkey % 2 = 0 then n_name else 'legacy' end as affiliation from supplier join nation on n_nationkey = s_nationkey")
def _(t):
    payload = F.when(F.col("s_suppkey") % 2 == 0, F.format_string('{"institutions":[{"name":"%s"},{"name":"x"}],"old":"legacy"}', "n_name")).otherwise(F.lit('{"institutions":[],"old":"legacy"}'))
    j = F.from_json(payload, "struct<institutions:array<struct<name:string>>,old:string>")
    s = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", j.alias("j"))
    return s.select("s_suppkey", F.coalesce(F.get("j.institutions", F.lit(0))["name"], "j.old").alias("affiliation"))


@P.add("enr_9_success_rate", "select count(*) filter (where n_chars > 1000) / count(*) as rate, count(*) as n from documents")
def _(t):
    return t("documents").agg((F.count_if(F.col("n_chars") > 1000) / F.count("*")).alias("rate"), F.count("*").alias("n"))


@P.add("json_5_nested_work", "select p_partkey, 'W' || p_partkey as work, p_brand as author, p_type as topic from part")
def _(t):
    payload = F.format_string('{"id":"https://x.org/W%d","authorships":[{"author":{"name":"%s"}}],"topics":[{"name":"%s","field":null}]}', "p_partkey", "p_brand", "p_type")
    j = F.from_json(payload, "struct<id:string,authorships:array<struct<author:struct<name:string>>>,topics:array<struct<name:string,field:struct<name:string>>>>")
    return t("part").select("p_partkey", j.alias("j")).select("p_partkey", T.strip_prefix(F.col("j.id"), "https://x.org/").alias("work"), F.col("j.authorships")[0]["author"]["name"].alias("author"), F.col("j.topics")[0]["name"].alias("topic"))


@P.add("srv_4_person_detail", """
    select s_suppkey, string_agg(l_partkey::varchar, ',' order by d desc, l_partkey) as papers from supplier join (select l_suppkey, l_partkey, max(l_shipdate) as d from lineitem group by all) on l_suppkey = s_suppkey group by s_suppkey
""")
def _(t):
    work = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_shipdate").alias("d"))
    newest = F.sort_array(F.collect_list(F.struct((-F.unix_timestamp("d")).alias("age"), "l_partkey")))
    return work.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(newest.alias("i")).select("s_suppkey", F.array_join(F.transform("i", lambda x: x["l_partkey"].cast("string")), ",").alias("papers"))


@P.add("srv_6g_worker", f"""
    select count(*) filter (where value < 30) as queued, count(*) filter (where value >= 30) as done, sum(case when ts >= timestamp '{AS_OF}' - interval 2 day then value::decimal(18,4) end)::double as tokens from events
""")
def _(t):
    recent = F.col("ts") >= F.lit(AS_OF).cast("timestamp") - F.expr("interval 2 days")
    return t("events").agg(F.count_if(F.col("value") < 30).alias("queued"), F.count_if(F.col("value") >= 30).alias("done"), total(F.when(recent, F.col("value"))).alias("tokens"))


@P.add("srv_6h_discovery", "select count(*) as pool, count(*) filter (where toxic = 1) as flagged from labels where doc_id in (select doc_id from documents where lang = 'en')")
def _(t):
    return t("labels").join(t("documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_semi").agg(F.count("*").alias("pool"), F.count_if(F.col("toxic") == 1).alias("flagged"))


@P.add("srv_7_review_log", "select event_id, ts, (props::json->>'k')::int as k from events where (props::json->>'k')::int > 90 and ts >= '2024-01-10' order by ts desc, event_id limit 50")
def _(t):
    k = F.from_json("props", "struct<k:int>")["k"]
    rows = t("events").withColumn("k", k).where((F.col("k") > 90) & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")))
    return R.page(rows.select("event_id", "ts", "k"), 1, 50, F.desc("ts"), F.col("event_id"))


@P.add("srv_11_at_risk", "select user_id, count(*) filter (where value < 20) as strikes from events group by user_id having count(*) filter (where value < 20) >= 10 order by strikes desc, user_id")
def _(t):
    return t("events").groupBy("user_id").agg(F.count_if(F.col("value") < 20).alias("strikes")).where("strikes >= 10").orderBy(F.desc("strikes"), "user_id")


@P.add("srv_13_unchecked", "select page_id, url from pages where page_id % 3 = 1 order by page_id limit 100")
def _(t):
    return t("pages").where("page_id % 3 = 1").orderBy("page_id").limit(100).select("page_id", "url")


@P.add("key_3_ordered_lists", "select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderdate, o_orderkey) as orders from orders group by o_custkey")
def _(t):
    items = R.nested(t("orders"), ["o_custkey"], "o_orderdate", "o_orderkey")
    return items.select("o_custkey", F.array_join(F.transform("items", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@P.add("key_5_flags", "select page_id, page_id % 4 = 0 as first_time, md5(html) is distinct from case when page_id % 4 <> 0 then md5(url) end as due from pages")
def _(t):
    done = F.when(F.col("page_id") % 4 != 0, F.md5("url"))
    return t("pages").select("page_id", done.isNull().alias("first_time"), (~F.md5("html").eqNullSafe(done)).alias("due"))


@P.add("key_6_active", "select page_id, url from pages where page_id % 7 <> 0")
def _(t):
    return t("pages").where("page_id % 7 <> 0").select("page_id", "url")


@P.add("eval_1_shared_names", "select n_name, count(*) as n, string_agg(s_name, ',' order by s_name) as names from supplier join nation on n_nationkey = s_nationkey group by n_name having count(*) >= 2")
def _(t):
    named = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return named.groupBy("n_name").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("s_name")), ",").alias("names")).where("n >= 2")


@P.add("eval_2_latest_by_label", "select event_type, event_id, value from events qualify row_number() over (partition by event_type order by event_id desc) = 1")
def _(t):
    return R.latest(t("events").select("event_type", "event_id", "value"), ["event_type"], F.desc("event_id"))


@P.add("strm_7_stuck_runs", f"select event_id from events where event_type = 'signup' and ts < timestamp '{AS_OF}' - interval 20 day")
def _(t):
    return t("events").where((F.col("event_type") == "signup") & (F.col("ts") < F.lit(AS_OF).cast("timestamp") - F.expr("interval 20 days"))).select("event_id")


@P.add("date_8_recency", f"select event_id, date_diff('hour', ts, timestamp '{AS_OF}') < 48 as fresh from events")
def _(t):
    hours = F.expr(f"timestampdiff(hour, date_trunc('hour', ts), timestamp_ntz '{AS_OF}')")
    return t("events").select("event_id", (hours < 48).alias("fresh"))
