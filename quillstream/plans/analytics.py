"""Counts, sums, histograms and dashboards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstream.operators import rows as R
from quillstream.plans.common import AS_OF, Plans, money, total

P = Plans()
def _now():
    return F.lit(AS_OF).cast("timestamp")



@P.add("agg_1_scalar_counts", "select count(*) as n, count(*) filter (where o_orderstatus = 'F') as finished, count(*) filter (where o_totalprice > 200000) as large, max(o_orderdate) as latest from orders")
def _(t):
    return t("orders").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.max("o_orderdate").alias("latest"))


@P.add("agg_2_distinct", "select count(distinct user_id) as users, count(distinct event_type) as kinds from events where value > 10")
def _(t):
    return t("events").where("value > 10").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("kinds"))


@P.add("agg_3_count_by_key", "select nullif(o_orderstatus, 'P') as status, count(*) as n from orders group by all")
def _(t):
    return t("orders").groupBy(F.nullif("o_orderstatus", F.lit("P")).alias("status")).agg(F.count("*").alias("n"))


@P.add("agg_4_conditional_sums", """
    select l_returnflag, sum(case when l_discount > 0.05 then 1 else 0 end)::bigint as discounted, coalesce(sum(case when l_tax > 9 then 1 end), 0)::bigint as none,
        sum(case when l_linestatus = 'F' then l_quantity::decimal(18,4) end)::double as finished from lineitem group by l_returnflag
""")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.coalesce(F.sum(F.when(F.col("l_tax") > 9, 1)), F.lit(0)).alias("none"), F.sum(F.when(F.col("l_linestatus") == "F", money("l_quantity"))).cast("double").alias("finished"))


@P.add("agg_5_cost_by_key", "select l_returnflag, l_linestatus, sum(l_quantity::decimal(18,4))::double as sum_qty, sum(l_extendedprice::decimal(18,4))::double as sum_price, count(*) as n from lineitem group by all")
def _(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(total("l_quantity").alias("sum_qty"), total("l_extendedprice").alias("sum_price"), F.count("*").alias("n"))


@P.add("agg_5_cost_per_run", """
    select o_orderkey, coalesce((select sum(l_extendedprice::decimal(18,4)) from lineitem where l_orderkey = o_orderkey)::double, 0) as cost from orders
""")
def _(t):
    cost = t("lineitem").groupBy("l_orderkey").agg(total("l_extendedprice").alias("c"))
    return t("orders").join(cost, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("c", F.lit(0.0)).alias("cost"))


@P.add("agg_6_daily", f"select ts::date as day, count(*) as n, sum(value::decimal(18,4))::double as value from events where ts >= timestamp '{AS_OF}' - interval 14 day group by day")
def _(t):
    return t("events").where(F.col("ts") >= _now() - F.expr("interval 14 days")).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), total("value").alias("value"))


@P.add("agg_7_horizons", f"""
    select event_type, count(*) filter (where ts >= timestamp '{AS_OF}' - interval 36 hour) as recent, count(*) filter (where ts >= timestamp '{AS_OF}' - interval 7 day) as week, count(*) filter (where ts >= timestamp '{AS_OF}' - interval 30 day) as month
    from events group by event_type
""")
def _(t):
    since = lambda i: F.count_if(F.col("ts") >= _now() - F.expr(f"interval {i}"))
    return t("events").groupBy("event_type").agg(since("36 hours").alias("recent"), since("7 days").alias("week"), since("30 days").alias("month"))


@P.add("agg_8_max_of_counts", "select max(n) as most, min(n) as least from (select o_custkey, count(*) as n from orders group by o_custkey)")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.min("n").alias("least"))


@P.add("agg_9_ordered_list", "select s_nationkey, string_agg(s_name, ',' order by s_suppkey) as names from supplier group by s_nationkey")
def _(t):
    return R.nested(t("supplier"), ["s_nationkey"], "s_suppkey", "s_name").select("s_nationkey", F.array_join(F.transform("items", lambda x: x["s_name"]), ",").alias("names"))


@P.add("agg_10_having", "select p_name, count(*) as n from part group by p_name having count(*) > 1")
def _(t):
    return t("part").groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1")


@P.add("agg_11_best_label", """
    select o_custkey, (['F', 'O', 'P'])[max(list_position(['F', 'O', 'P'], o_orderstatus))] as best from orders group by o_custkey
""")
def _(t):
    rank = F.max(R.status_rank(F.col("o_orderstatus"), ("F", "O", "P"))).alias("r")
    return t("orders").groupBy("o_custkey").agg(rank).select("o_custkey", R.status_of(F.col("r"), ("F", "O", "P")).alias("best"))


@P.add("agg_12_weighted_top5", """
    with w as (select user_id, (props::json->>'k')::int % 7 as code, sum(case when value = 0 then 0.5 else value end::decimal(18,4))::double as weight from events group by all)
    select user_id, code, weight from w qualify row_number() over (partition by user_id order by weight desc, code) <= 5
""")
def _(t):
    code = (F.from_json("props", "struct<k:int>")["k"] % 7).alias("code")
    w = t("events").groupBy("user_id", code).agg(total(F.when(F.col("value") == 0, 0.5).otherwise(F.col("value"))).alias("weight"))
    return R.top(w, ["user_id"], 5, F.desc("weight"), F.col("code"))


@P.add("agg_13_hosts", "select lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host, count(*) as n from pages group by host order by n desc, host limit 30")
def _(t):
    return t("pages").groupBy(F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(30)


@P.add("agg_14_mean_by_model", """
    select event_type, round(sum(value::decimal(18,4))::double / count(*), 6) as score, round(sum(case when value >= 50 then 1 else 0 end) / count(*), 6) as pass_rate,
        round(sum(value::decimal(18,4))::double / count(*) * 0.3 + 2.5, 6) as cost from events group by event_type
""")
def _(t):
    mean = total("value") / F.count("*")
    return t("events").groupBy("event_type").agg(F.round(mean, 6).alias("score"), F.round(F.count_if(F.col("value") >= 50) / F.count("*"), 6).alias("pass_rate"), F.round(mean * 0.3 + 2.5, 6).alias("cost"))


@P.add("agg_15_pareto", """
    with m as (select p_brand, min(p_retailprice) as cost, max(p_size) as score from part group by p_brand)
    select p_brand, cost, score from m qualify score > coalesce(max(score) over (order by cost, score desc, p_brand rows between unbounded preceding and 1 preceding), -1)
""")
def _(t):
    return R.pareto(t("part").groupBy("p_brand").agg(F.min("p_retailprice").alias("cost"), F.max("p_size").alias("score")), "cost", "score", "p_brand")


@P.add("agg_16_ratio", "select count(*) filter (where l_returnflag = 'R') / count(*) as rate, count(*) filter (where l_returnflag = 'R') / count(*) <= 0.5 as ok from lineitem")
def _(t):
    rate = F.count_if(F.col("l_returnflag") == "R") / F.count("*")
    return t("lineitem").agg(rate.alias("rate"), (rate <= 0.5).alias("ok"))


@P.add("agg_17_same_author_sets", """
    with a as (select l_orderkey, list_sort(list(distinct l_suppkey)) as s from lineitem group by l_orderkey having count(distinct l_suppkey) >= 2)
    select array_to_string(s, ',') as authors, count(*) as papers, min(l_orderkey) as first from a group by s having count(*) > 1
""")
def _(t):
    a = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("s")).where(F.size("s") >= 2)
    return a.groupBy("s").agg(F.count("*").alias("papers"), F.min("l_orderkey").alias("first")).where("papers > 1").select(F.array_join(F.col("s").cast("array<string>"), ",").alias("authors"), "papers", "first")


@P.add("agg_18_match_summary", "select quality, count(*) as n, count(*) filter (where toxic = 1) as toxic from labels group by quality")
def _(t):
    return t("labels").groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@P.add("agg_19_digest_groups", """
    select o_custkey, c_mktsegment, o_orderkey from (select *, row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate desc, o_orderkey) as n
        from orders join customer on c_custkey = o_custkey) where n = 1
""")
def _(t):
    o = R.latest(t("orders"), ["o_custkey", "o_orderstatus"], F.desc("o_orderdate"), F.col("o_orderkey"))
    return o.join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_custkey", "c_mktsegment", "o_orderkey")


@P.add("agg_20_relative_days", """
    select label, count(*) as n from (select case date_diff('day', ts::date, date '2024-01-30') when 0 then 'Today' when 1 then 'Yesterday' else strftime(ts, '%Y-%m-%d') end as label from events) group by label
""")
def _(t):
    ago = F.datediff(F.lit("2024-01-30").cast("date"), F.to_date("ts"))
    return t("events").groupBy(F.when(ago == 0, "Today").when(ago == 1, "Yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("label")).agg(F.count("*").alias("n"))


@P.add("agg_21_review_stats", "select event_type, count(*) as total, count(*) filter (where (props::json->>'k')::int > 50) as flagged, sum((props::json->>'k')::int)::bigint as corrections from events group by event_type")
def _(t):
    k = F.from_json("props", "struct<k:int>")["k"]
    return t("events").groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(k > 50).alias("flagged"), F.sum(k).alias("corrections"))


@P.add("agg_22_queue_eta", f"""
    select count(*) filter (where value < 50) as queue, count(*) filter (where ts >= timestamp '{AS_OF}' - interval 36 hour) as last, round(count(*) filter (where value < 50) / nullif(count(*) filter (where ts >= timestamp '{AS_OF}' - interval 36 hour) * 24, 0), 1) as eta from events
""")
def _(t):
    queue, last = F.count_if(F.col("value") < 50), F.count_if(F.col("ts") >= _now() - F.expr("interval 36 hours"))
    return t("events").agg(queue.alias("queue"), last.alias("last"), F.round(F.try_divide(queue, last * 24), 1).alias("eta"))


@P.add("agg_23_page_people", """
    with p as (select user_id from events where event_type = 'view' order by ts desc, event_id limit 20)
    select (select count(distinct user_id) from p) as page_people, (select count(distinct user_id) from events where event_type = 'view') as total_people
""")
def _(t):
    views = t("events").where("event_type = 'view'")
    page = R.page(views, 1, 20, F.desc("ts"), F.col("event_id")).agg(F.countDistinct("user_id").alias("page_people"))
    return page.crossJoin(views.agg(F.countDistinct("user_id").alias("total_people")))  # two single rows


@P.add("srv_6a_health", "select event_type, count(*) as n, max_by(event_id, event_id) as last_run, date_diff('second', min(ts), max(ts)) as span from events group by event_type")
def _(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_run"), F.expr("timestampdiff(second, date_trunc('second', min(ts)), date_trunc('second', max(ts)))").alias("span"))


@P.add("srv_6b_content", "select p_size as year, count(*) as n from part where p_size is not null group by p_size")
def _(t):
    return t("part").where("p_size is not null").groupBy(F.col("p_size").alias("year")).agg(F.count("*").alias("n"))


@P.add("srv_6c_coverage", """
    select count(*) as total, count(*) filter (where text is not null and text <> '') as with_text, count(*) filter (where n_chars >= 40) as with_abstract, count(*) filter (where lang = 'en') as english, count(distinct source) as sources from documents
""")
def _(t):
    return t("documents").agg(F.count("*").alias("total"), F.count_if(F.col("text").isNotNull() & (F.col("text") != "")).alias("with_text"), F.count_if(F.col("n_chars") >= 40).alias("with_abstract"), F.count_if(F.col("lang") == "en").alias("english"), F.countDistinct("source").alias("sources"))


@P.add("srv_6d_costs", """
    select coalesce(event_type, 'all') as call_type, count(*) as calls, sum(value::decimal(18,4))::double as cost from events group by grouping sets ((event_type), ())
""")
def _(t):
    return t("events").rollup("event_type").agg(F.count("*").alias("calls"), total("value").alias("cost")).select(F.coalesce("event_type", F.lit("all")).alias("call_type"), "calls", "cost")


@P.add("srv_6e_runs", """
    select o_orderkey, o_orderdate, coalesce(q, 0) as tokens, case when o_orderstatus = 'O' then date_diff('day', o_orderdate::date, date '1998-12-31') else days end as days from (
        select * from orders order by o_orderdate desc, o_orderkey limit 30) left join (
        select l_orderkey, sum(l_quantity::decimal(18,4))::double as q, date_diff('day', min(l_shipdate)::date, max(l_shipdate)::date) as days from lineitem group by l_orderkey) on l_orderkey = o_orderkey
""")
def _(t):
    per = t("lineitem").groupBy("l_orderkey").agg(total("l_quantity").alias("q"), F.datediff(F.max("l_shipdate").cast("date"), F.min("l_shipdate").cast("date")).cast("long").alias("days"))
    runs = t("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(30)
    days = F.when(F.col("o_orderstatus") == "O", F.datediff(F.lit("1998-12-31").cast("date"), F.col("o_orderdate").cast("date")).cast("long")).otherwise(F.col("days"))
    return runs.join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "o_orderdate", F.coalesce("q", F.lit(0.0)).alias("tokens"), days.alias("days"))


@P.add("srv_6f_activity", """
    select event_id, lag(event_type) over w || ' → ' || event_type as detail from events window w as (partition by user_id order by ts, event_id) order by ts desc, event_id desc limit 50
""")
def _(t):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").withColumn("before", before).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", F.concat("before", F.lit(" → "), "event_type").alias("detail"))


@P.add("strm_8_hourly_windows", "select time_bucket(interval 1 hour, ts) as hour, event_type, count(*) as n from events group by all")
def _(t):
    return t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@P.add("disc_1_batch_stats", "select count(*) as searched, count(*) filter (where toxic = 1) as found, count(*) filter (where quality = 0) as no_result, count(*) filter (where quality = 0 and toxic = 1) as errors from labels")
def _(t):
    return t("labels").agg(F.count("*").alias("searched"), F.count_if(F.col("toxic") == 1).alias("found"), F.count_if(F.col("quality") == 0).alias("no_result"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("errors"))
