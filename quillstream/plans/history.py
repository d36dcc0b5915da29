"""Snapshots, status histories, change capture and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import udfs as U
from quillstream.operators import rows as R
from quillstream.plans.common import Plans

P = Plans()
#: Kinds of events in the place of statuses, lowest first.
RANKS = ("view", "click", "signup", "logout", "purchase")
_RANK = "coalesce(list_position(['view', 'click', 'signup', 'logout', 'purchase'], event_type), 0)"


def _rank():
    return R.status_rank(F.col("event_type"), RANKS)


@P.add("win_1_strict_advances", f"""
    select event_id, event_type from (select *, {_RANK} as r, max({_RANK}) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as b from events)
    where b is null or r > b or r = 0
""")
def _(t):
    return R.advances(t("events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], _rank(), "ts", "event_id").select("event_id", "event_type")


@P.add("win_2_latest_per_key", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def _(t):
    return R.latest(t("events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@P.add("win_4_top_four", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate from lineitem qualify row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber, l_partkey, l_suppkey) <= 4")
def _(t):
    return R.top(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"), ["l_orderkey"], 4, F.desc("l_shipdate"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))


@P.add("win_5_adjacent_titles", """
    select a, b from (select p_partkey as a, lead(p_partkey) over w as b, p_name as x, lead(p_name) over w as y from part window w as (partition by p_brand order by lower(p_name), p_partkey))
    where lower(x)[1:8] = lower(y)[1:8]
""")
def _(t):
    w = Window.partitionBy("p_brand").orderBy(F.lower("p_name"), "p_partkey")
    pairs = t("part").select(F.col("p_partkey").alias("a"), F.lead("p_partkey").over(w).alias("b"), F.col("p_name").alias("x"), F.lead("p_name").over(w).alias("y"))
    return pairs.where(F.left(F.lower("x"), F.lit(8)) == F.left(F.lower("y"), F.lit(8))).select("a", "b")


@P.add("win_6_changes_only", """
    select event_id from (select event_id, event_type, lag(event_type) over w as b, row_number() over w as n from events window w as (partition by user_id order by ts, event_id))
    where n = 1 or event_type is distinct from b
""")
def _(t):
    return R.changes(t("events"), ["user_id"], "event_type", "ts", "event_id").select("event_id")


@P.add("win_7_monotone_status", f"""
    select event_id, max({_RANK}) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)::int as effective from events
""")
def _(t):
    return R.effective_status(t("events"), ["user_id"], _rank(), "ts", "event_id").select("event_id", "effective")


@P.add("win_9_canonical", "select p_name, first(p_partkey order by p_retailprice desc, p_size desc, p_partkey) as canonical, count(*) as n from part group by p_name")
def _(t):
    best = F.min_by("p_partkey", F.struct(-F.col("p_retailprice"), -F.col("p_size"), "p_partkey"))
    return t("part").groupBy("p_name").agg(best.alias("canonical"), F.count("*").alias("n"))


@P.add("win_10_mutual_unique", """
    with p as (select distinct l_orderkey as a, l_partkey as b from lineitem where l_quantity >= 49)
    select a, b from (select a, b, count(*) over (partition by a) as x, count(*) over (partition by b) as y from p) where x = 1 and y = 1
""")
def _(t):
    return R.mutual_unique(t("lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).distinct(), "a", "b")


@P.add("win_11_candidate_count", "select c_custkey, count(*) over (partition by c_nationkey, c_mktsegment) as n from customer")
def _(t):
    return t("customer").select("c_custkey", F.count("*").over(Window.partitionBy("c_nationkey", "c_mktsegment")).alias("n"))


@P.add("win_12_prune_to_newest", "select event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 10")
def _(t):
    return R.top(t("events"), ["user_id"], 10, F.desc("ts"), F.desc("event_id")).select("event_id")


def pages_now_and_before(t):
    """Two states of the page table: some pages' second paragraph is edited, every eleventh page is new."""
    now = t("pages").select("page_id", "url", F.col("html").alias("content"))
    edited = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("content", "(?s)<p>.{10}", "<p>before")).otherwise(F.col("content"))
    return now, now.where("page_id % 11 <> 0").select("page_id", edited.alias("old"))


_PAGES = r"""with now as (select page_id, html as content from pages),
    before as (select page_id, case when page_id % 3 = 0 then regexp_replace(html, '<p>.{10}', '<p>before', 'gs') else html end as old from pages where page_id % 11 <> 0)
"""


@P.add("cdc_1_change_detection", _PAGES + """
    select page_id, sha256(content) as hash, sha256(content) is distinct from case when old is not null then sha256(old) end as changed
    from now left join before using (page_id)
""")
def _(t):
    now, before = pages_now_and_before(t)
    joined = now.join(before, "page_id", "left")
    digest = lambda c: F.sha2(c, 256)
    return joined.select("page_id", digest("content").alias("hash"), (~digest("content").eqNullSafe(digest("old"))).alias("changed"))


@P.add("cdc_1_page_text_hash")
def _(t):
    """The full chain: visible text, cut, normalised, hashed."""
    return t("pages").select("page_id", F.sha2(T.normalize_text(F.left(U.page_text("html"), F.lit(20000))), 256).alias("hash"))


@P.add("cdc_2_archive_on_change", _PAGES + "select page_id, md5(old) as archived from now join before using (page_id) where content <> old")
def _(t):
    now, before = pages_now_and_before(t)
    return now.join(before, "page_id").where("content <> old").select("page_id", F.md5("old").alias("archived"))


@P.add("cdc_3_touch_and_backfill", _PAGES + "select page_id, coalesce(nullif(old, ''), content) = content as same from now join before using (page_id)")
def _(t):
    now, before = pages_now_and_before(t)
    return now.join(before, "page_id").select("page_id", (F.coalesce(F.nullif("old", F.lit("")), "content") == F.col("content")).alias("same"))


@P.add("cdc_4_work_queue", "select page_id from (select page_id, md5(html) as h, case when page_id % 2 = 0 then md5(html) end as done from pages where page_id % 5 <> 0) where done is null or done <> h order by page_id limit 200")
def _(t):
    rows = t("pages").where("page_id % 5 <> 0").select("page_id", F.md5("html").alias("h")).withColumn("done", F.when(F.col("page_id") % 2 == 0, F.col("h")))
    return rows.where(~F.col("done").eqNullSafe(F.col("h")) & F.col("h").isNotNull()).orderBy("page_id").limit(200).select("page_id")


@P.add("cdc_5_mark_done", "select page_id, case when page_id % 4 = 0 then md5(html) else md5(url) end as done from pages")
def _(t):
    marks = t("pages").where("page_id % 4 = 0").select("page_id", F.md5("html").alias("done"))
    return R.upsert(t("pages").select("page_id", F.md5("url").alias("done")), marks, ["page_id"])


@P.add("cdc_6_choose_path", _PAGES + "select page_id, case when old is null then 'full' when old = content then 'none' when length(old) > 3 * length(content) then 'full' else 'diff' end as path from now left join before using (page_id)")
def _(t):
    now, before = pages_now_and_before(t)
    path = F.when(F.col("old").isNull(), "full").when(F.col("old") == F.col("content"), "none").when(F.length("old") > 3 * F.length("content"), "full").otherwise("diff")
    return now.join(before, "page_id", "left").select("page_id", path.alias("path"))


@P.add("cdc_7_rehash", "select page_id, md5(lower(html)) as h, case when page_id % 2 = 0 then md5(lower(html)) else md5(url) end as done from pages")
def _(t):
    old = t("pages").select("page_id", F.md5("html").alias("h"), F.when(F.col("page_id") % 2 == 0, F.md5("html")).otherwise(F.md5("url")).alias("done"), F.md5(F.lower("html")).alias("new"))
    return old.select("page_id", F.col("new").alias("h"), F.when(F.col("done") == F.col("h"), F.col("new")).otherwise(F.col("done")).alias("done"))


@P.add("evt_1_new_paper", """
    select event_id from events e where event_type not in ('view', 'purchase') and value > 10 and (select count(*) from events f where f.user_id = e.user_id and f.ts < e.ts) >= 2
        and not exists (select 1 from events g where g.user_id = e.user_id and g.event_type = e.event_type and g.ts < e.ts)
""")
def _(t):
    e = t("events").select("event_id", "user_id", "event_type", "ts", "value")
    at = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("user_id", "ts")
    kind = Window.partitionBy("user_id", "event_type")
    told = e.withColumn("before", F.count("*").over(at) - F.count("*").over(same)).withColumn("first", F.min("ts").over(kind))
    return told.where("event_type not in ('view', 'purchase') and value > 10 and before >= 2 and ts = first").select("event_id")


@P.add("evt_5_best_status", f"""
    select user_id, (['view', 'click', 'signup', 'logout', 'purchase'])[nullif(max({_RANK}), 0)] as best from events group by user_id
""")
def _(t):
    return t("events").groupBy("user_id").agg(F.max(_rank()).alias("r")).select("user_id", R.status_of(F.col("r"), RANKS).alias("best"))


@P.add("evt_7_baseline", "select user_id, count(*) >= 60 as ready from events group by user_id")
def _(t):
    return t("events").groupBy("user_id").agg((F.count("*") >= 60).alias("ready"))


@P.add("html_4_match_form")
def _(t):
    return t("pages").select("page_id", U.match_html("html").alias("form"))


@P.add("html_3_links")
def _(t):
    return t("pages").select("page_id", F.explode(U.page_links("html")).alias("l")).select("page_id", "l.url", "l.anchor", "l.block")


@P.add("html_2_main_text")
def _(t):
    return t("pages").select("page_id", U.main_text("html").alias("text"))


@P.add("bin_1_deflate", "select page_id, sha256(html) as hash from pages")
def _(t):
    return t("pages").select("page_id", F.sha2(U.inflated(U.deflated("html")), 256).alias("hash"))


@P.add("str_23_compact_diff")
def _(t):
    now, before = pages_now_and_before(t)
    return now.join(before, "page_id").select("page_id", U.compact_diff("old", "content").alias("diff"))
