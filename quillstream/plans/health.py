"""The quality catalogue of links, stored pages, liveness and the schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.operators import quality as Q
from quillstream.plans.common import AS_OF, Plans

P = Plans()

LINKS_SQL = """select o_orderkey as id, o_custkey as paper, case o_orderkey % 6 when 0 then 'ftp://x' when 1 then 'HTTPS://doi.org/1' else 'https://x.org/' || (o_orderkey % 4) end as url,
    case o_orderkey % 7 when 0 then 'https://doi.org/10.1/a' when 1 then '10.1/a/pdf' when 2 then '10.1/P' || o_custkey || '/s2' when 3 then 'doi:10.1' when 4 then null else '10.1/ok' end as doi from orders"""
OWN_SQL = "select c_custkey as paper, case when c_custkey % 3 > 0 then '10.1/p' || c_custkey end as doi from customer"


def _sql(t, name: str, query: str):
    t(name).createOrReplaceTempView(f"health_{name}")
    return t(name).sparkSession.sql(query.replace(f"from {name}", f"from health_{name}"))


@P.add("dq_links", f"""
    with l as ({LINKS_SQL}), o as ({OWN_SQL}), j as (select l.*, o.doi as own, count(*) over (partition by l.paper, url) as times from l left join o using (paper))
    select id, 'doi_form' as rule from j where not starts_with(doi, '10.') union all select id, 'doi_address' from j where regexp_matches(lower(doi), '^https?:') union all select id, 'doi_path' from j where regexp_matches(doi, '/(html|abstract|pdf|epdf|fulltext)$')
    union all select id, 'doi_beyond_own' from j where starts_with(lower(doi), lower(own) || '/') union all select id, 'scheme' from j where not regexp_matches(lower(url), '^https?://') union all select id, 'repeated' from j where times > 1
""")
def _(t):
    return Q.link_faults(_sql(t, "orders", LINKS_SQL), _sql(t, "customer", OWN_SQL))


@P.add("join_11_prefix", f"""
    with l as ({LINKS_SQL}), o as ({OWN_SQL}) select l.id, o.doi as own from l join o using (paper) where starts_with(lower(l.doi), lower(o.doi) || '/')
""")
def _(t):
    """Links whose DOI goes on where their paper's ends; a paper's links meet its own DOI only."""
    own = _sql(t, "customer", OWN_SQL).withColumnRenamed("doi", "own")
    links = _sql(t, "orders", LINKS_SQL).join(own, "paper")
    return links.where(F.startswith(F.lower("doi"), F.concat(F.lower("own"), F.lit("/")))).select("id", "own")


PAGES_SQL = """select page_id as id, page_id % 40 as address, html as content, page_id % 9 as k from pages"""


@P.add("dq_snapshots", f"""
    with s as (select *, timestamp '2024-01-31 00:00:00' + to_hours((k::int - 5) * 7) as fetched, case when k = 1 then null else content end as c, case when k < 6 then 'h' end as hash, case when k % 2 = 0 then 'd' end as done_hash, case when k % 4 = 0 then 1 end as done_at from ({PAGES_SQL})),
    a as (select n_nationkey as address, n_nationkey % 2 = 0 as active, case when n_nationkey % 3 > 0 then timestamp '2024-01-30 12:00:00' end as stopped_at from nation)
    select id, 'future' as rule from s where fetched > timestamp '2024-01-31 00:00:00' union all select id, 'done_without_time' from s where done_hash is not null and done_at is null union all select id, 'hash_without_content' from s where hash is not null and coalesce(c, '') = ''
    union all select id, 'too_long' from s where length(c) > 9000 union all select id, 'unknown_address' from s where address not in (select address from a)
    union all select id, 'after_stop' from s join a using (address) where not active and fetched > stopped_at + interval 1 hour
""")
def _(t):
    now = F.lit(AS_OF).cast("timestamp_ntz")
    s = _sql(t, "pages", PAGES_SQL)
    rows = s.select(
        "id", "address", (now + F.make_interval(hours=((F.col("k") - 5) * 7).cast("int"))).alias("at"), F.when(F.col("k") != 1, F.col("content")).alias("content"), F.when(F.col("k") < 6, "h").alias("hash"),
        F.when(F.col("k") % 2 == 0, "d").alias("done_hash"), F.when(F.col("k") % 4 == 0, 1).alias("done_at"),
    )
    n = F.col("n_nationkey")
    addresses = t("nation").select(n.cast("long").alias("address"), (n % 2 == 0).alias("active"), F.when(n % 3 > 0, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).alias("stopped_at"))
    return Q.snapshot_faults(rows, addresses, now, 9000)


@P.add("dq_liveness", """
    with r as (select event_type as status, ts as started_at, ts as ended_at from events), n as (select max(ts) + interval 30 hour as now from events)
    select 'hung_runs' as rule, count(*) filter (where status = 'click' and epoch(now) - epoch(started_at) > 86400)::bigint as n from r, n
    union all select 'no_recent_run', (coalesce(epoch(any_value(now)) - epoch(max(ended_at) filter (where status = 'view')) > 172800, true))::bigint from r, n
    union all select 'stalled', case when (epoch(any_value(now)) - epoch(max(started_at) filter (where status = 'purchase'))) > 21600 then (select count(*) from pages where page_id % 4 = 0) else 0 end from r, n
""")
def _(t):
    """Kinds of events in the place of states, a day and six hours after the last of them."""
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "completed").otherwise(F.col("event_type"))
    runs = t("events").select(status.alias("status"), F.col("ts").alias("started_at"), F.col("ts").alias("ended_at"))
    now = t("events").agg((F.max("ts") + F.expr("interval 30 hours")).alias("now")).head()["now"]  # one value
    return Q.health_faults(runs, t("events").where("event_type = 'purchase'").select(F.col("ts").alias("called_at")), t("pages").where("page_id % 4 = 0"), F.lit(now))


_KNOWN = ("event_id", "ts", "user_id", "event_type", "value", "props")


@P.add("dq_schema", " union all ".join(f"select '{c}' as name, (select column_type in ('BIGINT', 'DOUBLE', 'VARCHAR', 'TIMESTAMP') from (describe select * from events) where column_name = '{c}') as expected, count(*) - count({c}) as nulls, count(distinct {c}) as n from events" for c in _KNOWN))
def _(t):
    """Each column that the library reads: whether its type is as expected, and its rows' nulls and distinct values."""
    e = t("events")
    kinds = {f.name: f.dataType.simpleString() in ("bigint", "double", "string", "timestamp", "timestamp_ntz") for f in e.schema.fields}
    counts = e.agg(*(F.struct(F.lit(c).alias("name"), F.lit(kinds[c]).alias("expected"), F.count_if(F.col(c).isNull()).alias("nulls"), F.countDistinct(c).alias("n")).alias(c) for c in _KNOWN))
    return counts.select(F.explode(F.array(*_KNOWN)).alias("r")).select("r.*")
