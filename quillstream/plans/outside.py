"""Outside formats read and written, pages' texts and links, queues, and the data-quality catalogue by area."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import udfs as U
from quillstream.functions import urls as W
from quillstream.operators import groups as G
from quillstream.operators import quality as Q
from quillstream.plans.common import Plans
from quillstream.session import shared_folder
from quillstream.sources import tables as S
from quillstream.streaming import streams as X

P = Plans()


@P.add("src_4_people_csv", "select 'F' || c_custkey as first_name, 'L, ' || c_custkey as last_name, c_mktsegment as position, case when c_custkey % 2 = 0 then c_name end as affiliation, 'home' as page_type, 'http://x.org/' || c_custkey as url from customer")
def _(t):
    c = t("customer")
    rows = c.select(F.concat(F.lit(" F"), "c_custkey").alias("first_name"), F.concat(F.lit("L, "), "c_custkey").alias("last_name"), F.concat("c_mktsegment", F.lit(" ")).alias("position"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("affiliation"), F.lit("home").alias("page_type"), F.concat(F.lit("http://x.org/"), "c_custkey").alias("url"))
    path = f"{shared_folder(c.sparkSession)}/people"
    rows.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return S.read_people_csv(c.sparkSession, path)


@P.add("src_5_person_files", "select 'N' || n_nationkey as first_name, n_name as last_name, null::varchar as full_name, case when n_nationkey % 2 = 0 then 'Uni ' || n_name end as workplace, 'http://' || lower(n_name) || '.org' as homepage, 'p' || n_nationkey as handle from nation where n_nationkey % 5 > 0")
def _(t):
    """SRC-5, SRC-6: one file a person, in folders; those without a homepage are left out."""
    n = t("nation")
    lines = F.concat_ws("\n", F.lit("Template-Type: ReDIF-Person 1.0"), F.concat(F.lit("Name-First: N"), "n_nationkey"), F.concat(F.lit("Name-Last: "), "n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Workplace-Name: Uni "), "n_name", F.lit("\nWorkplace-Name: second"))), F.when(F.col("n_nationkey") % 5 > 0, F.concat(F.lit("Homepage: http://"), F.lower("n_name"), F.lit(".org"))), F.concat(F.lit("Short-Id: p"), "n_nationkey"))
    path = f"{shared_folder(n.sparkSession)}/persons"
    for k in range(2):
        n.where(F.col("n_regionkey") % 2 == k).select("n_nationkey", lines.alias("value")).repartitionById(64, "n_nationkey").select("value").write.text(f"{path}/{k}")
    return S.read_person_files(n.sparkSession, path, "*.txt")


@P.add("src_12_json_lines", "select event_id, event_type as verdict from events where event_id % 7 > 0")
def _(t):
    """SRC-12: a batch's results, one a line; broken lines are dropped."""
    e = t("events")
    good = F.to_json(F.struct("event_id", F.col("event_type").alias("verdict")))
    path = f"{shared_folder(e.sparkSession)}/results"
    e.select(F.when(F.col("event_id") % 7 > 0, good).otherwise(F.lit('{"event_id": 1, "verd')).alias("value")).write.text(path)
    return S.read_json_lines(e.sparkSession, path, "event_id long, verdict string")


@P.add("dml_14_sinks", "select p_partkey, p_name, 'a, \"quoted\" ' || p_brand as brand, p_retailprice from part")
def _(t):
    """The CSV and JSON sinks, each read back."""
    p = t("part").select("p_partkey", "p_name", F.concat(F.lit('a, "quoted" '), "p_brand").alias("brand"), "p_retailprice")
    spark, path = p.sparkSession, shared_folder(p.sparkSession)
    p.where("p_partkey % 2 = 0").write.csv(f"{path}/csv", header=True, escape='"')
    p.where("p_partkey % 2 = 1").write.json(f"{path}/json")
    schema = "p_partkey long, p_name string, brand string, p_retailprice double"
    return spark.read.csv(f"{path}/csv", schema=schema, header=True, escape='"').unionByName(spark.read.schema(schema).json(f"{path}/json"))


@P.add("strm_1_queue", "select event_id, user_id from events where event_type = 'purchase'")
def _(t):
    """Work drawn in micro-batches, each written under its number: a batch that is repeated replaces itself."""
    e = t("events")
    spark = e.sparkSession
    path = f"{shared_folder(spark)}/done"
    source = f"{shared_folder(spark)}/queue"
    e.select("event_id", "user_id", "event_type").repartition(3, "user_id").write.parquet(source)
    stream = spark.readStream.schema("event_id long, user_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(source)
    X.run_batches(stream.where("event_type = 'purchase'").drop("event_type"), lambda rows, k: rows.write.mode("overwrite").parquet(f"{path}/batch={k}"))
    return spark.read.parquet(path).drop("batch")


@P.add("html_1_visible_text")
def _(t):
    return t("pages").select("page_id", F.length(U.page_text("html")).alias("chars"), F.sha2(U.page_text("html"), 256).alias("text_hash"))


@P.add("html_5_title_on_old_page")
def _(t):
    """Titles of a page's present state that its state before had already; pages without one have none."""
    rows = t("pages").select("page_id", W.host(F.col("url")).alias("site"), "html")
    before = F.lag("html").over(Window.partitionBy("site").orderBy("page_id"))
    pairs = rows.withColumn("before", before).withColumn("title", T.match_form(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)))
    return pairs.select("page_id", F.coalesce(F.contains(U.match_html("before"), F.col("title")), F.lit(False)).alias("there"))


@P.add("str_27_fields_of_codes", """
    with c as (select p_partkey, p_type, unnest(case p_size % 4 when 0 then ['J', 'F'] when 1 then ['J'] when 2 then ['F', 'X'] else [] end) as code from part)
    select p_partkey, case code when 'J' then 'labour-economics' else 'international-economics' end as field from c where code in ('J', 'F')
    union select p_partkey, 'migration' from part where contains(lower(p_type), 'econ')
""")
def _(t):
    """Codes through a map to fields, and one field more by a word of the description."""
    codes = F.when(F.col("p_size") % 4 == 0, F.array(F.lit("J"), F.lit("F"))).when(F.col("p_size") % 4 == 1, F.array(F.lit("J"))).when(F.col("p_size") % 4 == 2, F.array(F.lit("F"), F.lit("X"))).otherwise(F.array().cast("array<string>"))
    slugs = F.create_map(F.lit("J"), F.lit("labour-economics"), F.lit("F"), F.lit("international-economics"))
    mapped = F.filter(F.transform(codes, lambda c: F.try_element_at(slugs, c)), lambda f: f.isNotNull())
    more = F.when(T.contains_any(F.col("p_type"), ("econ",)), F.array(F.lit("migration"))).otherwise(F.array().cast("array<string>"))
    return t("part").select("p_partkey", F.explode(F.array_union(mapped, more)).alias("field"))


@P.add("str_34_visible_hash")
def _(t):
    return t("pages").select("page_id", F.sha2(T.normalize_text(U.page_text("html")), 256).alias("hash"))


@P.add("evt_4_routed_changes", """
    with c as (select *, ['new', 'status_change', 'title_change', 'removed'][event_id % 4 + 1] as kind from events)
    select event_id, case kind when 'new' then 'save' when 'status_change' then 'status' when 'title_change' then 'rename' end as route, case when kind = 'title_change' then event_type else null end as old_title from c where kind <> 'removed'
""")
def _(t):
    """A list of changes to the job of each kind; what was removed is no job."""
    kinds = F.array(*map(F.lit, ("new", "status_change", "title_change", "removed")))
    routes = F.create_map(F.lit("new"), F.lit("save"), F.lit("status_change"), F.lit("status"), F.lit("title_change"), F.lit("rename"))
    c = t("events").withColumn("kind", F.get(kinds, (F.col("event_id") % 4).cast("int"))).withColumn("route", F.try_element_at(routes, F.col("kind")))
    return c.where("route is not null").select("event_id", "route", F.when(F.col("kind") == "title_change", F.col("event_type")).alias("old_title"))


@P.add("rep_12_merge_near_duplicates", """
    with n as (select p_partkey as id, p_brand as owner, p_name || ' in the long run of ' || lower(p_type) || case when p_partkey % 3 = 0 then ' I' when p_partkey % 3 = 1 then ' II' else '' end as title from part),
    o as (select *, lag(id) over w as before, lag(title) over w as was from n window w as (partition by owner order by title, id))
    select id as dup, before as canonical from o where was = title
""")
def _(t):
    """Neighbours of one owner, in order of title, that begin alike, are nearly equal and carry no differing numeral."""
    mark = F.when(F.col("p_partkey") % 3 == 0, " I").when(F.col("p_partkey") % 3 == 1, " II").otherwise("")
    n = t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("owner"), F.concat("p_name", F.lit(" in the long run of "), F.lower("p_type"), mark).alias("title"))
    w = Window.partitionBy("owner").orderBy("title", "id")
    o = n.withColumn("before", F.lag("id").over(w)).withColumn("was", F.lag("title").over(w)).where(F.left("was", F.lit(20)) == F.left("title", F.lit(20)))
    numeral = lambda c: F.regexp_extract(c, r"\b(I{1,3}|IV|V|[0-9]+)$", 1)
    near = o.where(numeral("title") == numeral("was")).where(U.sequence_ratio(T.words(F.col("was")), T.words(F.col("title"))) >= 0.92)
    return near.select(F.col("id").alias("dup"), F.col("before").alias("canonical"))


# The data-quality catalogue: each area one scan for its rules by row, and one query for its rules across rows.


@P.add("dq_people_rows", r"""
    with p as (select c_custkey as id, case c_custkey % 6 when 0 then 'J.' when 1 then '' when 2 then 'Renée' when 3 then 'JosÃ©' when 4 then '  Ann' else 'Bob' end as first, case c_custkey % 7 when 0 then 'K.' when 1 then ' ' else 'Smith' end as last,
        case when c_custkey % 5 = 0 then repeat('x', 260) when c_custkey % 5 = 1 then 'prof' else c_mktsegment end as affiliation, case when c_custkey % 4 = 0 then 'PROF' else 'none' end as position from customer)
    select id, 'initial' as rule from p where regexp_full_match(trim(first), '[A-Za-z]\.?') union all select id, 'blank_first' from p where trim(first) = '' union all select id, 'mojibake' from p where contains(first, 'Ã©')
    union all select id, 'untrimmed' from p where first <> trim(first) union all select id, 'blank_last' from p where trim(last) = '' union all select id, 'initial_last' from p where regexp_full_match(trim(last), '[A-Za-z]\.?')
    union all select id, 'long_affiliation' from p where length(affiliation) > 250 union all select id, 'affiliation_is_position' from p where lower(affiliation) = lower(position)
""")
def _(t):
    k = F.col("c_custkey")
    first = F.when(k % 6 == 0, "J.").when(k % 6 == 1, "").when(k % 6 == 2, "Renée").when(k % 6 == 3, "JosÃ©").when(k % 6 == 4, "  Ann").otherwise("Bob")
    last = F.when(k % 7 == 0, "K.").when(k % 7 == 1, " ").otherwise("Smith")
    p = t("customer").select(k.alias("id"), first.alias("first"), last.alias("last"), F.when(k % 5 == 0, F.repeat(F.lit("x"), F.lit(260))).when(k % 5 == 1, "prof").otherwise(F.col("c_mktsegment")).alias("affiliation"), F.when(k % 4 == 0, "PROF").otherwise("none").alias("position"))
    c = F.col
    return Q.violations(p, "id", {"initial": T.initial(c("first")).isNotNull(), "blank_first": Q.blank(c("first")), "mojibake": Q.mojibake(c("first")), "untrimmed": Q.untrimmed(c("first")), "blank_last": Q.blank(c("last")), "initial_last": T.initial(c("last")).isNotNull(), "long_affiliation": F.length("affiliation") > 250, "affiliation_is_position": F.lower("affiliation") == F.lower("position")})


@P.add("dq_papers_rows", r"""
    with p as (select o_orderkey as id, case o_orderkey % 5 when 0 then 'x' || o_orderkey when 1 then '1066' when 2 then '2150' else '2010' end as year, case when o_orderkey % 4 = 0 then ' Submitted ' else o_orderpriority end as venue,
        case o_orderkey % 3 when 0 then 'https://doi.org/10.1/x' when 1 then '10.1234/a b' else '10.1234/ab' end as doi, case when o_orderkey % 6 = 0 then 'short' else repeat('y', 50) end as abstract, case when o_orderkey % 2 = 0 then 'ftp://x' else 'http://x' end as draft from orders)
    select id, 'no_year' as rule from p where not regexp_full_match(year, '[0-9]{4}') union all select id, 'odd_year' from p where regexp_full_match(year, '[0-9]{4}') and (year::int < 1900 or year::int > 2100)
    union all select id, 'state_venue' from p where lower(trim(venue)) = 'submitted' union all select id, 'doi_is_url' from p where doi like 'http%' union all select id, 'doi_format' from p where not regexp_full_match(doi, '10\.[0-9]{4,9}/[^ ]+')
    union all select id, 'short_abstract' from p where length(abstract) < 40 union all select id, 'draft_scheme' from p where not regexp_matches(draft, '^https?://')
""")
def _(t):
    k, c = F.col("o_orderkey"), F.col
    year = F.when(k % 5 == 0, F.concat(F.lit("x"), k)).when(k % 5 == 1, "1066").when(k % 5 == 2, "2150").otherwise("2010")
    doi = F.when(k % 3 == 0, "https://doi.org/10.1/x").when(k % 3 == 1, "10.1234/a b").otherwise("10.1234/ab")
    p = t("orders").select(k.alias("id"), year.alias("year"), F.when(k % 4 == 0, " Submitted ").otherwise(c("o_orderpriority")).alias("venue"), doi.alias("doi"), F.when(k % 6 == 0, "short").otherwise(F.repeat(F.lit("y"), F.lit(50))).alias("abstract"), F.when(k % 2 == 0, "ftp://x").otherwise("http://x").alias("draft"))
    number = F.expr("try_cast(year as int)")
    is_year = c("year").rlike("^[0-9]{4}$")
    return Q.violations(p, "id", {"no_year": ~is_year, "odd_year": is_year & ((number < 1900) | (number > 2100)), "state_venue": Q.state_venue(c("venue")), "doi_is_url": c("doi").startswith("http"), "doi_format": ~c("doi").rlike(r"^10\.[0-9]{4,9}/[^ ]+$"), "short_abstract": F.length("abstract") < 40, "draft_scheme": ~c("draft").rlike("^https?://")})


@P.add("dq_events_across", """
    with e as (select *, lag(event_type) over w as b, lag(ts) over w as bt, first_value(event_id) over w as f from events window w as (partition by user_id order by ts, event_id)),
    last as (select user_id, arg_max(event_type, (ts, event_id)) as last_type, count(*) as n from events group by user_id)
    select event_id, 'no_baseline' as rule from e where f = event_id and event_type = 'purchase' union all select event_id, 'no_op' from e where b = event_type union all select event_id, 'same_second' from e where bt = ts
    union all select event_id, 'outranked' from e join last using (user_id) where event_type = 'purchase' and last_type = 'view' union all select event_id, 'negative' from e where value < 0
""")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t("events").withColumns({"b": F.lag("event_type").over(w), "bt": F.lag("ts").over(w), "n": F.row_number().over(w)})
    last = t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    e = e.join(last, "user_id")
    return Q.violations(e, "event_id", {"no_baseline": (F.col("n") == 1) & (F.col("event_type") == "purchase"), "no_op": F.col("b") == F.col("event_type"), "same_second": F.col("bt") == F.col("ts"), "outranked": (F.col("event_type") == "purchase") & (F.col("last_type") == "view"), "negative": F.col("value") < 0})


@P.add("dq_ownership", """
    with w as (select l_suppkey as owner, l_partkey as paper, count(*) as n from lineitem group by all)
    select owner as id, 'many_papers' as rule from w group by owner having count(*) > 100 union all select paper, 'many_authors' from w group by paper having count(*) > 20
    union all select s_suppkey, 'no_papers' from supplier where s_suppkey not in (select owner from w) union all select owner, 'unknown_owner' from (select distinct owner from w) where owner not in (select s_suppkey from supplier)
    union all select p_partkey, 'orphan' from part where p_partkey not in (select paper from w) union all select paper, 'twice' from w where n > 3
""")
def _(t):
    w = t("lineitem").groupBy(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("paper")).agg(F.count("*").alias("n"))
    name = lambda rows, c, rule: rows.select(F.col(c).alias("id"), F.lit(rule).alias("rule"))
    owners, papers = w.groupBy("owner").count(), w.groupBy("paper").count()
    found = name(owners.where("count > 100"), "owner", "many_papers").unionAll(name(papers.where("count > 20"), "paper", "many_authors"))
    found = found.unionAll(name(t("supplier").join(owners, F.col("s_suppkey") == F.col("owner"), "left_anti"), "s_suppkey", "no_papers")).unionAll(name(owners.join(t("supplier"), F.col("s_suppkey") == F.col("owner"), "left_anti"), "owner", "unknown_owner"))
    return found.unionAll(name(t("part").join(papers, F.col("p_partkey") == F.col("paper"), "left_anti"), "p_partkey", "orphan")).unionAll(name(w.where("n > 3"), "paper", "twice"))


@P.add("dq_rates", """
    select 'p_brand' as name, count(*) filter (where p_size % 3 = 0) / count(*) as rate, count(*) filter (where p_size % 3 = 0) / count(*) > 0.35 as broken from part
    union all select 'o_year', count(*) filter (where year(o_orderdate) < 1995) / count(*), count(*) filter (where year(o_orderdate) < 1995) / count(*) > 0.5 from orders
    union all select 'e_value', count(*) filter (where value < 10) / count(*), count(*) filter (where value < 10) / count(*) > 0.1 from events
""")
def _(t):
    """Shares of rows without a value, each against its bound."""
    rate = lambda rows, name, cond, bound: rows.agg((F.count_if(cond) / F.count("*")).alias("rate")).select(F.lit(name).alias("name"), "rate", (F.col("rate") > bound).alias("broken"))
    return rate(t("part"), "p_brand", F.col("p_size") % 3 == 0, 0.35).unionAll(rate(t("orders"), "o_year", F.year("o_orderdate") < 1995, 0.5)).unionAll(rate(t("events"), "e_value", F.col("value") < 10, 0.1))
