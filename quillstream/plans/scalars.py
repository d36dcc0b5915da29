"""Text, URL, date, number, array and JSON functions on whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import udfs as U
from quillstream.functions import urls as W
from quillstream.plans.common import AS_OF, Plans

P = Plans()
_NORMAL = r"trim(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
_TEXT = _NORMAL.format("text")


def _docs(t):
    return t("documents")


_HEAD = "text"


@P.add("str_1_normalize_title", f"select doc_id, {_TEXT} as title from documents")
def _(t):
    return _docs(t).select("doc_id", T.normalize_title(F.expr(_HEAD)).alias("title"))


@P.add("str_2_title_hash", f"select doc_id, sha256({_TEXT}) as hash from documents")
def _(t):
    return _docs(t).select("doc_id", T.title_hash(F.expr(_HEAD)).alias("hash"))


@P.add("str_3_content_hash", "select doc_id, sha256(coalesce(nullif(lang, 'fr'), '') || '||' || coalesce(source, '') || '||' || text) as hash from documents")
def _(t):
    return _docs(t).select("doc_id", T.content_hash(F.nullif("lang", F.lit("fr")), F.col("source"), F.col("text")).alias("hash"))


_SUFFIX = "case p_size % 6 when 0 then ' — Working Paper' when 1 then ' [Forthcoming]' when 2 then ' (R & R) ' when 3 then ' -- new!' when 4 then ' revised edition' else '' end"


@P.add("str_4_clean_title", rf"""
    with s as (select p_partkey, lower(p_name) || {_SUFFIX} as x from part), a as (select p_partkey, regexp_replace(x, '\s*(?:--|—|–|―)\s*(?:working\s+paper|new(?:!)?)\s*$', '', 'i') as x from s),
    b as (select p_partkey, trim(regexp_replace(x, '\s*[\[\(]\s*(?:forthcoming|r\s*&\s*r)\s*[\]\)]\s*$', '', 'i')) as x from a)
    select p_partkey, upper(x[1]) || x[2:] as title from b
""")
def _(t):
    return t("part").select("p_partkey", T.clean_title(F.concat(F.lower("p_name"), F.expr(_SUFFIX))).alias("title"))


_PAGE = "'Skip to main content ' || p_name || ' “' || p_brand || '”  20' || ' ' || p_size || ' 1 2 3 (x ) ; Report Abuse'"


@P.add("str_5_normalize_text", rf"""
    with a as (select p_partkey, regexp_replace(replace(replace({_PAGE}, '“', '"'), '”', '"'), '\s+', ' ', 'g') as x from part),
    b as (select p_partkey, regexp_replace(regexp_replace(x, ' ([)\],;])', '\1', 'g'), '(\d) (\d)', '\1\2', 'g') as x from a)
    select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(x, 'skip to main content', '', 'gi'), 'report abuse', '', 'gi'), '\s+', ' ', 'g')) as text from b
""")
def _(t):
    return t("part").select("p_partkey", T.normalize_text(F.expr(_PAGE)).alias("text"))


@P.add("str_6_match_form", "select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as form from documents")
def _(t):
    return _docs(t).select("doc_id", T.match_form(F.col("text")).alias("form"))


@P.add("str_7_strip_accents", "select doc_id, strip_accents(text) as bare from documents")
def _(t):
    return _docs(t).select("doc_id", T.strip_accents(F.col("text")).alias("bare"))


@P.add("str_7_strip_accents_unicode", "select doc_id, strip_accents(text) as bare from documents")
def _(t):
    return _docs(t).select("doc_id", U.strip_accents(F.col("text")).alias("bare"))


_A, _B = _NORMAL.format("text"), _NORMAL.format("text[61:]")


@P.add("str_8_word_jaccard", f"""
    with w as (select doc_id, list_distinct(list_filter(string_split({_A}, ' '), lambda x: x <> '')) as a, list_distinct(list_filter(string_split({_B}, ' '), lambda x: x <> '')) as b from documents)
    select doc_id, case when len(a) > 0 and len(b) > 0 then round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) else 0.0 end as score from w
""")
def _(t):
    return _docs(t).select("doc_id", F.round(T.title_jaccard(F.col("text"), F.substring("text", 61, 1 << 30)), 9).alias("score"))


@P.add("str_9_overlap", f"""
    with w as (select doc_id, list_distinct(list_filter(string_split({_A}, ' '), lambda x: x <> '' and not list_contains(['the', 'a', 'an', 'of', 'on', 'in', 'at', 'to', 'for', 'and', 'or', 'by', 'with', 'from', 'as', 'is', 'are'], x))) as a,
        list_distinct(list_filter(string_split({_B}, ' '), lambda x: x <> '' and not list_contains(['the', 'a', 'an', 'of', 'on', 'in', 'at', 'to', 'for', 'and', 'or', 'by', 'with', 'from', 'as', 'is', 'are'], x))) as b from documents)
    select doc_id, case when least(len(a), len(b)) > 0 then round(len(list_intersect(a, b)) / least(len(a), len(b)), 9) else 0.0 end as score from w
""")
def _(t):
    a, b = (T.content_words(T.normalize_title(F.substring("text", k, 1 << 30))) for k in (1, 61))
    return _docs(t).select("doc_id", F.round(T.overlap(a, b), 9).alias("score"))


@P.add("str_10_sequence_ratio")
def _(t):
    return t("part").select("p_partkey", U.sequence_ratio(T.words(F.lower("p_name")), T.words(F.lower("p_type"))).alias("ratio"))


@P.add("str_17_title_on_page")
def _(t):
    title = T.match_form(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    return t("pages").select("page_id", U.title_on_page(title, U.match_html("html")).alias("found"))


@P.add("str_21_first_words", "select doc_id, array_to_string(string_split(text, ' ')[1:20], ' ') as head, length(text)::bigint as n from documents")
def _(t):
    return _docs(t).select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 20), " ").alias("head"), F.length("text").cast("long").alias("n"))


@P.add("str_22_segments")
def _(t):
    return _docs(t).select("doc_id", F.size(T.segments(F.col("text"))).cast("long").alias("n"))


@P.add("str_24_strip_prefix", "select c_custkey, nullif(regexp_replace(c_name, '^Customer#', ''), '') as bare from customer")
def _(t):
    return t("customer").select("c_custkey", T.strip_prefix(F.col("c_name"), "Customer#").alias("bare"))


@P.add("str_25_acronym", "select doc_id, replace(upper(array_to_string(list_transform(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda w: length(w) > 2), lambda w: w[1]), '')), 'ẞ', 'SS') as acronym from documents")
def _(t):
    return _docs(t).select("doc_id", T.acronym(F.col("text")).alias("acronym"))


@P.add("str_26_topic_codes")
def _(t):
    return t("part").select("p_partkey", F.array_join(T.topic_codes(F.concat_ws(" ", F.lit("tax and wage"), "p_name")), "").alias("codes"))


@P.add("str_30_labels", "select o_orderkey, upper(o_orderpriority[1]) || lower(o_orderpriority[2:]) as label, format('{} → {}', o_orderstatus, o_orderpriority) as detail from orders")
def _(t):
    return t("orders").select("o_orderkey", F.concat(F.upper(F.left("o_orderpriority", F.lit(1))), F.lower(F.substring("o_orderpriority", 2, 1000))).alias("label"), F.format_string("%s → %s", "o_orderstatus", "o_orderpriority").alias("detail"))


@P.add("str_19_repair", "select doc_id, text from documents")
def _(t):
    garbled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return _docs(t).select("doc_id", T.latin1_repair(garbled).alias("text"))


@P.add("str_32_signature")
def _(t):
    return t("customer").select("c_custkey", T.signature("key", F.col("c_name")).alias("token"))


@P.add("str_35_fuzzy_form", "select doc_id, regexp_replace(replace(replace(lower(text), '-', ''), '''s', ''), '[^\\pL\\pN_\\s]', '', 'g') as form from documents")
def _(t):
    return _docs(t).select("doc_id", T.fuzzy_form(F.col("text")).alias("form"))


@P.add("str_40_event_number", "select event_id, try_cast(regexp_extract('evt_' || event_id, '^evt_([0-9]+)$', 1) as bigint) as n from events")
def _(t):
    return t("events").select("event_id", F.expr("try_cast(regexp_extract(concat('evt_', event_id), '^evt_([0-9]+)$', 1) as bigint)").alias("n"))


# URLs

_LINK = "case p_size % 7 when 0 then 'https://www.nber.org/papers/w' || p_partkey when 1 then 'https://papers.ssrn.com/sol3/papers.cfm?abstract_id=' || p_partkey when 2 then 'https://doi.org/10.1257/aer.' || p_partkey || '#s1' when 3 then 'http:///dropbox.com/s/' || p_partkey when 4 then 'https://www.sciencedirect.com/science/article/pii/S00' || p_partkey when 5 then 'https://academic.oup.com/search?q=' || p_partkey else 'ftp://example.org/10.1000/supp/' || p_partkey || '/' end"


def _links(t):
    return t("part").select("p_partkey", F.expr(_LINK).alias("url"))


@P.add("url_1_parts", "select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)?', 1) as path from pages")
def _(t):
    return t("pages").select("page_id", W.host(F.col("url")).alias("host"), W.path(F.col("url")).alias("path"))


@P.add("url_2_trusted_type", f"""
    select p_partkey, case p_size % 7 when 0 then 'nber' when 1 then 'ssrn' when 2 then 'doi' when 4 then 'journal' end as type from part
""")
def _(t):
    return _links(t).select("p_partkey", W.trusted_type(F.col("url")).alias("type"))


@P.add("url_3_doi", "select p_partkey, case p_size % 7 when 1 then '10.2139/ssrn.' || p_partkey when 2 then '10.1257/aer.' || p_partkey end as doi from part")
def _(t):
    return _links(t).select("p_partkey", W.doi(F.col("url")).alias("doi"))


@P.add("url_4_pii", f"select p_partkey, nullif(regexp_extract({_LINK}, '/pii/([A-Z0-9]+)', 1), '') as pii from part")
def _(t):
    return _links(t).select("p_partkey", W.pii(F.col("url")).alias("pii"))


@P.add("url_7_absolute")
def _(t):
    links = t("pages").select("page_id", "url", F.explode(U.page_links("html")).alias("l"))
    return links.select("page_id", W.absolute(F.col("url"), F.col("l.url")).alias("url"))


@P.add("url_8_bare", "select page_id, rtrim(regexp_replace(url, '[?#].*$', ''), '/') as url from pages")
def _(t):
    return t("pages").select("page_id", W.bare(F.col("url")).alias("url"))


@P.add("url_9_fix_scheme", f"select p_partkey, regexp_replace({_LINK}, '^(https?):/+', '\\1://') as url from part")
def _(t):
    return _links(t).select("p_partkey", W.fix_scheme(F.col("url")).alias("url"))


@P.add("url_10_shared_hosts", "select page_id, regexp_matches(lower(regexp_extract(url, '//([^/?#:]+)', 1)), '(^|\\.)example\\.(com|org)$') as shared from pages")
def _(t):
    h = W.host(F.col("url"))
    return t("pages").select("page_id", (W.on_domain(h, "example.com") | W.on_domain(h, "example.org")).alias("shared"))


@P.add("url_12_web_only", f"select p_partkey, case when p_size % 7 < 6 then {_LINK} end as url from part")
def _(t):
    return _links(t).select("p_partkey", W.web_only(F.col("url")).alias("url"))


# Dates and numbers


@P.add("date_1_as_of", f"select event_id from events where ts >= timestamp '{AS_OF}' - interval 90 minute - interval 2 day")
def _(t):
    return t("events").where(F.col("ts") >= F.lit(AS_OF).cast("timestamp") - F.expr("interval 90 minutes") - F.expr("interval 2 days")).select("event_id")


@P.add("date_2_day", "select o_orderkey, o_orderdate::date as day from orders")
def _(t):
    return t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@P.add("date_3_hours_between", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', o_orderdate, l_shipdate) * 24 as hours from lineitem join orders on o_orderkey = l_orderkey where l_quantity = 50")
def _(t):
    joined = t("lineitem").where("l_quantity = 50").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr("timestampdiff(hour, o_orderdate, l_shipdate)").alias("hours"))


@P.add("date_4_next_run", "select event_id, ts + interval 1 hour * (event_id % 24) as next_run from events")
def _(t):
    return t("events").select("event_id", F.expr("ts + make_dt_interval(0, cast(event_id % 24 as int))").alias("next_run"))


@P.add("date_5_iso_text", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, try_strptime(rtrim(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'Z'), '%Y-%m-%dT%H:%M:%S') as back from events")
def _(t):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t("events").select("event_id", iso.alias("iso"), F.try_to_timestamp(F.rtrim(iso, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("back"))


_YEAR = "case p_size % 5 when 0 then 'c. 19' || lpad((p_size % 100)::varchar, 2, '0') when 1 then '20' || lpad((p_size % 100)::varchar, 2, '0') || '-05' when 2 then 'undated' when 3 then ' ' else null end"


@P.add("date_6_year", f"""
    with y as (select p_partkey, nullif(trim({_YEAR}), '') as y from part)
    select p_partkey, coalesce(nullif(regexp_extract(y, '(19|20)[0-9][0-9]'), ''), y[1:4]) as year from y
""")
def _(t):
    return t("part").select("p_partkey", T.coerce_year(F.expr(_YEAR.replace("::varchar", "").replace("(p_size % 100)", "cast(p_size % 100 as string)"))).alias("year"))


@P.add("date_7_plausible_year", "select o_orderkey, year(o_orderdate) + (o_orderkey % 40)::int between 1900 and 2026 as ok from orders")
def _(t):
    year = (F.year("o_orderdate") + F.expr("cast(o_orderkey % 40 as int)")).cast("string")
    return t("orders").select("o_orderkey", F.coalesce(year.rlike("^(19|20)[0-9]{2}$") & (year.try_cast("int") <= 2026), F.lit(False)).alias("ok"))


@P.add("math_2_total_fallback", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(nullif(l_tax, 0), l_discount + l_quantity) as total from lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(F.nullif("l_tax", F.lit(0.0)), F.col("l_discount") + F.col("l_quantity")).alias("total"))


@P.add("math_3_pages", "select o_orderstatus, ceil(count(*) / 20.0)::bigint as pages from orders group by o_orderstatus")
def _(t):
    return t("orders").groupBy("o_orderstatus").agg(F.ceil(F.count("*") / 20.0).alias("pages"))


# Arrays and JSON


@P.add("arr_1_filter_map", "select doc_id, replace(array_to_string(list_transform(list_filter(string_split(text, ' '), lambda w: length(w) > 6), lambda w: upper(w)), ' '), 'ẞ', 'SS') as long_words from documents")
def _(t):
    ws = F.filter(F.split("text", " "), lambda w: F.length(w) > 6)
    return _docs(t).select("doc_id", F.array_join(F.transform(ws, F.upper), " ").alias("long_words"))


@P.add("arr_2_ordered_distinct", "select doc_id, len(list_distinct(string_split(text, ' ')))::bigint as n from documents")
def _(t):
    return _docs(t).select("doc_id", F.size(F.array_distinct(F.split("text", " "))).cast("long").alias("n"))


@P.add("arr_3_name_parts", """
    with w as (select p_partkey, string_split(p_name, ' ') as w from part)
    select p_partkey, case when len(w) = 1 then '' else array_to_string(w[1:len(w) - 1], ' ') end as first, w[len(w)] as last from w
""")
def _(t):
    w = F.split("p_name", " ")
    return t("part").select("p_partkey", F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " ").alias("first"), F.element_at(w, -1).alias("last"))


@P.add("arr_4_csv_numbers", "select o_custkey, list_sum(list_transform(string_split(s, ','), lambda x: x::bigint))::bigint as total from (select o_custkey, string_agg(o_orderkey::varchar, ',') as s from orders group by o_custkey)")
def _(t):
    ids = F.split(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ","), ",")
    return t("orders").groupBy("o_custkey").agg(ids.alias("s")).select("o_custkey", F.aggregate(F.transform("s", lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@P.add("arr_5_longest", "select source, max(length(text))::bigint as n, first(doc_id order by length(text) desc, doc_id) as doc_id from documents group by source")
def _(t):
    return _docs(t).groupBy("source").agg(F.max(F.length("text")).cast("long").alias("n"), F.min_by("doc_id", F.struct(-F.length("text"), "doc_id")).alias("doc_id"))


@P.add("map_1_inverted_index", r"select doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') as text from documents where regexp_matches(text, '\S')")
def _(t):
    words = _docs(t).select("doc_id", F.posexplode(T.words(F.col("text"))).alias("p", "w"))
    index = words.groupBy("doc_id", "w").agg(F.sort_array(F.collect_list("p")).alias("at")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("m"))
    return index.select("doc_id", T.inverted_index_text(F.to_json("m")).alias("text"))


@P.add("json_1_field", "select event_id, (props::json->>'k')::int as k from events")
def _(t):
    return t("events").select("event_id", F.from_json("props", "struct<k:int>")["k"].alias("k"))


@P.add("json_2_explode_counts", "select k, count(*) as n from (select (props::json->>'k')::int as k from events) group by k")
def _(t):
    return t("events").select(F.explode(F.array(F.from_json("props", "struct<k:int>")["k"])).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@P.add("json_3_fenced", "select event_id, (props::json->>'k')::int as k from events")
def _(t):
    fenced = F.concat(F.lit("answer:\n```json\n"), "props", F.lit("\n```\n"))
    return t("events").select("event_id", F.from_json(T.fenced_json(fenced), "struct<k:int>")["k"].alias("k"))


@P.add("json_4_first_object", """
    select event_id, case when event_id % 4 <> 3 then (props::json->>'k')::int end as k, case when event_id % 4 in (1, 2) then event_type end as kind from events
""")
def _(t):
    """Objects in prose: flat, nested, with braces and quotes in strings, cut off."""
    kind = F.concat(F.lit('"kind": "'), "event_type", F.lit('"'))
    wrapped = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"a": '), "props", F.lit("}")))
    wrapped = wrapped.when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"b": {"c": [{"d": {}}]}, "a": '), "props", F.lit(", "), kind, F.lit("}")))
    wrapped = wrapped.when(F.col("event_id") % 4 == 2, F.concat(F.lit(r'{"x": "} \" { \\\\", "a": '), "props", F.lit(", "), kind, F.lit("}"))).otherwise(F.concat(F.lit('{"a": '), "props"))
    found = F.from_json(T.first_object(F.concat(F.lit("Sure! "), wrapped, F.lit(" and {so on"))), "struct<a:struct<k:int>,kind:string>")
    return t("events").select("event_id", found["a"]["k"].alias("k"), found["kind"].alias("kind"))


@P.add("json_7_actions", "select event_type, count(*) as n from events where (props::json->>'k')::int >= 50 group by event_type")
def _(t):
    issue = F.from_json(F.concat(F.lit('[{"severity":"'), F.when(F.from_json("props", "struct<k:int>")["k"] >= 50, "high").otherwise("low"), F.lit('"}]')), "array<struct<severity:string>>")
    return t("events").withColumn("i", F.explode(issue)).where("i.severity = 'high'").groupBy("event_type").agg(F.count("*").alias("n"))
