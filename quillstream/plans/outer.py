"""SQLite results read and written, pages decoded from bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions import charset as C
from quillstream.functions import text as T
from quillstream.functions import udfs as U
from quillstream.plans.common import Plans
from quillstream.session import shared_folder
from quillstream.sources.sqlite import register

P = Plans()


def _saved(rows, table: str, times: int = 1) -> str:
    """The rows as SQLite files in the shared folder."""
    spark = rows.sparkSession
    register(spark)
    path = f"{shared_folder(spark)}/{table}"
    rows.write.format("sqlite_rows").option("path", path).option("table", table).mode("append").save()
    return path


@P.add("src_3_sqlite_write", "select o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderkey % 3 = 0 as third from orders where o_orderkey >= 100 and o_orderstatus in ('F', 'O')")
def _(t):
    """Orders written to SQLite, appended in two parts and read again, with the conditions run there."""
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", (F.col("o_orderkey") % 3 == 0).alias("third"))
    spark = o.sparkSession
    path = _saved(o.where("o_orderkey % 2 = 0"), "orders")
    o.where("o_orderkey % 2 = 1").write.format("sqlite_rows").option("path", path).option("table", "orders").mode("append").save()
    back = spark.read.format("sqlite_rows").schema(o.schema).option("path", path).option("table", "orders").load()
    return back.where((F.col("o_orderkey") >= 100) & F.col("o_orderstatus").isin("F", "O"))


@P.add("src_13_eval_rows", """
    select provider, count(*) as n, sum(tokens)::bigint as tokens, sum(success::int)::bigint as passed from (
        select 'p:' || event_type as provider, user_id as tokens, value >= 40 as success from events where user_id % 3 = (select max(user_id % 3) from events)) group by provider
""")
def _(t):
    """The rows of the latest evaluation, with JSON columns, from a SQLite table of all of them."""
    e = t("events")
    provider = F.to_json(F.struct(F.concat(F.lit("p:"), "event_type").alias("id"), F.lit("x").alias("label")))
    response = F.to_json(F.struct(F.struct(F.col("user_id").alias("total")).alias("tokenUsage")))
    path = _saved(e.select((F.col("user_id") % 3).alias("eval_id"), provider.alias("provider"), F.coalesce(F.col("value") >= 40, F.lit(False)).alias("success"), response.alias("response")), "eval_results")
    spark = e.sparkSession
    rows = spark.read.format("sqlite_rows").option("path", path).option("table", "eval_results").load()
    latest = rows.agg(F.max("eval_id")).head()[0]  # one number
    told = rows.where(F.col("eval_id") == latest).select(F.from_json("provider", "struct<id:string>")["id"].alias("provider"), "success", F.from_json("response", "struct<tokenUsage:struct<total:bigint>>")["tokenUsage"]["total"].alias("tokens"))
    return told.groupBy("provider").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum(F.col("success").cast("int")).cast("long").alias("passed"))


def _raw_pages(t):
    """Pages as bytes in five encodings, one of which they all say they have.  In that of one byte a letter, what it has none for is a question mark."""
    k = F.col("page_id") % 5
    wide = F.regexp_replace("html", r"[\x{10000}-\x{10FFFF}]", "?")
    narrow = F.regexp_replace("html", r"[^\x{0}-\x{7F}\x{A0}-\x{FF}]", "?")
    raw = F.when(k == 0, F.encode("html", "UTF-8")).when(k == 1, F.concat(F.lit(bytes([0xEF, 0xBB, 0xBF])), F.encode("html", "UTF-8")))
    raw = raw.when(k == 2, F.concat(F.lit(bytes([0xFF, 0xFE])), F.encode(wide, "UTF-16LE"))).when(k == 3, F.encode(wide, "UTF-16")).otherwise(F.encode(narrow, "ISO-8859-1"))
    text = F.when(k < 2, F.col("html")).when(k < 4, wide).otherwise(narrow)
    return t("pages").where("html is not null").select("page_id", raw.alias("raw"), text.alias("text"))


@P.add("bin_2_charsets", r"""
    select page_id, case page_id % 5 when 0 then 'utf-8' when 1 then 'utf-8-sig' when 2 then 'utf-16' when 3 then 'utf-16' else case when regexp_matches(html, '[\x{A0}-\x{FF}]') then 'cp1252' else 'utf-8' end end as charset,
        sha256(case page_id % 5 when 0 then html when 1 then html when 2 then regexp_replace(html, '[\x{10000}-\x{10FFFF}]', '?', 'g') when 3 then regexp_replace(html, '[\x{10000}-\x{10FFFF}]', '?', 'g') else regexp_replace(html, '[^\x{0}-\x{7F}\x{A0}-\x{FF}]', '?', 'g') end) as hash
    from pages where html is not null
""")
def _(t):
    return C.decoded(_raw_pages(t).select("page_id", "raw")).select("page_id", "charset", F.sha2("html", 256).alias("hash"))


@P.add("cdc_1_from_bytes")
def _(t):
    """The change hash of a page that came as bytes: charset, visible text, normal form, SHA-256."""
    return C.decoded(_raw_pages(t).select("page_id", "raw")).select("page_id", F.sha2(T.normalize_text(U.page_text("html")), 256).alias("hash"))
