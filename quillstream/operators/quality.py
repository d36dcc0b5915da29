"""Data-quality invariants and repairs: each invariant is a frame of violations, each repair a frame to a frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import values as V

MOJIBAKE = r"[ÂÃ][\x{80}-\x{BF}]|â[\x{80}-\x{99}]"


def lowercase_start(c: Column) -> Column:
    return c.rlike("^[a-z]")


def blank(c: Column) -> Column:
    return F.trim(T.text(c)) == ""


def untrimmed(c: Column) -> Column:
    return c != F.trim(c)


def truncated(c: Column) -> Column:
    return c.rlike(r"(\.\.\.|…)\s*$")


def control_characters(c: Column) -> Column:
    return c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def markup(c: Column) -> Column:
    return c.rlike("<[a-zA-Z/][^>]*>")


def entities(c: Column) -> Column:
    return c.rlike("&(#[0-9]+|#x[0-9a-fA-F]+|[a-zA-Z]+);")


def mojibake(c: Column) -> Column:
    return c.rlike(MOJIBAKE)


def state_venue(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*V.STATE_VENUES)


def shared_by_several(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys with more than one owner, and how many."""
    return rows.groupBy(key).agg(F.countDistinct(owner).alias("owners")).where("owners > 1")


def violations(rows: DataFrame, id: str, rules: dict[str, Column]) -> DataFrame:
    """(id, rule) for every rule that a row breaks; one scan for all rules."""
    hit = F.filter(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items())), lambda x: x.isNotNull())
    return rows.select(id, F.explode(hit).alias("rule"))


def keep_earliest_of_shared(rows: DataFrame, key: str, owner: str, *order: Column) -> DataFrame:
    """Of a key that several owners have, the first row in ``order``; other keys' rows all stay."""
    w = Window.partitionBy(key)
    several = F.min(owner).over(w) != F.max(owner).over(w)
    rank = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("__s", several).withColumn("__n", rank).where("not __s or __n = 1").drop("__s", "__n")


def null_where(rows: DataFrame, column: str, bad: Column) -> DataFrame:
    return rows.withColumn(column, F.when(F.coalesce(bad, F.lit(False)), None).otherwise(F.col(column)))


def repaired(rows: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """REP-22: repairs in order, as one plan."""
    for step in steps:
        rows = step(rows)
    return rows


def real_publication(title: Column, authors: Column, venue: Column, status: Column, url: Column) -> Column:
    """Whether an extracted publication is one: no site's element or phrase, notice of rights, software or bare name.

    ``authors``: array of name parts (first ... last); null columns count as empty.
    """
    low, venue, url = F.trim(F.lower(T.text(title))), F.lower(T.text(venue)), F.lower(T.text(url))
    named = F.filter(F.coalesce(authors, F.array().cast("array<array<string>>")), lambda a: F.size(a) >= 1)
    whole = F.filter(named, lambda a: F.size(a) >= 2)
    first, last = (lambda a: F.trim(T.text(F.element_at(a, 1)))), (lambda a: F.trim(T.text(F.element_at(a, -1))))
    bad_name = F.exists(whole, lambda a: (first(a) == "") | last(a).rlike(r"^[A-Za-z]\.?$"))
    lasts = F.filter(F.transform(named, lambda a: F.lower(last(a))), lambda n: n != "")
    only_letters = (F.size(lasts) > 0) & F.forall(lasts, lambda n: F.length(n) < 2)
    in_title = T.words(F.regexp_replace(low, r"[^a-z\s]", ""))
    told = F.size(F.filter(lasts, lambda n: F.array_contains(in_title, n) & ~n.isin(*V.OVERLAP_STOPWORDS) & (F.length(n) >= 2)))
    short = (F.length(low) < 5) & (venue == "") & (T.text(status) == "")
    site = F.rtrim(low, F.lit(".")).isin(*V.SITE_WORDS) | T.contains_any(low, V.SITE_PHRASES) | low.startswith("©") | low.startswith("(c)")
    software = F.contains(venue, F.lit("github")) | (F.contains(url, F.lit("github.com")) & ~F.contains(url, F.lit("github.io"))) | T.contains_any(low, V.SOFTWARE_PHRASES)
    return ~(short | site | software | bad_name | only_letters | (told >= 2))


def link_faults(links: DataFrame, papers: DataFrame) -> DataFrame:
    """(id, rule) of saved links (id, paper, url, doi) against their papers (paper, doi): DOIs in another form, with steps of
    a path after them or after the paper's own, addresses that aren't of the web, and a paper's repeated ones."""
    own = links.join(papers.select("paper", F.col("doi").alias("own")), "paper", "left").withColumn("times", F.count("*").over(Window.partitionBy("paper", "url")))
    doi = F.col("doi")
    return violations(own, "id", {
        "doi_form": ~doi.startswith("10."), "doi_address": doi.rlike("(?i)^https?:"), "doi_path": doi.rlike("/(html|abstract|pdf|epdf|fulltext)$"), "doi_beyond_own": F.lower(doi).startswith(F.concat(F.lower("own"), F.lit("/"))),
        "scheme": ~F.col("url").rlike("(?i)^https?://"), "repeated": F.col("times") > 1,
    })


def snapshot_faults(snapshots: DataFrame, addresses: DataFrame, now: Column, most: int = 20_500) -> DataFrame:
    """(id, rule) of stored pages (id, address, at, content, hash, done_hash, done_at) and their addresses (address, active,
    stopped_at): of the future, hashes without what they stand for, texts over the limit, pages of unknown addresses, and
    ones fetched more than an hour after their address was stopped."""
    known = snapshots.join(addresses.withColumn("known", F.lit(True)), "address", "left")
    return violations(known, "id", {
        "future": F.col("at") > now, "done_without_time": F.col("done_hash").isNotNull() & F.col("done_at").isNull(), "hash_without_content": F.col("hash").isNotNull() & (T.text(F.col("content")) == ""),
        "too_long": F.length("content") > most, "unknown_address": F.col("known").isNull(), "after_stop": ~F.col("active") & (F.col("at") > F.col("stopped_at") + F.expr("interval 1 hour")),
    })


def health_faults(runs: DataFrame, calls: DataFrame, waiting: DataFrame, now: Column) -> DataFrame:
    """(rule, n) of a pipeline's liveness: runs (status, started_at, ended_at) that hang for over a day, no run ended in 48
    hours, and no call (called_at) for over six hours while pages wait (any row of ``waiting``)."""
    hours = lambda a: (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(a.cast("timestamp"))) / 3600
    told = runs.agg(F.count_if((F.col("status") == "running") & (hours(F.col("started_at")) > 24)).alias("hung"), F.max(F.when(F.col("status") == "completed", F.col("ended_at"))).alias("last_run"))
    told = told.join(calls.agg(F.max("called_at").alias("last_call"))).join(waiting.agg(F.count("*").alias("waiting")))  # three single rows
    late = lambda c, most: F.coalesce(hours(F.col(c)) > most, F.lit(True))
    rows = told.select(F.explode(F.array(
        F.struct(F.lit("hung_runs").alias("rule"), F.col("hung").cast("long").alias("n")), F.struct(F.lit("no_recent_run").alias("rule"), late("last_run", 48).cast("long").alias("n")),
        F.struct(F.lit("stalled").alias("rule"), F.when((F.col("waiting") > 0) & late("last_call", 6), F.col("waiting")).otherwise(0).cast("long").alias("n")),
    )).alias("r"))
    return rows.select("r.rule", "r.n")
