"""Who and what is the same: people of a paper, people across papers, papers by identifiers and by titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators import groups as G
from quillstream.operators.links import titled

#: Shared papers that two people of compatible names need, and those of whom one name shortens the other.
SHARED, SHARED_WEAK = 2, 5


def within_paper(authors: DataFrame) -> DataFrame:
    """(paper, id, kept): an author with the last name and a compatible first name of an earlier one is that one.

    ``authors``: paper, id (also the order), first, last.  Each is held against those before that stand
    for themselves.  A list of one paper's authors of one last name is folded at a time.
    """
    person = F.struct("id", "first")
    lists = authors.groupBy("paper", F.lower(F.trim("last")).alias("last")).agg(F.sort_array(F.collect_list(person)).alias("people"))
    shape = "array<struct<id:bigint,first:string,kept:bigint>>"

    def step(done, p):
        fits = F.filter(done, lambda q: (q["id"] == q["kept"]) & T.compatible_names(q["first"], p["first"]))
        kept = F.coalesce(F.get(fits, F.lit(0))["id"], p["id"])
        return F.concat(done, F.array(F.struct(p["id"].alias("id"), p["first"].alias("first"), kept.alias("kept"))))

    folded = lists.select("paper", F.explode(F.aggregate("people", F.array().cast(shape), step)).alias("p"))
    return folded.select("paper", "p.id", "p.kept")


def shared_papers(people: DataFrame, work: DataFrame) -> DataFrame:
    """Pairs a < b of people of one last name, with their first names, pages and number of shared papers.

    ``people``: id, first, last, urls (array); ``work``: paper, id.  Pairs start from shared papers, so people
    who share none never meet.
    """
    named = work.distinct().join(people.withColumn("key", F.lower(F.trim("last"))), "id")
    left, right = (named.select("paper", "key", F.col("id").alias(s), F.col("first").alias(f"first_{s}"), F.col("urls").alias(f"urls_{s}")) for s in "ab")
    pairs = left.join(right, ["paper", "key"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), *(F.first(f"{c}_{s}").alias(f"{c}_{s}") for c in ("first", "urls") for s in "ab"))


def conflicting(a, b):
    """Both have pages of their own and none in common."""
    a, b = (F.coalesce(c, F.array().cast("array<string>")) for c in (a, b))
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def same_person_pairs(people: DataFrame, work: DataFrame) -> DataFrame:
    """Pairs (a, b, rule): compatible names and SHARED papers, or a shortened name, SHARED_WEAK papers and no conflict of pages."""
    pairs = shared_papers(people, work)
    first = (F.col("first_a"), F.col("first_b"))
    fits = T.compatible_names(*first)
    rule = F.when(fits & (F.col("shared") >= SHARED), "compatible").when(~fits & (F.col("shared") >= SHARED_WEAK) & T.abbreviation(*first) & ~conflicting(F.col("urls_a"), F.col("urls_b")), "short")
    return pairs.withColumn("rule", rule).where("rule is not null").select("a", "b", "rule")


def merged_people(people: DataFrame, pairs: DataFrame) -> DataFrame:
    """(dup, canonical): of people whom ``pairs`` connect, the one with the longest first name (then the least id) stays."""
    roots = G.connected(pairs.select("a", "b"))
    members = people.join(roots, F.col("id") == F.col("node"))
    return G.survivors(members, "root", "id", F.length("first").desc(), F.col("id"))


def identifier_groups(rows: DataFrame, id: str, keys: list[str]) -> DataFrame:
    """(id, root) of rows that share a value of any of ``keys`` with another, directly or through others; nulls share nothing."""
    pairs = reduce(DataFrame.unionAll, [G.star_pairs(rows, k, id) for k in keys])
    found = G.connected(pairs)
    return found.select(F.col("node").alias(id), "root")


def _ranked(each: DataFrame, prefix: str) -> DataFrame:
    """Of each title's (authors, id, n, word) rows, its rarest words in its author set, as many as ``prefix`` of n says;
    those that no other title has take their places, and are left out as they meet nothing."""
    often = each.groupBy("authors", "word").agg(F.count("*").alias("often"))
    listed = each.join(often, ["authors", "word"]).groupBy("authors", "id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "word"))).alias("w"))
    return listed.select("authors", "id", "n", F.explode(F.expr(f"slice(w, 1, {prefix})")).alias("x")).where("x.often > 1").select("authors", "id", "n", "x.word")


def likely_pairs(titles: DataFrame, least: float, floor: float = 0.5) -> DataFrame:
    """(a, b) of titles of one author set that may be ``least`` similar by ``fuzzy_pairs``; the bounds lose none.

    ``titles``: authors, id, w (words), c (content words).  A ratio of r over n and m words needs r * (n + m) / 2 words
    in common, counted as often as they occur, so r / (2 - r) of either's.  An overlap of r needs r of the smaller
    set's content words; it counts only with a ratio of ``floor``, so neither has over (2 - floor) / floor as many words.
    """
    share = least / (2 - least)
    numbered = F.transform("w", lambda x, i: F.concat_ws("#", x, F.size(F.filter(F.slice("w", F.lit(1), i), lambda y: y == x))))
    rows = titles.select("authors", "id", numbered.alias("m"), F.array_distinct("c").alias("c"))
    words = rows.select("authors", "id", F.size("m").alias("n"), F.explode("m").alias("word"))
    heads = _ranked(words, f"n - cast(ceil({share} * n - 1e-9) as int) + 1")
    x, y = (heads.select("authors", "word", F.col("id").alias(s), F.col("n").alias(f"n_{s}")) for s in "ab")
    one = x.join(y, ["authors", "word"]).where((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b") - 1e-9)).select("authors", "a", "b")
    content = rows.select("authors", "id", F.size("c").alias("n"), F.explode("c").alias("word"))
    probe = _ranked(content, f"n - cast(ceil({least} * n - 1e-9) as int) + 1")
    met = probe.join(content.select("authors", "word", F.col("id").alias("other"), F.col("n").alias("m")), ["authors", "word"]).where("id <> other and n <= m")
    two = met.select("authors", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    pairs = one.unionByName(two).distinct()
    sides = [rows.select("authors", F.col("id").alias(s), F.col("m").alias(f"m_{s}"), F.col("c").alias(f"c_{s}")) for s in "ab"]
    both = pairs.join(sides[0], ["authors", "a"]).join(sides[1], ["authors", "b"])
    most = 2 * F.size(F.array_intersect("m_a", "m_b")) / (F.size("m_a") + F.size("m_b"))
    over = F.size(F.array_intersect("c_a", "c_b")) / F.least(F.size("c_a"), F.size("c_b"))
    return both.where((most >= least - 1e-9) | ((most >= floor - 1e-9) & (over >= least - 1e-9))).select("a", "b")


def fuzzy_pairs(papers: DataFrame, ratio, least: float) -> DataFrame:
    """Pairs (a, b, score) of titles of one author set that are ``least`` similar and share no identifier.

    ``papers``: id, title, authors (one value a set), doi.  Equal titles of a set are one row, under their
    least id, and pair with it at 1.  Others are compared in full only where ``likely_pairs`` lets them.
    """
    w = Window.partitionBy("authors", "title", "doi")
    lead = papers.withColumn("lead", F.min("id").over(w))
    equal = lead.where("id <> lead and doi is null").select(F.col("lead").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    leads = lead.where("id = lead").drop("lead")
    met = likely_pairs(leads.select("authors", "id", T.words(T.fuzzy_form(F.col("title"))).alias("w"), T.content_words(F.col("title")).alias("c")), least)
    left, right = (leads.select(F.col("id").alias(s), F.col("title").alias(f"title_{s}"), F.col("doi").alias(f"doi_{s}")) for s in "ab")
    pairs = met.join(left, "a").join(right, "b").where("not coalesce(doi_a = doi_b, false)")
    scored = pairs.withColumn("seq", ratio(T.words(T.fuzzy_form(F.col("title_a"))), T.words(T.fuzzy_form(F.col("title_b")))))
    scored = scored.withColumn("over", T.overlap(T.content_words(F.col("title_a")), T.content_words(F.col("title_b"))))
    score = F.when((F.col("over") > F.col("seq")) & (F.col("seq") < 0.5), F.col("seq")).otherwise(F.greatest("seq", "over"))
    return scored.withColumn("score", score).where(F.col("score") >= least).select("a", "b", "score").unionByName(equal)


def link_tiers(links: DataFrame, papers: DataFrame, least: float = 0.75) -> DataFrame:
    """(link, paper, tier): by title hash, else by identifier, else by the anchor's likeness to a title of the page's owner.

    ``links``: link, owner, anchor, doi; ``papers``: paper, owner, title, doi.  The least paper of equal ones.
    """
    hashed = papers.select(T.title_hash(F.col("title")).alias("h"), "paper").groupBy("h").agg(F.min("paper").alias("paper"))
    one = links.select("link", T.title_hash(F.col("anchor")).alias("h")).join(hashed, "h").select("link", F.lit(1).alias("tier"), "paper")
    dois = papers.where("doi is not null").groupBy("doi").agg(F.min("paper").alias("paper"))
    two = links.where("doi is not null").join(dois, "doi").select("link", F.lit(2).alias("tier"), "paper")
    found = G.written(one.unionByName(two).groupBy("link").agg(F.min(F.struct("tier", "paper")).alias("b")).select("link", "b.paper", F.when(F.col("b.tier") == 1, "title").otherwise("doi").alias("tier")))
    best = titled(links.join(found, "link", "left_anti").select("link", "owner", "anchor"), papers, least)
    return found.unionByName(best.select("link", "paper", F.lit("anchor").alias("tier")))
