"""Saving and merging: publications by title, people by names and shared papers, papers by identifiers, links to papers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import udfs as U
from quillstream.functions import values as V
from quillstream.operators import groups as G
from quillstream.operators import identity as I
from quillstream.operators import matching as M
from quillstream.operators import rows as R
from quillstream.plans.common import Plans

P = Plans()

FIRSTS = ("John", "J.", "Jon", "Mary Ann", "M.", "M. A.", "Maria", "Liz", "Elizabeth")


def _people(t):
    names = F.array(*map(F.lit, FIRSTS))
    urls = F.when(F.col("s_nationkey") % 2 == 1, F.array(F.concat(F.lit("h"), F.col("s_nationkey") % 5))).otherwise(F.array().cast("array<string>"))
    return t("supplier").select(F.col("s_suppkey").alias("id"), F.get(names, (F.col("s_suppkey") % 9).cast("int")).alias("first"), F.concat(F.lit("Fam"), F.col("s_suppkey") % 4).alias("last"), urls.alias("urls"))


def _work(t):
    return t("lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("id")).distinct()


PEOPLE_SQL = f"""people as (select s_suppkey as id, {list(FIRSTS)}[s_suppkey % 9 + 1] as first, 'Fam' || (s_suppkey % 4) as last,
    case when s_nationkey % 2 = 1 then ['h' || (s_nationkey % 5)] else [] end as urls from supplier),
    work as (select distinct l_orderkey as paper, l_suppkey as id from lineitem)"""


def compatible_sql(a: str, b: str) -> str:
    """Names word by word equal or an initial, as far as the shorter goes."""

    def words(x: str) -> str:
        return f"list_filter(string_split_regex(trim(regexp_replace(replace({x}, '-', ' '), '([A-Za-z])\\.([A-Za-z])', '\\1. \\2', 'g')), '\\s+'), lambda w: w <> '')"

    def initial(x: str) -> str:
        return f"(case when regexp_full_match(trim({x}), '[A-Za-z]\\.?') then lower(left(trim({x}), 1)) end)"

    x, y = words(a), words(b)
    p, q = f"({x})[i]", f"({y})[i]"
    agree = f"(lower({p}) = lower({q}) or coalesce({initial(p)} = lower(left({q}, 1)), false) or coalesce({initial(q)} = lower(left({p}, 1)), false))"
    return f"(least(len({x}), len({y})) > 0 and len(list_filter(range(1, least(len({x}), len({y})) + 1), lambda i: not {agree})) = 0)"


def short_sql(a: str, b: str) -> str:
    return f"(trim({a}) <> '' and trim({b}) <> '' and (contains(lower(trim({a})), lower(trim({b}))) or contains(lower(trim({b})), lower(trim({a})))))"


PAIRS_SQL = f"""{PEOPLE_SQL},
    shared as (select x.id as a, y.id as b, x.first as fa, y.first as fb, x.urls as ua, y.urls as ub, count(*) as n
        from work v join people x on v.id = x.id join work w on w.paper = v.paper join people y on w.id = y.id and x.id < y.id and x.last = y.last group by all),
    fit as (select *, {compatible_sql('fa', 'fb')} as ok from shared),
    pairs as (select a, b, case when ok and n >= 2 then 'compatible' when not ok and n >= 5 and {short_sql('fa', 'fb')} and not (len(ua) > 0 and len(ub) > 0 and len(list_intersect(ua, ub)) = 0) then 'short' end as rule from fit)"""
MERGE_SQL = """, e as (select a, b from chosen union select b, a from chosen), reach as (select a, a as b from e union select r.a, e.b from reach r join e on e.a = r.b),
    g as (select a as id, min(b) as root from reach group by a)
    select id as dup, canonical from (select id, first_value(id) over (partition by root order by length(first) desc, id) as canonical from g join people using (id)) where id <> canonical"""


@P.add("er_2_within_paper_authors", f"""
    with recursive {PEOPLE_SQL}, lists as (select paper, last, list({{'id': id, 'first': first}} order by id) as p from work join people using (id) group by paper, last),
    step as (select paper, last, p, 1 as k, [p[1].id] as kept from lists union all
        select paper, last, p, k + 1, list_append(kept, coalesce(p[list_filter(range(1, k + 1), lambda j: kept[j] = p[j].id and {compatible_sql('p[j].first', 'p[k + 1].first')})[1]].id, p[k + 1].id)) from step where k < len(p))
    select paper, unnest(p).id as id, unnest(kept) as kept from step where k = len(p)
""")
def _(t):
    return I.within_paper(_work(t).join(_people(t), "id"))


@P.add("er_3_same_person_pairs", f"with {PAIRS_SQL} select a, b, rule from pairs where rule is not null")
def _(t):
    return I.same_person_pairs(_people(t), _work(t))


@P.add("rep_7_merge_compatible_names", f"with recursive {PAIRS_SQL}, chosen as (select a, b from pairs where rule = 'compatible') {MERGE_SQL}")
def _(t):
    pairs = I.same_person_pairs(_people(t), _work(t)).where("rule = 'compatible'")
    return I.merged_people(_people(t), pairs)


@P.add("rep_8_merge_short_names", f"with recursive {PAIRS_SQL}, chosen as (select a, b from pairs where rule = 'short') {MERGE_SQL}")
def _(t):
    pairs = I.same_person_pairs(_people(t), _work(t)).where("rule = 'short'")
    return I.merged_people(_people(t), pairs)


@P.add("rep_5_merge_shared_identifier", """
    with n as (select c_custkey as id, case when c_custkey % 5 > 0 then floor(c_acctbal / 3)::bigint end as k from customer)
    select id as dup, c as canonical from (select id, min(id) over (partition by k) as c from n where k is not null) where id <> c
""")
def _(t):
    n = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 > 0, F.floor(F.col("c_acctbal") / 3)).alias("k")).where("k is not null")
    return G.survivors(n, "k", "id", F.col("id"))


@P.add("rep_6_merge_exact_names", f"""
    with {PEOPLE_SQL}, n as (select id, lower(first || ' ' || last) as name, count(*) as papers from people join work using (id) group by all)
    select id as dup, c as canonical from (select id, first_value(id) over (partition by name order by papers desc, id) as c from n) where id <> c
""")
def _(t):
    n = _people(t).join(_work(t), "id").groupBy("id", F.lower(F.concat_ws(" ", "first", "last")).alias("name")).agg(F.count("*").alias("papers"))
    return G.survivors(n, "name", "id", F.desc("papers"), F.col("id"))


@P.add("set_3_conflicting_pages", f"""
    with {PEOPLE_SQL} select x.id as a, y.id as b, len(x.urls) > 0 and len(y.urls) > 0 and len(list_intersect(x.urls, y.urls)) = 0 as conflict from people x join people y on y.id = x.id + 1
""")
def _(t):
    p = _people(t)
    other = p.select((F.col("id") - 1).alias("before"), F.col("id").alias("b"), F.col("urls").alias("theirs"))
    return p.join(other, F.col("id") == F.col("before")).select(F.col("id").alias("a"), "b", I.conflicting(F.col("urls"), F.col("theirs")).alias("conflict"))


_IDS = """n as (select c_custkey as id, case when c_custkey % 3 > 0 then floor(c_acctbal * 10)::bigint % 1777 end as x, case when c_custkey % 3 < 2 then floor(c_acctbal * 100)::bigint % 2003 end as y from customer),
    e as (select id as a, min(id) over (partition by x) as b from n where x is not null union select id, min(id) over (partition by y) from n where y is not null),
    s as (select a, b from e where a <> b union select b, a from e where a <> b), reach as (select a, a as b from s union select r.a, s.b from reach r join s on s.a = r.b)"""


def _ids(t):
    key = lambda scale, size: F.floor(F.col("c_acctbal") * scale) % size
    return t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, key(10, 1777)).alias("x"), F.when(F.col("c_custkey") % 3 < 2, key(100, 2003)).alias("y"))


@P.add("er_4_identifier_groups", f"with recursive {_IDS}, g as (select a as id, min(b) as root from reach group by a) select root, string_agg(id::varchar, ',' order by id) as ids from g group by root")
def _(t):
    groups = R.nested(I.identifier_groups(_ids(t), "id", ["x", "y"]), ["root"], "id")
    return groups.select("root", F.array_join(F.transform("items", lambda x: x["id"].cast("string")), ",").alias("ids"))


@P.add("set_2_transitive_groups", f"with recursive {_IDS} select n.id, coalesce(min(b), n.id) as root from n left join reach on a = n.id group by n.id")
def _(t):
    n = _ids(t)
    return n.select("id").join(I.identifier_groups(n, "id", ["x", "y"]), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


@P.add("er_5_fuzzy_titles")
def _(t):
    """Papers (parts) of one set of authors (the suppliers of their dearest sales)."""
    top = t("lineitem").where("l_quantity >= 49").groupBy(F.col("l_partkey").alias("id")).agg(F.array_join(F.sort_array(F.collect_set((F.col("l_suppkey") % 12).cast("string"))), ",").alias("authors"))
    papers = t("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title"), F.when(F.col("p_size") % 7 == 0, F.col("p_brand")).alias("doi")).join(top, "id")
    return I.fuzzy_pairs(papers, U.sequence_ratio, 0.85)


@P.add("er_1_save_publications", f"""
    with raw as (select p_partkey as id, p_name || case p_partkey % 4 when 0 then ' (forthcoming)' when 1 then ' — working paper' else '' end as title, case when p_size % 3 > 0 then p_brand end as venue from part),
    cleaned as (select id, venue, trim(regexp_replace(regexp_replace(title, '(?i)\\s*(?:--|—|–|―)\\s*(?:{V.TITLE_STATES.replace("'", "''")})\\s*$', ''), '(?i)\\s*[\\[\\(]\\s*(?:{V.TITLE_STATES.replace("'", "''")})\\s*[\\]\\)]\\s*$', '')) as title from raw),
    hashed as (select id, venue, upper(left(title, 1)) || substr(title, 2) as title, sha256(lower(title)) as h from cleaned where length(title) >= 8),
    known as (select h, min(id) as id, arg_min(venue, id) filter (venue is not null) as venue from hashed where id % 10 < 2 group by h),
    seen as (select h, min(id) as id, arg_min(venue, id) filter (venue is not null) as venue, count(*) as n from hashed where id % 10 >= 2 group by h)
    select coalesce(k.h, s.h) as title_hash, coalesce(k.id, s.id) as id, k.id is null as is_new, coalesce(k.venue, s.venue) as venue, coalesce(s.n, 0)::bigint as seen from known k full join seen s on s.h = k.h
""")
def _(t):
    """Clean, leave out what is no title, hash, keep one of each hash, fill what known papers lack."""
    state = F.when(F.col("p_partkey") % 4 == 0, " (forthcoming)").when(F.col("p_partkey") % 4 == 1, " — working paper").otherwise("")
    raw = t("part").select(F.col("p_partkey").alias("id"), T.clean_title(F.concat("p_name", state)).alias("title"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).alias("venue"))
    hashed = raw.where(F.length("title") >= 8).withColumn("title_hash", T.title_hash(F.col("title")))
    filled = lambda: F.min_by(F.col("venue"), F.when(F.col("venue").isNotNull(), F.col("id")))
    known = hashed.where("id % 10 < 2").groupBy("title_hash").agg(F.min("id").alias("known_id"), filled().alias("known_venue"))
    seen = hashed.where("id % 10 >= 2").groupBy("title_hash").agg(F.min("id").alias("new_id"), filled().alias("new_venue"), F.count("*").alias("n"))
    both = known.join(seen, "title_hash", "full")
    return both.select("title_hash", F.coalesce("known_id", "new_id").alias("id"), F.col("known_id").isNull().alias("is_new"), F.coalesce("known_venue", "new_venue").alias("venue"), F.coalesce("n", F.lit(0)).alias("seen"))


def _page_titles(t):
    """Titles of pages (suppliers) in an earlier and a later state."""
    early = F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    sales = t("lineitem").where("l_quantity >= 49").join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand")).alias("title")), "l_partkey")
    sides = sales.groupBy(F.col("l_suppkey").alias("page"), "title").agg(F.bool_or(early).alias("was"), F.bool_or(~early).alias("is"))
    return sides.where("was and not is").select("page", F.col("title").alias("old")), sides.where("is and not was").select("page", F.col("title").alias("new"))


@P.add("er_7_renames")
def renames(t):
    """Titles that went and came on one page: the best pairs of half their words, each title once, artefacts left out."""
    old, new = _page_titles(t)
    word = lambda c: F.explode(F.array_distinct(T.words(T.normalize_title(F.col(c))))).alias("word")
    met = old.select("page", "old", word("old")).join(new.select("page", "new", word("new")), ["page", "word"]).select("page", "old", "new").distinct()
    scored = met.withColumn("score", T.title_jaccard(F.col("old"), F.col("new"))).where("score >= 0.5").where(T.title_renamed(F.col("old"), F.col("new")))

    return M.greedy(scored, "page", "old", "new", "score")


@P.add("evt_3_rename_events")
def _(t):
    """An event for each title that took another's place on its page, under the least paper of the old title."""
    papers = t("part").groupBy(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand")).alias("old")).agg(F.min("p_partkey").alias("paper"))
    return renames(t).join(papers, "old").select("paper", "page", F.lit("title_change").alias("kind"), F.col("old").alias("old_title"), F.col("new").alias("new_title"))


@P.add("er_11_last_name_in_tokens", """
    with c as (select c_custkey, lower(string_split(c_name, '#')[2]) as last from customer), s as (select s_suppkey, unnest(list_distinct(string_split(lower(s_name), '#'))) as token from supplier)
    select c_custkey, s_suppkey from c join s on token = last
""")
def _(t):
    c = t("customer").select("c_custkey", F.lower(F.element_at(F.split("c_name", "#"), 2)).alias("last"))
    s = t("supplier").select("s_suppkey", F.explode(F.array_distinct(F.split(F.lower("s_name"), "#"))).alias("token"))
    return c.join(s, F.col("token") == F.col("last")).select("c_custkey", "s_suppkey")


@P.add("rep_11_clean_titles", f"""
    with raw as (select p_partkey as id, p_name || ' ' || lower(p_type) || case p_partkey % 5 when 0 then ' (forthcoming)' when 1 then '...' else '' end as title, p_brand as brand from part),
    fixed as (select id, brand, trim(regexp_replace(regexp_replace(title, '(?i)\\s*[\\[\\(]\\s*(?:{V.TITLE_STATES.replace("'", "''")})\\s*[\\]\\)]\\s*$', ''), '\\s*(\\.\\.\\.|…)\\s*$', '')) as title from raw)
    select id, upper(left(title, 1)) || substr(title, 2) as title, min(id) over (partition by brand, title) as canonical from fixed
""")
def _(t):
    """Titles without states and marks of truncation; those that then collide have the least id as their canonical one."""
    end = F.when(F.col("p_partkey") % 5 == 0, " (forthcoming)").when(F.col("p_partkey") % 5 == 1, "...").otherwise("")
    raw = t("part").select(F.col("p_partkey").alias("id"), F.concat(F.concat_ws(" ", "p_name", F.lower("p_type")), end).alias("title"), "p_brand")
    fixed = raw.withColumn("title", T.latin1_repair(T.clean_title(F.regexp_replace("title", r"\s*(\.\.\.|…)\s*$", ""))))
    return fixed.select("id", "title", F.min("id").over(Window.partitionBy("p_brand", T.title_hash(F.col("title")))).alias("canonical"))


NAMES_SQL = f"select p_partkey, {list(FIRSTS)}[p_partkey % 9 + 1] as a, {list(FIRSTS)}[p_size % 9 + 1] as b from part"


def _names(t):
    names = F.array(*map(F.lit, FIRSTS))
    return t("part").select("p_partkey", F.get(names, (F.col("p_partkey") % 9).cast("int")).alias("a"), F.get(names, F.col("p_size") % 9).alias("b"))


@P.add("str_12_name_compatible", f"select p_partkey, {compatible_sql('a', 'b')} as ok from ({NAMES_SQL})")
def _(t):
    return _names(t).select("p_partkey", T.compatible_names(F.col("a"), F.col("b")).alias("ok"))


@P.add("str_13_abbreviation", f"select p_partkey, {short_sql('a', 'b')} as ok from ({NAMES_SQL})")
def _(t):
    return _names(t).select("p_partkey", T.abbreviation(F.col("a"), F.col("b")).alias("ok"))


@P.add("str_14_initial_match", f"""
    select p_partkey, (regexp_full_match(a, '[A-Za-z]\\.?') or regexp_full_match(b, '[A-Za-z]\\.?')) and lower(left(a, 1)) = lower(left(b, 1)) as ok from ({NAMES_SQL})
""")
def _(t):
    return _names(t).select("p_partkey", T.initial_match(F.col("a"), F.col("b")).alias("ok"))


@P.add("str_15_longer_name", f"select p_partkey, case when length(rtrim(a, '.')) > length(rtrim(b, '.')) then a else b end as name from ({NAMES_SQL})")
def _(t):
    return _names(t).select("p_partkey", T.longer_name(F.col("a"), F.col("b")).alias("name"))


@P.add("str_33_name_words", f"select p_partkey, len(list_filter(string_split_regex(trim(a), '\\s+'), lambda w: w <> '')) as n, case when regexp_full_match(a, '[A-Za-z]\\.?') then lower(left(a, 1)) end as initial from ({NAMES_SQL})")
def _(t):
    return _names(t).select("p_partkey", F.size(T.name_words(F.col("a"))).cast("long").alias("n"), T.initial(F.col("a")).alias("initial"))


@P.add("str_16_title_renamed", """
    with p as (select p_partkey, p_name || ' ' || lower(p_type) as a, case p_partkey % 6 when 0 then p_name || ' ' || lower(p_type) when 1 then '[R&R] ' || p_name || ' ' || lower(p_type) when 2 then p_name || ' new ' || lower(p_type) when 3 then p_name || lower(p_type)
        when 4 then p_name || ' ' || lower(p_type) || ': an essay' else lower(p_type) || ' ' || p_name end as b from part)
    select p_partkey, p_partkey % 6 = 5 and a <> b as renamed from p
""")
def _(t):
    title, k = F.concat_ws(" ", "p_name", F.lower("p_type")), F.col("p_partkey") % 6
    other = F.when(k == 0, title).when(k == 1, F.concat(F.lit("[R&R] "), title)).when(k == 2, F.concat_ws(" new ", "p_name", F.lower("p_type"))).when(k == 3, F.concat("p_name", F.lower("p_type"))).when(k == 4, F.concat(title, F.lit(": an essay"))).otherwise(F.concat_ws(" ", F.lower("p_type"), "p_name"))
    return t("part").select("p_partkey", T.title_renamed(title, other).alias("renamed"))


@P.add("str_20_guard_columns", "select p_partkey, case when p_partkey % 2 = 0 then 'théorie ' || p_name else p_name end as title, p_brand as venue from part")
def _(t):
    """One repair applied to several columns."""
    garbled = F.decode(F.encode(F.concat(F.lit("théorie "), "p_name"), "UTF-8"), "ISO-8859-1")
    rows = t("part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, garbled).otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("venue"))
    return rows.withColumns({c: T.latin1_repair(F.col(c)) for c in ("title", "venue")})


@P.add("str_36_paper_hash", "select p_partkey, sha256(p_name || '||' || '||' || case when p_size > 25 then p_brand else '' end || '||' || p_type || '||' || '||' || p_size) as h from part")
def _(t):
    c = lambda e: F.lit(None).cast("string") if e is None else F.col(e).cast("string")
    return t("part").select("p_partkey", T.content_hash(c("p_name"), c(None), F.when(F.col("p_size") > 25, F.col("p_brand")), c("p_type"), c(None), c("p_size")).alias("h"))


@P.add("key_4_coauthors_of_papers", "select l_orderkey as paper, string_agg(s_name, ';' order by l_suppkey) as coauthors from (select distinct l_orderkey, l_suppkey from lineitem) join supplier on s_suppkey = l_suppkey group by l_orderkey")
def _(t):
    named = t("lineitem").select("l_orderkey", "l_suppkey").distinct().join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    lists = named.groupBy(F.col("l_orderkey").alias("paper")).agg(F.sort_array(F.collect_list(F.struct("l_suppkey", "s_name"))).alias("a"))
    return lists.select("paper", F.array_join(F.transform("a", lambda x: x["s_name"]), ";").alias("coauthors"))
