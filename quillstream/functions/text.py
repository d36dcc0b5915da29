"""Text functions as column expressions; the few that need Python are Arrow UDFs in ``udfs``."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions import values as V


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_title(c: Column) -> Column:
    """Lower case, only a-z, 0-9 and single blanks; null as empty."""
    kept = F.regexp_replace(F.lower(F.trim(text(c))), r"(?U)[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def title_hash(c: Column) -> Column:
    return F.sha2(normalize_title(c), 256)


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the values joined by two bars, null as empty."""
    return F.sha2(F.concat_ws("||", *(text(c) for c in columns)), 256)


def signature(key: str, message: Column) -> Column:
    """HMAC-SHA-256 of a text, in hexadecimal digits; a null text has none."""
    raw = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    inner, outer = (F.lit(bytes(b ^ pad for b in raw.ljust(64, bytes(1)))) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def match_form(c: Column) -> Column:
    """Lower-case alphanumeric words with single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def clean_title(c: Column) -> Column:
    """Without a state on its end, after a dash or in brackets; first letter in upper case."""
    bare = F.regexp_replace(c, rf"(?i)\s*(?:--|—|–|―)\s*(?:{V.TITLE_STATES})\s*$", "")
    bare = F.trim(F.regexp_replace(bare, rf"(?i)\s*[\[\(]\s*(?:{V.TITLE_STATES})\s*[\]\)]\s*$", ""))
    return F.concat(F.upper(F.left(bare, F.lit(1))), F.substring(bare, 2, 1 << 30))


def normalize_text(c: Column) -> Column:
    """Page text for change detection: plain quotes, single blanks, digits joined, page furniture dropped."""
    out = F.translate(c, "‘’“”", "''\"\"")
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    out = F.regexp_replace(out, r" ([)\],;])", "$1")
    out = F.regexp_replace(out, r"(\d) (\d)", "$1$2")
    for phrase in V.BOILERPLATE:
        out = F.regexp_replace(out, f"(?i){phrase}", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def strip_accents(c: Column) -> Column:
    """Latin-1 letters without their marks; ``udfs.strip_accents`` does all of Unicode."""
    return F.translate(c, *ACCENTS)


def words(c: Column) -> Column:
    """Words between blanks, without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def title_jaccard(a: Column, b: Column) -> Column:
    # bound as fields of one struct, each text is normalised once and not at every use
    pair = F.struct(words(normalize_title(a)).alias("a"), words(normalize_title(b)).alias("b"))
    return F.transform(F.array(pair), lambda p: jaccard(p["a"], p["b"]))[0]


def fuzzy_form(c: Column) -> Column:
    bare = F.replace(F.replace(F.replace(F.lower(c), F.lit("-")), F.lit("'s")), F.lit("’s"))
    return F.regexp_replace(bare, r"(?U)[^\w\s]", "")


def content_words(c: Column) -> Column:
    return F.filter(words(fuzzy_form(c)), lambda w: ~w.isin(*V.TITLE_STOPWORDS))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two arrays as sets; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def contains_any(c: Column, keywords: tuple[str, ...]) -> Column:
    """Whether any keyword occurs, without regard to case; literal, no wildcards."""
    low = F.lower(c)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(k.lower())) for k in keywords))


def topic_codes(c: Column) -> Column:
    """Codes of all keywords in a topic, in the table's order, each once."""
    low = F.lower(c)
    hits = [F.when(F.contains(low, F.lit(k)), F.array(*map(F.lit, codes))).otherwise(F.array().cast("array<string>")) for k, codes in V.TOPIC_CODES]
    return F.array_distinct(F.flatten(F.array(*hits)))


def acronym(c: Column) -> Column:
    """First letters of words of more than two letters."""
    return F.upper(F.array_join(F.transform(F.filter(words(c), lambda w: F.length(w) > 2), lambda w: F.left(w, F.lit(1))), ""))


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.nullif(F.regexp_replace(c, f"^{prefix}", ""), F.lit(""))


def common_start(a: Column, b: Column) -> Column:
    """How many first elements two arrays have in common."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(a))


def title_renamed(old: Column, new: Column) -> Column:
    """Whether two titles differ by more than an artefact: a bracketed prefix, a subtitle, one word more or less, blanks."""
    a, b = normalize_title(old), normalize_title(new)
    bare = [normalize_title(F.regexp_replace(text(c), r"^\[.*?\]\s*", "")) for c in (old, new)]
    x, y = words(a), words(b)
    # one word was put in: what is before and what is after it make up the shorter title
    covered = common_start(x, y) + common_start(F.reverse(x), F.reverse(y)) >= F.least(F.size(x), F.size(y))
    one_word = (F.abs(F.size(x) - F.size(y)) == 1) & covered
    same = (a == b) | (bare[0] == bare[1]) | (F.replace(a, F.lit(" ")) == F.replace(b, F.lit(" ")))
    return ~(same | one_word | F.startswith(a, b) | F.startswith(b, a))


def distinct_markers(a: Column, b: Column) -> Column:
    """Whether a word that only one of two normalised titles has is a number or marks a paper of its own."""
    x, y = words(a), words(b)
    return F.exists(F.array_union(F.array_except(x, y), F.array_except(y, x)), lambda w: w.rlike(V.DISTINCT_MARKERS))


def initial(c: Column) -> Column:
    """The letter of a lone initial, lower case, else null."""
    bare = F.trim(c)
    return F.when(bare.rlike(r"^[A-Za-z]\.?$"), F.lower(F.left(bare, F.lit(1))))


def name_words(c: Column) -> Column:
    apart = F.regexp_replace(F.replace(strip_accents(c), F.lit("-"), F.lit(" ")), r"([A-Za-z])\.(?=[A-Za-z])", "$1. ")
    return words(F.trim(apart))


def words_agree(a: Column, b: Column) -> Column:
    x, y = initial(a), initial(b)
    return (F.lower(a) == F.lower(b)) | F.coalesce(x == F.coalesce(y, F.lower(F.left(b, F.lit(1)))), F.lit(False)) | F.coalesce(y == F.coalesce(x, F.lower(F.left(a, F.lit(1)))), F.lit(False))


def compatible_names(a: Column, b: Column) -> Column:
    """Whether two first names may be one person's: word by word equal or an initial, as far as the shorter goes."""
    x, y = name_words(text(a)), name_words(text(b))
    n = F.least(F.size(x), F.size(y))
    return (n > 0) & F.forall(F.zip_with(F.slice(x, 1, F.greatest(n, F.lit(1))), F.slice(y, 1, F.greatest(n, F.lit(1))), words_agree), lambda ok: ok)


def abbreviation(a: Column, b: Column) -> Column:
    x, y = (F.trim(F.lower(strip_accents(text(c)))) for c in (a, b))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def initial_match(a: Column, b: Column) -> Column:
    """Whether one name is the other's initial; two full names never match here."""
    x, y = initial(a), initial(b)
    known = F.coalesce(a, F.lit("")) != ""
    known &= F.coalesce(b, F.lit("")) != ""
    return known & (x.isNotNull() | y.isNotNull()) & (F.coalesce(x, F.lower(F.left(a, F.lit(1)))) == F.coalesce(y, F.lower(F.left(b, F.lit(1)))))


def longer_name(a: Column, b: Column) -> Column:
    return F.when(F.length(F.rtrim(a, F.lit("."))) > F.length(F.rtrim(b, F.lit("."))), a).otherwise(b)


def bad_name(first: Column, last: Column) -> Column:
    return (F.trim(text(first)) == "") | (F.trim(text(last)) == "") | F.trim(text(last)).rlike(r"^[A-Za-z]\.?$")


def coerce_year(c: Column) -> Column:
    """The first year of 1900 to 2099, else the first four characters; blank as null."""
    bare = F.trim(c.cast("string"))
    return F.when(bare != "", F.coalesce(F.nullif(F.regexp_extract(bare, r"(19|20)\d{2}", 0), F.lit("")), F.left(bare, F.lit(4))))


def segments(c: Column) -> Column:
    """Sentences and lines, for diffs."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+(?=[A-Z])|(?<=\n)"), lambda s: s != "")


def latin1_repair(c: Column) -> Column:
    """UTF-8 that was read as Latin-1, read anew; other texts stay."""
    garbled = c.rlike(r"[ÂÃâ][\x{80}-\x{BF}]")
    again = F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")
    return F.when(garbled & ~c.rlike(r"[^\x{0}-\x{FF}]"), again).otherwise(c)


def inverted_index_text(c: Column) -> Column:
    """Words of a JSON map word -> positions, in order of position then word."""
    entries = F.map_entries(F.from_json(c, "map<string,array<int>>"))
    placed = F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " "), F.lit(""))


def fenced_json(c: Column) -> Column:
    """The inside of a fenced block, or all of it."""
    inside = F.regexp_extract(c, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    return F.regexp_replace(F.coalesce(F.nullif(inside, F.lit("")), c), r"^\s+|\s+$", "")


def first_object(c: Column) -> Column:
    """The first whole JSON object in a text: from its first brace to the one that closes it; null if none does.

    The text from there on is cut into strings (with their escapes), braces and the rest, and the pieces are folded
    with the depth so far; a string that doesn't end ends the search.
    """
    tail = F.when(F.contains(c, F.lit("{")), F.substr(c, F.instr(c, "{")))
    pieces = F.regexp_extract_all(tail, F.lit(r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+"|"|[{}]|[^"{}]++)'), 1)
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("read"), F.lit(None).cast("int").alias("end"))

    def step(at, piece):
        depth = at["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).when(piece == '"', 1 << 30).otherwise(0)
        read = at["read"] + F.length(piece)
        return F.struct(depth.alias("depth"), read.alias("read"), F.coalesce(at["end"], F.when(depth == 0, read)).alias("end"))

    return F.left(tail, F.aggregate(pieces, begin, step)["end"])


def meaningful_words(c: Column) -> Column:
    """Distinct lower-case words of two letters or more that aren't stop words."""
    found = F.regexp_extract_all(F.lower(strip_accents(c)), F.lit("[a-z0-9_]+"), 0)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*V.LINK_STOPWORDS)))


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]", "")


def link_score(anchor: Column, title: Column) -> Column:
    """How well an anchor names a title: 1 if one holds the other and is over three quarters of it, else the lesser
    of the shares of common words in either, of which each needs two."""
    a, t = alnum(anchor), alnum(title)
    share = F.least(F.length(a), F.length(t)) / F.greatest(F.length(a), F.length(t))
    held = (F.contains(a, t) | F.contains(t, a)) & (t != "")
    x, y = meaningful_words(anchor), meaningful_words(title)
    both = F.size(F.array_intersect(x, y))
    words_score = F.when((F.size(x) >= 2) & (F.size(y) >= 2), F.least(both / F.size(x), both / F.size(y))).otherwise(F.lit(0.0))
    return F.when((F.length(F.trim(anchor)) < 5) | (F.length(a) < 5), 0.0).when(held & (share > 0.75), 1.0).otherwise(words_score)


def generic_anchor(c: Column) -> Column:
    bare = F.trim(c)
    return (F.length(bare) < 5) | bare.rlike(V.GENERIC_ANCHOR) | F.lower(bare).endswith(".pdf")


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))
