"""URL functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions import values as V


def host(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def path(c: Column) -> Column:
    return F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))


def on_domain(h: Column, domain: str) -> Column:
    return (h == domain) | h.endswith("." + domain)


def link_type(h: Column) -> Column:
    """A host's kind of link; the first rule that fits."""
    kind = F.when(F.contains(h, F.lit("ssrn.com")), "ssrn").when(F.contains(h, F.lit("nber.org")), "nber").when(F.contains(h, F.lit("arxiv.org")), "arxiv").when(F.contains(h, F.lit("doi.org")), "doi")
    kind = kind.when(F.contains(h, F.lit("drive.google.com")) | F.contains(h, F.lit("docs.google.com")), "drive").when(F.contains(h, F.lit("dropbox.com")), "dropbox").when(F.contains(h, F.lit("cargocollective.com")), "pdf")
    return kind.when(reduce(lambda a, b: a | b, (F.contains(h, F.lit(d)) for d in V.REPOSITORY_HOSTS)), "repository").otherwise("journal")


def trusted_type(url: Column) -> Column:
    """The link's type on a trusted host, else null; journals' pages about themselves aren't papers."""
    h, p = host(url), F.lower(path(url))
    known = reduce(lambda a, b: a | b, (on_domain(h, d) for d in V.TRUSTED_DOMAINS))
    kind = link_type(h)
    about = reduce(lambda a, b: a | b, (F.contains(p, F.lit(x)) for x in V.NON_ARTICLE_PATHS))
    return F.when(known & ~((kind == "journal") & about), kind)


def doi(url: Column) -> Column:
    """The DOI in a publisher's URL; made up from the number for SSRN; null for supplements."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    ssrn = F.regexp_extract(bare, r"ssrn\.com/.*abstract_id=(\d+)", 1)
    found = F.regexp_extract(bare, r"(?:^|[/=])(10\.\d{4,}/[^\s?#]+)", 1)
    plain = F.nullif(F.rtrim(found, F.lit("/")), F.lit(""))
    out = F.when(ssrn != "", F.concat(F.lit("10.2139/ssrn."), ssrn)).otherwise(plain)
    return F.when(~url.rlike("/asset/|/supinfo/|/supp/"), out)


def pii(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "/pii/([A-Z0-9]+)", 1), F.lit(""))


def bare(url: Column) -> Column:
    """Without query, fragment and closing slashes."""
    return F.rtrim(F.regexp_replace(url, "[?#].*$", ""), F.lit("/"))


def fix_scheme(url: Column) -> Column:
    return F.regexp_replace(url, "^(https?):/+", "$1://")


def web_only(url: Column) -> Column:
    """The URL if its scheme is http or https, else null."""
    return F.when(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https"), url)


def same_site(a: Column, b: Column) -> Column:
    """Hosts equal but for a leading www."""
    cut = lambda h: F.regexp_replace(h, "^www[.]", "")
    return cut(host(a)) == cut(host(b))


_PARTS = r"^(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _parts(c: Column) -> Column:
    """A reference's scheme, whether it has an authority, authority, path, query and fragment; empty ones without their mark."""
    scheme, host, path_, query, fragment = (F.regexp_extract(c, _PARTS, k) for k in range(1, 6))
    return F.struct(
        c.alias("whole"), F.lower(scheme).alias("scheme"), c.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//").alias("has_host"), host.alias("host"), path_.alias("path"),
        F.when(query == "?", "").otherwise(query).alias("query"), F.when(fragment == "#", "").otherwise(fragment).alias("fragment"),
    )


def without_dots(segments: Column) -> Column:
    """A path's segments, resolved: a dot is left out, two dots take the one before away."""

    def step(done, s):
        return F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    out = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(out, F.array(F.lit("")))).otherwise(out)


def absolute(base: Column, ref: Column) -> Column:
    """A reference as it is meant on the page at ``base``; those of another scheme stay, an empty one is the page."""
    pair = F.array(F.struct(_parts(base).alias("b"), _parts(ref).alias("r")))

    def joined(p):
        b, r = p["b"], p["r"]
        up = F.split(b["path"], "/")
        up = F.when(F.element_at(up, -1) != "", F.slice(up, F.lit(1), F.size(up) - 1)).otherwise(up)
        here = F.split(r["path"], "/")
        both = F.concat(up, here)
        # blank steps inside are left out, as are those that joining would double
        inner = F.filter(F.slice(both, F.lit(2), F.greatest(F.size(both) - 2, F.lit(0))), lambda s: s != "")
        merged = F.when(F.size(both) > 2, F.concat(F.slice(both, 1, 1), inner, F.slice(both, -1, 1))).otherwise(both)
        resolved = F.array_join(without_dots(F.when(r["path"].startswith("/"), here).otherwise(merged)), "/")
        path_ = F.when(r["has_host"], r["path"]).when(r["path"] == "", b["path"]).otherwise(F.when(resolved == "", "/").otherwise(resolved))
        path_ = F.when((path_ != "") & ~path_.startswith("/"), F.concat(F.lit("/"), path_)).otherwise(path_)
        query = F.when((r["path"] == "") & ~r["has_host"] & (r["query"] == ""), b["query"]).otherwise(r["query"])
        host_ = F.when(r["has_host"], r["host"]).otherwise(b["host"])
        own = F.concat(b["scheme"], F.lit("://"), host_, path_, query, r["fragment"])
        return F.when(r["whole"] == "", b["whole"]).when((r["scheme"] != "") & (r["scheme"] != b["scheme"]), r["whole"]).otherwise(own)

    return F.transform(pair, joined)[0]


def steps(url: Column) -> Column:
    """The parts of a path that aren't blank."""
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def site(url: Column) -> Column:
    """(host, prefix): the host without www; on hosts of many sites also the two steps that name the site, if there are two."""
    h = F.regexp_replace(F.coalesce(host(url), F.lit("")), "^www[.]", "")
    many, s = h.isin(*V.TENANT_HOSTS), steps(url)
    return F.struct(h.alias("host"), F.when(many & (F.size(s) >= 2), F.concat(F.lit("/"), F.array_join(F.slice(s, 1, 2), "/"))).otherwise("").alias("prefix"))


def on_site(base: Column, url: Column) -> Column:
    """Whether a URL is on the site of ``base``."""
    a, b, p = site(base), site(url), F.lower(path(url))
    prefix = F.lower(a["prefix"])
    inside = p.startswith(F.concat(prefix, F.lit("/"))) | (F.rtrim(p, F.lit("/")) == prefix)
    same = F.when((a["prefix"] != "") & (b["prefix"] != ""), prefix == F.lower(b["prefix"])).when(a["prefix"] != "", inside).otherwise(b["prefix"] == "")
    return (a["host"] == b["host"]) & same


def near_page(base: Column, url: Column) -> Column:
    """Whether a URL is in the context of ``base``: anywhere on a person's own site, else below it or beside it."""
    h, s, c = F.regexp_replace(F.coalesce(host(base), F.lit("")), "^www[.]", ""), steps(base), steps(url)
    institution = reduce(lambda x, y: x | y, (F.contains(h, F.lit(m)) for m in V.INSTITUTION_MARKS))
    own = F.when(institution, F.contains(path(base), F.lit("/~"))).otherwise(F.size(s) <= 1)
    b, p = F.rtrim(path(base), F.lit("/")), F.rtrim(path(url), F.lit("/"))
    beside = (F.size(s) > 1) & (F.slice(c, F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))) == F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))))
    return own | ((F.size(s) > 0) & (p.startswith(F.concat(b, F.lit("/"))) | (p == b) | beside))


def research_page(url: Column, anchor: Column) -> Column:
    """Whether a link leads to a page that lists papers: by its last step, or on a short path by its text; never to a file."""
    p = path(url)
    return ~p.rlike(V.FILE_ENDINGS) & (p.rlike(V.RESEARCH_LEAF) | ((F.size(steps(url)) <= 4) & F.trim(anchor).rlike(V.RESEARCH_ANCHOR)))
