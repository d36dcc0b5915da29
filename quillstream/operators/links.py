"""Links of pages and the titles that they stand for."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import urls as U
from quillstream.functions import values as V
from quillstream.operators.groups import written

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Element:
    __slots__ = ("tag", "hidden", "near", "block", "anchor", "first", "inside")

    def __init__(self, tag: str, hidden: bool, block: _Element | None, first: int):
        self.tag, self.hidden, self.first = tag, hidden, first
        self.near: int | None = None  # the last link among the children that only text and inline elements follow
        self.anchor: int | None = None
        self.inside: list[int] = []  # links whose nearest block this is
        self.block = self if tag in V.BLOCK_TAGS else block


class _Walk(HTMLParser):
    """One walk over a page's tags.  Each link knows its neighbours among its siblings, through inline elements, and its block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.data: list[str] = []
        self.open = [_Element("", False, None, 0)]
        self.anchors: list[dict] = []

    def _flush(self) -> None:
        text, self.data = "".join(self.data).strip(), []
        if text and not self.open[-1].hidden:
            self.texts.append(text)

    def handle_data(self, data: str) -> None:
        self.data.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        parent = self.open[-1]
        own = _Element(tag, parent.hidden or tag in V.FURNITURE_TAGS, parent.block, len(self.texts))
        if not own.hidden:
            if tag == "a":
                own.anchor = len(self.anchors)
                if parent.near is not None:
                    self.anchors[parent.near]["after"] = own.anchor
                self.anchors.append({"url": dict(attrs).get("href"), "before": parent.near, "after": None, "own": "", "block": None})
                parent.near = own.anchor
                if own.block is not None:
                    own.block.inside.append(own.anchor)
            elif tag not in V.INLINE_TAGS:
                parent.near = None
        if tag not in _VOID:
            self.open.append(own)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if any(e.tag == tag for e in self.open[1:]):
            while self._close().tag != tag:
                pass

    def _close(self) -> _Element:
        own = self.open.pop()
        if own.anchor is not None:
            self.anchors[own.anchor]["own"] = "".join(self.texts[own.first :])
        if own.inside:
            text = " ".join(self.texts[own.first :])
            for k in own.inside:
                self.anchors[k]["block"] = text
        return own

    def finished(self) -> list[dict]:
        self.close()
        self._flush()
        while len(self.open) > 1:
            self._close()
        return self.anchors


def _may_be_generic(text: str) -> bool:
    return len(" ".join(text.split())) <= 40 or text.lower().endswith(".pdf")


def page_anchors(pages: DataFrame, web: bool = True) -> DataFrame:
    """(page, k, url, own, before, after, block): the links of each page in order, with ``web`` those of full web addresses.

    own: the link's text; before, after: those of its neighbours among its siblings, null if there is none or
    if anything but text and inline elements is between; block: the text of the paragraph, list item or cell
    around it, only where its own text may say nothing.  ``pages``: page, html; a null page has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, html in zip(batch.column("page").to_pylist(), batch.column("html").to_pylist(), strict=True):
                walk = _Walk()
                walk.feed(html or "")
                anchors = walk.finished()
                text = lambda k, all=anchors: None if k is None else all[k]["own"]
                for k, a in enumerate(anchors):
                    if a["url"] and (not web or a["url"].startswith(("http://", "https://"))):
                        out.append({"page": page, "k": k, "url": a["url"], "own": a["own"], "before": text(a["before"]), "after": text(a["after"]), "block": a["block"] if _may_be_generic(a["own"]) else None})
            yield pa.RecordBatch.from_pylist(out, schema=_ANCHORS)

    return pages.select(F.col("page").cast("long").alias("page"), "html").mapInArrow(run, "page long, k int, url string, own string, before string, after string, block string")


_ANCHORS = pa.schema([("page", pa.int64()), ("k", pa.int32()), *((c, pa.string()) for c in ("url", "own", "before", "after", "block"))])


def _closed(c: Column) -> Column:
    return F.rtrim(F.trim(c), F.lit(".,;:"))


def block_title(block: Column) -> Column:
    """The title that a block of text begins with: up to a label in brackets, without co-authors; empty if too short.

    A cut counts only beyond the tenth character, that of a late "with" only in the latter half.
    """
    at = [F.instr(block, m) - 1 for m in V.LABEL_MARKERS]
    cut = F.coalesce(*(F.when(k > 10, F.left(block, k)) for k in at), block)
    # fields of structs, so that each step is computed once
    steps = F.transform(F.array(F.struct(_closed(cut).alias("t"))), lambda s: F.struct(s["t"], F.instr(s["t"], "(with ").alias("k")))
    steps = F.transform(steps, lambda s: F.struct(F.when(s["k"] > 11, _closed(F.left(s["t"], s["k"] - 1))).otherwise(s["t"]).alias("t")))
    steps = F.transform(steps, lambda s: F.struct(s["t"], (F.length(s["t"]) - F.instr(F.reverse(s["t"]), " htiw ") - 5).alias("k"), F.contains(s["t"], F.lit(" with ")).alias("has")))
    title = F.transform(steps, lambda s: F.when(s["has"] & (s["k"] > F.length(s["t"]) * 0.5), _closed(F.left(s["t"], s["k"]))).otherwise(s["t"]))[0]
    return F.when((F.length(block) >= 10) & (F.length(title) > 10), title).otherwise("")


def named_links(pages: DataFrame) -> DataFrame:
    """(page, url, title, type): each trusted URL of a page, once, with the title that it stands for.

    A link whose text is a mere label takes the text of the link before it, else after it, else its block's
    title, else keeps its own.  Of a URL's links the longest title that is no label counts, the first of equal
    ones; if all are labels, the longest.  Pages without such links have no row.
    """
    found = page_anchors(pages).withColumn("type", U.trusted_type(F.col("url"))).where("type is not null")
    good = lambda c: (F.length(c) > 10) & ~T.generic_anchor(F.col(c))
    title = F.when(~T.generic_anchor(F.col("own")), F.col("own")).when(good("before"), F.col("before")).when(good("after"), F.col("after"))
    title = title.otherwise(F.coalesce(F.nullif(block_title(F.col("block")), F.lit("")), F.col("own")))
    return best_anchors(found.withColumn("title", title), ["page", "url"], "k")


def best_anchors(anchors: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, title and type: of each key's titles the longest that is no label, else the longest; the first of equals."""
    rank = F.struct((~T.generic_anchor(F.col("title"))).alias("named"), F.length("title"), -F.col(order))
    best = anchors.groupBy(*keys).agg(F.max_by(F.struct("title", "type"), rank).alias("b"))
    return best.select(*keys, "b.title", "b.type")


def research_links(pages: DataFrame) -> DataFrame:
    """(page, to): the pages of a page's own site, in its context, that list papers, but for the page itself.

    ``pages``: page, url, html.  Addresses go without query, fragment and closing slashes, each once a page.
    """
    found = page_anchors(pages, web=False).join(pages.select(F.col("page").cast("long").alias("page"), F.col("url").alias("base")), "page")
    href = F.trim(F.col("url"))
    links = found.where(~href.rlike("^(#|mailto:|tel:|javascript:)") & (href != "")).select("page", "base", "own", U.absolute(F.col("base"), href).alias("to"))
    kept = links.where(U.on_site(F.col("base"), F.col("to")) & U.research_page(F.col("to"), F.col("own")) & U.near_page(F.col("base"), F.col("to")))
    return kept.where(U.bare(F.col("to")) != U.bare(F.col("base"))).select("page", U.bare(F.col("to")).alias("to")).distinct()


def _forms(c: str) -> list[Column]:
    """What ``text.link_score`` looks at in a text: its letters and digits, and its meaningful words."""
    return [T.alnum(F.col(c)).alias("s"), F.array_sort(T.meaningful_words(F.col(c))).alias("w")]


def shared_words(links: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    """(link, paper, score): pairs of one owner by the words' rule of ``text.link_score``, of ``least`` or more.

    ``links``: link, owner, w (words); ``titles``: paper, owner, w.  The lesser of two shares of common words
    is that of the larger set, so sets of x and y words need ceil(least * max(x, y)) in common, which bounds
    their sizes by each other.  Words go by how rare they are among the owner's titles; a set's n - ceil(least * n) + 1
    rarest ones must meet the other's, and only those are joined.
    """
    sides = [links.select("owner", F.col("link").alias("id"), F.col("w").alias("words")), titles.select("owner", F.col("paper").alias("id"), F.col("w").alias("words"))]
    sides = [s.where(F.size("words") >= 2) for s in sides]
    each = sides[1].select("owner", F.explode("words").alias("word"))
    often = each.groupBy("owner", "word").agg(F.count("*").alias("often"))
    heads = []
    for side in sides:
        placed = side.select("owner", "id", F.size("words").alias("n"), F.explode("words").alias("word")).join(often, ["owner", "word"], "left")
        # words that no title has come first, as they are the rarest
        ordered = placed.groupBy("owner", "id", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word"))).alias("w"))
        heads.append(ordered.select("owner", "id", "n", F.explode(F.expr(f"slice(w, 1, n - cast(ceil({least} * n) as int) + 1)")).alias("x")).where("x.often > 0").select("owner", "id", "n", "x.word"))
    a, b = (h.select("owner", "word", F.col("id").alias(f"id_{s}"), F.col("n").alias(f"n_{s}")) for h, s in zip(heads, "ab", strict=True))
    met = a.join(b, ["owner", "word"]).where(F.least("n_a", "n_b") >= F.ceil(F.lit(least) * F.greatest("n_a", "n_b"))).select("owner", "id_a", "id_b").distinct()
    left, right = (s.select("owner", F.col("id").alias(f"id_{x}"), F.col("words").alias(f"words_{x}")) for s, x in zip(sides, "ab", strict=True))
    both = met.join(left, ["owner", "id_a"]).join(right, ["owner", "id_b"])
    score = F.size(F.array_intersect("words_a", "words_b")) / F.greatest(F.size("words_a"), F.size("words_b"))
    return both.select(F.col("id_a").alias("link"), F.col("id_b").alias("paper"), score.alias("score")).where(F.col("score") >= least)


#: Letters of the strings by which containment is looked for.
GRAM = 8


def contained(links: DataFrame, titles: DataFrame, least: float = 0.75) -> DataFrame:
    """(link, paper): pairs of one owner of which one's letters and digits hold the other's and are under 1 / ``least`` as many.

    ``links``: link, owner, s (letters and digits, five or more); ``titles``: paper, owner, s.  A string that holds
    another holds all its strings of GRAM characters; so the one that is rarest among the longer side is enough to
    join on, and one that none there has ends the search.  Shorter strings than that fit in a few letters more, all
    of whose parts are listed.
    """
    sides = [links.select("owner", F.col("link").alias("id"), "s"), titles.select("owner", F.col("paper").alias("id"), "s").where("s <> ''")]
    grams = F.explode(F.array_distinct(F.expr(f"transform(sequence(1, length(s) - {GRAM - 1}), i -> substring(s, i, {GRAM}))"))).alias("g")
    parts = F.explode(F.array_distinct(F.expr("flatten(transform(sequence(1, length(s)), i -> transform(sequence(1, length(s) - i + 1), n -> substring(s, i, n))))"))).alias("x")
    out = []
    for short, long, names in ((sides[0], sides[1], ("link", "paper")), (sides[1], sides[0], ("paper", "link"))):
        posted = long.where(F.length("s") >= GRAM).select("owner", F.col("id").alias("other"), F.col("s").alias("y"), grams)
        often = posted.groupBy("owner", "g").agg(F.count("*").alias("often"))
        own = short.where(F.length("s") >= GRAM).select("owner", "id", F.col("s").alias("x"), grams).join(often, ["owner", "g"], "left")
        probe = own.groupBy("owner", "id", "x").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g")).alias("r")).where("r.often > 0")
        met = probe.select("owner", "id", "x", "r.g").join(posted, ["owner", "g"])
        tiny = short.where(F.length("s") < GRAM).select("owner", "id", F.col("s").alias("x"))
        near = long.where(F.length("s") < GRAM / least).select("owner", F.col("id").alias("other"), F.col("s").alias("y"), parts)
        pairs = met.select("id", "other", "x", "y").unionByName(tiny.join(near, ["owner", "x"]).select("id", "other", "x", "y"))
        held = F.contains(F.col("y"), F.col("x")) & (F.length("x") / F.length("y") > least)
        out.append(pairs.where(held).select(F.col("id").alias(names[0]), F.col("other").alias(names[1])))
    return out[0].unionByName(out[1]).distinct()


def titled(links: DataFrame, titles: DataFrame, least: float = 0.75) -> DataFrame:
    """(link, paper, score): the title of its owner that an anchor names best, by ``text.link_score``; of equal ones the least paper.

    Anchors of under five characters name nothing.  Texts of one form score alike with everything, so an owner's
    anchors, and its titles (under the least paper), meet once for each form; the tables of forms are written, so that
    what they come from runs once and the joins' plans stay small.
    """
    long = written(links.where(F.length(F.trim("anchor")) >= 5).select("link", "owner", *_forms("anchor")).where(F.length("s") >= 5))
    anchors = written(long.select("owner", "s", "w").distinct().withColumn("link", F.monotonically_increasing_id()))
    sought = titles.join(anchors.select("owner").distinct(), "owner", "left_semi")
    names = written(sought.select("owner", "paper", *_forms("title")).groupBy("owner", "s", "w").agg(F.min("paper").alias("paper")))
    scored = written(contained(anchors, names).withColumn("score", F.lit(1.0))).unionByName(written(shared_words(anchors, names, least)))
    best = lambda df: df.groupBy("link").agg(F.max_by(F.struct("paper", "score"), F.struct("score", -F.col("paper"))).alias("b")).select("link", "b.paper", "b.score")
    told = anchors.join(best(scored), "link").drop("link")
    return best(long.join(told, ["owner", "s", "w"]))


def backfill(pages: DataFrame, saved: DataFrame, papers: DataFrame, least: float = 0.75) -> DataFrame:
    """(page, url, paper, tier, type): links to save for the pages (page, owner, html) that have none in ``saved`` (page).

    Other pages' html is never parsed.
    """
    from quillstream.operators.identity import link_tiers

    bare = pages.join(saved.select("page").distinct(), "page", "left_anti")
    found = written(named_links(bare).join(bare.select("page", "owner"), "page"))  # parsed once for all tiers
    links = found.select(F.struct("page", "url").alias("link"), "owner", F.col("title").alias("anchor"), U.doi(F.col("url")).alias("doi"))
    return link_tiers(links, papers, least).join(found.select(F.struct("page", "url").alias("link"), "type"), "link").select("link.page", "link.url", "paper", "tier", "type")
