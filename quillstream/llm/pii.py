"""Personal data in texts, also where it is disguised, with exact source offsets.

Plain identifiers are found first, by the rules in ``plain``.  Then windows around anything
that looks like a disguise (a letter or digit of another script, a spelled digit, an at or dot
in words or brackets) go through transducers.  Each rewrites the window and keeps, for every
character that it writes, the source characters it stands for; so what the rules find in the
rewritten window maps back to source offsets.  Found spans that touch no plain one are added.

Offsets are code points of the source, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import text as tx

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# begins where a run of digits does, so that each run is tried once
_DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3,}")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each at sign outwards.

    Each sign is looked at once, so a long run of one kind of character costs no more than its length.
    """
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((a, m.end()))
            done = m.end()
        # Characters before a failed sign can't be part of a later address.
        done = max(done, at + 1)
        at = text.find("@", done)
    return found


def ips(text: str) -> list[Span]:
    """Leftmost runs of four numbers joined by single dots; those with a number over 255 are dropped."""
    found = []
    for m in _DOTTED.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((at, end))
            at = end + 1
    return found


def cards(text: str) -> list[Span]:
    """Runs of digits, each at most one blank or hyphen apart, of 16 to 19 digits that pass Luhn's test."""
    found = []
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    """International numbers of 8 to 15 digits."""
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def plain(text: str) -> dict[str, list[Span]]:
    digits = _DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digits else [],
        "card": cards(text) if digits else [],
        "phone": phones(text) if digits and "+" in text else [],
    }


class Tape:
    """A string and, for each of its characters, the span of source characters behind it."""

    def __init__(self, text: str, offset: int = 0):
        self.text = text
        self.behind = [(offset + k, offset + k + 1) for k in range(len(text))]

    def rewrite(self, pattern: re.Pattern, by: Callable[[re.Match], str | None]) -> None:
        """Replace matches; each character of a replacement stands for all the match's, unless they are as many."""
        out, behind, at = [], [], 0
        for m in pattern.finditer(self.text):
            new = by(m)
            if new is None or new == m[0]:
                continue
            a, b = m.span()
            out += [self.text[at:a], new]
            own = self.behind[a:b]
            behind += self.behind[at:a]
            behind += own if len(new) == b - a else [(own[0][0], own[-1][1])] * len(new)
            at = b
        if at:
            self.text = "".join([*out, self.text[at:]])
            self.behind = behind + self.behind[at:]

    def source(self, span: Span) -> Span:
        return self.behind[span[0]][0], self.behind[span[1] - 1][1]


#: Letters of other scripts by the Latin letter they look like.
LOOKALIKES = {"a": "аα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еε", "g": "ɡ", "h": "һ", "i": "іι", "j": "ј", "k": "κ", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "т", "u": "υ", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγ", "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "Υ", "Z": "Ζ"}
_LATIN = {c: letter for letter, others in LOOKALIKES.items() for c in others}
#: Spelled digits.
NUMERALS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

# Characters beyond Latin-1 and its extensions, digits in rings, and the invisible ones
_FOREIGN = re.compile(r"[­²³¹ɐ-῿​-‏⁠-⿟﻿-￯\U0001d400-\U0001d7ff]")
_FOREIGN_RUN = re.compile(f"{_FOREIGN.pattern}+")
_INVISIBLE = re.compile(r"[­​-‏⁠﻿]")
_NUMERAL = rf"(?:{'|'.join(NUMERALS)})"
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:plus[\s-]+)?(?:(?:{_NUMERAL}|[0-9]+)[\s,-]+){{2,}}(?:{_NUMERAL}|[0-9]+)(?![^\W_])")
_BRACKETED = re.compile(r"(?i)[\[({<]\s*(?:at|@|dot|\.|punkt|arroba)\s*[\])}>]")
_LOOSE_AT = re.compile(r"\s@|@\s")
#: Last labels that need no test where an address is written out in bare words.
TOP_LEVEL = ("com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "dev", "app", "ai", "me", "tv", "eu", "uk", "us", "ca", "au", "nz", "de", "fr", "es", "it", "nl", "be", "ch", "at", "se", "no", "dk", "fi", "pl", "cz", "pt", "ie", "in", "cn", "jp", "kr", "br", "mx", "ru", "example", "test")
#: Words of prose, which are no name, host or last label beside a bare "at" or "dot".
PROSE = frozenset("a an the this that these those each every any some one its his her my your our their and or of on in at to by for with from as is are was were be been it he she we they you i us me him them more info look looks looked looking see visit arrive meet met aim available live stay work works worked sold hosted found held here there over up down out".split())
_AT = re.compile(r"""(?i)(?<=[\w%+.-])\s*(?:[\[({<]\s*(?:at|@|arroba)\s*[\])}>]|\s@|@(?=\s)|\s(?P<bare>at)(?=(?P<host>(?:\s+[\w-]+\s+dot)+)\s+(?P<top>[^\W\d_]{2,24})(?![^\W_]))|\s(?P<plain>at)(?=\s+(?:[a-z0-9-]+\.)+[a-z]{2,24}(?![\w@-])))\s*(?=\w)""")
_HOSTED = re.compile(r"(?i)at\s+((?:[a-z0-9-]+\.)+[a-z]{2,24})(?![\w@-])")
_NAME = re.compile(r"(?:^|[\s:<(\[\"',;])([\w.%+-]+)$")
_ASKS = re.compile(r"(?i)\b(?:e-?mails?|mail|contact|write|reach|address|kontakt|correo|courriel)\b")


def _at_sign(m: re.Match) -> str | None:
    """Whether a match of ``_AT`` stands for the sign: brackets always; bare words where what is around them is no prose.

    "name at host dot label": the host is no word of prose, and the label is a listed one or neither it nor the name is.
    "name at host.label": the name isn't one, and either nothing else is on the line or before it something asks for an address.
    """
    if m["bare"] is None and m["plain"] is None:
        return "@"
    name = _NAME.search(m.string, max(0, m.start() - 128), m.start())
    if name is None:
        return None
    if m["bare"]:
        host = m["host"].split()[0].lower()
        good = host not in PROSE and (m["top"].lower() in TOP_LEVEL or not PROSE & {name[1].lower(), m["top"].lower()})
        return "@" if good else None
    if name[1].lower() in PROSE:
        return None
    line = m.string.rfind("\n", 0, name.start(1)) + 1
    end = _HOSTED.search(m.string, m.start("plain")).end()
    rest = m.string.find("\n", end)
    alone = not m.string[line : name.start(1)].strip(" \t:<([\"',;-") and not m.string[end : rest if rest >= 0 else None].strip(" \t>)]\"',;.")
    return "@" if alone or _ASKS.search(m.string, max(0, name.start(1) - 60), name.start(1)) else None


_DOT = re.compile(r"(?i)(?<=[\w-])\s*(?:[\[({<]\s*(?:dot|\.|punkt)\s*[\])}>]|\sdot(?=\s))\s*(?=\w)")
_DOT_BLANK = re.compile(r"(?<=@)([\w-]+(?:\.[\w-]+)*)\s+\.\s*(?=\w)")

REACH = 128


def _unfold(m: re.Match) -> str:
    out = []
    for c in m[0]:
        flat = _LATIN.get(c) or unicodedata.normalize("NFKC", c)
        digit = unicodedata.digit(c, None)
        out.append("" if _INVISIBLE.match(c) else str(digit) if digit is not None else _LATIN.get(flat, flat))
    return "".join(out)


def _figures(m: re.Match) -> str:
    plus = "+" if m[0][:4].lower() == "plus" else ""
    return plus + "".join(NUMERALS.get(w.lower(), w if w.isdigit() else "") for w in re.split(r"[\s,-]+", m[0]))


def normalised(window: str, offset: int = 0) -> Tape:
    """The window after all transducers."""
    tape = Tape(window, offset)
    # one character at a time, so that each keeps its own source
    tape.rewrite(_FOREIGN, _unfold)
    tape.rewrite(_SPELLED, _figures)
    tape.rewrite(_AT, _at_sign)
    if "@" in tape.text or _DIGIT.search(tape.text):
        tape.rewrite(_DOT, lambda _: ".")
        tape.rewrite(_DOT_BLANK, lambda m: m[1] + ".")
    return tape


def _word_starts(word: str, low: str) -> Iterator[int]:
    """Where a word stands by itself; literal search, so nearly free where it doesn't occur."""
    at, n = low.find(word), len(word)
    while at >= 0:
        if not (at and low[at - 1].isalnum()) and not (at + n < len(low) and low[at + n].isalnum()):
            yield at
        at = low.find(word, at + n)


def windows(text: str) -> list[Span]:
    """Stretches around disguises, joined where they meet: REACH characters each way, on to white space, and on through
    digits and what may be between them, so that no number is cut."""
    marks = [m.span() for m in _FOREIGN_RUN.finditer(text)] if not text.isascii() else []
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
    if any(c in text for c in "[({<"):
        marks += [m.span() for m in _BRACKETED.finditer(text)]
    if "@" in text:
        marks += [m.span() for m in _LOOSE_AT.finditer(text)]
    marks += [(at, at + 3) for at in _word_starts("dot", low)]
    if "." in text:
        marks += [m.span() for at in _word_starts("at", low) if (m := _HOSTED.match(text, at))]
    near: list[Span] = []
    for at in sorted(at for word in NUMERALS for at in _word_starts(word, low)):
        if near and (at <= near[-1][1] + REACH or _BETWEEN.match(text, near[-1][1]).end() >= at):
            near[-1] = (near[-1][0], at)
        else:
            near.append((at, at))
    done = 0
    for a, b in near:
        # digits and what may be between them belong to a spelled number, however far they go
        while a > done and text[a - 1] in _LOOSE:
            a -= 1
        b = done = max(b, _BETWEEN.match(text, b).end())
        marks += [m.span() for m in _SPELLED.finditer(text, max(0, a - REACH), b + REACH) if not _PLAIN_NUMBERS.fullmatch(m[0])]
    joined: list[Span] = []
    for a, b in sorted(marks):
        a, b = max(0, a - REACH), min(len(text), b + REACH)
        done = joined[-1][1] if joined else 0
        if b <= done:
            continue
        while a > done and (not text[a - 1].isspace() or text[a - 1] in _LOOSE and text[a] in _LOOSE):
            a -= 1
        while b < len(text) and (not text[b].isspace() or text[b] in _LOOSE and text[b - 1] in _LOOSE):
            b += 1
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


_PLAIN_NUMBERS = re.compile(r"[\s,0-9-]*")
#: A spelled digit's letters and all that may be between it and the next one; characters of numbers.
_BETWEEN = re.compile(r"[A-Za-z]*[\s,0-9-]*")
_LOOSE = frozenset(" \t\n\r\f\v,.()+-0123456789")


def spans(text: str, base: dict[str, list[Span]] | None = None) -> dict[str, list[Span]]:
    """Plain spans and those found behind disguises, by kind, in order."""
    base = plain(text) if base is None else base
    added: list[tuple[int, int, str]] = []
    for a, b in windows(text):
        tape = normalised(text[a:b], a)
        if tape.text == text[a:b]:
            continue
        for kind, found in plain(tape.text).items():
            for span in found:
                x, y = tape.source(span)
                if text[x:y] != tape.text[span[0] : span[1]]:
                    added.append((x, y, kind))
    if not added:
        return base
    # plain spans of one kind don't overlap, so of each kind only the last one that begins before an end can touch
    begins = {k: [p for p, _ in found] for k, found in base.items()}
    merged = {k: set(found) for k, found in base.items()}
    for x, y, kind in added:
        if not any((k := bisect_left(begins[other], y)) and base[other][k - 1][1] > x for other in base):
            merged[kind].add((x, y))
    return {kind: sorted(found) for kind, found in merged.items()}


def listed(found: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in found[kind])


def redacted(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind in brackets; overlapping ones as a whole by that of the first and then longest."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in sorted(((a, b, k) for k, found in spans(text).items() for a, b in found), key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if at else text


def find(docs: DataFrame) -> DataFrame:
    """Counts and digest of the plain spans of every text, and all spans.

    A null text counts as empty; rows of equal or null doc_id stay apart; columns other than doc_id
    and text are left out; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                counts, digests, all_spans = [], [], []
                for text in part.column("text").to_pylist():
                    base = plain(text or "")
                    counts.append([len(base[k]) for k in KINDS])
                    digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                    all_spans.append(listed(spans(text or "", base)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with identifiers in ``text`` replaced, and n_chars, where there is one, counted anew.

    Null texts stay null and null counts stay so; repeated rows are treated each; all other columns stay; no
    rows give none.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                at = part.schema.get_field_index("text")
                yield part.set_column(at, part.schema.field(at), pa.array([redacted(t) for t in part.column("text").to_pylist()], part.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(schema["n_chars"].dataType))) if "n_chars" in docs.columns else out
