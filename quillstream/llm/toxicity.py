"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding maps each character to one: letters lose case and accents, look-alikes of other
scripts become Latin, and digits and signs that stand for letters become those letters.
Invisible characters go first.  As folding keeps positions, word boundaries are judged on
the text as it was written: a match starts where a word does, and ends where one does unless
its entry is a stem.  A match inside an exception phrase doesn't count.

Entries and weights are learnt: words and word beginnings that labelled toxic documents hold
far more often than clean ones, weighted by the log ratio of their rates.  So are exceptions: a
listed word with the word before or after it, where several clean documents have both and no
toxic one does.  A text's score is a
logistic function of its matches' total weight and of that weight over the text's length, the
three coefficients fitted on the same labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillstream.llm import text as tx
from quillstream.llm.storage import written

#: The most labelled documents that are learnt from, those with the least hash of their id.
LABELLED_ROWS = 20_000
STEMS = range(4, 9)
#: The least log ratio of rates of an entry, and the clean documents that a learnt exception is in (and no toxic one).
LEAST_WEIGHT, LEAST_CLEAN = 1.2, 5

#: Phrases in which a listed word means no harm, besides those that are learnt.
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bin", "sore loser rule", "pathetic fallacy")

#: Letters of other scripts by the Latin letter they look like.
LOOKALIKES = {"a": "аα", "b": "вβ", "c": "сς", "d": "ԁ", "e": "еεє", "g": "ɡ", "h": "һн", "i": "іιıӏ", "j": "ј", "k": "кκ", "m": "м", "n": "пη", "o": "оοσ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "тτ", "u": "υц", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ"}
#: Digits and signs by the letter they stand for.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
_INVISIBLE = re.compile(r"[­̀-ͯ​-‏⁠﻿]+")


class Fold(dict):
    """A translation table that is filled as characters are met; one character to one."""

    def __init__(self) -> None:
        super().__init__()
        for letter, others in LOOKALIKES.items():
            for c in others + others.upper():
                if len(c) == 1:
                    self[ord(c)] = letter
        self.update({ord(c): letter for c, letter in SIGNS.items()})

    def __missing__(self, code: int) -> str:
        c = chr(code)
        flat = unicodedata.normalize("NFKD", c)[:1].lower()
        out = self.get(ord(flat), flat) if len(flat) == 1 and flat != c else flat
        self[code] = out = out if len(out) == 1 else c
        return out


FOLD = Fold()


def visible(text: str) -> str:
    return text if text.isascii() else _INVISIBLE.sub("", text)


def fold(text: str) -> str:
    return text.translate(FOLD)


_WORD = re.compile(r"[^\W_]+")
_BEFORE, _AFTER = re.compile(r"(?<![^\W_])[^\W_]{1,32} $"), re.compile(r" [^\W_]{1,32}(?![^\W_])")


def terms(text: str) -> set[str]:
    """A text's folded words of three letters or more, and their beginnings (with a star)."""
    words = {w for w in set(_WORD.findall(fold(visible(text)))) if len(w) > 2}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


@dataclass
class Lexicon:
    """Entries (a star ends a stem) with weights, exception phrases, and the score's coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-3.0, 0.0, 0.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            built = ahocorasick.Automaton()
            own: dict[str, list] = {}
            for entry, weight in self.weights.items():
                key, whole = entry.rstrip("*"), not entry.endswith("*")
                # A one may stand for an l as well as for an i.
                for form in {key, key.replace("l", "i")}:
                    own.setdefault(form, []).append((len(form), whole, weight))
            for phrase in self.exceptions:
                own.setdefault(fold(visible(phrase)), []).append((len(phrase), True, None))
            for form, values in own.items():
                built.add_word(form, values)
            if own:
                built.make_automaton()
            self._automaton = built
        return self._automaton

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight): at each word the heaviest entry, outside exceptions, in ``visible(text)``."""
        text = visible(text)
        if not len(self.automaton):
            return []
        best: dict[int, tuple[float, int]] = {}
        spared: list[tuple[int, int]] = []
        for last, values in self.automaton.iter(fold(text)):
            for size, whole, weight in values:
                a, b = last + 1 - size, last + 1
                if (a and text[a - 1].isalnum()) or (whole and b < len(text) and text[b].isalnum()):
                    continue
                if weight is None:
                    spared.append((a, b))
                elif a not in best or best[a][0] < weight:
                    best[a] = (weight, b)
        # the furthest end of the phrases that begin up to a match tells whether one holds it
        out, reach, k = [], 0, 0
        spared.sort()
        for a, (w, b) in sorted(best.items()):
            while k < len(spared) and spared[k][0] <= a:
                reach = max(reach, spared[k][1])
                k += 1
            if b > reach:
                out.append((a, b, w))
        return out

    def contexts(self, text: str) -> set[str]:
        """Each matched word, folded, with the word before it and with the one after it, where only a blank lies between."""
        text = visible(text)
        low, found = fold(text), set()
        for a, b, _ in self.matches(text):
            while b < len(text) and text[b].isalnum():
                b += 1
            before, after = _BEFORE.search(low, max(0, a - 40), a), _AFTER.match(low, b)
            found |= {low[x.start() if x is before else a : b if x is before else x.end()] for x in (before, after) if x}
        return found

    def measures(self, text: str) -> tuple[float, float]:
        """log(1 + total weight), and total weight over the root of the number of words."""
        found = sum(w for _, _, w in self.matches(text))
        return (math.log1p(found), found / math.sqrt(text.count(" ") + text.count("\n") + 1)) if found else (0.0, 0.0)

    def score(self, text: str | None) -> float:
        a, b, c = self.coefficients
        x, y = self.measures(text or "")
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * x + c * y))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, float, float]:
    """Newton's method with a small penalty on the two slopes, which are kept from falling below 0."""
    x = np.column_stack([np.ones(len(x)), x])
    use = np.ones(3, dtype=bool)
    for _ in range(3):
        beta = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            penalty = np.array([1e-9, ridge, ridge])
            g = x.T @ (p - y) + penalty * beta
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            step = np.zeros(3)
            step[use] = np.linalg.solve(h[np.ix_(use, use)], g[use])
            beta -= np.clip(step, -4, 4)
        negative = (beta < 0) & (np.arange(3) > 0)
        if not negative.any():
            break
        use &= ~negative
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from the documents that ``labels`` (doc_id, toxic) marks.

    At most ``most`` labelled documents are read, one text of each id (that of least hash), so their ids may
    be broadcast and their measures collected.  Entries are all that pass the test, however many.  Without
    labels, or without toxic ones, the lexicon is empty and every score low.  A document labelled twice
    counts as toxic if it is so once; null ids, texts and labels aren't learnt from.
    """
    sample = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    found = read.join(F.broadcast(sample.withColumnRenamed("doc_id", "labelled")), F.col("doc_id") == F.col("labelled"))
    one = found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "toxic", "t.text")
    texts = written(one, "labelled")

    def counts(names_of) -> DataFrame:
        """In how many toxic (bad) and clean (good) documents each of their names is; under "" all documents."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
            for batch in batches:
                for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    seen[toxic].update({"", *names_of(text)})
            for toxic, found in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["toxic", "term", "n"])

        rows = texts.select("toxic", "text").mapInArrow(run, "toxic int, term string, n long")
        times = lambda toxic: F.coalesce(F.sum(F.when(F.col("toxic") == toxic, F.col("n"))), F.lit(0))
        return rows.groupBy("term").agg(times(1).alias("bad"), times(0).alias("good"))

    each = written(counts(terms), "terms")
    whole = each.where("term = ''").head()
    candidates = each.where("term <> '' and bad >= 3")
    n_bad, n_good = (whole["bad"], whole["good"]) if whole else (0, 0)
    if not n_bad:
        return Lexicon({}, exceptions)
    bar = 2 * math.log(candidates.count() + 1) + 4
    n, m = F.col("bad"), F.col("good")
    expected = (n + m) * (n_bad / (n_bad + n_good))
    ratio = 2 * (n * F.log(n / expected) + F.when(m > 0, m * F.log(m / (n + m - expected))).otherwise(0.0))
    weight = F.log((n + 0.5) / (n_bad + 1)) - F.log((m + 0.5) / (n_good + 1))
    passed = candidates.select("term", "bad", weight.alias("weight")).where((weight >= LEAST_WEIGHT) & (ratio >= bar)).collect()
    weights, bad = {r["term"]: r["weight"] for r in sorted(passed)}, {r["term"]: r["bad"] for r in passed}
    # A beginning that is nearly always this one word goes, as does a longer entry that says no more than one of its beginnings.
    for term in [t for t in weights if not t.endswith("*")]:
        for stem in (term[:k] + "*" for k in STEMS if k < len(term)):
            if stem in weights and bad[stem] <= 1.1 * bad[term]:
                del weights[stem]
    for term in sorted(weights, key=lambda t: -len(t)):
        stem = term.rstrip("*")
        if any((up := weights.get(stem[:k] + "*")) is not None and up >= weights[term] - 0.3 for k in STEMS if k < len(stem)):
            del weights[term]
    plain = Lexicon(weights, exceptions)
    spared = counts(plain.contexts).where((F.col("term") != "") & (F.col("good") >= LEAST_CLEAN) & (F.col("bad") == 0)).collect()
    lexicon = Lexicon(weights, tuple(sorted({*exceptions, *(r["term"] for r in spared)})))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [lexicon.measures(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([x for x, _ in got], pa.float64()), pa.array([y for _, y in got], pa.float64())], names=["doc_id", "toxic", "x", "y"])

    rows = texts.mapInArrow(measure, "doc_id long, toxic int, x double, y double").toArrow()
    m = np.column_stack([rows.column(c).to_numpy().astype(float) for c in ("x", "y", "toxic", "doc_id")])
    m = m[np.lexsort(m.T)]
    lexicon.coefficients = _logistic(m[:, :2], m[:, 2])
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` plus the score ``name`` (0 to 1); a null or empty text has no match.

    A column of that name is replaced; repeated rows are scored each; no rows give none.
    """
    schema = StructType([*docs.drop(name).schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                yield part.append_column(name, pa.array([lexicon.score(t) for t in part.column("text").to_pylist()], pa.float64()))

    return docs.drop(name).mapInArrow(run, schema)


def held_out(doc_id):
    """A fifth of the documents, by the crc32 of the id as text; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; only labels of rows not held out are read."""
    lexicon = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lexicon)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
