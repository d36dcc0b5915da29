import math
import time
import random
import re

import numpy as np
import pytest

from quillstream.llm import pii, toxicity

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    def good(kind, s):
        digits = re.sub(r"\D", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and pii.luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15

    return {kind: [m.span() for m in rule.finditer(text) if good(kind, m[0])] for kind, rule in RULES.items()}


def test_plain_rules_against_regular_expressions(sample, odd):
    rng = random.Random(1)
    texts = ["".join(rng.choice("a1.@+-( )04 9.com%") for _ in range(rng.randrange(1, 40))) for _ in range(30_000)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(200)) for _ in range(300)]
    for text in texts + [t or "" for _, t in [*sample, *odd]]:
        assert pii.plain(text) == brute(text), text


HIDDEN = {
    "write to john (at) example (dot) com now": ("email", "john (at) example (dot) com"),
    "mail john.doe at example dot co dot uk today": ("email", "john.doe at example dot co dot uk"),
    "see jоhn@exаmple.com there": ("email", "jоhn@exаmple.com"),
    "john＠example．com": ("email", "john＠example．com"),
    "call plus one five oh four five five five two six five two ok": ("phone", "plus one five oh four five five five two six five two"),
    "4111 1111 one one one one 1111": ("card", "4111 1111 one one one one 1111"),
    "anna at mail dot gr": ("email", "anna at mail dot gr"),
    "Contact: bob at mail.com today": ("email", "bob at mail.com"),
    "line\nbob at mail.com.\nline": ("email", "bob at mail.com"),
    "pay four" + " " * 140 + "one 11 1111 1111 111 one now": ("card", "four" + " " * 140 + "one 11 1111 1111 111 one"),
    "ip 10 dot 0 dot 0 dot 1 here": ("ip", "10 dot 0 dot 0 dot 1"),
    "éé １２７.０.０.１": ("ip", "１２７.０.０.１"),
}


@pytest.mark.parametrize("text", HIDDEN)
def test_disguises_map_back_to_the_source(text):
    kind, part = HIDDEN[text]
    a = text.index(part)
    assert pii.spans(text)[kind] == [(a, a + len(part))]
    long = "word " * 500 + text + " word" * 500
    assert pii.spans(long)[kind] == [(2500 + a, 2500 + a + len(part))]


@pytest.mark.parametrize("text", ["we met at noon and dot the i", "look at this dot matrix printer", "one two three", "zero-day, at one", "look at the dot on it", "see us at example.com today", "we looked at mail.com and left", "the shop sold at a dot in town", "email us at example.com", "stock at market.now is low", "f(at) or a @ b"])
def test_harmless_texts_gain_nothing(text):
    assert not any(pii.spans(text).values())


def test_added_spans_keep_base_ones(sample):
    for _, text in sample:
        base = pii.plain(text)
        found = pii.spans(text, base)
        assert all(set(base[k]) <= set(found[k]) for k in base)


def test_pii_rows(spark, odd):
    rows = [*odd, (50, "a@b.co +1 (504) 555-2652"), (51, "x" * 10**6 + "@b.co")]
    docs = spark.createDataFrame([(i, t, None, 7) for i, t in rows], "doc_id long, text string, spans string, n_chars int")
    got = pii.find(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_email, r.n_phone) for r in got if r.n_email} == {50: (1, 1), 51: (1, 0)}
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[50].text == "[EMAIL] [PHONE]" and clean[50].n_chars == 15 and clean[0].text is None
    assert pii.find(docs.limit(0)).count() == 0


def test_folding_keeps_length_and_sees_through_disguise():
    for text in ("İßǄ ﬁ ẞ", "1D10T іdіоt ｉｄｉｏｔ"):
        assert len(toxicity.fold(text)) == len(text)
    lexicon = toxicity.Lexicon({"idiot": 2.0, "clown": 1.0, "moro*": 3.0, "loser": 1.5})
    hits = lambda t: [w for *_, w in lexicon.matches(t)]
    assert hits("an IDIOT") == hits("1d10t!") == hits("іdіоt") == hits("id­iot") == [2.0]
    assert hits("1oser") == [1.5]
    assert hits("idiotic") == [] and hits("morons") == [3.0] and hits("clown") == [1.0]
    assert hits("a clown fish") == [] and hits("a clown, a clown fish") == [1.0]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.verdicts(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert sum(r.predicted for r in rows if r.toxic) > 0.85 * sum(r.toxic for r in rows)
    assert sum(r.predicted for r in rows if not r.toxic) < 0.02 * len(rows)


def test_toxicity_rows(spark, odd):
    docs = spark.createDataFrame([(i, t, "x") for i, t in odd], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (5, 1), (5, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        got = toxicity.verdicts(docs, known).collect()
        assert len(got) == len(odd) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert toxicity.verdicts(docs.limit(0), labels).count() == 0


def test_overlapping_identifiers_are_covered():
    text = "ring +1 504 555 2652 99bob@x.org now"
    found = pii.spans(text)
    assert found["phone"][0][1] > found["email"][0][0]
    assert pii.redacted(text) == "ring [PHONE] now"
    assert pii.redacted("a@b.co +1 (504) 555-2652") == "[EMAIL] [PHONE]"


@pytest.mark.parametrize("text", ["1" * 10**6, "1." * 300_000, "+1(" * 200_000, "@" * 10**6, "a[at]b" * 100_000, "0 1-" * 200_000, "one two three " * 30_000, "a" * 10**6 + "@" + "b" * 10**6])
def test_long_runs_take_time_in_proportion(text):
    began = time.process_time()
    pii.spans(text)
    assert time.process_time() - began < 30


def test_many_plain_and_added_spans():
    text = " ".join(f"u{k}@x{k}.org and v{k} [at] y{k} [dot] com" for k in range(6000))
    found = pii.spans(text)
    assert len(found["email"]) == 12_000
    assert {text[a:b] for a, b in found["email"]} >= {"u5999@x5999.org", "v5999 [at] y5999 [dot] com"}


def test_dotted_numbers_against_the_rule():
    rng = random.Random(6)
    rule = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        text = "".join(rng.choice(["1", "25", "300", ".", ".", ".", "a", "0"]) for _ in range(rng.randrange(30)))
        want = [m.span() for m in rule.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert pii.ips(text) == want, text


def naive(lexicon, text):
    """Matches and score by trying every entry at every place."""
    text = toxicity.visible(text)
    low, best = toxicity.fold(text), {}
    starts = [k for k in range(len(text)) if not (k and text[k - 1].isalnum())]

    def held(k, key, whole):
        b = k + len(key)
        return low[k:b] in (key, key.replace("l", "i")) and b <= len(text) and not (whole and b < len(text) and text[b].isalnum())

    spared = [(k, k + len(p)) for k in starts for p in map(toxicity.fold, lexicon.exceptions) if low[k : k + len(p)] == p and not (k + len(p) < len(text) and text[k + len(p)].isalnum())]
    for k in starts:
        for entry, weight in lexicon.weights.items():
            key = entry.rstrip("*")
            if held(k, key, not entry.endswith("*")) and (k not in best or weight > best[k][0]):
                best[k] = (weight, k + len(key))
    found = [(k, b, w) for k, (w, b) in sorted(best.items()) if not any(x <= k and b <= y for x, y in spared)]
    total = sum(w for *_, w in found)
    a, x, y = lexicon.coefficients
    z = a + x * math.log1p(total) + y * total / math.sqrt(text.count(" ") + text.count("\n") + 1)
    return found, 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def test_scores_against_brute_force(sample):
    rng = random.Random(8)
    words = sorted({w for _, t in sample[:60] for w in re.findall(r"[^\W_]{4,}", toxicity.fold(t or ""))})
    picked = rng.sample(words, 40)
    weights = {w if rng.random() < 0.5 else w[:4] + "*": 1 + rng.random() for w in picked}
    lexicon = toxicity.Lexicon(weights, tuple(f"{a} {b}" for a, b in zip(picked[:10], picked[10:20], strict=True)) + toxicity.EXCEPTIONS, (-3.0, 1.1, 0.7))
    texts = [t or "" for _, t in sample[:60]] + [" ".join(rng.choice([*picked, "clown fish", "x1", "é", "id­iot"]) for _ in range(30)).upper() for _ in range(60)]
    for text in texts:
        want, score = naive(lexicon, text)
        got = lexicon.matches(text)
        assert [(a, round(w, 9)) for a, _, w in got] == [(a, round(w, 9)) for a, _, w in want], text
        assert lexicon.score(text) == pytest.approx(score)


def test_exceptions_are_learnt(spark):
    bad = [(k, f"you grumble{k % 3} are a total zorp and more of it", 1) for k in range(60)]
    good = [(100 + k, f"the zorp lamp of house {k} is on", 0) for k in range(20)] + [(200 + k, f"a clean text of house {k}", 0) for k in range(200)]
    docs = spark.createDataFrame([r[:2] for r in bad + good] + [(5, "another text of the same id")] * 30, "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame([(r[0], r[2]) for r in bad + good], "doc_id long, toxic int"))
    assert "zorp" in lexicon.weights and "zorp lamp" in lexicon.exceptions and "total zorp" not in lexicon.exceptions
    assert lexicon.score("a zorp lamp here") < lexicon.score("you zorp")


def test_weights_are_those_of_the_counts(spark):
    """Every entry recomputed from how many toxic and clean documents have it."""
    rng = random.Random(9)
    clean = [f"word{chr(97 + k)}" for k in range(26)]
    rows = []
    for k in range(600):
        bad = k % 3 == 0
        words = [rng.choice(clean) for _ in range(20)] + (rng.sample(["grumblot", "grumblots", "zorkish", "vexo"], 2) if bad else []) + (["grumbling"] if not bad and rng.random() < 0.2 else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame([(k, b) for k, _, b in rows], "doc_id long, toxic int"))
    counts = {}
    for _, text, bad in rows:
        own = {w for w in text.split() if len(w) > 2}
        for term in own | {w[:k] + "*" for w in own for k in toxicity.STEMS if len(w) > k}:
            counts.setdefault(term, [0, 0])[bad] += 1
    n_bad, n_good = (sum(b == x for *_, b in rows) for x in (1, 0))
    candidates = {t: c for t, c in counts.items() if c[1] >= 3}
    bar, weights = 2 * math.log(len(candidates) + 1) + 4, {}
    for term, (m, n) in candidates.items():
        expected = (n + m) * n_bad / (n_bad + n_good)
        ratio = 2 * (n * math.log(n / expected) + (m * math.log(m / (n + m - expected)) if m else 0))
        weight = math.log((n + 0.5) / (n_bad + 1)) - math.log((m + 0.5) / (n_good + 1))
        if weight >= toxicity.LEAST_WEIGHT and ratio >= bar:
            weights[term] = weight
    assert set(lexicon.weights) <= set(weights) and {"vexo", "zork*"} & set(lexicon.weights)
    assert all(lexicon.weights[t] == pytest.approx(weights[t]) for t in lexicon.weights)
    for term in set(weights) - set(lexicon.weights):  # what went is said by one that stayed
        bare = term.rstrip("*")
        stems = [bare[:k] + "*" for k in toxicity.STEMS if k < len(bare)]
        longer = [t for t in lexicon.weights if not t.endswith("*") and t.startswith(bare)]
        assert any(s in weights and (weights[s] >= weights[term] - 0.3) for s in stems) or longer
    # the coefficients leave the loss where it is flat
    x = np.array([[1, *lexicon.measures(t)] for _, t, _ in rows])
    y = np.array([b for *_, b in rows])
    p = 1 / (1 + np.exp(-x @ np.array(lexicon.coefficients)))
    slope = x.T @ (p - y) + np.array([1e-9, 0.02, 0.02]) * np.array(lexicon.coefficients)
    assert all(abs(g) < 1e-3 or (c == 0 and g > 0) for g, c in zip(slope, lexicon.coefficients, strict=True))
