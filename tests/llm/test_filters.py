"""Toxicity, decontamination and personal data: held-out accuracy, brute force, and defined results for odd rows."""

import hashlib
import math
import random
import re
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import numpy as np

from hearthline.llm import pii, tiling, toxicity

from .conftest import words


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    bad = ["gruntle", "snivel", "blorkei", "blorkum", "blorkat", "blorkis"]
    rows = []
    for i in range(900):
        w = words(rng, rng.randint(20, 60))
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        elif rng.random() < 0.1:
            w += ["snivel", "harbour"]
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t, 1.0, 1) for i, t, _ in rows], "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_toxicity_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    out = [r for r in toxicity.classify(docs, labels).collect() if r.held_out]
    hits = sum(r.predicted for r in out if truth[r.doc_id])
    assert hits >= 0.9 * sum(truth[r.doc_id] for r in out) and sum(r.predicted for r in out if not truth[r.doc_id]) <= 2
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def test_labels_held_out_are_never_read(labelled):
    docs, labels, _ = labelled
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id"), 1 - labels.toxic).otherwise(labels.toxic))
    scores = lambda x: {r.doc_id: r.score for r in toxicity.classify(docs, x).collect()}
    assert scores(labels) == scores(flipped)


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 4.0, " scum": 3.0}, (" scum pond ",), (-3.0, 2.0, 0.5))
    machine = lexicon.automaton()
    hits = lambda t: len(lexicon.hits(machine, toxicity.fold(t)))
    assert [hits(t) for t in ("An IDIOT!", "1d10t", "idіоt", "ídiot idiot", "idiots", "scumbags", "a scum pond", "the scum ponds", "", None)] == [1, 1, 1, 2, 0, 1, 0, 1, 0, 0]
    assert lexicon.score(machine, None) == lexicon.score(machine, "") < 0.1 < lexicon.score(machine, "idiot")
    assert lexicon.score(machine, "idiot " + "x " * 500) < lexicon.score(machine, "idiot")


def plain_score(lexicon, text):
    """The score from its definition: at each word the heaviest term that the text goes on with, unless an exception phrase covers it."""
    folded = toxicity.fold(text)
    total = 0.0
    for start in (i for i, c in enumerate(folded) if c == " "):
        here = [(weight, -len(term)) for term, weight in lexicon.weights.items() if folded.startswith(term, start)]
        if here:
            weight, size = max(here)
            covered = any(folded.startswith(p, a) and start - size <= a + len(p) and start < a + len(p) for p in lexicon.exceptions for a in range(max(0, start - len(p)), start + 1))
            total += 0 if covered else weight
    words = len(folded.split())
    z = lexicon.curve[0] + lexicon.curve[1] * math.log1p(total) + lexicon.curve[2] * math.log1p(100 * total / max(words, 1))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def test_scores_equal_a_plain_scan(spark, docs, labelled):
    lexicon = replace(toxicity.learn_from_labels(*labelled[:2]), exceptions=(" snivel harbour ",))
    assert len(lexicon.weights) > 5
    texts = [r.text for r in labelled[0].collect()] + [r.text for r in docs.select("text").collect()] + ["gruntle", "Sn1vel  harbour", "snivel harbour blorkum", "bl\u043erkeist " * 3000, "harbour snivel", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(rows, lexicon).collect()}
    assert len(got) == len(texts) > 900
    assert [got[i] for i in range(len(texts))] == pytest.approx([plain_score(lexicon, t) for t in texts], abs=1e-12)
    hand = toxicity.Lexicon({" abc": 2.0, " abcd ": 3.0, " abcde": 3.0, " q ": 1.0}, (" abcd x ", " q q "), (-1.0, 1.0, 0.3))
    odd = ["abcd x", "abcde x abcd", "q q q", "abc q q abcd x abcd", "x abcd x q"]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert [r.score for r in toxicity.score(rows, hand).orderBy("doc_id").collect()] == pytest.approx([plain_score(hand, t) for t in odd], abs=1e-12)


def test_toxicity_of_odd_tables(docs, nothing, labelled):
    _, labels, _ = labelled
    assert toxicity.classify(docs, labels.limit(0)).where("score > 1e-9").count() == 0
    assert toxicity.classify(nothing, labels).count() == 0
    assert toxicity.classify(docs, labels).count() == docs.count()


def test_a_lexicon_of_more_than_300_terms(spark):
    """Every term that the labels teach is kept."""
    rng = random.Random(1)
    bad = ["".join(rng.choice("bcdfghjklm") + rng.choice("aeiou") for _ in range(6)) for _ in range(450)]
    rows = [(i, " ".join(words(rng, 12) + rng.sample(bad, 25) * (i % 2)), i % 2) for i in range(1200)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "id long, text string, toxic int"))
    assert sum(f" {w} " in lexicon.weights for w in bad) > 400


def brute_tiles(a, b, least):
    """Coverage of a by greedy string tiling, straight from its definition."""
    used_a, used_b, total = [False] * len(a), [False] * len(b), 0
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best >= least:
                    found.append((i, j))
        if not found:
            return total
        for i, j in found:
            if not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                used_a[i : i + best] = used_b[j : j + best] = [True] * best
                total += best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=25), st.lists(st.integers(1, 3), max_size=40))
def test_tiles_equal_their_definition(a, b):
    got = tiling.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
    places = [x for i, _, k in got for x in range(i, i + k)]
    assert len(places) == len(set(places)) and all(a[i : i + k] == b[j : j + k] for i, j, k in got)
    assert all(k >= 3 for _, _, k in got)
    if len(set(a)) == len(a):
        assert len(places) == brute_tiles(a, b, 3)


def test_decontamination_small_and_joined(spark, docs, nothing):
    rng = random.Random(2)
    items = [" ".join(words(rng, n)) for n in (30, 25, 40, 3)] + [None, ""]
    w = [i.split() for i in items[:3]]
    fill = lambda: words(rng, 30)
    rows = [
        (0, " ".join(fill() + w[0] + fill()), {0}), (1, ", ".join(fill() + w[1][12:] + fill() + w[1][:12]).replace("b", "B"), {1}), (2, " ".join(w[2][:10] + fill()), set()),
        (3, " ".join(fill()), set()), (4, None, set()), (5, " ".join(w[0] + fill() * 50 + w[2]), {0, 2}), (6, " ".join(w[2][:25]), {2}),
    ]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, item string, covered int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for most in (10**6, 0):
        found = {(r.doc_id, r.item_id): r for r in tiling.overlaps(table, bench, cover=0.5, most_words=most).collect()}
        assert set(found) == {(i, k) for i, _, ks in rows for k in ks}
        assert found[6, 2].covered == 25 and found[6, 2].coverage == 25 / 40
        assert tiling.overlaps(nothing, bench, most_words=most).count() == tiling.overlaps(docs, bench.limit(0), most_words=most).count() == 0


def test_tiles_equal_their_definition_on_longer_items():
    rng = random.Random(8)
    for n in range(60):
        a = rng.sample(range(1, 200), 60) if n % 2 else [rng.randint(1, 6) for _ in range(50)]
        b = []
        while len(b) < 100:
            i = rng.randrange(len(a))
            b += a[i : i + rng.randint(3, 40)] + [1000 + len(b)] * rng.randint(0, 1)
        got = tiling.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert sum(k for _, _, k in got) == brute_tiles(a, b, 3)


def test_decontamination_repetitive_items_and_null_ids(spark):
    rng = random.Random(9)
    phrase, other = words(rng, 4) * 10, words(rng, 30)
    bench = spark.createDataFrame([(1, " ".join(phrase)), (None, " ".join(other)), (2, "kurz")], "item_id int, text string")
    table = spark.createDataFrame([(5, " ".join(phrase)), (None, " ".join(other)), (6, " ".join(words(rng, 50))), (7, None), (8, " ".join(words(rng, 9) + other)), (8, " ".join(words(rng, 9) + other))], "doc_id long, text string")
    for most in (10**6, 1):
        found = sorted(((r.doc_id, r.item_id, r.covered) for r in tiling.overlaps(table, bench, most_words=most).collect()), key=str)
        assert found == [(5, 1, 40), (8, None, 30), (8, None, 30), (None, None, 30)]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def fits(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if fits(k, m[0])]


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("ab@.-+ ()0123459é٣"), max_size=50))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_pii_finds_disguised_forms_and_leaves_the_rest(spark, docs, nothing):
    rng = random.Random(4)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = number(15)
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    rows = []
    for i in range(400):
        thing = rng.choice((f"u{number(2)}@mail.example.com", f"{rng.randint(1, 255)}.4.{rng.randint(0, 255)}.9", card(), f"+1 ({number(3)}) 555-{number(4)}", f'token = "{number(4)}ab{number(20)}"', number(16), ""))
        rows.append((i, " ".join([*words(rng, 8), thing, *words(rng, 5)])))
    table = spark.createDataFrame([(*r, "b", "s") for r in rows], "doc_id long, text string, base string, spans string")
    model = pii.fit(table)
    assert model.trees is not None
    got = {r.doc_id: r for r in pii.find(table, model, redact=True).collect()}
    extra = 0
    for i, text in rows:
        base = [tuple(s) for s in got[i].base]
        assert base == brute_spans(text) and set(base) <= {tuple(s) for s in got[i].spans}
        extra += len(got[i].spans) - len(base)
        assert all(text[s.start : s.end] not in got[i].redacted for s in got[i].base)
    assert extra <= 4
    kinds = lambda text: [k for k, *_ in model.choose([text])[0][1]]
    c = card()
    assert kinds(f"{c} {c}") == ["card", "card"] and kinds("write to jan at mail3 dot example dot com now") == ["email"]
    odd = pii.find(docs, model, redact=True).collect()
    assert len(odd) == docs.count() and all(r.redacted is None or isinstance(r.redacted, str) for r in odd)
    assert pii.find(nothing, model).count() == 0 and pii.fit(nothing).trees is None
    kept = pii.redact_column(docs, model)
    assert kept.columns == docs.columns and sorted(map(repr, kept.select("text").collect())) == sorted(repr(docs.select("text").first().__class__(text=r.redacted)) for r in odd)


def test_added_spans_on_forms_that_no_training_case_had(spark):
    """Recall and precision of the spans that the trees add, on disguises and look-alikes written otherwise than those they are fitted to."""
    rng = random.Random(14)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(sign):
        body = number(15)
        full = next(body + c for c in "0123456789" if pii.luhn(body + c))
        return sign.join(full[i : i + 4] for i in range(0, 16, 4))

    name = lambda: "".join(rng.choice(("ba", "ti", "ko", "re")) for _ in range(3))
    ip = lambda s: s.join(str(rng.randint(1, 254)) for _ in range(4))
    hidden = [lambda: f"{name()} {{at}} {name()} {{dot}} org", lambda: f"{name()}<at>{name()}.net", lambda: f"{name()} @ {name()}.de", lambda: ip("(dot)"), lambda: ip(" . "), lambda: card("_"), lambda: card(". "), lambda: f"{number(3)}.{rng.randint(200, 999)}.{number(4)}"]
    plain = [lambda: f"meet at {number(1)}.{number(2)} sharp", lambda: f"version {number(1)}.{number(2)}.{number(1)}", lambda: f"look at example.{name()}", lambda: f"order {number(14)}", lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(3)} {number(2)} of {number(4)}"]
    known = [lambda: f"u{number(2)}@mail.example.com", lambda: ip("."), lambda: card(""), lambda: f"+1 ({number(3)}) 555-{number(4)}", lambda: number(16)]
    train = spark.createDataFrame([(i, " ".join([*words(rng, 8), rng.choice(known)(), *words(rng, 5)])) for i in range(600)], "doc_id long, text string")
    model = pii.fit(train)
    texts = [(" ".join([*words(rng, 6), rng.choice(kinds)(), *words(rng, 6)]), y) for y, kinds in ((1, hidden), (0, plain)) for _ in range(200)]
    found = [bool(more) for _, more in model.choose([t for t, _ in texts])]
    recall, false = sum(found[:200]) / 200, sum(found[200:]) / 200
    print(f"added spans: recall {recall:.2f}, look-alikes taken {false:.2f}")
    assert recall >= 0.4 and false <= 0.15


def test_long_runs_take_linear_time():
    text = "a" * 300_000 + "@ " + "1" * 300_000 + " " + "a.b" * 50_000 + "@"
    assert pii.base_spans(text) == []
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_personal_data_model_learns_from_every_text(spark):
    """No text with candidates is left out, and equal cases are one row."""
    docs = spark.range(12_000).selectExpr("id AS doc_id", "concat('call +44 20 7946 0958 or x', id % 3, '@mail.org') AS text")
    cases = pii.training_cases(docs, "doc_id", "text")
    base = cases.where("kind = 'email' AND label = 1")
    assert base.agg(F.sum("n")).first()[0] == 12_000 * sum(y for *_, y in pii.variants("x1@mail.org", "email", 0, 11)) and cases.count() < 200
