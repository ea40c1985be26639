"""Edits by letters in several languages, and the score against brute force."""

import math
import random
import re

import pytest

from assayer.llm import toxicity
from tests.llm import brute

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F“”„«»]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("term", ["müllkopf", "dummkopf", "débile", "estúpido", "idiot", "ублюдок", "gañán", "schwachsinnige"])
def test_a_letter_is_one_edit_with_and_without_marks(term):
    finder = toxicity.Finder(toxicity.Model(terms=[term]))
    k = toxicity.edits(term)
    assert finder.counts(f"so ein {term}!".encode()) == (1, 0, 0)
    for i in range(len(term)):
        for letter in "aüéñж":
            for word in (term[:i] + letter + term[i + 1 :], term[:i] + letter + term[i:], term[:i] + term[i + 1 :]):
                if word != term:
                    assert finder.counts(f"ein {word}, ja".encode()) == (0, 1, 0), word
    far = "ж" * (k + 1) + term[k + 1 :]
    assert finder.counts(far.encode()) == (0, 0, 0)


def hits(model, text):
    """(exact, misspelled, quoted) by comparing every word with every term."""
    exact = wrong = quoted = 0
    text = text or ""
    for m in WORD.finditer(text.translate(LOWER)):
        word = m[0]
        near = [brute.distance(word, t) for t in model.terms if brute.distance(word, t) <= toxicity.edits(t)]
        near += [0 for s in model.stems if word.startswith(s)]
        if not near or min(near) and word in model.clean:
            continue
        before, after = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 60]
        if any(q in before for q in '"“”„«»') and any(q in after for q in '"“”„«»'):
            quoted += 1
        elif min(near):
            wrong += 1
        else:
            exact += 1
    return exact, wrong, quoted


def score(model, counts):
    exact, wrong, quoted = counts
    plain = exact + 0.5 * wrong
    w = model.weights
    return 1 / (1 + math.exp(-(w[0] + w[1] * (plain >= 1) + w[2] * math.log1p(plain) + w[3] * math.log1p(quoted))))


def test_scores_equal_brute_force(spark):
    rng = random.Random(9)
    parts = ["ba", "um", "grö", "ße", "lin", "do", "ét", "wa", "tre", "ño", "ka", "pf"]
    fine = ["".join(rng.choices(parts, k=rng.randrange(2, 5))) for _ in range(900)] + ["idiom", "milkopf"]
    bad = ["müllkopf", "idiotas", "débilette", "schwachsinnig"]
    rows = []
    for i in range(800):
        toxic, new = i % 4 == 0, i >= 600
        words = rng.choices(fine, k=rng.randrange(5, 25))
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        if new and i % 3 == 0:
            w = rng.choice(bad)
            at = rng.randrange(len(w))
            words.append(rng.choice([w[:at] + "ö" + w[at + 1 :], f"“{w}”", f'"{w} so"', f"„{w}“ wie", w.upper()]))
        rows.append((i, " ".join(words) + f" {i}", None if new else int(toxic)))
    rows += [(1000, None, None), (1001, "", None), (1002, "müllkopf " * 300, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id bigint, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id bigint, toxic int")
    model = toxicity.fitted(docs, labels)
    assert set(bad) <= {t for t in model.terms} | {b for b in bad if any(b.startswith(s) for s in model.stems)}
    got = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    for i, text, _ in rows:
        want = hits(model, text)
        assert (got[i].n_exact, got[i].n_misspelled, got[i].n_quoted) == want, (i, text)
        assert abs(got[i].score - score(model, want)) < 1e-9 and got[i].predicted == int(got[i].score >= 0.5)


def test_whole_table_equals_brute_force(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fitted(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    cache = {}
    near = brute.distance
    got = toxicity.scores(docs, labels).collect()
    for r in got:
        for w in set(WORD.findall((texts[r.doc_id] or "").translate(LOWER))) - cache.keys():
            cache[w] = any(abs(len(w) - len(t)) <= toxicity.edits(t) and near(w, t) <= toxicity.edits(t) for t in model.terms) or any(w.startswith(s) for s in model.stems)
        want = hits(model, texts[r.doc_id]) if any(cache[w] for w in WORD.findall((texts[r.doc_id] or "").translate(LOWER))) else (0, 0, 0)
        assert (r.n_exact, r.n_misspelled, r.n_quoted) == want
        assert abs(r.score - score(model, want)) < 1e-9
