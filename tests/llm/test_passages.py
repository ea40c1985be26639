"""Repeated strings and passages that documents share, against brute force."""

import random

import numpy as np

from assayer.llm import suffix_dedup
from assayer.llm._words import prefix_sums
from tests.llm import brute


def _texts(seed):
    rng = random.Random(seed)
    words = ["ta", "lo", "Mi", "né", "ru", "ki", "ze", "pa", "quelo", "vomira"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    shared = [prose(n) for n in (50, 51, 55, 60, 70, 80, 120)]
    texts = [None, "", "one", prose(300), prose(49)]
    for s in shared:
        texts += [f"{prose(rng.randrange(40))} {s} {prose(rng.randrange(40))}" for _ in range(3)]
    again = prose(60)
    texts += [f"{again} {prose(5)} {again}", texts[7], texts[7], f"{shared[4].upper()}\n{prose(10)}", shared[5].replace(" ", "  \n")]
    texts += [f"{'so ' * 70}{shared[3]}", f"{'so ' * 60}{shared[3]} {prose(4)}", f"{'so ' * 90}", f"{'so ' * 90}x"]
    return texts


def test_passages_and_strings_equal_brute_force(spark):
    texts = _texts(3)
    docs = spark.createDataFrame([(i, t, "c", 7) for i, t in enumerate(texts)], "doc_id bigint, text string, tid string, h int").repartition(4)
    got = {r.doc_id: r for r in suffix_dedup.repeated_spans(docs).collect()}
    words, strings = brute.passages(texts, 50), brute.deduplicated(texts, 400)
    for i in range(len(texts)):
        assert (got[i].passage_words, got[i].n_passages) == words[i], i
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == strings[i], i
    assert all(got[i].passage_words >= 50 for i in range(5, 26)) and got[3].passage_words == got[4].passage_words == 0


def test_representatives_do_not_depend_on_what_is_read_at_once(monkeypatch):
    data = np.frombuffer("".join(random.Random(1).choices("ab", k=3000)).encode(), dtype=np.uint8)
    c = prefix_sums(data)
    whole = suffix_dedup._representatives(c, 400, 96)
    monkeypatch.setattr(suffix_dedup, "_AT_ONCE", 37)
    assert (suffix_dedup._representatives(c, 400, 96) == whole).all() and len(whole) == 3000 - 399


def test_a_text_longer_than_a_slice(spark):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefghij ", k=2_500_000))
    docs = spark.createDataFrame([(1, long), (2, "x" + long[2_100_000:2_100_800]), (3, long[5:300])], "doc_id bigint, text string")
    got = {r.doc_id: r for r in suffix_dedup.repeated_spans(docs).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in (1, 2, 3)] == [(800, 1), (800, 1), (0, 0)]
