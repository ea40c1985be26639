"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from assayer.llm import importance
from assayer.llm.queries import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent, n, buckets, least, seed):
    cells = {d: [zlib.crc32(x.encode()) % buckets for x in runs(t, n)[1]] for d, t in docs}
    s, t = np.zeros(buckets), np.zeros(buckets)
    for d, _ in docs:
        np.add.at(s, cells[d], 1)
    for x in target:
        np.add.at(t, [zlib.crc32(f.encode()) % buckets for f in runs(x, n)[1]], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for d, text in docs:
        weight = sum(gain[c] for c in cells[d]) // len(cells[d]) if cells[d] else 0
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        rows.append((d, runs(text, n)[0], len(cells[d]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    part = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0]))
    ranks = {r[0]: i + 1 for i, r in enumerate(part[: math.floor(percent * len(part) / 100)])}
    return sorted((*r, ranks.get(r[0])) for r in rows)


def table(df):
    return sorted((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(6)
    words = ["ta", "LO", "mí", "né,", "ru-ki", "x7", "ÉZE", "pa.", "Kö", "12"]
    texts = [None, "", "...", "one", " ".join(rng.choices(words, k=40_000)), *(" ".join(rng.choices(words[: rng.randrange(2, 10)], k=rng.randrange(60))) for _ in range(150))]
    texts += [texts[9]] * 60
    docs = [(i * 3 - 9, t) for i, t in enumerate(texts)]
    target = [None, "", "ta mí x7 né ta", "Pa pa pa kö 12"]
    frame = spark.createDataFrame([(d, t, "n", 5, 1.0) for d, t in docs], "doc_id bigint, text string, score string, bucket int, weight double").repartition(5)
    return docs, frame, target, spark.createDataFrame([(t,) for t in target], "text string")


@pytest.mark.parametrize(("n", "percent", "least", "buckets"), [(1, 10, 20, 10_000), (3, 37.5, 1, 100), (2, 100, 0, 7), (1, 0, 20, 50)])
def test_equals_brute_force(small, n, percent, least, buckets):
    docs, frame, target, aim = small
    got = importance.scored(frame, aim, percent=percent, n=n, least_words=least, buckets=buckets, seed=11)
    assert table(got) == brute(docs, target, percent, n, buckets, least, 11)


def test_whole_table(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = sorted((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in queries()["op11_importance_resampling"](spark, data).collect())
    assert got == [(d, f, w, s, r) for d, _, f, w, s, r in brute(docs, items, 10, 1, 10_000, 20, 2024)]


def test_drawn_documents_keep_their_columns(small):
    docs, frame, _, aim = small
    drawn = importance.resampled(frame, aim, percent=20, seed=3)
    ranks = {r.doc_id for r in importance.scored(frame, aim, percent=20, seed=3).where("rank is not null").collect()}
    assert drawn.columns == frame.columns and {r.doc_id for r in drawn.collect()} == ranks and len(ranks) > 10


def test_no_rows_no_target_and_repeated_rows(spark, small):
    _, frame, _, aim = small
    assert importance.scored(frame.where("false"), aim).collect() == []
    assert importance.resampled(frame.where("false"), aim).count() == 0
    alike = importance.scored(frame, aim.where("false"), buckets=50)
    assert all(r.weight is not None for r in alike.collect())
    text = " ".join(f"w{i}" for i in range(30))
    rows = importance.scored(spark.createDataFrame([(None, text), (1, text), (1, text), (1, "short")], "doc_id bigint, text string"), aim, percent=100).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3] and sorted(r.score for r in rows)[0] is not None
    assert len({r["rank"] for r in rows if r.doc_id == 1 and r.n_words == 30}) == 2


def test_ring_extends_the_states_of_the_last_starts():
    tokens = [b"a", b"bc", b"d", b"bc"]
    for n in (1, 2, 3, 9):
        want = sorted(zlib.crc32(b" ".join(tokens[i : i + k])) for k in range(1, n + 1) for i in range(len(tokens) - k + 1))
        assert sorted(importance.ring(tokens, n)) == want
    assert importance.ring([], 2) == []
