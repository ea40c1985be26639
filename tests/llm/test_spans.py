"""Places of matches, free spans and replacements against loops; texts with very many matches."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from assayer.llm import pii, secrets, spans

KIND = "array<struct<kind:int,start:int,end:int,value:string>>"


def texts():
    rng = random.Random(12)
    return [None, "", "ab", "xx", "é" * 300 + "ab1", *("".join(rng.choices(["ab1", "é", "x ", "ab22", "😀", "-"], k=rng.choice([3, 40, 255, 256, 257, 900]))) for _ in range(25))]


def test_places_equal_a_loop(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, t string").repartition(3)
    got = rows.select("i", spans.matches(F.coalesce("t", F.lit("")), 2, "ab[0-9]+").alias("m")).collect()
    for r in got:
        want = [(2, m.start(), m.end(), m[0]) for m in re.finditer("ab[0-9]+", texts()[r.i] or "")]
        assert [tuple(x) for x in r.m] == want


@pytest.mark.parametrize("seed", range(3))
def test_free_spans_and_replacements_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(30):
        text = "".join(rng.choices("abcé😀 ", k=rng.choice([0, 10, 500, 3000])))
        make = lambda n: sorted((a, min(len(text), a + rng.randrange(1, 9))) for a in (rng.randrange(len(text)) for _ in range(n if text else 0)))  # noqa: B023, E731
        mine, at = [], 0
        for a, b in make(rng.choice([0, 3, 400])):
            if a >= at:
                mine.append((3, a, b, text[a:b]))
                at = b
        rows.append((i, text, mine, [(rng.randrange(3), a, b, text[a:b]) for a, b in make(rng.choice([0, 2, 600]))]))
    df = spark.createDataFrame(rows, f"i int, t string, m {KIND}, o {KIND}")
    got = df.select("i", spans.outside(F.col("m"), F.col("o")).alias("f"), spans.replaced(F.col("t"), F.col("o"), ["<0>", "<1>", "<2>"]).alias("r")).collect()
    for r in got:
        _, text, mine, others = rows[r.i]
        assert [tuple(x) for x in r.f] == [x for x in mine if not any(x[1] < y[2] and y[1] < x[2] for y in others)]
        out, at = "", 0
        for kind, a, b, _ in sorted(others, key=lambda x: (x[1], x[0], x[2])):
            if a >= at:
                out += text[at:a] + f"<{kind}>"
            at = max(at, b)
        assert r.r == out + text[at:]


def test_a_text_with_very_many_matches_takes_time_in_proportion(spark):
    """100,000 addresses or assignments in one text of some MB."""

    def took(n, what):
        text = " ".join(f"user{i}@mail{i % 50}.org password=abcdef{i}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        began = time.perf_counter()
        out = what(df)
        return time.perf_counter() - began, out

    find = lambda df: df.select(F.size(pii.base_spans(F.col("text"))).alias("n"), F.length(spans.replaced(F.col("text"), pii._bare(pii.base_spans(F.col("text"))), pii.LABELS)).alias("k")).first()
    took(20_000, find)
    half, full = took(50_000, find), took(100_000, find)
    assert full[1].n == 100_000 and half[1].n == 50_000
    assert full[0] < 2.5 * half[0] + 2  # four times half of it, and hours, if each match copied all before it
    scan = lambda df: secrets.scanned(df, F.lit("r"), F.lit("o")).first()
    took(20_000, scan)
    half, full = took(50_000, scan), took(100_000, scan)
    assert full[1].n_assign == 100_000 and full[0] < 2.5 * half[0] + 2
