"""The quality threshold that is set from labelled rows."""

import math
import random

from pyspark.sql import functions as F

from assayer.llm import quality


def test_best_threshold():
    assert -0.5 < quality.best_threshold([(0, -1.0), (0, -0.5), (1, -0.1), (1, 0.2)]) < -0.1
    assert quality.best_threshold([(1, -0.3), (1, -0.1), (0, 0.1), (0, 0.2)]) == -0.3  # nothing is gained: all stay
    mixed = [(1, -1.0 + i / 100) for i in range(100)] + [(0, -0.7)] * 50
    assert sum(s < quality.best_threshold(mixed) for label, s in mixed if label) <= 1  # clean texts are not given up for junk


def test_threshold_from_labelled_rows_rejects_nearly_clean_junk(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    clean = [" ".join(r.choices(vocabulary, k=60)) for _ in range(400)]
    junk = [" ".join(w if i not in (20, 40) else f"{w}&&&{r.randrange(10**6)}" for i, w in enumerate(r.choices(vocabulary, k=60))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id bigint, text string")
    trusted, rejected = docs.where("doc_id < 400").select("doc_id"), docs.where("doc_id >= 400").select("doc_id")
    held = docs.where(quality.fold(F.col("text")) == quality.HELD_OUT).select("doc_id")

    def kept(rows):
        found = rows.join(held, "doc_id").selectExpr("doc_id < 400 as clean", "kept").collect()
        return [sum(x.kept for x in found if x.clean == c) / sum(x.clean == c for x in found) for c in (True, False)]

    fixed, fitted = kept(quality.ruled(docs, trusted)), kept(quality.ruled(docs, trusted, rejected=rejected))
    assert fixed[0] == 1.0 and fixed[1] > 0.5, (fixed, fitted)
    assert fitted[0] > 0.9 and fitted[1] < 0.1, (fixed, fitted)
    few = quality.ruled(docs, trusted, rejected=rejected.limit(3))
    assert sorted(few.collect()) == sorted(quality.ruled(docs, trusted).collect())


def test_the_threshold_of_a_table_is_that_of_its_rows(spark):
    r = random.Random(6)
    for case in ([(r.randrange(2), r.randrange(-60, 20) / 50) for _ in range(500)], [(int(x > 0.3), x) for x in (r.random() for _ in range(300))], [(1, -0.3), (1, -0.1), (0, 0.1), (0, 0.2)]):
        assert quality._set_threshold(spark.createDataFrame(case, "label int, score double").repartition(4)) == quality.best_threshold(case)
    assert quality._set_threshold(spark.createDataFrame([(1, 0.5)], "label int, score double")) is None


def test_all_trusted_rows_count(spark):
    # the target was estimated from 20,000 trusted rows at most
    ids = spark.range(20_500).withColumnRenamed("id", "doc_id")
    assert quality._listed(ids.union(ids)).count() == 20_500


def test_texts_that_fit_nothing_are_not_shuffled(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('some words of text number ', id % 97, ' and more ', id) as text")
    trusted = docs.where("doc_id % 3 = 0").select("doc_id")
    seen = []
    plain = quality.fold
    monkeypatch.setattr(quality, "fold", lambda text: seen.append(text) or plain(text))
    logs = quality._logs(docs, trusted, 50, 10.0, True)
    assert len(seen) == 1 and len(logs) == 50
    held = docs.join(trusted, "doc_id").where(~plain(F.col("text")).isin(quality.HELD_OUT, quality.CALIBRATION))
    count = lambda df: {r.c: r["count"] for r in df.select(F.explode(quality._cells(quality.words(F.col("text")), 50)).alias("c")).groupBy("c").count().collect()}
    raw, target = count(docs), count(held)
    n, m = sum(raw.values()), sum(target.values())
    for c, k in raw.items():
        assert abs(logs[c] - (math.log((target.get(c, 0) + 10.0 * k / n) / (m + 10.0)) - math.log(k / n))) < 1e-12
    jobs = []
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: jobs.append(df._jdf.queryExecution().optimizedPlan().toString()) or collect(df))
    quality._logs(docs, trusted, 50, 10.0, True)
    assert len(jobs) == 2 and "Join" not in jobs[0] and "Join LeftSemi" in jobs[1]
