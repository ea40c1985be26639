"""One key with nine tenths of the rows: no task takes more than its share, and results are those of one range."""

import pytest
from pyspark.sql import functions as F

from assayer.operators import auroc, ranks, transfer
from assayer.operators.ordering import quantile_ranges, ranges_needed


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.range(30_000).selectExpr("if(id % 10 = 0, concat('k', id % 30), 'hot') as k", "id as s", "int(id % 3 = 0) as label", "double(case when id % 4 = 0 then 5 else (id * 7919) % 9973 end) as score", "double((id * 31) % 977) as other").cache()


def test_ranges_hold_a_bounded_share_of_distinct_values(skewed):
    distinct = skewed.select("k", "score").distinct()
    sizes = {(r.k, r.r): r["count"] for r in quantile_ranges(distinct, ["k"], "score", 20, "r").groupBy("k", "r").count().collect()}
    hot = [n for (k, _), n in sizes.items() if k == "hot"]
    assert sum(hot) > 8000 and len(hot) >= 18 and max(hot) < 3 * sum(hot) / 20
    assert ranges_needed(skewed, ["k"], 1000) == 27 and ranges_needed(skewed, ["k"]) == 1 and ranges_needed(skewed.where("false"), ["k"]) == 1


def test_results_do_not_depend_on_ranges(spark, skewed):
    same = lambda f: f(1) == f(13)
    assert same(lambda n: sorted((r.k, r.s, round(r.rank01, 12)) for r in ranks.rank01(skewed, ["k"], buckets=n).collect()))
    assert same(lambda n: sorted((r.k, r.n, round(r.spearman, 9)) for r in ranks.spearman(skewed, ["k"], "score", "other", n).collect()))
    assert same(lambda n: sorted(map(tuple, auroc.ranked_area(skewed, ["k"], buckets=n).collect())))
    cells = skewed.selectExpr("k", "s", "label", "inline(array(struct('a' as cell, score as score), struct('b' as cell, other as score)))")
    fusion = spark.createDataFrame([("f", "a"), ("f", "b")], "fusion string, cell string")
    signs = cells.select("k", "cell").distinct().withColumn("sign", F.lit(-1))
    assert same(lambda n: sorted((r.k, r.s, round(r.score, 12)) for r in ranks.fused(cells, ["k"], "s", fusion, signs, n).collect()))
    ranked = ranks.rank01(cells.withColumn("m", F.pmod("s", F.lit(3))), ["k", "m", "cell"])
    assert same(lambda n: sorted(map(tuple, transfer.pooled_without(ranked, ["k", "cell"], "m", n).collect())))


def test_leaving_out_reads_counts_and_multiplies_nothing_by_models(spark, skewed):
    cells = skewed.withColumn("m", F.pmod("s", F.lit(7))).withColumn("cell", F.lit("a"))
    keys = ["k", "m", "cell"]
    by_sample = transfer.pooled_without(ranks.rank01(cells, keys), ["k", "cell"], "m")
    counts = ranks.counted(cells, keys).cache()
    for n in (1, 13):
        by_rank = transfer.pooled_without(ranks.rank01_of_counts(counts, keys, buckets=n), ["k", "cell"], "m", n)
        assert sorted(map(tuple, by_rank.collect())) == sorted(map(tuple, by_sample.collect()))
        assert "Join" not in transfer.pooled_without(counts.withColumn("rank01", F.col("score") / 9973), ["k", "cell"], "m", n)._jdf.queryExecution().optimizedPlan().toString()
    own = {(r.k, r.m): r.auc for r in auroc.ranked_area(cells, ["k", "m"]).collect()}
    assert {(r.k, r.m): r.auc for r in by_sample.collect()} == own


def test_fusion_deals_scores_by_number_of_rows(spark, skewed, monkeypatch):
    cells = skewed.selectExpr("k", "s", "label", "inline(array(struct('a' as cell, score as score), struct('b' as cell, if(s % 3 = 0, null, other) as score)))")
    fusions = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "a")], "fusion string, cell string")
    signs = cells.select("k", "cell").distinct().withColumn("sign", F.expr("if(cell = 'a', -1, 1)"))
    plain = {(r.k, r.fusion, r.s): r.score for r in ranks.fused(cells, ["k"], "s", fusions, signs).collect()}
    monkeypatch.setattr(ranks, "_TASK_ROWS", 2000)
    dealt = ranks.fused(cells, ["k"], "s", fusions, signs)
    assert {(r.k, r.fusion, r.s): r.score for r in dealt.collect()} == pytest.approx(plain)
    # 60,000 scores: thirty tasks, whatever their bytes
    assert dealt.rdd.getNumPartitions() == 30 and len(plain) == 60_000
    want = ranks.rank01(cells.where("cell = 'a'").withColumn("score", -F.col("score")), ["k"]).collect()
    assert {(r.k, r.s): r.rank01 for r in want} == pytest.approx({(k, s): x for (k, f, s), x in plain.items() if f == "g"})
    assert all((x is None) == (s % 3 == 0) for (_, f, s), x in plain.items() if f == "f")
