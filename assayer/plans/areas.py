"""Queries over areas under the curve: sign locking, winners, survival, coverage and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assayer.functions.numbers import finite, rounded
from assayer.operators import auroc, summaries
from assayer.plans.deployments import LOCKED_SQL, SAMPLES_SQL, SCORES_SQL, area_sql, samples, scores
from assayer.plans.registry import query

CELL = ["slug", "task", "cell_idx", "cell"]
DEPLOYMENT = ["slug", "task"]
GEOMETRIC = ["signal", "inverse", "sparse"]


def locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auroc.sign_locked(scores(spark, sf_dir), CELL)


@query(f"WITH {LOCKED_SQL} SELECT slug, task, cell, round(auroc, 9) AS auroc, sign, n_evaluated FROM locked")
def auc1_sign_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locked(spark, sf_dir).select("slug", "task", "cell", rounded(F.col("auroc")).alias("auroc"), "sign", "n_evaluated")


@query(f"WITH {LOCKED_SQL} SELECT slug, task, cell, round(auroc, 9) AS auroc, sign FROM locked")
def auc2_spread_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same areas with each cell's values dealt into ranges."""
    out = auroc.sign_locked(scores(spark, sf_dir), CELL, buckets=16)
    return out.select("slug", "task", "cell", rounded(F.col("auroc")).alias("auroc"), "sign")


@query(
    f"WITH {SCORES_SQL}, turned AS (SELECT *, score * (CASE WHEN cell = 'inverse' THEN -1 ELSE 1 END) AS t FROM scores) "
    f"SELECT slug, task, cell, CASE WHEN n >= 4 THEN round(auc, 9) END AS auroc, n FROM {area_sql('turned', 'slug, task, cell_idx, cell', 't')}"
)
def auc3_fixed_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = scores(spark, sf_dir).withColumn("sign", F.when(F.col("cell") == "inverse", -1).otherwise(1))
    return auroc.fixed_sign(signed, CELL).select("slug", "task", "cell", rounded(F.col("auroc")).alias("auroc"), "n")


@query(f"WITH {SCORES_SQL} SELECT task, cell, round(auc, 9) AS auroc, n1, n0 FROM {area_sql('scores', 'task, cell')}")
def auc4_midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auroc.ranked_area(scores(spark, sf_dir), ["task", "cell"]).select("task", "cell", rounded(F.col("auc")).alias("auroc"), "n1", "n0")


@query(
    f"WITH {SCORES_SQL}, held AS (SELECT slug, cell, sample_idx, label, CASE WHEN slug = 'm3' THEN 1.0 ELSE score END AS score FROM scores) "
    f"SELECT a.slug, a.cell, CASE WHEN v > 1e-8 THEN round(auc, 9) END AS auroc FROM {area_sql('held', 'slug, cell')} a JOIN (SELECT slug, cell, stddev_pop(score) AS v FROM held GROUP BY ALL) USING (slug, cell)"
)
def auc5_constant_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = scores(spark, sf_dir).withColumn("score", F.when(F.col("slug") == "m3", F.lit(1.0)).otherwise(F.col("score")))
    return auroc.varying(some, ["slug", "cell"]).select("slug", "cell", rounded(F.col("auroc")).alias("auroc"))


@query(
    f"WITH {SCORES_SQL} SELECT a.slug, a.cell, CASE WHEN missing = 0 THEN round(auc, 9) END AS auroc "
    f"FROM {area_sql('scores', 'slug, cell')} a JOIN (SELECT slug, cell, count(*) - count(score) AS missing FROM scores GROUP BY ALL) USING (slug, cell)"
)
def auc6_strict_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auroc.strict(scores(spark, sf_dir), ["slug", "cell"]).select("slug", "cell", rounded(F.col("auroc")).alias("auroc"))


@query(
    f"WITH {SCORES_SQL}, held AS (SELECT slug, cell, label, CASE WHEN slug = 'm3' THEN 1.0 ELSE score END AS score FROM scores), "
    f"a AS (SELECT a.slug, a.cell, CASE WHEN n >= 5 AND v THEN auc END AS auc FROM {area_sql('held', 'slug, cell')} a JOIN (SELECT slug, cell, max(score) > min(score) AS v FROM held GROUP BY ALL) USING (slug, cell)) "
    "SELECT slug, cell, round(auc, 9) AS auroc, CASE WHEN auc > 0.5 THEN 'hi' WHEN auc < 0.5 THEN 'lo' WHEN auc = 0.5 THEN '=' END AS direction FROM a"
)
def auc7_direction_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = scores(spark, sf_dir).withColumn("score", F.when(F.col("slug") == "m3", F.lit(1.0)).otherwise(F.col("score")))
    return auroc.direction(some, ["slug", "cell"]).select("slug", "cell", rounded(F.col("auroc")).alias("auroc"), "direction")


WINNERS_SQL = LOCKED_SQL + """, winners AS (SELECT slug, task, cell, cell_idx, auroc, sign FROM locked WHERE auroc IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY slug, task ORDER BY abs(auroc - 0.5) DESC, cell_idx) = 1)"""


def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auroc.first_best(locked(spark, sf_dir), DEPLOYMENT, F.abs(F.col("auroc") - 0.5), "cell_idx", ["cell", "cell_idx", "auroc", "sign"])


@query(f"WITH {WINNERS_SQL} SELECT slug, task, cell AS winner, round(auroc, 9) AS auroc, sign FROM winners")
def agg1_first_tie_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winners(spark, sf_dir).select("slug", "task", F.col("cell").alias("winner"), rounded(F.col("auroc")).alias("auroc"), "sign")


@query(
    f"WITH {WINNERS_SQL}, c AS (SELECT task, cell, cell_idx, count(*) AS n FROM winners GROUP BY ALL) "
    "SELECT task, cell AS winner, n AS wins, round(n * 1.0 / sum(n) OVER (PARTITION BY task), 9) AS stability FROM c QUALIFY row_number() OVER (PARTITION BY task ORDER BY n DESC, cell_idx) = 1"
)
def agg2_modal_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.modal(winners(spark, sf_dir), ["task"], "cell", "cell_idx")
    return out.select("task", F.col("cell").alias("winner"), F.col("n").alias("wins"), rounded(F.col("share")).alias("stability"))


@query(f"WITH {SAMPLES_SQL}, c AS (SELECT slug, stratum, count(*) AS n FROM samples GROUP BY ALL) SELECT slug, stratum AS value, n FROM c QUALIFY row_number() OVER (PARTITION BY slug ORDER BY n DESC, stratum) = 1")
def agg3_modal_lexicographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.modal_lexicographic(samples(spark, sf_dir), ["slug"], "stratum").select("slug", F.col("stratum").alias("value"), "n")


@query(f"WITH {WINNERS_SQL} SELECT cell, count(*) AS wins, round(count(*) * 1.0 / sum(count(*)) OVER (), 9) AS share FROM winners GROUP BY cell")
def agg4_win_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.shares(winners(spark, sf_dir), [], "cell").select("cell", F.col("n").alias("wins"), rounded(F.col("share")).alias("share"))


@query(
    f"WITH {SCORES_SQL} SELECT slug, cell, round(quantile_cont(score, 0.025), 9) AS lo, round(quantile_cont(score, 0.5), 9) AS median, round(quantile_cont(score, 0.975), 9) AS hi FROM scores GROUP BY ALL"
)
def agg5_percentile_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.interval(scores(spark, sf_dir), ["slug", "cell"], "score")
    return out.select("slug", "cell", *(rounded(F.col(c)).alias(c) for c in ("lo", "median", "hi")))


@query(f"WITH {LOCKED_SQL} SELECT slug, cell, CASE WHEN sum(sign) >= 0 THEN 1 ELSE -1 END AS sign FROM locked GROUP BY ALL")
def agg6_majority_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locked(spark, sf_dir).groupBy("slug", "cell").agg(summaries.majority_sign("sign").alias("sign"))


@query(
    f"WITH {LOCKED_SQL}, m AS (SELECT cell, task, CASE WHEN sum(sign) >= 0 THEN 1 ELSE -1 END AS modal_sign FROM locked GROUP BY ALL) "
    "SELECT cell, task, modal_sign, count(*) AS models, count(*) FILTER (sign = modal_sign) AS agreeing, round(avg(CASE WHEN sign = modal_sign THEN 1.0 ELSE 0.0 END), 9) AS agreement FROM locked JOIN m USING (cell, task) WHERE sign <> 0 GROUP BY ALL"
)
def agg7_sign_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.sign_stability(locked(spark, sf_dir), ["cell", "task"]).withColumn("agreement", rounded(F.col("agreement")))


@query(
    f"WITH {LOCKED_SQL}, c AS (SELECT task, cell, cell_idx, count(*) FILTER (auroc > 0.55) AS survivors, count(auroc) AS models FROM locked GROUP BY ALL) "
    "SELECT task, cell, survivors, models, row_number() OVER (PARTITION BY task ORDER BY survivors DESC, cell_idx) = 1 AS best FROM c"
)
def agg8_survival_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.survival(locked(spark, sf_dir), ["task"], 0.55).select("task", "cell", "survivors", "models", "best")


@query(
    f"WITH {SCORES_SQL}, u AS (SELECT slug, cell, max(auc) FILTER (task = 'alpha') AS a, max(auc) FILTER (task = 'beta') AS b FROM {area_sql('scores', 'slug, task, cell')} GROUP BY ALL) "
    "SELECT slug, count(*) AS cells, count(*) FILTER (a > 0.55 OR b > 0.55) AS covered_any, count(*) FILTER ((a > 0.55 OR b > 0.55) AND cell IN ('signal', 'inverse', 'sparse')) AS covered_geometric, "
    "CASE WHEN bool_or(a > 0.55 AND cell IN ('signal', 'inverse', 'sparse')) THEN 'gap_free' WHEN bool_or(a > 0.55) THEN 'detector_gap' ELSE 'measurement_orphan' END AS class FROM u GROUP BY slug"
)
def agg10_coverage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = auroc.ranked_area(scores(spark, sf_dir), ["slug", "task", "cell"])
    pair = area.groupBy("slug", "cell").agg(*(F.max(F.when(F.col("task") == t, F.col("auc"))).alias(n) for t, n in (("alpha", "a"), ("beta", "b"))))
    return summaries.coverage(pair, ["slug"], 0.55, GEOMETRIC)


#: deployments by status: a model is planned for all tasks; some have no result, some fail commitment
STATUS_SQL = WINNERS_SQL + """, planned AS (SELECT DISTINCT slug, task FROM samples), status AS (SELECT slug, task,
  CASE WHEN slug = 'm9' AND task = 'gamma' THEN 'UNRUN' WHEN task = 'beta' AND slug IN ('m1', 'm2', 'm3') OR task = 'alpha' AND slug IN ('m1', 'm2') THEN 'COMMITMENT_FAIL' ELSE 'OK' END AS status, auroc
  FROM planned LEFT JOIN winners USING (slug, task))"""


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug, task = F.col("slug"), F.col("task")
    planned = samples(spark, sf_dir).select("slug", "task").distinct()
    fail = ((task == "beta") & slug.isin("m1", "m2", "m3")) | ((task == "alpha") & slug.isin("m1", "m2"))
    status = F.when((slug == "m9") & (task == "gamma"), "UNRUN").when(fail, "COMMITMENT_FAIL").otherwise("OK")
    return planned.join(winners(spark, sf_dir), DEPLOYMENT, "left").select("slug", "task", status.alias("status"), "auroc")


@query(
    f"WITH {STATUS_SQL}, v AS (SELECT slug, task, CASE status WHEN 'UNRUN' THEN NULL WHEN 'OK' THEN auroc > 0.6 ELSE FALSE END AS ok FROM status) "
    "SELECT task, count(*) AS planned, count(*) FILTER (ok) AS passed, CASE WHEN bool_or(ok IS NULL) THEN NULL ELSE count(*) FILTER (ok) >= 7 END AS verdict FROM v GROUP BY task"
)
def agg11_endpoint_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.when(F.col("status") == "UNRUN", F.lit(None).cast("boolean")).when(F.col("status") == "OK", F.col("auroc") > 0.6).otherwise(False)
    return summaries.verdict(statuses(spark, sf_dir).withColumn("ok", ok), ["task"], "ok", 7)


@query(
    f"WITH {STATUS_SQL}, f AS (SELECT *, count(*) FILTER (status = 'COMMITMENT_FAIL') OVER (PARTITION BY task) >= 3 AS systematic FROM status) "
    "SELECT slug, task, status, systematic, CASE WHEN systematic OR status <> 'OK' THEN 0.0 ELSE round(auroc, 9) END AS value FROM f"
)
def agg12_systematic_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.systematic(statuses(spark, sf_dir), ["task"], "COMMITMENT_FAIL", 3)
    value = F.when(F.col("systematic") | (F.col("status") != "OK"), F.lit(0.0)).otherwise(rounded(F.col("auroc")))
    return out.select("slug", "task", "status", "systematic", value.alias("value"))


@query(f"WITH {STATUS_SQL} SELECT status, count(*) AS n FROM status GROUP BY status")
def agg13_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuses(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {SCORES_SQL}, g AS (SELECT slug, cell, label, avg(score) AS m, var_samp(score) AS v, count(score) AS n FROM scores WHERE score IS NOT NULL GROUP BY ALL), "
    "j AS (SELECT a.slug, a.cell, a.n AS n1, b.n AS n0, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS d FROM g a JOIN g b ON a.slug = b.slug AND a.cell = b.cell AND a.label = 1 AND b.label = 0), "
    "h AS (SELECT *, d * (1 - 3.0 / (4.0 * (n1 + n0) - 9)) AS g, sqrt((n1 + n0) * 1.0 / (n1 * n0) + d * d / (2.0 * (n1 + n0))) AS se FROM j) "
    "SELECT slug, cell, round(g, 6) AS g, round(g - 1.96 * se, 6) AS lo, round(g + 1.96 * se, 6) AS hi FROM h"
)
def agg14_hedges_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.hedges(scores(spark, sf_dir), ["slug", "cell"])
    return out.select("slug", "cell", *(rounded(F.col(c), 6).alias(c) for c in ("g", "lo", "hi")))


@query(f"WITH {SCORES_SQL} SELECT slug, cell, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, min(score) AS least, max(score) AS greatest, round(corr(score, label), 6) AS r FROM scores GROUP BY ALL")
def agg15_repeat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    return scores(spark, sf_dir).groupBy("slug", "cell").agg(
        F.count(s).alias("n"), rounded(F.avg(s), 6).alias("mean"), rounded(F.stddev_samp(s), 6).alias("sd"), F.min(s).alias("least"), F.max(s).alias("greatest"), rounded(F.corr(s, F.col("label").cast("double")), 6).alias("r")
    )


@query(f"WITH {SAMPLES_SQL} SELECT stratum, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1 FROM samples GROUP BY stratum")
def agg16_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = samples(spark, sf_dir).groupBy("stratum").pivot("label", [0, 1]).count().na.fill(0)
    return out.select("stratum", F.col("0").alias("label_0"), F.col("1").alias("label_1"))


THRESHOLD_SQL = SCORES_SQL + """, d AS (SELECT slug, cell, score, sum(label) AS p, sum(1 - label) AS q FROM scores WHERE score IS NOT NULL GROUP BY ALL),
cand AS (SELECT slug, cell, coalesce((score + lag(score) OVER w) / 2, score - 1e-9) AS t, sum(p) OVER up AS tp, sum(q) OVER up AS fp FROM d WINDOW w AS (PARTITION BY slug, cell ORDER BY score), up AS (PARTITION BY slug, cell ORDER BY score ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  UNION ALL SELECT slug, cell, max(score) + 1e-9, 0, 0 FROM d GROUP BY slug, cell),
tot AS (SELECT slug, cell, sum(p) AS np, sum(q) AS nq FROM d GROUP BY ALL),
best AS (SELECT slug, cell, t, tp * 1.0 / np - fp * 1.0 / nq AS j FROM cand JOIN tot USING (slug, cell) QUALIFY row_number() OVER (PARTITION BY slug, cell ORDER BY round(j, 12) DESC, t) = 1)"""


@query(f"WITH {THRESHOLD_SQL} SELECT slug, cell, round(t, 6) AS threshold, round(j, 9) AS youden FROM best")
def agg17_youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.youden(scores(spark, sf_dir), ["slug", "cell"])
    return out.select("slug", "cell", rounded(F.col("threshold"), 6).alias("threshold"), rounded(F.col("youden")).alias("youden"))


@query(f"WITH {SCORES_SQL} SELECT slug, sample_idx, round(cume_dist() OVER (PARTITION BY slug, task ORDER BY score), 9) AS percentile FROM scores WHERE cell = 'signal'")
def agg18_empirical_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = scores(spark, sf_dir, ["signal"])
    return held.select("slug", "sample_idx", rounded(F.cume_dist().over(W.partitionBy("slug", "task").orderBy("score"))).alias("percentile"))


@query(
    f"WITH {SCORES_SQL}, w AS (SELECT slug, task, sample_idx, label, max(score) FILTER (cell = 'price') AS v1, max(score) FILTER (cell = 'signal') AS v2 FROM scores GROUP BY ALL), "
    "m AS (SELECT slug, quantile_cont(v1, 0.5) AS m1, quantile_cont(v2, 0.5) AS m2, quantile_cont(v2, 0.9) AS hi, quantile_cont(v2, 0.1) AS lo FROM w GROUP BY slug) "
    "SELECT slug, sample_idx, k AS kind FROM w JOIN m USING (slug), (VALUES ('false_negative'), ('false_positive'), ('caught_by_second')) t(k) "
    "WHERE (k = 'false_negative' AND label = 1 AND v2 <= lo) OR (k = 'false_positive' AND label = 0 AND v2 >= hi) OR (k = 'caught_by_second' AND label = 1 AND v1 < m1 AND v2 > hi)"
)
def agg19_failure_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = scores(spark, sf_dir, ["price", "signal"]).groupBy("slug", "task", "sample_idx", "label").pivot("cell", ["price", "signal"]).agg(F.max("score"))
    return summaries.failures(wide.withColumnsRenamed({"price": "v1", "signal": "v2"}), ["slug"]).select("slug", "sample_idx", "kind")


@query(
    f"WITH {SCORES_SQL} SELECT slug, CASE WHEN score IS NULL THEN 'missing' WHEN score < 10 THEN 'below_floor' WHEN score > 1000 THEN 'above_ceiling' ELSE 'kept' END AS reason, count(*) AS n FROM scores GROUP BY ALL"
)
def agg20_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = finite(F.col("score"))
    reason = F.when(s.isNull(), "missing").when(s < 10, "below_floor").when(s > 1000, "above_ceiling").otherwise("kept")
    return scores(spark, sf_dir).groupBy("slug", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
