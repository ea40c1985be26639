"""Logistic models, least squares and special functions against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import special
from assayer.operators import least_squares, numeric, resampling, transfer


def newton(x, y, c=1.0):
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ b)))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(b)) / c, x.T @ (y - p) - b / c)
    return b


def test_all_models_at_once_have_the_coefficients_of_each_alone(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 3))
    y = (x @ [1.5, -1, 0] + rng.normal(size=160) > 0).astype(float)
    rows = spark.createDataFrame([("k", i, float(y[i]), *map(float, x[i])) for i in range(160)], "k string, s int, label double, a double, b double, c double")
    models = {"a": ["a"], "ab": ["a", "b"], "bc": ["b", "c"]}
    got = {r.model: r.beta for r in numeric.logistic(numeric.each_model(rows, models, ["a", "b", "c"]), ["k", "model"], ["a", "b", "c"], rounds=12).collect()}
    for m, used in models.items():
        at = ["abc".index(f) for f in used]
        want = np.zeros(4)
        want[[0, *(1 + i for i in at)]] = newton(x[:, at], y)
        assert np.abs(np.array(got[m]) - want).max() < 1e-8


def test_out_of_fold_probabilities_of_a_suite(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 2))
    y = (x[:, 0] + rng.normal(size=90) > 0).astype(float)
    rows = spark.createDataFrame([("k", i, float(y[i]), i % 3, 3, *map(float, x[i])) for i in range(90)], "k string, s int, label double, fold int, n_folds int, a double, b double")
    got = {(r.model, r.s): r.score for r in numeric.out_of_fold(numeric.each_model(rows, {"a": ["a"], "ab": ["a", "b"]}, ["a", "b"]), ["k", "model"], "s", ["a", "b"]).collect()}
    for m, at in (("a", [0]), ("ab", [0, 1])):
        for fold in range(3):
            train, test = [i for i in range(90) if i % 3 != fold], [i for i in range(90) if i % 3 == fold]
            mean, sd = x[train][:, at].mean(axis=0), x[train][:, at].std(axis=0)
            b = newton((x[train][:, at] - mean) / sd, y[train])
            for i in test:
                assert abs(got[m, i] - 1 / (1 + math.exp(-(b[0] + (x[i, at] - mean) / sd @ b[1:])))) < 1e-6


#: quantiles at 0.975 and upper tails of Student's t and the normal distribution (fixed values)
QUANTILES = {1: 12.706204736175, 2: 4.302652729749, 5: 2.570581835636, 9: 2.262157162798, 10: 2.228138851986, 12: 2.178812829667, 20: 2.085963447266, 30: 2.042272456301}


def test_quantiles_and_tails(spark):
    rows = spark.createDataFrame([(k, v) for k, v in QUANTILES.items()], "df int, want double")
    for r in rows.select("df", "want", special.t_quantile(0.975, F.col("df")).alias("t"), special.t_upper(F.col("want"), F.col("df")).alias("p"), special.t_upper(-F.col("want"), F.col("df")).alias("m")).collect():
        assert abs(r.t / r.want - 1) < 1e-10 and abs(r.p - 0.025) < 1e-11 and abs(r.m - 0.975) < 1e-11
    z = spark.createDataFrame([(x,) for x in (-8.0, -3.6, -1.0, 0.0, 0.5, 1.96, 3.4, 3.6, 9.0)], "z double")
    for r in z.select("z", special.normal_upper(F.col("z")).alias("p"), special.log_gamma(F.abs("z") + 0.5).alias("g")).collect():
        want = 0.5 * math.erfc(r.z / math.sqrt(2))
        assert abs(r.p - want) < 1e-12 * max(want, 1e-8) + 1e-15 and abs(r.g - math.lgamma(abs(r.z) + 0.5)) < 1e-12


def residual(v, c):
    d = np.column_stack([np.ones(len(v)), c])
    return v - d @ np.linalg.lstsq(d, v, rcond=None)[0]


@pytest.mark.parametrize("collinear", [False, True])
def test_partial_association_equals_residuals(spark, collinear):
    rng = np.random.default_rng(7)
    c = rng.normal(size=(70, 3)) * [1, 100, 0.01] + [0, 1e4, 5]
    if collinear:
        c[:, 2] = 3 * c[:, 0] - 2
    x, y = c @ [1, 0.01, 10] + rng.normal(size=70), c @ [0, 0.02, 1] + rng.normal(size=70)
    rows = spark.createDataFrame([("k", i, float(x[i]), float(y[i]), *map(float, c[i])) for i in range(70)] + [("k", 99, None, 1.0, 1.0, 1.0, 1.0), ("few", 1, 1.0, 2.0, 3.0, 4.0, 5.0)], "k string, s int, x double, y double, a double, b double, c double").repartition(3)
    for n, names in ((0, []), (1, ["a"]), (3, ["a", "b", "c"])):
        got = {r.k: r for r in least_squares.partial_association(rows, ["k"], "x", "y", names).collect()}
        assert got["k"].n == 70 and abs(got["k"].partial - np.corrcoef(residual(x, c[:, :n]), residual(y, c[:, :n]))[0, 1]) < 1e-9 and got["few"].partial is None
    out = {r.k: r for r in least_squares.partial_interval(rows, ["k"], "s", "x", "y", ["a", "b", "c"], 21, 3).collect()}["k"]
    w = {(r.rep, r.s): r.w for r in resampling.multiplicities(rows.where("k = 'k' and x is not null"), ["k"], "s", 21, 3).collect()}
    want = []
    for rep in range(21):
        at = np.repeat(np.arange(70), [w[rep, i] for i in range(70)])
        want.append(np.corrcoef(residual(x[at], c[at]), residual(y[at], c[at]))[0, 1])
    assert out.n_used == 21 and abs(out.lo - np.percentile(want, 2.5)) < 1e-9 and abs(out.hi - np.percentile(want, 97.5)) < 1e-9


def test_weighted_regression_equals_normal_equations(spark):
    rng = np.random.default_rng(8)
    x, w = rng.normal(size=(25, 2)), rng.uniform(0.5, 4, 25)
    y = x @ [1, -2] + rng.normal(size=25)
    rows = spark.createDataFrame([("k", float(y[i]), *map(float, x[i]), float(x[i, 0] * x[i, 1]), float(w[i])) for i in range(25)] + [("two", 1.0, 1.0, 2.0, 2.0, 1.0)] * 2, "k string, y double, a double, b double, ab double, w double")
    got = {(r.k, r.term): r for r in least_squares.weighted_regression(rows, ["k"], "y", ["a", "b", "ab"], "w").collect()}
    d = np.column_stack([np.ones(25), x, x[:, 0] * x[:, 1]])
    inverse = np.linalg.inv((d * w[:, None]).T @ d)
    for i, term in enumerate(["intercept", "a", "b", "ab"]):
        assert abs(got["k", term].beta - (inverse @ (d.T @ (w * y)))[i]) < 1e-9 and abs(got["k", term].se - math.sqrt(inverse[i, i])) < 1e-9
        assert got["two", term].beta is None


def test_meta_analysis_keeps_keys_without_studies(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.5), ("b", None, 1.0), ("b", 2.0, 0.0), ("c", 1.0, 0.1), ("c", 1.2, 0.1), ("c", float("nan"), 1.0)], "g string, effect double, se double")
    got = {r.g: r for r in transfer.random_effects(rows, ["g"]).collect()}
    assert (got["a"].k, got["a"]["method"], got["a"].ci_lo) == (1, "one_study", None) and got["b"]["method"] == "none" and got["b"].k == 0 and got["b"].pooled is None
    assert got["c"]["method"] == "knapp_hartung_t" and abs(got["c"].pooled - 1.1) < 1e-9 and abs(got["c"].ci_hi - (1.1 + 12.706204736175 * math.sqrt(max(1, 2) / 200))) < 1e-6


def test_the_control_needs_exact_pairs_and_keeps_them(spark):
    rows = spark.createDataFrame([("k", i, i // 2, i % 2) for i in range(40)] + [("r", i, None, int(i % 3 == 0)) for i in range(40)], "k string, s int, stem int, label int")
    got = resampling.exchanged(rows, ["k"], "s", "stem", 3, 5).collect()
    assert len(got) == 240 and {(r.k, r["unit"]) for r in got} == {("k", "stem"), ("r", "row")}
    for perm in range(3):
        mine = [r for r in got if r.perm == perm]
        assert all(sorted(r.label for r in mine if r.k == "k" and r.stem == t) == [0, 1] for t in range(20)) and sum(r.label for r in mine if r.k == "r") == 14
    broken = rows.unionByName(spark.createDataFrame([("k", 50, 3, 1)], rows.schema))
    with pytest.raises(Exception, match="exact pairs"):
        resampling.exchanged(broken, ["k"], "s", "stem", 3, 5).collect()


def test_samples_of_a_partial_correlation_are_put_together_by_one_shuffle(spark, data):
    from assayer.plans import selection

    plan = selection._wide(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan
