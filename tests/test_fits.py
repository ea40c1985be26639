"""Logistic models over blocks of samples, against NumPy."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.functions import blocks
from assayer.operators import numeric, resampling
from assayer.plans import QUERIES
from assayer.plans.deployments import SCORES_SQL
from assayer.plans.selection import _FOLDS_SQL


def newton(x, y, rounds=8):
    """As many steps as `numeric.logistic` takes, with its bounds."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(b)), x.T @ (y - p) - b)
        b = b + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return b


def out_of_fold(x, y, fold, n_folds):
    """Scores of one model; missing features are at their mean, samples without label train no weights."""
    out = np.full(len(x), np.nan)
    for held in range(n_folds):
        train, test = fold != held, fold == held
        if not train.any():
            continue
        mean, sd = np.nanmean(x[train], axis=0), np.nanstd(x[train], axis=0)
        scaled = np.nan_to_num((x - mean) / np.where(np.nanmin(x[train], axis=0) < np.nanmax(x[train], axis=0), sd, 1.0), nan=0.0)
        b = newton(scaled[train & ~np.isnan(y)], y[train & ~np.isnan(y)])
        out[test] = 1 / (1 + np.exp(-(b[0] + scaled[test] @ b[1:])))
    return out


def area(y, s):
    values, code = np.unique(s, return_inverse=True)
    ones, zeros = (np.bincount(code, weights=y == k, minlength=len(values)) for k in (1, 0))
    return (ones * (np.cumsum(zeros) - zeros / 2)).sum() / (ones.sum() * zeros.sum())


def test_models_of_several_keys_with_gaps_equal_numpy(spark):
    rng = np.random.default_rng(11)
    models, rows, want = [["a"], ["b", "a"], ["c"], ["c", "b", "constant"]], [], {}
    for key, n, n_folds in (("k", 240, 4), ("l", 90, 3), ("one", 5, 1)):
        x = np.column_stack([rng.normal(size=(n, 2)), rng.normal(1e4, 0.5, size=n), np.full(n, 0.1)])
        y = (x[:, 0] - x[:, 1] + rng.normal(size=n) > 0).astype(float)
        x[rng.random(x.shape) < 0.1] = np.nan
        x[1, 0] = np.nan
        y[::17] = np.nan
        fold = np.arange(n) % n_folds
        for m, used in enumerate(models):
            at = [["a", "b", "c", "constant"].index(f) for f in used]
            want |= {(key, i, m): s for i, s in enumerate(out_of_fold(x[:, at], y, fold, n_folds))}
        gap = lambda v: None if np.isnan(v) else float(v)
        rows += [(key, i, gap(y[i]), int(fold[i]), n_folds, *(gap(v) for v in x[i])) for i in range(n)]
    # a value that is not finite is a missing one
    rows = [(*r[:5], float("inf"), *r[6:]) if r[:2] == ("k", 1) else r for r in rows]
    held = spark.createDataFrame(rows, "k string, s int, label double, fold int, n_folds int, a double, b double, c double, constant double").repartition(5)
    got = {(r.k, r.s, m): s for r in numeric.out_of_fold_models(held, ["k"], "s", models).collect() for m, s in enumerate(r.scores)}
    assert set(got) == {k for k, s in want.items() if not np.isnan(s)} and len(got) == 330 * len(models)
    assert max(abs(s - want[k]) for k, s in got.items()) < 1e-9


def test_a_round_of_a_fit_reads_blocks_and_copies_no_rows(spark):
    rows = spark.range(6000).selectExpr("id as s", "concat('k', id % 3) as k", "cast(id % 2 as int) as label", "cast(id % 5 as int) as fold", "5 as n_folds", "cast(id % 97 as double) as a", "cast(id % 89 as double) as b").coalesce(2)
    made = numeric._blocks(rows, ["k"], ["a", "b"])
    assert made.count() <= 6
    start = numeric._first_fits(numeric._training_scales(rows, ["k"], ["a", "b"]), ["k"], ["a", "b"], 3)
    parts = numeric._round_sums(made, start, ["k"], [[0], [1], [0, 1]], 2)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
    # a row for a task, key, held fold and model, however many samples there are
    assert parts.count() <= made.rdd.getNumPartitions() * 3 * 5 * 3
    sums = {(r.k, r["_held"], r["_model"]): r.n for r in parts.groupBy("k", "_held", "_model").agg((F.sum("_h0_0") * 4).alias("n")).collect()}
    assert len(sums) == 45 and all(abs(n - 1600) < 1e-6 for n in sums.values())


def test_rows_are_ranked_by_cell_and_not_by_key_for_their_folds(spark):
    rows = spark.range(4000).selectExpr("concat('k', id % 1) as k", "id as s", "cast(id % 2 as int) as label")
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in off.items():
        spark.conf.set(name, value)
    try:
        made = resampling.folds(rows, ["k"], "s", 5, 2, 7)
        plan = made._jdf.queryExecution().executedPlan().toString().splitlines()
        sizes = {(r.rep, r.label, r.fold): r["count"] for r in made.groupBy("rep", "label", "fold").count().collect()}
    finally:
        for name in off:
            spark.conf.unset(name)
    ranked = next(i for i, line in enumerate(plan) if "Window" in line and "[_h#" in line)
    assert "_cell#" in next(line for line in plan[ranked:] if "Exchange" in line)
    assert len(sizes) == 20 and set(sizes.values()) == {400}


def test_blocks_keep_every_sample(monkeypatch):
    monkeypatch.setattr(blocks, "_HELD", 40)
    monkeypatch.setattr(blocks, "_BLOCK", 7)
    keys, x = [f"k{i % 3}" for i in range(100)], [None if i % 10 == 0 else float(i) for i in range(100)]
    table = pa.table({"k": keys, "x": x, "y": [float(i) for i in range(100)], "fold": pa.array([i % 4 for i in range(100)], pa.int32())})
    got = []
    for batch in blocks.packed(["k"], ["x", "y"])(iter(table.to_batches(max_chunksize=9))):
        for r in batch.to_pylist():
            values, fold = np.frombuffer(r["_x"]).reshape(2, -1), np.frombuffer(r["_fold"], dtype=np.int32)
            assert 1 <= len(fold) <= 7
            got += [(int(i), r["k"], None if np.isnan(v) else v, int(f)) for v, i, f in zip(*values, fold, strict=True)]
    assert sorted(got) == [(i, keys[i], x[i], i % 4) for i in range(100)]


def test_rows_without_a_feature_fit_nothing(spark):
    rows = [("k", float(i % 3 > 0), float(i % 7)) for i in range(40)]
    schema = "k string, label double, a double"
    one = numeric.logistic(spark.createDataFrame(rows, schema), ["k"], ["a"]).collect()
    gaps = numeric.logistic(spark.createDataFrame([*rows, ("k", 1.0, None), ("k", None, 5.0), ("k", 0.0, float("nan")), ("none", 1.0, None)], schema), ["k"], ["a"]).collect()
    assert [r.k for r in gaps] == ["k"] and np.abs(np.subtract(one[0].beta, gaps[0].beta)).max() < 1e-12


@pytest.fixture(scope="module")
def suite(data):
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{data}/orders.parquet'")
    sql = f"WITH {SCORES_SQL}, {_FOLDS_SQL} SELECT f.slug, f.task, f.sample_idx, f.label, f.rep, f.fold, max(k) OVER (PARTITION BY f.slug, f.task) AS k, p.score AS price, c.score AS coarse, s.score AS signal, i.score AS inverse FROM folds f JOIN kk USING (slug, task)"
    for t, c in (("p", "price"), ("c", "coarse"), ("s", "signal"), ("i", "inverse")):
        sql += f" JOIN scores {t} ON {t}.slug = f.slug AND {t}.task = f.task AND {t}.sample_idx = f.sample_idx AND {t}.cell = '{c}'"
    rows = con.execute(sql + " ORDER BY f.rep, f.sample_idx").df()

    def auc(slug, task, features):
        mine = rows[(rows.slug == slug) & (rows.task == task)]
        scores = [out_of_fold(r[features].to_numpy(float), r.label.to_numpy(float), r.fold.to_numpy(), int(r.k.iloc[0])) for _, r in mine.groupby("rep")]
        return area(mine[mine.rep == 0].label.to_numpy(), np.mean(scores, axis=0).round(12))

    return auc


def test_increments_equal_numpy(spark, data, suite):
    got = QUERIES["cv4_increment"](spark, data).collect()
    assert len({(r.slug, r.task, r.base, r.statistic) for r in got}) == len(got) == 120
    for r in got:
        base, both = suite(r.slug, r.task, [r.base]), suite(r.slug, r.task, [r.base, r.statistic])
        assert abs(r.base_auc - base) < 1e-9 and abs(r.with_stat - both) < 1e-9 and abs(r.increment - (both - base)) < 1e-9


def test_out_of_fold_areas_equal_numpy(spark, data, suite):
    got = QUERIES["cv2_out_of_fold_logistic"](spark, data).collect()
    assert len(got) == 30
    for r in got:
        assert abs(r.auc - suite(r.slug, r.task, ["price", "signal"])) < 1e-9
