"""Bootstraps as vectors over replicates against resampled rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import numeric, resampling


def rows(n, seed, ties):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        label = int(rng.random() < 0.4)
        for j, cell in enumerate(["a", "b"]):
            out.append((f"k{i % 3}", i, i // 4, label, cell, j, None if rng.random() < 0.1 else float(rng.integers(0, ties))))
    return out


@pytest.mark.parametrize(("ties", "range_rows"), [(1000, 1 << 15), (1000, 20), (5, 20), (2, 7), (40, 1)])
def test_areas_of_resamples_do_not_depend_on_ranges(spark, ties, range_rows):
    held = spark.createDataFrame(rows(240, ties, ties), "k string, s int, stem int, label int, cell string, cell_idx int, score double").repartition(3)
    own = held.select("k", "s", "stem", "label").distinct()
    n = 19
    packed = resampling.packed_multiplicities(own, ["k"], "stem", n, 5)
    got = {(r.k, r.rep, r.cell): r for r in resampling.bag_areas(held, packed, ["k"], "s", ["cell"], n, range_rows).collect()}
    weights = {(r.k, r.rep, r.s): r.w for r in resampling.multiplicities(own, ["k"], "stem", n, 5).collect()}
    for k in ("k0", "k1", "k2"):
        for cell in "ab":
            mine = held.where(F.col("k").eqNullSafe(k) & (F.col("cell") == cell)).collect()
            s = np.array([[np.nan if r.score is None else r.score] for r in mine])
            y = np.array([r.label for r in mine])
            w = np.array([[weights[k, rep, r.s] for r in mine] for rep in range(n)])
            inside, outside = numeric.weighted_areas(s, y, w)[:, 0], numeric.weighted_areas(s, y, (w == 0).astype(int))[:, 0]
            for rep in range(n):
                r = got[k, rep, cell]
                for a, b in ((r.in_bag, inside[rep]), (r.out_of_bag, outside[rep])):
                    assert (a is None and np.isnan(b)) or abs(a - b) < 1e-12
                assert r.n_in == w[rep][np.isfinite(s[:, 0])].sum() and r.n_out == (w[rep][np.isfinite(s[:, 0])] == 0).sum()


def test_sums_over_replicates(spark):
    own = spark.createDataFrame([("x" if i % 5 else None, i, float(i % 7), None if i % 4 == 0 else 1.5) for i in range(90)], "k string, s int, v double, u double").where("k is not null").repartition(4)
    packed = resampling.packed_multiplicities(own, ["k"], "s", 11, 3)
    w = resampling.multiplicities(own, ["k"], "s", 11, 3)
    for out in (False, True):
        weight = (F.col("w") == 0).cast("int") if out else F.col("w")
        want = {r.rep: (r.a, r.b) for r in w.groupBy("rep").agg(F.sum(F.col("v") * weight).alias("a"), F.coalesce(F.sum(F.col("u") * weight), F.lit(0.0)).alias("b")).collect()}
        got = {r.rep: (r.a, r.b) for r in resampling.replicate_sums(packed, ["k"], {"a": F.col("v"), "b": F.col("u")}, 11, out).collect()}
        assert got == want and len(got) == 11


def test_one_key_with_most_rows_is_cut_into_ranges(spark):
    held = spark.range(20_000).selectExpr("if(id % 10 = 0, 'small', 'hot') as k", "id as s", "int(id % 3 = 0) as label", "double((id * 7919) % 15000) as score", "'c' as cell")
    from assayer.operators.ordering import value_ranges

    ranged = value_ranges(held, ["k"], "score", "s", 18_000, 1000, "_range")
    sizes = sorted(r["count"] for r in ranged.groupBy("k", "_range").count().collect())
    assert sizes[-1] < 2500 and len(sizes) > 15
    assert ranged.groupBy("k", "score").agg(F.countDistinct("_range").alias("n")).where("n > 1").count() == 0


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, s int, label int, score double, cell string, cell_idx int")
    assert resampling.nested_selection(none, none.select("k", "s", "label"), ["k"], "s", "s", 9, 1).collect() == []


def test_sequential_draws_of_any_size_equal_the_bootstrap_of_one_task(spark, monkeypatch):
    """Deployments are cut into chunks of units and ranges of scores; before, a task held each whole."""
    monkeypatch.setattr(resampling, "_chunk", lambda n: 16)
    monkeypatch.setattr(resampling, "RANGE_WEIGHTS", 1)
    rng = np.random.default_rng(3)
    held = [("k%d" % (i % 2), i, int(rng.integers(0, 30)), int(rng.random() < 0.4), float(rng.integers(0, 50)), None if i % 5 == 0 else float(rng.random())) for i in range(2600)]
    wide = spark.createDataFrame(held, "k string, s int, stem int, label int, a double, b double").repartition(5)
    for unit in ("s", "stem"):
        got = {r.k: r for r in numeric.parity_selection(wide, ["k"], ["a", "b"], unit, "s", 21, 8).collect()}
        for k in ("k0", "k1"):
            mine = sorted((r for r in held if r[0] == k), key=lambda r: r[1])
            want = numeric.nested_bootstrap(np.array([r[4:] for r in mine], dtype=float), np.array([r[3] for r in mine]), np.array([r[1 if unit == "s" else 2] for r in mine]), 21, 8)
            r = got[k]
            assert (r.winner, r.wins, r.n_used) == ("ab"[want["winner"]], want["wins"], want["n_used"])
            assert all(abs(r[c] - want[c]) < 1e-12 for c in ("ci_lo", "oob_median", "ci_hi"))
    (plan,) = (numeric.parity_selection(wide, ["k"], ["a", "b"], "s", "s", 21, 8)._jdf.queryExecution().executedPlan().toString(),)
    assert "FlatMapGroupsInPandas" not in plan
