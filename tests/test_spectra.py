"""Spectra and leading directions against dense solvers."""

import time

import numpy as np
import pytest

from assayer.operators import spectra


def softmax(z):
    e = np.exp(z - z.max())
    return e / e.sum()


@pytest.mark.parametrize("seed", range(12))
def test_secular_roots_equal_the_dense_solver(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 90))
    p = softmax(rng.normal(size=n) * rng.choice([0, 0.01, 1, 8]))
    if seed % 3 == 0:  # repeated values and zeros
        p = np.concatenate([p, p[: n // 2], np.zeros(3)])
        p /= p.sum()
    want = np.linalg.eigvalsh(np.diag(p) - np.outer(p, p))[::-1]
    got = spectra.fisher_spectrum(p)
    assert len(got) == len(p) and np.abs(got - want).max() < 1e-14
    assert np.abs(spectra.fisher_spectrum(p, 3) - want[:3]).max() < 1e-14
    top = np.sort(p)[::-1]
    assert (got[: len(p) - 1] <= top[: len(p) - 1] + 1e-15).all() and (got[: len(p) - 1] >= top[1:] - 1e-15).all()
    assert abs(got.sum() - (1 - (p * p).sum())) < 1e-12


def test_a_large_vocabulary_takes_a_moment():
    p = softmax(np.random.default_rng(1).normal(size=50_000) * 3)
    began = time.perf_counter()
    top = spectra.fisher_spectrum(p, 16)
    assert time.perf_counter() - began < 5 and (np.diff(top) <= 0).all() and np.sort(p)[-2] <= top[0] <= p.max()


def test_leading_directions_equal_the_dense_solver():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(900, 400)) * 0.97 ** np.arange(400) @ np.linalg.qr(rng.normal(size=(400, 400)))[0]
    _, s, v = np.linalg.svd(a, full_matrices=False)
    got_s, got_v = spectra.leading(a, 10)
    assert np.abs(got_s / s[:10] - 1).max() < 1e-9 and np.abs(np.abs((got_v * v[:10]).sum(axis=1)) - 1).max() < 1e-6


def test_reflections_change_no_spectrum():
    rng = np.random.default_rng(3)
    w, p = rng.normal(size=(40, 25)), softmax(rng.normal(size=40))
    turned = spectra.reflected(w, 5)
    assert np.abs(turned - w).max() > 0.1 and np.abs(turned @ turned.T - w @ w.T).max() < 1e-10
    centred = w - p @ w
    want = np.linalg.eigvalsh((p[:, None] * centred).T @ centred)[::-1]
    for weights in (w, turned):
        assert np.abs(spectra.centred_spectrum(p, weights)[:25] - want).max() < 1e-12


def test_ratios_at_full_rank_and_by_definition():
    rng = np.random.default_rng(4)
    w, p, d = rng.normal(size=(30, 8)), softmax(rng.normal(size=30)), rng.normal(size=8)
    for null, energy in (spectra.static_ratios(d, w, [1, 8, 99]), spectra.fisher_ratios(p, d, w, [1, 8, 99]), spectra.centred_ratios(p, d, w, [1, 8, 99])):
        assert null[0] > null[1] and null[1] == null[2] and null[1] < 1e-4 and energy[0] < energy[1] <= 1 and energy[1] > 1 - 1e-6
    basis = np.linalg.svd(np.sqrt(p + 1e-10)[:, None] * w, full_matrices=False)[2]
    beside = d - basis[:3].T @ (basis[:3] @ d)
    assert abs(spectra.fisher_ratios(p, d, w, [3])[0][0] - np.linalg.norm(beside) / np.linalg.norm(d)) < 1e-10
    z = w @ d
    assert abs(spectra.discharged(p, d, w) - 0.5 * (p @ z**2 - (p @ z) ** 2)) < 1e-12
    assert abs(spectra.low_rank_distance(p, d, w, 8) - np.sqrt(p @ z**2 - (p @ z) ** 2)) < 1e-6
    assert spectra.fisher_ratios(p, 0 * d, w, [1]) == ([0.0], [0.0]) and spectra.centred_ratios(p, 0 * d, w, [1]) == ([0.0], [0.0])


def test_queries_use_all_dimensions(spark, data):
    from assayer.plans import QUERIES, numeric

    rows = {r.vec_id: r for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    got = QUERIES["arr7_fisher_spectrum"](spark, data).collect()
    assert len(got) == len(rows)
    for r in got[:20]:
        p = softmax(np.array(rows[r.vec_id].embedding, dtype=float))
        assert len(p) == 64 and abs(r.largest - np.linalg.eigvalsh(np.diag(p) - np.outer(p, p))[-1]) < 1e-12 and r.below <= r.largest <= r.above
    assert all(r.invariant for r in QUERIES["arr8_spectrum_statistics"](spark, data).collect())
    held = QUERIES["arr13_null_ratio"](spark, data).collect()
    assert len(held) == 9 * len(rows)
    for r in held[:45]:
        e = np.array(rows[r.vec_id].embedding, dtype=float)
        if r.kind == "fisher":
            assert abs(r.null_ratio - spectra.fisher_ratios(softmax(e), e, numeric._W, [r["rank"]])[0][0]) < 1e-9


def test_rows_are_worked_on_a_few_at_a_time_and_spectra_in_one_pass(spark, data):
    import pandas as pd
    from pyspark.sql import DataFrame

    from assayer.operators import numeric as rows
    from assayer.plans import QUERIES

    sizes = []

    class Taken:
        schema = spark.createDataFrame([], "p array<double>").schema

        def mapInPandas(self, run, schema):
            whole = pd.DataFrame({"p": [np.array([float(i)]) for i in range(1000)]})
            out = list(run(iter([whole])))
            sizes.extend(map(len, out))
            return pd.concat(out)

    got = rows.rowwise(Taken(), ["p"], lambda p: [2 * float(p[0])], "d", rows.DOUBLES)
    assert [x[0] for x in got["d"]] == [2.0 * i for i in range(1000)] and max(sizes) <= 256
    assert QUERIES["arr8_spectrum_statistics"](spark, data)._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
