"""Every query with SQL equals it; every other one runs and keeps its promises."""

import pytest

from assayer.plans import QUERIES, SQL
from tests.oracle import connected, differences


@pytest.fixture(scope="module")
def con(data):
    return connected(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, con, name):
    assert differences(QUERIES[name](spark, data), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    assert rows


def test_entry_has_all(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_donors_never_give_their_own(spark, data):
    rows = QUERIES["jon8_donor_pairing"](spark, data).collect()
    assert all(r.donor != r.p_type for r in rows)
    assert sum(r.donor is not None for r in rows) > 0


def test_spectra_keep_the_trace(spark, data):
    from assayer.functions import arrays
    from assayer.plans.numeric import _probabilities

    trace = {r.vec_id: r.trace for r in QUERIES["arr7_fisher_spectrum"](spark, data).collect()}
    for r in _probabilities(spark, data).select("vec_id", (1 - arrays.dot(arrays.F.col("p"), arrays.F.col("p"))).alias("t")).collect():
        assert abs(trace[r.vec_id] - r.t) < 1e-9
