"""Every query that SQL can express, against DuckDB."""

import oracle
import pytest

from keytide.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal(spark, duck, name):
    assert oracle.compare(spark, name, QUERIES[name], ORACLE_SQL[name], duck) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, oracle.SF).count() > 0


def test_approximate_counts_are_near(spark):
    exact = {r["key"]: r["n"] for r in QUERIES["pfcount_exact"](spark, oracle.SF).collect()}
    near = {r["key"]: r["n"] for r in QUERIES["pfcount_approx"](spark, oracle.SF).collect()}
    assert all(abs(near[k] - n) <= max(3, 0.05 * n) for k, n in exact.items())
