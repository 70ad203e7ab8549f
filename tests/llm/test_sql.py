"""The operators that SQL can express, against DuckDB on whole tables."""

import oracle
import pytest

from keytide.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal(spark, name):
    assert oracle.compare(spark, name, QUERIES[name], ORACLE_SQL[name], oracle.connection()) is None
