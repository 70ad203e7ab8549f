"""Every query of the library with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keytide.plans import clients, cluster, commands, logs, moves, reports, state
from keytide.plans.views import Query

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (state, commands, cluster, moves, clients, logs, reports):
    QUERIES |= _part.R.queries
    ORACLE_SQL |= _part.R.sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["counter_replay"](spark, sf_dir)
