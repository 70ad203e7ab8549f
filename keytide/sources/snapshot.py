"""Snapshots: state tables and a manifest row, and recovery from snapshot plus log suffix.

Data is written first, the manifest last: a snapshot that has no manifest was never taken. The manifest names the last
index its tables hold, so a replay of entries beyond it gives the state exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(spark: SparkSession, path: str, tables: dict[str, DataFrame], last_idx: int, last_term: int = 0, dbid: str = "") -> None:
    """Writes tables under path/idx=<last_idx> and publishes them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/idx={last_idx}/{name}")
    row = [(dbid, last_term, last_idx, sorted(tables))]
    spark.createDataFrame(row, "dbid string, last_term long, last_idx long, tables array<string>").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def latest(spark: SparkSession, path: str) -> tuple[int, dict[str, DataFrame]]:
    """The last published index and its tables."""
    row = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("last_idx")).first()
    return row["last_idx"], {t: spark.read.parquet(f"{path}/idx={row['last_idx']}/{t}") for t in row["tables"]}


def latest_or_none(spark: SparkSession, path: str) -> tuple[int, dict[str, DataFrame]]:
    """The last published index and its tables; -1 and none before the first."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return latest(spark, path) if there else (-1, {})


def restore_counters(base: DataFrame, suffix: DataFrame) -> DataFrame:
    """Counters (key, value) of a snapshot after the log suffix: the base is a SET before all of it."""
    from keytide.operators.keyspace import Keyspace

    seed = base.select(F.lit(-1).cast("long").alias("idx"), "key", F.lit("SET").alias("cmd"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), F.col("value").alias("num"))
    return Keyspace(seed.unionByName(suffix.select("idx", "key", "cmd", "field", "value", "num"))).counters()


def merge_keys(state: DataFrame, imported: DataFrame) -> DataFrame:
    """state (key, value) with imported keys in place of its own."""
    return state.join(imported.select("key"), "key", "left_anti").unionByName(imported.select(*state.columns))


def compacted(log: DataFrame, upto: int) -> DataFrame:
    """The log after entries up to an index have gone into a snapshot."""
    return log.where(F.col("idx") > upto)
