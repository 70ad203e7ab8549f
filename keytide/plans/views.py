"""How the driver's tables are read as logs, keyspaces and topologies; each view as a DataFrame and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.session import table

#: Readings of events as commands.
COMMANDS = {"signup": "SET", "click": "INCRBY", "view": "SADD", "purchase": "RPUSH", "error": "DEL"}

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put


def log(spark: SparkSession, sf: str, mapping: dict[str, str] = COMMANDS) -> DataFrame:
    """events as a log: idx, key, cmd, field, value, num, ts, client. Columns that a query doesn't use aren't read."""
    e = table(spark, sf, "events")
    cmd = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col("event_type")]
    num = F.round(F.col("value") * 100).cast("long")
    return e.select(
        F.col("event_id").alias("idx"), F.concat(F.lit("u"), F.col("user_id")).alias("key"), cmd.alias("cmd"),
        F.concat(F.lit("f"), num % 7).alias("field"), num.cast("string").alias("value"), num.alias("num"), F.col("ts"), F.col("user_id").alias("client"),
    )


def log_sql(mapping: dict[str, str] = COMMANDS) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return (
        "log AS (SELECT event_id AS idx, 'u' || CAST(user_id AS VARCHAR) AS key, "
        f"CASE event_type {cases} END AS cmd, 'f' || CAST(CAST(round(value * 100) AS BIGINT) % 7 AS VARCHAR) AS field, "
        "CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS value, CAST(round(value * 100) AS BIGINT) AS num, ts, user_id AS client FROM events)"
    )


#: CRC-16 of a text's bytes modulo the slots, in SQL; {k} is the text of one-byte letters.
SLOT_SQL = (
    "list_reduce(list_transform(list_concat([''], string_split({k}, '')), lambda c: CASE WHEN c = '' THEN 0 ELSE ord(c) END), "
    "lambda crc, b: list_reduce([xor(crc, b * 256), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN (x & 32768) > 0 THEN xor(x * 2, 4129) & 65535 ELSE (x * 2) & 65535 END)) & 16383"
)


def orders_zset(spark: SparkSession, sf: str) -> DataFrame:
    """A sorted set a customer: members are order keys as text, scores are prices in cents."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").cast("string").alias("member"), F.round(F.col("o_totalprice") * 100).cast("long").alias("score"))


ZSET_SQL = "z AS (SELECT o_custkey AS key, CAST(o_orderkey AS VARCHAR) AS member, CAST(round(o_totalprice * 100) AS BIGINT) AS score FROM orders)"


def line_lists(spark: SparkSession, sf: str) -> DataFrame:
    """A list an order: part keys by line number, positions from 0."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") - 1).alias("pos"), F.col("l_partkey").alias("value"))


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    """nation as shard groups: 655 slots each; groups of region 3 are moving to those of region 1 that are as far in their region's order."""
    n = table(spark, sf, "nation")
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    base = n.select(
        F.format_string("g%02d", k).alias("group_id"), (r == 0).alias("local"), (k * 655).cast("int").alias("start"), (k * 655 + 654).cast("int").alias("end"),
        F.when(r == 3, 3).when(r == 4, 2).otherwise(1).alias("type"), F.lit(0).cast("long").alias("session_key"), k.alias("position"),
    )
    incoming = n.where(r == 3).select(
        F.lit("g00").alias("group_id"), F.lit(True).alias("local"), (k * 655).cast("int").alias("start"), (k * 655 + 654).cast("int").alias("end"),
        F.lit(2).alias("type"), F.lit(7).cast("long").alias("session_key"), (k + 100).alias("position"),
    )
    return base.unionByName(incoming)


RANGES_SQL = (
    "ranges AS (SELECT printf('g%02d', n_nationkey) AS group_id, n_regionkey = 0 AS local, n_nationkey * 655 AS \"start\", n_nationkey * 655 + 654 AS \"end\", "
    "CASE n_regionkey WHEN 3 THEN 3 WHEN 4 THEN 2 ELSE 1 END AS type, n_nationkey AS position FROM nation "
    "UNION ALL SELECT 'g00', true, n_nationkey * 655, n_nationkey * 655 + 654, 2, n_nationkey + 100 FROM nation WHERE n_regionkey = 3)"
)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Three nodes a group."""
    n = table(spark, sf, "nation")
    return n.select(F.format_string("g%02d", "n_nationkey").alias("group_id"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("node_no")).select(
        "group_id", "node_no", F.concat(F.rpad("group_id", 32, "0"), F.format_string("%08x", "node_no")).alias("node_id"), F.concat(F.col("group_id"), F.lit(".example.com")).alias("host"), (F.col("node_no") + 7000).alias("port"),
    )


NODES_SQL = (
    "nodes AS (SELECT printf('g%02d', n_nationkey) AS group_id, i AS node_no, rpad(printf('g%02d', n_nationkey), 32, '0') || printf('%08x', i) AS node_id, "
    "printf('g%02d', n_nationkey) || '.example.com' AS host, 7000 + i AS port FROM nation, (VALUES (0), (1), (2)) v(i))"
)
