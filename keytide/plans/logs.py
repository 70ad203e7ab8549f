"""Queries on the log itself: sizes, offsets, batches, recovery, metrics, codecs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions import codecs
from keytide.operators import logops
from keytide.plans.views import Registry, log, log_sql
from keytide.session import shared_folder, table

R = Registry()
_SIZED = "l AS (SELECT event_id AS idx, strlen(props) AS data_len FROM events)"


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("idx"), F.octet_length("props").cast("long").alias("data_len"))


@R.add(f"WITH {_SIZED} SELECT idx, CAST(coalesce(sum(data_len + 60) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 120 AS BIGINT) AS \"offset\" FROM l")
def offset_index(spark: SparkSession, sf: str) -> DataFrame:
    return logops.offsets(_sized(spark, sf), F.col("data_len") + 60, 120).select("idx", "offset")


@R.add(f"WITH {_SIZED}, s AS (SELECT *, sum(data_len) OVER (ORDER BY idx) AS t FROM l WHERE idx >= 1000) SELECT idx, CAST(data_len AS BIGINT) AS data_len FROM s WHERE idx = 1000 OR t <= 50000")
def batch_by_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return logops.batch_by_bytes(_sized(spark, sf), 1000, 50000).select("idx", "data_len")


@R.add(f"WITH {_SIZED}, s AS (SELECT *, sum(data_len + 56) OVER (ORDER BY idx DESC) AS held FROM l) SELECT idx FROM s WHERE held > 200000 AND idx <= 9000")
def cache_evict(spark: SparkSession, sf: str) -> DataFrame:
    return logops.evict(_sized(spark, sf), 200000, 9000).select("idx")


@R.add("SELECT event_id AS idx FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_id > 4000 AND event_type = 'error')")
def prefix_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """The first error after entry 4000 stands for a failed checksum."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("idx"), "event_type")
    return logops.longest_prefix(e, (F.col("idx") > 4000) & (F.col("event_type") == "error")).select("idx")


@R.add("SELECT coalesce(min(event_id), 1) AS first, coalesce(max(event_id), 0) AS current, count(*) AS count FROM events")
def log_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return logops.bounds(table(spark, sf, "events").select(F.col("event_id").alias("idx")))


@R.add("SELECT event_id AS idx, event_type FROM events WHERE event_id BETWEEN 100 AND 149")
def range_read(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("idx"), "event_type")
    return logops.contiguous(e, 100, 50).select("idx", "event_type")


@R.add("SELECT event_id AS idx, user_id, value FROM events WHERE event_id = 1234")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_id = 1234").select(F.col("event_id").alias("idx"), "user_id", "value")


@R.add("SELECT event_id AS idx FROM events")
def two_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Two pages of a log, the second going on at 5000."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("idx"))
    return logops.join_pages(e.where("idx < 5000"), e.where("idx >= 5000"), 4999)


@R.add("SELECT event_id AS idx FROM events WHERE event_id > 3000")
def compaction_suffix(spark: SparkSession, sf: str) -> DataFrame:
    from keytide.sources.snapshot import compacted

    return compacted(table(spark, sf, "events").select(F.col("event_id").alias("idx")), 3000)


@R.add(f"""WITH {log_sql()}, s AS (SELECT * FROM log WHERE cmd IN ('SET', 'INCRBY', 'DEL')), t AS (SELECT *, coalesce((SELECT max(b.idx) FROM s b WHERE b.key = s.key AND b.cmd = 'DEL'), -1) AS gone, coalesce((SELECT max(b.idx) FROM s b WHERE b.key = s.key AND b.cmd = 'SET'), -1) AS base FROM s)
SELECT key, CAST(sum(num) AS BIGINT) AS value FROM t WHERE idx > gone AND (idx >= base OR base < gone) GROUP BY key""")
def snapshot_plus_suffix(spark: SparkSession, sf: str) -> DataFrame:
    """State at entry 5000 as the base of a replay of the entries beyond: equal to the whole replay."""
    from keytide.operators.keyspace import Keyspace
    from keytide.sources.snapshot import restore_counters

    entries = log(spark, sf)
    return restore_counters(Keyspace.from_log(entries).as_of(5000).counters(), entries.where("idx > 5000"))


@R.add(f"""WITH {log_sql()}, s AS (SELECT * FROM log WHERE cmd IN ('SET', 'INCRBY', 'DEL')), t AS (SELECT *, coalesce((SELECT max(b.idx) FROM s b WHERE b.key = s.key AND b.cmd = 'DEL'), -1) AS gone, coalesce((SELECT max(b.idx) FROM s b WHERE b.key = s.key AND b.cmd = 'SET'), -1) AS base FROM s)
SELECT key, CAST(sum(num) AS BIGINT) AS value FROM t WHERE idx > gone AND (idx >= base OR base < gone) GROUP BY key""")
def snapshot_restore(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot of the counters in the middle of the log, written, published, read back, and brought up to date by the entries it doesn't hold."""
    from keytide.operators.keyspace import Keyspace
    from keytide.sources import snapshot

    entries, path = log(spark, sf), f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    middle = entries.agg(F.floor(F.max("idx") / 2)).first()[0] or 0
    snapshot.write(spark, path, {"counters": Keyspace.from_log(entries).as_of(middle).counters()}, middle)
    last, tables = snapshot.latest(spark, path)
    return snapshot.restore_counters(tables["counters"], snapshot.compacted(entries, last))


@R.add("SELECT n_regionkey AS group_id, list_sort(list(n_nationkey), 'DESC')[count(*) // 2 + 1] AS committed FROM nation GROUP BY 1")
def quorum_commit(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("group_id"), F.col("n_nationkey").alias("match_idx"))
    return logops.quorum_index(n)


@R.add("SELECT count(*) AS count, CAST(sum(l_orderkey) AS BIGINT) AS total, max(l_orderkey) AS max, CAST(sum(l_orderkey) // count(*) AS BIGINT) AS average FROM lineitem")
def fsync_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return logops.fsync_metrics(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("micros")))


@R.add("SELECT event_type AS cmd, count(*) AS n, CAST(sum(strlen(props) + 56) AS BIGINT) AS cached FROM events GROUP BY 1")
def info_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumnRenamed("event_type", "cmd")
    return logops.cache_bytes(e, "cmd", F.octet_length("props"))


@R.add("SELECT l_orderkey AS v, CASE WHEN length(CAST(l_orderkey AS VARCHAR)) > 7 THEN 22 ELSE length(CAST(l_orderkey AS VARCHAR)) + 2 END AS n FROM lineitem")
def encoded_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("v"), codecs.int_length(F.col("l_orderkey")).cast("long").alias("n"))


@R.add("SELECT event_id AS idx, 'SET' AS name, props AS value, false AS asking FROM events")
def command_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Commands encoded to bytes and decoded again."""
    e = table(spark, sf, "events")
    argv = F.array(F.array(F.encode(F.lit("SET"), "UTF-8"), F.encode(F.concat(F.lit("u"), "user_id"), "UTF-8"), F.encode("props", "UTF-8")))
    back = e.select(F.col("event_id").alias("idx"), codecs.decode_commands_column(codecs.encode_commands_column(argv)).alias("c"))
    word = lambda k: F.get(F.get(F.col("c.commands"), 0), k).cast("string")
    return back.select("idx", word(0).alias("name"), word(2).alias("value"), F.col("c.asking").alias("asking"))


@R.add("SELECT l_orderkey AS txn, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS keys FROM lineitem GROUP BY 1")
def lock_key_list(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct keys in byte order, as a lock entry lists them."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("txn")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("k"))
    return li.select("txn", F.array_join(F.array_sort("k"), ",").alias("keys"))
