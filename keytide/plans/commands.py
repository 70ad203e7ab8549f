"""Queries of single commands over state tables and folded logs, one for each command that no other plan holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.operators import keyspace, orderedfold, values, zset
from keytide.operators.keyspace import Keyspace
from keytide.plans.views import ZSET_SQL, Registry, log, log_sql, orders_zset
from keytide.session import table

R = Registry()
_AFTER = "live AS (SELECT * FROM log WHERE idx > coalesce((SELECT max(b.idx) FROM log b WHERE b.key = log.key AND b.cmd IN ('DEL', 'UNLINK')), -1))"


def _map(**cmds: str) -> dict[str, str]:
    return {"signup": "NONE", "click": "NONE", "view": "NONE", "purchase": "NONE", "error": "NONE"} | cmds


# strings

_STRINGS_SQL = "strings AS (SELECT c_name AS key, c_mktsegment AS value FROM customer)"


def _strings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that orders ask for; every second one isn't there."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("idx"), F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2 - F.col("o_orderkey") % 2).cast("string"), 9, "0")).alias("key"))


_ASKED_SQL = "asked AS (SELECT o_orderkey AS idx, 'Customer#' || lpad(CAST(o_custkey * 2 - o_orderkey % 2 AS VARCHAR), 9, '0') AS key FROM orders)"


@R.add(f"WITH {_STRINGS_SQL}, {_ASKED_SQL} SELECT idx, asked.key, value FROM asked LEFT JOIN strings USING (key)")
def get(spark: SparkSession, sf: str) -> DataFrame:
    return values.mget(_strings(spark, sf), _asked(spark, sf)).select("idx", "key", "value")


@R.add(f"""WITH {_STRINGS_SQL}, k AS (SELECT l_orderkey AS idx, l_linenumber AS pos, 'Customer#' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS key FROM lineitem)
SELECT idx, string_agg(coalesce(value, 'nil'), ',' ORDER BY pos, k.key) AS reply FROM k LEFT JOIN strings USING (key) GROUP BY idx""")
def mget(spark: SparkSession, sf: str) -> DataFrame:
    """Several keys an order, in order; nil where a key isn't there."""
    li = table(spark, sf, "lineitem")
    asked = li.select(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("Customer#"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("key"))
    got = values.mget(_strings(spark, sf), asked).groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("pos", "key", F.coalesce("value", F.lit("nil")).alias("v")))).alias("r"))
    return got.select("idx", F.array_join(F.transform("r", lambda x: x["v"]), ",").alias("reply"))


_MSET_SQL = f"WITH {_STRINGS_SQL}, given AS (SELECT key, arg_max(value, idx) AS value FROM (SELECT o_orderkey AS idx, 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS key, o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, 'new' || o_custkey, o_orderstatus FROM orders) GROUP BY key)"


def _mset_calls(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_custkey")
    return o.select(F.col("o_orderkey").alias("idx"), F.create_map(F.concat(F.lit("Customer#"), F.lpad((k * 2).cast("string"), 9, "0")), F.col("o_orderpriority"), F.concat(F.lit("new"), k), F.col("o_orderstatus")).alias("pairs"))


@R.add(_MSET_SQL + " SELECT key, value FROM strings WHERE key NOT IN (SELECT key FROM given) UNION ALL SELECT key, value FROM given")
def mset(spark: SparkSession, sf: str) -> DataFrame:
    return values.mset(_strings(spark, sf), _mset_calls(spark, sf))


@R.add(f"WITH {_STRINGS_SQL} SELECT p_partkey AS idx, CASE WHEN EXISTS (SELECT 1 FROM strings WHERE key = 'Customer#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')) THEN 0 ELSE 1 END AS reply FROM part")
def msetnx(spark: SparkSession, sf: str) -> DataFrame:
    """Two keys a part, one of them perhaps a customer's: nothing is set where that is there."""
    k = F.col("p_partkey")
    calls = table(spark, sf, "part").select(k.alias("idx"), F.create_map(F.concat(F.lit("part"), k), F.col("p_name"), F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0")), F.col("p_brand")).alias("pairs"))
    return values.msetnx(_strings(spark, sf), calls).select("idx", "reply")


_DECR = _map(signup="SET", click="DECRBY", view="DECR", purchase="INCR", error="DEL")


@R.add(f"""WITH {log_sql(_DECR)}, {_AFTER}, s AS (SELECT *, CASE cmd WHEN 'SET' THEN num WHEN 'DECRBY' THEN -num WHEN 'DECR' THEN -1 ELSE 1 END AS d FROM live),
t AS (SELECT *, coalesce((SELECT max(b.idx) FROM s b WHERE b.key = s.key AND b.cmd = 'SET'), -1) AS base FROM s WHERE cmd <> 'DEL') SELECT key, CAST(sum(d) AS BIGINT) AS value FROM t WHERE idx >= base GROUP BY key""")
def decr(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of SET, INCR, DECR and DECRBY."""
    return Keyspace.from_log(log(spark, sf, _DECR)).counters()


@R.add(f"""WITH {log_sql(_DECR)}, e AS (SELECT *, CASE cmd WHEN 'SET' THEN num WHEN 'DECRBY' THEN -num WHEN 'DECR' THEN -1 WHEN 'INCR' THEN 1 ELSE 0 END AS d, count(*) FILTER (cmd IN ('SET', 'DEL')) OVER (PARTITION BY key ORDER BY idx) AS ep FROM log)
SELECT idx, key, CAST(r AS BIGINT) AS reply FROM (SELECT idx, key, cmd, sum(d) OVER (PARTITION BY key, ep ORDER BY idx) AS r FROM e) WHERE cmd NOT IN ('SET', 'DEL')""")
def decr_running_reply(spark: SparkSession, sf: str) -> DataFrame:
    return keyspace.running_counter(log(spark, sf, _DECR))


_FLOAT = _map(signup="SET", click="INCRBY", error="UNLINK")


@R.add(f"""WITH {log_sql(_FLOAT)}, {_AFTER}, t AS (SELECT *, coalesce((SELECT max(b.idx) FROM live b WHERE b.key = live.key AND b.cmd = 'SET'), -1) AS base FROM live WHERE cmd IN ('SET', 'INCRBY'))
SELECT key, CAST(sum(num) AS BIGINT) / 100.0::DOUBLE AS value FROM t WHERE idx >= base GROUP BY key""")
def incrbyfloat(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of hundredths are exact, and divided once; UNLINK deletes as DEL does."""
    return Keyspace.from_log(log(spark, sf, _FLOAT)).counters().select("key", (F.col("value") / F.lit(100.0)).alias("value"))


_SETEX = _map(signup="SET", click="SETEX", error="DEL")
_TIME = "(epoch_us(ts) // 1000)"


@R.add(f"""WITH {log_sql(_SETEX)}, {_AFTER}, w AS (SELECT key, arg_max(cmd, idx) AS c, arg_max(value, idx) AS value, arg_max({_TIME} + num, idx) AS due FROM live WHERE cmd IN ('SET', 'SETEX') GROUP BY key), n AS (SELECT max({_TIME}) - 86400000 AS now FROM log)
SELECT key, value, CASE WHEN c = 'SETEX' THEN due END AS expire_at FROM w, n WHERE c = 'SET' OR due > now""")
def psetex(spark: SparkSession, sf: str) -> DataFrame:
    """Values that have not expired a day before the log's last entry; times in milliseconds."""
    entries = log(spark, sf, _SETEX)
    live = keyspace.after_last(entries.where("cmd in ('SET', 'SETEX', 'DEL')"), ["key"], F.col("cmd") == "DEL")
    due = F.when(F.col("cmd") == "SETEX", keyspace.due(F.lit("PSETEX"), F.col("num"), F.unix_millis(F.col("ts").cast("timestamp"))))
    last = live.groupBy("key").agg(F.max_by(F.struct("value", due.alias("expire_at")), "idx").alias("w")).select("key", "w.value", "w.expire_at")
    now = entries.agg((F.max(F.unix_millis(F.col("ts").cast("timestamp"))) - 86400000).alias("now"))
    return last.crossJoin(F.broadcast(now)).where("expire_at is null or expire_at > now").drop("now")


@R.add(f"WITH {log_sql(_map(click='SETBIT', view='SETBIT', error='DEL'))}, {_AFTER}, b AS (SELECT key, num % 64 AS bit, arg_max(idx % 3, idx) AS v FROM live WHERE cmd = 'SETBIT' GROUP BY 1, 2) SELECT key, count(*) FILTER (v > 0) AS n, max(bit) FILTER (v > 0) AS highest FROM b GROUP BY key")
def setbit(spark: SparkSession, sf: str) -> DataFrame:
    """Bits set and cleared, a row a bit: how many are set, and the last of them."""
    live = Keyspace.from_log(log(spark, sf, _map(click="SETBIT", view="SETBIT", error="DEL")))._live("SETBIT").where("cmd = 'SETBIT'")
    held = live.groupBy("key", (F.col("num") % 64).alias("bit")).agg(F.max_by(F.col("idx") % 3, "idx").alias("v"))
    return held.groupBy("key").agg(F.count_if(F.col("v") > 0).alias("n"), F.max(F.when(F.col("v") > 0, F.col("bit"))).alias("highest"))


@R.add("SELECT c_custkey AS k, upper(hex(encode(substr(c_name, 1, 3) || 'XY' || substr(c_name, 6)))) AS hex FROM customer")
def setrange(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.hex(values.setrange(F.encode("c_name", "UTF-8"), 3, F.lit(b"XY"))).alias("hex"))


@R.add("SELECT c_custkey AS k, CAST(((ord(substr(c_name, 2, 1)) * 256 + ord(substr(c_name, 3, 1))) >> 4) & 255 AS BIGINT) AS field, CAST(ord(substr(c_name, 18, 1)) * 256 AS BIGINT) AS past FROM customer")
def bitfield(spark: SparkSession, sf: str) -> DataFrame:
    """Eight bits from bit 12 - 4 on, and sixteen that go past the end."""
    raw = F.encode("c_name", "UTF-8")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), values.bitfield(raw, 8, 12).alias("field"), values.bitfield(raw, 16, 136).alias("past"))


# hashes

_HASHES_SQL = "h AS (SELECT c_custkey AS key, 'name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer)"


def _hashes(spark: SparkSession, sf: str) -> DataFrame:
    held = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.explode(held).alias("field", "value"))


@R.add(f"WITH {_HASHES_SQL}, a AS (SELECT o_orderkey AS idx, o_custkey AS key, CASE o_orderkey % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'none' ELSE 'nation' END AS field FROM orders) SELECT idx, a.key, a.field, value FROM a LEFT JOIN h USING (key, field)")
def hget(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("key"), F.when(k == 0, "name").when(k == 1, "none").otherwise("nation").alias("field"))
    return asked.join(_hashes(spark, sf), ["key", "field"], "left").select("idx", "key", "field", "value")


@R.add(f"WITH {_HASHES_SQL} SELECT key, string_agg(field, ',' ORDER BY field) AS reply FROM h GROUP BY key")
def hkeys(spark: SparkSession, sf: str) -> DataFrame:
    return values.listed(_hashes(spark, sf), "field").select("key", F.array_join("reply", ",").alias("reply"))


@R.add(f"WITH {_HASHES_SQL} SELECT key, string_agg(value, ',' ORDER BY value) AS reply FROM h GROUP BY key")
def hvals(spark: SparkSession, sf: str) -> DataFrame:
    return values.listed(_hashes(spark, sf), "value").select("key", F.array_join("reply", ",").alias("reply"))


@R.add(f"WITH {_HASHES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY field) AS r, count(*) OVER (PARTITION BY key) AS n FROM h WHERE field > 'n') SELECT key, field, value, CASE WHEN n > 2 THEN max(CASE WHEN r = 2 THEN field END) OVER (PARTITION BY key) ELSE '0' END AS cursor FROM k WHERE r <= 2")
def hscan(spark: SparkSession, sf: str) -> DataFrame:
    """A page of two fields of each hash after a cursor, and the next cursor."""
    return values.page_after(_hashes(spark, sf), "field", F.lit("n"), 2).select("key", "field", "value", "cursor")


_HMSET = _map(click="HMSET", view="HSETNX", error="DEL")


@R.add(f"""WITH {log_sql(_map(click='HMSET', error='DEL'))}, {_AFTER}, w AS (SELECT key, field, value, idx FROM live WHERE cmd = 'HMSET' UNION ALL SELECT key, 'last', field, idx FROM live WHERE cmd = 'HMSET') SELECT key, field, arg_max(value, idx) AS value FROM w GROUP BY 1, 2""")
def hmset(spark: SparkSession, sf: str) -> DataFrame:
    """Two fields a command: the entry's own, and one that names it."""
    entries = log(spark, sf, _map(click="HMSET", error="DEL"))
    pairs = F.when(F.col("cmd") == "HMSET", F.create_map(F.col("field"), F.col("value"), F.lit("last"), F.col("field"))).otherwise(F.create_map(F.lit(""), F.lit("")))
    return Keyspace.from_log(entries.drop("field", "value").join(entries.select("idx", F.explode(pairs).alias("field", "value")), "idx")).hashes()


@R.add(f"WITH {log_sql(_map(view='HSETNX', error='DEL'))}, {_AFTER} SELECT key, field, arg_min(value, idx) AS value FROM live WHERE cmd = 'HSETNX' GROUP BY 1, 2")
def hsetnx(spark: SparkSession, sf: str) -> DataFrame:
    return keyspace.first_fields(log(spark, sf, _map(view="HSETNX", error="DEL")))


_HFLOAT = _map(signup="HSET", click="HINCRBY", view="HDEL", error="DEL")


@R.add(f"""WITH {log_sql(_HFLOAT)}, {_AFTER}, t AS (SELECT *, coalesce((SELECT max(b.idx) FROM live b WHERE b.key = live.key AND b.field = live.field AND b.cmd IN ('HSET', 'HDEL')), -1) AS base FROM live WHERE cmd IN ('HSET', 'HINCRBY', 'HDEL'))
SELECT key, field, CAST(sum(num) AS BIGINT) / 100.0::DOUBLE AS value FROM t WHERE idx >= base AND cmd <> 'HDEL' GROUP BY 1, 2""")
def hincrbyfloat(spark: SparkSession, sf: str) -> DataFrame:
    return Keyspace.from_log(log(spark, sf, _HFLOAT)).hash_counters().select("key", "field", (F.col("value") / F.lit(100.0)).alias("value"))


# lists: part keys of an order by line number

_LISTS_SQL = "l AS (SELECT l_orderkey AS key, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS pos, l_partkey AS value FROM lineitem), n AS (SELECT key, count(*) AS n FROM l GROUP BY key)"


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), (F.row_number().over(order) - 1).alias("pos"), F.col("l_partkey").alias("value"))


@R.add(f"WITH {_LISTS_SQL} SELECT key, CAST(pos - 1 AS INTEGER) AS pos, value FROM l JOIN n USING (key) WHERE pos BETWEEN 1 AND n - 2")
def ltrim(spark: SparkSession, sf: str) -> DataFrame:
    return values.trimmed(_lists(spark, sf), 1, -2)


@R.add(f"WITH {_LISTS_SQL} SELECT key, pos, CASE WHEN pos = n - 2 THEN -1 ELSE value END AS value FROM l JOIN n USING (key)")
def lset(spark: SparkSession, sf: str) -> DataFrame:
    return values.set_at(_lists(spark, sf), -2, F.lit(-1).cast("long"))


_PIVOT = "p AS (SELECT key, min(pos) AS p FROM l WHERE value = (key * 7) % 20 + 1 GROUP BY key)"


@R.add(f"WITH {_LISTS_SQL}, {_PIVOT} SELECT key, CAST(CASE WHEN pos > p THEN pos + 1 ELSE pos END AS INTEGER) AS pos, value FROM l LEFT JOIN p USING (key) UNION ALL SELECT key, CAST(p + 1 AS INTEGER), -5 FROM p")
def linsert(spark: SparkSession, sf: str) -> DataFrame:
    return values.inserted(_lists(spark, sf), (F.col("key") * 7) % 20 + 1, F.lit(-5).cast("long"), after=True)


def _small(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of few values, so that they repeat."""
    return _lists(spark, sf).withColumn("value", F.col("value") % 3)


@R.add(f"WITH {_LISTS_SQL}, s AS (SELECT key, pos, value % 3 AS value FROM l), h AS (SELECT *, CASE WHEN value = 1 THEN row_number() OVER (PARTITION BY key, value ORDER BY pos DESC) END AS r FROM s) SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS INTEGER) AS pos, value FROM h WHERE r IS NULL OR r > 2")
def lrem(spark: SparkSession, sf: str) -> DataFrame:
    """Up to two items that equal 1 go, from the tail."""
    return values.removed(_small(spark, sf), -2, F.lit(1))


@R.add(f"WITH {_LISTS_SQL} SELECT key, arg_max(value, pos) AS value FROM l GROUP BY key")
def rpop(spark: SparkSession, sf: str) -> DataFrame:
    return values.popped(_lists(spark, sf), False)[0]


@R.add(f"WITH {_LISTS_SQL} SELECT key, CAST(pos - 1 AS INTEGER) AS pos, value FROM l WHERE pos > 0")
def lpop_rest(spark: SparkSession, sf: str) -> DataFrame:
    return values.popped(_lists(spark, sf), True)[1]


@R.add(f"WITH {_LISTS_SQL} SELECT -key AS key, 0 AS pos, value FROM l JOIN n USING (key) WHERE pos = n - 1 UNION ALL SELECT key, pos, value FROM l JOIN n USING (key) WHERE pos < n - 1")
def rpoplpush(spark: SparkSession, sf: str) -> DataFrame:
    """Each list's tail goes to the head of a list of its own; LMOVE and BLMOVE do the same where something is there."""
    return values.moved_tail(_lists(spark, sf), -F.col("key"))


def _push_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select((F.col("o_orderkey") + F.col("o_custkey") % 2 * 1000000000).alias("key"))


_PUSHX = f"WITH {_LISTS_SQL}, p AS (SELECT o_orderkey + o_custkey % 2 * 1000000000 AS key, count(*) AS m FROM orders GROUP BY 1) SELECT p.key, CAST(coalesce(n + m, 0) AS BIGINT) AS reply FROM p LEFT JOIN n USING (key)"


@R.add(_PUSHX)
def lpushx(spark: SparkSession, sf: str) -> DataFrame:
    return values.pushed_if(_lists(spark, sf), _push_keys(spark, sf), True)


@R.add(_PUSHX)
def rpushx(spark: SparkSession, sf: str) -> DataFrame:
    return values.pushed_if(_lists(spark, sf), _push_keys(spark, sf), False)


_QUEUE = _map(purchase="RPUSH", click="POP")
#: A pop that finds nothing lowers the running minimum of pushes less pops; the k-th that finds something gets the k-th element.
_QUEUE_SQL = f"""WITH {log_sql(_QUEUE)}, q AS (SELECT *, sum(CASE cmd WHEN 'RPUSH' THEN 1 ELSE -1 END) OVER (PARTITION BY key ORDER BY idx) AS h FROM log WHERE cmd IN ('RPUSH', 'POP')),
m AS (SELECT *, least(0, min(h) OVER (PARTITION BY key ORDER BY idx)) AS low FROM q), d AS (SELECT *, low < coalesce(lag(low) OVER (PARTITION BY key ORDER BY idx), 0) AS missed FROM m),
k AS (SELECT *, count(*) FILTER (cmd = 'POP' AND NOT missed) OVER (PARTITION BY key ORDER BY idx) AS nth FROM d), p AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY idx) AS nth FROM log WHERE cmd = 'RPUSH')
SELECT k.idx, CASE WHEN missed THEN NULL ELSE @@ END AS reply FROM k LEFT JOIN p ON p.key = k.key AND p.nth = k.nth AND NOT missed WHERE cmd = 'POP'"""


def _queue(spark: SparkSession, sf: str, argv: Column) -> DataFrame:
    entries = log(spark, sf, _QUEUE).where("cmd in ('RPUSH', 'POP')")
    argv = F.when(F.col("cmd") == "RPUSH", F.array("cmd", "key", "value")).otherwise(argv)
    replies = orderedfold.replies(entries.select("idx", "key", argv.alias("argv")), "key")
    return replies.join(entries.where("cmd = 'POP'").select("idx"), "idx").select("idx", "reply")


@R.add(_QUEUE_SQL.replace("@@", "p.value"))
def lpop_replies(spark: SparkSession, sf: str) -> DataFrame:
    return _queue(spark, sf, F.array(F.lit("LPOP"), F.col("key")))


@R.add(_QUEUE_SQL.replace("@@", "'[' || k.key || ',' || p.value || ']'"))
def multi_blocking_pop(spark: SparkSession, sf: str) -> DataFrame:
    """BLPOP inside MULTI never waits: it is applied with timeout 0 and answers none where the list is empty."""
    from keytide.operators.commands import without_timeout

    return _queue(spark, sf, without_timeout(F.array(F.lit("BLPOP"), F.col("key"), F.lit("5"))))


@R.add(_QUEUE_SQL.replace("@@", "'[' || k.key || ',' || p.value || ']'"))
def blmpop(spark: SparkSession, sf: str) -> DataFrame:
    return _queue(spark, sf, F.array(F.lit("BLMPOP"), F.lit("0"), F.lit("2"), F.concat(F.col("key"), F.lit("none")), F.col("key"), F.lit("LEFT")))


@R.add(_QUEUE_SQL.replace("@@", "p.value"))
def blmove(spark: SparkSession, sf: str) -> DataFrame:
    return _queue(spark, sf, F.array(F.lit("BLMOVE"), F.col("key"), F.concat(F.col("key"), F.lit("done")), F.lit("LEFT"), F.lit("RIGHT"), F.lit("0")))


@R.add(_QUEUE_SQL.replace("@@", "'[' || k.key || ',' || p.value || ']'"))
def brpop(spark: SparkSession, sf: str) -> DataFrame:
    """What is pushed to the head and popped from the tail comes out in order."""
    entries = log(spark, sf, _QUEUE).where("cmd in ('RPUSH', 'POP')")
    argv = F.when(F.col("cmd") == "RPUSH", F.array(F.lit("LPUSH"), "key", "value")).otherwise(F.array(F.lit("BRPOP"), "key", F.lit("0")))
    replies = orderedfold.replies(entries.select("idx", "key", argv.alias("argv")), "key")
    return replies.join(entries.where("cmd = 'POP'").select("idx"), "idx").select("idx", "reply")


@R.add(_QUEUE_SQL.replace("@@", "p.value"))
def brpoplpush(spark: SparkSession, sf: str) -> DataFrame:
    entries = log(spark, sf, _QUEUE).where("cmd in ('RPUSH', 'POP')")
    argv = F.when(F.col("cmd") == "RPUSH", F.array(F.lit("LPUSH"), "key", "value")).otherwise(F.array(F.lit("BRPOPLPUSH"), "key", F.concat("key", F.lit("done")), F.lit("0")))
    replies = orderedfold.replies(entries.select("idx", "key", argv.alias("argv")), "key")
    return replies.join(entries.where("cmd = 'POP'").select("idx"), "idx").select("idx", "reply")


_BLOCK = _map(purchase="RPUSH", click="WAIT")
#: Nothing times out, so the k-th waiter of a key gets its k-th element, when both are there.
_BLOCK_SQL = f"""WITH {log_sql(_BLOCK)}, w AS (SELECT key, idx, row_number() OVER (PARTITION BY key ORDER BY idx) AS k FROM log WHERE cmd = 'WAIT'), p AS (SELECT key, idx AS pushed, value, row_number() OVER (PARTITION BY key ORDER BY idx) AS k FROM log WHERE cmd = 'RPUSH')
SELECT w.idx, CASE WHEN pushed IS NULL THEN NULL ELSE greatest(w.idx, pushed) END AS settled_by, CASE WHEN pushed IS NULL THEN 'WAITING' ELSE @@ END AS reply FROM w LEFT JOIN p USING (key, k)"""


def _blocked(spark: SparkSession, sf: str, argv: Column) -> DataFrame:
    entries = log(spark, sf, _BLOCK).where("cmd in ('RPUSH', 'WAIT')")
    argv = F.when(F.col("cmd") == "RPUSH", F.array("cmd", "key", "value")).otherwise(argv)
    out = orderedfold.settled(entries.select("idx", "key", argv.alias("argv")), "key")
    return out.join(entries.where("cmd = 'WAIT'").select("idx"), "idx").select("idx", "settled_by", "reply")


@R.add(_BLOCK_SQL.replace("@@", "'[' || w.key || ',' || value || ']'"))
def blpop_waits(spark: SparkSession, sf: str) -> DataFrame:
    """Who waits for a list, which entry serves it, and with what."""
    return _blocked(spark, sf, F.array(F.lit("BLPOP"), F.col("key"), F.lit("0")))


@R.add(_BLOCK_SQL.replace("@@", "value"))
def blmove_waits(spark: SparkSession, sf: str) -> DataFrame:
    return _blocked(spark, sf, F.array(F.lit("BLMOVE"), F.col("key"), F.concat(F.col("key"), F.lit("done")), F.lit("LEFT"), F.lit("RIGHT"), F.lit("0")))


# sets: the types of events a user has

_SETS_SQL = "s AS (SELECT DISTINCT 'e' || CAST(user_id % 50 AS VARCHAR) AS key, CAST(event_id % 400 AS VARCHAR) AS member FROM events)"


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.concat(F.lit("e"), F.col("user_id") % 50).alias("key"), (F.col("event_id") % 400).cast("string").alias("member")).distinct()


def _members(spark: SparkSession, sf: str, key: str) -> DataFrame:
    return _sets(spark, sf).where(F.col("key") == key).select("member")


@R.add(f"WITH {_SETS_SQL} SELECT key, string_agg(member, ',' ORDER BY member) AS reply FROM s GROUP BY key")
def smembers(spark: SparkSession, sf: str) -> DataFrame:
    return values.listed(_sets(spark, sf), "member").select("key", F.array_join("reply", ",").alias("reply"))


@R.add(f"WITH {_SETS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS r, count(*) OVER (PARTITION BY key) AS n FROM s WHERE member > '2') SELECT key, member, CASE WHEN n > 5 THEN max(CASE WHEN r = 5 THEN member END) OVER (PARTITION BY key) ELSE '0' END AS cursor FROM k WHERE r <= 5")
def sscan(spark: SparkSession, sf: str) -> DataFrame:
    return values.page_after(_sets(spark, sf), "member", F.lit("2"), 5).select("key", "member", "cursor")


def _store(op: str) -> str:
    return f"WITH {_SETS_SQL}, r AS (SELECT member FROM s WHERE key = 'e1' {op} SELECT member FROM s WHERE key = 'e2') SELECT key, member FROM s WHERE key <> 'e3' UNION ALL SELECT 'e3', member FROM r"


@R.add(_store("UNION"))
def sunionstore(spark: SparkSession, sf: str) -> DataFrame:
    return values.stored(_sets(spark, sf), "e3", _members(spark, sf, "e1").union(_members(spark, sf, "e2")).distinct())


@R.add(_store("INTERSECT"))
def sinterstore(spark: SparkSession, sf: str) -> DataFrame:
    return values.stored(_sets(spark, sf), "e3", _members(spark, sf, "e1").intersect(_members(spark, sf, "e2")))


@R.add(_store("EXCEPT"))
def sdiffstore(spark: SparkSession, sf: str) -> DataFrame:
    return values.stored(_sets(spark, sf), "e3", _members(spark, sf, "e1").subtract(_members(spark, sf, "e2")))


@R.add(f"""WITH {_SETS_SQL}, a AS (SELECT member FROM s WHERE key = 'e1'), b AS (SELECT member FROM s WHERE key = 'e2'), m AS (SELECT CAST(n_nationkey * 16 AS VARCHAR) AS member FROM nation), g AS (SELECT member FROM a WHERE member IN (SELECT member FROM m))
SELECT 'e1' AS key, member FROM a WHERE member NOT IN (SELECT member FROM g) UNION ALL SELECT 'e2', member FROM (SELECT member FROM b UNION SELECT member FROM g)""")
def smove(spark: SparkSession, sf: str) -> DataFrame:
    moved = table(spark, sf, "nation").select((F.col("n_nationkey") * 16).cast("string").alias("member"))
    a, b = values.smove(_members(spark, sf, "e1"), _members(spark, sf, "e2"), moved)
    return a.select(F.lit("e1").alias("key"), "member").unionByName(b.select(F.lit("e2").alias("key"), "member"))


@R.add(f"WITH {_SETS_SQL} SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('9:' || key || ':' || member), member) AS r FROM s) WHERE r > 3")
def spop(spark: SparkSession, sf: str) -> DataFrame:
    """What is left after three members of each set are popped, chosen by a seeded hash."""
    s = _sets(spark, sf)
    return s.join(values.random_of(s, "member", 9, 3), ["key", "member"], "left_anti")


@R.add(f"WITH {_SETS_SQL} SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('42:' || key || ':' || member), member) AS r FROM s) WHERE r = 1")
def srandmember(spark: SparkSession, sf: str) -> DataFrame:
    return values.random_of(_sets(spark, sf), "member", 42)


@R.add("SELECT 'all' AS db, c_name AS key FROM customer ORDER BY md5('7:all:' || c_name), c_name LIMIT 1")
def randomkey(spark: SparkSession, sf: str) -> DataFrame:
    """One key of all, by a seeded hash: an aggregate, so no task sorts the keys."""
    keys = table(spark, sf, "customer").select(F.lit("all").alias("db"), F.col("c_name").alias("key"))
    return keys.groupBy("db").agg(F.min_by("key", F.struct(F.md5(F.concat(F.lit("7:all:"), "key")), "key")).alias("key"))


# sorted sets


@R.add(f"WITH {ZSET_SQL} SELECT key, count(*) AS n FROM z GROUP BY key")
def zcard(spark: SparkSession, sf: str) -> DataFrame:
    return orders_zset(spark, sf).groupBy("key").agg(F.count("*").alias("n"))


@R.add(f"WITH {ZSET_SQL}, a AS (SELECT l_orderkey AS idx, l_linenumber AS pos, o_custkey AS key, CAST(l_orderkey + l_linenumber % 2 AS VARCHAR) AS member FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT idx, pos, score FROM a LEFT JOIN z USING (key, member)")
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    asked = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("pos"), F.col("o_custkey").alias("key"), (F.col("l_orderkey") + F.col("l_linenumber") % 2).cast("string").alias("member"))
    return asked.join(orders_zset(spark, sf), ["key", "member"], "left").select("idx", "pos", "score")


@R.add(f"WITH {ZSET_SQL} SELECT key, count(*) FILTER (member >= '1' AND member < '3') AS n FROM z GROUP BY key")
def zlexcount(spark: SparkSession, sf: str) -> DataFrame:
    return orders_zset(spark, sf).groupBy("key").agg(F.count_if(zset.in_lex("[1", "(3")).alias("n"))


@R.add(f"WITH {ZSET_SQL} SELECT key, member, score FROM z WHERE NOT (member >= '1' AND member < '3')")
def zremrangebylex(spark: SparkSession, sf: str) -> DataFrame:
    return orders_zset(spark, sf).where(~zset.in_lex("[1", "(3"))


@R.add(f"WITH {ZSET_SQL} SELECT key, member, score FROM z WHERE NOT (score > 5000000 AND score <= 20000000)")
def zremrangebyscore(spark: SparkSession, sf: str) -> DataFrame:
    return orders_zset(spark, sf).where(~zset.in_range("(5000000", "20000000"))


_REV = "r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS k FROM {0})"


@R.add(f"WITH {ZSET_SQL}, {_REV.format('z')} SELECT key, member, score, CAST(k AS INTEGER) AS rank FROM r WHERE k BETWEEN 1 AND 3")
def zrevrange(spark: SparkSession, sf: str) -> DataFrame:
    return zset.ranks(orders_zset(spark, sf), reverse=True).where("rank between 1 and 3")


@R.add(f"WITH {ZSET_SQL}, f AS (SELECT * FROM z WHERE score > 5000000 AND score <= 20000000), {_REV.format('f')} SELECT key, member, score, CAST(k AS INTEGER) AS rank FROM r")
def zrevrangebyscore(spark: SparkSession, sf: str) -> DataFrame:
    return zset.ranks(orders_zset(spark, sf).where(zset.in_range("(5000000", "20000000")), reverse=True)


@R.add(f"WITH {ZSET_SQL}, f AS (SELECT key, member FROM z WHERE member >= '1' AND member < '3') SELECT key, member, CAST(row_number() OVER (PARTITION BY key ORDER BY member DESC) - 1 AS INTEGER) AS rank FROM f")
def zrevrangebylex(spark: SparkSession, sf: str) -> DataFrame:
    """Members between two texts, the largest first; scores are equal where such a range has a meaning."""
    equal = orders_zset(spark, sf).where(zset.in_lex("[1", "(3")).withColumn("score", F.lit(0).cast("long"))
    return zset.ranks(equal, reverse=True).select("key", "member", "rank")


@R.add(f"WITH {ZSET_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS r, count(*) OVER (PARTITION BY key) AS n FROM z WHERE member > '5') SELECT key, member, score, CASE WHEN n > 3 THEN max(CASE WHEN r = 3 THEN member END) OVER (PARTITION BY key) ELSE '0' END AS cursor FROM k WHERE r <= 3")
def zscan(spark: SparkSession, sf: str) -> DataFrame:
    return values.page_after(orders_zset(spark, sf), "member", F.lit("5"), 3).select("key", "member", "score", "cursor")


def _served_sql(order: str) -> str:
    return f"""WITH {ZSET_SQL}, w AS (SELECT user_id AS key, event_id AS waiter, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type = 'signup'),
m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order}) AS r FROM z) SELECT w.key, waiter, member, score FROM w LEFT JOIN m USING (key, r)"""


def _waits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'signup'").select(F.col("user_id").alias("key"), F.col("event_id").alias("idx"))


@R.add(_served_sql("score, member"))
def bzpopmin(spark: SparkSession, sf: str) -> DataFrame:
    """Signups wait for the sorted set of the customer with the user's number, which comes at once."""
    from keytide.operators.clients import serve_sorted

    return serve_sorted(_waits(spark, sf), orders_zset(spark, sf))


@R.add(_served_sql("score DESC, member DESC"))
def bzpopmax(spark: SparkSession, sf: str) -> DataFrame:
    from keytide.operators.clients import serve_sorted

    return serve_sorted(_waits(spark, sf), orders_zset(spark, sf), largest=True)


_ZQUEUE = _map(purchase="ZADD", click="POP")


@R.add(f"""WITH {log_sql(_ZQUEUE)}, q AS (SELECT *, sum(CASE cmd WHEN 'ZADD' THEN 1 ELSE -1 END) OVER (PARTITION BY key ORDER BY idx) AS h FROM log WHERE cmd IN ('ZADD', 'POP')),
m AS (SELECT *, least(0, min(h) OVER (PARTITION BY key ORDER BY idx)) AS low FROM q), d AS (SELECT *, low < coalesce(lag(low) OVER (PARTITION BY key ORDER BY idx), 0) AS missed FROM m),
k AS (SELECT *, count(*) FILTER (cmd = 'POP' AND NOT missed) OVER (PARTITION BY key ORDER BY idx) AS nth FROM d), p AS (SELECT key, idx, row_number() OVER (PARTITION BY key ORDER BY idx) AS nth FROM log WHERE cmd = 'ZADD')
SELECT k.idx, CASE WHEN NOT missed THEN '[' || k.key || ',m' || p.idx || ',' || p.idx || ']' END AS reply FROM k LEFT JOIN p ON p.key = k.key AND p.nth = k.nth AND NOT missed WHERE cmd = 'POP'""")
def bzmpop(spark: SparkSession, sf: str) -> DataFrame:
    """Members with rising scores, popped from the least: the pops give them in order."""
    entries = log(spark, sf, _ZQUEUE).where("cmd in ('ZADD', 'POP')")
    argv = F.when(F.col("cmd") == "ZADD", F.array(F.lit("ZADD"), "key", F.col("idx").cast("string"), F.concat(F.lit("m"), "idx"))).otherwise(F.array(F.lit("BZMPOP"), F.lit("0"), F.lit("1"), "key", F.lit("MIN")))
    replies = orderedfold.replies(entries.select("idx", "key", argv.alias("argv")), "key")
    return replies.join(entries.where("cmd = 'POP'").select("idx"), "idx").select("idx", "reply")


# distinct counts: exact ones stand for the host's estimates


@R.add("SELECT event_id AS idx, CASE WHEN row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS reply FROM events")
def pfadd(spark: SparkSession, sf: str) -> DataFrame:
    """1 where an entry brings a new value to its key."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("idx"), F.col("event_type").alias("key"), F.col("user_id").alias("value"))
    first = e.groupBy("key", "value").agg(F.min("idx").alias("__f"))
    return e.join(first, ["key", "value"]).select("idx", (F.col("idx") == F.col("__f")).cast("int").alias("reply"))


@R.add("SELECT CASE WHEN event_type IN ('click', 'view') THEN 'seen' ELSE 'done' END AS key, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def pfmerge(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    merged = F.when(F.col("event_type").isin("click", "view"), "seen").otherwise("done")
    return e.select(merged.alias("key"), "user_id").distinct().groupBy("key").agg(F.count("*").alias("n"))


# places

_PLACES_SQL = "p AS (SELECT c_nationkey AS key, c_name AS member, (c_custkey * 37 % 3600) / 10.0 - 180 AS lon, (c_custkey * 53 % 1700) / 10.0 - 85 AS lat FROM customer)"


def _places(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("member"), ((k * 37 % 3600) / F.lit(10.0) - 180).alias("lon"), ((k * 53 % 1700) / F.lit(10.0) - 85).alias("lat"))


@R.add(f"WITH {log_sql(_map(click='GEOADD', view='ZREM', error='DEL'))}, {_AFTER}, w AS (SELECT key, field, arg_max(cmd, idx) AS c, arg_max(num % 360 - 180, idx) AS lon, arg_max(num % 170 - 85, idx) AS lat FROM live WHERE cmd IN ('GEOADD', 'ZREM') GROUP BY 1, 2) SELECT key, field AS member, lon, lat FROM w WHERE c = 'GEOADD'")
def geoadd(spark: SparkSession, sf: str) -> DataFrame:
    """The last place of each member."""
    live = Keyspace.from_log(log(spark, sf, _map(click="GEOADD", view="ZREM", error="DEL")))._live("GEOADD", "ZREM")
    last = live.groupBy("key", "field").agg(F.max_by(F.struct("cmd", (F.col("num") % 360 - 180).alias("lon"), (F.col("num") % 170 - 85).alias("lat")), "idx").alias("w"))
    return last.where("w.cmd = 'GEOADD'").select("key", F.col("field").alias("member"), "w.lon", "w.lat")


@R.add(f"WITH {_PLACES_SQL}, a AS (SELECT s_suppkey AS idx, s_nationkey AS key, 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS member FROM supplier) SELECT idx, round(lon, 1) AS lon, round(lat, 1) AS lat FROM a LEFT JOIN p USING (key, member)")
def geopos(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_nationkey").alias("key"), F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("member"))
    return asked.join(_places(spark, sf), ["key", "member"], "left").select("idx", F.round("lon", 1).alias("lon"), F.round("lat", 1).alias("lat"))


@R.add(f"""WITH {_PLACES_SQL}, c AS (SELECT key, member AS centre, lon AS x, lat AS y FROM p WHERE member LIKE '%7')
SELECT c.key, centre, member FROM c JOIN p ON p.key = c.key WHERE 2 * 6372797.560856 * asin(sqrt(power(sin((radians(lat) - radians(y)) / 2), 2) + cos(radians(y)) * cos(radians(lat)) * power(sin((radians(lon) - radians(x)) / 2), 2))) <= 1500000""")
def georadiusbymember(spark: SparkSession, sf: str) -> DataFrame:
    p = _places(spark, sf)
    return values.radius_by_member(p, p.where(F.col("member").endswith("7")).select("key", F.col("member").alias("centre")), 1_500_000.0)


# keys


@R.add("WITH a AS (SELECT l_orderkey AS idx, l_partkey AS key FROM lineitem) SELECT idx, count(c_custkey) AS reply FROM a LEFT JOIN customer ON c_custkey = key GROUP BY idx")
def exists(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("idx"), F.col("l_partkey").alias("key"))
    return values.exists(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), asked)


@R.add("WITH a AS (SELECT l_suppkey AS idx, l_partkey * 3 AS key FROM lineitem) SELECT idx, count(c_custkey) AS reply FROM a LEFT JOIN customer ON c_custkey = key GROUP BY idx")
def touch(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("idx"), (F.col("l_partkey") * 3).alias("key"))
    return values.exists(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), asked)


_DROP = _map(signup="SET", purchase="SET", error="UNLINK")


@R.add(f"WITH {log_sql(_DROP)}, {_AFTER} SELECT key, arg_max(value, idx) AS value FROM live WHERE cmd = 'SET' GROUP BY key")
def unlink(spark: SparkSession, sf: str) -> DataFrame:
    return Keyspace.from_log(log(spark, sf, _DROP)).strings()


def _ttl_sql(cmd: str, due: str, unit: int) -> str:
    """Keys by SET, times by cmd, and what is left at the time of the last entry."""
    return f"""WITH {log_sql(_map(signup='SET', click=cmd, view='PERSIST', error='DEL'))}, {_AFTER}, f AS (SELECT key, min(idx) AS since FROM live WHERE cmd = 'SET' GROUP BY key), n AS (SELECT max({_TIME}) AS now FROM log),
w AS (SELECT l.key, arg_max(l.cmd, l.idx) AS c, arg_max({due}, l.idx) AS due FROM live l JOIN f ON f.key = l.key AND l.idx >= since WHERE l.cmd IN ('SET', '{cmd}', 'PERSIST') GROUP BY l.key)
SELECT k.key, CASE WHEN c IS NULL THEN -2 WHEN c <> '{cmd}' THEN -1 WHEN due <= now THEN -2 ELSE (due - now + {unit // 2}) // {unit} END AS ttl FROM (SELECT DISTINCT key FROM log) k CROSS JOIN n LEFT JOIN w USING (key)"""


def _ttl(spark: SparkSession, sf: str, cmd: str, num: Column, unit: int) -> DataFrame:
    entries = log(spark, sf, _map(signup="SET", click=cmd, view="PERSIST", error="DEL"))
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    timed = entries.withColumn("num", F.when(F.col("cmd") == cmd, keyspace.due(F.col("cmd"), num, at)).otherwise(F.col("num")))
    now = entries.agg(F.max(at)).first()[0]
    left = Keyspace.from_log(timed).ttl(now or 0)
    return left.select("key", F.when(F.col("ttl") > 0, F.floor((F.col("ttl") + unit // 2) / unit)).otherwise(F.col("ttl")).cast("long").alias("ttl"))


@R.add(_ttl_sql("EXPIRE", f"{_TIME} + num * 100 * 1000", 1000))
def expire_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds left (TTL) of keys that EXPIRE gave seconds from each entry's time."""
    return _ttl(spark, sf, "EXPIRE", F.col("num") * 100, 1000)


@R.add(_ttl_sql("PEXPIRE", f"{_TIME} + num * 100000", 1))
def pexpire_pttl(spark: SparkSession, sf: str) -> DataFrame:
    return _ttl(spark, sf, "PEXPIRE", F.col("num") * 100000, 1)


@R.add(_ttl_sql("PEXPIREAT", f"{_TIME} - {_TIME} % 1000000 + num * 100000", 1))
def pexpireat_pttl(spark: SparkSession, sf: str) -> DataFrame:
    """Milliseconds left (PTTL) of keys with a time from the epoch."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return _ttl(spark, sf, "PEXPIREAT", at - at % 1000000 + F.col("num") * 100000, 1)


_NAMES_SQL = "names AS (SELECT 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS key, 'Customer#' || lpad(CAST(s_suppkey * 3 + 600 AS VARCHAR), 9, '0') AS new FROM supplier WHERE s_suppkey <= 500)"


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """Old names among the first 500, new ones from 603 on, some of them customers'."""
    named = lambda k: F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    return table(spark, sf, "supplier").where("s_suppkey <= 500").select(named(F.col("s_suppkey")).alias("key"), named(F.col("s_suppkey") * 3 + 600).alias("new"))


@R.add(f"""WITH {_STRINGS_SQL}, {_NAMES_SQL}, m AS (SELECT * FROM names WHERE key IN (SELECT key FROM strings)), rest AS (SELECT * FROM strings WHERE key NOT IN (SELECT new FROM m))
SELECT coalesce(new, rest.key) AS key, value FROM rest LEFT JOIN m USING (key)""")
def rename(spark: SparkSession, sf: str) -> DataFrame:
    return values.renamed(_strings(spark, sf), _names(spark, sf)).select("key", "value")


@R.add(f"""WITH {_STRINGS_SQL}, {_NAMES_SQL}, m AS (SELECT * FROM names WHERE key IN (SELECT key FROM strings) AND new NOT IN (SELECT key FROM strings)) SELECT coalesce(new, strings.key) AS key, value FROM strings LEFT JOIN m USING (key)""")
def renamenx(spark: SparkSession, sf: str) -> DataFrame:
    return values.renamed(_strings(spark, sf), _names(spark, sf), only_new=True).select("key", "value")


@R.add("""WITH i AS (SELECT l_orderkey AS key, l_suppkey AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(s_acctbal, 0), l_suppkey) - 1 AS pos FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) LEFT JOIN supplier ON s_suppkey = l_suppkey)
SELECT key, CAST(pos AS INTEGER) AS pos, value, s_name AS got FROM i LEFT JOIN supplier ON s_suppkey = value""")
def sort_by_get(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of an order by their balance, with their names."""
    s = table(spark, sf, "supplier")
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("value")).distinct()
    return values.sort_by(items, s.select(F.col("s_suppkey").alias("item"), F.col("s_acctbal").alias("weight")), s.select(F.col("s_suppkey").alias("item"), F.col("s_name").alias("got")))
