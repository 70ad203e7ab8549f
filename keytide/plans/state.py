"""Queries on folded state: strings, counters, hashes, lists, sets, sorted sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions import bits
from keytide.operators import keyspace, orderedfold, zset
from keytide.operators.keyspace import Keyspace
from keytide.plans.views import ZSET_SQL, Registry, line_lists, log, log_sql, orders_zset
from keytide.session import table

R = Registry()
LOG = log_sql()
_AFTER = "live AS (SELECT * FROM log WHERE idx > coalesce((SELECT max(b.idx) FROM log b WHERE b.key = log.key AND b.cmd = 'DEL'), -1))"


def _map(**cmds: str) -> dict[str, str]:
    return {"signup": "NONE", "click": "NONE", "view": "NONE", "purchase": "NONE", "error": "NONE"} | cmds


@R.add(f"""WITH {LOG}, {_AFTER}, s AS (SELECT * FROM live WHERE cmd IN ('SET', 'INCRBY')),
t AS (SELECT *, coalesce((SELECT max(b.idx) FROM s b WHERE b.key = s.key AND b.cmd = 'SET'), -1) AS base FROM s)
SELECT key, CAST(sum(num) AS BIGINT) AS value FROM t WHERE idx >= base GROUP BY key""")
def counter_replay(spark: SparkSession, sf: str) -> DataFrame:
    return Keyspace.from_log(log(spark, sf)).counters()


@R.add(f"""WITH {LOG}, half AS (SELECT * FROM log WHERE idx <= 5000), s AS (SELECT * FROM half WHERE cmd IN ('SET', 'INCRBY', 'DEL')),
t AS (SELECT *, coalesce((SELECT max(b.idx) FROM s b WHERE b.key = s.key AND b.cmd = 'DEL'), -1) AS gone, coalesce((SELECT max(b.idx) FROM s b WHERE b.key = s.key AND b.cmd = 'SET'), -1) AS base FROM s)
SELECT key, CAST(sum(num) AS BIGINT) AS value FROM t WHERE idx > gone AND (idx >= base OR base < gone) GROUP BY key""")
def counter_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return Keyspace.from_log(log(spark, sf)).as_of(5000).counters()


_LWW = _map(signup="SET", click="SET", error="DEL")


@R.add(f"""WITH {log_sql(_LWW)}, {_AFTER} SELECT key, arg_max(value, idx) AS value FROM live WHERE cmd = 'SET' GROUP BY key""")
def lww_string(spark: SparkSession, sf: str) -> DataFrame:
    return Keyspace.from_log(log(spark, sf, _LWW)).strings()


_APPEND = _map(signup="SET", view="APPEND", error="DEL")


@R.add(f"""WITH {log_sql(_APPEND)}, {_AFTER}, t AS (SELECT *, coalesce((SELECT max(b.idx) FROM live b WHERE b.key = live.key AND b.cmd = 'SET'), -1) AS base FROM live)
SELECT key, string_agg(value, '' ORDER BY idx) AS value FROM t WHERE cmd IN ('SET', 'APPEND') AND idx >= base GROUP BY key""")
def append_concat(spark: SparkSession, sf: str) -> DataFrame:
    return Keyspace.from_log(log(spark, sf, _APPEND)).strings()


@R.add(f"""WITH {LOG}, h AS (SELECT idx, key, cmd, value, lag(CASE WHEN cmd = 'SET' THEN value END) OVER (PARTITION BY key ORDER BY idx) AS previous FROM log WHERE cmd IN ('SET', 'DEL')) SELECT idx, key, value, previous FROM h WHERE cmd = 'SET'""")
def getset_history(spark: SparkSession, sf: str) -> DataFrame:
    return keyspace.history(log(spark, sf))


@R.add(f"""WITH {LOG}, e AS (SELECT *, sum(CASE WHEN cmd IN ('SET', 'DEL') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY idx) AS ep FROM log WHERE cmd IN ('SET', 'INCRBY', 'DEL'))
SELECT idx, key, reply FROM (SELECT idx, key, cmd, CAST(sum(CASE WHEN cmd = 'DEL' THEN 0 ELSE num END) OVER (PARTITION BY key, ep ORDER BY idx) AS BIGINT) AS reply FROM e) WHERE cmd = 'INCRBY'""")
def incr_running_reply(spark: SparkSession, sf: str) -> DataFrame:
    return keyspace.running_counter(log(spark, sf))


_NX = _map(signup="SETNX", click="SETNX", error="DEL")


@R.add(f"WITH {log_sql(_NX)}, {_AFTER} SELECT key, arg_min(value, idx) AS value FROM live WHERE cmd = 'SETNX' GROUP BY key")
def setnx_first(spark: SparkSession, sf: str) -> DataFrame:
    return keyspace.first_writes(log(spark, sf, _NX))


@R.add("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents")
def strlen_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))


@R.add("SELECT c_custkey, CAST(list_sum(list_transform(string_split(c_name, ''), lambda c: bit_count(CAST(ord(c) AS INTEGER)))) AS BIGINT) AS n FROM customer")
def bitcount_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", bits.bitcount(F.encode("c_name", "UTF-8")).alias("n"))


@R.add("SELECT c_custkey, CAST((ord(substr(c_name, 2, 1)) >> 4) & 1 AS INTEGER) AS bit FROM customer")
def getbit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", bits.getbit(F.encode("c_name", "UTF-8"), 11).alias("bit"))


@R.add("""SELECT s_suppkey, upper(string_agg(printf('%02x', ord(substr(s_name, CAST(i AS INT), 1)) & ord(substr(reverse(s_name), CAST(i AS INT), 1))), '' ORDER BY i)) AS hex
FROM supplier, range(1, 64) r(i) WHERE i <= length(s_name) GROUP BY s_suppkey""")
def bitop_and(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", F.hex(bits.bitop("and", F.encode("s_name", "UTF-8"), F.encode(F.reverse("s_name"), "UTF-8"))).alias("hex"))


@R.add("SELECT doc_id, substr(source, 2, greatest(0, length(source) - 2)) AS part FROM documents")
def getrange(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", bits.getrange(F.encode("source", "UTF-8"), 1, -2).cast("string").alias("part"))


_HASH = _map(signup="HSET", click="HSET", view="HDEL", error="DEL")


@R.add(f"""WITH {log_sql(_HASH)}, {_AFTER}, w AS (SELECT key, field, arg_max(cmd, idx) AS c, arg_max(value, idx) AS value FROM live WHERE cmd IN ('HSET', 'HDEL') GROUP BY key, field)
SELECT key, field, value FROM w WHERE c = 'HSET'""")
def hash_lww(spark: SparkSession, sf: str) -> DataFrame:
    return Keyspace.from_log(log(spark, sf, _HASH)).hashes()


_HINCR = _map(signup="HSET", click="HINCRBY", purchase="HINCRBY", error="DEL")


@R.add(f"""WITH {log_sql(_HINCR)}, {_AFTER}, t AS (SELECT *, coalesce((SELECT max(b.idx) FROM live b WHERE b.key = live.key AND b.field = live.field AND b.cmd = 'HSET'), -1) AS base FROM live WHERE cmd IN ('HSET', 'HINCRBY'))
SELECT key, field, CAST(sum(num) AS BIGINT) AS value FROM t WHERE idx >= base GROUP BY key, field""")
def hincrby(spark: SparkSession, sf: str) -> DataFrame:
    return Keyspace.from_log(log(spark, sf, _HINCR)).hash_counters()


@R.add(f"""WITH {log_sql(_HASH)}, {_AFTER}, w AS (SELECT key, field, arg_max(cmd, idx) AS c, arg_max(value, idx) AS value FROM live WHERE cmd IN ('HSET', 'HDEL') GROUP BY key, field)
SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS reply FROM w WHERE c = 'HSET' GROUP BY key""")
def hgetall_sorted(spark: SparkSession, sf: str) -> DataFrame:
    from keytide.operators.commands import sorted_map_reply

    h = Keyspace.from_log(log(spark, sf, _HASH)).hashes()
    packed = h.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
    return packed.select("key", F.array_join(F.transform(sorted_map_reply(F.col("m")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("reply"))


@R.add("""WITH f AS (SELECT * FROM (VALUES (0, 'name'), (1, 'missing'), (2, 'segment')) v(pos, field)), h AS (SELECT c_custkey AS key, 'name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer)
SELECT c_custkey AS key, f.pos, h.value FROM customer CROSS JOIN f LEFT JOIN h ON h.key = c_custkey AND h.field = f.field""")
def hmget_missing(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    held = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    asked = F.array(F.lit("name"), F.lit("missing"), F.lit("segment"))
    return c.select(F.col("c_custkey").alias("key"), F.posexplode(F.transform(asked, lambda f: F.try_element_at(held, f))).alias("pos", "value"))


@R.add("SELECT c_custkey AS key, CAST(strlen(c_name) AS INTEGER) AS n, 2 AS hlen, true AS has_name FROM customer")
def hstrlen_hexists(spark: SparkSession, sf: str) -> DataFrame:
    held = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("key"), F.octet_length(held["name"]).alias("n"), F.size(held).alias("hlen"), F.map_contains_key(held, "name").alias("has_name"))


@R.add(f"WITH {LOG}, {_AFTER} SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS INTEGER) AS pos, value FROM live WHERE cmd = 'RPUSH'")
def list_rpush(spark: SparkSession, sf: str) -> DataFrame:
    return Keyspace.from_log(log(spark, sf)).lists()


_BOTH = _map(purchase="RPUSH", view="LPUSH", error="DEL")


@R.add(f"""WITH {log_sql(_BOTH)}, {_AFTER} SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY CASE cmd WHEN 'LPUSH' THEN 0 ELSE 1 END, CASE cmd WHEN 'LPUSH' THEN -idx ELSE idx END) - 1 AS INTEGER) AS pos, value
FROM live WHERE cmd IN ('RPUSH', 'LPUSH')""")
def list_both_ends(spark: SparkSession, sf: str) -> DataFrame:
    return Keyspace.from_log(log(spark, sf, _BOTH)).lists()


@R.add("""WITH l AS (SELECT l_orderkey AS key, l_linenumber - 1 AS pos, l_partkey AS value, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT key, pos, value FROM l WHERE pos >= greatest(0, n - 3) AND pos <= n - 2""")
def lrange_negative(spark: SparkSession, sf: str) -> DataFrame:
    return keyspace.lrange(line_lists(spark, sf), -3, -2)


@R.add("SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1")
def llen(spark: SparkSession, sf: str) -> DataFrame:
    return line_lists(spark, sf).groupBy("key").agg(F.count("*").alias("n"))


@R.add("SELECT l_orderkey AS key, arg_max(l_partkey, row(l_linenumber, l_partkey)) AS value FROM lineitem GROUP BY 1")
def lindex_last(spark: SparkSession, sf: str) -> DataFrame:
    return line_lists(spark, sf).groupBy("key").agg(F.max_by("value", F.struct("pos", "value")).alias("value"))


@R.add(f"WITH {LOG}, {_AFTER} SELECT DISTINCT key, field AS member FROM live WHERE cmd = 'SADD'")
def sadd_members(spark: SparkSession, sf: str) -> DataFrame:
    return Keyspace.from_log(log(spark, sf)).sets()


_SREM = _map(view="SADD", click="SREM", error="DEL")


@R.add(f"""WITH {log_sql(_SREM)}, {_AFTER}, w AS (SELECT key, field, arg_max(cmd, idx) AS c FROM live WHERE cmd IN ('SADD', 'SREM') GROUP BY 1, 2)
SELECT key, count(*) AS n FROM w WHERE c = 'SADD' GROUP BY key""")
def srem_scard(spark: SparkSession, sf: str) -> DataFrame:
    return Keyspace.from_log(log(spark, sf, _SREM)).sets().groupBy("key").agg(F.count("*").alias("n"))


def _two_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Users and the last digit of their events: views are one set, purchases another."""
    e = table(spark, sf, "events").select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("member"), "event_type")
    return e.where("event_type = 'view'").select("member"), e.where("event_type = 'purchase'").select("member")


_A, _B = "SELECT user_id * 10 + event_id % 10 AS member FROM events WHERE event_type = 'view'", "SELECT user_id * 10 + event_id % 10 AS member FROM events WHERE event_type = 'purchase'"


@R.add(f"{_A} UNION {_B}")
def sunion(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two_sets(spark, sf)
    return a.union(b).distinct()


@R.add(f"{_A} INTERSECT {_B}")
def sinter(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two_sets(spark, sf)
    return a.intersect(b)


@R.add(f"{_A} EXCEPT {_B}")
def sdiff(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two_sets(spark, sf)
    return a.subtract(b)


@R.add(f"SELECT c_custkey AS member FROM customer WHERE c_custkey IN ({_A})")
def sismember_semi(spark: SparkSession, sf: str) -> DataFrame:
    a, _ = _two_sets(spark, sf)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("member")).join(a, "member", "left_semi")


_ZADD = _map(signup="ZADD", click="ZADD", view="ZREM", error="DEL")


@R.add(f"""WITH {log_sql(_ZADD)}, {_AFTER}, w AS (SELECT key, field, arg_max(cmd, idx) AS c, arg_max(num, idx) AS score FROM live WHERE cmd IN ('ZADD', 'ZREM') GROUP BY 1, 2)
SELECT key, field AS member, score FROM w WHERE c = 'ZADD'""")
def zadd_lww(spark: SparkSession, sf: str) -> DataFrame:
    return Keyspace.from_log(log(spark, sf, _ZADD)).zsets()


_ZINCR = _map(signup="ZADD", click="ZINCRBY", error="DEL")


@R.add(f"""WITH {log_sql(_ZINCR)}, {_AFTER}, t AS (SELECT *, coalesce((SELECT max(b.idx) FROM live b WHERE b.key = live.key AND b.field = live.field AND b.cmd = 'ZADD'), -1) AS base FROM live WHERE cmd IN ('ZADD', 'ZINCRBY'))
SELECT key, field AS member, CAST(sum(num) AS BIGINT) AS score FROM t WHERE idx >= base GROUP BY 1, 2""")
def zincrby(spark: SparkSession, sf: str) -> DataFrame:
    return Keyspace.from_log(log(spark, sf, _ZINCR)).zsets()


@R.add(f"WITH {ZSET_SQL} SELECT key, member, score, CAST(row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS INTEGER) AS rank FROM z")
def zrank(spark: SparkSession, sf: str) -> DataFrame:
    return zset.ranks(orders_zset(spark, sf))


@R.add(f"WITH {ZSET_SQL} SELECT key, member, score, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS INTEGER) AS rank FROM z")
def zrevrank(spark: SparkSession, sf: str) -> DataFrame:
    return zset.ranks(orders_zset(spark, sf), reverse=True)


@R.add(f"""WITH {ZSET_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS k, count(*) OVER (PARTITION BY key) AS n FROM z)
SELECT key, member, score, CAST(k AS INTEGER) AS rank FROM r WHERE k >= 1 AND k <= n - 2""")
def zrange_page(spark: SparkSession, sf: str) -> DataFrame:
    return zset.page(orders_zset(spark, sf), 1, -2)


@R.add(f"WITH {ZSET_SQL} SELECT key, member, score FROM z WHERE score > 5000000 AND score <= 20000000")
def zrangebyscore(spark: SparkSession, sf: str) -> DataFrame:
    return orders_zset(spark, sf).where(zset.in_range("(5000000", "20000000"))


@R.add(f"WITH {ZSET_SQL} SELECT key, member, score FROM z WHERE member >= '1' AND member < '3'")
def zrangebylex(spark: SparkSession, sf: str) -> DataFrame:
    return orders_zset(spark, sf).where(zset.in_lex("[1", "(3"))


@R.add(f"WITH {ZSET_SQL} SELECT key, count(*) FILTER (score >= 10000000) AS n FROM z GROUP BY key")
def zcount(spark: SparkSession, sf: str) -> DataFrame:
    return zset.count(orders_zset(spark, sf), "10000000", "+inf")


@R.add(f"WITH {ZSET_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS k FROM z) SELECT key, member, score, CAST(k AS INTEGER) AS rank FROM r WHERE k < 3")
def zpopmax_topk(spark: SparkSession, sf: str) -> DataFrame:
    return zset.pop(orders_zset(spark, sf), 3, largest=True)[0]


@R.add(f"WITH {ZSET_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS k FROM z) SELECT key, member, score FROM r WHERE k > 2")
def zpopmin_rest(spark: SparkSession, sf: str) -> DataFrame:
    return zset.pop(orders_zset(spark, sf), 2)[1]


@R.add(f"WITH {ZSET_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS k FROM z) SELECT key, member, score FROM r WHERE k NOT BETWEEN 0 AND 1")
def zremrangebyrank(spark: SparkSession, sf: str) -> DataFrame:
    z = orders_zset(spark, sf)
    return z.join(zset.page(z, 0, 1).select("key", "member"), ["key", "member"], "left_anti")


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("member"), F.col("l_quantity").cast("long").alias("score"), "l_returnflag")
    return tuple(li.where(F.col("l_returnflag") == f).groupBy("member").agg(F.sum("score").alias("score")) for f in ("A", "R"))


_S = "a AS (SELECT l_partkey AS member, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS score FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS member, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS score FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"


@R.add(f"WITH {_S} SELECT member, CAST(sum(score) AS BIGINT) AS score FROM (SELECT member, score * 2 AS score FROM a UNION ALL SELECT member, score * 3 FROM b) GROUP BY member")
def zunionstore_weighted(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return zset.combine([(a, 2), (b, 3)])


@R.add(f"WITH {_S} SELECT member, greatest(a.score, b.score) AS score FROM a JOIN b USING (member)")
def zinterstore(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return zset.combine([(a, 1), (b, 1)], "max", inter=True)


@R.add("SELECT event_type AS key, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def pfcount_exact(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("key")).agg(F.count_distinct("user_id").alias("n"))


@R.add()
def pfcount_approx(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches per key, merged over all keys: estimates, so checked by rows alone."""
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("key")).agg(F.hll_sketch_agg("user_id", F.lit(14)).alias("s"))
    merged = e.agg(F.hll_union_agg("s").alias("s")).select(F.lit("all").alias("key"), "s")
    return e.unionByName(merged).select("key", F.hll_sketch_estimate("s").alias("n"))


@R.add("""WITH p AS (SELECT c_custkey AS k, c_custkey % 360 - 180.0 AS lon, c_custkey % 170 - 85.0 AS lat FROM customer)
SELECT k, CAST(round(2 * 6372797.560856 * asin(sqrt(power(sin((radians(lat + 1) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat + 1)) * power(sin((radians(lon + 1) - radians(lon)) / 2), 2)))) AS BIGINT) AS metres FROM p""")
def geodist_haversine(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    lon, lat = (k % 360 - 180.0), (k % 170 - 85.0)
    return table(spark, sf, "customer").select(k.alias("k"), F.round(bits.haversine_m(lon, lat, lon + 1, lat + 1)).cast("long").alias("metres"))


@R.add("""WITH p AS (SELECT c_custkey AS k, c_custkey % 360 - 180.0 AS lon, c_custkey % 170 - 85.0 AS lat FROM customer)
SELECT k FROM p WHERE 2 * 6372797.560856 * asin(sqrt(power(sin((radians(40.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(40.0)) * power(sin((radians(10.0) - radians(lon)) / 2), 2))) <= 2000000""")
def georadius(spark: SparkSession, sf: str) -> DataFrame:
    """A bounding box that the scan can use, then the exact distance."""
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(k.alias("k"), (k % 360 - 180.0).alias("lon"), (k % 170 - 85.0).alias("lat"))
    return p.where(F.col("lat").between(40 - 18.1, 40 + 18.1)).where(bits.haversine_m(F.lit(10.0), F.lit(40.0), F.col("lon"), F.col("lat")) <= 2000000).select("k")


#: Bits of longitude and latitude by turns, five a letter.
_GEOHASH_SQL = """WITH p AS (SELECT c_custkey AS k, CAST(floor((c_custkey % 360) / 360.0 * power(2, 28)) AS BIGINT) AS x, CAST(floor((c_custkey % 170 - 85.0 + 90) / 180.0 * power(2, 27)) AS BIGINT) AS y FROM customer),
b AS (SELECT k, i, sum(((CASE WHEN (i * 5 + j) % 2 = 0 THEN x >> (27 - (i * 5 + j) // 2) ELSE y >> (26 - (i * 5 + j) // 2) END) & 1) << (4 - j)) AS v FROM p, range(0, 11) r(i), range(0, 5) q(j) GROUP BY k, i)
SELECT k, string_agg(substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(v AS INT) + 1, 1), '' ORDER BY i) AS hash FROM b GROUP BY k"""


@R.add(_GEOHASH_SQL)
def geohash(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("k"), bits.geohash(k % 360 - 180.0, k % 170 - 85.0).alias("hash"))


@R.add("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1%' AND p_name LIKE '_a%'")
def keys_glob(spark: SparkSession, sf: str) -> DataFrame:
    from keytide.functions.slots import glob_to_regex

    return table(spark, sf, "part").where(F.col("p_name").rlike(glob_to_regex("?a*1*"))).select("p_partkey", "p_name")


@R.add("SELECT o_custkey AS key, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS reply FROM orders GROUP BY 1")
def sorted_reply(spark: SparkSession, sf: str) -> DataFrame:
    from keytide.operators.commands import sorted_reply as ordered

    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.collect_list("o_orderpriority").alias("v"))
    return o.select("key", F.array_join(ordered(F.col("v")), ",").alias("reply"))


@R.add("SELECT 'c' || CAST(c_custkey AS VARCHAR) AS key, 'hash' AS type FROM customer UNION ALL SELECT DISTINCT 'z' || CAST(o_custkey AS VARCHAR), 'zset' FROM orders UNION ALL SELECT DISTINCT 'l' || CAST(l_orderkey AS VARCHAR), 'list' FROM lineitem")
def type_of_key(spark: SparkSession, sf: str) -> DataFrame:
    parts = (("customer", "c_custkey", "c", "hash"), ("orders", "o_custkey", "z", "zset"), ("lineitem", "l_orderkey", "l", "list"))
    out = None
    for name, column, prefix, kind in parts:
        t = table(spark, sf, name).select(F.col(column)).distinct().select(F.concat(F.lit(prefix), F.col(column)).alias("key"), F.lit(kind).alias("type"))
        out = t if out is None else out.unionByName(t)
    return out


_EXP = _map(signup="SET", click="EXPIREAT", view="PERSIST", error="DEL")


@R.add(f"""WITH {log_sql(_EXP)}, {_AFTER}, f AS (SELECT key, min(idx) AS since FROM live WHERE cmd = 'SET' GROUP BY key),
w AS (SELECT l.key, arg_max(l.cmd, l.idx) AS c, arg_max(num, l.idx) AS due FROM live l JOIN f ON f.key = l.key AND l.idx >= since WHERE l.cmd IN ('SET', 'EXPIREAT', 'PERSIST') GROUP BY l.key)
SELECT k.key, CASE WHEN c IS NULL THEN -2 WHEN c <> 'EXPIREAT' THEN -1 WHEN due > 5000 THEN due - 5000 ELSE -2 END AS ttl FROM (SELECT DISTINCT key FROM log) k LEFT JOIN w USING (key)""")
def ttl_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Time left at 5000: -1 for keys that don't expire, -2 for those that have or aren't there."""
    return Keyspace.from_log(log(spark, sf, _EXP)).ttl(5000)


@R.add("SELECT o_custkey AS key, CAST(o_orderkey AS VARCHAR) AS member, o_totalprice AS weight FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def sort_limit(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    o = table(spark, sf, "orders")
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("r", F.row_number().over(w)).where("r <= 2").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").cast("string").alias("member"), F.col("o_totalprice").alias("weight"))


@R.add("SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE o_orderkey > 400 ORDER BY o_orderkey LIMIT 1000")
def scan_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a scan of all orders after a cursor: the limit, 1000 keys by default, is the feature."""
    return table(spark, sf, "orders").where("o_orderkey > 400").orderBy("o_orderkey").limit(1000).select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value"))


@R.add(f"WITH {ZSET_SQL} SELECT key, arg_min(member, row(md5('42:' || key || ':' || member), member)) AS member FROM z GROUP BY key")
def random_member(spark: SparkSession, sf: str) -> DataFrame:
    """One member a key, chosen by a seeded hash, so that replays agree; an aggregate, so a hot key's members don't meet."""
    z = orders_zset(spark, sf)
    return z.groupBy("key").agg(F.min_by("member", F.struct(F.md5(F.concat_ws(":", F.lit("42"), "key", "member")), "member")).alias("member"))


@R.add(f"""WITH {LOG}, ordered AS (SELECT *, sum(CASE WHEN cmd = 'DEL' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY idx) AS ep FROM log WHERE cmd IN ('SET', 'INCRBY', 'DEL')),
e AS (SELECT *, sum(CASE WHEN cmd = 'SET' THEN 1 ELSE 0 END) OVER (PARTITION BY key, ep ORDER BY idx) AS s FROM ordered),
last AS (SELECT key, max(ep) AS ep FROM ordered GROUP BY key), l2 AS (SELECT e.key, e.ep, max(e.s) AS s FROM e JOIN last USING (key, ep) WHERE cmd <> 'DEL' GROUP BY 1, 2)
SELECT e.key, 'string' AS type, CAST(CAST(sum(num) AS BIGINT) AS VARCHAR) AS value FROM e JOIN l2 USING (key, ep, s) WHERE cmd <> 'DEL' GROUP BY e.key""")
def ordered_fold_counters(spark: SparkSession, sf: str) -> DataFrame:
    """The counters again, by the ordered fold: each key's commands in order through the store."""
    entries = log(spark, sf).where("cmd IN ('SET', 'INCRBY', 'DEL')")
    argv = F.when(F.col("cmd") == "DEL", F.array("cmd", "key")).otherwise(F.array("cmd", "key", "value"))
    return orderedfold.fold(entries.select("idx", "key", argv.alias("argv")), "key").select("key", "type", "value")


@R.add(f"""WITH {log_sql(_map(purchase="RPUSH", click="LPOP"))}, q AS (SELECT *, sum(CASE cmd WHEN 'RPUSH' THEN 1 ELSE -1 END) OVER (PARTITION BY key ORDER BY idx) AS h FROM log WHERE cmd IN ('RPUSH', 'LPOP')),
m AS (SELECT *, least(0, min(h) OVER (PARTITION BY key ORDER BY idx)) AS low FROM q) SELECT key, CAST(arg_max(h - low, idx) AS BIGINT) AS n FROM m GROUP BY key HAVING arg_max(h - low, idx) > 0""")
def ordered_fold_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of queues that are pushed and popped; a pop of an empty queue does nothing."""
    entries = log(spark, sf, _map(purchase="RPUSH", click="LPOP")).where("cmd IN ('RPUSH', 'LPOP')")
    argv = F.when(F.col("cmd") == "LPOP", F.array("cmd", "key")).otherwise(F.array("cmd", "key", "value"))
    return orderedfold.fold(entries.select("idx", "key", argv.alias("argv")), "key").groupBy("key").agg(F.count("*").alias("n"))
