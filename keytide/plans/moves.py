"""Queries on key migration and on log entries that change the topology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions import codecs, slots
from keytide.operators import migration, topology
from keytide.plans.views import RANGES_SQL, SLOT_SQL, Registry, nodes, ranges
from keytide.session import table

R = Registry()

#: A MIGRATE command a customer, some of them faulty.
_ARGV_SQL = """m AS (SELECT c_custkey AS idx, c_name AS key, CASE c_custkey % 6 WHEN 0 THEN 'no keys' WHEN 1 THEN 'single keys aren''t migrated' WHEN 2 THEN 'wrong number of arguments' END AS error FROM customer)"""


def _argv() -> F.Column:
    k = F.col("c_custkey") % 6
    head = lambda single: F.array(F.lit("MIGRATE"), F.lit("host"), F.lit("7000"), F.lit(single), F.lit("0"), F.lit("100"))
    keys = F.array(F.lit("keys"), F.col("c_name"), F.concat("c_name", F.lit("x")))
    auth = F.array(F.lit("auth2"), F.concat(F.lit("u"), F.col("c_nationkey")), F.lit("secret"))
    return (
        F.when(k == 0, F.concat(head(""), auth)).when(k == 1, F.concat(head("key"), keys)).when(k == 2, F.concat(head(""), F.array(F.lit("KEYS"))))
        .when(k == 3, F.concat(head(""), auth, keys)).otherwise(F.concat(head(""), keys))
    )


@R.add(f"""WITH {_ARGV_SQL} SELECT idx, CASE WHEN error IS NULL THEN key || ',' || key || 'x' END AS keys, CASE WHEN error IS NULL THEN CASE WHEN idx % 6 = 3 THEN 'u' || c_nationkey ELSE 'default' END END AS username,
CASE WHEN error IS NULL THEN CASE WHEN idx % 6 = 3 THEN 'secret' ELSE '' END END AS password, error FROM m JOIN customer ON c_custkey = idx""")
def migrate_parse(spark: SparkSession, sf: str) -> DataFrame:
    parsed = table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), migration.parse_migrate(_argv()).alias("m"))
    return parsed.select("idx", F.array_join("m.keys", ",").alias("keys"), "m.username", "m.password", "m.error")


def _slot(key: F.Column) -> F.Column:
    return slots.hash_slot(key)


@R.add(f"""WITH {RANGES_SQL}, k AS (SELECT c_custkey // 2 AS idx, CAST({SLOT_SQL.format(k="CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE CAST(c_custkey // 2 AS VARCHAR) END")} AS INTEGER) AS slot FROM customer),
g AS (SELECT idx, min(slot) AS slot, max(slot) AS high FROM k GROUP BY idx)
SELECT idx, g.slot, CASE WHEN g.slot <> high THEN 'CROSSSLOT' WHEN m.group_id IS NULL THEN 'ERR not migratable' WHEN NOT m.local THEN 'ERR not owned' WHEN i.group_id IS NULL THEN 'ERR no importing group' WHEN i.local THEN 'ERR importing into itself' ELSE 'OK' END AS outcome
FROM g LEFT JOIN ranges m ON m.type = 3 AND g.slot BETWEEN m.start AND m."end" LEFT JOIN ranges i ON i.type = 2 AND g.slot BETWEEN i.start AND i."end" """)
def migrate_lock_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Lock requests of one or two keys, some of them in different slots."""
    k = F.col("c_custkey")
    keys = table(spark, sf, "customer").select(F.floor(k / 2).alias("idx"), _slot(F.when(k % 3 == 0, F.col("c_name")).otherwise(F.floor(k / 2).cast("string"))).alias("slot"))
    return migration.lock_outcomes(keys, topology.slot_map(ranges(spark, sf)))


def _space(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit("string").alias("type"), F.col("c_mktsegment").alias("value"))


_SPACE_SQL = "space AS (SELECT c_custkey AS key, 'string' AS type, c_mktsegment AS value FROM customer), asked AS (SELECT DISTINCT l_orderkey AS idx, l_partkey AS key FROM lineitem)"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("idx"), F.col("l_partkey").alias("key"))


@R.add(f"WITH {_SPACE_SQL} SELECT idx, key FROM asked WHERE key IN (SELECT key FROM space)")
def lock_existing(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of a lock entry that exist are locked."""
    return migration.lock_keys(_asked(spark, sf), _space(spark, sf))


@R.add(f"WITH {_SPACE_SQL} SELECT key, 'string' || chr(10) || value AS body, true AS whole FROM space WHERE key IN (SELECT key FROM asked)")
def dump_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Locked keys exported and read back: the payload's head, and whether it is restored."""
    out = migration.export(_space(spark, sf), _asked(spark, sf))
    back = migration.restore(F.col("payload"))
    return out.select("key", F.concat_ws("\n", back["type"], back["value"]).alias("body"), (F.length(F.hex("payload")) == 2 * (F.octet_length(back["type"]) + F.octet_length(back["value"]) + 10)).alias("whole"))


@R.add("SELECT s_suppkey AS key, CASE WHEN s_suppkey % 4 = 0 THEN 'ERR bad payload' WHEN c_custkey IS NOT NULL AND s_suppkey % 2 = 1 THEN 'BUSYKEY' ELSE 'OK' END AS reply FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 3")
def restore_replies(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    payload = migration.dump(F.lit("string"), F.col("s_name"))
    given = table(spark, sf, "supplier").select((k * 3).alias("key"), k, F.when(k % 4 == 0, F.concat(payload, F.lit(b"0"))).otherwise(payload).alias("payload"), (k % 2 == 0).alias("replace"))
    return migration.restored(_space(spark, sf), given).select(F.col("s_suppkey").alias("key"), "reply")


_IMPORTS_SQL = """i AS (SELECT event_id // 2 AS idx, event_id % 2 AS pos, user_id % 16 AS slot, event_id // 500 + CAST(round(value) AS BIGINT) % 5 AS term, CASE WHEN event_id // 2 % 11 = 0 THEN 9 ELSE 7 END AS session_key, user_id % 16 < 12 AS importing, user_id * 3 AS key, event_type || event_id AS value FROM events),
f AS (SELECT *, importing AND session_key = 7 AS ok FROM i WHERE pos = 0)"""


def _imports(spark: SparkSession, sf: str) -> DataFrame:
    """Two keys an import; the slot of the first decides."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    return e.select(
        F.floor(k / 2).alias("idx"), (k % 2).alias("pos"), (F.col("user_id") % 16).alias("slot"), (F.floor(k / 500) + F.round("value").cast("long") % 5).alias("term"),
        F.when(F.floor(k / 2) % 11 == 0, 9).otherwise(7).alias("session_key"), (F.col("user_id") % 16 < 12).alias("importing"), F.lit(7).alias("slot_session"),
        (F.col("user_id") * 3).alias("key"), migration.dump(F.lit("string"), F.concat("event_type", k)).alias("payload"),
    )


@R.add(f"""WITH {_IMPORTS_SQL}, m AS (SELECT *, coalesce(max(CASE WHEN ok THEN term END) OVER (PARTITION BY slot ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM f),
g AS (SELECT idx FROM m WHERE ok AND term >= top), b AS (SELECT key, arg_max(value, idx * 2 + pos) AS value FROM i WHERE idx IN (SELECT idx FROM g) GROUP BY key)
SELECT c_custkey AS key, c_mktsegment AS value, c_custkey * 10 AS expire_at FROM customer WHERE c_custkey NOT IN (SELECT key FROM b) UNION ALL SELECT key, value, NULL FROM b""")
def import_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of accepted imports replace those that are there, and don't expire."""
    state = _space(spark, sf).withColumn("expire_at", F.col("key") * 10)
    return migration.import_keys(state, _imports(spark, sf)).select("key", "value", "expire_at")


@R.add("""WITH i AS (SELECT event_id AS idx, user_id % 16 AS slot, event_id // 500 + CAST(round(value) AS BIGINT) % 5 AS term, event_type FROM events),
e AS (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY slot ORDER BY idx) AS ep FROM i), m AS (SELECT *, coalesce(max(term) OVER (PARTITION BY slot, ep ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM e WHERE event_type <> 'error')
SELECT idx, slot, CASE WHEN term < top THEN 'term' ELSE 'ok' END AS status FROM m""")
def import_fencing_restarts(spark: SparkSession, sf: str) -> DataFrame:
    """Terms begin again where an entry makes the slot stable or migrating here."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    rows = e.select(
        k.alias("idx"), (F.col("user_id") % 16).alias("slot"), (F.floor(k / 500) + F.round("value").cast("long") % 5).alias("term"), F.lit(7).alias("session_key"),
        F.lit(True).alias("importing"), F.lit(7).alias("slot_session"), "event_type",
    )
    imports = rows.where("event_type <> 'error'").drop("event_type")
    return topology.fence(imports, rows.where("event_type = 'error'").select("idx", "slot")).select("idx", "slot", "status")


@R.add(f"WITH {_SPACE_SQL} SELECT key, value FROM space WHERE key NOT IN (SELECT key FROM asked WHERE idx % 2 = 0)")
def delete_unlock(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of moved entries, the even ones, are gone."""
    moved = _asked(spark, sf).where("idx % 2 = 0")
    return migration.delete_unlock(_space(spark, sf), _asked(spark, sf), moved)[0].select("key", "value")


@R.add(f"WITH {_SPACE_SQL} SELECT idx, key FROM asked WHERE key NOT IN (SELECT key FROM asked WHERE idx % 2 = 0)")
def locks_left(spark: SparkSession, sf: str) -> DataFrame:
    locks = migration.lock_keys(_asked(spark, sf), _asked(spark, sf).select("key").distinct())
    return migration.delete_unlock(_space(spark, sf), locks, _asked(spark, sf).where("idx % 2 = 0"))[1].select("idx", "key")


_STEP = "CASE event_type WHEN 'signup' THEN 'LOCK' WHEN 'click' THEN 'DUMP' WHEN 'view' THEN 'IMPORT' WHEN 'purchase' THEN 'DELETE_UNLOCK' ELSE 'FAILED' END"


@R.add(f"""WITH e AS (SELECT event_id AS idx, user_id AS key, {_STEP} AS step FROM events), r AS (SELECT *, count(*) FILTER (step = 'LOCK') OVER (PARTITION BY key ORDER BY idx) AS run FROM e),
d AS (SELECT *, min(idx) FILTER (step = 'DUMP') OVER (PARTITION BY key, run) AS d FROM r), i AS (SELECT *, min(idx) FILTER (step = 'IMPORT' AND idx > d) OVER (PARTITION BY key, run) AS i FROM d),
u AS (SELECT *, min(idx) FILTER (step = 'DELETE_UNLOCK' AND idx > i) OVER (PARTITION BY key, run) AS u FROM i)
SELECT idx, key, step, CASE WHEN run = 0 THEN 'FREE' WHEN idx >= u THEN 'MOVED' WHEN idx >= i THEN 'IMPORTED' WHEN idx >= d THEN 'DUMPED' ELSE 'LOCKED' END AS state FROM u""")
def migration_steps(spark: SparkSession, sf: str) -> DataFrame:
    step = F.when(F.col("event_type") == "signup", "LOCK").when(F.col("event_type") == "click", "DUMP").when(F.col("event_type") == "view", "IMPORT").when(F.col("event_type") == "purchase", "DELETE_UNLOCK").otherwise("FAILED")
    return migration.pipeline_steps(table(spark, sf, "events").select(F.col("event_id").alias("idx"), F.col("user_id").alias("key"), step.alias("step")))


# existence of a command's keys, and routing of entries with and without keys


@R.add("""WITH k AS (SELECT DISTINCT l_orderkey AS txn, l_partkey AS key FROM lineitem WHERE l_quantity > 20), m AS (SELECT txn, c_custkey IS NOT NULL AS here, s_suppkey IS NOT NULL AS held FROM k LEFT JOIN customer ON c_custkey = key * 5 LEFT JOIN supplier ON s_suppkey = key)
, g AS (SELECT txn, count(*) AS n, count(*) FILTER (here) AS e, count(*) FILTER (here AND held) AS l FROM m GROUP BY txn)
SELECT o_orderkey AS txn, CASE WHEN l > 0 THEN 'LOCKED' WHEN coalesce(n, 0) = coalesce(e, 0) THEN 'ALL' WHEN e = 0 THEN 'NONE' ELSE 'SOME' END AS exist FROM orders LEFT JOIN g ON txn = o_orderkey""")
def key_class(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of orders by joins with the keys that exist and those that are locked; orders without keys are ALL."""
    keys = table(spark, sf, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("txn"), F.col("l_partkey").alias("key"))
    here = table(spark, sf, "customer").where("c_custkey % 5 = 0").select((F.col("c_custkey") / 5).cast("long").alias("key"))
    held = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"))
    return topology.key_classes(keys, here, held, table(spark, sf, "orders").select(F.col("o_orderkey").alias("txn")))


@R.add(f"""WITH k AS (SELECT l_orderkey AS txn, CAST({SLOT_SQL.format(k="CAST(l_partkey % 3 AS VARCHAR)")} AS INTEGER) AS slot FROM lineitem WHERE l_quantity > 30), g AS (SELECT txn, min(slot) AS a, max(slot) AS b FROM k GROUP BY txn)
SELECT o_orderkey AS txn, CAST(CASE WHEN a IS NULL THEN -1 WHEN a = b THEN a END AS INTEGER) AS slot, coalesce(a <> b, false) AS crossed FROM orders LEFT JOIN g ON txn = o_orderkey""")
def crossslot_keyless(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("txn"), _slot((F.col("l_partkey") % 3).cast("string")).alias("slot"))
    return topology.cross_slot(keys, entries=table(spark, sf, "orders").select(F.col("o_orderkey").alias("txn")))


@R.add(f"""WITH {RANGES_SQL}, k AS (SELECT l_orderkey AS txn, CAST({SLOT_SQL.format(k="CAST(l_partkey % 3 AS VARCHAR)")} AS INTEGER) AS slot FROM lineitem WHERE l_quantity > 30), g AS (SELECT txn, min(slot) AS a, max(slot) AS b FROM k GROUP BY txn),
o AS (SELECT o_orderkey AS idx, a, b FROM orders LEFT JOIN g ON txn = o_orderkey), s AS (SELECT o.*, s.local AS sl, m.local AS ml FROM o LEFT JOIN ranges s ON s.type = 1 AND a = b AND a BETWEEN s.start AND s."end" LEFT JOIN ranges m ON m.type = 3 AND a = b AND a BETWEEN m.start AND m."end")
SELECT idx, CASE WHEN a IS NULL THEN 'OK' WHEN a <> b THEN 'CROSSSLOT' WHEN sl OR (sl IS NULL AND ml) THEN 'OK' WHEN sl IS NULL AND ml IS NULL THEN 'CLUSTERDOWN' ELSE 'MOVED' END AS outcome FROM s""")
def route_entries(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of entries with several keys, one or none."""
    entries = crossslot_keyless(spark, sf).select(F.col("txn").alias("idx"), "slot", F.lit(False).alias("asking"), F.lit("ALL").alias("exist"))
    out = topology.decide(entries, topology.slot_map(ranges(spark, sf)), nodes(spark, sf))
    return out.select("idx", F.split_part("outcome", F.lit(" "), F.lit(1)).alias("outcome"))


# entries that change the topology: nations as groups, entries by events

_ENTRIES_SQL = """t AS (SELECT max(event_id) // 2 AS mid FROM events), e AS (SELECT event_id AS idx, CASE WHEN event_id % 3 = 0 THEN 'ADD' ELSE 'UPDATE' END AS kind, 'g' || (user_id % 30) AS group_id, event_id % 16 AS lo, event_type AS host FROM events
UNION ALL SELECT mid, 'REPLACE', 'g' || n_nationkey, n_nationkey, n_name FROM nation, t WHERE n_nationkey < 20)"""


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """ADD and UPDATE entries by events, and one REPLACE by twenty groups in the middle of the log."""
    span = lambda lo: F.array(F.struct(lo.cast("int").alias("start"), (lo + 9).cast("int").alias("end"), F.lit(1).alias("type"), F.lit(0).cast("long").alias("session_key")))
    node = lambda host: F.array(F.struct(F.lit("n").alias("node_id"), host.alias("host"), F.lit(1).alias("port")))
    e, k = table(spark, sf, "events"), F.col("event_id")
    log = e.select(k.alias("idx"), F.when(k % 3 == 0, "ADD").otherwise("UPDATE").alias("kind"), F.concat(F.lit("g"), F.col("user_id") % 30).alias("group_id"), span(k % 16).alias("slot_ranges"), node(F.col("event_type")).alias("nodes"))
    middle = e.agg(F.floor(F.max(k) / 2).alias("idx"))
    n = table(spark, sf, "nation").where("n_nationkey < 20")
    replaced = n.crossJoin(F.broadcast(middle)).select("idx", F.lit("REPLACE").alias("kind"), F.concat(F.lit("g"), "n_nationkey").alias("group_id"), span(F.col("n_nationkey")).alias("slot_ranges"), node(F.col("n_name")).alias("nodes"))
    return log.unionByName(replaced)


_FOLD_SQL = f"""WITH {_ENTRIES_SQL}, l AS (SELECT e.* FROM e, t WHERE idx >= mid AND (idx > mid OR kind = 'REPLACE')), a AS (SELECT group_id, max(idx) AS ai, arg_max(lo, idx) AS lo, arg_max(host, idx) AS host FROM l WHERE kind <> 'UPDATE' GROUP BY 1),
u AS (SELECT group_id, max(idx) AS ui, arg_max(host, idx) AS host FROM l WHERE kind = 'UPDATE' AND group_id <> 'g0' GROUP BY 1), f AS (SELECT a.group_id, lo, CASE WHEN ui > ai THEN u.host ELSE a.host END AS host FROM a LEFT JOIN u USING (group_id))"""


@R.add(_FOLD_SQL + " SELECT group_id, CAST(lo AS INTEGER) AS start, host FROM f")
def shard_groups_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Groups in force: those of the last REPLACE, later ADDs, and later nodes by UPDATE, the local group's apart."""
    # the entry in the middle of the log gives way to the REPLACE that has its index
    entries = _entries(spark, sf)
    folded = topology.fold_groups(entries.withColumn("idx", F.col("idx") * 2 + F.when(F.col("kind") == "REPLACE", 1).otherwise(0)), "g0")
    return folded.select("group_id", F.get("slot_ranges", F.lit(0))["start"].alias("start"), F.get("nodes", F.lit(0))["host"].alias("host"))


@R.add(_FOLD_SQL + " SELECT group_id, lo || ' ' || (lo + 9) || ' 1' AS ranges, 'n ' || host || ':1' AS nodes FROM f WHERE group_id = 'g0'")
def shard_group_get(spark: SparkSession, sf: str) -> DataFrame:
    entries = _entries(spark, sf)
    folded = topology.fold_groups(entries.withColumn("idx", F.col("idx") * 2 + F.when(F.col("kind") == "REPLACE", 1).otherwise(0)), "g0")
    return topology.shard_group_get(folded, "g0").select("group_id", F.array_join("ranges", ",").alias("ranges"), F.array_join("nodes", ",").alias("nodes"))


@R.add("SELECT true AS sharding")
def is_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return topology.is_sharding(topology.fold_groups(_entries(spark, sf), "g0"))


@R.add("""WITH x AS (SELECT event_id AS idx, user_id % 25 AS slot, event_id // 100 AS term FROM events), r AS (SELECT CAST(u.slot AS BIGINT) AS slot, max(event_id) AS at FROM events, LATERAL (SELECT unnest(range(event_id % 16, event_id % 16 + 10)) AS slot) u WHERE event_type = 'error' GROUP BY 1)
SELECT x.slot, CAST(coalesce(max(term) FILTER (r.at IS NULL OR x.idx > r.at), 0) AS BIGINT) AS term FROM x LEFT JOIN r USING (slot) GROUP BY 1""")
def importing_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Largest importing term of each slot, from 0 again where the local group got the slot."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    entries = e.where("event_type = 'error'").select(k.alias("idx"), F.lit("g0").alias("group_id"), F.array(F.struct((k % 16).alias("start"), (k % 16 + 9).alias("end"), F.lit(1).alias("type"))).alias("slot_ranges"))
    terms = e.select(k.alias("idx"), (F.col("user_id") % 25).alias("slot"), F.floor(k / 100).alias("term"))
    return topology.slot_terms(entries, terms, "g0")


@R.add("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'invalid slot range' WHEN 1 THEN 'invalid slot type' WHEN 2 THEN 'invalid node' WHEN 3 THEN 'wrong number of arguments' END AS error, CASE WHEN n_nationkey % 5 = 4 THEN lower(n_name) || chr(10) || '1' || chr(10) || '1' || chr(10) || n_nationkey || chr(10) || (n_nationkey + 5) || chr(10) || '1' || chr(10) || '7' || chr(10) || 'node' || n_nationkey || chr(10) || 'h:7000' || chr(10) END AS text FROM nation""")
def shard_group_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Argument vectors of groups, most of them faulty, parsed and written as the text of an entry."""
    k, m = F.col("n_nationkey"), F.col("n_nationkey") % 5
    word = lambda c: c.cast("string")
    argv = F.array(
        F.lower("n_name"), F.lit("1"), F.lit("1"), word(k), word(F.when(m == 0, 20000).otherwise(k + 5)), F.when(m == 1, "4").otherwise("1"), F.lit("7"), F.concat(F.lit("node"), k), F.when(m == 2, "h:0").otherwise("h:7000"),
    )
    argv = F.when(m == 3, F.slice(argv, 1, 8)).otherwise(argv)
    p = table(spark, sf, "nation").select("n_nationkey", topology.parse_group(argv).alias("p"))
    g = F.col("p.group")
    group = F.struct(g["group_id"].alias("id"), g["slot_ranges"].alias("slot_ranges"), g["nodes"].alias("nodes"))
    return p.select("n_nationkey", "p.error", F.when(F.col("p.error").isNull(), codecs.shard_group_column(group)).alias("text"))


@R.add("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'ADD' WHEN 2 THEN 'REPLACE' WHEN 3 THEN 'LINK' END AS action FROM nation")
def shard_group_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("n_nationkey") % 5
    word = F.when(m == 0, "get").when(m == 1, "A").when(m == 2, "Repl").when(m == 3, "LINK").otherwise("getx")
    return table(spark, sf, "nation").select("n_nationkey", topology.subcommand(F.array(word)).alias("action"))


@R.add("WITH g AS (SELECT n_regionkey AS r, n_name || n_nationkey % 2 AS a, n_name || n_nationkey % 3 AS b FROM nation) SELECT r AS group_id, string_agg(a, ',' ORDER BY a) = string_agg(b, ',' ORDER BY b) AS same FROM g GROUP BY r")
def shard_groups_equal(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    held = n.groupBy(F.col("n_regionkey").alias("group_id")).agg(*[F.array_sort(F.collect_list(F.struct(F.concat("n_name", F.col("n_nationkey") % by).alias("node_id"), F.lit("h").alias("host"), F.lit(1).alias("port")))).alias(x) for x, by in (("a", 2), ("b", 3))])
    return held.select("group_id", topology.same_nodes(F.col("a"), F.col("b")).alias("same"))


@R.add("SELECT s_suppkey AS node_id, s_suppkey IN (SELECT c_custkey // 10 FROM customer) AS reused FROM supplier")
def node_id_reuse(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 10).alias("node_id"))
    return topology.reused_ids(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id")), used)


@R.add("""WITH f AS (SELECT user_id % 25 AS group_id, event_type AS nodes, event_id AS as_of FROM events WHERE event_type <> 'error' UNION ALL SELECT n_nationkey, n_name, -1 FROM nation) SELECT group_id, arg_max(nodes, as_of) AS nodes, max(as_of) AS as_of FROM f GROUP BY 1""")
def remote_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups after fetches; an error stands for a redirect, which brings no group."""
    known = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("group_id"), F.col("n_name").alias("nodes"), F.lit(-1).cast("long").alias("as_of"))
    fetched = table(spark, sf, "events").select((F.col("user_id") % 25).alias("group_id"), F.col("event_type").alias("nodes"), F.col("event_id").alias("as_of"), F.when(F.col("event_type") == "error", "h:1").alias("redirect"))
    return topology.merge_remote(known, fetched)


@R.add("""WITH k AS (SELECT l_orderkey AS idx, list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))) AS k FROM lineitem GROUP BY 1) SELECT idx, upper(hex('*' || len(k) || chr(10) || array_to_string(k, chr(1)) || chr(1))) AS hex FROM k""")
def lock_keys_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of lock entries; the zero byte that ends a key is shown as 1, which no key holds."""
    k = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("idx")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("k"))
    return k.select("idx", F.hex(F.translate(F.decode(codecs.lock_keys_column(F.col("k")), "UTF-8"), "\0", "\1")).alias("hex"))


@R.add("SELECT event_id AS idx, '*' || event_id || chr(10) || '*' || CASE WHEN event_type = 'error' THEN 1 ELSE 0 END || chr(10) AS text FROM events")
def timeout_payload(spark: SparkSession, sf: str) -> DataFrame:
    payload = codecs.timeout_column(F.col("event_id"), F.col("event_type") == "error")
    return table(spark, sf, "events").select(F.col("event_id").alias("idx"), F.decode(payload, "UTF-8").alias("text"))


@R.add("SELECT c_custkey AS idx, '*' || (c_custkey % 9 + 1) || chr(10) || '*' || c_nationkey || chr(10) || '*1' || chr(10) || '$' || strlen(c_name) || chr(10) || c_name || chr(10) || '$' || strlen(c_mktsegment) || chr(10) || c_mktsegment || chr(10) AS text FROM customer")
def import_payload(spark: SparkSession, sf: str) -> DataFrame:
    entries = F.array(F.struct(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("payload")))
    payload = codecs.import_column(F.col("c_custkey") % 9 + 1, F.col("c_nationkey"), entries)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), F.decode(payload, "UTF-8").alias("text"))


@R.add(f"""WITH k AS (SELECT c_name AS key, CAST({SLOT_SQL.format(k='c_name')} AS INTEGER) AS slot, row_number() OVER (ORDER BY c_name) AS r FROM customer WHERE c_name > 'Customer#000000020')
SELECT CASE WHEN max(r) > 100 THEN max(CASE WHEN r <= 100 THEN key END) ELSE '' END AS cursor, string_agg(key || ' ' || slot, ',' ORDER BY key) FILTER (r <= 100 AND slot < 8000) AS keys FROM k""")
def scan_slots_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a hundred keys after a cursor, of which those in the first 8000 slots are shown."""
    keys = table(spark, sf, "customer").select(F.col("c_name").alias("key"), _slot(F.col("c_name")).alias("slot"))
    wanted = spark.range(8000).select(F.col("id").cast("int").alias("slot"))
    return topology.scan_page(keys, wanted, "Customer#000000020", 100).select("cursor", F.array_join("keys", ",").alias("keys"))


@R.add("SELECT l_orderkey AS k, l_linenumber AS pos, l_partkey * 90 - 100 BETWEEN 0 AND 16383 AND l_partkey * 90 BETWEEN 0 AND 16383 AND l_linenumber IN (1, 2, 3) AND l_suppkey - 2 >= 0 AS good FROM lineitem")
def slot_range_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges, types and session keys, many of them out of bounds."""
    end = F.col("l_partkey") * 90
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), topology.valid_range(end - 100, end, F.col("l_linenumber"), F.col("l_suppkey") - 2).alias("good"))
