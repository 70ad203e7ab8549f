"""Queries on slots, routing, topology and migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.functions import slots
from keytide.operators import topology
from keytide.plans.views import NODES_SQL, RANGES_SQL, SLOT_SQL, Registry, log, log_sql, nodes, ranges
from keytide.session import table

R = Registry()


@R.add(f"SELECT c_custkey, CAST({SLOT_SQL.format(k='c_name')} AS INTEGER) AS slot FROM customer")
def hash_slot(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", slots.hash_slot(F.col("c_name")).alias("slot"))


@R.add("""WITH k AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'a{' || p_brand || '}b' WHEN 1 THEN '{}' || p_brand WHEN 2 THEN 'a{' || p_brand WHEN 3 THEN 'x{{' || p_brand || '}}y' ELSE p_brand END AS key, p_brand FROM part)
SELECT p_partkey, key, CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 3 THEN '{' || p_brand ELSE key END AS tag FROM k""")
def hash_tag(spark: SparkSession, sf: str) -> DataFrame:
    b, m = F.col("p_brand"), F.col("p_partkey") % 5
    key = (
        F.when(m == 0, F.concat(F.lit("a{"), b, F.lit("}b"))).when(m == 1, F.concat(F.lit("{}"), b)).when(m == 2, F.concat(F.lit("a{"), b))
        .when(m == 3, F.concat(F.lit("x{{"), b, F.lit("}}y"))).otherwise(b)
    )
    return table(spark, sf, "part").select("p_partkey", key.alias("key")).withColumn("tag", slots.hash_tag(F.col("key")))


@R.add("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE 3 + CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE 1 END END AS n FROM nation""")
def slot_list_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of lists like '5-7,100'; those that descend are refused."""
    k = F.col("n_nationkey")
    text = F.when(k % 4 == 0, F.concat_ws("-", k, k + 2)).when(k % 4 == 3, F.concat_ws("-", k + 9, k)).otherwise(F.concat(F.concat_ws("-", k, k + 2), F.lit(","), k + 100))
    return table(spark, sf, "nation").select("n_nationkey", text.alias("t")).select("n_nationkey", F.when(slots.slot_list(F.col("t")).isNotNull(), F.size(slots.slot_list(F.col("t")))).alias("n"))


@R.add(f"SELECT CAST({SLOT_SQL.format(k='c_name')} AS INTEGER) // 655 AS part, count(*) AS n FROM customer GROUP BY 1")
def slot_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy(F.floor(slots.hash_slot(F.col("c_name")) / 655).cast("int").alias("part")).agg(F.count("*").alias("n"))


@R.add(f"WITH s AS (SELECT c_name AS key, CAST({SLOT_SQL.format(k='c_name')} AS INTEGER) AS slot FROM customer) SELECT key, slot FROM s WHERE slot BETWEEN 0 AND 4000 OR slot = 9000")
def scan_slots_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the slots '0-4000,9000': the slot side has 16384 rows at most."""
    keys = table(spark, sf, "customer").select(F.col("c_name").alias("key"), slots.hash_slot(F.col("c_name")).alias("slot"))
    wanted = spark.range(1).select(F.explode(slots.slot_list(F.lit("0-4000,9000"))).alias("slot"))
    return keys.join(F.broadcast(wanted), "slot", "left_semi").select("key", "slot")


@R.add("SELECT n_nationkey, rpad(n_name, 32, 'x') || printf('%08x', n_nationkey) AS id FROM nation")
def node_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", slots.node_id(F.rpad("n_name", 32, "x"), F.col("n_nationkey")).alias("id"))


@R.add("SELECT n_nationkey, CASE WHEN n_nationkey > 0 THEN lower(n_name) || ':x' END AS host, CASE WHEN n_nationkey > 0 THEN n_nationkey * 100 END AS port FROM nation")
def address_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of redirect replies; port 0 is refused, and a colon may be in the host."""
    reply = F.concat(F.lit("MOVED 12 "), F.lower("n_name"), F.lit(":x:"), F.col("n_nationkey") * 100)
    return table(spark, sf, "nation").select("n_nationkey", slots.moved_address(reply).alias("a")).select("n_nationkey", "a.host", "a.port")


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    """Commands on customers' keys: the slot by key, every ninth asking, existence by a rule."""
    k = F.col("c_custkey")
    exist = F.when(k % 3 == 0, "ALL").when(k % 3 == 1, "NONE").otherwise("SOME")
    commands = table(spark, sf, "customer").select(k.alias("idx"), slots.hash_slot(F.col("c_name")).alias("slot"), (k % 9 == 0).alias("asking"), exist.alias("exist"))
    return topology.decide(commands, topology.slot_map(ranges(spark, sf)), nodes(spark, sf))


_OWNER = f"""WITH {RANGES_SQL}, {NODES_SQL}, c AS (SELECT c_custkey AS idx, CAST({SLOT_SQL.format(k='c_name')} AS INTEGER) AS slot, c_custkey % 9 = 0 AS asking, CASE c_custkey % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN 'NONE' ELSE 'SOME' END AS exist FROM customer),
own AS (SELECT c.*, s.group_id AS sg, s.local AS sl, m.group_id AS mg, m.local AS ml, i.group_id AS ig, i.local AS il FROM c
LEFT JOIN ranges s ON s.type = 1 AND slot BETWEEN s.start AND s."end" LEFT JOIN ranges m ON m.type = 3 AND slot BETWEEN m.start AND m."end" LEFT JOIN ranges i ON i.type = 2 AND slot BETWEEN i.start AND i."end"),
o AS (SELECT *, CASE WHEN sg IS NOT NULL THEN sg WHEN ml THEN mg WHEN asking AND il THEN ig ELSE mg END AS owner,
CASE WHEN sg IS NOT NULL THEN sl WHEN ml THEN ml WHEN asking AND il THEN il ELSE ml END AS local,
CASE WHEN sg IS NOT NULL THEN 1 WHEN ml THEN 3 WHEN asking AND il THEN 2 WHEN mg IS NOT NULL THEN 3 END AS kind FROM own)"""


@R.add(_OWNER + " SELECT idx, slot, owner FROM o")
def route_owner(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf).select("idx", "slot", "owner")


@R.add(_OWNER + """, t AS (SELECT *, row_number() OVER (PARTITION BY owner, owner IS NOT NULL AND NOT local ORDER BY idx) AS turn FROM o)
SELECT idx, exist, CASE WHEN owner IS NULL THEN 'CLUSTERDOWN' WHEN NOT local THEN 'MOVED ' || slot || ' ' || n.host || ':' || n.port
WHEN kind = 3 AND exist = 'SOME' THEN 'TRYAGAIN' WHEN kind = 3 AND exist = 'NONE' THEN coalesce('ASK ' || slot || ' ' || a.host || ':' || a.port, 'ERR no importing shard group to ask') WHEN kind = 2 AND exist <> 'ALL' THEN 'TRYAGAIN' ELSE 'OK' END AS outcome
FROM t LEFT JOIN nodes n ON n.group_id = owner AND n.node_no = turn % 3 LEFT JOIN nodes a ON a.group_id = ig AND a.node_no = 0""")
def route_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """OK, MOVED round the group's nodes, TRYAGAIN or CLUSTERDOWN of each command."""
    return _routed(spark, sf).select("idx", "exist", "outcome")


@R.add("""WITH e AS (SELECT l_orderkey AS txn, count(*) AS n, count(*) FILTER (l_partkey % 3 = 0) AS x FROM lineitem GROUP BY 1)
SELECT txn, CASE WHEN x = n THEN 'ALL' WHEN x = 0 THEN 'NONE' ELSE 'SOME' END AS exist FROM e""")
def key_existence(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("txn")).agg(F.count("*").alias("n"), F.count_if(F.col("l_partkey") % 3 == 0).alias("x"))
    return li.select("txn", topology.existence(F.col("n"), F.col("x"), F.lit(0)).alias("exist"))


@R.add(f"""WITH k AS (SELECT l_orderkey AS txn, CAST({SLOT_SQL.format(k="CAST(l_partkey % 50 AS VARCHAR)")} AS INTEGER) AS slot FROM lineitem), g AS (SELECT txn, min(slot) AS a, max(slot) AS b FROM k GROUP BY txn)
SELECT txn, CASE WHEN a = b THEN a END AS slot, a <> b AS crossed FROM g""")
def crossslot(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("txn"), slots.hash_slot((F.col("l_partkey") % 50).cast("string")).alias("slot"))
    return topology.cross_slot(keys)


def _proposed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.format_string("n%02d", "n_nationkey").alias("group_id"), (F.col("n_nationkey") * 650).alias("start"), (F.col("n_nationkey") * 650 + 9).alias("end"))


@R.add(f"""WITH {RANGES_SQL}, p AS (SELECT printf('n%02d', n_nationkey) AS group_id, n_nationkey * 650 + i AS slot FROM nation, range(0, 10) r(i))
SELECT DISTINCT p.group_id, p.slot FROM p JOIN ranges r ON r.type = 1 AND p.slot BETWEEN r.start AND r."end" """)
def slot_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return topology.overlaps(_proposed(spark, sf), ranges(spark, sf).where("type = 1"))


_CLASH = f"""{RANGES_SQL}, w AS (SELECT type, position, "start" AS a, "end" AS b FROM ranges UNION ALL SELECT n_nationkey % 3 + 1, 200 + n_nationkey, n_nationkey * 650, n_nationkey * 650 + 3 FROM nation),
p AS (SELECT type, position, CAST(u.slot AS INTEGER) AS slot FROM w, LATERAL (SELECT unnest(range(a, b + 1)) AS slot) u),
s AS (SELECT *, coalesce(bool_or(type = 1) OVER prior, false) AS s, coalesce(bool_or(type = 2) OVER prior, false) AS i, coalesce(bool_or(type = 3) OVER prior, false) AS m FROM p WINDOW prior AS (PARTITION BY slot ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@R.add(f"""WITH {_CLASH}, r AS (SELECT slot, position, CASE WHEN s THEN 'owned' WHEN type = 1 AND (i OR m) THEN 'resharding' WHEN type = 2 AND i THEN 'importing' WHEN type = 3 AND m THEN 'migrating' END AS reason FROM s)
SELECT slot, position, reason FROM r WHERE reason IS NOT NULL""")
def shard_validate(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    more = table(spark, sf, "nation").select((k % 3 + 1).cast("int").alias("type"), (k + 200).alias("position"), (k * 650).cast("int").alias("start"), (k * 650 + 3).cast("int").alias("end"))
    return topology.violations(ranges(spark, sf).select("type", "position", "start", "end").unionByName(more))


@R.add(f"""WITH {RANGES_SQL}, {NODES_SQL} SELECT r.group_id, r.start, r."end", string_agg(n.node_id || '@' || n.host || ':' || n.port, ',' ORDER BY n.node_no) AS nodes FROM ranges r JOIN nodes n USING (group_id) WHERE r.type <> 2 GROUP BY ALL""")
def cluster_slots(spark: SparkSession, sf: str) -> DataFrame:
    text = F.array_join(F.transform("nodes", lambda n: F.concat(n["node_id"], F.lit("@"), n["host"], F.lit(":"), n["port"])), ",")
    return topology.cluster_slots(ranges(spark, sf), nodes(spark, sf)).select("group_id", "start", "end", text.alias("nodes"))


@R.add(f"""WITH {RANGES_SQL}, {NODES_SQL}, p AS (SELECT group_id, string_agg("start" || ',' || "end", ',' ORDER BY position) FILTER (type IN (1, 3)) AS slots FROM ranges GROUP BY 1)
SELECT n.group_id, coalesce(p.slots, '') AS slots, string_agg(n.host || ':' || n.port || CASE node_no WHEN 0 THEN ' master' ELSE ' replica' END, ',' ORDER BY node_no) AS nodes FROM nodes n JOIN p USING (group_id) GROUP BY ALL""")
def cluster_shards(spark: SparkSession, sf: str) -> DataFrame:
    text = F.array_join(F.transform("nodes", lambda n: F.concat(n["host"], F.lit(":"), n["port"], F.lit(" "), n["role"])), ",")
    return topology.cluster_shards(ranges(spark, sf), nodes(spark, sf)).select("group_id", F.array_join(F.col("slots").cast("array<string>"), ",").alias("slots"), text.alias("nodes"))


@R.add(f"""WITH {RANGES_SQL}, {NODES_SQL}, p AS (SELECT group_id, coalesce(string_agg("start" || '-' || "end", ' ' ORDER BY position) FILTER (type <> 2), '') AS slots FROM ranges GROUP BY 1)
SELECT n.group_id, n.node_no, n.node_id || ' ' || n.host || ':' || n.port || '@' || n.port || CASE n.node_no WHEN 0 THEN ' master -' ELSE ' slave ' || f.node_id END || ' 0 0 0 connected ' || CASE n.node_no WHEN 0 THEN p.slots ELSE '' END AS line
FROM nodes n JOIN nodes f ON f.group_id = n.group_id AND f.node_no = 0 JOIN p ON p.group_id = n.group_id""")
def cluster_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return topology.cluster_nodes(ranges(spark, sf), nodes(spark, sf))


@R.add(f"""WITH {RANGES_SQL}, {NODES_SQL}, h AS (SELECT type, CAST(u.slot AS INTEGER) AS slot FROM ranges, LATERAL (SELECT unnest(range("start", "end" + 1)) AS slot) u WHERE local AND type <> 1)
SELECT h.slot, ' [' || h.slot || '-' || CASE h.type WHEN 2 THEN '<' ELSE '>' END || '-' || n.node_id || ']' AS note FROM h JOIN ranges r ON r.type = 5 - h.type AND h.slot BETWEEN r.start AND r."end" JOIN nodes n ON n.group_id = r.group_id AND n.node_no = 0""")
def migration_notes(spark: SparkSession, sf: str) -> DataFrame:
    return topology.move_notes(ranges(spark, sf), nodes(spark, sf).where("node_no = 0"))


@R.add(f"WITH {log_sql()}, c AS (SELECT idx, user_id % 97 AS config FROM (SELECT event_id AS idx, user_id FROM events WHERE event_type = 'signup')) SELECT l.idx, c.config FROM log l ASOF LEFT JOIN c ON l.idx >= c.idx WHERE l.cmd <> 'SET'")
def as_of_topology(spark: SparkSession, sf: str) -> DataFrame:
    """The configuration in force at each entry."""
    entries = log(spark, sf)
    configs = entries.where("cmd = 'SET'").select("idx", (F.col("client") % 97).alias("config"))
    return topology.as_of(entries.where("cmd <> 'SET'").select("idx"), configs, "config")


@R.add("""WITH i AS (SELECT event_id AS idx, user_id % 16 AS slot, event_id // 500 + CAST(round(value) AS BIGINT) % 5 AS term, CASE WHEN event_id % 11 = 0 THEN 9 ELSE 7 END AS session_key, user_id % 16 < 12 AS importing FROM events),
p AS (SELECT *, importing AND session_key = 7 AS ok FROM i), m AS (SELECT *, coalesce(max(CASE WHEN ok THEN term END) OVER (PARTITION BY slot ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM p)
SELECT idx, slot, CASE WHEN NOT importing THEN 'slot' WHEN NOT ok THEN 'session' WHEN term < top THEN 'term' ELSE 'ok' END AS status FROM m""")
def import_fencing(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.col("event_id")
    imports = e.select(
        k.alias("idx"), (F.col("user_id") % 16).alias("slot"), (F.floor(k / 500) + F.round("value").cast("long") % 5).alias("term"),
        F.when(k % 11 == 0, 9).otherwise(7).alias("session_key"), (F.col("user_id") % 16 < 12).alias("importing"), F.lit(7).alias("slot_session"),
    )
    return topology.fence(imports).select("idx", "slot", "status")


@R.add("WITH s AS (SELECT c_custkey AS key, c_acctbal AS value FROM customer), i AS (SELECT s_suppkey AS key, s_acctbal AS value FROM supplier) SELECT key, value FROM s WHERE key NOT IN (SELECT key FROM i) UNION ALL SELECT key, value FROM i")
def import_replace(spark: SparkSession, sf: str) -> DataFrame:
    from keytide.sources.snapshot import merge_keys

    state = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return merge_keys(state, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value")))


@R.add("SELECT n_regionkey AS group_id, CASE WHEN n_regionkey = 0 THEN arg_min(n_name, n_nationkey) ELSE arg_max(n_name, n_nationkey) END AS nodes FROM nation GROUP BY 1")
def shard_group_update(spark: SparkSession, sf: str) -> DataFrame:
    """The last update of each group's nodes; the local group keeps those it was added with."""
    n = table(spark, sf, "nation")
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("f"))
    entries = n.join(first, "n_regionkey").select(
        F.col("n_nationkey").alias("idx"), F.when(F.col("n_nationkey") == F.col("f"), "ADD").otherwise("UPDATE").alias("kind"), F.col("n_regionkey").alias("group_id"), F.array("f").alias("slot_ranges"), F.col("n_name").alias("nodes"),
    )
    return topology.fold_groups(entries, "0").select("group_id", "nodes")


@R.add("""WITH a AS (SELECT n_regionkey AS g, n_name AS addr, n_nationkey AS k FROM nation), r AS (SELECT g, addr, min(k) AS k FROM (SELECT g, addr, k FROM a UNION ALL SELECT g, addr, k + 100 FROM a) GROUP BY 1, 2)
SELECT g AS group_id, string_agg(addr, ',' ORDER BY k) AS addresses FROM r GROUP BY g""")
def address_union(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of addresses joined, first places kept."""
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("group_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("a"))
    return n.select("group_id", F.array_join(slots.addresses_joined(F.col("a"), F.reverse("a")), ",").alias("addresses"))
