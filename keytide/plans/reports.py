"""Queries on log maintenance and reports, pub/sub, scripts and who may run what."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.operators import clients, commands, logops, scripts
from keytide.plans.views import Registry, log, log_sql
from keytide.session import table

R = Registry()
_HALF = "(SELECT max(event_id) * 3 // 4 FROM events)"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("idx"), "event_type", F.octet_length("props").alias("data_len"))


# the log itself


@R.add(f"SELECT event_id AS idx, event_type FROM events WHERE event_id < {_HALF}")
def truncate_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The log without its last quarter."""
    cut = _log(spark, sf).agg(F.floor(F.max("idx") * 3 / 4)).first()[0]
    return logops.truncate_tail(_log(spark, sf), cut).select("idx", "event_type")


@R.add(f"SELECT event_id AS idx, event_type AS data FROM events WHERE event_id < {_HALF}")
def log_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """The log written as pages and read back; an entry at three quarters is lost, so pages beyond it don't count."""
    from keytide.session import shared_folder
    from keytide.sources import logfile

    logfile.register(spark)
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("idx"), F.lit(1).cast("long").alias("term"), F.col("event_id").cast("int").alias("entry_id"), F.lit(0).cast("decimal(20,0)").alias("session"), F.lit(0).alias("type"), F.encode("event_type", "UTF-8").alias("data"),
    )
    cut = e.agg(F.floor(F.max("idx") * 3 / 4)).first()[0]
    for part in (e.where(F.col("idx") < cut), e.where(F.col("idx") > cut)):
        part.repartitionByRange(4, "idx").sortWithinPartitions("idx").write.format("logpage").option("dbid", "k" * logfile.ID_LENGTH).mode("append").save(path)
    return logfile.recovered(spark, path).select("idx", F.col("data").cast("string").alias("data"))


@R.add("SELECT 100::BIGINT AS prev_log_idx, 7::BIGINT AS prev_log_term, 0::BIGINT AS entries, 101::BIGINT AS first, 100::BIGINT AS current")
def reset_log(spark: SparkSession, sf: str) -> DataFrame:
    empty, head = logops.reset(_log(spark, sf), 100, 7)
    return head.crossJoin(F.broadcast(logops.bounds(empty, 100))).select("prev_log_idx", "prev_log_term", F.col("count").alias("entries"), "first", "current")


@R.add("SELECT event_id // 1000 AS page, CAST(sum(strlen(props) + 24) + 120 AS BIGINT) AS bytes FROM events GROUP BY 1")
def log_page_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return logops.page_sizes(_log(spark, sf), F.col("data_len").cast("long") + 24, F.floor(F.col("idx") / 1000), 120)


@R.add("SELECT l_partkey AS idx, l_orderkey AS req, l_linenumber AS pos, event_type, CASE WHEN event_id IS NULL THEN false ELSE event_id % 3 = 0 END AS hit FROM lineitem LEFT JOIN events ON event_id = l_partkey")
def cache_first(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that lines ask for, a third of them in the cache."""
    whole = _log(spark, sf).select("idx", "event_type")
    wanted = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("idx"))
    found = logops.cache_first(wanted.distinct(), whole.where("idx % 3 = 0"), whole)
    asked = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("idx"), F.col("l_orderkey").alias("req"), F.col("l_linenumber").alias("pos"))
    return asked.join(found, "idx").select("idx", "req", "pos", "event_type", "hit")


@R.add(f"SELECT event_id AS idx, CASE WHEN event_id < {_HALF} THEN event_type ELSE 'TIMEOUT' END AS reply FROM events")
def uncommitted_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of requests when the last quarter of the log was never committed."""
    committed = truncate_tail(spark, sf).withColumnRenamed("event_type", "reply")
    return logops.uncommitted_replies(_log(spark, sf).select("idx"), committed)


@R.add("SELECT count(*) AS nodes, count(*) FILTER (s_acctbal > 0) AS voting, string_agg(s_suppkey || CASE WHEN s_acctbal > 0 THEN 'v' ELSE '-' END, ',' ORDER BY s_suppkey) AS listed FROM supplier")
def membership(spark: SparkSession, sf: str) -> DataFrame:
    return logops.membership(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), (F.col("s_acctbal") > 0).alias("voting")))


@R.add("SELECT event_id AS idx, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS turn FROM events")
def admission(spark: SparkSession, sf: str) -> DataFrame:
    return logops.admit(_log(spark, sf), 64).select("idx", "turn")


@R.add("WITH q AS (SELECT n_regionkey AS group_id, list_sort(list(n_nationkey), 'DESC')[count(*) // 2 + 1] AS i FROM nation GROUP BY 1) SELECT group_id, CASE WHEN i % 3 = 1 THEN i END AS committed FROM q")
def commit_of_term(spark: SparkSession, sf: str) -> DataFrame:
    """The quorum's index counts only where its entry is of the current term."""
    n = table(spark, sf, "nation")
    matches = n.select(F.col("n_regionkey").alias("group_id"), F.col("n_nationkey").alias("match_idx"))
    terms = n.select(F.col("n_regionkey").alias("group_id"), F.col("n_nationkey").alias("idx"), (F.col("n_nationkey") % 3).alias("term"))
    return logops.committed_index(matches, terms, 1)


_SESSION_SQL = "s AS (SELECT user_id AS client, min(event_id) AS opened, CASE WHEN user_id % 3 = 0 THEN max(event_id) END AS closed FROM events GROUP BY 1)"


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("client"))
    return e.agg(F.min("event_id").alias("opened"), F.max("event_id").alias("last")).select("client", "opened", F.when(F.col("client") % 3 == 0, F.col("last")).alias("closed"))


@R.add(f"WITH {_SESSION_SQL} SELECT count(DISTINCT client) AS n FROM s WHERE opened <= 500 AND (closed IS NULL OR closed > 500)")
def open_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return clients.open_sessions(_sessions(spark, sf), 500)


@R.add(f"""WITH {_SESSION_SQL}, e AS (SELECT count(*) AS a, min(event_id) AS b, max(event_id) AS c, sum(strlen(props)) AS d FROM events), n AS (SELECT count(*) AS f, count(*) FILTER (s_acctbal > 0) AS g FROM supplier), x AS (SELECT count(*) AS s FROM s)
SELECT unnest(['log_entries', 'first_log_index', 'current_log_index', 'log_bytes', 'num_sessions', 'num_nodes', 'num_voting_nodes']) AS name, unnest([a::BIGINT, b::BIGINT, c::BIGINT, d::BIGINT, s::BIGINT, f::BIGINT, g::BIGINT]) AS value FROM e, n, x""")
def info_report(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), (F.col("s_acctbal") > 0).alias("voting"))
    return logops.info(_log(spark, sf), _sessions(spark, sf), nodes)


@R.add("SELECT n_nationkey, 'name:' || n_name || chr(10) || 'cluster_enabled:1' AS text FROM nation")
def info_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", logops.cluster_enabled(F.concat(F.lit("name:"), "n_name", F.lit("\ncluster_enabled:"), F.col("n_nationkey") % 2 * 0)).alias("text"))


@R.add("SELECT c_custkey AS k, '*3' || chr(13) || chr(10) || ':' || c_custkey || chr(13) || chr(10) || '$' || strlen(c_name) || chr(13) || chr(10) || c_name || chr(13) || chr(10) || '*2' || chr(13) || chr(10) || ':' || c_nationkey || chr(13) || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN ':7' || chr(13) || chr(10) ELSE '$-1' || chr(13) || chr(10) END AS reply FROM customer")
def nested_reply(spark: SparkSession, sf: str) -> DataFrame:
    """A reply with a number, a text and an array that may hold none."""
    inner = F.array(F.col("c_nationkey"), F.when(F.col("c_custkey") % 2 == 0, 7))
    df = table(spark, sf, "customer").select("c_custkey", F.struct(F.col("c_custkey").alias("a"), F.col("c_name").alias("b"), inner.alias("c")).alias("r"))
    return df.select(F.col("c_custkey").alias("k"), commands.resp(F.col("r"), df.schema["r"].dataType).alias("reply"))


@R.add("SELECT c_custkey AS k, c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS asking, CAST((c_custkey % 8) | (c_nationkey % 16) AS BIGINT) AS cmd_flags, c_mktsegment AS acl, 'GET,' || c_name || ',SET' AS commands FROM customer")
def array_move(spark: SparkSession, sf: str) -> DataFrame:
    """Commands of one array put at the end of another."""
    part = lambda asking, flags, acl, cmds: F.struct(asking.alias("asking"), flags.cast("long").alias("cmd_flags"), acl.alias("acl"), cmds.alias("commands"))
    k = F.col("c_custkey")
    into = part(k % 2 == 0, k % 8, F.lit("old"), F.array(F.array(F.lit("GET"), F.col("c_name"))))
    taken = part(k % 3 == 0, F.col("c_nationkey") % 16, F.col("c_mktsegment"), F.array(F.array(F.lit("SET"))))
    moved = table(spark, sf, "customer").select(k.alias("k"), commands.moved_array(into, taken).alias("m"))
    return moved.select("k", "m.asking", "m.cmd_flags", "m.acl", F.array_join(F.flatten("m.commands"), ",").alias("commands"))


@R.add("SELECT o_custkey AS key, CASE WHEN o_custkey % 2 = 0 THEN string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) END AS reply, CASE WHEN o_custkey % 2 = 1 THEN 'ERR reply isn''t sorted' END AS error FROM orders GROUP BY 1")
def sort_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of SMEMBERS are sorted; those of LRANGE can't be."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.collect_list("o_orderpriority").alias("v"))
    s = o.select("key", commands.checked_sort(F.when(F.col("key") % 2 == 0, "smembers").otherwise("LRANGE"), F.col("v")).alias("s"))
    return s.select("key", F.array_join("s.reply", ",").alias("reply"), "s.error")


@R.add("SELECT lower(n_name) AS cmd, CAST(2 AS INTEGER) AS flags FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT lower(n_name), 4 FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 4 <> 2")
def module_reload(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue after modules changed some commands and took others away."""
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    base = n.where("n_nationkey % 4 = 1").unionByName(n.where("n_nationkey % 4 = 2")).select(F.lower("n_name").alias("cmd"), F.lit(2).alias("flags"))
    changes = n.where("n_nationkey % 2 = 0").select(k.alias("idx"), F.col("n_name").alias("cmd"), F.when(k % 4 == 2, F.lit(None)).otherwise(4).cast("int").alias("flags"))
    return commands.reloaded(base, changes)


@R.add("SELECT event_id AS idx, CASE event_type WHEN 'click' THEN 'reject_random' WHEN 'view' THEN 'sort_reply' ELSE 'pass' END AS target FROM events")
def script_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Inside a script random commands are refused and replies of sets are sorted."""
    cmd = F.when(F.col("event_type") == "click", "spop").when(F.col("event_type") == "view", "smembers").otherwise("set")
    return table(spark, sf, "events").select(F.col("event_id").alias("idx"), commands.route(cmd, F.lit(True)).alias("target"))


# scripts and functions

_CALLS = {"signup": "EVAL", "click": "EVALSHA", "view": "EVALSHA", "purchase": "SCRIPT LOAD", "error": "SCRIPT FLUSH"}
_BODIES = ("return KEYS[1]", "return ARGV[1]", "return call('set', KEYS[1], ARGV[1])")


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies by EVAL and SCRIPT LOAD, their names by EVALSHA; every fiftieth error is a FLUSH."""
    e = log(spark, sf, _CALLS).where("cmd <> 'SCRIPT FLUSH' or idx % 50 = 0")
    body = F.element_at(F.array(*[F.lit(b) for b in _BODIES]), (F.col("idx") % 3 + 1).cast("int"))
    return e.select("idx", "cmd", F.when(F.col("cmd") == "EVALSHA", scripts.sha1(body)).when(F.col("cmd") != "SCRIPT FLUSH", body).alias("script"), F.array("key").alias("keys"), F.array("value").alias("argv"))


_CALLS_SQL = f"""WITH {log_sql(_CALLS)}, c AS (SELECT *, idx % 3 AS b FROM log WHERE cmd <> 'SCRIPT FLUSH' OR idx % 50 = 0), f AS (SELECT *, max(CASE WHEN cmd = 'SCRIPT FLUSH' THEN idx END) OVER (ORDER BY idx) AS flush FROM c),
l AS (SELECT *, max(CASE WHEN cmd IN ('EVAL', 'SCRIPT LOAD') THEN idx END) OVER (PARTITION BY b ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS loaded FROM f WHERE cmd <> 'SCRIPT FLUSH'),
k AS (SELECT *, cmd <> 'EVALSHA' OR coalesce(loaded > coalesce(flush, -1), false) AS known FROM l)"""


@R.add(_CALLS_SQL + " SELECT idx, cmd, known, CASE WHEN NOT known THEN 'NOSCRIPT' WHEN b = 0 THEN key WHEN b = 1 THEN value ELSE 'OK' END AS reply FROM k")
def eval_replies(spark: SparkSession, sf: str) -> DataFrame:
    """EVAL, EVALSHA, SCRIPT LOAD and SCRIPT FLUSH: what is known, and what it answers."""
    found = scripts.resolve(_calls(spark, sf))
    library = {
        _BODIES[0]: scripts.Script(lambda keys, argv: F.get(keys, 0)), _BODIES[1]: scripts.Script(lambda keys, argv: F.get(argv, 0)),
        _BODIES[2]: scripts.Script(lambda keys, argv: F.lit("OK"), writes=True),
    }
    by_sha = {_sha(b): s for b, s in library.items()}
    return scripts.evaluate(found, by_sha, F.col("sha"), F.lit(False), F.col("known")).select("idx", "cmd", "known", "reply")


def _sha(body: str) -> str:
    import hashlib

    return hashlib.sha1(body.encode()).hexdigest()


@R.add(_CALLS_SQL + " SELECT idx, CASE WHEN NOT known THEN 'NOSCRIPT' WHEN b = 0 THEN key WHEN b = 1 THEN value ELSE 'ERR Write commands are not allowed from read-only scripts' END AS reply FROM k WHERE cmd = 'EVALSHA'")
def evalsha_ro(spark: SparkSession, sf: str) -> DataFrame:
    """The read-only forms refuse a script that writes."""
    found = scripts.resolve(_calls(spark, sf)).where("cmd = 'EVALSHA'")
    by_sha = {_sha(_BODIES[0]): scripts.Script(lambda keys, argv: F.get(keys, 0)), _sha(_BODIES[1]): scripts.Script(lambda keys, argv: F.get(argv, 0)), _sha(_BODIES[2]): scripts.Script(lambda keys, argv: F.lit("OK"), writes=True)}
    return scripts.evaluate(found, by_sha, F.col("sha"), F.lit(True), F.col("known")).select("idx", "reply")


@R.add(f"""WITH {log_sql(_CALLS)}, c AS (SELECT * FROM log WHERE cmd <> 'SCRIPT FLUSH' OR idx % 50 = 0), f AS (SELECT max(idx) FILTER (cmd = 'SCRIPT FLUSH') AS flush FROM c), h AS (SELECT DISTINCT idx % 3 AS b FROM c, f WHERE cmd IN ('EVAL', 'SCRIPT LOAD') AND (flush IS NULL OR idx > flush))
SELECT n_nationkey AS b, CASE WHEN n_nationkey IN (SELECT b FROM h) THEN 1 ELSE 0 END AS here FROM nation WHERE n_nationkey < 4""")
def script_exists(spark: SparkSession, sf: str) -> DataFrame:
    bodies = F.array(*[F.lit(b) for b in (*_BODIES, "return 1")])
    names = table(spark, sf, "nation").where("n_nationkey < 4").select(F.col("n_nationkey").alias("b"), scripts.sha1(F.get(bodies, F.col("n_nationkey"))).alias("sha"))
    return names.join(scripts.exists(names.select("sha"), _calls(spark, sf)), "sha").select("b", "here")


@R.add("""WITH e AS (SELECT event_id AS idx, 'lib' || user_id % 10 AS library, CASE WHEN event_id % 500 = 0 THEN 'FLUSH' WHEN event_type = 'error' THEN 'DELETE' ELSE 'LOAD' END AS kind, event_type AS n FROM events), f AS (SELECT max(idx) AS f FROM e WHERE kind = 'FLUSH' AND idx <= 1800),
l AS (SELECT library, arg_max(kind, idx) AS kind, arg_max(n, idx) AS n FROM e, f WHERE idx <= 1800 AND kind <> 'FLUSH' AND (f IS NULL OR idx > f) GROUP BY 1) SELECT library, n || unnest(['a', 'b']) AS name FROM l WHERE kind = 'LOAD'""")
def function_list(spark: SparkSession, sf: str) -> DataFrame:
    """Functions in force at entry 1800, two a library."""
    k = F.col("event_id")
    kind = F.when(k % 500 == 0, "FLUSH").when(F.col("event_type") == "error", "DELETE").otherwise("LOAD")
    entries = table(spark, sf, "events").select(k.alias("idx"), kind.alias("kind"), F.concat(F.lit("lib"), F.col("user_id") % 10).alias("library"), F.array(F.concat("event_type", F.lit("a")), F.concat("event_type", F.lit("b"))).alias("names"))
    return scripts.functions_as_of(entries, 1800).select("library", "name")


_FUNCTIONS = {
    "first": scripts.Script(lambda keys, argv: F.get(keys, 0)), "sum": scripts.Script(lambda keys, argv: F.aggregate(argv, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))),
    "put": scripts.Script(lambda keys, argv: F.lit("OK"), writes=True),
}
_FCALL_SQL = "SELECT o_orderkey AS idx, CASE o_orderkey %% 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN CAST(o_custkey + o_orderkey AS VARCHAR) WHEN 2 THEN %s ELSE 'ERR Function not found' END AS reply FROM orders"


def _fcall(spark: SparkSession, sf: str, read_only: bool) -> DataFrame:
    k = F.col("o_orderkey")
    calls = table(spark, sf, "orders").select(k.alias("idx"), F.array(F.col("o_custkey").cast("string")).alias("keys"), F.array(F.col("o_custkey").cast("string"), k.cast("string")).alias("argv"), F.get(F.array(F.lit("first"), F.lit("sum"), F.lit("put"), F.lit("none")), k % 4).alias("name"))
    return scripts.evaluate(calls, _FUNCTIONS, F.col("name"), F.lit(read_only)).select("idx", "reply")


@R.add(_FCALL_SQL % "'OK'")
def fcall(spark: SparkSession, sf: str) -> DataFrame:
    return _fcall(spark, sf, False)


@R.add(_FCALL_SQL % "'ERR Write commands are not allowed from read-only scripts'")
def fcall_ro(spark: SparkSession, sf: str) -> DataFrame:
    return _fcall(spark, sf, True)


_ACL = (("u1", "get", "Customer#*1"), ("u1", "set", "Customer#0000000*"), ("u2", "*", "*5"), ("u3", "get", "*"))
_ACL_SQL = """c AS (SELECT o_orderkey AS idx, 'u' || o_custkey % 5 AS u, CASE WHEN o_orderkey % 2 = 0 THEN 'GET' ELSE 'SET' END AS cmd, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS key, o_custkey AS client, o_orderkey % 7 AS txn FROM orders),
a AS (SELECT *, (u = 'u1' AND cmd = 'GET' AND key LIKE '%1') OR (u = 'u1' AND cmd = 'SET' AND key LIKE 'Customer#0000000%') OR (u = 'u2' AND key LIKE '%5') OR (u = 'u3' AND cmd = 'GET') AS allowed FROM c)"""


def _allowed(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    asked = table(spark, sf, "orders").select(k.alias("idx"), F.concat(F.lit("u"), c % 5).alias("user"), F.when(k % 2 == 0, "GET").otherwise("SET").alias("cmd"), F.concat(F.lit("Customer#"), F.lpad(c.cast("string"), 9, "0")).alias("key"), c.alias("client"), (k % 7).alias("txn"))
    return scripts.permitted(asked, spark.createDataFrame(_ACL, "user string, cmd string, pattern string"))


@R.add(f"WITH {_ACL_SQL} SELECT idx, allowed FROM a")
def acl_allowed(spark: SparkSession, sf: str) -> DataFrame:
    """Commands under the access list of the user who sent them."""
    return _allowed(spark, sf).select("idx", "allowed")


@R.add(f"WITH {_ACL_SQL} SELECT client, txn, bool_and(allowed) AS allowed FROM a GROUP BY 1, 2")
def multi_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    """A transaction is refused when one of its commands is."""
    return scripts.dry_run(_allowed(spark, sf))


# publications and subscriptions

_SUB_SQL = """e AS (SELECT event_id AS idx, user_id AS client, CASE WHEN event_id = 2000 THEN 'DROP' WHEN event_type = 'error' THEN 'UNSUBSCRIBE' WHEN event_type = 'signup' THEN 'PSUBSCRIBE' WHEN event_type = 'click' THEN 'SSUBSCRIBE' ELSE 'SUBSCRIBE' END AS event,
CASE WHEN event_type = 'signup' THEN ['ch*', '*1', 'ch2'][user_id % 3 + 1] ELSE 'ch' || event_id % 9 END AS channel FROM events),
l AS (SELECT client, channel, arg_max(event, idx) FILTER (event IN ('SUBSCRIBE', 'UNSUBSCRIBE')) AS s, max(idx) FILTER (event = 'PSUBSCRIBE') AS p, max(idx) FILTER (event = 'SSUBSCRIBE') AS sh FROM e WHERE idx > 2000 AND event <> 'DROP' GROUP BY 1, 2)"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e, k = table(spark, sf, "events"), F.col("event_id")
    kind = F.col("event_type")
    event = F.when(k == 2000, "DROP").when(kind == "error", "UNSUBSCRIBE").when(kind == "signup", "PSUBSCRIBE").when(kind == "click", "SSUBSCRIBE").otherwise("SUBSCRIBE")
    pattern = F.get(F.array(F.lit("ch*"), F.lit("*1"), F.lit("ch2")), (F.col("user_id") % 3).cast("int"))
    return e.select(k.alias("idx"), F.col("user_id").alias("client"), event.alias("event"), F.when(kind == "signup", pattern).otherwise(F.concat(F.lit("ch"), k % 9)).alias("channel"))


@R.add(f"WITH {_SUB_SQL} SELECT DISTINCT channel FROM l WHERE s = 'SUBSCRIBE' AND channel LIKE 'ch_'")
def pubsub_channels(spark: SparkSession, sf: str) -> DataFrame:
    return clients.channels(_events(spark, sf), "ch?")


@R.add(f"WITH {_SUB_SQL} SELECT DISTINCT channel FROM l WHERE sh IS NOT NULL AND channel LIKE '%2'")
def pubsub_shardchannels(spark: SparkSession, sf: str) -> DataFrame:
    return clients.channels(_events(spark, sf), "*2", "SSUBSCRIBE")


@R.add(f"WITH {_SUB_SQL} SELECT channel, count(*) AS n FROM l WHERE sh IS NOT NULL GROUP BY 1")
def pubsub_shardnumsub(spark: SparkSession, sf: str) -> DataFrame:
    return clients.subscriptions(_events(spark, sf), "SSUBSCRIBE")


@R.add(f"WITH {_SUB_SQL} SELECT count(DISTINCT channel) AS n FROM l WHERE p IS NOT NULL")
def pubsub_numpat(spark: SparkSession, sf: str) -> DataFrame:
    return clients.numpat(_events(spark, sf))


@R.add(f"""WITH {_SUB_SQL}, m AS (SELECT n_nationkey AS id, 'ch' || n_nationkey % 12 AS channel FROM nation), x AS (SELECT channel, count(*) AS n FROM l WHERE s = 'SUBSCRIBE' GROUP BY 1), p AS (SELECT replace(channel, '*', '%') AS pat, count(*) AS n FROM l WHERE p IS NOT NULL GROUP BY 1)
SELECT id, m.channel, CAST(coalesce(x.n, 0) + coalesce((SELECT sum(p.n) FROM p WHERE m.channel LIKE pat), 0) AS BIGINT) AS receivers FROM m LEFT JOIN x USING (channel)""")
def publish(spark: SparkSession, sf: str) -> DataFrame:
    """Who gets each message: subscribers of its channel, and of each pattern that fits."""
    m = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("ch"), F.col("n_nationkey") % 12).alias("channel"))
    return clients.publish(m, _events(spark, sf))


@R.add(f"WITH {_SUB_SQL}, x AS (SELECT channel, count(*) AS n FROM l WHERE sh IS NOT NULL GROUP BY 1) SELECT n_nationkey AS id, 'ch' || n_nationkey % 12 AS channel, CAST(coalesce(x.n, 0) AS BIGINT) AS receivers FROM nation LEFT JOIN x ON x.channel = 'ch' || n_nationkey % 12")
def spublish(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("ch"), F.col("n_nationkey") % 12).alias("channel"))
    return clients.publish(m, _events(spark, sf), shard=True)


@R.add("""WITH e AS (SELECT event_id AS idx, user_id AS client, 'ch' || event_id % 9 AS channel, CASE WHEN event_type IN ('error', 'click') THEN 'UNSUBSCRIBE' ELSE 'SUBSCRIBE' END AS event FROM events),
d AS (SELECT *, CASE WHEN event = coalesce(lag(event) OVER (PARTITION BY client, channel ORDER BY idx), 'UNSUBSCRIBE') THEN 0 WHEN event = 'SUBSCRIBE' THEN 1 ELSE -1 END AS d FROM e) SELECT idx, CAST(sum(d) OVER (PARTITION BY client ORDER BY idx) AS BIGINT) AS count FROM d""")
def subscribe_replies(spark: SparkSession, sf: str) -> DataFrame:
    """How many channels a client has after each SUBSCRIBE and UNSUBSCRIBE."""
    k = F.col("event_id")
    e = table(spark, sf, "events").select(k.alias("idx"), F.col("user_id").alias("client"), F.concat(F.lit("ch"), k % 9).alias("channel"), F.when(F.col("event_type").isin("error", "click"), "UNSUBSCRIBE").otherwise("SUBSCRIBE").alias("event"))
    return clients.subscription_counts(e).select("idx", "count")


_WATCH = {"signup": "WATCH", "click": "WATCH", "view": "GET", "purchase": "UNWATCH", "error": "EXEC"}


@R.add(f"WITH {log_sql(_WATCH)}, r AS (SELECT client, idx, cmd, field AS k FROM log WHERE cmd <> 'GET'), l AS (SELECT client, max(idx) FILTER (cmd <> 'WATCH') AS last FROM r GROUP BY 1) SELECT client, count(DISTINCT k) AS watches FROM r JOIN l USING (client) WHERE cmd = 'WATCH' AND (last IS NULL OR idx > last) GROUP BY 1")
def unwatch(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that clients still watch: those named since their last UNWATCH or EXEC."""
    return clients.unwatched(log(spark, sf, _WATCH).drop("key").withColumnRenamed("field", "key"))


@R.add("""WITH w AS (SELECT event_id AS idx FROM events WHERE event_type = 'signup'), t AS (SELECT event_id AS idx FROM events WHERE event_id % 97 = 0), n AS (SELECT w.idx, min(t.idx) AS term FROM w LEFT JOIN t ON t.idx >= w.idx GROUP BY 1),
s AS (SELECT idx, CASE WHEN idx % 3 = 0 THEN idx + 40 END AS done FROM w) SELECT idx, CASE WHEN term IS NOT NULL AND (done IS NULL OR done > term) THEN 'CANCELLED' WHEN done IS NULL THEN 'WAITING' ELSE 'v' || idx END AS reply FROM n JOIN s USING (idx)""")
def waiters_cancelled(spark: SparkSession, sf: str) -> DataFrame:
    """Waiters that a new term ends before they are served; a third are served forty entries later."""
    waits = table(spark, sf, "events").where("event_type = 'signup'").select(F.col("event_id").alias("idx"))
    terms = table(spark, sf, "events").where("event_id % 97 = 0").select(F.col("event_id").alias("idx"))
    served = waits.where("idx % 3 = 0").select(F.col("idx").alias("waiter"), (F.col("idx") + 40).alias("served_by"), F.concat(F.lit("v"), "idx").alias("value"))
    return clients.cancel(waits, terms, served)


_TXN = {"signup": "MULTI", "click": "SET", "view": "ASKING", "purchase": "EXEC", "error": "GET"}


@R.add(f"""WITH {log_sql(_TXN)}, s AS (SELECT *, coalesce(sum(CASE WHEN cmd = 'EXEC' THEN 1 ELSE 0 END) OVER (PARTITION BY client ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg, coalesce(lag(cmd) OVER (PARTITION BY client ORDER BY idx) = 'ASKING', false) AS asks FROM log),
o AS (SELECT *, min(CASE WHEN cmd = 'MULTI' THEN idx END) OVER (PARTITION BY client, seg) AS opened FROM s)
SELECT client, CAST(seg AS BIGINT) AS txn, bool_or(asks) AS asking FROM o WHERE idx >= opened AND cmd <> 'EXEC' AND (cmd <> 'MULTI' OR idx = opened) GROUP BY 1, 2""")
def txn_asking(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions that ask: ASKING before one of their commands."""
    entries = log(spark, sf, _TXN).select("client", F.col("idx").alias("arrival"), "cmd")
    return clients.asking_entries(clients.transactions(entries))
