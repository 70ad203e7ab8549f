"""Queries on transactions, sessions, locks, waiters, subscriptions and commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.operators import clients, commands
from keytide.plans.views import Registry, log, log_sql
from keytide.session import table

R = Registry()
_TX = {"signup": "MULTI", "click": "INCRBY", "view": "WATCH", "purchase": "EXEC", "error": "DISCARD"}
_SPANS = f"""WITH {log_sql(_TX)}, s AS (SELECT *, coalesce(sum(CASE WHEN cmd IN ('EXEC', 'DISCARD') THEN 1 ELSE 0 END) OVER (PARTITION BY client ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM log),
o AS (SELECT *, min(CASE WHEN cmd = 'MULTI' THEN idx END) OVER (PARTITION BY client, seg) AS opened FROM s),
r AS (SELECT *, CASE WHEN idx = opened THEN 'begin' WHEN idx > opened AND cmd = 'MULTI' THEN 'nested' WHEN idx > opened AND cmd = 'WATCH' THEN 'watch' WHEN idx > opened AND cmd = 'EXEC' THEN 'exec' WHEN idx > opened AND cmd = 'DISCARD' THEN 'discard'
WHEN cmd IN ('EXEC', 'DISCARD') THEN 'stray' WHEN idx > opened THEN 'queued' ELSE 'single' END AS role FROM o)"""


def _judged(spark: SparkSession, sf: str, mapping: dict[str, str]) -> DataFrame:
    return clients.transactions(log(spark, sf, mapping).select("idx", "client", "cmd"), "client", "idx")


@R.add(_SPANS + " SELECT idx, client, role FROM r")
def txn_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf, _TX).select("idx", "client", "role")


@R.add(_SPANS + " SELECT client, CAST(seg AS BIGINT) AS txn, count(*) FILTER (role IN ('begin', 'queued')) AS n_commands FROM r WHERE role NOT IN ('single', 'stray') GROUP BY 1, 2 HAVING bool_or(role = 'exec')")
def txn_entries(spark: SparkSession, sf: str) -> DataFrame:
    """One log entry per executed transaction."""
    return clients.entries(_judged(spark, sf, _TX), "client", "idx").select("client", "txn", "n_commands")


_POISON = _TX | {"view": "DEBUG"}


@R.add(f"""WITH {log_sql(_POISON)}, s AS (SELECT *, coalesce(sum(CASE WHEN cmd IN ('EXEC', 'DISCARD') THEN 1 ELSE 0 END) OVER (PARTITION BY client ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM log),
o AS (SELECT *, min(CASE WHEN cmd = 'MULTI' THEN idx END) OVER (PARTITION BY client, seg) AS opened FROM s), p AS (SELECT *, bool_or(idx > opened AND cmd = 'DEBUG') OVER (PARTITION BY client, seg) AS bad FROM o)
SELECT idx, client, CASE WHEN bad THEN 'EXECABORT' ELSE 'EXECUTED' END AS reply FROM p WHERE cmd = 'EXEC' AND opened < idx""")
def txn_poison(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf, _POISON).where("role = 'exec'").select("idx", "client", "reply")


_SESSION = {"signup": "WATCH", "click": "WATCH", "view": "END", "purchase": "OTHER", "error": "OTHER"}


@R.add("""WITH e AS (SELECT event_id AS idx, user_id AS client, CASE WHEN event_id % 997 = 0 THEN 'NO_OP' WHEN event_type IN ('signup', 'click') THEN 'WATCH' WHEN event_type = 'view' THEN 'END' ELSE 'OTHER' END AS event FROM events),
b AS (SELECT idx FROM e WHERE event = 'NO_OP'), o AS (SELECT * FROM e WHERE event IN ('WATCH', 'END')),
c AS (SELECT o.*, least((SELECT min(x.idx) FROM o x WHERE x.client = o.client AND x.event = 'END' AND x.idx > o.idx), (SELECT min(b.idx) FROM b WHERE b.idx > o.idx)) AS closed FROM o),
p AS (SELECT *, max(CASE WHEN event = 'WATCH' THEN coalesce(closed, 9223372036854775807) END) OVER (PARTITION BY client ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM c)
SELECT client, idx AS opened, closed FROM p WHERE event = 'WATCH' AND (prior IS NULL OR prior < idx)""")
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Client sessions; every 997th entry begins a new term and closes all."""
    e = log(spark, sf, _SESSION)
    return clients.sessions(e.select("idx", "client", F.when(F.col("idx") % 997 == 0, "NO_OP").otherwise(F.col("cmd")).alias("event")))


_ASK = {"signup": "ASKING", "click": "GET", "view": "GET", "purchase": "SET", "error": "GET"}


@R.add(f"WITH {log_sql(_ASK)}, a AS (SELECT *, coalesce(lag(cmd) OVER (PARTITION BY client ORDER BY idx) = 'ASKING', false) AS asking FROM log) SELECT idx, client, asking FROM a WHERE cmd <> 'ASKING'")
def asking_lag(spark: SparkSession, sf: str) -> DataFrame:
    return clients.with_asking(log(spark, sf, _ASK), "client", "idx").where("cmd <> 'ASKING'").select("idx", "client", "asking")


_LOCK = {"signup": "LOCK", "error": "UNLOCK", "click": "GET", "view": "GET", "purchase": "GET"}
_LOCKS = f"""WITH {log_sql(_LOCK)}, e AS (SELECT idx, key, cmd, lag(cmd) OVER (PARTITION BY key ORDER BY idx) AS p FROM log WHERE cmd IN ('LOCK', 'UNLOCK')), ch AS (SELECT *, lead(idx) OVER (PARTITION BY key ORDER BY idx) AS nxt FROM e WHERE p IS NULL OR p <> cmd),
i AS (SELECT key, idx AS locked, nxt AS unlocked FROM ch WHERE cmd = 'LOCK')"""


def _locks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    entries = log(spark, sf, _LOCK)
    return entries, clients.lock_intervals(entries.where("cmd in ('LOCK', 'UNLOCK')").select("idx", "key", F.col("cmd").alias("event")))


@R.add(_LOCKS + " SELECT key, locked, unlocked FROM i")
def lock_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return _locks(spark, sf)[1]


@R.add(_LOCKS + " SELECT l.idx, l.key, i.key IS NOT NULL AS locked FROM log l LEFT JOIN i ON i.key = l.key AND l.idx > i.locked AND (i.unlocked IS NULL OR l.idx < i.unlocked) WHERE l.cmd = 'GET'")
def held_locks(spark: SparkSession, sf: str) -> DataFrame:
    entries, intervals = _locks(spark, sf)
    return clients.held_locks(entries.where("cmd = 'GET'").select("idx", "key"), intervals)


_WAIT = {"signup": "BLPOP", "click": "GET", "view": "GET", "purchase": "RPUSH", "error": "TIMEOUT"}
_FIFO = f"""WITH {log_sql(_WAIT)}, w AS (SELECT key, idx AS waiter, row_number() OVER (PARTITION BY key ORDER BY idx) AS r FROM log WHERE cmd = 'BLPOP'), p AS (SELECT key, idx AS served_by, value, row_number() OVER (PARTITION BY key ORDER BY idx) AS r FROM log WHERE cmd = 'RPUSH'),
f AS (SELECT w.key, waiter, served_by, value FROM w LEFT JOIN p USING (key, r))"""


def _served(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    entries = log(spark, sf, _WAIT)
    return entries, clients.fifo(entries.where("cmd = 'BLPOP'").select("key", "idx"), entries.where("cmd = 'RPUSH'").select("key", "idx", "value"))


@R.add(_FIFO + " SELECT key, waiter, served_by, value FROM f")
def fifo_waiters(spark: SparkSession, sf: str) -> DataFrame:
    return _served(spark, sf)[1]


@R.add(_FIFO + """, t AS (SELECT w.waiter, w.waiter + 300 AS ended, w.waiter % 2 = 0 AS err FROM w WHERE w.waiter % 3 = 0)
SELECT f.waiter AS idx, CASE WHEN served_by IS NOT NULL AND (ended IS NULL OR served_by < ended) THEN value WHEN ended IS NULL THEN 'WAITING' WHEN err THEN 'UNBLOCKED' ELSE 'NIL' END AS reply FROM f LEFT JOIN t ON t.waiter = f.waiter""")
def waiter_timeout(spark: SparkSession, sf: str) -> DataFrame:
    """Every third waiter has a timeout event 300 entries later, an error for even ones."""
    entries, served = _served(spark, sf)
    waits = entries.where("cmd = 'BLPOP'").select("idx")
    events = waits.where("idx % 3 = 0").select(F.col("idx").alias("waits_idx"), (F.col("idx") + 300).alias("idx"), (F.col("idx") % 2 == 0).alias("error"))
    return clients.settle_timeouts(waits, events, served)


@R.add("""WITH c AS (SELECT DISTINCT 'ch' || CAST(user_id AS VARCHAR) AS channel FROM events), p AS (SELECT * FROM (VALUES ('ch1?', '^ch1.$'), ('*7', '^.*7$'), ('ch25', '^ch25$'), ('c*3', '^c.*3$')) v(pattern, re))
SELECT channel, pattern FROM c, p WHERE regexp_matches(channel, re)""")
def pubsub_pattern(spark: SparkSession, sf: str) -> DataFrame:
    channels = table(spark, sf, "events").select(F.concat(F.lit("ch"), F.col("user_id")).alias("channel")).distinct()
    patterns = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("ch1?", "*7", "ch25", "c*3")])).alias("pattern"))
    return clients.pattern_matches(channels, patterns)


@R.add("""WITH e AS (SELECT event_id AS idx, user_id AS client, 'ch' || CAST(event_id % 5 AS VARCHAR) AS channel, CASE WHEN event_id = 2000 THEN 'DROP' WHEN event_type = 'error' THEN 'UNSUBSCRIBE' ELSE 'SUBSCRIBE' END AS event FROM events),
l AS (SELECT client, channel, arg_max(event, idx) AS ev FROM e WHERE event <> 'DROP' AND idx > 2000 GROUP BY 1, 2) SELECT channel, count(*) AS n FROM l WHERE ev = 'SUBSCRIBE' GROUP BY 1""")
def numsub(spark: SparkSession, sf: str) -> DataFrame:
    """Subscribers a channel after a change of role at entry 2000."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    event = F.when(k == 2000, "DROP").when(F.col("event_type") == "error", "UNSUBSCRIBE").otherwise("SUBSCRIBE")
    return clients.subscriptions(e.select(k.alias("idx"), F.col("user_id").alias("client"), F.concat(F.lit("ch"), k % 5).alias("channel"), event.alias("event")))


_FLAGGED = {"signup": "set", "click": "get", "view": "keys", "purchase": "blpop", "error": "debug"}


@R.add(f"WITH {log_sql(_FLAGGED)} SELECT client, CAST(bit_or(CASE cmd WHEN 'set' THEN 4 WHEN 'get' THEN 2 WHEN 'keys' THEN 34 WHEN 'blpop' THEN 260 ELSE 8 END) AS INTEGER) AS flags FROM log GROUP BY 1")
def flags_bit_or(spark: SparkSession, sf: str) -> DataFrame:
    return commands.array_flags(log(spark, sf, _FLAGGED), "client")


@R.add(f"WITH {log_sql(_FLAGGED)} SELECT idx, CASE cmd WHEN 'set' THEN 'log' WHEN 'get' THEN 'read' WHEN 'keys' THEN 'read' WHEN 'blpop' THEN 'log' ELSE 'reject' END AS target FROM log")
def interception_route(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf, _FLAGGED).select("idx", commands.route(F.col("cmd")).alias("target"))


@R.add("SELECT event_id AS idx, CAST(ceil(value * 1000) AS BIGINT) AS ms FROM events")
def blocking_timeouts(spark: SparkSession, sf: str) -> DataFrame:
    argv = F.array(F.lit("BLPOP"), F.lit("key"), F.col("value").cast("string"))
    return table(spark, sf, "events").select(F.col("event_id").alias("idx"), commands.timeout_ms(argv).alias("ms"))


@R.add("""WITH r AS (SELECT conv_id AS client, turn AS arrival, strlen(text) AS n FROM conversations) SELECT client, count(*) AS n_commands, CAST(sum(n) AS BIGINT) AS n_bytes FROM r GROUP BY 1""")
def txn_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transactions: commands and bytes a client."""
    c = table(spark, sf, "conversations")
    return c.groupBy(F.col("conv_id").alias("client")).agg(F.count("*").alias("n_commands"), F.sum(F.octet_length("text").cast("long")).alias("n_bytes"))
