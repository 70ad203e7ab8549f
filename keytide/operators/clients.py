"""Transactions, sessions, asking, locks, waiters and subscriptions as windows over a client log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.functions.slots import glob_column, glob_to_regex
from keytide.operators.commands import DONT_INTERCEPT, UNSUPPORTED, flags_of
from keytide.operators.logops import running_sum


def transactions(log: DataFrame, client: str = "client", order: str = "arrival") -> DataFrame:
    """log (client, arrival, cmd) with txn, role and reply of each command.

    A segment ends at EXEC or DISCARD; within it the first MULTI opens the transaction, so a nested MULTI is an error that
    opens nothing. WATCH inside is an error that poisons nothing; unsupported and pass-through commands poison.
    """
    cmd = F.upper(F.col("cmd"))
    closes = cmd.isin("EXEC", "DISCARD")
    by = W.partitionBy(client).orderBy(order)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    marked = log.withColumn("__seg", F.coalesce(F.sum(closes.cast("int")).over(before), F.lit(0)))
    inside = W.partitionBy(client, "__seg")
    upto = inside.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    opened = marked.withColumn("__open", F.min(F.when(cmd == "MULTI", F.col(order))).over(inside))
    active = F.col("__open").isNotNull() & (F.col(order) > F.col("__open"))
    flags = flags_of(F.col("cmd"))
    bad = active & ~closes & (cmd != "MULTI") & (cmd != "WATCH") & (flags.bitwiseAND(F.lit(UNSUPPORTED | DONT_INTERCEPT)) > 0)
    role = (
        F.when(F.col(order) == F.col("__open"), "begin").when(active & (cmd == "MULTI"), "nested").when(active & (cmd == "WATCH"), "watch")
        .when(active & (cmd == "EXEC"), "exec").when(active & (cmd == "DISCARD"), "discard").when(closes, "stray").when(bad, "poison").when(active, "queued").otherwise("single")
    )
    judged = opened.withColumn("role", role).withColumn("__err", F.coalesce(F.max(bad.cast("int")).over(upto), F.lit(0)))
    reply = (
        F.when(F.col("role") == "begin", "OK").when(F.col("role") == "nested", "ERR nested").when(F.col("role") == "watch", "ERR watch").when(F.col("role") == "poison", "ERR unsupported")
        .when(F.col("role") == "queued", "QUEUED").when((F.col("role") == "exec") & (F.col("__err") == 1), "EXECABORT").when(F.col("role") == "exec", "EXECUTED")
        .when(F.col("role") == "discard", "OK").when(F.col("role") == "stray", "ERR without multi").otherwise("EXECUTED")
    )
    return judged.withColumn("reply", reply).withColumn("txn", F.when(~F.col("role").isin("single", "stray"), F.col("__seg"))).drop("__seg", "__open", "__err")


def entries(judged: DataFrame, client: str = "client", order: str = "arrival") -> DataFrame:
    """(client, txn, n_commands): one log entry per executed transaction, its queued commands and the MULTI itself."""
    done = judged.where("txn is not null").groupBy(client, "txn").agg(
        F.count_if(F.col("role").isin("queued", "begin")).alias("n_commands"), F.max((F.col("reply") == "EXECUTED").cast("int")).alias("ran"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "queued", F.struct(order, "cmd")))).alias("commands"),
    )
    return done.where("ran = 1").drop("ran")


def sessions(log: DataFrame) -> DataFrame:
    """(client, opened, closed) from events (idx, client, event): a WATCH opens; END of the client or any NO_OP closes.

    NO_OP rows hold for all clients: the next one is found by an as-of step over their indexes, so only WATCH and END rows are grouped by client.
    """
    own = log.where(F.col("event").isin("WATCH", "END"))
    barriers = log.where(F.col("event") == "NO_OP").select("idx")
    closes = barriers.select("idx", F.col("idx").alias("config"))
    later = own.select((-F.col("idx")).alias("idx"))
    from keytide.operators.topology import as_of

    next_barrier = as_of(later, closes.select((-F.col("idx")).alias("idx"), "config")).select((-F.col("idx")).alias("idx"), F.col("config").alias("barrier"))
    rows = own.join(next_barrier, "idx", "left")
    ahead = W.partitionBy("client").orderBy("idx").rowsBetween(1, W.unboundedFollowing)
    behind = W.partitionBy("client").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    ends = rows.withColumn("end", F.min(F.when(F.col("event") == "END", F.col("idx"))).over(ahead))
    closed = ends.withColumn("closed", F.least("end", "barrier"))
    # a WATCH inside an open session of the client opens no other
    prior = F.max(F.when(F.col("event") == "WATCH", F.coalesce("closed", F.lit((1 << 63) - 1)))).over(behind)
    return closed.withColumn("__p", prior).where((F.col("event") == "WATCH") & (F.col("__p").isNull() | (F.col("__p") < F.col("idx")))).select("client", F.col("idx").alias("opened"), "closed")


def with_asking(log: DataFrame, client: str = "client", order: str = "arrival") -> DataFrame:
    """log with `asking`: true for the command right after an ASKING of its client."""
    previous = F.lag(F.upper("cmd")).over(W.partitionBy(client).orderBy(order))
    return log.withColumn("asking", F.coalesce(previous == "ASKING", F.lit(False)))


def asking_entries(judged: DataFrame, client: str = "client", order: str = "arrival") -> DataFrame:
    """(client, txn, asking) of transactions (transactions() of a log): an entry asks where one of its commands was sent right after ASKING."""
    sent = with_asking(judged, client, order)
    return sent.where("txn is not null and role in ('begin', 'queued')").groupBy(client, "txn").agg(F.bool_or("asking").alias("asking"))


def lock_intervals(events: DataFrame) -> DataFrame:
    """(key, locked, unlocked) from (idx, key, event LOCK | UNLOCK): from each first LOCK to the next UNLOCK (null: still held)."""
    by = W.partitionBy("key").orderBy("idx")
    changed = events.withColumn("__p", F.lag("event").over(by)).where(F.col("__p").isNull() | (F.col("__p") != F.col("event")))
    spans = changed.withColumn("unlocked", F.lead("idx").over(by))
    return spans.where("event = 'LOCK'").select("key", F.col("idx").alias("locked"), "unlocked")


def held_locks(commands: DataFrame, intervals: DataFrame) -> DataFrame:
    """commands (idx, key) with `locked`: inside an interval of its key. Found by order, not by a range join."""
    starts = intervals.select("key", F.col("locked").alias("idx"), F.lit(1).alias("d"))
    stops = intervals.where("unlocked is not null").select("key", F.col("unlocked").alias("idx"), F.lit(-1).alias("d"))
    marks = starts.unionByName(stops).withColumn("__c", F.lit(0))
    rows = marks.unionByName(commands.select("key", "idx", F.lit(0).alias("d"), F.lit(1).alias("__c")))
    depth = F.sum("d").over(W.partitionBy("key").orderBy("idx", "__c").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("locked", depth > 0).where("__c = 1").select("idx", "key", "locked")


def fifo(waits: DataFrame, pushes: DataFrame) -> DataFrame:
    """(key, waiter, served_by, value): the k-th waiter of a key gets its k-th element; exact while nothing else pops."""
    rank = lambda order: F.row_number().over(W.partitionBy("key").orderBy(order))
    a = waits.select("key", F.col("idx").alias("waiter"), rank("idx").alias("__r"))
    b = pushes.select("key", F.col("idx").alias("served_by"), "value", rank("idx").alias("__r"))
    return a.join(b, ["key", "__r"], "left").select("key", "waiter", "served_by", "value")


def settle_timeouts(waits: DataFrame, events: DataFrame, served: DataFrame) -> DataFrame:
    """waits (idx) with `reply`: value when served before its logged timeout or unblock event, null text or error after it, waiting otherwise."""
    rows = waits.select("idx").join(served.select(F.col("waiter").alias("idx"), "served_by", "value"), "idx", "left").join(events.select(F.col("waits_idx").alias("idx"), F.col("idx").alias("at"), "error"), "idx", "left")
    first = F.col("served_by").isNotNull() & (F.col("at").isNull() | (F.col("served_by") < F.col("at")))
    return rows.select("idx", F.when(first, F.col("value").cast("string")).when(F.col("at").isNull(), "WAITING").when(F.col("error"), "UNBLOCKED").otherwise("NIL").alias("reply"))


def pattern_matches(channels: DataFrame, patterns: DataFrame) -> DataFrame:
    """channels (channel) with each pattern (pattern) that fits.

    Patterns without wild cards meet by equality. The others are grouped by their literal head, up to eight letters,
    and meet the channels' heads of those lengths; only then is the expression tried.
    """
    head = F.regexp_extract("pattern", r"^([^*?\[\\]{0,8})", 1)
    p = patterns.select("pattern", head.alias("h"), F.length(head).alias("n"), glob_column(F.col("pattern")).alias("re"))
    c = channels.select("channel", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(8), F.length("channel"))), lambda k: F.struct(k.alias("n"), F.substring(F.col("channel"), F.lit(1), k).alias("h")))).alias("x")).select("channel", "x.n", "x.h")
    return c.join(p, ["n", "h"]).where(F.rlike("channel", F.col("re"))).select("channel", "pattern")


def subscribers(events: DataFrame, kind: str = "SUBSCRIBE") -> DataFrame:
    """(client, channel) after all (idx, client, event, channel): kind is SUBSCRIBE, PSUBSCRIBE (channel is a pattern) or SSUBSCRIBE.

    Role changes (DROP) end all of them.
    """
    ends = {"SUBSCRIBE": "UNSUBSCRIBE", "PSUBSCRIBE": "PUNSUBSCRIBE", "SSUBSCRIBE": "SUNSUBSCRIBE"}[kind]
    dropped = events.where("event = 'DROP'").agg(F.max("idx").alias("d"))
    live = events.where(F.col("event").isin(kind, ends)).crossJoin(F.broadcast(dropped)).where("d is null or idx > d")
    last = live.groupBy("client", "channel").agg(F.max_by("event", "idx").alias("e"))
    return last.where(F.col("e") == kind).select("client", "channel")


def subscriptions(events: DataFrame, kind: str = "SUBSCRIBE") -> DataFrame:
    """(channel, n): subscribers of each channel after all events, as NUMSUB and SHARDNUMSUB answer."""
    return subscribers(events, kind).groupBy("channel").agg(F.count("*").alias("n"))


def numpat(events: DataFrame) -> DataFrame:
    """(n): distinct patterns that someone is subscribed to."""
    return subscribers(events, "PSUBSCRIBE").agg(F.count_distinct("channel").alias("n"))


def channels(events: DataFrame, pattern: str, kind: str = "SUBSCRIBE") -> DataFrame:
    """(channel) with a subscriber that fits a glob, as CHANNELS and SHARDCHANNELS answer."""
    return subscribers(events, kind).select("channel").distinct().where(F.col("channel").rlike(glob_to_regex(pattern)))


def publish(messages: DataFrame, events: DataFrame, shard: bool = False) -> DataFrame:
    """messages (channel, ...) with `receivers`: subscribers of the channel and, for each of its patterns, of that pattern; a shard message has no patterns."""
    if shard:
        counts = subscriptions(events, "SSUBSCRIBE").select("channel", F.col("n").alias("receivers"))
    else:
        exact = subscriptions(events).select("channel", F.col("n"))
        by_pattern = subscriptions(events, "PSUBSCRIBE").select(F.col("channel").alias("pattern"), "n")
        fits = pattern_matches(messages.select("channel").distinct(), by_pattern.select("pattern"))
        counts = exact.unionByName(fits.join(by_pattern, "pattern").select("channel", "n")).groupBy("channel").agg(F.sum("n").alias("receivers"))
    return messages.join(counts, "channel", "left").select(*messages.columns, F.coalesce("receivers", F.lit(0)).cast("long").alias("receivers"))


def subscription_counts(events: DataFrame) -> DataFrame:
    """events (idx, client, event, channel) of SUBSCRIBE and UNSUBSCRIBE with `count`: how many channels the client has after each, as its replies say."""
    by = W.partitionBy("client", "channel").orderBy("idx")
    change = F.when(F.col("event") == F.coalesce(F.lag("event").over(by), F.lit("UNSUBSCRIBE")), 0).when(F.col("event") == "SUBSCRIBE", 1).otherwise(-1)
    return running_sum(events.withColumn("__d", change), F.col("__d"), "count", keys=("client",)).drop("__d")


def open_sessions(intervals: DataFrame, at: int) -> DataFrame:
    """(n): distinct clients with a session (client, opened, closed) that is open after an entry."""
    return intervals.where((F.col("opened") <= at) & (F.col("closed").isNull() | (F.col("closed") > at))).agg(F.count_distinct("client").alias("n"))


def unwatched(log: DataFrame) -> DataFrame:
    """(client, watches): keys that each client still watches at the end; UNWATCH, EXEC and DISCARD forget them all."""
    rows = log.where(F.col("cmd").isin("WATCH", "UNWATCH", "EXEC", "DISCARD"))
    last = rows.groupBy("client").agg(F.max(F.when(F.col("cmd") != "WATCH", F.col("idx"))).alias("__l"))
    left = rows.where("cmd = 'WATCH'").join(last, "client").where("__l is null or idx > __l")
    return left.groupBy("client").agg(F.count_distinct("key").alias("watches"))


def serve_sorted(waits: DataFrame, members: DataFrame, largest: bool = False) -> DataFrame:
    """(key, waiter, member, score): clients that wait (key, idx) for a sorted set that comes at once (key, member, score) get its members from one end.

    The k-th waiter of a key gets the k-th smallest or largest member, ties by the member's bytes; others wait on.
    """
    order = [F.desc("score"), F.desc("member")] if largest else ["score", "member"]
    a = waits.select("key", F.col("idx").alias("waiter"), F.row_number().over(W.partitionBy("key").orderBy("idx")).alias("__r"))
    b = members.select("key", "member", "score", F.row_number().over(W.partitionBy("key").orderBy(*order)).alias("__r"))
    return a.join(b, ["key", "__r"], "left").select("key", "waiter", "member", "score")


def cancel(waits: DataFrame, terms: DataFrame, served: DataFrame) -> DataFrame:
    """waits (idx) with `reply`: CANCELLED where a new term (terms: idx) begins before the waiter is served (served: waiter, served_by, value)."""
    from keytide.operators.topology import as_of

    later = as_of(waits.select((-F.col("idx")).alias("idx")), terms.select((-F.col("idx")).alias("idx"), F.col("idx").alias("config")))
    next_term = later.select((-F.col("idx")).alias("idx"), F.col("config").alias("__t"))
    rows = waits.select("idx").join(next_term, "idx").join(served.select(F.col("waiter").alias("idx"), "served_by", "value"), "idx", "left")
    ended = F.col("__t").isNotNull() & (F.col("served_by").isNull() | (F.col("served_by") > F.col("__t")))
    return rows.select("idx", F.when(ended, "CANCELLED").when(F.col("served_by").isNull(), "WAITING").otherwise(F.col("value").cast("string")).alias("reply"))
