"""Folding a command log into typed state tables.

A log has a row per change: idx (unique, ascending), key, cmd, field, value (string) and num (long). Spark has no
ordered fold, so each state is found from what survives: the last barrier of a key is a pre-aggregated maximum,
changes before it are dropped by a join on the key and a bucket of the log, and the rest is an aggregate that combines before its
shuffle (last write by max_by, deltas by sum). Positions and replies are running sums in two levels. So a hot key's rows
meet in one task only by buckets; a string that is appended to is one value, as long as its input. State-dependent commands go to keytide.operators.orderedfold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.operators.logops import AT, BUCKET, bucketed, last_before, running_sum

DELETES = ("DEL", "UNLINK")


def after_last(changes: DataFrame, keys: list[str], barrier: Column, inclusive: bool = False, width: int = BUCKET) -> DataFrame:
    """Changes after the last barrier of their keys (with inclusive, the barrier too).

    The barrier goes to a row a key and bucket, and from there to the changes, so a hot key's changes are joined bucket by bucket.
    """
    rows = bucketed(changes, "idx", tuple(keys), width)
    ends = rows.groupBy(*AT).agg(F.max(F.when(barrier, F.col("idx"))).alias("__l")).withColumn("__last", F.max("__l").over(W.partitionBy("__k"))).drop("__l")
    kept = F.col("__last").isNull() | ((F.col("idx") >= F.col("__last")) if inclusive else (F.col("idx") > F.col("__last")))
    return rows.join(ends, AT).where(kept).drop(*AT, "__last")


def step(cmd: Column, num: Column) -> Column:
    """What a counter command adds; for SET the number itself."""
    return F.when(cmd == "INCR", 1).when(cmd == "DECR", -1).when(cmd == "DECRBY", -num).otherwise(num)


class Keyspace:
    """State of a log as of an index; every method is a lazy DataFrame."""

    def __init__(self, log: DataFrame) -> None:
        self.log = log

    @classmethod
    def from_log(cls, log: DataFrame) -> Keyspace:
        return cls(log)

    def as_of(self, idx: int) -> Keyspace:
        """The state after the entry idx; the bound reaches the scan of the log."""
        return Keyspace(self.log.where(F.col("idx") <= idx))

    def _of(self, *cmds: str) -> DataFrame:
        return self.log.where(F.col("cmd").isin(*cmds, *DELETES))

    def _live(self, *cmds: str) -> DataFrame:
        return after_last(self._of(*cmds), ["key"], F.col("cmd").isin(*DELETES))

    def strings(self) -> DataFrame:
        """(key, value): the last SET since the last delete, with later APPENDs in order."""
        live = after_last(self._live("SET", "MSET", "GETSET", "APPEND"), ["key"], F.col("cmd") != "APPEND", inclusive=True)
        return live.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]), "").alias("value"))

    def counters(self) -> DataFrame:
        """(key, value): the last SET plus later INCRs and DECRs; a deleted key without later changes is absent."""
        live = after_last(self._live("SET", "INCR", "INCRBY", "DECR", "DECRBY"), ["key"], F.col("cmd") == "SET", inclusive=True)
        return live.groupBy("key").agg(F.sum(step(F.col("cmd"), F.col("num"))).alias("value"))

    def hashes(self) -> DataFrame:
        """(key, field, value): the last write of each field, fields removed by HDEL left out."""
        live = self._live("HSET", "HMSET", "HDEL")
        last = live.groupBy("key", "field").agg(F.max_by(F.struct("cmd", "value"), "idx").alias("w"))
        return last.where(F.col("w.cmd") != "HDEL").select("key", "field", "w.value")

    def hash_counters(self) -> DataFrame:
        """(key, field, value) of HINCRBY since the last HSET or HDEL of the field, its number included."""
        live = self._live("HSET", "HINCRBY", "HDEL")
        rest = after_last(live, ["key", "field"], F.col("cmd") != "HINCRBY", inclusive=True)
        return rest.where(F.col("cmd") != "HDEL").groupBy("key", "field").agg(F.sum("num").alias("value"))

    def sets(self) -> DataFrame:
        """(key, member): members whose last change is SADD."""
        last = self._live("SADD", "SREM").groupBy("key", "field").agg(F.max_by("cmd", "idx").alias("w"))
        return last.where(F.col("w") == "SADD").select("key", F.col("field").alias("member"))

    def zsets(self) -> DataFrame:
        """(key, member, score): the last ZADD of a member plus later ZINCRBYs."""
        live = self._live("ZADD", "ZINCRBY", "ZREM")
        rest = after_last(live, ["key", "field"], F.col("cmd") != "ZINCRBY", inclusive=True)
        return rest.where(F.col("cmd") != "ZREM").groupBy("key", "field").agg(F.sum("num").alias("score")).withColumnRenamed("field", "member")

    def lists(self) -> DataFrame:
        """(key, pos, value): RPUSH to the end, LPUSH to the head, positions from 0."""
        left = F.col("cmd") == "LPUSH"
        counted = running_sum(self._live("RPUSH", "LPUSH"), F.when(left, 1).otherwise(0), "__l", keys=("key",), total="__heads")
        counted = running_sum(counted, F.when(left, 0).otherwise(1), "__r", keys=("key",))
        pos = F.when(left, F.col("__heads") - F.col("__l")).otherwise(F.col("__heads") + F.col("__r") - 1)
        return counted.select("key", pos.cast("int").alias("pos"), "value")

    def keys(self, writes: tuple[str, ...] = ("SET",)) -> DataFrame:
        """(key, since): keys that exist, and the first write after their last delete."""
        return self._live(*writes).groupBy("key").agg(F.min("idx").alias("since"))

    def expiries(self, writes: tuple[str, ...] = ("SET",)) -> DataFrame:
        """(key, expire_at) of keys that exist: null where they don't expire.

        num is the time itself, whatever command gave it (see due()); a command on a key that isn't there does nothing, a SET forgets
        the time, PERSIST removes it.
        """
        sets = ("EXPIREAT", "PEXPIREAT", "EXPIRE", "PEXPIRE", "PERSIST")
        live = self._live(*writes, *sets)
        held = live.join(self.keys(writes), "key").where("idx >= since")
        last = held.groupBy("key").agg(F.max_by(F.struct("cmd", "num"), "idx").alias("w"))
        return last.select("key", F.when(F.col("w.cmd").isin(*sets[:-1]), F.col("w.num")).alias("expire_at"))

    def ttl(self, at: int, writes: tuple[str, ...] = ("SET",)) -> DataFrame:
        """(key, ttl) of every key of the log: what is left at a time, -1 without expiry, -2 where the key isn't there or has expired."""
        known = self.log.select("key").distinct().join(self.expiries(writes).withColumn("here", F.lit(True)), "key", "left")
        left = F.when(F.col("here").isNull(), -2).when(F.col("expire_at").isNull(), -1).when(F.col("expire_at") > at, F.col("expire_at") - at).otherwise(-2)
        return known.select("key", left.cast("long").alias("ttl"))


def history(log: DataFrame, cmds: tuple[str, ...] = ("SET", "GETSET")) -> DataFrame:
    """(idx, key, value, previous): what GETSET replies, the value before; null after a delete."""
    changes = log.where(F.col("cmd").isin(*cmds, *DELETES))
    gone = F.col("cmd").isin(*DELETES)
    seen = last_before(changes, F.lit(True), F.when(~gone, F.col("value")), "previous", keys=("key",))
    return seen.where(~gone).select("idx", "key", "value", "previous")


def running_counter(log: DataFrame) -> DataFrame:
    """(idx, key, reply): the reply of each INCR or DECR: the last SET or delete before it, plus the changes since."""
    cmd = F.col("cmd")
    barrier = cmd.isin("SET", *DELETES)
    changes = log.where(cmd.isin("SET", "INCR", "INCRBY", "DECR", "DECRBY", *DELETES))
    summed = running_sum(changes, F.when(barrier, 0).otherwise(step(cmd, F.col("num"))), "__sum", keys=("key",))
    base = F.struct((F.when(cmd == "SET", F.col("num")).otherwise(0) - F.col("__sum")).alias("from"))
    found = last_before(summed, barrier, base, "__base", keys=("key",)).where(~barrier)
    return found.select("idx", "key", (F.col("__sum") + F.coalesce("__base.from", F.lit(0))).alias("reply"))


def first_writes(log: DataFrame) -> DataFrame:
    """(key, value): the first SETNX since the last delete wins."""
    live = after_last(log.where(F.col("cmd").isin("SETNX", *DELETES)), ["key"], F.col("cmd").isin(*DELETES))
    return live.groupBy("key").agg(F.min_by("value", "idx").alias("value"))


def first_fields(log: DataFrame) -> DataFrame:
    """(key, field, value): the first HSETNX of a field since the last delete of its key wins."""
    live = after_last(log.where(F.col("cmd").isin("HSETNX", *DELETES)), ["key"], F.col("cmd").isin(*DELETES))
    return live.groupBy("key", "field").agg(F.min_by("value", "idx").alias("value"))


def slice_bounds(n: Column, start: int, stop: int) -> tuple[Column, Column]:
    """First and last position of start..stop, both in, negative from the end, for n items."""
    low = F.greatest(F.lit(0), n + start) if start < 0 else F.lit(start)
    high = (n + stop) if stop < 0 else F.lit(stop)
    return low, high


def lrange(lists: DataFrame, start: int, stop: int, key: str = "key", pos: str = "pos") -> DataFrame:
    """Items at start..stop of each list, by the list's length; the length is a pre-aggregated count joined back."""
    n = lists.groupBy(key).agg(F.count("*").alias("__n"))
    low, high = slice_bounds(F.col("__n"), start, stop)
    return lists.join(n, key).where((F.col(pos) >= low) & (F.col(pos) <= high)).drop("__n")


def due(cmd: Column, num: Column, now: Column) -> Column:
    """The time in milliseconds that an expiry command sets: seconds or milliseconds, from the epoch or from now (in milliseconds)."""
    return (
        F.when(cmd == "EXPIRE", now + num * 1000).when(cmd == "PEXPIRE", now + num).when(cmd == "EXPIREAT", num * 1000).when(cmd == "PEXPIREAT", num)
        .when(cmd == "SETEX", now + num * 1000).when(cmd == "PSETEX", now + num)
    )
