"""Moving keys between shard groups: parse, lock, dump, import, delete and unlock, as joins over keyspace, slots and locks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.operators.topology import fence

#: Fixed value: the longest name or password of a MIGRATE command.
MOST_AUTH = 255
STEPS = ("LOCK", "DUMP", "IMPORT", "DELETE_UNLOCK")


def parse_migrate(argv: Column) -> Column:
    """Struct (keys, username, password, error) of MIGRATE host port "" db timeout [AUTH2 name password] KEYS key ...; options begin at the seventh word."""
    upper = F.transform(argv, lambda x, i: F.when(i >= 6, F.upper(x)))
    auth, listed = F.array_position(upper, F.lit("AUTH2")), F.array_position(upper, F.lit("KEYS"))
    name, password = F.get(argv, auth), F.get(argv, auth + 1)
    given = auth > 0
    error = (
        F.when(F.size(argv) < 8, "wrong number of arguments").when(given & (auth + 2 > F.size(argv)), "no username or password")
        .when(given & (F.octet_length(name) > MOST_AUTH), "username too long").when(given & (F.octet_length(password) > MOST_AUTH), "password too long")
        .when(F.get(argv, 3) != "", "single keys aren't migrated").when((listed == 0) | (listed >= F.size(argv)), "no keys")
    )
    keys = F.slice(argv, F.greatest(listed + 1, F.lit(1)).cast("int"), F.greatest(F.size(argv) - listed, F.lit(0)).cast("int"))
    return F.struct(
        F.when(error.isNull(), keys).alias("keys"), F.when(error.isNull(), F.when(given, name).otherwise("default")).alias("username"),
        F.when(error.isNull(), F.when(given, password).otherwise("")).alias("password"), error.alias("error"),
    )


def lock_outcomes(keys: DataFrame, slot_owners: DataFrame, by: str = "idx") -> DataFrame:
    """(by, slot, outcome) of lock requests (by, key, slot): OK, or why the keys of one can't be locked; the slot map is broadcast."""
    g = keys.groupBy(by).agg(F.min("slot").alias("slot"), F.max("slot").alias("__high"))
    placed = g.join(F.broadcast(slot_owners), "slot", "left")
    outcome = (
        F.when(F.col("slot") != F.col("__high"), "CROSSSLOT").when(F.col("migrating").isNull(), "ERR not migratable").when(~F.col("migrating.local"), "ERR not owned")
        .when(F.col("importing").isNull(), "ERR no importing group").when(F.col("importing.local"), "ERR importing into itself").otherwise("OK")
    )
    return placed.select(by, "slot", outcome.alias("outcome"))


def lock_keys(keys: DataFrame, keyspace: DataFrame, outcomes: DataFrame | None = None, by: str = "idx") -> DataFrame:
    """(by, key): keys of accepted requests that exist; others aren't locked."""
    asked = keys.select(by, "key").distinct()
    if outcomes is not None:
        asked = asked.join(outcomes.where("outcome = 'OK'"), by, "left_semi")
    return asked.join(keyspace, "key", "left_semi").select(by, "key")


def dump(kind: Column, value: Column) -> Column:
    """A payload: type, line feed, value, line feed and the CRC-32 of what is before it, as bytes."""
    body = F.concat(F.encode(kind, "UTF-8"), F.lit(b"\n"), F.encode(value, "UTF-8"), F.lit(b"\n"))
    return F.concat(body, F.encode(F.lpad(F.hex(F.crc32(body)), 8, "0"), "UTF-8"))


def restore(payload: Column) -> Column:
    """Struct (type, value) of a payload; null where it is damaged."""
    n = F.octet_length(payload)
    body = F.substring(payload, F.lit(1), n - 8)
    text = F.decode(body, "UTF-8")
    good = (n > 9) & (F.decode(F.substring(payload, n - 7, F.lit(8)), "UTF-8") == F.lpad(F.hex(F.crc32(body)), 8, "0"))
    cut = F.locate("\n", text)
    return F.when(good, F.struct(F.substring(text, F.lit(1), cut - 1).alias("type"), F.substring(text, cut + 1, F.length(text) - cut - 1).alias("value")))


def export(keyspace: DataFrame, locked: DataFrame) -> DataFrame:
    """(key, payload) of the locked keys of a keyspace (key, type, value)."""
    return keyspace.join(locked.select("key").distinct(), "key", "left_semi").select("key", dump(F.col("type"), F.col("value")).alias("payload"))


def restored(state: DataFrame, given: DataFrame) -> DataFrame:
    """given (key, payload, replace) with `reply`: OK, BUSYKEY where the key is there and isn't to be replaced, or an error for a damaged payload."""
    there = state.select("key").distinct().withColumn("__t", F.lit(True))
    reply = F.when(restore(F.col("payload")).isNull(), "ERR bad payload").when(F.col("__t") & ~F.col("replace"), "BUSYKEY").otherwise("OK")
    return given.join(there, "key", "left").select(*given.columns, reply.alias("reply"))


def import_keys(state: DataFrame, imports: DataFrame, restarts: DataFrame | None = None) -> DataFrame:
    """state (key, type, value, expire_at) after imports (idx, pos, slot, term, session_key, importing, slot_session, key, payload).

    An entry is judged by the slot of its first key alone; keys of accepted entries replace what is there and don't expire;
    the last entry that brings a key wins.
    """
    first = imports.where("pos = 0")
    ok = fence(first, restarts).where("status = 'ok'").select("idx")
    brought = imports.join(ok, "idx", "left_semi").groupBy("key").agg(F.max_by("payload", F.struct("idx", "pos")).alias("payload"))
    new = brought.select("key", restore(F.col("payload")).alias("r")).where("r is not null").select("key", "r.type", "r.value", F.lit(None).cast("long").alias("expire_at"))
    return state.join(new.select("key"), "key", "left_anti").select("key", "type", "value", "expire_at").unionByName(new)


def delete_unlock(keyspace: DataFrame, locks: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keyspace and locks without the keys that were moved."""
    gone = moved.select("key").distinct()
    return keyspace.join(gone, "key", "left_anti"), locks.join(gone, "key", "left_anti")


def pipeline_steps(events: DataFrame) -> DataFrame:
    """events (idx, key, step) with `state` after each: a key goes through LOCK, DUMP, IMPORT, DELETE_UNLOCK in this order.

    A step that doesn't follow the step before it is refused and leaves a key as it is; LOCK begins anew. A key whose import failed
    (step FAILED) stays as it was. Keys are independent, so windows by key and run are enough.
    """
    by = W.partitionBy("key").orderBy("idx")
    rows = events.withColumn("__run", F.count_if(F.col("step") == "LOCK").over(by))
    run = W.partitionBy("key", "__run")
    state, before, reached = F.when(F.col("__run") == 0, "FREE"), F.lit(-1), []
    for k, name in enumerate(STEPS[1:]):
        # the first such step of the run that comes after the step before it
        rows = rows.withColumn(f"__{k}", F.min(F.when((F.col("step") == name) & (F.col("idx") > before), F.col("idx"))).over(run))
        before = F.col(f"__{k}")
        reached.append(before)
    for at, name in zip(reversed(reached), ("MOVED", "IMPORTED", "DUMPED")):
        state = state.when(F.col("idx") >= at, name)
    return rows.select("idx", "key", "step", state.otherwise("LOCKED").alias("state"))
