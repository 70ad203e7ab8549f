"""Scripts and functions as registered column expressions, and who may run what.

A script is text; its name is its SHA-1. What a script does is given by a library that maps texts or function names to
column expressions over the call's keys and arguments: built-in expressions only, so that a replay gives the same results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.functions.slots import glob_column
from keytide.operators.logops import last_before


@dataclass(frozen=True)
class Script:
    """What a script or function does with (keys, argv), and whether it writes."""

    run: Callable[[Column, Column], Column]
    writes: bool = False


def sha1(body: Column) -> Column:
    return F.sha1(F.encode(body, "UTF-8"))


def resolve(calls: DataFrame) -> DataFrame:
    """calls (idx, cmd, script) of EVAL, EVALSHA, EVAL_RO, EVALSHA_RO, SCRIPT LOAD and SCRIPT FLUSH with (sha, known).

    A body given to EVAL or SCRIPT LOAD is known from then on, to the next FLUSH; a name that isn't known is NOSCRIPT. Flushes and
    first loads are found by order, in two levels.
    """
    cmd = F.upper("cmd")
    own = cmd.isin("EVAL", "EVAL_RO", "SCRIPT LOAD")
    named = calls.withColumn("sha", F.when(own, sha1(F.col("script"))).when(cmd != "SCRIPT FLUSH", F.lower("script")))
    flushed = last_before(named, cmd == "SCRIPT FLUSH", F.col("idx"), "__flush")
    loaded = last_before(flushed, own, F.col("idx"), "__load", keys=("sha",))
    known = own | (F.col("__load").isNotNull() & (F.col("__flush").isNull() | (F.col("__load") > F.col("__flush"))))
    return loaded.where(cmd != "SCRIPT FLUSH").select(*calls.columns, "sha", F.coalesce(known, F.lit(False)).alias("known"))


def exists(names: DataFrame, calls: DataFrame) -> DataFrame:
    """names (sha) with `here`: whether the script is known after all calls, as SCRIPT EXISTS answers."""
    last = calls.where(F.upper("cmd") == "SCRIPT FLUSH").agg(F.max("idx").alias("__f"))
    loads = calls.where(F.upper("cmd").isin("EVAL", "EVAL_RO", "SCRIPT LOAD")).crossJoin(F.broadcast(last)).where("__f is null or idx > __f")
    held = loads.select(sha1(F.col("script")).alias("sha")).distinct().withColumn("__h", F.lit(1))
    return names.join(held, "sha", "left").select("sha", F.coalesce("__h", F.lit(0)).alias("here"))


def evaluate(calls: DataFrame, library: dict[str, Script], name: Column, read_only: Column, known: Column | None = None) -> DataFrame:
    """calls (idx, keys, argv) with `reply`: the result of the script or function called name, or an error.

    A script that writes is refused in a read-only call; array results are sorted, as they are for a replay.
    """
    reply = F.when(~known, "NOSCRIPT") if known is not None else F.when(F.lit(False), F.lit(None))
    for key, script in library.items():
        out = script.run(F.col("keys"), F.col("argv"))
        if script.writes:
            reply = reply.when((name == key) & read_only, "ERR Write commands are not allowed from read-only scripts")
        reply = reply.when(name == key, out.cast("string"))
    return calls.withColumn("reply", reply.otherwise("ERR Function not found"))


def functions_as_of(entries: DataFrame, at: int) -> DataFrame:
    """(name, library): functions in force after entries (idx, kind LOAD | DELETE | FLUSH, library, names) up to an index; a library is replaced as a whole."""
    upto = entries.where(F.col("idx") <= at)
    last = upto.where("kind = 'FLUSH'").agg(F.max("idx").alias("__f"))
    live = upto.where("kind <> 'FLUSH'").crossJoin(F.broadcast(last)).where("__f is null or idx > __f")
    held = live.groupBy("library").agg(F.max_by(F.struct("kind", "names"), "idx").alias("l"))
    return held.where("l.kind = 'LOAD'").select(F.explode("l.names").alias("name"), "library")


def permitted(commands: DataFrame, rules: DataFrame) -> DataFrame:
    """commands (idx, user, cmd, key) with `allowed`: whether a rule (user, cmd or *, pattern) of the user fits command and key.

    The user is the one that was captured when the entry was appended, so a rule that changes later doesn't reach it. Rules are joined by user.
    """
    r = rules.select(F.col("user").alias("__u"), F.lower("cmd").alias("__c"), glob_column(F.col("pattern")).alias("__re"))
    fits = ((F.col("__c") == "*") | (F.col("__c") == F.lower("cmd"))) & F.rlike("key", F.col("__re"))
    joined = commands.join(r, F.col("user") == F.col("__u"), "left")
    return joined.groupBy(*commands.columns).agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias("allowed"))


def dry_run(judged: DataFrame) -> DataFrame:
    """(client, txn, allowed) of transactions (client, txn, allowed a command): one refused command refuses all."""
    return judged.groupBy("client", "txn").agg(F.bool_and("allowed").alias("allowed"))
