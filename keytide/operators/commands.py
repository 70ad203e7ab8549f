"""The command catalogue, its flags, and how commands are classified and routed to the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Command flags, as bits.
READONLY, WRITE, UNSUPPORTED, DONT_INTERCEPT, SORT_REPLY, RANDOM, SCRIPTS, BLOCKING, MULTI, SUBCOMMAND = (1 << k for k in range(1, 11))

#: Which commands have which flags.
FLAG_GROUPS = (
    (UNSUPPORTED, "sync psync reset bgrewriteaof slaveof replicaof debug save bgsave xrange xrevrange xlen xread xreadgroup xgroup xsetid xinfo xdel"),
    (UNSUPPORTED | RANDOM, "xadd xack xpending xclaim xautoclaim xtrim"),
    (DONT_INTERCEPT | RANDOM, "time"),
    (DONT_INTERCEPT, "unsubscribe sunsubscribe punsubscribe auth ping hello module config monitor command shutdown quit slowlog acl"),
    (SUBCOMMAND | DONT_INTERCEPT, "client"),
    (SCRIPTS, "eval evalsha eval_ro evalsha_ro fcall fcall_ro"),
    (WRITE | BLOCKING, "brpop brpoplpush blmove blpop blmpop bzpopmin bzpopmax bzmpop"),
    (READONLY, "publish spublish pubsub"),
    (MULTI, "multi"),
    (READONLY, "get mget getrange strlen bitcount getbit exists hexists hget hgetall hlen hmget hstrlen lindex llen lrange scard sismember zcard zcount zlexcount"),
    (READONLY, "zrange zrangebylex zrangebyscore zrank zrevrange zrevrangebylex zrevrangebyscore zrevrank zscore ttl pttl type touch pfcount geodist geohash geopos"),
    (READONLY | SORT_REPLY, "keys hkeys hvals sdiff sinter sunion smembers"),
    (READONLY | RANDOM, "randomkey srandmember scan hscan sscan zscan"),
    (WRITE | RANDOM, "spop"),
    (WRITE, "append bitfield bitop decr decrby del expire expireat geoadd georadius georadiusbymember getset hdel hincrby hincrbyfloat hmset hset hsetnx"),
    (WRITE, "incr incrby incrbyfloat linsert lpop lpush lpushx lrem lset ltrim mset msetnx persist pexpire pexpireat pfadd pfmerge psetex"),
    (WRITE, "rename renamenx rpop rpoplpush rpush rpushx sadd sdiffstore set setbit setex setnx setrange sinterstore smove sort srem sunionstore unlink"),
    (WRITE, "zadd zincrby zinterstore zpopmax zpopmin zrem zremrangebylex zremrangebyrank zremrangebyscore zunionstore restore dump migrate"),
)


def catalogue(ignored: str = "") -> dict[str, int]:
    """Flags by lower-case command name; ignored is a comma list of commands that are passed through."""
    found = {name: flags for flags, names in FLAG_GROUPS for name in names.split()}
    for name in filter(None, (x.strip().lower() for x in ignored.split(","))):
        found[name] = found.get(name, 0) | DONT_INTERCEPT
    return found


def catalogue_table(spark: SparkSession, ignored: str = "") -> DataFrame:
    return spark.createDataFrame(sorted(catalogue(ignored).items()), "cmd string, flags int")


def flags_of(cmd: Column, ignored: str = "", default: int = WRITE) -> Column:
    """Flags of a command name in any case; unknown commands count as writes. A literal map of fixed size."""
    table = F.create_map(*[F.lit(x) for item in sorted(catalogue(ignored).items()) for x in item])
    return F.coalesce(F.try_element_at(table, F.lower(cmd)), F.lit(default))


def array_flags(log: DataFrame, idx: str = "idx", cmd: str = "cmd", ignored: str = "") -> DataFrame:
    """(idx, flags): the flags of all commands of an entry, or-ed."""
    return log.groupBy(idx).agg(F.bit_or(flags_of(F.col(cmd), ignored)).alias("flags"))


def route(cmd: Column, in_script: Column | None = None, may_subscribe: Column | None = None) -> Column:
    """Where a command goes: pass, log, read, reject, subscribe, sort_reply or reject_random."""
    flags = flags_of(cmd)
    has = lambda bit: flags.bitwiseAND(F.lit(bit)) > 0
    scripted = in_script if in_script is not None else F.lit(False)
    may = may_subscribe if may_subscribe is not None else F.lit(True)
    return (
        F.when(scripted & has(SORT_REPLY), "sort_reply").when(scripted & has(RANDOM), "reject_random").when(scripted, "pass")
        .when(has(DONT_INTERCEPT), "pass")
        .when(F.lower(cmd).isin("subscribe", "ssubscribe", "psubscribe"), F.when(may, "subscribe").otherwise("reject"))
        .when(has(UNSUPPORTED), "reject").when(has(READONLY) & ~has(WRITE), "read").otherwise("log")
    )


def timeout_ms(argv: Column) -> Column:
    """Timeout of a blocking command in milliseconds, rounded up: the argument after the name for blmpop and bzmpop, else the last; null if it isn't a number from 0 on."""
    given = F.when(F.lower(F.get(argv, F.lit(0))).isin("blmpop", "bzmpop"), F.get(argv, F.lit(1))).otherwise(F.element_at(argv, -1)).try_cast("double")
    return F.when(given >= 0, F.ceil(given * 1000)).cast("long")


def without_timeout(argv: Column) -> Column:
    """The argument vector with its timeout replaced by 0."""
    at = F.when(F.lower(F.get(argv, F.lit(0))).isin("blmpop", "bzmpop"), F.lit(1)).otherwise(F.size(argv) - 1)
    return F.transform(argv, lambda x, i: F.when(i == at, F.lit("0")).otherwise(x))


def sorted_reply(values: Column) -> Column:
    """An array reply in byte order, repeats kept."""
    return F.array_sort(values)


def sorted_map_reply(reply: Column) -> Column:
    """A map reply as pairs in byte order of their keys."""
    return F.array_sort(F.map_entries(reply))


def checked_sort(cmd: Column, reply: Column) -> Column:
    """Struct (reply, error): an array reply of a command whose replies are sorted, in byte order; an error for other commands."""
    may = flags_of(cmd).bitwiseAND(F.lit(SORT_REPLY)) > 0
    return F.struct(F.when(may, sorted_reply(reply)).alias("reply"), F.when(~may, "ERR reply isn't sorted").alias("error"))


def moved_array(into: Column, taken: Column) -> Column:
    """A command array (asking, cmd_flags, acl, commands) with the commands of another at its end: flags and asking are or-ed, the access list is the other's."""
    return F.struct(
        (into["asking"] | taken["asking"]).alias("asking"), into["cmd_flags"].bitwiseOR(taken["cmd_flags"]).alias("cmd_flags"), taken["acl"].alias("acl"), F.concat(into["commands"], taken["commands"]).alias("commands"),
    )


def resp(reply: Column, kind) -> Column:
    """A nested reply as protocol text: * arrays, : integers, $ strings, $-1 for none; kind is the column's type."""
    from pyspark.sql import types as T

    end = F.lit("\r\n")
    if isinstance(kind, T.ArrayType):
        items = F.array_join(F.transform(reply, lambda x: resp(x, kind.elementType)), "")
        out = F.concat(F.lit("*"), F.size(reply).cast("string"), end, items)
    elif isinstance(kind, T.StructType):
        out = F.concat(F.lit(f"*{len(kind.fields)}\r\n"), *[resp(reply[f.name], f.dataType) for f in kind.fields])
    elif isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)):
        out = F.concat(F.lit(":"), reply.cast("string"), end)
    else:
        text = reply.cast("string")
        out = F.concat(F.lit("$"), F.octet_length(text).cast("string"), end, text, end)
    return F.coalesce(out, F.lit("$-1\r\n"))


def reloaded(base: DataFrame, changes: DataFrame) -> DataFrame:
    """A catalogue (cmd, flags) after modules came and went: changes (idx, cmd, flags; null flags: removed); the last change of a command counts."""
    last = changes.groupBy(F.lower("cmd").alias("cmd")).agg(F.max_by(F.struct("flags"), "idx").alias("c"))
    return base.join(last, "cmd", "left_anti").select("cmd", "flags").unionByName(last.where("c.flags is not null").select("cmd", "c.flags"))
