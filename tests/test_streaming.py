from keytide.operators import orderedfold
from keytide.operators.keyspace import Keyspace
from keytide.streaming import tail


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_counters_equal_the_batch(spark, tmp_path):
    rows = [(i, f"k{i % 4}", ("SET", "INCRBY", "INCRBY", "DEL", "INCRBY")[i * 7 % 5], None, None, i) for i in range(200)]
    log = spark.createDataFrame(rows, "idx long, key string, cmd string, field string, value string, num long")
    for k in range(4):
        log.where(f"idx >= {k * 50} and idx < {k * 50 + 50}").coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    out = run(spark, tail.counters(stream), "counters_stream", "update")
    last = {}
    for r in sorted(out, key=lambda r: r.idx):
        last[r.key] = r.value
    want = {r.key: r.value for r in Keyspace(log).counters().collect()}
    assert {k: v for k, v in last.items() if v is not None} == want


def test_waiters(spark, tmp_path):
    rows = [("x", 0, "WAIT", None, None), ("x", 1, "WAIT", None, None), ("x", 2, "PUSH", None, "1"), ("x", 3, "PUSH", None, "2"), ("x", 4, "PUSH", None, "3"), ("y", 5, "WAIT", None, None), ("y", 6, "TIMEOUT", 5, None), ("y", 7, "PUSH", None, "9")]
    df = spark.createDataFrame(rows, "key string, idx long, event string, ref long, value string")
    df.coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path))
    out = run(spark, tail.waiters(stream), "waiters_stream", "append")
    assert sorted((r.key, r.waiter, r.value) for r in out) == [("x", 0, "1"), ("x", 1, "2"), ("y", 5, None)]


def test_applied_once(spark):
    df = spark.range(10).withColumnRenamed("id", "idx")
    assert tail.apply_once(df, 6).count() == 3


def test_counters_leave_other_commands_out(spark, tmp_path):
    rows = [(i, "k", c, None, None, 5) for i, c in enumerate(("SET", "DECRBY", "HINCRBY", "RPUSH", "INCR", "DECR", "DECR"))]
    log = spark.createDataFrame(rows, "idx long, key string, cmd string, field string, value string, num long")
    log.coalesce(1).write.mode("append").parquet(str(tmp_path))
    out = run(spark, tail.counters(spark.readStream.schema(log.schema).parquet(str(tmp_path))), "mixed_stream", "update")
    assert [r.value for r in out] == [-1] == [r.value for r in Keyspace(log).counters().collect()]


def test_state_is_applied_once(spark, tmp_path):
    rows = [(i, f"k{i % 3}", ("SET", "INCRBY", "INCRBY", "DEL", "INCRBY")[i * 7 % 5], None, None, i) for i in range(90)]
    log = spark.createDataFrame(rows, "idx long, key string, cmd string, field string, value string, num long")
    source, state = str(tmp_path / "log"), str(tmp_path / "state")
    from keytide.sources import snapshot

    for k, checkpoint in enumerate(("a", "a", "b")):
        # the third run has lost its checkpoint, and sees every entry again
        log.where(f"idx >= {k * 30} and idx < {k * 30 + 30}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(log.schema).parquet(source)
        q = tail.apply_state(stream, state, str(tmp_path / checkpoint))
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        last, tables = snapshot.latest(spark, state)
        want = {r.key: r.value for r in Keyspace(log).as_of(k * 30 + 29).counters().collect()}
        assert last == k * 30 + 29 and {r.key: r.value for r in tables["counters"].collect()} == want


def test_messages_are_published_once(spark, tmp_path):
    df = spark.range(20).withColumnRenamed("id", "idx")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = tail.publish_once(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


BLOCKED = [
    # two waiters on a list, then three pushes
    ("a", 1, ["BLPOP", "x", "0"]), ("a", 2, ["BLPOP", "x", "0"]), ("a", 3, ["RPUSH", "x", "1"]), ("a", 4, ["RPUSH", "x", "2"]), ("a", 5, ["RPUSH", "x", "3"]), ("a", 6, ["LRANGE", "x", "0", "-1"]),
    # two waiters on a sorted set that comes at once, from either end
    ("b", 1, ["BZPOPMIN", "z", "0"]), ("b", 2, ["BZPOPMIN", "z", "0"]), ("b", 3, ["ZADD", "z", "0", "a", "1", "b", "2", "c"]), ("c", 1, ["BZPOPMAX", "z", "0"]), ("c", 2, ["BZPOPMAX", "z", "0"]), ("c", 3, ["ZADD", "z", "0", "a", "1", "b", "2", "c"]),
    # the first waiter times out, one is unblocked, one is cancelled by a new term, one is served
    ("d", 1, ["BLPOP", "x", "1"]), ("d", 2, ["BRPOP", "x", "0"]), ("d", 3, ["TIMEOUT", "1"]), ("d", 4, ["LPUSH", "x", "1"]), ("d", 5, ["BLPOP", "x", "0"]), ("d", 6, ["UNBLOCK", "5"]), ("d", 7, ["BLPOP", "x", "0"]), ("d", 8, ["TERM"]), ("d", 9, ["RPUSH", "x", "9"]),
    # a move serves a waiter of its target, which came before; inside MULTI nothing waits
    ("e", 1, ["BLPOP", "y", "0"]), ("e", 2, ["BLMOVE", "x", "y", "LEFT", "RIGHT", "0"]), ("e", 3, ["MULTI", "BLPOP", "x", "0"]), ("e", 4, ["RPUSH", "x", "7"]), ("e", 5, ["BZMPOP", "0", "1", "z", "MAX"]),
]
SETTLED = {
    ("a", 1, 3, "[x,1]"), ("a", 2, 4, "[x,2]"), ("a", 6, 6, "[3]"), ("b", 1, 3, "[z,a,0]"), ("b", 2, 3, "[z,b,1]"), ("c", 1, 3, "[z,c,2]"), ("c", 2, 3, "[z,b,1]"), ("d", 1, 3, None), ("d", 2, 4, "[x,1]"),
    ("d", 5, 6, "UNBLOCKED client unblocked via CLIENT UNBLOCK"), ("d", 7, 8, "CANCELLED"), ("e", 2, 4, "7"), ("e", 1, 4, "[y,7]"), ("e", 3, 3, None),
}


def blocked(spark):
    return spark.createDataFrame(BLOCKED, "group string, idx long, argv array<string>")


def test_blocking_commands_wait(spark):
    got = {(r.group, r.idx, r.settled_by, r.reply) for r in orderedfold.settled(blocked(spark), "group").collect()}
    assert SETTLED <= got and {g for g in got if g[3] == "WAITING"} == {("e", 5, None, "WAITING")}


def test_waiters_outlive_a_restart(spark, tmp_path):
    df = blocked(spark)
    for k in range(0, 9, 2):
        df.where(f"idx > {k} and idx <= {k + 2}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = tail.settled(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).outputMode("append").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    out = {(r.group, r.idx, r.settled_by, r.reply) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {(r.group, r.idx, r.settled_by, r.reply) for r in orderedfold.settled(df, "group").collect() if r.reply != "WAITING"}


def test_sessions_stream(spark, tmp_path):
    rows = [(1, 1, "WATCH"), (1, 3, "WATCH"), (2, 4, "WATCH"), (1, 5, "END"), (1, 6, "END"), (2, 7, "NO_OP"), (1, 7, "NO_OP"), (2, 8, "WATCH")]
    df = spark.createDataFrame(rows, "client long, idx long, event string")
    for k in (4, 8):
        df.where(f"idx > {k - 4} and idx <= {k}").coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    out = run(spark, tail.sessions(stream), "sessions_stream", "append")
    assert {tuple(r) for r in out} == {(1, 1, 5), (2, 4, 7)}
