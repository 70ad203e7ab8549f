"""Folds against the store, two-level scans against plain windows, and the operators of migration, topology entries and scripts."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.functions.interpreter import Store
from keytide.operators import clients, commands, keyspace, logops, migration, scripts, topology, values, zset
from keytide.operators.keyspace import Keyspace

LOG = "idx long, key string, cmd string, field string, value string, num long"


def mixed(spark, weights, n=1500, keys=6, seed=1):
    """A log with one hot key, and the replies and end state that the store gives."""
    r = random.Random(seed)
    store, rows, replies = Store(), [], {}
    for i in range(n):
        cmd = r.choices(list(weights), list(weights.values()))[0]
        key, field, num = ("hot" if r.random() < 0.4 else f"k{r.randrange(keys)}"), f"f{r.randrange(4)}", r.randrange(1, 90)
        argv = {
            "SET": [key, str(num)], "INCRBY": [key, str(num)], "DECRBY": [key, str(num)], "INCR": [key], "DECR": [key], "DEL": [key], "UNLINK": [key], "GETSET": [key, str(num)], "HSET": [key, field, str(num)], "HDEL": [key, field],
            "HSETNX": [key, field, str(num)], "SADD": [key, field], "SREM": [key, field], "ZADD": [key, str(num), field], "ZINCRBY": [key, str(num), field], "ZREM": [key, field], "RPUSH": [key, str(num)], "LPUSH": [key, str(num)],
            "APPEND": [key, str(num)], "EXPIREAT": [key, str(num)], "PERSIST": [key],
        }[cmd]
        replies[i] = store.apply(i, [cmd, *argv])
        rows.append((i, key, cmd, field, str(num), num))
    return spark.createDataFrame(rows, LOG), store, replies


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    """Buckets of 100 places, so that every scan crosses many."""
    for f in (logops.running_sum, logops.last_before, logops.max_before, keyspace.after_last):
        defaults = list(f.__defaults__)
        defaults[-1] = 100
        monkeypatch.setattr(f, "__defaults__", tuple(defaults))


COUNTERS = {"SET": 2, "INCRBY": 4, "DECRBY": 3, "INCR": 2, "DECR": 2, "DEL": 1, "UNLINK": 1}


def test_counters_and_their_replies(spark):
    log, store, replies = mixed(spark, COUNTERS)
    got = {r.key: str(r.value) for r in Keyspace(log).counters().collect()}
    assert got == {k: v for k, (_, v) in store.data.items()}
    answered = {r.idx: r.reply for r in keyspace.running_counter(log).collect()}
    assert answered == {i: x for i, x in replies.items() if isinstance(x, int) and i in answered} and len(answered) > 800


def test_getset_history(spark):
    log, _, replies = mixed(spark, {"GETSET": 5, "DEL": 1})
    assert {r.idx: r.previous for r in keyspace.history(log).collect()} == {i: x for i, x in replies.items() if not isinstance(x, int)}


@pytest.mark.parametrize(("weights", "fold"), [
    ({"HSET": 5, "HDEL": 2, "DEL": 1}, lambda k: k.hashes()), ({"SADD": 5, "SREM": 2, "DEL": 1}, lambda k: k.sets()), ({"ZADD": 5, "ZINCRBY": 3, "ZREM": 1, "DEL": 1}, lambda k: k.zsets()),
    ({"RPUSH": 5, "LPUSH": 5, "DEL": 1}, lambda k: k.lists()), ({"SET": 1, "APPEND": 4, "DEL": 1}, lambda k: k.strings()), ({"HSETNX": 5, "DEL": 1}, lambda k: keyspace.first_fields(k.log)),
])
def test_folds_give_the_stores_state(spark, weights, fold):
    log, store, _ = mixed(spark, weights)
    want = sorted((k, f, v) for k, _, f, v in store.rows())
    rows = [r.asDict() for r in fold(Keyspace(log)).collect()]
    place = lambda r: next((str(r[c]) for c in ("field", "member", "pos") if c in r), None)
    held = lambda r: next((str(r[c]) for c in ("score", "value") if c in r), None)
    assert sorted((r["key"], place(r), held(r)) for r in rows) == want


def test_time_left(spark):
    log, store, _ = mixed(spark, {"SET": 3, "EXPIREAT": 6, "PERSIST": 1, "DEL": 2}, keys=60)
    store.now = 45_000
    want = {r.key: store.apply(0, ["TTL", r.key], 45_000) for r in log.select("key").distinct().collect()}
    assert {r.key: r.ttl for r in Keyspace(log).ttl(45).collect()} == want
    assert {-2, -1} < set(want.values())


def test_scans_equal_plain_windows(spark):
    r = random.Random(4)
    rows = [(i * 3, r.choice(["a", "b", None]), r.choice([None, r.randrange(50)]), r.random() < 0.1) for i in range(900)]
    df = spark.createDataFrame(rows, "idx long, k string, v long, flag boolean")
    w = W.partitionBy("k").orderBy("idx")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    got = logops.running_sum(df, F.col("v"), "s", keys=("k",), total="t")
    got = logops.last_before(got, F.col("flag"), F.col("v"), "l", keys=("k",))
    got = logops.max_before(got, F.col("v"), "m", keys=("k",))
    want = (
        df.withColumn("s", F.coalesce(F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))).withColumn("t", F.sum("v").over(W.partitionBy("k")))
        .withColumn("l", F.last(F.when(F.col("flag"), F.struct("v")), True).over(before)["v"]).withColumn("m", F.max("v").over(before))
    )
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    page = logops.contiguous(df.where("idx <> 600").select("idx").union(spark.range(601, 605).toDF("idx")), 597, 1)
    assert [x.idx for x in page.collect()] == [597]


def test_ranks_by_bands_equal_a_plain_window(spark):
    r = random.Random(6)
    scores = [0.0, -0.0, 1.0, -1.0, 1e300, -1e300, float("inf"), float("-inf"), 0.5, 2.0**53, 2.0**53 + 2]
    rows = [("hot" if r.random() < 0.6 else f"k{r.randrange(5)}", f"m{i}", r.choice(scores) if r.random() < 0.3 else r.uniform(-1, 1) * 10 ** r.randrange(-5, 12)) for i in range(1500)]
    z = spark.createDataFrame(rows, "key string, member string, score double")
    for reverse in (False, True):
        want = z.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(*zset.order(reverse))) - 1)
        assert sorted(map(str, zset.ranks(z, reverse).collect())) == sorted(map(str, want.collect()))


def test_sums_in_three_levels(spark):
    df = spark.range(5000).select((F.col("id") * 7).alias("idx"), (F.col("id") % 3).alias("k"), (F.col("id") % 11).alias("v"))
    plain, deep = (sorted(map(tuple, logops.running_sum(df, F.col("v"), "s", keys=("k",), total="t", levels=n, width=10).collect())) for n in (1, 3))
    assert plain == deep


def test_store_options():
    s = Store()
    do = lambda line, now=0: s.apply(7, line.split(" "), now)
    assert do("ZADD z NX 1 a") == 1 and do("ZADD z GT CH 0 a") == 0 and do("ZADD z GT CH 9 a") == 1 and do("ZADD z INCR 2 a") == "11" and do("ZADD z XX 1 b") == 0 and do("ZADD z x a").startswith("ERR")
    assert do("SET t v EX 10", 1000) == "OK" and do("PTTL t", 4000) == 7000 and do("TTL t", 11000) == -2 and do("SET t w KEEPTTL") == "OK" and do("PTTL t", 4000) == 7000 and do("SET t x XX GET") == "w" and do("PTTL t") == -1
    assert do("EXPIRE t 5", 2000) == 1 and do("PTTL t", 2000) == 5000 and do("PEXPIREAT t 900") == 1 and do("PTTL t", 100) == 800 and do("SET t v EX").startswith("ERR") and do("SET t v NX XX").startswith("ERR")
    for k, v in (("w1", "9"), ("w2", "1"), ("w3", "5")):
        do(f"SET {k} {v}")
    do("RPUSH l 1 2 3")
    assert do("SORT l BY w* GET # GET w*") == ["2", "1", "3", "5", "1", "9"] and do("SORT l BY none") == ["1", "2", "3"] and do("SORT l DESC LIMIT 0 1 STORE m") == 1 and do("LRANGE m 0 -1") == ["3"]
    assert do("LPOP l 2") == ["1", "2"] and do("LPOP none 2") is None and do("BLPOP none l 0") == ["l", "3"] and do("BRPOP none 0") is None
    do("SADD s a b c d")
    assert len(do("SPOP s 2")) == 2 and len(do("SRANDMEMBER s -5")) == 5 and len(do("SRANDMEMBER s 9")) == 2
    assert do("ZUNIONSTORE u 2 z s WEIGHTS 2 3 AGGREGATE MAX") == 3 and do("ZSCORE u a") == "22" and do("ZINTERSTORE v 1 z WEIGHTS x").startswith("ERR")
    assert do("MSET a 1 b").startswith("ERR") and do("INCRBYFLOAT t x").startswith("ERR") and do("GET").startswith("ERR wrong") and do("GEOADD g x 1 m").startswith("ERR") and do("BITFIELD q GET u8 x").startswith("ERR")
    assert do("ZPOPMIN u 2")[::2] != [] and do("BZMPOP 0 1 z MIN COUNT 2") == ["z", "a", "11"] and do("HINCRBY h f x").startswith("ERR") and do("EXISTS h") == 0


def test_fencing_restarts(spark):
    imports = spark.createDataFrame([(1, 5, 2, 7, True, 7), (2, 5, 1, 7, True, 7), (3, 5, 9, 8, True, 7), (4, 5, 3, 7, True, 7), (6, 5, 1, 7, True, 7), (7, 6, 1, 7, False, 7)], "idx long, slot int, term long, session_key int, importing boolean, slot_session int")
    status = lambda df: {r.idx: r.status for r in df.collect()}
    plain = {1: "ok", 2: "term", 3: "session", 4: "ok", 6: "term", 7: "slot"}
    assert status(topology.fence(imports)) == plain
    assert status(topology.fence(imports, spark.createDataFrame([(5, 5), (5, 9)], "idx long, slot int"))) == plain | {6: "ok"}


def test_keys_of_entries(spark):
    keys = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x"), (3, "a"), (4, "a"), (4, "x"), (4, "a"), (6, "y")], "txn long, key string")
    here, held = spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("b",), ("y",)], "key string")
    entries = spark.createDataFrame([(i,) for i in range(1, 7)], "txn long")
    got = {r.txn: r.exist for r in topology.key_classes(keys, here, held, entries).collect()}
    assert got == {1: "LOCKED", 2: "NONE", 3: "ALL", 4: "SOME", 5: "ALL", 6: "NONE"}
    slots = keys.withColumn("slot", F.ascii("key"))
    assert {r.txn: (r.slot, r.crossed) for r in topology.cross_slot(slots, entries=entries).collect()}[5] == (-1, False)


def test_migration(spark):
    space = spark.createDataFrame([("a", "string", "1\n2", 5), ("b", "string", "", 6), ("c", "string", "é", None)], "key string, type string, value string, expire_at long")
    keys = spark.createDataFrame([(1, "a"), (1, "none"), (2, "b")], "idx long, key string")
    outcomes = spark.createDataFrame([(1, "OK"), (2, "CROSSSLOT")], "idx long, outcome string")
    locked = migration.lock_keys(keys, space, outcomes)
    assert [tuple(r) for r in locked.collect()] == [(1, "a")]
    sent = {r.key: bytes(r.payload) for r in migration.export(space, space).collect()}
    rows = [(k, bytearray(v)) for k, v in sent.items()] + [("bad", bytearray(sent["a"][:-1] + b"x")), ("short", bytearray(b"x")), ("none", None)]
    back = {r.key: r.r and tuple(r.r) for r in spark.createDataFrame(rows, "key string, payload binary").select("key", migration.restore(F.col("payload")).alias("r")).collect()}
    assert back == {"a": ("string", "1\n2"), "b": ("string", ""), "c": ("string", "é"), "bad": None, "short": None, "none": None}
    imports = spark.createDataFrame([(1, 0, 1, 5, 7, True, 7, "a", bytearray(sent["c"])), (1, 1, 2, 5, 7, True, 7, "z", bytearray(sent["b"])), (2, 0, 1, 4, 7, True, 7, "c", bytearray(sent["a"]))], "idx long, pos int, slot int, term long, session_key int, importing boolean, slot_session int, key string, payload binary")
    after = {r.key: (r.value, r.expire_at) for r in migration.import_keys(space, imports).collect()}
    assert after == {"a": ("é", None), "b": ("", 6), "c": ("é", None), "z": ("", None)}
    left, locks = migration.delete_unlock(space, locked, locked)
    assert sorted(r.key for r in left.collect()) == ["b", "c"] and locks.count() == 0
    steps = spark.createDataFrame([(i, "k", s) for i, s in enumerate("DUMP LOCK IMPORT DUMP FAILED IMPORT DELETE_UNLOCK LOCK".split())], "idx long, key string, step string")
    assert [r.state for r in migration.pipeline_steps(steps).orderBy("idx").collect()] == ["FREE", "LOCKED", "LOCKED", "DUMPED", "DUMPED", "IMPORTED", "MOVED", "LOCKED"]


def test_migrate_words(spark):
    cases = {
        'MIGRATE h 1 "" 0 9 KEYS a b': (["a", "b"], "default", "", None), 'MIGRATE h 1 "" 0 9 AUTH2 u p keys a': (["a"], "u", "p", None), "MIGRATE h 1 k 0 9 KEYS a b": (None, None, None, "single keys aren't migrated"),
        'MIGRATE h 1 "" 0 9 KEYS': (None, None, None, "wrong number of arguments"), 'MIGRATE h 1 "" 0 9 COPY KEYS': (None, None, None, "no keys"), 'MIGRATE h 1 "" 0 9 COPY x': (None, None, None, "no keys"),
        'MIGRATE h 1 "" 0 9 COPY AUTH2 u': (None, None, None, "no username or password"), f'MIGRATE h 1 "" 0 9 AUTH2 {"u" * 256} p KEYS a': (None, None, None, "username too long"),
    }
    df = spark.createDataFrame([(t, [w.replace('""', "") for w in t.split(" ")]) for t in cases], "t string, argv array<string>")
    assert {r.t: tuple(r.m) for r in df.select("t", migration.parse_migrate(F.col("argv")).alias("m")).collect()} == cases


def test_group_words(spark):
    good = ["g", "1", "1", "0", "5", "1", "7", "n", "h:1"]
    cases = [(good, None), (["g", "0", "0"], None), (["g", "1"], "wrong number of arguments"), (["g" * 33, *good[1:]], "invalid id"), (["g", "x", *good[2:]], "invalid number"), (good[:-1], "wrong number of arguments"),
             ([*good[:3], "9", *good[4:]], "invalid slot range"), ([*good[:5], "4", *good[6:]], "invalid slot type"), ([*good[:6], "-1", *good[7:]], "invalid session key"), ([*good[:8], "h"], "invalid node"), ([*good[:7], "n" * 41, "h:1"], "invalid node")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, argv array<string>")
    got = {r.i: r.p for r in df.select("i", topology.parse_group(F.col("argv")).alias("p")).collect()}
    assert [got[i].error for i in range(len(cases))] == [e for _, e in cases] and all((got[i].group is None) == (e is not None) for i, (_, e) in enumerate(cases))
    assert got[0].group.nodes[0].port == 1 and got[0].group.slot_ranges[0].end == 5


def test_groups_in_force(spark):
    rows = [(1, "ADD", "a", 1), (2, "ADD", "b", 2), (3, "REPLACE", "b", 3), (3, "REPLACE", "c", 4), (4, "UPDATE", "b", 5), (5, "UPDATE", "c", 6), (6, "UPDATE", "x", 7), (7, "ADD", "d", 8)]
    df = spark.createDataFrame(rows, "idx long, kind string, group_id string, n int").select("idx", "kind", "group_id", F.array("n").alias("slot_ranges"), F.array("n").alias("nodes"))
    assert {r.group_id: (r.slot_ranges, r.nodes) for r in topology.fold_groups(df, "c").collect()} == {"b": ([3], [5]), "c": ([4], [4]), "d": ([8], [8])}


def test_scripts_are_known_until_a_flush(spark):
    import hashlib

    sha = hashlib.sha1(b"body").hexdigest()
    rows = [(1, "EVALSHA", sha), (2, "SCRIPT LOAD", "body"), (3, "evalsha", sha.upper()), (4, "SCRIPT FLUSH", None), (5, "EVALSHA", sha), (6, "EVAL", "body"), (205, "EVALSHA", sha)]
    calls = spark.createDataFrame(rows, "idx long, cmd string, script string")
    assert {r.idx: r.known for r in scripts.resolve(calls).collect()} == {1: False, 2: True, 3: True, 5: False, 6: True, 205: True}
    names = spark.createDataFrame([(sha,), ("0",)], "sha string")
    assert {r.sha: r.here for r in scripts.exists(names, calls).collect()} == {sha: 1, "0": 0}


def test_lists_and_places(spark):
    lists = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 2, 1, 1])] + [("b", 0, 5)], "key string, pos int, value long")
    flat = lambda df: {k: [v for _, v in sorted((r.pos, r.value) for r in df.collect() if r.key == k)] for k in ("a", "b")}
    one = F.lit(1).cast("long")
    assert flat(values.removed(lists, 2, one)) == {"a": [2, 1], "b": [5]} and flat(values.removed(lists, 0, one)) == {"a": [2], "b": [5]} and flat(values.removed(lists, -1, one)) == {"a": [1, 2, 1], "b": [5]}
    assert flat(values.inserted(lists, one, F.lit(9).cast("long"))) == {"a": [9, 1, 2, 1, 1], "b": [5]} and flat(values.set_at(lists, -1, F.lit(7).cast("long"))) == {"a": [1, 2, 1, 7], "b": [7]}
    assert flat(values.set_at(lists, 3, F.lit(7).cast("long"))) == {"a": [1, 2, 1, 7], "b": [5]} and flat(values.trimmed(lists, -2, -1)) == {"a": [1, 1], "b": [5]}
    assert flat(values.popped(lists, True)[1]) == {"a": [2, 1, 1], "b": []}


def test_replies_and_arrays(spark):
    df = spark.createDataFrame([([["é", None], []], 3, None)], "a array<array<string>>, b long, c string").select(F.struct("a", "b", "c").alias("r"))
    assert df.select(commands.resp(F.col("r"), df.schema["r"].dataType)).first()[0] == "*3\r\n*2\r\n*2\r\n$2\r\né\r\n$-1\r\n*0\r\n:3\r\n$-1\r\n"


def test_cancelled_waiters(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "idx long")
    served = spark.createDataFrame([(1, 2, "v"), (4, 30, "w")], "waiter long, served_by long, value string")
    assert {r.idx: r.reply for r in clients.cancel(ids(1, 3, 4, 20), ids(10), served).collect()} == {1: "v", 3: "CANCELLED", 4: "CANCELLED", 20: "WAITING"}
