import random

from pyspark.sql import functions as F

from keytide.functions.interpreter import Store
from keytide.operators import clients, commands, logops, orderedfold, topology, zset
from keytide.operators.keyspace import Keyspace


def log_of(spark, rows):
    return spark.createDataFrame([(i, k, c, f, v, int(v) if v and v.lstrip("-").isdigit() else None) for i, (k, c, f, v) in enumerate(rows)], "idx long, key string, cmd string, field string, value string, num long")


def random_log(seed, n, kinds):
    r = random.Random(seed)
    return [(f"k{r.randint(0, 5)}", r.choice(kinds), f"f{r.randint(0, 3)}", str(r.randint(0, 50))) for _ in range(n)]


def test_folds_equal_the_store(spark):
    """DataFrame folds against commands applied in order."""
    cases = [
        (("SET", "INCRBY", "DEL"), lambda k: k.counters(), lambda r: (r.key, None, str(r.value))),
        (("SET", "APPEND", "DEL"), lambda k: k.strings(), lambda r: (r.key, None, r.value)),
        (("HSET", "HDEL", "DEL"), lambda k: k.hashes(), lambda r: (r.key, r.field, r.value)),
        (("HSET", "HINCRBY", "HDEL", "DEL"), lambda k: k.hash_counters(), lambda r: (r.key, r.field, str(r.value))),
        (("SADD", "SREM", "DEL"), lambda k: k.sets(), lambda r: (r.key, r.member, None)),
        (("ZADD", "ZINCRBY", "ZREM", "DEL"), lambda k: k.zsets(), lambda r: (r.key, r.member, str(r.score))),
        (("RPUSH", "LPUSH", "DEL"), lambda k: k.lists(), lambda r: (r.key, str(r.pos), r.value)),
    ]
    for seed, (kinds, fold, shape) in enumerate(cases):
        rows = random_log(seed, 300, kinds)
        store = Store()
        for i, (k, c, f, v) in enumerate(rows):
            argv = {
                "DEL": [k], "HSET": [k, f, v], "HDEL": [k, f], "HINCRBY": [k, f, v], "SADD": [k, f], "SREM": [k, f], "ZADD": [k, v, f], "ZINCRBY": [k, v, f], "ZREM": [k, f],
            }.get(c, [k, v])
            store.apply(i, [c, *argv])
        want = sorted(((k, f, v) for k, _, f, v in store.rows()), key=repr)
        got = sorted((shape(r) for r in fold(Keyspace.from_log(log_of(spark, rows))).collect()), key=repr)
        assert got == want, kinds


def test_as_of(spark):
    df = log_of(spark, [("a", "SET", None, "1"), ("a", "INCRBY", None, "2"), ("a", "DEL", None, None)])
    assert [r.value for r in Keyspace(df).as_of(1).counters().collect()] == [3]
    assert Keyspace(df).counters().count() == 0


def test_ordered_fold_streams_groups(spark):
    r = random.Random(5)
    rows = []
    for i in range(400):
        g = r.randint(0, 6)
        argv = r.choice([["RPUSH", "a", str(i)], ["LPOP", "a"], ["RPOPLPUSH", "a", "b"], ["LTRIM", "b", "0", "3"], ["SETNX", "s", str(i)], ["RENAME", "b", "c"], ["SPOP", "m"], ["SADD", "m", str(i % 9)], ["LSET", "a", "0", "x"]])
        rows.append((g, i, argv))
    df = spark.createDataFrame(rows, "slot int, idx long, argv array<string>").repartition(7)
    want_state, want_replies = [], {}
    for g in range(7):
        s = Store()
        for gg, i, argv in rows:
            if gg == g:
                want_replies[i] = orderedfold.text_of(s.apply(i, argv))
        want_state += [(str(g), *x) for x in s.rows()]
    assert sorted(map(tuple, orderedfold.fold(df).collect()), key=repr) == sorted(want_state, key=repr)
    assert {x.idx: x.reply for x in orderedfold.replies(df).collect()} == want_replies


def test_store_semantics():
    s = Store()
    do = lambda *a: s.apply(0, list(a))
    assert [do("INCR", "c") for _ in range(3)] == [1, 2, 3]
    assert do("HSET", "c", "f", "v").startswith("WRONGTYPE") and do("INCR", "c") == 4
    assert do("SET", "c", "1", "NX") is None and do("GETSET", "c", "x") == "4" and do("INCR", "c").startswith("ERR")
    assert do("MSETNX", "c", "1", "d", "2") == 0 and do("EXISTS", "d", "c", "c") == 2
    assert do("RPUSH", "l", "1", "2", "3") == 3 and do("LRANGE", "l", "-2", "-1") == ["2", "3"] and do("LINSERT", "l", "BEFORE", "2", "x") == 4
    assert do("LREM", "l", "-1", "3") == 1 and do("LINDEX", "l", "-1") == "2" and do("LSET", "l", "9", "x").startswith("ERR")
    assert do("ZADD", "z", "1", "a", "2", "b", "2", "c") == 3 and do("ZREVRANGE", "z", "0", "1") == ["c", "b"] and do("ZRANGEBYSCORE", "z", "(1", "+inf") == ["b", "c"]
    assert do("ZRANK", "z", "b") == 1 and do("ZPOPMAX", "z") == ["c", "2"] and do("ZLEXCOUNT", "z", "-", "[a") == 1
    assert do("SADD", "s", "a", "b") == 2 and do("SADD", "t", "b", "d") == 2 and do("SINTER", "s", "t") == ["b"] and do("SUNIONSTORE", "u", "s", "t") == 3
    assert do("SETRANGE", "r", "3", "ab") == 5 and do("GETRANGE", "r", "0", "-1") == "\0\0\0ab" and do("BITCOUNT", "r") == 6
    assert do("SETBIT", "w", "7", "1") == 0 and do("GETBIT", "w", "7") == 1 and do("TYPE", "w") == "string" and do("RENAMENX", "w", "z") == 0
    assert do("NOPE").startswith("ERR") and do("SET", "a").startswith("ERR") and do("KEYS", "?") == sorted("cdlzstur"[:1] + "lrstuwz")
    assert do("EXPIREAT", "l", "50") == 1 and do("TTL", "l", "20") == 30 and do("PERSIST", "l") == 1 and do("TTL", "l") == -1 and do("TTL", "nope") == -2


def test_fencing_script(spark):
    script = [(2, 123, "ok"), (1, 123, "term"), (2, 10, "session"), (2, 123, "ok"), (3, 123, "ok"), (2, 123, "term")]
    df = spark.createDataFrame([(i, 7, t, s, True, 123) for i, (t, s, _) in enumerate(script)], "idx long, slot int, term long, session_key long, importing boolean, slot_session long")
    assert [r.status for r in topology.fence(df).orderBy("idx").collect()] == [x for *_, x in script]


TOPOLOGY = [("g1", True, 0, 500, 1), ("g1", True, 600, 700, 2), ("g1", True, 800, 1000, 3), ("g2", False, 1001, 16383, 2), ("g2", False, 600, 700, 3), ("g3", False, 800, 1000, 2), ("g3", False, 1001, 16383, 3)]


def ranges_of(spark, rows):
    return spark.createDataFrame([(*r, 0, k) for k, r in enumerate(rows)], "group_id string, local boolean, start int, end int, type int, session_key long, position int")


def nodes_of(spark, groups):
    return spark.createDataFrame([(g, k, f"{g}-{k}", g, 7000 + k) for g in groups for k in range(2)], "group_id string, node_no int, node_id string, host string, port int")


def test_three_groups(spark):
    r = ranges_of(spark, TOPOLOGY)
    assert topology.violations(r).count() == 0
    got = {x.group_id: x.slots for x in topology.cluster_shards(r, nodes_of(spark, ["g1", "g2", "g3"])).collect()}
    assert got == {"g1": [0, 500, 800, 1000], "g2": [600, 700], "g3": [1001, 16383]}
    assert {x.slot: x.note for x in topology.move_notes(r, nodes_of(spark, ["g1", "g2", "g3"]).where("node_no=0")).collect()}[600] == " [600-<-g2-0]"


def test_routing(spark):
    r, n = ranges_of(spark, TOPOLOGY), nodes_of(spark, ["g1", "g2", "g3"])
    cases = [(0, 5, False, "ALL"), (1, 650, False, "ALL"), (2, 650, True, "ALL"), (3, 650, True, "SOME"), (4, 900, False, "NONE"), (5, 900, False, "SOME"), (6, 900, False, "ALL"), (7, 5000, False, "ALL"), (8, 550, False, "ALL"), (9, None, False, "ALL"), (10, 650, False, "ALL")]
    df = spark.createDataFrame(cases, "idx long, slot int, asking boolean, exist string")
    got = {x.idx: x.outcome for x in topology.decide(df, topology.slot_map(r), n).collect()}
    assert got == {0: "OK", 1: "MOVED 650 g2:7001", 2: "OK", 3: "TRYAGAIN", 4: "ASK 900 g3:7000", 5: "TRYAGAIN", 6: "OK", 7: "MOVED 5000 g3:7001", 8: "CLUSTERDOWN", 9: "CROSSSLOT", 10: "MOVED 650 g2:7000"}


def test_clashes_depend_on_order(spark):
    assert {x.reason for x in topology.violations(ranges_of(spark, [("a", True, 0, 1, 1), ("b", True, 1, 2, 2)])).collect()} == {"owned"}
    assert {x.reason for x in topology.violations(ranges_of(spark, [("b", True, 1, 2, 2), ("a", True, 0, 1, 1)])).collect()} == {"resharding"}


def test_transactions(spark):
    cmds = ["MULTI", "INCR", "INCR", "EXEC", "EXEC", "MULTI", "DEBUG", "EXEC", "MULTI", "WATCH", "MULTI", "INCR", "EXEC", "MULTI", "INCR", "DISCARD", "GET"]
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(cmds)], "client long, arrival long, cmd string")
    out = [(r.role, r.reply) for r in clients.transactions(df).orderBy("arrival").collect()]
    assert [x for x, _ in out] == ["begin", "queued", "queued", "exec", "stray", "begin", "poison", "exec", "begin", "watch", "nested", "queued", "exec", "begin", "queued", "discard", "single"]
    assert [r for x, r in out if x == "exec"] == ["EXECUTED", "EXECABORT", "EXECUTED"]
    assert sorted(r.n_commands for r in clients.entries(clients.transactions(df)).collect()) == [2, 3]


def test_blocked_lists(spark):
    waits = spark.createDataFrame([("x", 0), ("x", 1)], "key string, idx long")
    pushes = spark.createDataFrame([("x", 2, "1"), ("x", 3, "2"), ("x", 4, "3")], "key string, idx long, value string")
    assert [(r.waiter, r.value) for r in clients.fifo(waits, pushes).orderBy("waiter").collect()] == [(0, "1"), (1, "2")]


def test_eviction_counts(spark):
    cache = spark.createDataFrame([(i, 100) for i in range(1, 1000)], "idx long, data_len int")
    n = 999 * 156
    for most, upto, count in ((n - 5 * 156, 999, 5), (n, 999, 0), (n - 6 * 156, 1, 1), (0, 998, 998)):
        assert logops.evict(cache, most, upto).count() == count


def test_batches_and_offsets(spark):
    log = spark.createDataFrame([(i, 10) for i in range(1, 200_000, 1)], "idx long, data_len int")
    assert logops.batch_by_bytes(log, 5, 35).count() == 3 and logops.batch_by_bytes(log, 5, 1).count() == 1
    got = logops.offsets(log, F.col("data_len"), 3).agg(F.sum((F.col("offset") != (F.col("idx") - 1) * 10 + 3).cast("int"))).first()[0]
    assert got == 0
    assert logops.contiguous(log.where("idx <> 8"), 5, 10).count() == 3
    assert logops.bounds(log.where("idx < 0"), 7).first().asDict() == {"first": 8, "current": 7, "count": 0}


def test_catalogue(spark):
    flags = commands.catalogue("ping, Get")
    assert flags["get"] & commands.DONT_INTERCEPT and flags["bzmpop"] == commands.WRITE | commands.BLOCKING
    df = spark.createDataFrame([("SUBSCRIBE",), ("GeT",), ("nope",), ("xadd",), ("auth",)], "cmd string")
    assert [r[0] for r in df.select(commands.route(F.col("cmd"))).collect()] == ["subscribe", "read", "log", "reject", "pass"]
    assert [r[0] for r in df.select(commands.route(F.col("cmd"), may_subscribe=F.lit(False))).collect()][0] == "reject"
    argv = spark.createDataFrame([(["BLPOP", "k", "0.0015"],), (["BLMPOP", "2", "1", "k", "LEFT"],), (["BLPOP", "k", "-1"],), (["BLPOP", "k", "x"],)], "a array<string>")
    assert [r[0] for r in argv.select(commands.timeout_ms(F.col("a"))).collect()] == [2, 2000, None, None]
    assert argv.select(commands.without_timeout(F.col("a"))).first()[0] == ["BLPOP", "k", "0"]


def test_weighted_sets(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "member string, score double")
    b = spark.createDataFrame([("y", 5.0), ("z", 1.0)], "member string, score double")
    assert {r.member: r.score for r in zset.combine([(a, 2), (b, 1)]).collect()} == {"x": 2.0, "y": 9.0, "z": 1.0}
    assert {r.member: r.score for r in zset.combine([(a, 1), (b, 1)], "min", True).collect()} == {"y": 2.0}


def test_store_places_cursors_and_fields():
    s = Store()
    do = lambda *a: s.apply(0, list(a))
    assert do("GEOADD", "g", "13.361389", "38.115556", "P", "15.087269", "37.502669", "C") == 2
    assert abs(float(do("GEODIST", "g", "P", "C")) - 166274.15) < 1 and do("GEODIST", "g", "P", "x") is None
    assert do("GEORADIUS", "g", "15", "37", "100000") == ["C"] and do("GEORADIUSBYMEMBER", "g", "P", "200000") == ["P", "C"]
    assert do("GEOHASH", "g", "P", "x") == ["sqc8b49rny0"[:8] + do("GEOHASH", "g", "P")[0][8:], None] and do("TYPE", "g") == "geo"
    assert do("PFADD", "a", "1", "2") == 1 and do("PFADD", "b", "2", "3") == 1 and do("PFMERGE", "c", "a", "b") == "OK" and do("PFCOUNT", "c") == 3
    assert do("RPUSH", "l", "3", "10", "2") == 3 and do("SORT", "l") == ["2", "3", "10"] and do("SORT", "l", "ALPHA", "DESC", "LIMIT", "0", "2") == ["3", "2"]
    assert do("BLMPOP", "0", "2", "none", "l", "LEFT") == ["l", "3"] and do("ZADD", "z", "1", "m") == 1 and do("BZMPOP", "0", "1", "z", "MIN") == ["z", "m", "1"]
    do("HSET", "h", *(x for k in range(25) for x in (f"f{k:02d}", "v")))
    seen, cursor = [], "0"
    while True:
        cursor, *names = do("HSCAN", "h", cursor, "COUNT", "7")
        seen += names
        if cursor == "0":
            break
    assert seen == [f"f{k:02d}" for k in range(25)] and do("HSCAN", "h", "0", "COUNT", "99", "MATCH", "f0?")[1:] == [f"f{k:02d}" for k in range(10)]
    assert do("BITFIELD", "w", "SET", "u8", "4", "255", "GET", "u4", "0", "INCRBY", "u8", "4", "2") == [0, 0, 1] and do("BITFIELD", "w", "GET", "u8", "4") == [1]
