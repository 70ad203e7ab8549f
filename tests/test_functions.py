import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keytide.functions import bits, codecs, slots
from keytide.sources.logfile import crc32c


def values(spark, pairs, make):
    df = spark.createDataFrame([(a,) for a in pairs], "x string")
    return [r[0] for r in df.select(make(F.col("x"))).collect()]


def test_slots_have_their_known_values(spark):
    keys = ["key", "{key}7", "{key2}7", "123456789", "", "foo{}{bar}", "foo{{bar}}zap", "ключ"]
    got = values(spark, keys, slots.hash_slot)
    assert got[0] == got[1] == 12539 and got[2] == 4998 and got[3] == 12739 and got[4] == 0
    table = slots._crc16_table()

    def plain(k):
        a = k.find("{")
        b = k.find("}", a + 1) if a >= 0 else -1
        k = k[a + 1 : b] if b > a + 1 else k
        crc = 0
        for byte in k.encode():
            crc = ((crc << 8) & 0xFF00) ^ table[(crc >> 8) ^ byte]
        return crc & 16383

    assert got == [plain(k) for k in keys]


def test_slot_lists(spark):
    texts = ["0", "0-10", "0,5-10,16,58-62,100", "", "a", "5-1", "16384", "1-", "1,,2", "3,3"]
    got = values(spark, texts, slots.slot_list)
    assert got[:3] == [[0], list(range(11)), [0, *range(5, 11), 16, *range(58, 63), 100]]
    assert got[3:9] == [None] * 6 and got[9] == [3]


def test_slot_config(spark):
    assert values(spark, ["", "5", "0:16383", "9:3", "16384", "1,2", "1:2:3"], slots.slot_config_valid) == [True, True, True, False, False, False, False]


def test_addresses(spark):
    got = values(spark, ["h:1", "::1:7000", "h:0", "h:65536", "h", "MOVED 3 h:7"], slots.moved_address)
    assert [g and tuple(g) for g in got] == [("h", 1), ("::1", 7000), None, None, None, ("h", 7)]


def test_globs(spark):
    import re

    cases = [("a*c", "abbc", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[a-c]x", "bx", True), ("[^a]x", "ax", False), ("a\\*", "a*", True), ("a.c", "abc", False)]
    for pattern, text, fits in cases:
        assert bool(re.match(slots.glob_to_regex(pattern), text)) is fits, pattern
    df = spark.createDataFrame([(p, t) for p, t, _ in cases if "[" not in p and "\\" not in p], "p string, t string")
    assert [r[0] for r in df.select(F.rlike("t", slots.glob_column(F.col("p")))).collect()] == [f for p, _, f in cases if "[" not in p and "\\" not in p]


def test_crc32c():
    assert crc32c(b"\0") == 1383945041 and crc32c(b"1\0") == 2727214374 and crc32c(b"123456789") == 0xE3069283


GOLDEN = b"*2\n*3\n:0\n:0\n$5\nhello\n*3\n*3\n$3\nSET\n$3\nkey\n$5\nvalue\n*2\n$3\nGET\n$5\nmykey\n*1\n$4\nPING\n"
COMMANDS = [[b"SET", b"key", b"value"], [b"GET", b"mykey"], [b"PING"]]


def test_command_array_bytes():
    assert codecs.encode_commands(COMMANDS, acl=b"hello") == GOLDEN
    assert codecs.decode_commands(GOLDEN) == {"asking": False, "cmd_flags": 0, "acl": "hello", "commands": COMMANDS}


def test_command_array_without_access_list():
    data = GOLDEN.replace(b"$5\nhello\n", b"$0\n\n", 1)
    assert codecs.encode_commands(COMMANDS) == data and codecs.decode_commands(data)["acl"] is None


def test_command_array_columns(spark):
    rows = [([[b"SET", b"", b"\xff\n"], [b"GET"]], True, 7, "u"), (COMMANDS, False, 0, None)]
    df = spark.createDataFrame([([[bytearray(x) for x in c] for c in cs], a, f, u) for cs, a, f, u in rows], "c array<array<binary>>, a boolean, f long, u string")
    got = [bytes(r[0]) for r in df.select(codecs.encode_commands_column(F.col("c"), F.col("a"), F.col("f"), F.col("u"))).collect()]
    assert got == [codecs.encode_commands(cs, a, f, u and u.encode()) for cs, a, f, u in rows]
    assert [bytes(r[0]) for r in df.select(codecs.encode_commands_column(F.col("c"))).collect()] == [codecs.encode_commands(cs) for cs, *_ in rows]


def test_payload_columns(spark):
    group = {"id": "g", "slot_ranges": [{"start": 1, "end": 2, "type": 1, "session_key": 3}], "nodes": [{"node_id": "n", "host": "h", "port": 4}]}
    df = spark.createDataFrame([(7, True, ["b", "a", "b"], [("k", "v")], group)], "i long, e boolean, k array<string>, p array<struct<key:string,payload:string>>, g struct<id:string,slot_ranges:array<struct<start:int,end:int,type:int,session_key:long>>,nodes:array<struct<node_id:string,host:string,port:int>>>")
    row = df.select(codecs.timeout_column(F.col("i"), F.col("e")), codecs.lock_keys_column(F.col("k")), codecs.import_column(F.col("i"), F.lit(9), F.col("p")), codecs.shard_group_column(F.col("g"))).first()
    assert bytes(row[0]) == codecs.encode_timeout(7, True) and bytes(row[1]) == codecs.encode_lock_keys([b"b", b"a"]) and bytes(row[2]) == codecs.encode_import(7, 9, [(b"k", b"v")]) and row[3] == codecs.encode_shard_group(group)


@pytest.mark.parametrize("data", [b"", b"*1\n", b"*2\n*3\n:0\n:0\n$-1\n*0\n", GOLDEN[:-1], GOLDEN + b"x", GOLDEN.replace(b"$5\nvalue", b"$9\nvalue"), b"*0\n" + GOLDEN])
def test_bad_command_arrays(data):
    with pytest.raises(codecs.Bad):
        codecs.decode_commands(data)


@given(st.lists(st.lists(st.binary(max_size=9), min_size=1, max_size=3), min_size=1, max_size=3), st.booleans(), st.integers(0, 1 << 40), st.none() | st.just(b"u"))
def test_command_arrays_come_back(commands, asking, flags, acl):
    got = codecs.decode_commands(codecs.encode_commands(commands, asking, flags, acl))
    assert got == {"asking": asking, "cmd_flags": flags, "acl": acl and acl.decode(), "commands": commands}


@given(st.integers(1, 1 << 60), st.integers(0, (1 << 64) - 1), st.lists(st.tuples(st.binary(), st.binary()), min_size=1, max_size=4))
def test_imports_come_back(term, key, entries):
    assert codecs.decode_import(codecs.encode_import(term, key, entries)) == {"term": term, "session_key": key, "entries": entries}


def test_lock_keys_and_timeouts():
    assert codecs.encode_lock_keys([b"b", b"a", b"b"]) == b"*2\na\0b\0"
    assert codecs.decode_lock_keys(b"*2\na\0b\0") == [b"a", b"b"]
    with pytest.raises(codecs.Bad):
        codecs.decode_lock_keys(b"*3\na\0b\0")
    assert codecs.decode_timeout(codecs.encode_timeout(7, True)) == {"idx": 7, "error": True}


def test_shard_group_text():
    nodes = [{"node_id": f"12345678901234567890123456789012aabbcc{x}", "host": f"{k}.{k}.{k}.{k}", "port": 1111 * k} for k, x in enumerate(("dd", "ee", "ff"), 1)]
    group = {"id": "12345678901234567890123456789012", "slot_ranges": [{"start": 1, "end": 1000, "type": 1, "session_key": 123}], "nodes": nodes}
    text = codecs.encode_shard_group(group)
    assert text.startswith("12345678901234567890123456789012\n1\n3\n1\n1000\n1\n123\n12345678901234567890123456789012aabbccdd\n1.1.1.1:1111\n")
    assert codecs.decode_shard_group(text) == group
    for bad in ("", text[:-1], text + "x\n", text.replace(":1111", "")):
        with pytest.raises(codecs.Bad):
            codecs.decode_shard_group(bad)


def test_codec_columns(spark):
    df = spark.createDataFrame([(bytearray(GOLDEN),), (bytearray(b"bad"),), (None,)], "x binary")
    rows = [r[0] for r in df.select(codecs.decode_commands_column(F.col("x"))).collect()]
    assert [[bytes(a) for a in c] for c in rows[0]["commands"]] == COMMANDS and rows[0]["acl"] == "hello"
    assert rows[1]["commands"] is None and rows[2]["commands"] is None


def test_bits(spark):
    df = spark.createDataFrame([(bytearray(b"foobar"), bytearray(b"abcdef")), (bytearray(b""), bytearray(b"x"))], "a binary, b binary")
    a, b = F.col("a"), F.col("b")
    rows = df.select(bits.bitcount(a), bits.getbit(a, 1), bits.getbit(a, 100), bits.bitop("xor", a, b), bits.bitop("not", a, a), bits.setbit(b, 7, 1), bits.getrange(a, -3, -1)).collect()
    assert rows[0][0] == 26 and rows[0][1] == 1 and rows[0][2] == 0
    assert bytes(rows[0][3]) == bytes(x ^ y for x, y in zip(b"foobar", b"abcdef")) and bytes(rows[0][4]) == bytes(255 - x for x in b"foobar")
    assert bytes(rows[0][5]) == b"abcdef" and bytes(rows[0][6]) == b"bar"
    assert rows[1][0] == 0 and bytes(rows[1][3]) == b"x" and bytes(rows[1][5]) == b"y"


def test_geo(spark):
    row = spark.range(1).select(
        bits.haversine_m(F.lit(13.361389), F.lit(38.115556), F.lit(15.087269), F.lit(37.502669)), bits.geohash(F.lit(13.361389), F.lit(38.115556), 8),
    ).first()
    assert abs(row[0] - 166274.15) < 1 and row[1] == "sqc8b49r"
