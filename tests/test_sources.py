from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keytide.operators.keyspace import Keyspace
from keytide.sources import logfile, snapshot

DBID = "01234567890123456789012345678901"


def entry(n, data=b"x"):
    return {"term": 1, "entry_id": n, "session": (1 << 64) - 1, "type": 0, "data": data}


def load(data):
    header, at = logfile.read_header(data)
    return list(logfile.read_entries(data, header, at))


PAGE = logfile.page_bytes({"dbid": DBID, "node_id": 1}, [entry(5000), entry(6000, b"\r\n$5\r\n"), entry(7000)])


def test_entries_come_back():
    rows = load(PAGE)
    assert [(r[0], r[2]) for r in rows] == [(1, 5000), (2, 6000), (3, 7000)] and rows[1][5] == b"\r\n$5\r\n"


def test_every_flipped_header_byte_fails():
    end = logfile.read_header(PAGE)[1]
    for i in range(end):
        bad = bytearray(PAGE)
        bad[i] ^= 0x01
        with pytest.raises(logfile.BadPage):
            logfile.read_header(bytes(bad))


def test_every_flipped_byte_of_the_second_entry_leaves_one():
    rows = load(PAGE)
    for i in range(rows[1][7], rows[2][7]):
        bad = bytearray(PAGE)
        bad[i] ^= 0x01
        assert [r[2] for r in load(bytes(bad))] == [5000], i


def test_partial_tail_is_left_out():
    assert [r[2] for r in load(PAGE[:-3])] == [5000, 6000]


def test_metadata():
    data = logfile.metadata_bytes(DBID, 1002, 6, 6)
    assert logfile.read_metadata(data) == {"dbid": DBID, "node_id": 1002, "term": 6, "vote": 6}
    with pytest.raises(logfile.BadPage):
        logfile.read_metadata(data[:-4])


def test_data_source_round_trip(spark, tmp_path):
    logfile.register(spark)
    rows = [(i, 2, i * 10, Decimal(i), 0, bytearray(f"v{i}".encode())) for i in range(1, 301)]
    df = spark.createDataFrame(rows, "idx long, term long, entry_id int, session decimal(20,0), type int, data binary")
    df.repartitionByRange(3, "idx").sortWithinPartitions("idx").write.format("logpage").option("dbId", DBID).option("dbid", DBID).mode("append").save(str(tmp_path))
    back = spark.read.format("logpage").load(str(tmp_path))
    assert back.count() == 300 and back.select("idx").distinct().count() == 300
    assert [tuple(r) for r in back.orderBy("idx").select("idx", "entry_id", F.col("data").cast("string")).limit(2).collect()] == [(1, 10, "v1"), (2, 20, "v2")]
    assert not list(tmp_path.glob("*.part"))


def test_snapshot_and_suffix(spark, tmp_path):
    rows = [(i, f"k{i % 3}", ("SET", "INCRBY", "DEL", "INCRBY")[i % 4], None, None, i) for i in range(60)]
    log = spark.createDataFrame(rows, "idx long, key string, cmd string, field string, value string, num long")
    whole = {r.key: r.value for r in Keyspace(log).counters().collect()}
    for cut in (0, 17, 30, 59):
        snapshot.write(spark, str(tmp_path), {"counters": Keyspace(log).as_of(cut).counters()}, cut)
        last, tables = snapshot.latest(spark, str(tmp_path))
        assert last == cut
        got = snapshot.restore_counters(tables["counters"], snapshot.compacted(log, last))
        assert {r.key: r.value for r in got.collect()} == whole


def pages(tmp_path, *parts, damage=None):
    """Pages of (previous index, number of entries) as files; damage: (page, entry) whose bytes are spoilt."""
    for k, (prev, n) in enumerate(parts):
        data = bytearray(logfile.page_bytes({"dbid": DBID, "node_id": 1, "prev_log_term": 1, "prev_log_idx": prev}, [entry(prev + i + 1) for i in range(n)]))
        if damage and damage[0] == k:
            data[load(bytes(data))[damage[1]][7] + 30] ^= 1
        (tmp_path / f"{k}.log").write_bytes(bytes(data))


@pytest.mark.parametrize(("parts", "damage", "want"), [
    ([(0, 3), (3, 2), (5, 2)], None, 7), ([(0, 3), (50, 3)], None, 3), ([(0, 3), (3, 3), (6, 2)], (1, 1), 4), ([(0, 3), (3, 2)], (0, 2), 2), ([(0, 3), (3, 0), (3, 2)], None, 5), ([(0, 3), (3, 2), (5, 1)], (1, 0), 3), ([(0, 4)], (0, 0), 0),
])
def test_the_log_ends_at_damage_or_a_gap(spark, tmp_path, parts, damage, want):
    logfile.register(spark)
    pages(tmp_path, *parts, damage=damage)
    assert sorted(r.entry_id for r in logfile.recovered(spark, str(tmp_path)).collect()) == list(range(1, want + 1))


def test_long_checksums():
    import os

    table = logfile._CRC
    for n in (0, 7, 8, 9, 2047, 2048, 2049, 9000):
        data, crc = os.urandom(n), 99 ^ 0xFFFFFFFF
        for b in data:
            crc = table[(crc ^ b) & 0xFF] ^ (crc >> 8)
        assert logfile.crc32c(data, 99) == crc ^ 0xFFFFFFFF


def test_a_failed_page_is_taken_back(spark, tmp_path):
    logfile.register(spark)
    rows = [(i, 2, i, Decimal(i), 0, bytearray(b"v")) for i in (1, 2, 4)]
    df = spark.createDataFrame(rows, "idx long, term long, entry_id int, session decimal(20,0), type int, data binary").coalesce(1).sortWithinPartitions("idx")
    with pytest.raises(Exception, match="hole"):
        df.write.format("logpage").option("dbid", DBID).mode("append").save(str(tmp_path / "x"))
    assert not [p for p in (tmp_path / "x").glob("*")]


def test_metadata_is_published_whole(spark, tmp_path):
    for term in (5, 6):
        logfile.publish_metadata(str(tmp_path / "m"), dbid=DBID, node_id=1002, term=term, vote=6)
    row = logfile.metadata(spark, [str(tmp_path / "m")]).first()
    assert (row.dbid, row.node_id, row.term, row.vote) == (DBID, 1002, 6, 6) and [p.name for p in tmp_path.iterdir()] == ["m"]
