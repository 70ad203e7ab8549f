"""Log pages as a Spark data source, with checksum-chained recovery, and the one-record metadata file.

Fixed values, format: records are arrays of strings, *7 and so on, all lines ended by CR LF. The header has the tag
RAFTLOG, version 1, database id (32 letters), node id, the term and index before the page, and a checksum; an entry has the tag
ENTRY, term, id, session, type, data and a checksum. Checksums are CRC-32C of the bytes of a record before its own
checksum; an entry's goes on from the checksum of the record before it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

LOG_TAG, ENTRY_TAG, VERSION, ID_LENGTH = b"RAFTLOG", b"ENTRY", 1, 32
HEADER_SCHEMA = "version int, dbid string, node_id int, prev_log_term long, prev_log_idx long, crc long"
SCHEMA = "idx long, term long, entry_id int, session decimal(20,0), type int, data binary, crc long, offset long, page long"


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ 0x82F63B78 if n & 1 else n >> 1
        out.append(n)
    return out


_CRC = _table()
#: What a byte contributes when 1, 2, ... 7 more bytes follow it.
_FOLD = [_CRC]
for _ in range(7):
    _FOLD.append([_CRC[c & 0xFF] ^ (c >> 8) for c in _FOLD[-1]])
#: Bytes of a stripe, and the effect of one stripe of zeros on each byte of a checksum.
_STRIPE = 256


def _shifted(crc: int, n: int) -> int:
    for _ in range(n):
        crc = _CRC[crc & 0xFF] ^ (crc >> 8)
    return crc


_SKIP = [[_shifted(b << 8 * k, _STRIPE) for b in range(256)] for k in range(4)]


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC-32C, going on from crc.

    Long data is cut into stripes; all stripes go through the table together, a column of bytes at a time, and are then joined,
    for the checksum of two pieces is that of the first, moved on, and that of the second.
    """
    crc ^= 0xFFFFFFFF
    n = len(data) // _STRIPE
    if n >= 8:
        import numpy as np

        table = np.array(_CRC, np.uint32)
        stripes = np.frombuffer(data, np.uint8, n * _STRIPE).reshape(n, _STRIPE)
        sums = np.zeros(n, np.uint32)
        for column in stripes.T:
            sums = table[(sums ^ column) & 0xFF] ^ (sums >> 8)
        a, b, c, d = _SKIP
        for x in sums.tolist():
            crc = a[crc & 0xFF] ^ b[crc >> 8 & 0xFF] ^ c[crc >> 16 & 0xFF] ^ d[crc >> 24] ^ x
        data = data[n * _STRIPE :]
    at, end = 0, len(data) - 7
    t0, t1, t2, t3, t4, t5, t6, t7 = _FOLD
    while at < end:
        x = crc ^ int.from_bytes(data[at : at + 4], "little")
        crc = t7[x & 0xFF] ^ t6[x >> 8 & 0xFF] ^ t5[x >> 16 & 0xFF] ^ t4[x >> 24] ^ t3[data[at + 4]] ^ t2[data[at + 5]] ^ t1[data[at + 6]] ^ t0[data[at + 7]]
        at += 8
    for b in data[at:]:
        crc = _CRC[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def _string(value: bytes | int) -> bytes:
    raw = value if isinstance(value, bytes) else str(value).encode()
    return b"$%d\r\n%s\r\n" % (len(raw), raw)


class BadPage(ValueError):
    """The header of a page is damaged."""


class _Bytes:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def length(self, prefix: bytes) -> int:
        end = self.data.find(b"\r\n", self.at, self.at + 64)
        digits = self.data[self.at + 1 : end]
        if end < 0 or self.data[self.at : self.at + 1] != prefix or not digits.isdigit():
            raise BadPage("a length")
        self.at = end + 2
        return int(digits)

    def string(self) -> bytes:
        n = self.length(b"$")
        out = self.data[self.at : self.at + n]
        if len(out) != n or self.data[self.at + n : self.at + n + 2] != b"\r\n":
            raise BadPage("a string")
        self.at += n + 2
        return out

    def number(self) -> int:
        try:
            return int(self.string())
        except ValueError as e:
            raise BadPage("a number") from e


def header_bytes(dbid: str, node_id: int, prev_log_term: int = 0, prev_log_idx: int = 0) -> tuple[bytes, int]:
    body = b"*7\r\n" + b"".join(map(_string, (LOG_TAG, VERSION, dbid.encode(), node_id, prev_log_term, prev_log_idx)))
    crc = crc32c(body)
    return body + _string(crc), crc


def entry_bytes(entry: dict, crc: int) -> tuple[bytes, int]:
    """Bytes of an entry (term, entry_id, session, type, data) after a record with checksum crc."""
    body = b"*7\r\n" + b"".join(map(_string, (ENTRY_TAG, entry["term"], entry["entry_id"], entry["session"], entry["type"]))) + _string(bytes(entry["data"]))
    crc = crc32c(body, crc)
    return body + _string(crc), crc


def page_bytes(header: dict, entries: list[dict]) -> bytes:
    out, crc = header_bytes(**header)
    parts = [out]
    for e in entries:
        raw, crc = entry_bytes(e, crc)
        parts.append(raw)
    return b"".join(parts)


def read_header(data: bytes) -> tuple[dict, int]:
    """The header and where the entries begin; BadPage if anything is wrong with it."""
    c = _Bytes(data)
    if c.length(b"*") != 7 or c.string() != LOG_TAG or c.number() != VERSION:
        raise BadPage("not a log page")
    dbid = c.string()
    node, term, idx = c.number(), c.number(), c.number()
    body = c.at
    crc = c.number()
    if len(dbid) != ID_LENGTH or crc32c(data[:body]) != crc:
        raise BadPage("header checksum")
    return {"version": VERSION, "dbid": dbid.decode(), "node_id": node, "prev_log_term": term, "prev_log_idx": idx, "crc": crc}, c.at


def read_entries(data: bytes, header: dict, at: int) -> Iterator[tuple]:
    """Entries up to the first that is cut short or fails its checksum."""
    crc, idx = header["crc"], header["prev_log_idx"]
    while at < len(data):
        c = _Bytes(data, at)
        try:
            if c.length(b"*") != 7 or c.string() != ENTRY_TAG:
                return
            term, number, session, kind, payload = c.number(), c.number(), c.number(), c.number(), c.string()
            body = c.at
            written = c.number()
        except BadPage:
            return
        found = crc32c(data[at:body], crc)
        if found != written:
            return
        idx += 1
        yield idx, term, number, session, kind, payload, written, at
        crc, at = written, c.at


class LogSource(DataSource):
    """spark.read.format('logpage').load(path): a page, or a folder of pages, each read by one task, for the chain of checksums goes from record to record.

    Each page gives its own records up to the first bad one, with `page`, the index before it. recovered() gives the log:
    pages that go on where the one before ends.
    """

    @classmethod
    def name(cls) -> str:
        return "logpage"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options)


class _Page(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _pages(path: str) -> list[str]:
    from pyarrow import fs

    system, root = _open(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [root]
    return sorted(x.path for x in system.get_file_info(fs.FileSelector(root)) if x.is_file and x.path.endswith(".log"))


class LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        """Pages by their first index; headers alone are read here, and a damaged one fails the query."""
        system, _ = _open(self.path)
        heads = []
        for p in _pages(self.path):
            with system.open_input_file(p) as f:
                heads.append((read_header(f.read(4096))[0]["prev_log_idx"], p))
        heads.sort()
        return [_Page(p) for _, p in heads]

    def read(self, partition: _Page) -> Iterator[tuple]:
        from decimal import Decimal

        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as f:
            data = f.read()
        header, at = read_header(data)
        for row in read_entries(data, header, at):
            yield (*row[:3], Decimal(row[3]), *row[4:], header["prev_log_idx"])


class _Written(WriterCommitMessage):
    def __init__(self, path: str, n: int) -> None:
        self.path, self.n = path, n


class LogWriter(DataSourceWriter):
    """Writes a page a partition: rows sorted by idx within partitions; a page of a failed attempt is never named .log."""

    def __init__(self, options: dict) -> None:
        self.path, self.dbid, self.node = options["path"], options["dbid"], int(options.get("nodeId", "1"))

    def write(self, rows: Iterator) -> _Written:
        import uuid

        first, crc, n, out, temporary = None, 0, 0, None, ""
        system, root = _open(self.path)
        try:
            for r in rows:
                if first is None:
                    first = r["idx"]
                    system.create_dir(root, recursive=True)
                    temporary = f"{root}/{first:020d}-{uuid.uuid4().hex}.part"
                    out = system.open_output_stream(temporary)
                    head, crc = header_bytes(self.dbid, self.node, 0, first - 1)
                    out.write(head)
                elif r["idx"] != first + n:
                    raise ValueError(f"the log has a hole before {r['idx']}")
                raw, crc = entry_bytes({k: r[k] for k in ("term", "entry_id", "session", "type", "data")}, crc)
                out.write(raw)
                n += 1
        except BaseException:
            # what was written of a page that failed is taken back
            if out is not None:
                out.close()
                system.delete_file(temporary)
            raise
        if out is not None:
            out.close()
        return _Written(temporary, n)

    def commit(self, messages: list) -> None:
        system, root = _open(self.path)
        for m in messages:
            if m is not None and m.path:
                system.move(m.path, f"{root}/{m.path.rpartition('/')[2].partition('-')[0]}.log")

    def abort(self, messages: list) -> None:
        system, _ = _open(self.path)
        for m in messages:
            if m is not None and m.path:
                system.delete_file(m.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)


def recovered(spark: SparkSession, path: str) -> DataFrame:
    """The log in a folder of pages: records up to the first bad one of all pages, pages that are empty or leave a gap, and all after them, left out.

    Pages are as many as tasks that wrote them; their order is a window over a row a page, found by one aggregate.
    """
    rows = spark.read.format("logpage").load(path)
    order = W.orderBy("page")
    pages = rows.groupBy("page").agg(F.max("idx").alias("last"))
    broken = F.coalesce(F.col("page") != F.lag("last").over(order), F.lit(False))
    sound = pages.withColumn("__b", broken).withColumn("__n", F.max(F.col("__b").cast("int")).over(order)).where("__n = 0").agg(F.max("last").alias("__end"))
    return rows.crossJoin(F.broadcast(sound)).where("idx <= __end").drop("__end", "page")


def metadata(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, dbid, node_id, term, vote) of metadata files."""
    read = spark.read.format("binaryFile").load(paths)

    @F.pandas_udf("dbid string, node_id int, term long, vote int")
    def parsed(data):
        import pandas as pd

        return pd.DataFrame([read_metadata(bytes(x)) for x in data], columns=["dbid", "node_id", "term", "vote"])

    return read.select("path", parsed("content").alias("m")).select("path", "m.*")


def publish_metadata(path: str, **fields) -> None:
    """Writes a metadata file under another name first, so that a reader sees the old one or the new one."""
    system, at = _open(path)
    with system.open_output_stream(f"{at}.part") as f:
        f.write(metadata_bytes(**fields))
    system.move(f"{at}.part", at)


def metadata_bytes(dbid: str, node_id: int, term: int, vote: int) -> bytes:
    """One record of six strings: tag, version, database id, node id, term, vote."""
    return b"*6\r\n" + b"".join(map(_string, (b"METADATA", 1, dbid.encode(), node_id, term, vote)))


def read_metadata(data: bytes) -> dict:
    c = _Bytes(data)
    if c.length(b"*") != 6 or c.string() != b"METADATA" or c.number() != 1:
        raise BadPage("not a metadata record")
    return {"dbid": c.string().decode(), "node_id": c.number(), "term": c.number(), "vote": c.number()}
