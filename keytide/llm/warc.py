"""WARC derivative builder: metadata and plain-text conversion records from response records.

`responses` makes a response record of each page: an HTTP block with the HTML, a record id derived from page and URL,
a payload digest (SHA-1, base 32) and a block digest. `derivatives` reads response records and gives two for each:
metadata, with the source's headers, digests, title and links, and conversion, with the page's plain text. Both name
the response in WARC-Refers-To and its target and date. `write_files` puts records into .warc.gz files, a gzip member a record, so
any record can be read by its offset; `read_files` reads them back.

No shuffle: a task writes the records of its own rows, in files of its own attempt, and reports them; only reported
files are read. Defined results: a null page is an empty payload; null URLs give the target urn:page:<id>; equal pages
have equal digests and ids of their own; repeated rows have equal ids.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from keytide.llm.common import new_path, stored
from keytide.llm.markup import plain_text

CRLF = b"\r\n"
#: Bytes of a file after which another is begun.
FILE_BYTES = 256 << 20
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, block binary"
FIELDS = [x.split()[0] for x in RECORD.split(", ")]
_KINDS = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.string(), pa.binary()]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def response(page_id: int | None, url: str | None, page: str | None, date: str) -> tuple:
    payload = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    target = " ".join(url.split()) if url else f"urn:page:{page_id}"
    return (page_id, "response", record_id("response", page_id, target), None, target, date, "application/http; msgtype=response", len(block), digest(block), digest(payload), block)


def derive(source: tuple) -> Iterator[tuple]:
    """The metadata and the conversion record of a response record."""
    page_id, _, rid, _, target, date, kind, length, block_digest, payload_digest, block = source
    head, _, payload = block.partition(CRLF * 2)
    text, title, links = plain_text(payload.decode("utf-8", "replace"))
    fields = [("source-record-id", rid), ("source-content-type", kind), ("source-content-length", length), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest)]
    fields += [("source-http-header", x) for x in head.decode("latin-1").split("\r\n")]
    fields += [("title", title)] * bool(title) + [("outlink", " ".join(x.split())) for x in links]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    yield (page_id, "metadata", record_id("metadata", rid), rid, target, date, "application/warc-fields", len(about), digest(about), None, about)
    plain = text.encode()
    yield (page_id, "conversion", record_id("conversion", rid), rid, target, date, "text/plain; charset=utf-8", len(plain), digest(plain), digest(plain), plain)


def serialize(record: tuple) -> bytes:
    page_id, kind, rid, refers, target, date, content, length, block_digest, payload_digest, block = record
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    if refers:
        # a derivative has its source's target and date
        lines += [f"WARC-Refers-To: {refers}", f"WARC-Refers-To-Target-URI: {target}", f"WARC-Refers-To-Date: {date}"]
    lines += [f"WARC-Payload-Digest: {payload_digest}"] * bool(payload_digest)
    lines += [f"WARC-Block-Digest: {block_digest}", *[f"WARC-Page-ID: {page_id}"] * (page_id is not None), f"Content-Type: {content}", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + block + CRLF * 2


def parse(data: bytes) -> tuple:
    """A record from its bytes."""
    head, _, rest = data.partition(CRLF * 2)
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    length = int(h["content-length"])
    block = rest[:length]
    # other writers may leave digests out or use another function: what can be checked is checked
    given = h.get("warc-block-digest", "")
    if len(block) != length or (given.lower().startswith("sha1:") and digest(block).lower() != given.lower()):
        raise ValueError(f"damaged record {h.get('warc-record-id')}")
    page = h.get("warc-page-id")
    return (
        int(page) if page is not None else None, h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), h.get("warc-target-uri"), h["warc-date"], h.get("content-type", "application/octet-stream"), length,
        given or digest(block), h.get("warc-payload-digest"), block,
    )


def _batch(rows: list[tuple], extra: list[tuple[str, pa.Array]] = ()) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)]
    return pa.RecordBatch.from_arrays([*columns, *[a for _, a in extra]], [*FIELDS, *[n for n, _ in extra]])


def _batches(rows: Iterator[tuple], size: int = 8 << 20) -> Iterator[list[tuple]]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[-1])
        if n >= size or len(held) >= 4096:
            yield held
            held, n = [], 0
    if held:
        yield held


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    narrow = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(response(i, u, h, date) for i, u, h in _rows(batches, ["page_id", "url", "html"])):
            yield _batch(part)

    return narrow.mapInArrow(run, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of the response records; records of other types have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(d for r in _rows(batches, FIELDS) if r[1] == "response" for d in derive(r)):
            yield _batch(part)

    return records.select(*FIELDS).mapInArrow(run, RECORD)


def write_files(records: DataFrame) -> tuple[DataFrame, str]:
    """Writes records to .warc.gz files of the shared folder; returns their manifest (path, n_records, n_bytes) and the folder."""
    folder = new_path(records.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        number, path, stream, n, size = TaskContext.get().partitionId(), "", None, 0, 0
        done: list[tuple[str, int, int]] = []
        for row in _rows(batches, FIELDS):
            if stream is None:
                system.create_dir(root, recursive=True)
                path = f"{root}/{number:06d}-{uuid.uuid4().hex}.warc.gz"
                stream, n, size = system.open_output_stream(path, compression=None), 0, 0
            member = gzip.compress(serialize(row), 5, mtime=0)
            stream.write(member)
            n, size = n + 1, size + len(member)
            if size >= FILE_BYTES:
                stream.close()
                done.append((path, n, size))
                stream = None
        if stream is not None:
            stream.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "n_records", "n_bytes"])

    manifest, _ = stored(records.select(*FIELDS).mapInArrow(run, "path string, n_records long, n_bytes long"), "manifest")
    return manifest, folder


def members(source: io.RawIOBase) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each gzip member of a stream."""
    offset, raw = 0, source.read(1 << 20)
    while raw:
        unzip, parts, length = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not raw:
                raw = source.read(1 << 20)
                if not raw:
                    raise ValueError("a gzip member is cut short")
            parts.append(unzip.decompress(raw))
            length += len(raw) - len(unzip.unused_data)
            raw = unzip.unused_data
        yield offset, length, b"".join(parts)
        offset += length
        raw = raw or source.read(1 << 20)


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the files, checked against their block digests, with the offset and length of each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)

        def rows() -> Iterator[tuple]:
            for (path,) in _rows(batches, ["path"]):
                with system.open_input_stream(path, compression=None) as source:
                    for offset, length, data in members(source):
                        record = parse(data)
                        yield (path.rpartition("/")[2], offset, length, *record)

        for part in _batches(rows()):
            extra = [(n, pa.array([r[k] for r in part], t)) for k, (n, t) in enumerate((("file", pa.string()), ("member_offset", pa.int64()), ("member_length", pa.int64())))]
            yield _batch([r[3:] for r in part], extra)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n).mapInArrow(run, RECORD + ", file string, member_offset long, member_length long")


def read_archive(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of .warc.gz files of other writers (URIs, each gzip member a record): responses to give to derivatives()."""
    manifest = spark.createDataFrame([(fs.FileSystem.from_uri(p)[1],) for p in paths], "path string")
    return read_files(manifest, paths[0].rpartition("/")[0])
