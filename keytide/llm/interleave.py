"""Interleaved document sequences: ordered text and media references from HTML, payloads by digest join.

`sequences` parses HTML into an array of items in reading order: text items, and references to media with digest,
caption and position. `store_media` keeps payloads as lossless PNG images of 8-bit RGB samples, addressed by the
SHA-256 of the payload. `resolve` joins references to stored media by digest, so that each item keeps its position and
caption and gains the facts of its payload.

`of_documents` applies the three to texts: each text gives a page of its first lines, a figure that refers to the
text's own payload (UTF-8, with spaces to a positive multiple of 192 bytes, 64 pixels of 3 samples), and its other lines.
Payloads are written by the task that reads the row and decoded once; a task keeps no payload twice. Only digests,
captions and numbers are shuffled. References are dealt to `salts` shares; each share asks once for each of its digests, the
facts are joined to those questions, and the answers to the references of the share, so a digest that a third of all
references hold is spread over all shares.

Defined results: a null text is empty: no text items, a payload of 192 spaces; equal texts give equal values; rows
that repeat are rows of their own; a reference without stored media keeps its item, with null facts.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keytide.llm.common import stored
from keytide.llm.markup import BLOCKS, MEDIA, attributes, events

ROW = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Digests that a task remembers so as not to store a payload twice.
SEEN = 200_000


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The bytes of a text, filled with spaces to a positive multiple of ROW, and their number before."""
    raw = (text or "").encode()
    return raw + b" " * ((-len(raw)) % ROW or (0 if raw else ROW)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """An image of 64 pixels a row, 8-bit RGB, every row unfiltered; the private chunk ktLn has the unfilled length."""
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"ktLn", struct.pack(">Q", n_bytes)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (rows, 192) and the unfilled length of an image of to_png; chunk sums are checked."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, head, n_bytes, packed = 8, None, 0, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"ktLn":
            n_bytes = struct.unpack(">Q", body)[0]
        elif kind == b"IDAT":
            packed.append(body)
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(head[1], ROW + 1)
    if head[0] * 3 != ROW or head[2:] != (8, 2, 0, 0, 0) or rows[:, 0].any():
        raise ValueError("another kind of PNG")
    return rows[:, 1:], n_bytes


def features(samples: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, and the commonest sample with its count."""
    pixels = samples.reshape(-1, 3)
    means = pixels.sum(axis=0, dtype=np.int64) * 1000 // len(pixels)
    counts = np.bincount(samples.reshape(-1), minlength=256)
    top = int(counts.argmax())
    return f"rgb8 {ROW // 3}x{len(samples)} mean {means[0]},{means[1]},{means[2]} top {top}:{int(counts[top])} used {int((counts > 0).sum())}"


def page_of(text: str | None, digest: str, lead: int = 3) -> str:
    """A page of a text: its first lines, a figure for its payload, its other lines."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    figure = f'<figure><img src="media:sha256:{digest}"><figcaption>Payload of {len(lines)} lines</figcaption></figure>'
    paragraph = lambda xs: "".join(f"<p>{html.escape(x)}</p>" for x in xs)
    return f"<article>{paragraph(lines[:lead])}{figure}{paragraph(lines[lead:])}</article>"


def items_of(page: str) -> list[dict]:
    """Items in reading order: kind, text, digest, caption. A figure's caption, or else alt, is the reference's."""
    out: list[dict] = []
    held: list[str] = []
    caption: list[str] | None = None
    figure: list[dict] | None = None

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append({"position": len(out), "kind": "text", "text": text, "digest": None, "caption": None})

    for kind, x, raw in events(page):
        if kind == "text":
            (held if caption is None else caption).append(x)
        elif x == "figcaption":
            if kind == "open":
                caption = []
            elif caption is not None:
                for item in figure or ():
                    item["caption"] = " ".join("".join(caption).split())
                caption = None
        elif x in MEDIA and kind == "open":
            given = attributes(raw)
            source = given.get("src", "")
            if source:
                flush()
                digest = source.rpartition(":")[2] if source.startswith("media:sha256:") else hashlib.sha256(source.encode()).hexdigest()
                out.append({"position": len(out), "kind": "media", "text": None, "digest": digest, "caption": given.get("alt")})
                if figure is not None:
                    figure.append(out[-1])
        elif x in BLOCKS:
            flush()
            if x == "figure":
                figure = [] if kind == "open" else None
    if caption is not None:
        held.extend(caption)
    flush()
    return out


_ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def sequences(pages: DataFrame, html_col: str = "html", keep: list[str] = ()) -> DataFrame:
    """The columns of keep and `items`, the interleaved sequence of each page (null: none)."""
    narrow = pages.select(*keep, pages[html_col].cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [items_of(x or "") for x in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.list_(_ITEM))], [*keep, "items"])

    return narrow.mapInArrow(run, _with_items(narrow, keep))


def _with_items(narrow: DataFrame, keep: list[str]) -> StructType:
    items = narrow.sparkSession.createDataFrame([], f"items {ITEMS}").schema["items"]
    return StructType([*[narrow.schema[c] for c in keep], items])


def store_media(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The table (digest, media) of the payloads of texts, in the shared folder; a digest may be there once a task."""
    narrow = texts.select(texts[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for x in batch.column("text").slice(at, 256).to_pylist():
                    payload, n = payload_of(x)
                    # texts that differ in spaces at their end alone share a payload but not n_bytes
                    key = hashlib.sha256(payload).digest() + n.to_bytes(8, "big")
                    if key in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    rows.append((media_key(key[:32].hex(), n), to_png(payload, n)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["digest", "media"])

    return stored(narrow.mapInArrow(run, "digest string, media binary"), "media", "none")[0]


def media_key(payload_sha256: str, n_bytes: int) -> str:
    return f"{payload_sha256}-{n_bytes}"


FACTS = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_facts(media: DataFrame) -> DataFrame:
    """What the stored bytes show when read back, once a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, data in zip(batch.column("digest").to_pylist(), batch.column("media")):
                raw = data.as_py()
                samples, n = from_png(raw)
                payload = np.ascontiguousarray(samples).tobytes()
                rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), features(samples)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in FACTS.split(", ")])

    names = [x.split()[0] for x in FACTS.split(", ")][1:]
    return media.select("digest", "media").mapInArrow(run, FACTS).groupBy("digest").agg(*[F.first(c).alias(c) for c in names])


def resolve(items: DataFrame, facts: DataFrame, salts: int = 64) -> DataFrame:
    """A row per media reference of items (key columns and `items`): the keys, position, caption, n_items and the payload's facts."""
    keys = [c for c in items.columns if c != "items"]
    media = F.filter("items", lambda x: x["kind"] == "media")
    refs = items.select(*keys, F.size("items").alias("n_items"), F.explode(media).alias("m")).select(*keys, "n_items", "m.position", "m.caption", "m.digest")
    share = F.pmod(F.xxhash64(*keys, "position"), F.lit(salts)).cast("int")
    refs, _ = stored(refs.withColumn("__share", share), "references")
    known = refs.select("digest", "__share").distinct().join(facts.hint("merge"), "digest")
    return refs.join(known.hint("merge"), ["digest", "__share"], "left").drop("__share")


def of_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, n_items, caption, sequence_sha256."""
    facts = media_facts(store_media(docs, text_col))
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, found, sums = batch.slice(at, 256), [], []
                for x in part.column("text").to_pylist():
                    payload, n = payload_of(x)
                    got = items_of(page_of(x, media_key(hashlib.sha256(payload).hexdigest(), n)))
                    sums.append(hashlib.sha256("\n".join(i["text"] or i["digest"] for i in got).encode()).hexdigest())
                    # the texts themselves aren't needed beside their digest here
                    found.append([i | {"text": None} for i in got])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sums), pa.array(found, pa.list_(_ITEM))], ["doc_id", "sequence_sha256", "items"])

    schema = StructType([narrow.schema["doc_id"]]).add("sequence_sha256", "string")
    schema = StructType([*schema.fields, *_with_items(narrow, []).fields])
    return resolve(narrow.mapInArrow(run, schema), facts).drop("digest")
