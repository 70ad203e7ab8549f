"""Substring dedup by fixed-block anchors: index blocks, probe with every rolling window, extend to maximal repeats.

A repeat is a run of `window` words whose sequence also starts anywhere else. The index holds the hash of every
non-overlapping block of `block` words (words 0-15, 16-31, ... of each document); the probe is the hash of every
rolling window of `block` words. As 2 * block - 1 <= window, each window of 35 words holds a whole block of its
own document, so two equal windows always meet at that block's hash. A block hash that occurs at two places or
more is an anchor hit. Each hit is extended to all windows that hold it; extended windows are compared by
their own 64-bit hash, and those that occur twice or more, merged where they touch, are the maximal
exact repeats. Their words are removed, at every place.

Groups of copies are never paired: hashes are made distinct by task before they are dealt to buckets, counted
there, and sent back (see sideload), so the work is linear in the words, whatever a passage's frequency. The
documents' text isn't shuffled. Windows have 16-byte hashes of words that have 16-byte hashes themselves: among
10^14 windows two differing ones agree with a chance of about 10^-11. Anchor hashes are shorter, for a false hit costs one more candidate and
changes nothing: as many bytes as make false hits rarer than 1 in 64 for the bytes of text counted while the documents are
stored. A bucket stands for BUCKET bytes of text, and there are at least two for each of spark.sql.shuffle.partitions.

Defined results: a null text has no words; documents under `window` words keep all; repeated rows are documents
of their own, so their windows repeat.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from keytide.llm.common import delete, stored
from keytide.llm.sideload import BLOB, Values, answers, read_answer, send

#: Characters of text worked on at once.
SLICE = 6 << 20
BUCKET = 256 << 20
WINDOW_BYTES = 16
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PIECE = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K1 + ((b << np.uint64(31)) | (b >> np.uint64(33))) * _K2
    x ^= x >> np.uint64(29)
    x *= _K2
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of some texts, one after the other, as hashes, and where each document lies."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        full = pc.greater(pc.binary_length(flat), 0)
        kept = full.to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        running = np.concatenate([[0], np.cumsum(kept)])
        self.ends = running[offsets[1:]]
        self.starts = running[offsets[:-1]]
        coded = flat.filter(full).dictionary_encode()
        digests = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.cast(pa.large_binary()).to_pylist()))
        own = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
        self.hashes, self.others = (own[:, k][coded.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64) for k in (0, 1))
        n = self.ends - self.starts
        self.into = np.arange(len(self.hashes)) - np.repeat(self.starts, n)
        self.left = np.repeat(n, n) - self.into

    def rolling(self, width: int, other: bool = False) -> np.ndarray:
        """A hash of `width` words from each place on, by doubling, or its other half; places too near an end hold anything."""
        h, size = self.others if other else self.hashes, 1
        with np.errstate(over="ignore"):
            while size < width:
                step = min(size, width - size)
                later = np.zeros_like(h)
                later[: max(0, len(h) - step)] = h[step:]
                h, size = _mix(h, later), size + step
        return h


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // SLICE
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                part = batch.slice(a, b - a)
                tasks = part.column("task").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(tasks)) + 1), part.num_rows]
                for c, d in zip(cuts, cuts[1:]):
                    yield part.slice(c, d - c)


class _Answers:
    """Answers of the task at hand; one is held at a time."""

    def __init__(self, path: str, width: int) -> None:
        self.path, self.width, self.task, self.values = path, width, None, None

    def of(self, task: int) -> Values:
        if task != self.task:
            self.task, self.values = task, read_answer(self.path, task, self.width)
        return self.values


def _probe(block: int, width: int, buckets: int):
    """Every rolling window of `block` words; flag 1 marks the non-overlapping blocks."""

    def found(part: pa.RecordBatch) -> tuple[int, Values]:
        w = Words(part.column("text"))
        ok = w.left >= block
        values = Values(w.rolling(block)[ok] >> np.uint64(64 - 8 * width), None, (w.into[ok] % block == 0).astype(np.uint8))
        return part.column("task")[0].as_py(), values.distinct()

    return lambda batches: send(map(found, _slices(batches)), width, buckets)


def _extend(anchors: str, block: int, width: int, window: int, buckets: int):
    """The windows that hold an anchor hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Answers(anchors, width)

        def found(part: pa.RecordBatch) -> tuple[int, Values]:
            task = part.column("task")[0].as_py()
            w = Words(part.column("text"))
            hit = hits.of(task).member(w.rolling(block) >> np.uint64(64 - 8 * width)) & (w.left >= block)
            before = np.concatenate([[0], np.cumsum(hit)])
            n, reach = len(hit), window - block + 1
            near = before[np.minimum(np.arange(n) + reach, n)] > before[:n]
            at = np.flatnonzero(near & (w.left >= window))
            return task, Values(w.rolling(window)[at], w.rolling(window, True)[at] if len(at) else np.zeros(0, np.uint64)).distinct()

        return send(map(found, _slices(batches)), WINDOW_BYTES, buckets)

    return run


def _remove(repeats: str, window: int, names: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Answers(repeats, WINDOW_BYTES)
        for part in _slices(batches):
            w = Words(part.column("text"))
            repeated = found.of(part.column("task")[0].as_py())
            at = np.flatnonzero(repeated.member(w.rolling(window), w.rolling(window, True)) & (w.left >= window)) if len(repeated) else np.zeros(0, np.int64)
            cover = np.zeros(len(w.hashes) + 1, np.int32)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            keep = np.cumsum(cover)[:-1] == 0
            digests, cleaned, removed, spans = [], [], [], []
            for raw, a, b in zip(part.column("text").cast(pa.large_binary()).to_pylist(), w.starts, w.ends):
                mask, raw = keep[a:b], raw or b""
                gone = int(len(mask) - mask.sum())
                words = raw.split()
                digests.append(hashlib.sha256(b" ".join(words if not gone else compress(words, mask))).hexdigest())
                removed.append(gone)
                edges = np.flatnonzero(np.diff(np.concatenate([[True], mask, [True]]).astype(np.int8)))
                spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(edges[::2], edges[1::2])])
                if with_text:
                    cleaned.append((raw if not gone else b"".join(compress(_PIECE.findall(raw), mask))).decode())
            out = [part.column(c) for c in names]
            out += [pa.array(w.ends - w.starts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(cleaned, pa.string())] if with_text else []), [*names, "n_words", "n_removed", "kept_sha256", "spans", *["clean_text"] * with_text])

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def anchor_width(size: int, block: int) -> int:
    """Bytes of an anchor hash for so many bytes of text, with 6 a word: 64 times as many hashes as blocks, 5 at least."""
    return next((w for w in range(5, 8) if 256**w >= 64 * size // (6 * block)), 8)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 35, block: int = 16, buckets: int | None = None, keep_rows: bool = False,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and spans (first word and length of each removed run).

    With keep_rows also the struct `row` with all other columns of docs, and `clean_text`: the text without removed words.
    """
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block")
    spark = docs.sparkSession
    row = [F.struct(F.lit(True).alias("__row"), *[docs[c] for c in docs.columns if c != text_col]).alias("row")] if keep_rows else []
    # `task` is a column of the stored table: it names the same rows in every later pass
    counted = Observation()
    whole = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), F.spark_partition_id().cast("long").alias("task"), *row)
    table, _ = stored(whole.observe(counted, F.sum(F.octet_length("text")).alias("bytes")), "documents")
    size = counted.get["bytes"] or 0
    buckets = buckets or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET)
    anchor_bytes = anchor_width(size, block)
    narrow = table.select("task", "text")
    anchors = answers(narrow.mapInArrow(_probe(block, anchor_bytes, buckets), BLOB), anchor_bytes, 1, buckets, "anchors")
    repeats = answers(narrow.mapInArrow(_extend(anchors, block, anchor_bytes, window, buckets), BLOB), WINDOW_BYTES, 0, buckets, "repeats")
    delete(spark, anchors)
    names = ["doc_id", *["row"] * keep_rows]
    span = ArrayType(StructType().add("start", "long").add("length", "long"))
    schema = StructType([table.schema[c] for c in names]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("spans", span)
    if keep_rows:
        schema = schema.add("clean_text", "string")
    return table.mapInArrow(_remove(repeats, window, names, keep_rows), schema)
