"""Token ids in files of fixed-width bit packing: each id takes the fewest bits that hold every id of the vocabulary.

File format, little-endian: the magic, then bits u32, ids a block u32; the blocks, each a whole number of bytes, ids
one after the other from the lowest bit; the offset of each block u64 and the end u64; the documents' ids i64, their
null marks u8, and their first ids u64 and the end u64; last a trailer of u64 counts (blocks, documents, ids) and
the place of the offsets. A reader seeks the trailer, then any block, and unpacks eight ids a step with numpy.

Documents are dealt by ranges of doc_id and sorted, so the files, in order, hold ascending doc_ids. A task writes its
file under a name of its own attempt and reports it; only reported files are in the manifest, so a lost
executor or a second attempt does no harm. Files are written and read as streams of blocks.

Defined results: a null text is empty and gives the end id alone; repeated rows are written each; null doc_ids
come first; documents with equal doc_ids are ordered by a hash of the text.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.llm.common import new_path, stored
from keytide.llm.tokens import encoder, vocabulary

MAGIC = b"KTPACK01"
BLOCK_IDS = 1 << 14
TRAILER = np.dtype("<u8")


def width_of(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids at `bits` bits each, lowest bit first, to a whole byte."""
    n = len(ids)
    groups = np.zeros((-(-n // 8), 8), np.uint64)
    groups.reshape(-1)[:n] = ids
    out = np.zeros((len(groups), bits + 8), np.uint8)
    for k in range(8):
        at, shift = divmod(k * bits, 8)
        value = groups[:, k] << np.uint64(shift)
        for b in range((bits + shift + 7) // 8):
            out[:, at + b] |= ((value >> np.uint64(8 * b)) & np.uint64(255)).astype(np.uint8)
    return np.ascontiguousarray(out[:, :bits]).tobytes()[: (n * bits + 7) // 8]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    groups = -(-n // 8)
    raw = np.zeros(groups * bits, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    raw = np.concatenate([raw.reshape(groups, bits), np.zeros((groups, 8), np.uint8)], axis=1)
    out = np.empty((groups, 8), np.uint32)
    for k in range(8):
        at, shift = divmod(k * bits, 8)
        value = np.zeros(groups, np.uint64)
        for b in range((bits + shift + 7) // 8):
            value |= raw[:, at + b].astype(np.uint64) << np.uint64(8 * b)
        out[:, k] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:n]


class Writer:
    """Writes one file; documents are added in order."""

    def __init__(self, stream, bits: int, block_ids: int = BLOCK_IDS) -> None:
        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.offsets, self.keys, self.firsts = [16], [], []
        stream.write(MAGIC + np.array([bits, block_ids], "<u4").tobytes())

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.firsts.append(self.n_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            rest = np.concatenate(self.held)
            whole = len(rest) // self.block_ids * self.block_ids
            for at in range(0, whole, self.block_ids):
                self._block(rest[at : at + self.block_ids])
            self.held, self.n_held = [rest[whole:]], len(rest) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.stream.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        self.stream.write(np.array(self.offsets, "<u8").tobytes())
        self.stream.write(np.array([x or 0 for x in self.keys], "<i8").tobytes())
        self.stream.write(np.array([x is None for x in self.keys], np.uint8).tobytes())
        self.stream.write(np.array([*self.firsts, self.n_ids], "<u8").tobytes())
        self.stream.write(np.array([len(self.offsets) - 1, len(self.keys), self.n_ids, self.offsets[-1]], "<u8").tobytes())
        self.stream.close()


class Reader:
    """Random access to one file: the documents' table is held, blocks are read when asked for."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source = source
        size = source.size()
        if source.read_at(8, 0) != MAGIC:
            raise ValueError("not a packed id file")
        self.bits, self.block_ids = (int(x) for x in np.frombuffer(source.read_at(8, 8), "<u4"))
        self.n_blocks, self.n_docs, self.n_ids, at = (int(x) for x in np.frombuffer(source.read_at(32, size - 32), "<u8"))
        tail = source.read_at(size - 32 - at, at)
        self.offsets = np.frombuffer(tail, "<u8", self.n_blocks + 1).astype(np.int64)
        at = 8 * (self.n_blocks + 1)
        self.keys = np.frombuffer(tail, "<i8", self.n_docs, at)
        self.nulls = np.frombuffer(tail, np.uint8, self.n_docs, at + 8 * self.n_docs).astype(bool)
        self.firsts = np.frombuffer(tail, "<u8", self.n_docs + 1, at + 9 * self.n_docs).astype(np.int64)
        self._at, self._block = -1, np.zeros(0, np.uint32)

    def block(self, k: int) -> np.ndarray:
        if k != self._at:
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            a, b = int(self.offsets[k]), int(self.offsets[k + 1])
            self._at, self._block = k, unpack(self.source.read_at(b - a, a), n, self.bits)
        return self._block

    def ids(self, start: int, end: int) -> Iterator[np.ndarray]:
        """The ids of [start, end), a part of a block at a time."""
        while start < end:
            k, inside = divmod(start, self.block_ids)
            part = self.block(k)[inside : inside + end - start]
            yield part
            start += len(part)


def _write(folder: str, tokenizer: str, pieces: str, end: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        system, root = fs.FileSystem.from_uri(folder)
        path, writer, ids_of = f"{root}/{shard:08d}-{uuid.uuid4().hex}.ids", None, encoder(tokenizer, pieces)
        for batch in batches:
            for key, ids in zip(batch.column("doc_id").to_pylist(), ids_of.encode_all(batch.column("text"))):
                if writer is None:
                    system.create_dir(root, recursive=True)
                    writer = Writer(system.open_output_stream(path, compression=None), bits)
                writer.add(key, np.append(ids, np.uint32(end)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([path]), pa.array([len(writer.keys)], pa.int64()), pa.array([writer.n_ids], pa.int64())], ["shard", "path", "n_docs", "n_ids"])

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, path, base in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "base"))):
                with system.open_input_file(path) as source:
                    file = Reader(source)
                    for at in range(0, file.n_docs, 4096):
                        until = min(at + 4096, file.n_docs)
                        sums = []
                        for a, b in zip(file.firsts[at:until].tolist(), file.firsts[at + 1 : until + 1].tolist()):
                            crc = 0
                            for part in file.ids(a, b):
                                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        starts = file.firsts[at : until + 1]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(file.keys[at:until], pa.int64(), mask=file.nulls[at:until]), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(sums, pa.int64()),
                                pa.array([shard] * (until - at), pa.int64()), pa.array(starts[:-1] // file.block_ids), pa.array([file.bits] * (until - at), pa.int32()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "block", "bits"],
                        )

    return run


def write_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "word_bpe_49k.json", pieces: str = "words", end_id: int = 2, shards: int | None = None) -> tuple[DataFrame, str]:
    """Writes the files; returns their manifest (shard, path, n_docs, n_ids, base: ids of all files before) and folder."""
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    bits = width_of(max(Tokenizer.from_file(vocabulary(tokenizer)).get_vocab_size(), end_id + 1))
    folder = new_path(spark, "ids")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = narrow.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    manifest, _ = stored(ordered.mapInArrow(_write(folder, tokenizer, pieces, end_id, bits), "shard long, path string, n_docs long, n_ids long"), "manifest")
    # one row a file, so a single task may order them
    base = F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    return manifest.withColumn("base", F.coalesce(base, F.lit(0))), folder


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, block, bits for each document of the files."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("shard", "path", "base").repartition(n).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, block long, bits int")
