"""Sets of hashes that go from tasks to buckets and back, packed, and read by the task that asked.

A task of the stored documents (column `task`) sends the hashes it holds, sorted, distinct and packed, to buckets
of the hash range. A bucket sees all tasks' hashes together and answers each task with those that matter. The
answers lie in a table of the shared folder, one directory a task, and are read by that task alone; a task that
is run again, on any executor, reads the same answers. Nothing here grows with a hot value: a task sends each
value once for every HOLD values. A bucket keeps its blobs packed and unpacks CHUNK values at a time.

Values have up to 8 bytes, or 16: then `low` holds their other half, and both decide.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame

from keytide.llm.common import new_path

BLOB = "task long, bucket long, blob binary"
#: Values that a task gathers before it sends them, and that a bucket unpacks at once.
HOLD = 1 << 22
CHUNK = 1 << 22


class Values:
    """Values in ascending order, their other halves (for 16 bytes) and a flag byte each."""

    def __init__(self, high: np.ndarray, low: np.ndarray | None = None, flags: np.ndarray | None = None) -> None:
        self.high, self.low = high, low
        self.flags = np.zeros(len(high), np.uint8) if flags is None else flags

    def __len__(self) -> int:
        return len(self.high)

    def __getitem__(self, at) -> Values:
        return Values(self.high[at], None if self.low is None else self.low[at], self.flags[at])

    @staticmethod
    def joined(parts: list[Values]) -> Values:
        low = None if parts[0].low is None else np.concatenate([p.low for p in parts])
        return Values(np.concatenate([p.high for p in parts]), low, np.concatenate([p.flags for p in parts]))

    def runs(self) -> tuple[Values, np.ndarray]:
        """All values in order, and where each distinct one starts. High halves decide the order where they differ, as they nearly always do."""
        order = np.argsort(self.high, kind="stable")
        new = np.diff(self.high[order], prepend=self.high[order[:1]] ^ np.uint64(1)) != 0
        if self.low is not None:
            changes = np.diff(self.low[order], prepend=self.low[order[:1]]) != 0
            if (changes & ~new).any():
                order = np.lexsort((self.low, self.high))
                new = np.diff(self.high[order], prepend=self.high[order[:1]] ^ np.uint64(1)) != 0
                changes = np.diff(self.low[order], prepend=self.low[order[:1]]) != 0
            new |= changes
        return self[order], np.flatnonzero(new)

    def distinct(self) -> Values:
        """Each value once; flags or-ed, and 2 added where a value comes twice or more."""
        if not len(self):
            return self
        values, starts = self.runs()
        many = (np.diff(starts, append=len(values)) > 1).astype(np.uint8) * 2
        out = values[starts]
        out.flags = np.bitwise_or.reduceat(values.flags, starts) | many
        return out

    def member(self, high: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
        """Which of the given values are among these."""
        if not len(self):
            return np.zeros(len(high), bool)
        at, last = np.searchsorted(self.high, high), len(self) - 1
        found = self.high[np.minimum(at, last)] == high
        if self.low is None:
            return found
        left = np.flatnonzero(found)
        found[:] = False
        while len(left):
            here = at[left]
            hit = self.low[here] == low[left]
            found[left[hit]] = True
            left = left[~hit & (here < last)]
            at[left] += 1
            left = left[self.high[at[left]] == high[left]]
        return found


def pack(values: Values, width: int) -> bytes:
    """Counts by the leading two bytes, then planes of the other bytes, the other halves, and flags if any is set."""
    kept = min(width, 8) - 2
    bins = (values.high >> np.uint64(8 * kept)).astype(np.int64)
    first = int(bins[0]) if len(bins) else 0
    counts = np.bincount(bins - first).astype("<u4")
    planes = values.high.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :kept]
    marked = np.flatnonzero(values.flags).astype("<u4")
    head = np.array([len(values), first, len(counts), len(marked)], "<u4")
    low = b"" if values.low is None else values.low.astype("<u8").tobytes()
    return b"".join([head.tobytes(), counts.tobytes(), planes.T.tobytes(), low, marked.tobytes(), values.flags[marked].tobytes()])


class Packed:
    """A blob of pack(), unpacked by ranges of bins."""

    def __init__(self, blob: bytes, width: int) -> None:
        self.blob, self.width, self.kept = blob, width, min(width, 8) - 2
        self.n, self.first, n_counts, self.n_marked = (int(x) for x in np.frombuffer(blob, "<u4", 4))
        self.counts = np.frombuffer(blob, "<u4", n_counts, 16)
        self.at = 16 + 4 * n_counts

    def values(self, low: int = 0, high: int = 1 << 16) -> Values:
        a, b = (min(max(x - self.first, 0), len(self.counts)) for x in (low, high))
        before, counts = int(self.counts[:a].sum()), self.counts[a:b]
        n, at = int(counts.sum()), self.at + before
        out = np.repeat(np.arange(self.first + a, self.first + b, dtype=np.uint64), counts) << np.uint64(8 * self.kept)
        for k in range(self.kept):
            out |= np.frombuffer(self.blob, np.uint8, n, at + k * self.n).astype(np.uint64) << np.uint64(8 * k)
        end = self.at + self.n * self.kept
        other = None
        if self.width > 8:
            other = np.frombuffer(self.blob, "<u8", n, end + 8 * before)
            end += 8 * self.n
        flags = np.zeros(n, np.uint8)
        marked = np.frombuffer(self.blob, "<u4", self.n_marked, end).astype(np.int64)
        held = (marked >= before) & (marked < before + n)
        flags[marked[held] - before] = np.frombuffer(self.blob, np.uint8, self.n_marked, end + 4 * self.n_marked)[held]
        return Values(out, other, flags)


def deal(values: Values, width: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) for values in order, by equal ranges of their leading four bytes."""
    at = ((values.high >> np.uint64(8 * min(width, 8) - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(at, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(values)]):
        yield int(at[a]), pack(values[a:b], width)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["task", "bucket", "blob"])


def _batches(rows: Iterator[tuple[int, int, bytes]], most: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= most:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def send(found: Iterator[tuple[int, Values]], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Batches of BLOB for the values that a task finds, part by part; parts of one task are gathered up to HOLD values."""

    def rows() -> Iterator[tuple[int, int, bytes]]:
        held: list[Values] = []
        task = size = 0
        for now, values in found:
            if held and (now != task or size >= HOLD):
                yield from ((task, b, blob) for b, blob in deal(Values.joined(held).distinct(), width, buckets))
                held, size = [], 0
            task, size = now, size + len(values)
            held.append(values)
        if held:
            yield from ((task, b, blob) for b, blob in deal(Values.joined(held).distinct(), width, buckets))

    return _batches(rows())


def _spans(blobs: list[Packed]) -> Iterator[tuple[int, int]]:
    """Ranges of bins with about CHUNK values of all blobs each."""
    total = np.zeros(1 << 16, np.int64)
    for b in blobs:
        total[b.first : b.first + len(b.counts)] += b.counts
    low, size = 0, 0
    for at in np.flatnonzero(total).tolist():
        if size and size + total[at] > CHUNK:
            yield low, at
            low, size = at, 0
        size += int(total[at])
    if size:
        yield low, 1 << 16


def _answer(bucket: int, held: list[tuple[int, Packed]], width: int, need: int) -> Iterator[tuple[int, int, bytes]]:
    for low, high in _spans([b for _, b in held]):
        parts = [(t, v) for t, v in ((t, b.values(low, high)) for t, b in held) if len(v)]
        values, starts = Values.joined([v for _, v in parts]).runs()
        any_flag = np.bitwise_or.reduceat(values.flags, starts)
        counts = np.diff(starts, append=len(values))
        found = values[starts[((counts > 1) | (any_flag & 2 > 0)) & (any_flag & need == need)]]
        del values, starts, any_flag, counts
        for task, v in parts:
            hit = v[found.member(v.high, v.low)]
            if len(hit):
                hit.flags = np.zeros(len(hit), np.uint8)
                yield task, bucket, pack(hit, width)


def _settle(batches: Iterator[pa.RecordBatch], width: int, need: int) -> Iterator[pa.RecordBatch]:
    """Answers of the buckets of a partition, whose rows are in order of the bucket."""

    def rows() -> Iterator[tuple[int, int, bytes]]:
        bucket, held = None, []
        for batch in batches:
            for task, b, blob in zip(*(batch.column(c).to_pylist() for c in ("task", "bucket", "blob"))):
                if b != bucket:
                    yield from _answer(bucket, held, width, need)
                    bucket, held = b, []
                held.append((task, Packed(blob, width)))
        yield from _answer(bucket, held, width, need)

    return _batches(rows())


def answers(sent: DataFrame, width: int, need: int, buckets: int, label: str) -> str:
    """Path of the answers: of each task's values, those that occur twice or more in all, and, where need is 1, hold flag 1 somewhere.

    Flag 2 on a value says that the task holds it twice or more.
    """
    settle: Callable = partial(_settle, width=width, need=need)
    path = new_path(sent.sparkSession, label)
    back = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(settle, BLOB)
    back.repartition("task").write.partitionBy("task").option("compression", "none").parquet(path)
    return path


def read_answer(path: str, task: int, width: int) -> Values:
    """The values that the buckets sent back to a task, in order."""
    system, root = fs.FileSystem.from_uri(path)
    folder = posixpath.join(root, f"task={task}")
    none = Values(np.zeros(0, np.uint64), np.zeros(0, np.uint64) if width > 8 else None)
    if system.get_file_info(folder).type == fs.FileType.NotFound:
        return none
    files = [x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.path.endswith(".parquet")]
    parts = [Packed(b, width).values() for f in files for b in pq.read_table(f, filesystem=system, columns=["blob"], partitioning=None)["blob"].to_pylist()]
    return Values.joined(parts).distinct() if parts else none
