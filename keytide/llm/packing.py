"""Order-preserving packing by dynamic programming with monotone-queue transitions.

Documents, each ended by its end id, follow each other in the order of their partition. A sequence is a run of at most
`length` ids of that stream. Its cost is its padding, up to `length` (none where its length is a power of two), plus
the price of the cut at its end: nothing at the end of a document, `sentence_price` at the end of a sentence,
`cut_price` elsewhere. Cut places are document ends, sentence ends, and, in runs without either, every `stride`
ids. The least cost up to a place i is min over places j in [i - length, i) of cost(j) + j, plus length - i, plus the price at
i; places leave and enter the window in order, so a monotone queue yields each minimum in constant time. Lengths that
are a power of two are tried at every place, from pairs of places found by array lookups before.

The stream is packed in blocks of about `block` ids, so memory is bounded whatever a partition or document holds; a
document may go on in the next block. No shuffle: a partition packs its own rows, and sequence_id is
partition * 2^33 + number. Rows need a stable order within their partitions, as a file scan or a sorted table has.

Defined results: a null text is empty and gives the end id alone; repeated rows are packed each; null ids pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from keytide.llm.tokens import encoder

BLOCK = 1 << 19


def _by_powers(places: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Numbers of the places that lie a power of two below length before each place, nearest first; where each place's end."""
    number = np.full(int(places[-1]) + 1, -1, np.int32)
    number[places] = np.arange(len(places), dtype=np.int32)
    later, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for p in [1 << k for k in range((length - 1).bit_length())]:
        first = int(np.searchsorted(places, p))
        k = number[places[first:] - p]
        held = np.flatnonzero(k >= 0)
        later.append(held + first)
        before.append(k[held])
    at = np.concatenate(later)
    return np.concatenate(before)[np.argsort(at, kind="stable")].tolist(), np.cumsum(np.bincount(at, minlength=len(places))).tolist()


def cut(places: np.ndarray, prices: np.ndarray, length: int = 1024) -> list[int]:
    """Cut places of least cost. places: ascending, from 0 to the end, gaps at most length; prices: of a cut there."""
    before, stops = _by_powers(places, length)
    where, price = places.tolist(), prices.tolist()
    n = len(where)
    best, came = [0.0], [0]
    # numbers of places in the window with ascending cost + place, and that sum; the first is the window's minimum
    queue, keys, head = [0], [0.0], 0
    j, low_key, leaves = 0, 0.0, length
    c = stops[0]
    for i, (at, stop, fee) in enumerate(zip(where[1:], stops[1:], price[1:]), 1):
        while leaves < at:
            head += 1
            j, low_key = queue[head], keys[head]
            leaves = where[j] + length
        low, source = low_key + length - at, j
        if stop != c:
            for k in before[c:stop]:
                if best[k] < low:
                    low, source = best[k], k
            c = stop
        low += fee
        best.append(low)
        came.append(source)
        key = low + at
        while keys[-1] >= key:
            queue.pop()
            keys.pop()
            if len(keys) == head:
                j, low_key, leaves = i, key, at + length
                break
        queue.append(i)
        keys.append(key)
    out, i = [], n - 1
    while i > 0:
        out.append(where[i])
        i = came[i]
    return [0, *out[::-1]]


def _merged(*places: np.ndarray | list[int]) -> np.ndarray:
    """All places once, ascending."""
    held = np.zeros(max(int(p[-1]) for p in places if len(p)) + 1, bool)
    for p in places:
        held[np.asarray(p, np.int64)] = True
    return np.flatnonzero(held)


def candidates(ends: np.ndarray, sentences: np.ndarray, stride: int, sentence_price: float, cut_price: float) -> tuple[np.ndarray, np.ndarray]:
    """Cut places and prices from document ends (the last is the stream's) and sentence ends."""
    known = _merged(ends, sentences, [0])
    gaps = np.diff(known)
    inner = (gaps - 1) // stride
    base = np.repeat(known[:-1], inner)
    rank = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner)
    places = _merged(known, base + (rank + 1) * stride)
    prices = np.full(len(places), float(cut_price))
    prices[np.searchsorted(places, sentences)] = sentence_price
    prices[np.searchsorted(places, ends)] = 0.0
    return places, prices


def _sentence_ids(name: str) -> np.ndarray:
    """Which ids end a sentence: their text ends with . ! ? or holds a line break."""
    library = encoder(name, "spaces").library
    size = library.get_vocab_size()
    texts = library.decode_batch([[i] for i in range(size)], skip_special_tokens=False)
    return np.array([x.rstrip().endswith((".", "!", "?")) or "\n" in x for x in texts])


_PIECES = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
_tables: dict[str, np.ndarray] = {}


def _packer(name: str, end: int, length: int, stride: int, sentence_price: float, cut_price: float, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _tables:
            _tables[name] = _sentence_ids(name)
        ends_sentence, ids_of = _tables[name], encoder(name, "spaces")
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

        def packed(held: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            """held: (doc_id, first id's place in the document, ids, ids of the whole document)."""
            nonlocal number
            stream = np.concatenate([x[2] for x in held])
            edges = np.cumsum([len(x[2]) for x in held])
            places, prices = candidates(edges, np.flatnonzero(ends_sentence[stream]) + 1, stride, sentence_price, cut_price)
            cuts = np.array(cut(places, prices, length))
            marks = _merged(cuts, [0], edges)
            a, b = marks[:-1], marks[1:]
            doc, seq = np.searchsorted(edges, a, "right"), np.searchsorted(cuts, a, "right") - 1
            firsts = np.concatenate([[0], edges[:-1]])
            start = a - firsts[doc] + np.array([x[1] for x in held], np.int64)[doc]
            raw = memoryview(stream.astype("<u4").tobytes())
            spans = [raw[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist())]
            columns = [pa.array([held[d][0] for d in doc], id_type), pa.array(start), pa.array(b - a), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
            columns += [pa.array(np.array([x[3] for x in held], np.int64)[doc]), pa.array(seq + number), pa.array(a - cuts[seq])]
            number += len(cuts) - 1
            names = ["doc_id", *[n for n, _ in _PIECES]]
            if with_ids:
                columns, names = [*columns, pa.array([x.tobytes() for x in spans], pa.binary())], [*names, "ids"]
            return pa.RecordBatch.from_arrays(columns, names)

        held, size, kind = [], 0, pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for key, found in zip(batch.column(0).to_pylist(), ids_of.encode_all(batch.column(1))):
                ids = np.append(found, np.uint32(end))
                total, at = len(ids), 0
                while at < total:
                    take = min(total - at, BLOCK - size)
                    held.append((key, at, ids[at : at + take], total))
                    at, size = at + take, size + take
                    if size >= BLOCK:
                        yield packed(held, kind)
                        held, size = [], 0
        if held:
            yield packed(held, kind)

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, length: int = 1024,
    stride: int = 16, sentence_price: float = 2.0, cut_price: float = 12.0, with_ids: bool = True,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with with_ids the ids as bytes."""
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = StructType([narrow.schema["doc_id"]])
    for name, _ in _PIECES:
        schema = schema.add(name, "long")
    if with_ids:
        schema = schema.add("ids", "binary")
    return narrow.mapInArrow(_packer(tokenizer, end_id, length, stride, sentence_price, cut_price, with_ids), schema)
