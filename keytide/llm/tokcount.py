"""Token counts by heap-and-linked-list byte-pair merging, without identifiers.

A text is cut at special strings, then by the vocabulary's split pattern. The bytes of a piece are a doubly linked
list; a heap holds its adjacent pairs by rank, then place. The lowest is popped, stale entries are
passed over, the pair is merged, and its two new neighbours are pushed. Each merge takes one symbol away, so the count is
the bytes less the merges. Counts of short pieces are kept by the worker, at most CACHE of them.

Defined results: a null text is empty and has no tokens; special strings of the file count as one token each; a file with
other settings than a byte-level vocabulary's is refused.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from keytide.llm.tokens import byte_letters, pieces_spaces, shape, vocabulary

CACHE = 600_000
#: Longest piece that is kept.
SHORT = 64


class Counter:
    def __init__(self, name: str) -> None:
        import public_tokenizers
        import regex

        with open(vocabulary(name), encoding="utf-8") as f:
            file = json.load(f)
        if shape(file) != "spaces":
            raise ValueError("counts need a byte-level vocabulary with the usual split pattern and no normalizer")
        code = {v: bytes([k]) for k, v in byte_letters().items()}
        raw = lambda s: b"".join(code[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.split = regex.compile(public_tokenizers.PATTERN)
        special = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.firsts = sorted({t[0] for t in special})
        self.known: dict[str, int] = {}

    def merged(self, data: bytes) -> int:
        """Symbols left of a piece when no pair merges any more."""
        n, ranks = len(data), self.ranks
        symbol: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, pair) for i in range(n - 1) if (r := ranks.get(pair := (symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbol[i] != pair[0] or symbol[j] != pair[1]:
                continue
            symbol[i], symbol[j] = pair[0] + pair[1], None
            k, h = after[j], before[i]
            after[i] = k
            merges += 1
            if k < n:
                before[k] = i
                pair = (symbol[i], symbol[k])
                if (r := ranks.get(pair)) is not None:
                    heapq.heappush(heap, (r, i, pair))
            if h >= 0:
                pair = (symbol[h], symbol[i])
                if (r := ranks.get(pair)) is not None:
                    heapq.heappush(heap, (r, h, pair))
        return n - merges

    def plain(self, text: str) -> int:
        return sum(self.merged(x.encode()) for x in self.split.findall(text))

    def count(self, text: str) -> int:
        if self.special is not None and any(c in text for c in self.firsts):
            found = self.special.findall(text)
            if found:
                return len(found) + sum(map(self.segment, self.special.split(text)))
        return self.segment(text)

    def segment(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total, known = 0, self.known
        for x in pieces_spaces(text):
            n = known.get(x)
            if n is None:
                n = self.plain(x)
                if len(x) <= SHORT:
                    if len(known) >= CACHE:
                        known.clear()
                    known[x] = n
            total += n
        return total


_counters: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    """This worker's counter."""
    if name not in _counters:
        _counters[name] = Counter(name)
    return _counters[name]


def _count(name: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name).count
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            n = [count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; no shuffle."""
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = StructType([narrow.schema["doc_id"]]).add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return narrow.mapInArrow(_count(tokenizer, limit), schema)
