"""The pipeline against a plain version of its five stages, and the queries' registration."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
from test_documents import WORD, alike, ids_of, plain_quality, rows_of

import __spark_entry__ as entry
import corpus_pipeline


def plain_pipeline(rows):
    """(doc_id, ids) of what is packed, without any code of the package."""
    rows = [r | {"text": clean} for r, (_, _, kept, clean) in zip(rows, plain_quality(rows, True)) if kept]
    first = {}
    for r, c in zip(rows, alike([r["text"] for r in rows])):
        if c not in first or r["doc_id"] < first[c]["doc_id"]:
            first[c] = r
    rows = list(first.values())
    docs = [WORD.findall(r["text"] or "") for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in docs for i in range(len(w) - 34))
    left = []
    for r, w in zip(rows, docs):
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        if any(keep) or not w:
            import re

            text = r["text"] if all(keep) else "".join(x for x, k in zip(re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", r["text"]), keep) if k)
            left.append(r | {"text": text})
    sizes = defaultdict(int)
    for r in left:
        r["size"] = len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += r["size"]
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while free:
        rest = 1.5 * sum(sizes.values()) - sum(target.values())
        fair = {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if fair[s] > 2 * sizes[s]}
        if not over:
            target |= fair
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    out = []
    for s in order:
        own = sorted((r for r in left if r["source"] == s), key=lambda r: (hashlib.md5(f"42:{'' if r['doc_id'] is None else r['doc_id']}:{s or ''}".encode()).hexdigest(), r["doc_id"], r["size"]))
        whole = target[s] // sizes[s] if sizes[s] else 0
        part, at = target[s] - whole * sizes[s], 0
        for r in own:
            copies = int(whole) + (part > 0 and at + r["size"] / 2 <= part) if sizes[s] else 0
            at += r["size"]
            out += [(r["doc_id"], r["text"] or "")] * copies
    ids = ids_of("byte_bpe_50k.json", [t for _, t in out])
    return Counter((d, tuple(i + [0])) for (d, _), i in zip(out, ids))


def test_pipeline(spark, odd, tmp_path):
    docs = odd.where("doc_id is not null").coalesce(2)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_pipeline(rows_of(docs))
    parts = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    sequences = defaultdict(list)
    for r in parts:
        sequences[r["sequence_id"]].append(r)
    # copies of a document have equal rows: whole documents are put together in order of the sequences
    held, got = defaultdict(list), Counter()
    for s in sorted(sequences):
        for r in sorted(sequences[s], key=lambda r: r["offset"]):
            ids = list(np.frombuffer(r["ids"], "<u4"))
            key = r["doc_id"]
            assert r["start"] == len(held[key])
            held[key] += ids
            if len(held[key]) == r["doc_tokens"]:
                got[key, tuple(held.pop(key))] += 1
    assert got == want and not any(held.values())


def test_stages_keep_columns(spark, odd, clashing):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clashing, "").columns == clashing.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "substring dedup", "mixing", "packing"]


def test_empty_pipeline(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
