"""The operators over documents against brute force, on odd rows, with clashing columns and on empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash

from keytide.llm import blockdedup, idpack, interleave, licenses, linefreq, mixture, packing, sideload, signatures, simhash, tokcount
from keytide.llm.tokens import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def bag(rows, names):
    return Counter(tuple(r[n] for n in names) for r in rows)


def ids_of(name, texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(vocabulary(name)).encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


OPERATORS = {
    "quality": lambda d: linefreq.judge(d), "quality rows": lambda d: linefreq.judge(d, keep_rows=True), "media": interleave.of_documents,
    "near": lambda d: simhash.near_duplicates(d), "near rows": lambda d: simhash.near_duplicates(d, keep_rows=True), "similar": lambda d: simhash.near_duplicates(d, shingle=5, similarity=0.8), "similar rows": lambda d: simhash.near_duplicates(d, shingle=5, similarity=0.8, keep_rows=True), "substring": lambda d: blockdedup.remove_repeats(d),
    "substring rows": lambda d: blockdedup.remove_repeats(d, keep_rows=True), "mix": lambda d: mixture.mix(d), "mix rows": lambda d: mixture.mix(d, keep_rows=True), "count": tokcount.token_counts,
    "pack": lambda d: packing.pack(d), "licenses": licenses.scan, "ids": lambda d: idpack.read_ids(*idpack.write_ids(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(name, empty):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(name, odd, clashing):
    plain, other = OPERATORS[name](odd), OPERATORS[name](clashing)
    drop = [c for c in plain.columns if c in ("row", "rid", "sequence_id", "spans", "detections")]
    assert plain.columns == other.columns
    assert Counter(map(str, plain.drop(*drop).collect())) == Counter(map(str, other.drop(*drop).collect()))


def base_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    again = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(5)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), n < 10 or 100 * len(again) > 20 * n


def plain_quality(rows, copies_once):
    """(n_frequent_lines, n_words_left, kept, clean text) of each row, by dictionaries."""
    norm = lambda x: re.sub(r"[\x20\x09\x0B-\x0D]+", " ", x.lower()).strip(" ")
    held, total = defaultdict(set), defaultdict(set)
    for k, r in enumerate(rows):
        document = (r["text"] or "") if copies_once else k
        total[r["source"]].add(document)
        for line in filter(None, map(norm, (r["text"] or "").split("\n"))):
            held[r["source"], line].add(document)
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        gone = [bool(norm(x)) and len(held[r["source"], norm(x)]) > max(5, 0.05 * len(total[r["source"]])) for x in lines]
        n, *_, failed = base_counts(r["text"])
        left = n - sum(len(norm(x).split(" ")) for x, g in zip(lines, gone) if g)
        clean = r["text"] if not any(gone) else "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((sum(gone), left, not failed and not (any(gone) and (left < 10 or left < 0.3 * n)), clean))
    return out


def test_quality_counts(odd):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = rows_of(linefreq.judge(odd))
    assert bag(got, names) == Counter((r["doc_id"], *base_counts(r["text"])) for r in rows_of(odd))


@pytest.mark.parametrize("copies_once", [True, False])
def test_frequent_lines(odd, copies_once):
    rows = rows_of(odd)
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, plain_quality(rows, copies_once)))
    got = rows_of(linefreq.judge(odd, copies_once=copies_once, keep_rows=True))
    assert bag(got, ["doc_id", "n_frequent_lines", "n_words_left", "kept", "clean_text"]) == want and all(r["row"]["doc_id"] == r["doc_id"] for r in got)
    assert sum(r["n_frequent_lines"] for r in got) >= 12


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(rows):
    """Smallest doc_id of each component, by all pairs."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            r = find(f)
            least[r] = min(d, least.get(r, d))
    return [(d, f"{f:016x}", least.get(find(f))) for d, f in rows]


def test_near_duplicates(odd):
    got = rows_of(simhash.near_duplicates(odd))
    want = classes([(r["doc_id"], fingerprint(r["text"])) for r in rows_of(odd)])
    assert bag(got, ["doc_id", "fingerprint", "component_id"]) == Counter(want)


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("heavy", [2048, 3])
def test_links_within_each_distance(spark, heavy, distance):
    r = np.random.default_rng(8)
    fps = sorted({0x0F0F1234 ^ (1 << int(i)) ^ (1 << int(j)) for i, j in r.integers(0, 64, (60, 2))})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = {x.node: x.root for x in simhash.components(*simhash.links(df, 16, distance, heavy)).collect()}
    root = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            root[a] = min([root[b] for b in fps if (a ^ b).bit_count() <= distance])
    own = [found.get(s, s) for s in (int(np.uint64(f).view(np.int64)) for f in fps)]
    assert all((own[i] == own[j]) == (root[a] == root[b]) for i, a in enumerate(fps) for j, b in enumerate(fps))


@pytest.mark.parametrize(("segments", "heavy"), [(32, 2048), (32, 3), (8, 2048), (4, 50)])
def test_links_are_all_found(spark, segments, heavy):
    """Random fingerprints, dense balls and long chains; with heavy cells as well."""
    r = np.random.default_rng(3)
    fps = {int(x) for x in r.integers(0, 1 << 64, 300, dtype=np.uint64)} | {0, 1, 3, (1 << 64) - 1, 1 << 63}
    centre = 0x123456789ABCDEF0
    fps |= {centre ^ (1 << int(i)) ^ (1 << int(j)) for i, j in r.integers(0, 64, (200, 2))}
    chain = 0xFFFF0000FFFF0000
    for k in range(25):
        chain ^= 3 << 2 * (k % 32)
        fps.add(chain)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {x.node: x.root for x in simhash.components(*simhash.links(df, segments, heavy=heavy)).collect()}
    groups = defaultdict(set)
    for f, s in zip(fps, signed):
        groups[found.get(s, s)].add(f)
    want = defaultdict(set)
    for (d, f, c) in classes([(k, f) for k, f in enumerate(fps)]):
        want[c].add(int(f, 16))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def alike(texts, size=5, least=0.8):
    """Smallest place of each text's component under the exact similarity of its sets of shingles, by all pairs."""
    words = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in words]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if words[i] == words[j] or (a and b and len(a & b) >= least * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_similar_texts(spark, odd, docs_schema):
    import random

    r = random.Random(11)
    vocabulary = [f"v{k}" for k in range(2000)]
    texts = [x["text"] for x in rows_of(odd)]
    for n, changes in ((60, 1), (200, 2), (200, 4), (400, 6), (400, 12), (400, 40), (30, 3)):
        base = [r.choice(vocabulary) for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for k in r.sample(range(n), changes):
                copy[k] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    # a chain whose ends are far apart, and a crowd around a text that only its centre joins
    chain = [r.choice(vocabulary) for _ in range(300)]
    for k in range(10):
        chain = [*chain[6:], *(r.choice(vocabulary) for _ in range(6))]
        texts.append(" ".join(chain).upper())
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], docs_schema).repartition(3)
    want = alike(texts)
    got = rows_of(simhash.near_duplicates(df, shingle=5, similarity=0.8, keep_rows=True))
    assert {x["doc_id"]: x["component_id"] for x in got} == dict(enumerate(want))
    assert Counter(x["component_id"] for x in got if x["first"]) == Counter(set(want)) and len(set(want)) < len(texts) - 20


@pytest.mark.parametrize("buckets", [{}, {"bands": 1, "rows": 40}])
def test_no_similar_text_is_left(spark, docs_schema, buckets):
    """Texts that hang on one of a crowd each, and pairs at 0.8 and just below; also with buckets that bring next to nothing."""
    import random

    r = random.Random(5)
    vocabulary = [f"v{k}" for k in range(3000)]

    def changed(base, n):
        copy = list(base)
        for k in r.sample(range(len(copy)), n):
            copy[k] = r.choice(vocabulary)
        return copy

    centre = [r.choice(vocabulary) for _ in range(200)]
    crowd = [changed(centre, 4) for _ in range(70)]
    texts = [" ".join(w) for w in (centre, *crowd, *(changed(w, 4) for w in crowd[:40]))]
    for _ in range(10):
        short = [r.choice(vocabulary) for _ in range(12)]
        texts += [" ".join(short), " ".join([*short, "x", "y"]), " ".join(["a", "b", "c", *short])]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], docs_schema).repartition(3)
    got = rows_of(simhash.near_duplicates(df, shingle=5, similarity=0.8, **buckets))
    want = alike(texts)
    assert {x["doc_id"]: x["component_id"] for x in got} == dict(enumerate(want)) and Counter(want)[0] > 80


def test_first_shingles_meet():
    """Two sets of a similarity share one of their first shingles, in any order; rows come out where a token has several texts."""
    import pyarrow as pa

    from keytide.llm import similar

    r = np.random.default_rng(2)
    for _ in range(300):
        both, only = int(r.integers(1, 60)), int(r.integers(0, 20))
        ids = r.choice(1 << 40, both + only, replace=False).astype(np.uint64)
        cut = int(r.integers(0, only + 1))
        x, y = np.sort(np.concatenate([ids[:both], ids[both : both + cut]])), np.sort(np.concatenate([ids[:both], ids[both + cut :]]))
        order = r.integers(0, 4, similar.CELLS).astype(np.uint8)
        met = set(similar.first_shingles(x, order, 0.8)) & set(similar.first_shingles(y, order, 0.8))
        assert met or both < 0.8 * (both + only)
    rows = sorted((int(t), int(k)) for t, k in zip(r.integers(0, 40, 120), r.integers(0, 3, 120)))
    table = pa.table({"token": [t for t, _ in rows], "kid": [k for _, k in rows], "n": [1] * 120, "at": [0] * 120})
    for size in (1, 2, 7, 200):
        out = pa.Table.from_batches(list(similar._shared(iter(table.to_batches(max_chunksize=size)))), table.schema)
        many = {t for t in range(40) if len({k for u, k in rows if u == t}) > 1}
        assert list(zip(out["token"].to_pylist(), out["kid"].to_pylist())) == sorted({x for x in rows if x[0] in many})


@pytest.mark.parametrize("smaller", [False, True])
def test_crowds_below_the_similarity_meet_in_few_rows(spark, monkeypatch, smaller):
    """Sets of about one size around a common one: rows and pairs stay few, and none that is alike is lost."""
    from keytide.llm import similar

    r = np.random.default_rng(9)
    base = r.choice(1 << 40, 146, replace=False).astype(np.uint64)
    sets = []
    for k in range(420):
        # most have more shingles of their own than two alike sets of that size; the others are near 0.8 of each other
        own = int(r.integers(18, 29)) if k < 360 else int(r.integers(4, 17))
        left = r.choice(base, 146 - own, replace=False)
        sets.append(np.unique(np.concatenate([left, r.choice(1 << 40, own + int(r.integers(-2, 3)), replace=False).astype(np.uint64)])))
    if smaller:
        # sizes from 0.8 of the common set on
        sets += [np.sort(base), *(np.sort(r.choice(base, n, replace=False)) for n in (116, 117, 118, 130, 145))]
    bits = [similar.parities(x) for x in sets]
    want = {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if similar.jaccard(x, y) >= 0.8}
    apart = lambda x: int(np.bitwise_count(x.view(np.uint64)).sum())
    assert all(apart(bits[i] ^ bits[j]) <= len(np.setxor1d(sets[i], sets[j])) for i, j in r.integers(0, len(sets), (300, 2)))
    counts, stored = {}, similar.stored

    def counting(df, label, codec="zstd"):
        table, path = stored(df, label, codec)
        counts[label] = table.count()
        return table, path

    monkeypatch.setattr(similar, "stored", counting)
    table = spark.createDataFrame([(k, similar.packed(x)) for k, x in enumerate(sets)], "kid long, grams binary").repartition(3)
    names = spark.createDataFrame([(k, k, k, bits[k].tolist()) for k in range(len(sets))], "kid long, cid long, root long, odd array<long>")
    left = [(x.a, x.b) for x in similar.left_over(table.union(table), names, 0.8).collect()]
    assert len(left) == len(set(left)) and want <= set(left) and len(want) > 200
    # rows by 0.2 of the shingles, whatever the sizes: 3749, which make 447,684 rows in pairs
    assert len(left) < 1.5 * len(want) and (smaller or counts["open"] < 600)


def test_sets_and_band_keys():
    from keytide.llm import similar

    r = np.random.default_rng(1)
    a = similar.shingles([b"w%d" % x for x in r.integers(0, 999, 3000)], 5)
    assert (similar.unpacked(similar.packed(a)) == a).all() and len(similar.shingles([], 5)) == 0 and len(similar.shingles([b"x"], 5)) == 1
    seeds = similar._seeds(256, 42)
    shared = []
    for s in (0.8, 0.5):
        n = 2000
        both = r.integers(0, 1 << 48, n, dtype=np.uint64)
        rest = int(n * (1 - s) / (2 * s))
        x, y = (np.unique(np.concatenate([both, r.integers(0, 1 << 48, rest, dtype=np.uint64)])) for _ in range(2))
        assert similar.jaccard(x, y) == pytest.approx(s, abs=0.01)
        shared.append(sum(p == q for p, q in zip(similar.band_keys(x, 256, 1, seeds)[0], similar.band_keys(y, 256, 1, seeds)[0])) / 256)
    assert abs(shared[0] - 0.8) < 0.1 and abs(shared[1] - 0.5) < 0.12


def test_points_are_bit_counts(spark):
    from pyspark.sql import functions as F

    fps = [0, -1, 1 << 62, -(1 << 63), 0x123456789ABCDEF, -0x123456789ABCDEF]
    for segments in (4, 8, 16, 32):
        width = 64 // segments
        got = spark.createDataFrame([(f,) for f in fps], "fp long").select("fp", simhash.point(F.col("fp"), segments).alias("p")).collect()
        for x in got:
            bits = [(x.fp >> width * k & (1 << width) - 1).bit_count() for k in range(segments)]
            assert [x.p >> width * k & (1 << width) - 1 for k in range(segments)] == bits


def test_one_of_each_group_is_first(odd):
    got = rows_of(simhash.near_duplicates(odd, keep_rows=True))
    assert all(n == 1 for n in Counter(r["component_id"] for r in got if r["first"]).values())
    assert {r["component_id"] for r in got} == {r["component_id"] for r in got if r["first"]}


def cut_repeats(texts, n=35):
    docs = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in docs for i in range(len(w) - n + 1))
    out = []
    for w in docs:
        keep = [True] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                keep[i : i + n] = [False] * n
        left = [x for x, k in zip(w, keep) if k]
        out.append((len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return out


def test_substring_dedup(odd):
    rows = rows_of(odd)
    got = rows_of(blockdedup.remove_repeats(odd, keep_rows=True))
    want = cut_repeats([r["text"] for r in rows])
    assert bag(got, ["doc_id", "n_words", "n_removed", "kept_sha256"]) == Counter((r["doc_id"], *w) for r, w in zip(rows, want))
    for r in got:
        assert hashlib.sha256(" ".join(WORD.findall(r["clean_text"])).encode()).hexdigest() == r["kept_sha256"]
        assert sum(s["length"] for s in r["spans"]) == r["n_removed"]


def test_substring_dedup_over_many_slices(spark, docs_schema, monkeypatch):
    import random

    monkeypatch.setattr(blockdedup, "SLICE", 2000)
    r = random.Random(2)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 400))) for _ in range(60)]
    texts += [t[50:] + " z " + t for t in texts[:30]]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], docs_schema).repartition(5)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in blockdedup.remove_repeats(df, buckets=7).collect()}
    assert got == dict(enumerate(cut_repeats(texts)))


def test_windows_that_share_half_a_hash(spark, docs_schema, monkeypatch):
    """The first half of every word's hash takes 4 values: the other half keeps windows apart."""
    import random

    plain = blockdedup.Words.__init__

    def weak(self, texts):
        plain(self, texts)
        self.hashes = self.hashes & np.uint64(3)

    monkeypatch.setattr(blockdedup.Words, "__init__", weak)
    r = random.Random(5)
    texts = [" ".join(f"w{r.randint(0, 50)}" for _ in range(r.randint(30, 200))) for _ in range(40)]
    texts += [t[9:] + " z " + t for t in texts[:10]]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts)), pa.array(texts)], ["task", "text"])
    w = blockdedup.Words(batch.column("text"))
    both = sideload.Values(w.rolling(35), w.rolling(35, True))[w.left >= 35]
    values, starts = both.runs()
    windows = Counter(tuple(x[i : i + 35]) for x in map(WORD.findall, texts) for i in range(len(x) - 34))
    assert len(starts) == len(windows) > len(np.unique(both.high)) and sorted(np.diff(starts, append=len(values))) == sorted(windows.values())


def test_mix(odd):
    rows = rows_of(mixture.mix(odd))
    sizes = defaultdict(int)
    for r in rows_of(odd):
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(target.values())
        fair = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if fair[s] > 2 * sizes[s]}
        if not over:
            target |= fair
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    assert bag(rows, ["doc_id", "size"]) == Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in rows_of(odd))
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    longest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - target[s]) <= longest / 2 + 1 for s in order)
    assert bag(rows, ["doc_id", "taken"]) == bag(rows_of(mixture.mix(odd.repartition(7))), ["doc_id", "taken"])


def test_many_sources_are_ranked(spark):
    names = [f"s{k:04d}" for k in range(500)] + ["é", "z" * 50, "", None]
    got = mixture.ranked(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long").repartition(7)).collect()
    assert [x.source for x in sorted(got, key=lambda x: x["rank"])] == sorted(n for n in names if n is not None) + [None] and [x["rank"] for x in sorted(got, key=lambda x: x["rank"])] == list(range(len(names)))


def test_long_texts(spark, docs_schema):
    """Texts of over a megabyte beside short ones, through every operator, against the plain versions."""
    import random

    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(20_000)]
    long = " ".join(r.choice(vocabulary) + "." * (r.random() < 0.1) + "\n" * (r.random() < 0.05) for _ in range(200_000))
    middle = long.split("\n")[40]
    texts = [long, long[: len(long) // 2] + " mit license " + long[len(long) // 2 :], "x" * 1_200_000, middle * 3, "short"]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], docs_schema)
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in blockdedup.remove_repeats(df).collect()} == dict(enumerate(cut_repeats(texts)))
    assert bag(rows_of(simhash.near_duplicates(df)), ["doc_id", "fingerprint", "component_id"]) == Counter(classes([(k, fingerprint(t)) for k, t in enumerate(texts)]))
    assert {x["doc_id"]: x["component_id"] for x in rows_of(simhash.near_duplicates(df, shingle=5, similarity=0.8))} == dict(enumerate(alike(texts))) and alike(texts)[1] == 0
    ids = ids_of("byte_bpe_50k.json", texts)
    assert {x["doc_id"]: x["n_tokens"] for x in rows_of(tokcount.token_counts(df))} == {k: len(i) for k, i in enumerate(ids)}
    pieces = sorted(rows_of(packing.pack(df)), key=lambda x: (x["doc_id"], x["start"]))
    for k, i in enumerate(ids):
        assert np.concatenate([np.frombuffer(x["ids"], "<u4") for x in pieces if x["doc_id"] == k]).tolist() == [*i, 0]
    words = [i + [2] for i in ids_of("word_bpe_49k.json", texts)]
    assert {x["doc_id"]: (x["n_tokens"], x["ids_crc32"]) for x in rows_of(idpack.read_ids(*idpack.write_ids(df, shards=2)))} == {k: (len(i), crc(i)) for k, i in enumerate(words)}
    assert {x["doc_id"]: x["size"] for x in rows_of(mixture.mix(df))} == {k: len(WORD.findall(t)) for k, t in enumerate(texts)} == {x["doc_id"]: x["n_words"] for x in rows_of(linefreq.judge(df))}
    assert {x["doc_id"]: x["payload_sha256"] for x in rows_of(interleave.of_documents(df))} == {k: hashlib.sha256(t.encode() + b" " * (-len(t.encode()) % 192)).hexdigest() for k, t in enumerate(texts)}
    got = {x["doc_id"]: x for x in rows_of(licenses.scan(df))}
    assert [got[k]["labels"] for k in range(5)] == ["", "mit", "", "", ""] and got[1]["n_base"] == 1


def test_token_counts(odd):
    rows = rows_of(odd)
    ids = ids_of("byte_bpe_50k.json", [r["text"] or "" for r in rows])
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(i), len(i) > 1024) for r, i in zip(rows, ids))
    assert bag(rows_of(tokcount.token_counts(odd)), ["doc_id", "n_bytes", "n_tokens", "over_limit"]) == want


def test_bit_packed_ids(odd):
    rows = rows_of(odd)
    ids = [i + [2] for i in ids_of("word_bpe_49k.json", [r["text"] or "" for r in rows])]
    got = rows_of(idpack.read_ids(*idpack.write_ids(odd, shards=5)))
    assert bag(got, ["doc_id", "n_tokens", "ids_crc32"]) == Counter((r["doc_id"], len(i), crc(i)) for r, i in zip(rows, ids))
    got.sort(key=lambda r: r["start"])
    at, last = 0, -1
    for r in got:
        assert r["start"] == at and (r["doc_id"] is None or r["doc_id"] >= last) and r["bits"] == 16
        at, last = at + r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]


def test_packing(odd):
    rows = rows_of(odd.where("doc_id is not null").dropDuplicates(["doc_id"]))
    df = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    whole = {r["doc_id"]: i + [0] for r, i in zip(rows, ids_of("byte_bpe_50k.json", [r["text"] or "" for r in rows]))}
    got = rows_of(packing.pack(df))
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = list(np.frombuffer(r["ids"], "<u4"))
        assert ids == whole[r["doc_id"]][r["start"] : r["start"] + r["length"]] and len(ids) == r["length"] > 0 and crc(ids) == r["ids_crc32"] and r["doc_tokens"] == len(whole[r["doc_id"]])
        parts[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, size in [(parts[d], len(i)) for d, i in whole.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at == size if size is not None else at <= 1024


def test_media(odd):
    def want(text):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192) if raw else b" " * 192
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])

    got = rows_of(interleave.of_documents(odd))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]
    assert bag(got, names) == Counter((r["doc_id"], *want(r["text"])) for r in rows_of(odd))
    lines = {r["doc_id"]: [x for x in (r["text"] or "").split("\n") if x.strip()] for r in rows_of(odd) if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is None:
            continue
        shown = [" ".join(x.split()) for x in lines[r["doc_id"]]]
        digest = f"{r['payload_sha256']}-{r['n_bytes']}"
        assert r["caption"] == f"Payload of {len(shown)} lines" and r["position"] == min(3, len(shown)) and r["n_items"] == len(shown) + 1
        assert r["sequence_sha256"] == hashlib.sha256("\n".join([*shown[:3], digest, *shown[3:]]).encode()).hexdigest()
    for r in rows_of(odd):
        payload = (r["text"] or "").encode()
        payload += b" " * (-len(payload) % 192 or 192 * (not payload))
        means = ",".join(str(sum(payload[c::3]) * 1000 // (len(payload) // 3)) for c in range(3))
        counts = Counter(payload)
        top = min(counts, key=lambda b: (-counts[b], b))
        want_feature = f"rgb8 64x{len(payload) // 192} mean {means} top {top}:{counts[top]} used {len(counts)}"
        assert {x["feature"] for x in got if x["doc_id"] == r["doc_id"] and x["payload_sha256"] == hashlib.sha256(payload).hexdigest()} == {want_feature}
    by_text = defaultdict(set)
    for r in got:
        by_text[r["payload_sha256"], r["n_bytes"]].add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())


SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def test_license_base(odd):
    def want(text):
        w, starts, labels = SPLIT.findall((text or "").translate(LOWER)), [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    starts.append(i)
                    labels.add(label)
        return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))

    got = rows_of(licenses.scan(odd))
    assert bag(got, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]) == Counter((r["doc_id"], *want(r["text"])) for r in rows_of(odd))
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)


def whole_detections(text):
    """Every rule tried at every word of the whole text, with no keyword, gate or block; those inside an earlier rule's dropped."""
    words = " " + " ".join(SPLIT.findall((text or "").translate(LOWER))) + " "
    found = []
    for n, rule in enumerate(signatures.RULES):
        context = f"(?<=(?: |^){signatures.expanded(rule[4])})" if len(rule) > 4 else ""
        for m in regex.finditer(f"(?<= ){context}(?=((?:{signatures.expanded(rule[3])})(?= )))", words):
            start = words[: m.start()].count(" ") - 1
            found.append((n, rule[0], start, start + m[1].count(" ") + 1, rule[1]))
    return {f[1:] for f in found if not any(e[0] < f[0] and e[2] <= f[2] and e[3] >= f[3] for e in found)}


#: Labelled by hand, from the texts of the licenses and their usual notices.
NOTICES = [
    ("Released under GPLv2 or later", "gpl-2.0"), ("GPL-3.0-or-later", "gpl-3.0"), ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"), ("This is free and unencumbered software released into the public domain.", "unlicense"), ("The Unlicense", "unlicense"), ("WTFPL", "wtfpl"),
    ("Creative Commons Attribution 4.0", "cc-by"), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2.0,mit"), ("// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2.0"),
    ("Licensed under the Apache License, Version 2.0 (the License)", "apache,apache-2.0"), ("SPDX-License-Identifier: MIT", "mit"), ("released under the terms of the GNU Lesser General Public License v3 or later", "gpl,lgpl-3.0"), ("BSD 3-Clause License", "bsd-3-clause"),
    ("see the Mozilla Public License 2.0 for details", "mpl-2.0"), ("This is CC BY-SA 4.0 licensed work", "cc-by-sa"), ("distributed under the Boost Software License 1.0 or under the MIT license", "bsl-1.0,mit"), ("distributed under the GNU GPL version 2 or later", "gpl-2.0"),
    ("released under MIT", "mit"), ("available under Apache 2.0", "apache-2.0"), ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa"), ("CC0 1.0", "cc0-1.0"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Released under the MIT License.", "mit"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"), ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"), ("This project is licensed under the ISC License", "isc"), ("GNU Affero General Public License v3", "agpl-3.0,gpl"),
    ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"), ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"), ("0BSD", "0bsd"), ("the 2-Clause BSD License", "bsd-2-clause"),
    ("Er kam mit seinem Hund, und mit ihm ein Commit.", ""), ("a simple example of a complete reply", ""), ("the zlib source", ""), ("", ""), (None, ""), ("All rights reserved.", "proprietary"),
    ("You just DO WHAT THE FUCK YOU WANT TO.", "wtfpl"), ("The Software shall be used for Good, not Evil.", "json"), ("Eclipse Public License 2.0", "epl-2.0"), ("EUPL-1.2", "eupl-1.2"), ("Licence Ouverte 2.0", "etalab"), ("SIL Open Font License, Version 1.1", "ofl-1.1"), ("copyleft", "copyleft"),
]


def test_license_labels(spark, docs_schema):
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, (t, _) in enumerate(NOTICES)], docs_schema)
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert [(t, got[k], want) for k, (t, want) in enumerate(NOTICES) if got[k] != want] == []


def sample(pattern, r):
    """Some words that a pattern matches, from its syntax tree."""
    import re._parser as parser

    def walk(items):
        out = []
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                out.append(chr(arg))
            elif op == "IN":
                kind, x = arg[0]
                out.append(chr(x if str(kind) == "LITERAL" else r.randint(*x)))
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                out += [walk(arg[2]) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 3)))]
            elif op == "SUBPATTERN":
                out.append(walk(arg[3]))
            elif op == "BRANCH":
                out.append(walk(r.choice(arg[1])))
        return "".join(out)

    return walk(parser.parse(pattern))


def longest(pattern):
    """The most words that a pattern can match."""
    import re._parser as parser

    def spaces(items):
        n = 0
        for op, arg in items:
            op = str(op)
            n += (op == "LITERAL" and arg == 32) or (op == "IN" and any(x == 32 for _, x in arg if isinstance(x, int)))
            if op in ("MAX_REPEAT", "MIN_REPEAT"):
                n += arg[1] * spaces(arg[2])
            elif op == "SUBPATTERN":
                n += spaces(arg[3])
            elif op == "BRANCH":
                n += max(map(spaces, arg[1]))
        return n

    return spaces(parser.parse(pattern)) + 1


def test_license_rules_hold_their_keywords_and_gates():
    import random

    r = random.Random(1)
    assert len(signatures.RULES) > 250
    for rule in signatures.RULES:
        context = signatures.expanded(rule[4]) if len(rule) > 4 else ""
        pattern = signatures.expanded(rule[3])
        for _ in range(40):
            words = f" {sample(context, r) if context else ''}{sample(pattern, r)} "
            assert rule[2] in words and any(g in words for g in signatures.gates(rule)), (rule, words)
        assert longest(pattern) + (longest(context) if context else 0) <= licenses.REACH // 2, rule


def test_license_rules_need_no_gate_or_block(spark, docs_schema):
    import random

    r = random.Random(3)
    phrases = [sample(signatures.expanded(x[4]) if len(x) > 4 else "", r) + sample(signatures.expanded(x[3]), r) for x in signatures.RULES for _ in range(2)]
    known = sorted({w for p in phrases for w in p.split()} | set("under see the to of released license licensed spdx is copy v2 gpl2 subject".split()))
    texts = [t for t, _ in NOTICES] + ["MIT License. MIT License! gpl license and licence", "license " * 40, "spdx license identifier " * 30]
    texts += [" ".join(r.choice(known) if r.random() < 0.8 else r.choice("abcxyz") for _ in range(r.randint(1, 60))) for _ in range(60)]
    texts += ["; ".join(r.choice(phrases) if r.random() < 0.7 else r.choice(known) for _ in range(r.randint(1, 12))) for _ in range(60)]
    texts += [" ".join(r.choice(phrases) if r.random() < 0.2 else r.choice(known) for _ in range(1200))]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], docs_schema)
    got = {x.doc_id: x for x in licenses.scan(df).collect()}
    for k, t in enumerate(texts):
        assert sorted(tuple(d) for d in got[k].detections or ()) == sorted(whole_detections(t)), t
