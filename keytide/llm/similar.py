"""Links between texts whose sets of word shingles are alike: candidates by fingerprints and by bands, then the exact similarity.

SimHash fingerprints within 2 of 64 bits miss most pairs at a Jaccard similarity of 0.8 (there they differ in 10 bits on average,
where segment counts prune nothing), so they are joined by a second search: `bands` keys a text, each the hash of `rows`
minima of its shingles under seeded hashes. A pair at similarity s shares a key with chance 1 - (1 - s^rows)^bands:
0.998 at 0.8 and over 0.9999 from 0.85 on, with 20 bands of 6. Whatever is found is compared exactly, set against set.

Pairs inside a bucket are never listed. A bucket holds its components, each with its number of texts and REPS of them, chosen by a hash of
the bucket's own. In a round every component faces its bucket's largest one and one other; sketches (a byte of each minimum) leave out pairs whose
similarity is below the wanted one by over four standard deviations, and of each two components that face each other the pair with the best
sketches is compared exactly. What is alike becomes one component, so a crowd shrinks to one row a bucket. Rounds end when IDLE in
a row bring no link.

These searches are quick and may miss links, so a third one, which can't, finds what they left (see left_over). Shingles have one order, rare ones
first. Two sets of m and n shingles and similarity s agree in o = ceil(s (m + n) / (1 + s)) at least, and the first that they agree in has o - 1 later
ones in either, so it is among the first n - o + 1 of either: n - ceil(s n) + 1 for the least m that may be alike, far fewer for m near n. All pairs that
share a shingle that early and are in two components yet are listed. Of these, pairs are compared unless their parities rule the similarity out: a bit for
each of PARITIES cells, whether the set has an odd number of shingles there, so sets that differ in d shingles differ in d bits at most. Links inside a
component need no listing, so a crowd costs its rows, and pairs only with what it isn't linked to. A shingle's rows that reach no size of a set that has
it are dropped before they meet, so texts of one size around a common one, each with over (1 - s) / (1 + s) shingles of its own, bring no rows at all. The
order may be any without loss: it goes by the counts of CELLS cells of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import delete, stored

#: Bytes of a shingle's hash in a stored set (two sets of 10^5 shingles share one by chance in a hundred pairs), and shingles hashed at once.
WIDTH = 5
CHUNK = 1 << 9
#: Texts that stand for a component in a bucket.
REPS = 3
#: Rounds in a row without a link after which the search in buckets ends.
IDLE = 4
#: Cells in which shingles are counted, and those in a row of counts.
CELLS = 1 << 18
CHUNK_CELLS = 1 << 12
#: Cells whose parities bound the difference of two sets, 64 in a long.
PARITIES = 512


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the distinct shingles, in order; a text under size words is one shingle, no words are none."""
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[k:] for k in range(size))))
    digest = xxhash.xxh3_64_digest
    return np.unique(np.frombuffer(b"".join([digest(g) for g in grams]), ">u8").astype(np.uint64) >> np.uint64(64 - 8 * WIDTH))


def _seeds(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def band_keys(grams: np.ndarray, bands: int, rows: int, seeds: tuple[np.ndarray, np.ndarray]) -> tuple[list[int], bytes]:
    """A key a band, as signed longs, and the sketch; none without shingles. Minima of 32 bits are enough, for they only bring candidates."""
    if not len(grams):
        return [], b""
    a, b = seeds
    least = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        mixed = ((grams ^ (grams >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(mixed), CHUNK):
            held = mixed[at : at + CHUNK, None] * a
            held += b
            # the product's low bits follow the low bits of the hash alone, so high bits are turned into them
            held ^= held >> np.uint32(15)
            held *= np.uint32(0x2C1B3C6D)
            held ^= held >> np.uint32(12)
            np.minimum(least, held.min(axis=0), out=least)
    raw = least.astype("<u4").tobytes()
    return [xxhash.xxh3_64_intdigest(raw[4 * rows * k : 4 * rows * (k + 1)], k) - (1 << 63) for k in range(bands)], raw[::4]


def packed(grams: np.ndarray) -> bytes:
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def parities(grams: np.ndarray) -> np.ndarray:
    """Longs with a bit a cell: is the number of shingles there odd."""
    odd = np.bincount((grams & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def _signatures(fingerprint: Callable[[list[bytes]], int], shingle: int, bands: int, rows: int, seed: int, upper: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(bands * rows, seed)
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "text"]
            # few texts at a time, so that a batch of long ones stays small
            for at in range(0, batch.num_rows, 256):
                part, names, keys, sketches, sets, odd, fps = batch.slice(at, 256), [], [], [], [], [], []
                for x in part.column("text").cast(pa.large_binary()).to_pylist():
                    words = (x or b"").translate(upper).split()
                    grams = shingles(words, shingle)
                    names.append(xxhash.xxh3_128_hexdigest(b" ".join(words)))
                    found, sketch = band_keys(grams, bands, rows, seeds)
                    keys.append(found)
                    sketches.append(sketch)
                    sets.append(packed(grams))
                    odd.append(parities(grams))
                    fps.append(fingerprint(words))
                signed = pa.array(np.array(fps, np.uint64).view(np.int64))
                columns = [signed, pa.array(names), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(sets, pa.binary()), pa.array(odd, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], *columns], [*rest, "fp", "key", "bands", "sketch", "grams", "odd"])

    return run


def with_signatures(docs: DataFrame, keep: list[Column], text: Column, fingerprint: Callable[[list[bytes]], int], shingle: int, bands: int, rows: int, seed: int, upper: bytes) -> DataFrame:
    """The columns of keep, fp (fingerprint of the words), key (of the words, lower-cased), bands, sketch, grams and odd (parities): one pass over the text."""
    from pyspark.sql.types import ArrayType, LongType, StructType

    narrow = docs.select(*keep, text.cast("string").alias("text"))
    schema = StructType([f for f in narrow.schema.fields if f.name != "text"]).add("fp", "long").add("key", "string").add("bands", ArrayType(LongType())).add("sketch", "binary").add("grams", "binary").add("odd", ArrayType(LongType()))
    return narrow.mapInArrow(_signatures(fingerprint, shingle, bands, rows, seed, upper), schema)


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [jaccard(unpacked(x), unpacked(y)) >= similarity for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(hits))

    return run


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose sets (cid, grams) are alike. A pair whose sizes alone rule it out isn't compared."""
    x = sets.select(F.col("cid").alias("a"), F.col("grams").alias("x"))
    y = sets.select(F.col("cid").alias("b"), F.col("grams").alias("y"))
    joined = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    low, high = F.least(F.length("x"), F.length("y")), F.greatest(F.length("x"), F.length("y"))
    return joined.where(low >= F.lit(similarity) * high - 1e-6).select("a", "b", "x", "y").mapInArrow(_alike(similarity), "a long, b long")


def _chance(name: str, turn: int) -> Column:
    return F.struct(F.xxhash64(F.lit(turn), F.col(name)), F.col(name))


def _promising(least: int):
    """Pairs whose sketches agree in at least so many bytes, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
            same = (x == y).sum(axis=1)
            out = batch.select(["ra", "a", "rb", "b"]).append_column("same", pa.array(same, pa.int64()))
            yield out.filter(pa.array(same >= least))

    return run


def linked(members: DataFrame, sketches: DataFrame, sets: DataFrame, first: DataFrame, similarity: float, size: int, components) -> DataFrame:
    """(node, root) of texts that are linked, directly or over others: members (h, cid) of buckets, sketches (cid, sketch) of size bytes, and pairs (a, b) found otherwise."""
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    least = int(size * similarity - 4 * (size * similarity * (1 - similarity)) ** 0.5)
    tested, _ = stored(ordered(first), "tested")
    links, _ = stored(compared(tested, sets, similarity), "links")
    one = F.struct(F.col("cid"), F.col("sketch"))
    stands = members.join(sketches.hint("merge"), "cid").select("h", F.col("cid").alias("root"), F.array(one).alias("reps"), F.lit(1).cast("long").alias("n"))
    joined, turn, idle, path = links, 0, 0, ""
    while True:
        if turn == 0 or not joined.isEmpty():
            # components that were linked become one in each bucket, with REPS of their texts
            names = components(joined).select(F.col("node").alias("root"), F.col("root").alias("into"))
            merged = stands.join(names.hint("merge"), "root", "left").select("h", F.coalesce("into", "root").alias("root"), F.get("reps", F.pmod(F.lit(turn), F.size("reps"))).alias("rep"), "n")
            chosen = [F.min_by("rep", F.xxhash64(F.lit(turn * REPS + k), "h", F.col("rep.cid"))) for k in range(REPS)]
            old, (stands, path) = path, stored(merged.groupBy("h", "root").agg(F.array_distinct(F.array(*chosen)).alias("reps"), F.sum("n").alias("n")), "stands")
            if old:
                delete(links.sparkSession, old)
        best = F.max_by(F.struct("root", "reps"), F.struct("n", F.xxhash64(F.lit(turn), "root"), "root")).alias("best")
        other = F.min_by(F.struct("root", F.slice("reps", 1, 1).alias("reps")), _chance("root", turn)).alias("other")
        hubs = stands.groupBy("h").agg(best, other, F.count("*").alias("m")).where("m > 1").drop("m")
        faced = stands.join(hubs.hint("merge"), "h").select(
            F.col("root").alias("ra"), F.get("reps", F.pmod(F.lit(turn), F.size("reps"))).alias("u"),
            F.explode(F.flatten(F.transform(F.array("best", "other"), lambda o: F.transform(o["reps"], lambda r: F.struct(o["root"].alias("rb"), r.alias("v")))))).alias("o"),
        ).where("ra <> o.rb")
        flat = faced.select("ra", F.col("u.cid").alias("a"), F.col("u.sketch").alias("x"), F.col("o.rb").alias("rb"), F.col("o.v.cid").alias("b"), F.col("o.v.sketch").alias("y"))
        likely = flat.mapInArrow(_promising(least), "ra long, a long, rb long, b long, same long")
        swapped = F.col("a") > F.col("b")
        turned = likely.select(*[F.when(swapped, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("ra", "rb"), ("a", "b"), ("rb", "ra"), ("b", "a"))], "same").distinct()
        fresh = turned.join(tested.hint("merge"), ["a", "b"], "left_anti")
        pair = F.struct(F.least("ra", "rb").alias("low"), F.greatest("ra", "rb").alias("high"))
        new = fresh.groupBy(pair.alias("p")).agg(F.max_by(F.struct("a", "b"), F.struct("same", "a", "b")).alias("w")).select("w.a", "w.b", F.col("p.low").alias("low"), F.col("p.high").alias("high"))
        asked, _ = stored(new, "asked")
        found, _ = stored(compared(asked.select("a", "b"), sets, similarity), "links")
        joined, _ = stored(asked.join(found.hint("merge"), ["a", "b"], "left_semi").select(F.col("low").alias("a"), F.col("high").alias("b")), "joined")
        idle = idle + 1 if found.isEmpty() else 0
        if idle == IDLE:
            delete(links.sparkSession, path)
            return components(links)
        tested, _ = stored(tested.unionByName(asked.select("a", "b")), "tested")
        links, _ = stored(links.unionByName(found), "links")
        turn += 1


def _cell(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            counts += np.bincount(_cell(unpacked(b"".join(batch.column("grams").slice(at, 256).to_pylist()))), minlength=CELLS)
    if counts.any():
        parts = [counts[k : k + CHUNK_CELLS].astype("<i8").tobytes() for k in range(0, CELLS, CHUNK_CELLS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])


def _grades(chunk: pa.Table) -> pa.Table:
    counts = sum(np.frombuffer(x, "<i8") for x in chunk.column("counts").to_pylist())
    grades = np.minimum(8 * np.log2(1 + counts), 255).astype(np.uint8)
    return pa.table({"chunk": chunk.column("chunk").slice(0, 1), "grades": pa.array([grades.tobytes()], pa.binary())})


def grades(sets: DataFrame) -> np.ndarray:
    """How frequent the shingles of each cell are in sets (grams), as a byte: CELLS bytes, whatever the size of the table."""
    found = sets.select("grams").mapInArrow(_counts, "chunk int, counts binary").groupBy("chunk").applyInArrow(_grades, "chunk int, grades binary").collect()
    return np.frombuffer(b"".join(bytes(r.grades) for r in sorted(found, key=lambda r: r.chunk)), np.uint8)


def common(n: int, similarity: float) -> int:
    """The least number of n shingles that a set of that similarity or more agrees in."""
    return int(np.ceil(similarity * n - 1e-6))


def agreed(both: Column, similarity: float) -> Column:
    """The least number of shingles that two sets of so many in all agree in."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * both - 1e-6)


def first_shingles(grams: np.ndarray, order: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of which any set of that similarity has one among its own first ones, in order, each led by its grade."""
    ranked = (order[_cell(grams)].astype(np.uint64) << np.uint64(8 * WIDTH)) | grams
    keep = len(grams) - common(len(grams), similarity) + 1
    return np.sort(np.partition(ranked, keep - 1)[:keep])


def _prefixes(order: np.ndarray, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                # copies in sight count once
                sets = dict(zip(part.column("kid").to_pylist(), part.column("grams").to_pylist()))
                held = [(kid, unpacked(raw)) for kid, raw in sets.items() if raw]
                if not held:
                    continue
                firsts = [first_shingles(g, order, similarity) for _, g in held]
                sizes = np.array([len(x) for x in firsts])
                columns = [
                    np.concatenate(firsts).view(np.int64), np.repeat(np.array([kid for kid, _ in held], np.int64), sizes),
                    np.repeat(np.array([len(g) for _, g in held], np.int32), sizes), np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "kid", "n", "at"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of token and kid, one of each pair of them, where the token has several kids. One row is held back, never a group."""
    held, known = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        token, kid = (rows.column(c).to_numpy() for c in ("token", "kid"))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (kid[1:] != kid[:-1])
        rows, token = rows.filter(pa.array(new)), token[new]
        same = token[1:] == token[:-1]
        several = np.zeros(len(token), bool)
        several[0] = known
        several[1:] |= same
        known = bool(several[-1])
        several[:-1] |= same
        yield from rows.slice(0, len(token) - 1).filter(pa.array(several[:-1])).to_batches()
        held = rows.slice(len(token) - 1).combine_chunks().to_batches()[0]
    if known:
        yield held


def _meeting(similarity: float):
    """Of rows in order of token, n and kid, one of each pair of token and kid, where several kids may meet: a row's place leaves room for a set as small as the token's least."""
    ratio = (1 + similarity) / similarity

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            token, n, at = (batch.column(c).to_numpy() for c in ("token", "n", "at"))
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            least = n[np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))]
            if last is not None and last[0] == token[0]:
                least = np.where(token == token[0], last[1], least)
            last = token[-1], least[-1]
            yield batch.filter(pa.array((n - at + 2e-6) * ratio - n >= least))

    return lambda batches: _shared(reaching(batches))


def left_over(sets: DataFrame, names: DataFrame, similarity: float) -> DataFrame:
    """(a, ra, b, rb): pairs of texts of the components ra and rb, all that are alike among them; others are few.

    sets (kid, grams) may repeat a text; names (kid, cid, root, odd) has each once. Two texts with one kid are both asked for.
    """
    schema = "token long, kid long, n int, at int"
    firsts = sets.mapInArrow(_prefixes(grades(sets), similarity), schema)
    shared = firsts.repartition("token").sortWithinPartitions("token", "n", "kid").mapInArrow(_meeting(similarity), schema)
    rows, rows_path = stored(shared.join(names.drop("odd").hint("merge"), "kid").drop("kid"), "firsts")
    # the component with most rows of a shingle is its home: rows at home face the others, and these each other
    homes = rows.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("root", F.struct("k", "root")).alias("home"), F.count("*").alias("m")).where("m > 1").drop("m")
    open_, open_path = stored(rows.join(homes.hint("merge"), "token"), "open")
    delete(sets.sparkSession, rows_path)
    a, b = open_.where("root <> home").alias("a"), open_.alias("b").hint("merge")
    once = (F.col("b.root") == F.col("b.home")) | (F.col("a.cid") < F.col("b.cid"))
    early = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= agreed(F.col("a.n") + F.col("b.n"), similarity)
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root")) & once & early)
    swapped = F.col("a.cid") > F.col("b.cid")
    side = lambda c, x, y: F.when(swapped, F.col(f"{y}.{c}")).otherwise(F.col(f"{x}.{c}"))
    seen = met.select(
        side("cid", "a", "b").alias("a"), side("root", "a", "b").alias("ra"), side("cid", "b", "a").alias("b"), side("root", "b", "a").alias("rb"), (F.col("a.n") + F.col("b.n")).alias("both"),
    ).distinct()
    odd = lambda c, x: names.select(F.col("cid").alias(c), F.col("odd").alias(x)).hint("merge")
    differ = sum(F.bit_count(F.get("x", F.lit(k)).bitwiseXOR(F.get("y", F.lit(k)))) for k in range(PARITIES // 64))
    likely = seen.join(odd("a", "x"), "a").join(odd("b", "y"), "b").where(differ <= F.col("both") - 2 * agreed(F.col("both"), similarity))
    pairs, _ = stored(likely.select("a", "ra", "b", "rb"), "left")
    delete(sets.sparkSession, open_path)
    return pairs
