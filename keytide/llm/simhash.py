"""SimHash near-dedup: segment-popcount embedding, grid range-join under Manhattan distance, exact check.

A fingerprint of 64 bits is cut into `segments` pieces; the bit counts of the pieces are a point of a small
integer grid, kept in one long. Two fingerprints that differ in r bits have points at Manhattan distance r at most, so links within
2 bits lie between grid cells at distance 2 at most. Two cells that near share a cell at distance 1 or 0 from
both, hence each distinct fingerprint is put into its own cell and the cells next to it, and an
equality join on the cell finds every candidate; Hamming distance then decides. The rows grow with the number
of distinct fingerprints only: 49 each on average with 32 segments, whose fullest cell holds 2048 random fingerprints only
from about 2.7 * 10^11 distinct ones on (6 * 10^8 with 16 segments, 5 * 10^6 with 8).

So a cell with more than `heavy` fingerprints is a crowd of near copies, at every size of the corpus, and not joined with itself, for
its pairs would grow with the square of the crowd. Each fingerprint of such a cell is instead
tied to the values at Hamming distance 1 or 0 (65 rows); two fingerprints share such a value exactly when they
differ in at most 2 bits, so the components stay exact and the rows linear, whatever a cell holds. Components
come from rounds of hooking to the smallest neighbour and pointer jumping, each round a table in the shared folder. Joins are
sort-merge joins by hint, so nothing is broadcast; a fingerprint or root that many rows share is split by adaptive execution
(spark.sql.adaptive.skewJoin), which such joins admit.

Defined results: a null or wordless text has fingerprint zero, linked like any other; a text under
`shingle` words gives its whole word sequence as its only shingle; repeated shingles count as often as they
occur. Rows of one fingerprint are one class; null ids are compared last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.llm import similar
from keytide.llm.common import delete, named_rows, stored

BITS = 64


def fingerprint(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """Bit set where over half of the shingle hashes have it; zero for no words."""
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(g, seed) for g in grams]), np.uint8)
    n = len(hashes) // 8
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at * 8 : (at + (1 << 16)) * 8].reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [
                0 if x is None else fingerprint(x.translate(_UPPER).split(), shingle, seed)
                for x in batch.column("text").cast(pa.large_binary()).to_pylist()
            ]
            signed = pa.array(np.array(values, np.uint64).view(np.int64))
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, signed], [*[c for c in batch.schema.names if c != "text"], "fp"])

    return run


def with_fingerprints(docs: DataFrame, keep: list[Column], text: Column, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The columns of keep and `fp`, the fingerprint as a signed 64-bit integer. bytes.split() cuts at the six ASCII white spaces."""
    from pyspark.sql.types import LongType, StructType

    narrow = docs.select(*keep, text.cast("string").alias("text"))
    schema = StructType([f for f in narrow.schema.fields if f.name != "text"]).add("fp", LongType())
    return narrow.mapInArrow(_fingerprints(shingle, seed), schema)


def _long(bits: int) -> Column:
    """A 64-bit pattern as a signed literal."""
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def point(fp: Column, segments: int) -> Column:
    """The bit counts of the segments, side by side in one long, each in the bits of its segment; no step overflows."""
    c, width = fp, 1
    while width < BITS // segments:
        mask = _long(sum(((1 << width) - 1) << k for k in range(0, BITS, 2 * width)))
        low, high = c.bitwiseAND(mask), F.shiftrightunsigned(c, width).bitwiseAND(mask)
        # single bits are added by hand, for their sum may reach the sign
        c = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1)) if width == 1 else low + high
        width *= 2
    return c


def _cells(fps: DataFrame, segments: int) -> DataFrame:
    """(cell, move, fp): the own cell (move 0) and those one step away, where every count stays between 0 and the segment's bits."""
    width = BITS // segments
    mask, at = (1 << width) - 1, F.expr(f"cast((move - 1) div 2 * {width} as int)")
    by = F.when(F.col("move") % 2 == 1, 1).otherwise(-1)
    moved = fps.select("fp", point(F.col("fp"), segments).alias("own")).select("fp", "own", F.explode(F.sequence(F.lit(0), F.lit(2 * segments))).alias("move"))
    count = F.call_function("shiftrightunsigned", F.col("own"), at).bitwiseAND(_long(mask))
    there = moved.withColumn("n", (count + by).cast("long")).where((F.col("move") == 0) | F.col("n").between(0, width))
    cleared = F.col("own").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", _long(mask), at)))
    cell = F.when(F.col("move") == 0, F.col("own")).otherwise(cleared.bitwiseOR(F.call_function("shiftleft", F.col("n"), at)))
    return there.select(cell.alias("cell"), "move", "fp")


def links(fps: DataFrame, segments: int = 32, distance: int = 2, heavy: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Links between distinct fingerprints: pairs (a, b) within distance, and ties (a, b) to values b that stand for the pairs of heavy cells.

    distance may be 0, 1 or 2: beyond, one step from both cells is not enough.
    """
    if not 0 <= distance <= 2 or segments not in (4, 8, 16, 32):
        raise ValueError("distance is at most 2; segments is 4, 8, 16 or 32")
    cells = _cells(fps, segments)
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("cell")
    big, _ = stored(sizes, "heavy")
    crowds = not big.isEmpty()
    light = cells.join(big.hint("merge"), "cell", "left_anti") if crowds else cells
    a, b = light.alias("a"), light.alias("b").hint("merge")
    # Same move on both sides: the own cells agree, and the pair is found there.
    once = (F.col("a.move") != F.col("b.move")) | (F.col("a.move") == 0)
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    pairs = a.join(b, (F.col("a.cell") == F.col("b.cell")) & once & (F.col("a.fp") < F.col("b.fp")) & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if not crowds:
        return pairs, pairs.limit(0)
    crowded = cells.join(big.hint("merge"), "cell", "left_semi").select("fp").distinct()
    if distance == 1:
        # two values differ in bit k alone exactly when they agree once it is cleared
        shared = [F.struct(F.lit(k).alias("bit"), F.col("fp").bitwiseAND(_long((1 << 64) - 1 - (1 << k))).alias("rest")) for k in range(BITS)]
    else:
        shared = [F.col("fp"), *[F.col("fp").bitwiseXOR(_long(1 << k)) for k in range(BITS if distance else 0)]]
    return pairs, crowded.select(F.col("fp").alias("a"), F.explode(F.array(*shared)).alias("b"))


def components(pairs: DataFrame, ties: DataFrame | None = None) -> DataFrame:
    """(node, root) for every node of an edge list of longs; root names the component.

    ties are (node, hub) edges whose hubs aren't nodes. Each is turned into node-node edges by linking every node
    of a hub to the smallest one: as many edges as ties. Then, in rounds, each root is hooked to the smallest root beyond
    one of its edges (an aggregated minimum, so no task gathers a neighbourhood), hooks are followed to their ends by
    pointer jumping, and nodes take the new roots, until no edge joins two roots.
    """
    edges = pairs.select("a", "b")
    if ties is not None and not ties.isEmpty():
        low = ties.groupBy("b").agg(F.min("a").alias("low"), F.count("*").alias("n")).where("n > 1")
        edges = edges.unionByName(ties.join(low.hint("merge"), "b").where("a <> low").select("low", F.col("a").alias("x")).select(F.col("low").alias("a"), F.col("x").alias("b")))
    edges, path = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels, label_path = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "labels")
    while True:
        # hook: the smallest root seen over the edges, for the root of each node; jump: the root's root
        seen = (
            edges.join(labels.select(F.col("node").alias("a"), F.col("root").alias("ra")).hint("merge"), "a")
            .join(labels.select(F.col("node").alias("b"), F.col("root").alias("rb")).hint("merge"), "b")
            .where("ra <> rb").select(F.greatest("ra", "rb").alias("high"), F.least("ra", "rb").alias("low"))
        )
        hooks, hook_path = stored(seen.groupBy("high").agg(F.min("low").alias("low")), "hooks")
        if hooks.isEmpty():
            delete(edges.sparkSession, path)
            return labels
        while True:
            far = hooks.alias("x").join(hooks.alias("y").hint("merge"), F.col("x.low") == F.col("y.high"), "left").select("x.high", F.coalesce("y.low", "x.low").alias("low"), F.col("y.low").isNotNull().alias("moved"))
            jumped, new_path = stored(far, "hooks")
            delete(edges.sparkSession, hook_path)
            hooks, hook_path = jumped.select("high", "low"), new_path
            if jumped.where("moved").isEmpty():
                break
        moved = labels.join(hooks.withColumnRenamed("high", "root").hint("merge"), "root", "left").select("node", F.coalesce("low", "root").alias("root"))
        old, (labels, label_path) = label_path, stored(moved, "labels")
        delete(edges.sparkSession, old)
        delete(edges.sparkSession, hook_path)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, seed: int = 42, segments: int = 32,
    distance: int = 2, heavy: int = 2048, similarity: float | None = None, bands: int = 20, rows: int = 6, keep_rows: bool = False,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component), and `rid` with keep_rows.

    Links are fingerprints within distance; with similarity, texts whose sets of shingles are at least that alike (Jaccard), which
    fingerprints, bands of minima and, for all that these leave, first shingles find and an exact comparison decides (see llm.similar). Then texts without words are one class.

    With keep_rows the struct `row` has all columns of docs, and `first` marks one row of each component: the
    smallest doc_id, and of rows that repeat it, one.
    """
    docs, name = named_rows(docs)
    keep = [name.alias("rid"), docs[id_col].alias("doc_id")]
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid"))).alias("least")
    if similarity is None:
        marked, _ = stored(with_fingerprints(docs, keep, docs[text_col], shingle, seed), "fingerprints")
        classes, _ = stored(marked.groupBy("fp").agg(smallest).withColumn("cid", F.col("fp")), "classes")
        found, by = components(*links(classes.select("fp"), segments, distance, heavy)), "fp"
    else:
        signed = similar.with_signatures(docs, keep, docs[text_col], partial(fingerprint, shingle=shingle, seed=seed), shingle, bands, rows, seed, _UPPER)
        wide, wide_path = stored(signed, "signatures", "lz4")
        named = wide.groupBy("key").agg(smallest, F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("odd").alias("odd")).withColumn("cid", F.monotonically_increasing_id())
        classes, _ = stored(named, "classes")
        found, by = _similar(classes, wide, segments, distance, heavy, similarity, bands * rows), "key"
        # the sets are as large as the texts: only what names a row and its class stays
        marked, _ = stored(wide.select("rid", "doc_id", "fp", "key"), "fingerprints")
        delete(docs.sparkSession, wide_path)
    rooted = classes.join(found.select(F.col("node").alias("cid"), "root").hint("merge"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    named = rooted.join(best.hint("merge"), "root").select(by, "best")
    out = marked.join(named.hint("merge"), by).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.id").alias("component_id"), "rid", (F.col("rid") == F.col("best.rid")).alias("first"),
    )
    if not keep_rows:
        return out.drop("rid", "first")
    return out.join(docs.select(name.alias("rid"), F.struct(*[docs[c] for c in docs.columns]).alias("row")).hint("merge"), "rid")


def _similar(classes: DataFrame, wide: DataFrame, segments: int, distance: int, heavy: int, similarity: float, size: int) -> DataFrame:
    """(node, root) over classes (cid, key, fp, bands) of texts with the same words."""
    keyed = classes.select("cid", F.explode("bands").alias("h"))
    shared = keyed.groupBy("h").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low < high").select("h")
    members, members_path = stored(keyed.join(shared.hint("merge"), "h", "left_semi"), "buckets")
    # fingerprints that are close, and texts that share one: a star of each fingerprint, and a pair for each link
    full = classes.where(F.size("bands") > 0).select("cid", "fp")
    heads, _ = stored(full.groupBy("fp").agg(F.min("cid").alias("head")), "heads")
    pairs, ties = links(heads.select("fp"), segments, distance, heavy)
    near = pairs.select("a", "b")
    if not ties.isEmpty():
        hubs = ties.groupBy("b").agg(F.min("a").alias("low"))
        near = near.unionByName(ties.join(hubs.hint("merge"), "b").select(F.col("a").alias("x"), "low").select(F.col("x").alias("a"), F.col("low").alias("b")))
    at = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head")).hint("merge")
    close = near.join(at("a"), "a").join(at("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    same = full.join(heads.hint("merge"), "fp").select(F.col("cid").alias("a"), F.col("head").alias("b"))
    first, _ = stored(close.unionByName(same).where("a <> b"), "close")
    chosen = members.select("cid").unionByName(first.select(F.col("a").alias("cid"))).unionByName(first.select(F.col("b").alias("cid")))
    sets, sets_path = _sets(classes, wide, chosen)
    quick = similar.linked(members, classes.select("cid", "sketch"), sets, first, similarity, size, components)
    for path in (members_path, sets_path):
        delete(wide.sparkSession, path)
    # what is alike and not linked yet: found without exception, and compared
    rooted = classes.join(quick.withColumnRenamed("node", "cid").hint("merge"), "cid", "left").select(F.xxhash64("key").alias("kid"), "cid", F.coalesce("root", "cid").alias("root"), "odd")
    names, _ = stored(rooted, "names")
    left = similar.left_over(wide.select(F.xxhash64("key").alias("kid"), "grams"), names, similarity)
    sets, sets_path = _sets(classes, wide, left.select(F.col("a").alias("cid")).union(left.select("b")))
    alike, _ = stored(similar.compared(left.select("a", "b"), sets, similarity).join(left.hint("merge"), ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")), "joined")
    delete(wide.sparkSession, sets_path)
    into = components(alike).select(F.col("node").alias("root"), F.col("root").alias("into"))
    return names.join(into.hint("merge"), "root", "left").select(F.col("cid").alias("node"), F.coalesce("into", "root").alias("root"))


def _sets(classes: DataFrame, wide: DataFrame, chosen: DataFrame) -> tuple[DataFrame, str]:
    """(cid, grams) of one row of each chosen class, and the table's path."""
    wanted = classes.select("cid", F.col("least.rid").alias("rid")).join(chosen.distinct().hint("merge"), "cid", "left_semi")
    return stored(wide.select("rid", "grams").join(wanted.hint("merge"), "rid").select("cid", "grams"), "sets", "lz4")
