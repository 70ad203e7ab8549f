"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Targets: `share` of all sizes is dealt to the sources by weight; a source is clamped at max_epochs times its own
size, and the excess goes to the others by weight, again and again until none is above. A document then comes
floor(target / source size) whole times, and once more when it lies in the part of its source, in the order of a
seeded md5, that covers the fraction left: a document is in when its middle word is inside that part, so the
words taken differ from the target by half a document at most. A place in that order is a distributed prefix sum:
sizes are summed by (source, leading digits of the md5), those sums are accumulated, and only rows that share the
leading digits are sorted together, so a source with a third of all rows is spread over `16 ** digits` groups.

Sources are ranked by ranges, so as many as there may be (hosts, say), no task sees them all.

Defined results: a null text has size 0; null is a source of its own, last in order; sources without words get
target 0; repeated rows are documents of their own, equal keys are ordered by size, then by a hash of the text. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.llm.common import SPACE, WORD, named_rows, stored


def size_of(text: Column) -> Column:
    """Number of words of a text (null: 0): the pieces between separators, without the empty ends."""
    whole = F.coalesce(text, F.lit(""))
    ends = F.when(whole.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(whole.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(~whole.rlike(WORD), F.lit(0)).otherwise(F.size(F.split(whole, SPACE, -1)) - ends).cast("long")


def water_fill(sources: DataFrame, total: float, max_epochs: float = 2.0) -> DataFrame:
    """sources (source, source_size, weight) with `target`; total is dealt by weight under the caps.

    One aggregate a round; each round clamps every source above its cap, so rounds are few and at most the sources.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    state, _ = stored(sources.withColumn("capped", F.lit(False)), "sources")
    while True:
        free = state.agg(
            F.coalesce(F.sum(F.when(F.col("capped"), cap)), F.lit(0.0)).alias("c"),
            F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0.0)).alias("w"),
        ).first()
        rest = total - free["c"]
        fair = F.lit(0.0) if free["w"] <= 0 else F.col("weight") * F.lit(float(rest)) / F.lit(float(free["w"]))
        over = ~F.col("capped") & (fair > cap)
        if free["w"] <= 0 or state.where(over).isEmpty():
            return state.withColumn("target", F.when(F.col("capped"), cap).otherwise(fair).cast("double")).drop("capped")
        state, _ = stored(state.withColumn("capped", F.col("capped") | over), "sources")


def ranked(sources: DataFrame) -> DataFrame:
    """sources (source, ...) with `rank` from 0 in code-point order, null last: a count a range, and places inside each range."""
    order = F.col("source").asc_nulls_last()
    dealt, _ = stored(sources.repartitionByRange(order).withColumn("__p", F.spark_partition_id()), "ranked")
    before = F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1))
    # a row a range: as many as shuffle partitions
    ranges = dealt.groupBy("__p").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(before, F.lit(0))).drop("n")
    inside = F.row_number().over(W.partitionBy("__p").orderBy(order)) - 1
    return dealt.withColumn("__in", inside).join(ranges, "__p").withColumn("rank", F.col("__before") + F.col("__in")).drop("__p", "__before", "__in")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: str = "42", digits: int = 3, keep_rows: bool = False,
) -> DataFrame:
    """What the mix takes of each row; weights repeat over the sources in code-point order.

    With keep_rows, the struct `row` has all columns of docs, and `copies` says how often the mix holds the row.
    """
    docs, name = named_rows(docs)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":"), F.coalesce(docs[source_col], F.lit(""))))
    sized, _ = stored(
        docs.select(name.alias("rid"), docs[id_col].alias("doc_id"), docs[source_col].alias("source"), size_of(docs[text_col]).alias("size"), key.alias("k"), F.xxhash64(docs[text_col]).alias("t")), "sizes",
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    listed = ranked(sums).withColumn("weight", weight).drop("rank")
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    targets = water_fill(listed, share * total, max_epochs)
    head = F.substring("k", 1, digits)
    groups = sized.groupBy("source", head.alias("head")).agg(F.sum("size").alias("words"))
    before = F.sum("words").over(W.partitionBy("source").orderBy("head").rowsBetween(W.unboundedPreceding, -1))
    # At most 16 ** digits rows a source.
    starts = groups.withColumn("start", F.coalesce(before, F.lit(0))).drop("words")
    plan = starts.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "a.head", "a.start", "b.source_size", "b.target")
    within = F.sum("size").over(W.partitionBy("source", "head").orderBy("k", "doc_id", "size", "t").rowsBetween(W.unboundedPreceding, -1))
    narrow = sized.select("rid", "doc_id", "source", "size", "k", "t", head.alias("head"))
    placed = narrow.withColumn("inside", F.coalesce(within, F.lit(0)))
    joined = placed.alias("d").join(plan.alias("p"), (F.col("d.head") == F.col("p.head")) & F.col("d.source").eqNullSafe(F.col("p.source")))
    whole = F.floor(F.col("target") / F.col("source_size"))
    part = F.col("target") - whole * F.col("source_size")
    middle = F.col("start") + F.col("inside") + F.col("size") / F.lit(2.0)
    copies = F.when(F.col("source_size") > 0, whole + F.when((part > 0) & (middle <= part), 1).otherwise(0)).otherwise(F.lit(0)).cast("long")
    out = joined.select(
        "rid", "d.doc_id", "d.source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )
    rows = docs.select(name.alias("rid"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return out.join(rows.hint("merge"), "rid").drop("rid") if keep_rows else out.drop("rid")
