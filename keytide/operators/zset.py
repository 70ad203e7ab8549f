"""Sorted sets: (key, member, score) tables. Order is by score, then member in byte order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order(reverse: bool = False) -> list[Column]:
    return [F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")]


def ranks(z: DataFrame, reverse: bool = False, bands: int = 64) -> DataFrame:
    """z with rank from 0.

    Members are counted by key and band of scores (`bands` to each doubling of the score), and ranked inside their band, so
    a key that holds a third of all members is spread over its bands; members are shuffled once.
    """
    size = F.least(F.log2(F.abs(F.col("score").cast("double")) + 1), F.lit(1100.0)) * bands
    banded = z.withColumn("__b", F.floor(F.when(F.col("score") < 0, -size).otherwise(size)))
    counts = banded.groupBy("key", "__b").agg(F.count("*").alias("__n"))
    over = W.partitionBy("key").orderBy(F.desc("__b") if reverse else F.asc("__b")).rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(over), F.lit(0))).drop("__n")
    inside = F.row_number().over(W.partitionBy("key", "__b").orderBy(*order(reverse))) - 1
    placed = banded.withColumn("__in", inside).join(before, ["key", "__b"])
    return placed.select(*z.columns, (F.col("__before") + F.col("__in")).cast("int").alias("rank"))


def page(z: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Members of ranks start..stop, both in, negative from the end. Non-negative bounds plan a group limit, which cuts before the shuffle."""
    if start >= 0 and stop >= 0:
        numbered = z.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(*order(reverse))) - 1)
        return numbered.where(F.col("rank").between(start, stop))
    ranked = ranks(z, reverse)
    sizes = z.groupBy("key").agg(F.count("*").alias("__n"))
    bound = lambda v: F.col("__n") + v if v < 0 else F.lit(v)
    return ranked.join(sizes, "key").where((F.col("rank") >= bound(start)) & (F.col("rank") <= bound(stop))).drop("__n")


def bound(text: str) -> tuple[float, bool]:
    """A score bound and whether it is exclusive: '(5', '5', '-inf', '+inf'."""
    exclusive = text.startswith("(")
    return float(text[exclusive:]), exclusive


def in_range(low: str, high: str, score: str = "score") -> Column:
    (a, a_out), (b, b_out) = bound(low), bound(high)
    s = F.col(score)
    return (s > a if a_out else s >= a) & (s < b if b_out else s <= b)


def in_lex(low: str, high: str, member: str = "member") -> Column:
    """Byte-order range of members: '[a' in, '(a' out, '-' and '+' the ends."""
    m = F.col(member)
    above = F.lit(True) if low == "-" else F.lit(False) if low == "+" else (m >= low[1:] if low[0] == "[" else m > low[1:])
    below = F.lit(True) if high == "+" else F.lit(False) if high == "-" else (m <= high[1:] if high[0] == "[" else m < high[1:])
    return above & below


def count(z: DataFrame, low: str, high: str) -> DataFrame:
    return z.groupBy("key").agg(F.count_if(in_range(low, high)).alias("n"))


def pop(z: DataFrame, k: int, largest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The k first (or last) members of each key, and what remains."""
    top = page(z, 0, k - 1, largest)
    return top, z.join(top.select("key", "member"), ["key", "member"], "left_anti")


def combine(sources: list[tuple[DataFrame, float]], how: str = "sum", inter: bool = False) -> DataFrame:
    """(member, score): weighted union or intersection of (member, score) tables; scores meet by sum, min or max."""
    act = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    parts = [df.select("member", (F.col("score") * F.lit(w)).alias("score"), F.lit(k).alias("src")) for k, (df, w) in enumerate(sources)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    out = whole.groupBy("member").agg(act("score").alias("score"), F.count_distinct("src").alias("n") if inter else F.lit(len(parts)).alias("n"))
    return out.where(F.col("n") == len(parts)).drop("n")
