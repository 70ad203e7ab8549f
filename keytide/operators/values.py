"""What commands read from, and make of, state tables: strings, lists, sets, sorted sets, places and keys.

State tables: strings (key, value), hashes (key, field, value), lists (key, pos, value), sets (key, member), zsets (key, member,
score), places (key, member, lon, lat). A command over many keys is one join or one aggregate; nothing is collected.
Windows are by key and serve results that are themselves an order of that key's members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.functions import bits
from keytide.operators.keyspace import slice_bounds

# strings


def mget(strings: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (..., key) with `value`, null where the key isn't there."""
    return asked.join(strings.select("key", "value"), "key", "left")


def mset(strings: DataFrame, calls: DataFrame) -> DataFrame:
    """strings after MSETs: calls (idx, pairs map<string,string>); the last pair of a key wins."""
    given = calls.select("idx", F.explode("pairs").alias("key", "value")).groupBy("key").agg(F.max_by("value", "idx").alias("value"))
    return strings.join(given.select("key"), "key", "left_anti").select("key", "value").unionByName(given)


def msetnx(strings: DataFrame, calls: DataFrame) -> DataFrame:
    """calls (idx, pairs) with `reply`, for calls whose keys don't meet: 1 where none of the keys is there, else 0."""
    keys = calls.select("idx", F.explode(F.map_keys("pairs")).alias("key")).join(strings.select("key", F.lit(1).alias("__h")), "key", "left")
    busy = keys.groupBy("idx").agg(F.count("__h").alias("__n"))
    return calls.join(busy, "idx").select(*calls.columns, (F.col("__n") == 0).cast("int").alias("reply"))


def setrange(value: Column, offset: int, new: Column) -> Column:
    """Bytes of a value with new ones from an offset on, zero bytes between."""
    filled = F.rpad(value, F.greatest(F.octet_length(value), F.lit(offset)), F.lit(b"\0"))
    return F.when(F.octet_length(new) == 0, value).otherwise(F.overlay(filled, new, F.lit(offset + 1)))


def bitfield(value: Column, width: int, at: int) -> Column:
    """The unsigned field of up to 32 bits at a bit place; bits beyond the end are zero."""
    first, last = at // 8, (at + width - 1) // 8
    raw = F.rpad(F.substring(F.hex(value), 2 * first + 1, 2 * (last - first + 1)), 2 * (last - first + 1), "0")
    whole = F.conv(raw, 16, 10).cast("long")
    return F.shiftright(whole, 8 * (last + 1) - at - width).bitwiseAND(F.lit((1 << width) - 1))


# lists


def _counted(lists: DataFrame) -> DataFrame:
    return lists.join(lists.groupBy("key").agg(F.count("*").alias("__n")), "key")


def trimmed(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """LTRIM: items at start..stop, numbered anew."""
    low, high = slice_bounds(F.col("__n"), start, stop)
    return _counted(lists).where((F.col("pos") >= low) & (F.col("pos") <= high)).select("key", (F.col("pos") - low).cast("int").alias("pos"), "value")


def set_at(lists: DataFrame, at: int, value: Column) -> DataFrame:
    """LSET: the item at a place, from the end if negative, replaced; lists that are too short stay."""
    place = F.lit(at) if at >= 0 else F.col("__n") + at
    return _counted(lists).select("key", "pos", F.when(F.col("pos") == place, value).otherwise(F.col("value")).alias("value"))


def inserted(lists: DataFrame, pivot: Column, value: Column, after: bool = False) -> DataFrame:
    """LINSERT: a value before or after the first item that equals the pivot; lists without it stay."""
    at = lists.where(F.col("value") == pivot).groupBy("key").agg(F.min("pos").alias("__p"))
    place = F.col("__p") + int(after)
    moved = lists.join(at, "key", "left").select("key", F.when(F.col("pos") >= place, F.col("pos") + 1).otherwise(F.col("pos")).cast("int").alias("pos"), "value")
    return moved.unionByName(at.select("key", place.cast("int").alias("pos"), value.alias("value")))


def removed(lists: DataFrame, count: int, value: Column) -> DataFrame:
    """LREM: up to count items that equal a value removed, from the head, from the tail if negative, all if 0; the others numbered anew."""
    order = F.desc("pos") if count < 0 else F.asc("pos")
    hit = F.col("value") == value
    nth = F.sum(hit.cast("int")).over(W.partitionBy("key").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    gone = hit & (F.lit(count == 0) | (nth <= abs(count)))
    kept = lists.withColumn("__g", F.coalesce(gone, F.lit(False))).where("not __g")
    return kept.select("key", (F.row_number().over(W.partitionBy("key").orderBy("pos")) - 1).cast("int").alias("pos"), "value")


def popped(lists: DataFrame, left: bool) -> tuple[DataFrame, DataFrame]:
    """(key, value) from the head or the tail of each list, and the lists without it."""
    ends = lists.groupBy("key").agg((F.min_by if left else F.max_by)("value", "pos").alias("value"))
    rest = trimmed(lists, 1, -1) if left else trimmed(lists, 0, -2)
    return ends, rest


def moved_tail(lists: DataFrame, target: Column) -> DataFrame:
    """RPOPLPUSH of every list to the head of the list named target, where those differ from all lists that are popped."""
    values, rest = popped(lists, False)
    pushed = values.select(target.alias("key"), F.lit(0).alias("pos"), "value")
    return rest.unionByName(pushed)


def pushed_if(lists: DataFrame, pushes: DataFrame, left: bool) -> DataFrame:
    """(key, reply): the length after LPUSHX or RPUSHX of one value each (pushes: key), 0 where there is no list."""
    n = lists.groupBy("key").agg(F.count("*").alias("__n"))
    more = pushes.groupBy("key").agg(F.count("*").alias("__m"))
    return more.join(n, "key", "left").select("key", F.coalesce(F.col("__n") + F.col("__m"), F.lit(0)).cast("long").alias("reply"))


# sets and hashes


def smove(source: DataFrame, target: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (member) that move from one set to another; those that aren't in the source don't."""
    going = source.join(moved.select("member").distinct(), "member", "left_semi")
    return source.join(going, "member", "left_anti"), target.unionByName(going).distinct()


def stored(sets: DataFrame, target: str, members: DataFrame) -> DataFrame:
    """sets with the members of one key replaced; an empty result removes the key."""
    return sets.where(F.col("key") != target).select("key", "member").unionByName(members.select(F.lit(target).alias("key"), "member").distinct())


def page_after(items: DataFrame, name: str, cursor: Column, count: int) -> DataFrame:
    """items (key, name) after a cursor, the first count of each key in byte order, with `cursor`: the last one's name where more follow, else 0."""
    w = W.partitionBy("key").orderBy(name)
    left = items.where(F.col(name) > cursor).withColumn("__k", F.row_number().over(w))
    # one more than the page shows whether the cursor has ended
    page = left.where(F.col("__k") <= count + 1)
    more = F.max("__k").over(W.partitionBy("key")) > count
    last = F.max(F.when(F.col("__k") <= count, F.col(name))).over(W.partitionBy("key"))
    return page.withColumn("cursor", F.when(more, last).otherwise("0")).where(F.col("__k") <= count).drop("__k")


def listed(items: DataFrame, name: str) -> DataFrame:
    """(key, reply): the distinct names of each key in byte order."""
    return items.groupBy("key").agg(F.array_sort(F.collect_list(name)).alias("reply"))


def random_of(items: DataFrame, name: str, seed: int, n: int = 1) -> DataFrame:
    """(key, name): n members of each key, chosen by a seeded hash, so that replays agree."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "key", name))
    return items.withColumn("__k", F.row_number().over(W.partitionBy("key").orderBy(order, name))).where(F.col("__k") <= n).drop("__k")


# places


def radius_by_member(places: DataFrame, centres: DataFrame, metres: float) -> DataFrame:
    """(key, centre, member): members within metres of a member (centres: key, centre) of the same key.

    Latitude bands as high as the radius are joined with their neighbours, so a key's members don't all meet.
    """
    band = metres / 111_000.0
    at = F.floor(F.col("lat") / band)
    c = centres.join(places.select("key", F.col("member").alias("centre"), F.col("lon").alias("__x"), F.col("lat").alias("__y")), ["key", "centre"])
    c = c.withColumn("__b", F.explode(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.floor(F.col("__y") / band) + k)))
    near = places.withColumn("__b", at).join(c, ["key", "__b"])
    return near.where(bits.haversine_m(F.col("__x"), F.col("__y"), F.col("lon"), F.col("lat")) <= metres).select("key", "centre", "member")


# keys


def exists(keyspace: DataFrame, asked: DataFrame, by: str = "idx") -> DataFrame:
    """(by, reply): how many of the keys (by, key) are there, named twice counting twice; EXISTS and TOUCH."""
    held = asked.join(keyspace.select("key").distinct().withColumn("__h", F.lit(1)), "key", "left")
    return held.groupBy(by).agg(F.count("__h").alias("reply"))


def renamed(state: DataFrame, names: DataFrame, only_new: bool = False) -> DataFrame:
    """A state table (key, ...) after RENAMEs (key, new) whose keys and new names don't meet; what a new name held is gone, unless only_new keeps it."""
    names = names.join(state.select("key").distinct(), "key", "left_semi")
    if only_new:
        names = names.join(state.select(F.col("key").alias("new")).distinct(), "new", "left_anti").select("key", "new")
    rest = state.join(names.select(F.col("new").alias("key")), "key", "left_anti")
    return rest.join(names, "key", "left").withColumn("key", F.coalesce("new", "key")).drop("new")


def sort_by(items: DataFrame, weights: DataFrame, gets: DataFrame | None = None, desc: bool = False) -> DataFrame:
    """(key, pos, value, got): SORT BY a pattern's value (weights: item, weight; none counts as 0) and GET of another (gets: item, got)."""
    w = items.join(weights.select(F.col("item").alias("value"), "weight"), "value", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    order = [F.desc("weight"), F.desc("value")] if desc else ["weight", "value"]
    out = w.select("key", "value", (F.row_number().over(W.partitionBy("key").orderBy(*order)) - 1).alias("pos"))
    return out.join(gets.select(F.col("item").alias("value"), "got"), "value", "left") if gets is not None else out
