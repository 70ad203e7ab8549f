"""Operators on the log itself: batching by bytes, eviction, offsets, recovery, compaction and metrics.

Orders over a whole log are done in two levels: sums per bucket of indexes, then a running sum inside each bucket, so no
task sorts the whole log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET = 1 << 16


#: Columns by which rows and the sums of their bucket meet: the keys as one struct, in which nulls are equal, and the bucket.
AT = ["__k", "__b"]


def bucketed(log: DataFrame, order: str, keys: tuple[str, ...], width: int) -> DataFrame:
    return log.withColumn("__k", F.struct(F.lit(0).alias("all"), *[F.col(k) for k in keys])).withColumn("__b", F.floor(F.col(order) / width))


def running_sum(
    log: DataFrame, value: Column, out: str, order: str = "idx", inclusive: bool = True, keys: tuple[str, ...] = (), total: str | None = None, levels: int = 1, width: int = BUCKET,
) -> DataFrame:
    """log with the sum of value over rows of its keys up to its own (or before it), by order; with total, also the sum of all.

    Only rows of one bucket of `width` places meet in a task, whatever key they have, and rows are shuffled once. The sums of buckets,
    a row a key and bucket, are added up by key: one task for width * width places of a key, and again by buckets with more levels.
    """
    rows = bucketed(log, order, keys, width).withColumn("__v", value)
    sums = rows.groupBy(*AT).agg(F.sum("__v").alias("__s"))
    over = W.partitionBy("__k")
    if levels > 1:
        held = sums.select(F.col("__k").alias("__key"), F.col("__b").alias("__place"), "__s")
        deeper = running_sum(held, F.col("__s"), "__sofar", "__place", False, ("__key",), "__whole", levels - 1, width=width)
        before = deeper.select(F.col("__key").alias("__k"), F.col("__place").alias("__b"), F.col("__sofar").alias("__base"), F.col("__whole").alias("__total"))
    else:
        before = sums.select(*AT, F.coalesce(F.sum("__s").over(over.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.sum("__s").over(over).alias("__total"))
    inside = F.sum("__v").over(W.partitionBy(*AT).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    summed = rows.withColumn("__in", F.coalesce(inside, F.lit(0))).join(before, AT)
    gone = F.lit(0) if inclusive else F.coalesce("__v", F.lit(0))
    found = summed.withColumn(out, F.col("__base") + F.col("__in") - gone)
    return (found.withColumn(total, F.col("__total")) if total else found).drop(*AT, "__v", "__base", "__in", "__total")


def last_before(log: DataFrame, flag: Column, value: Column, out: str, order: str = "idx", keys: tuple[str, ...] = (), width: int = BUCKET) -> DataFrame:
    """log with `out`: value at the last row before its own, of its keys, that is flagged (null: none). Two levels, as running_sum."""
    rows = bucketed(log, order, keys, width).withColumn("__v", F.when(flag, F.struct(value.alias("v"))))
    ends = rows.groupBy(*AT).agg(F.max_by("__v", F.when(flag, F.col(order))).alias("__l"))
    over = W.partitionBy("__k").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("__carry", F.last("__l", True).over(over)).drop("__l")
    inside = F.last("__v", True).over(W.partitionBy(*AT).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("__in", inside).join(carried, AT).withColumn(out, F.coalesce("__in", "__carry")["v"]).drop(*AT, "__v", "__in", "__carry")


def max_before(log: DataFrame, value: Column, out: str, order: str = "idx", keys: tuple[str, ...] = (), width: int = BUCKET) -> DataFrame:
    """log with the largest value of the rows of its keys before its own (null: none). Two levels, as running_sum."""
    rows = bucketed(log, order, keys, width).withColumn("__v", value)
    over = W.partitionBy("__k").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy(*AT).agg(F.max("__v").alias("__l")).withColumn("__carry", F.max("__l").over(over)).drop("__l")
    inside = F.max("__v").over(W.partitionBy(*AT).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("__in", inside).join(carried, AT).withColumn(out, F.greatest("__in", "__carry")).drop(*AT, "__v", "__in", "__carry")


def offsets(log: DataFrame, size: Column, header: int = 0, levels: int = 1) -> DataFrame:
    """log with `offset`: where each record begins. levels as in running_sum: 2 from some 10^9 entries on."""
    return running_sum(log, size, "offset", inclusive=False, levels=levels).withColumn("offset", F.col("offset") + header)


def batch_by_bytes(log: DataFrame, start: int, limit: int, size: str = "data_len") -> DataFrame:
    """Entries from start whose sizes sum to at most limit; the first always."""
    summed = running_sum(log.where(F.col("idx") >= start), F.col(size), "total")
    return summed.where((F.col("idx") == start) | (F.col("total") <= limit))


def evict(cache: DataFrame, most: int, upto: int, overhead: int = 56, size: str = "data_len") -> DataFrame:
    """Entries that leave a cache: from the head, while it holds more than most bytes and the index is at most upto."""
    flipped = cache.withColumn("__n", -F.col("idx"))
    held = running_sum(flipped, F.col(size) + overhead, "held", "__n")
    return held.where((F.col("held") > most) & (F.col("idx") <= upto)).drop("__n")


def longest_prefix(log: DataFrame, bad: Column) -> DataFrame:
    """Rows before the first bad one: a minimum, then a filter."""
    first = log.where(bad).agg(F.min("idx").alias("__bad"))
    return log.crossJoin(F.broadcast(first)).where(F.col("__bad").isNull() | (F.col("idx") < F.col("__bad"))).drop("__bad")


def contiguous(log: DataFrame, start: int, n: int) -> DataFrame:
    """Up to n entries from start, ended by the first hole: a row counts while as many rows as places lie before it."""
    page = log.where(F.col("idx").between(start, start + n - 1))
    return running_sum(page, F.lit(1), "__k").where(F.col("__k") == F.col("idx") - start + 1).drop("__k")


def join_pages(first: DataFrame, second: DataFrame, second_prev_idx: int) -> DataFrame:
    """Both pages of a log, the second only if it isn't empty and goes on where the first ends."""
    end = first.agg(F.max("idx").alias("__end"))
    return first.unionByName(second.crossJoin(F.broadcast(end)).where(F.col("__end") == second_prev_idx).drop("__end"))


def bounds(log: DataFrame, prev: int = 0) -> DataFrame:
    """(first, current, count) of a log that begins after prev."""
    return log.agg(F.coalesce(F.min("idx"), F.lit(prev + 1)).cast("long").alias("first"), F.coalesce(F.max("idx"), F.lit(prev)).cast("long").alias("current"), F.count("*").alias("count"))


def fsync_metrics(times: DataFrame, value: str = "micros") -> DataFrame:
    total, n = F.coalesce(F.sum(value), F.lit(0)), F.count("*")
    average = F.coalesce(F.expr(f"sum({value}) div nullif(count(*), 0)"), F.lit(0))
    return times.agg(n.alias("count"), total.alias("total"), F.coalesce(F.max(value), F.lit(0)).alias("max"), average.cast("long").alias("average"))


def cache_bytes(cache: DataFrame, by: str, size: Column, overhead: int = 56) -> DataFrame:
    """(by, n, cached): entries of a cache and the bytes they take, an entry's own and its data's."""
    return cache.groupBy(by).agg(F.count("*").alias("n"), F.sum(size.cast("long") + overhead).alias("cached"))


def quorum_index(matches: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, committed): the largest index that a majority of nodes holds; nodes of a group are few."""
    held = F.sort_array(F.collect_list("match_idx"), asc=False)
    return matches.groupBy(group).agg(F.get(held, F.floor(F.count("*") / 2).cast("int")).alias("committed"))


def committed_index(matches: DataFrame, terms: DataFrame, current_term: int, group: str = "group_id") -> DataFrame:
    """(group, committed): the quorum index where its entry is of the current term (terms: group, idx, term), else null: nothing new is committed."""
    q = quorum_index(matches, group)
    held = terms.select(F.col(group).alias("__g"), F.col("idx").alias("__i"), "term")
    joined = q.join(held, (F.col(group) == F.col("__g")) & (F.col("committed") == F.col("__i")), "left")
    return joined.select(group, F.when(F.col("term") == current_term, F.col("committed")).alias("committed"))


def truncate_tail(log: DataFrame, from_idx: int) -> DataFrame:
    """The log without the entries from an index on; the bound reaches the scan."""
    return log.where(F.col("idx") < from_idx)


def reset(log: DataFrame, idx: int, term: int) -> tuple[DataFrame, DataFrame]:
    """An empty log that goes on after (idx, term), and its one-row header (prev_log_idx, prev_log_term)."""
    head = log.sparkSession.range(1).select(F.lit(idx).cast("long").alias("prev_log_idx"), F.lit(term).cast("long").alias("prev_log_term"))
    return log.where(F.lit(False)), head


def page_sizes(log: DataFrame, size: Column, page: Column, header: int) -> DataFrame:
    """(page, bytes): a header and the records of each page; the log's size is their sum."""
    return log.groupBy(page.alias("page")).agg((F.sum(size) + header).alias("bytes"))


def cache_first(wanted: DataFrame, cache: DataFrame, log: DataFrame) -> DataFrame:
    """wanted (idx) with the entry (columns of log but idx) and `hit`: from the cache where it holds the index, else from the log.

    Only indexes that miss are looked up in the log.
    """
    rest = [c for c in log.columns if c != "idx"]
    found = wanted.join(cache.select("idx", F.lit(True).alias("hit"), *rest), "idx", "left")
    missed = found.where("hit is null").select("idx").join(log, "idx", "left").select("idx", F.lit(False).alias("hit"), *rest)
    return found.where("hit").select("idx", "hit", *rest).unionByName(missed)


def uncommitted_replies(requests: DataFrame, committed: DataFrame) -> DataFrame:
    """requests (idx) with `reply`: that of the committed entry, TIMEOUT where leadership was lost before it was committed."""
    return requests.join(committed.select("idx", F.col("reply").alias("__r")), "idx", "left").select(*requests.columns, F.coalesce("__r", F.lit("TIMEOUT")).alias("reply"))


def membership(nodes: DataFrame) -> DataFrame:
    """(nodes, voting, listed): counts, and ids with v for voting and - for others, in order of the id."""
    listed = F.array_sort(F.collect_list(F.struct("node_id", F.when(F.col("voting"), "v").otherwise("-").alias("kind"))))
    return nodes.agg(F.count("*").alias("nodes"), F.count_if("voting").alias("voting"), F.array_join(F.transform(listed, lambda x: F.concat(x["node_id"].cast("string"), x["kind"])), ",").alias("listed"))


def admit(log: DataFrame, per_turn: int, width: int = BUCKET) -> DataFrame:
    """log with `turn`: the batch that applies each entry when a turn takes at most per_turn of them, in order."""
    return running_sum(log, F.lit(1), "__n", width=width).withColumn("turn", F.floor((F.col("__n") - 1) / per_turn)).drop("__n")


def info(entries: DataFrame, sessions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, value) lines of the log's report: entries, first and last index, bytes, open sessions, nodes and voting nodes."""
    e = entries.agg(F.count("*").alias("log_entries"), F.min("idx").alias("first_log_index"), F.max("idx").alias("current_log_index"), F.sum("data_len").cast("long").alias("log_bytes"))
    s = sessions.agg(F.count_distinct("client").alias("num_sessions"))
    n = nodes.agg(F.count("*").alias("num_nodes"), F.count_if("voting").alias("num_voting_nodes"))
    names = [*e.columns, *s.columns, *n.columns]
    row = e.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(n))
    return row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).cast("long").alias("value")) for x in names])).alias("x")).select("x.name", "x.value")


def cluster_enabled(info_text: Column) -> Column:
    """A report's text with cluster_enabled:1 in place of 0."""
    return F.regexp_replace(info_text, r"(?m)^cluster_enabled:0", "cluster_enabled:1")
