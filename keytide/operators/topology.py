"""Shard groups and slots: routing, validation and topology replies.

A topology is a table of ranges: group_id, local, start, end, type (1 stable, 2 importing, 3 migrating), session_key,
position (order of the range), and a table of nodes: group_id, node_no, node_id, host, port.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.functions import slots
from keytide.functions.slots import N_SLOTS
from keytide.operators.logops import last_before, max_before, running_sum

#: Types of slot ranges.
STABLE, IMPORTING, MIGRATING = 1, 2, 3


def valid_range(start: Column, end: Column, kind: Column, session: Column) -> Column:
    return start.between(0, N_SLOTS - 1) & end.between(0, N_SLOTS - 1) & (start <= end) & kind.isin(STABLE, IMPORTING, MIGRATING) & (session >= 0)


def slot_map(ranges: DataFrame) -> DataFrame:
    """A row per slot: owner of each type and its locality. At most 16384 rows, so it may be broadcast."""
    per_slot = ranges.select("group_id", "local", "type", "position", F.explode(F.sequence("start", "end")).alias("slot"))
    pick = lambda t: F.max_by(F.when(F.col("type") == t, F.struct("group_id", "local")), F.when(F.col("type") == t, F.col("position")))
    return per_slot.groupBy("slot").agg(pick(STABLE).alias("stable"), pick(IMPORTING).alias("importing"), pick(MIGRATING).alias("migrating"))


def owner(asking: Column) -> Column:
    """The group that answers for a slot: stable, then a local migrating one, then, when asked for, a local importing one, then a migrating one."""
    return (
        F.when(F.col("stable").isNotNull(), F.struct(F.lit(STABLE).alias("type"), "stable.group_id", "stable.local"))
        .when(F.col("migrating.local"), F.struct(F.lit(MIGRATING).alias("type"), "migrating.group_id", "migrating.local"))
        .when(asking & F.col("importing.local"), F.struct(F.lit(IMPORTING).alias("type"), "importing.group_id", "importing.local"))
        .when(F.col("migrating").isNotNull(), F.struct(F.lit(MIGRATING).alias("type"), "migrating.group_id", "migrating.local"))
    )


def existence(n_keys: Column, n_exist: Column, n_locked: Column) -> Column:
    """Keys of a command: ALL, SOME, NONE or LOCKED; an existing locked key decides, no keys count as ALL."""
    return F.when(n_locked > 0, "LOCKED").when(n_exist == n_keys, "ALL").when(n_exist == 0, "NONE").otherwise("SOME")


def key_classes(keys: DataFrame, keyspace: DataFrame, locks: DataFrame, entries: DataFrame | None = None, by: str = "txn") -> DataFrame:
    """(by, exist): the class of the keys (by, key) of each entry, by joins with the keys that exist and those that are locked.

    A locked key counts only where it exists. Entries (by) without keys are ALL.
    """
    here = keyspace.select("key").distinct().withColumn("__here", F.lit(1))
    held = locks.select("key").distinct().withColumn("__held", F.lit(1))
    marked = keys.select(by, "key").distinct().join(here, "key", "left").join(held, "key", "left")
    counted = marked.groupBy(by).agg(F.count("*").alias("n"), F.count("__here").alias("e"), F.count_if(F.col("__here").isNotNull() & F.col("__held").isNotNull()).alias("l"))
    if entries is not None:
        counted = entries.select(by).distinct().join(counted, by, "left").na.fill(0, ["n", "e", "l"])
    return counted.select(by, existence(F.col("n"), F.col("e"), F.col("l")).alias("exist"))


def decide(commands: DataFrame, slot_owners: DataFrame, nodes: DataFrame) -> DataFrame:
    """commands (idx, slot, asking, exist) with `outcome`: OK, MOVED, ASK, TRYAGAIN, CLUSTERDOWN, CROSSSLOT or an error.

    The slot map is broadcast (16384 rows at most), as is the first node of each group. A redirect to a remote group
    goes round its nodes, beginning with the second; redirects are numbered in two levels, so a hot group is many tasks' work.
    The slot is that of cross_slot: null where keys differ in it, -1 without keys, which goes through.
    """
    placed = commands.join(F.broadcast(slot_owners), "slot", "left").withColumn("owner", owner(F.col("asking")))
    counts = nodes.groupBy("group_id").agg(F.count("*").alias("n_nodes"))
    remote = F.col("owner").isNotNull() & ~F.col("owner.local")
    numbered = running_sum(placed.withColumn("__own", F.col("owner.group_id")), F.when(remote, 1).otherwise(0), "turn", keys=("__own",))
    turned = numbered.join(counts.withColumnRenamed("group_id", "__g"), F.col("__own") == F.col("__g"), "left")
    target = turned.withColumn("target_no", F.when(remote, F.col("turn") % F.col("n_nodes")))
    # which group's address: the owner's for a redirect, the importing group's first node to ask
    at = nodes.select(F.col("group_id").alias("__tg"), F.col("node_no").alias("__tn"), F.concat_ws(":", "host", "port").alias("__addr"))
    ask = nodes.where("node_no = 0").select(F.col("group_id").alias("__ag"), F.concat_ws(":", "host", "port").alias("__ask"))
    joined = target.join(at, (F.col("owner.group_id") == F.col("__tg")) & (F.col("target_no") == F.col("__tn")), "left").join(ask, F.col("importing.group_id") == F.col("__ag"), "left")
    kind, exist = F.col("owner.type"), F.col("exist")
    word = lambda head, addr: F.concat_ws(" ", F.lit(head), F.col("slot"), addr)
    outcome = (
        F.when(F.col("slot").isNull(), "CROSSSLOT").when(F.col("slot") < 0, "OK").when(F.col("owner").isNull(), "CLUSTERDOWN")
        .when(~F.col("owner.local"), word("MOVED", F.col("__addr")))
        .when((kind == MIGRATING) & exist.isin("SOME", "LOCKED"), "TRYAGAIN")
        .when((kind == MIGRATING) & (exist == "NONE"), F.when(F.col("__ask").isNotNull(), word("ASK", F.col("__ask"))).otherwise("ERR no importing shard group to ask"))
        .when((kind == IMPORTING) & (exist != "ALL"), "TRYAGAIN").otherwise("OK")
    )
    return joined.select(*commands.columns, F.col("owner.group_id").alias("owner"), outcome.alias("outcome"))


def cross_slot(keys: DataFrame, by: str = "txn", entries: DataFrame | None = None) -> DataFrame:
    """(by, slot, crossed): the slot of all keys of an entry, null when they differ; with entries (by), -1 for those without keys."""
    g = keys.groupBy(by).agg(F.min("slot").alias("low"), F.max("slot").alias("high"))
    if entries is not None:
        g = entries.select(by).distinct().join(g, by, "left").na.fill(-1, ["low", "high"])
    return g.select(by, F.when(F.col("low") == F.col("high"), F.col("low")).alias("slot"), (F.col("low") != F.col("high")).alias("crossed"))


def violations(ranges: DataFrame) -> DataFrame:
    """(slot, position, reason) of every clash in a replacement of all groups; none means it is valid.

    Ranges apply in order of position: a slot that is stable already is owned; a stable range on a moving slot is marked
    for resharding; a slot has one importer and one migrator. A running count per slot, over the ranges that hold it.
    """
    per_slot = ranges.select("type", "position", F.explode(F.sequence("start", "end")).alias("slot"))
    before = W.partitionBy("slot").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    seen = lambda t: F.coalesce(F.count_if(F.col("type") == t).over(before), F.lit(0)) > 0
    marked = per_slot.withColumn("s", seen(STABLE)).withColumn("i", seen(IMPORTING)).withColumn("m", seen(MIGRATING))
    reason = (
        F.when(F.col("s"), "owned").when((F.col("type") == STABLE) & (F.col("i") | F.col("m")), "resharding")
        .when((F.col("type") == IMPORTING) & F.col("i"), "importing").when((F.col("type") == MIGRATING) & F.col("m"), "migrating")
    )
    return marked.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("slot", "position", "reason")


def overlaps(new: DataFrame, present: DataFrame) -> DataFrame:
    """(group_id, slot): slots of new ranges that present ranges hold; equal slots, at most 16384 on a side."""
    held = lambda r: r.select("group_id", F.explode(F.sequence("start", "end")).alias("slot"))
    return held(new).join(F.broadcast(held(present).select("slot").distinct()), "slot", "left_semi").select("group_id", "slot").distinct()


def range_text(ranges: DataFrame) -> DataFrame:
    """(group_id, slots): '0-500 800-1000' of the ranges that aren't being imported, in order."""
    part = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat_ws("-", "start", "end"))
    listed = F.array_sort(F.collect_list(F.when(F.col("type") != IMPORTING, F.struct("position", part.alias("t")))))
    return ranges.groupBy("group_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), " ").alias("slots"))


def cluster_slots(ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(start, end, nodes) of each range that isn't being imported, the first node first."""
    listed = nodes.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("node_no", "node_id", "host", "port"))).alias("nodes"))
    return ranges.where(F.col("type") != IMPORTING).join(listed, "group_id", "left").select("group_id", "start", "end", "nodes")


def cluster_shards(ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group_id, slots, nodes): flat pairs of stable and migrating ranges, and nodes with their roles."""
    held = F.filter(F.array_sort(F.collect_list(F.struct("position", "type", "start", "end"))), lambda x: x["type"].isin(STABLE, MIGRATING))
    pairs = ranges.groupBy("group_id").agg(F.flatten(F.transform(held, lambda x: F.array(x["start"], x["end"]))).alias("slots"))
    role = F.when(F.col("node_no") == 0, "master").otherwise("replica")
    listed = nodes.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("node_no", "node_id", "host", "port", role.alias("role")))).alias("nodes"))
    return pairs.join(listed, "group_id", "left")


def cluster_nodes(ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group_id, node_no, line): the text line of each node; later nodes name the first as their master."""
    first = nodes.where("node_no = 0").select("group_id", F.col("node_id").alias("master"))
    lead = F.col("node_no") == 0
    text = range_text(ranges)
    joined = nodes.join(first, "group_id").join(text, "group_id", "left")
    line = F.format_string("%s %s:%d@%d %s %s 0 0 0 connected %s", "node_id", "host", "port", "port", F.when(lead, "master").otherwise("slave"), F.when(lead, "-").otherwise(F.col("master")), F.when(lead, F.coalesce("slots", F.lit(""))).otherwise(""))
    return joined.select("group_id", "node_no", line.alias("line"))


def move_notes(ranges: DataFrame, first_nodes: DataFrame) -> DataFrame:
    """(slot, note): ' [slot-<-id]' for imported and ' [slot->-id]' for migrating slots of local groups, naming the other side."""
    moving = ranges.where(F.col("type") != STABLE).select("group_id", "local", "type", F.explode(F.sequence("start", "end")).alias("slot"))
    here, there = moving.where("local").alias("h"), moving.alias("t")
    other = here.join(there, (F.col("h.slot") == F.col("t.slot")) & (F.col("h.type") + F.col("t.type") == IMPORTING + MIGRATING))
    named = other.join(first_nodes.alias("n"), F.col("t.group_id") == F.col("n.group_id"))
    arrow = F.when(F.col("h.type") == IMPORTING, "<").otherwise(">")
    return named.select(F.col("h.slot").alias("slot"), F.format_string(" [%d-%s-%s]", F.col("h.slot"), arrow, F.col("n.node_id")).alias("note"))


def fence(imports: DataFrame, restarts: DataFrame | None = None) -> DataFrame:
    """imports (idx, slot, term, session_key, importing, slot_session) with `status`: ok, slot, session or term.

    A term must not be below the largest accepted one of its slot; as rejected terms are below it, the plain running
    maximum over imports that pass the other tests is exact. It begins again from 0 at each of restarts (idx, slot): the slot
    became stable or migrating in the local group.
    """
    names = imports.columns
    passes = F.col("importing") & (F.col("session_key") == F.col("slot_session"))
    rows = imports.withColumn("__epoch", F.lit(0).cast("long"))
    if restarts is not None:
        marks = imports.select(*names, F.lit(0).alias("__r")).unionByName(restarts.select("idx", "slot", F.lit(1).alias("__r")), allowMissingColumns=True)
        rows = running_sum(marks, F.col("__r"), "__epoch", keys=("slot",)).where("__r = 0")
    found = max_before(rows, F.when(passes, F.col("term")), "__top", keys=("slot", "__epoch"))
    status = F.when(~F.col("importing"), "slot").when(~passes, "session").when(F.col("term") < F.coalesce("__top", F.lit(0)), "term").otherwise("ok")
    return found.select(*names, status.alias("status"))


def as_of(events: DataFrame, configs: DataFrame, value: str = "config") -> DataFrame:
    """events (idx) with the last config (idx, value) at or before them: one order over both, in two levels, no range join."""
    kind = configs.schema[value].dataType
    both = events.select("idx", F.lit(1).alias("__e"), F.lit(None).cast(kind).alias(value)).unionByName(configs.select("idx", F.lit(0).alias("__e"), value))
    # a config comes before an event at the same index
    found = last_before(both.withColumn("__o", F.col("idx") * 2 + F.col("__e")), F.col("__e") == 0, F.col(value), "__found", order="__o")
    return found.where("__e = 1").select("idx", F.col("__found").alias(value))


def scan_page(keys: DataFrame, wanted: DataFrame, cursor: str = "", count: int = 1000) -> DataFrame:
    """(cursor, keys): a page of a scan of keys (key, slot) in byte order after a cursor, with the keys in wanted slots (slot) as 'key slot'.

    The page is cut before slots are looked at, so it may be empty while keys follow; the cursor is its last key, or empty at the end.
    """
    page = keys.where(F.col("key") > cursor).orderBy("key").limit(count + 1).select("key", "slot", F.row_number().over(W.orderBy("key")).alias("__k"))
    held = page.join(F.broadcast(wanted.select("slot").distinct().withColumn("__w", F.lit(True))), "slot", "left")
    shown = F.array_sort(F.collect_list(F.when(F.col("__w") & (F.col("__k") <= count), F.struct("key", "slot"))))
    last = F.max(F.when(F.col("__k") <= count, F.col("key")))
    return held.agg(F.when(F.max("__k") > count, last).otherwise("").alias("cursor"), F.transform(shown, lambda x: F.concat_ws(" ", x["key"], x["slot"])).alias("keys"))


# log entries that change the topology


def same_nodes(a: Column, b: Column) -> Column:
    """Whether two groups have the same nodes (arrays of node_id, host, port), in order; ranges aren't compared."""
    return a.eqNullSafe(b)


def fold_groups(entries: DataFrame, local_id: str) -> DataFrame:
    """(group_id, slot_ranges, nodes): the groups in force after entries (idx, kind ADD | UPDATE | REPLACE, group_id, slot_ranges, nodes).

    A REPLACE entry has a row a group and drops all that came before, the local group too; an ADD brings a group; an
    UPDATE changes the nodes of a group that is there, not those of the local one. The last REPLACE is one maximum.
    """
    last = entries.where("kind = 'REPLACE'").agg(F.max("idx").alias("__last"))
    live = entries.crossJoin(F.broadcast(last)).where("__last is null or idx >= __last")
    added = live.where("kind in ('ADD', 'REPLACE')").groupBy("group_id").agg(F.max_by(F.struct("idx", "slot_ranges", "nodes"), "idx").alias("a"))
    changed = live.where((F.col("kind") == "UPDATE") & (F.col("group_id") != local_id)).groupBy(F.col("group_id").alias("__g")).agg(F.max_by(F.struct("idx", "nodes"), "idx").alias("u"))
    joined = added.join(changed, F.col("group_id") == F.col("__g"), "left")
    return joined.select("group_id", "a.slot_ranges", F.when(F.col("u.idx") > F.col("a.idx"), F.col("u.nodes")).otherwise(F.col("a.nodes")).alias("nodes"))


def slot_terms(entries: DataFrame, terms: DataFrame, local_id: str) -> DataFrame:
    """(slot, term): the largest importing term kept for each slot (terms: idx, slot, term) after entries (idx, group_id, slot_ranges).

    It starts again from 0 where the local group gets the slot as stable or migrating.
    """
    local = entries.where(F.col("group_id") == local_id).select("idx", F.explode("slot_ranges").alias("r")).where(F.col("r.type").isin(STABLE, MIGRATING))
    resets = local.select("idx", F.explode(F.sequence("r.start", "r.end")).alias("slot")).groupBy("slot").agg(F.max("idx").alias("__r"))
    kept = terms.join(resets, "slot", "left").groupBy("slot").agg(F.max(F.when(F.col("__r").isNull() | (F.col("idx") > F.col("__r")), F.col("term"))).alias("term"))
    return kept.select("slot", F.coalesce("term", F.lit(0)).cast("long").alias("term"))


def is_sharding(groups: DataFrame) -> DataFrame:
    """One row, whether the groups hold anything but one stable group with all slots."""
    r = groups.select("group_id", F.explode_outer("slot_ranges").alias("r"))
    return r.agg(((F.count_distinct("group_id") > 1) | (F.max(F.col("r.type")) > STABLE) | (F.min(F.col("r.start")) > 0) | (F.max(F.col("r.end")) < 16383)).alias("sharding"))


def shard_group_get(groups: DataFrame, local_id: str) -> DataFrame:
    """(group_id, ranges, nodes) of the local group: ranges as 'start end type', nodes as 'id host:port'."""
    spans = F.transform("slot_ranges", lambda r: F.concat_ws(" ", r["start"], r["end"], r["type"]))
    nodes = F.transform("nodes", lambda n: F.concat(n["node_id"], F.lit(" "), n["host"], F.lit(":"), n["port"]))
    return groups.where(F.col("group_id") == local_id).select("group_id", spans.alias("ranges"), nodes.alias("nodes"))


def parse_group(argv: Column) -> Column:
    """Struct (group, error) of an argument vector: id, numbers of ranges and nodes, four values a range, two a node.

    Ids have 32 letters at most, node ids 40; ranges and types must be valid, session keys not negative; numbers must
    agree with the length. One of group and error is null.
    """
    number = lambda k: F.get(argv, k).try_cast("int")
    n_ranges, n_nodes = number(F.lit(1)), number(F.lit(2))
    size = 3 + 4 * n_ranges + 2 * n_nodes
    places = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    ranges = F.transform(
        places(n_ranges),
        lambda k: F.struct(*[number(4 * k + 3 + i).alias(n) for i, n in enumerate(("start", "end", "type"))], F.get(argv, 4 * k + 6).try_cast("decimal(20,0)").alias("session_key")),
    )
    where = lambda k: slots.address(F.get(argv, 3 + 4 * n_ranges + 2 * k + 1))
    nodes = F.transform(places(n_nodes), lambda k: F.struct(F.get(argv, 3 + 4 * n_ranges + 2 * k).alias("node_id"), where(k)["host"].alias("host"), where(k)["port"].alias("port")))
    bad_range = F.exists(ranges, lambda r: ~F.coalesce((r["start"] >= 0) & (r["start"] <= r["end"]) & (r["end"] < slots.N_SLOTS), F.lit(False)))
    bad_type = F.exists(ranges, lambda r: ~F.coalesce(r["type"].isin(STABLE, IMPORTING, MIGRATING), F.lit(False)))
    bad_key = F.exists(ranges, lambda r: ~F.coalesce(r["session_key"] >= 0, F.lit(False)))
    bad_node = F.exists(nodes, lambda n: ~F.coalesce((F.length(n["node_id"]) <= 40) & (n["node_id"] != "") & n["port"].isNotNull(), F.lit(False)))
    error = (
        F.when(F.size(argv) < 3, "wrong number of arguments").when(F.length(F.get(argv, 0)) > 32, "invalid id").when(n_ranges.isNull() | n_nodes.isNull() | (n_ranges < 0) | (n_nodes < 0), "invalid number")
        .when(F.size(argv) != size, "wrong number of arguments").when(bad_range, "invalid slot range").when(bad_type, "invalid slot type").when(bad_key, "invalid session key").when(bad_node, "invalid node")
    )
    group = F.struct(F.get(argv, 0).alias("group_id"), ranges.alias("slot_ranges"), nodes.alias("nodes"))
    return F.struct(F.when(error.isNull(), group).alias("group"), error.alias("error"))


def subcommand(argv: Column) -> Column:
    """What a SHARDGROUP command does: GET, ADD, REPLACE or LINK, in any case; beginnings of these count, in this order."""
    word = F.upper(F.get(argv, 0))
    out = F.when(word == "", F.lit(None))
    for name in ("GET", "ADD", "REPLACE", "LINK"):
        out = out.when(F.startswith(F.lit(name), word), name)
    return out


def reused_ids(joining: DataFrame, used: DataFrame) -> DataFrame:
    """joining (node_id) with `reused`: whether the id was used before; used ids are never many, but nothing is broadcast by hint."""
    return joining.join(used.select("node_id").distinct().withColumn("__u", F.lit(True)), "node_id", "left").select(*joining.columns, F.coalesce("__u", F.lit(False)).alias("reused"))


def merge_remote(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """Shard groups known (group_id, nodes, as_of) after fetches (group_id, nodes, as_of, redirect): the newest answer of each group.

    A fetch that was answered by a redirect brings the address to ask next, not a group; such rows change nothing.
    """
    answers = fetched.where("redirect is null").select("group_id", "nodes", "as_of")
    return known.select("group_id", "nodes", "as_of").unionByName(answers).groupBy("group_id").agg(F.max_by("nodes", "as_of").alias("nodes"), F.max("as_of").alias("as_of"))
