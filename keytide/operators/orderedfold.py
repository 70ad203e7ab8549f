"""Ordered folds of state-dependent commands.

Rows are dealt by group (a slot, or a key where commands never meet), sorted by (group, idx) inside partitions, and run
through the store as a stream: a task holds the state of one group at a time, never its log. Groups are the grain of
parallelism; a log whose commands stay within a hash tag may be dealt by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.functions.interpreter import BlockingStore, Store


def text_of(reply: object) -> str | None:
    return None if reply is None else "[" + ",".join("nil" if x is None else str(x) for x in reply) + "]" if isinstance(reply, list) else str(reply)


def _run(kind: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, store = None, Store()

        def state() -> pd.DataFrame:
            return pd.DataFrame([(group, *r) for r in store.rows()], columns=["group", "key", "type", "field", "value"])

        for part in parts:
            replies = []
            for g, idx, argv, now in zip(part["group"], part["idx"], part["argv"], part["now"]):
                if g != group:
                    if kind == "state" and group is not None:
                        yield state()
                    group, store = g, Store()
                reply = store.apply(int(idx), [str(x) for x in argv], int(now))
                if kind == "replies":
                    replies.append((g, idx, text_of(reply)))
            if kind == "replies":
                yield pd.DataFrame(replies, columns=["group", "idx", "reply"])
        if kind == "state" and group is not None:
            yield state()

    return run


def _dealt(log: DataFrame, group: str) -> DataFrame:
    now = F.col("now") if "now" in log.columns else F.lit(0).cast("long")
    return log.select(F.col(group).cast("string").alias("group"), "idx", "argv", now.alias("now")).repartition("group").sortWithinPartitions("group", "idx")


def fold(log: DataFrame, group: str = "slot") -> DataFrame:
    """(group, key, type, field, value): the state after all commands (group, idx, argv array<string>, and now, milliseconds, for expiry)."""
    return _dealt(log, group).mapInPandas(_run("state"), "group string, key string, type string, field string, value string")


def replies(log: DataFrame, group: str = "slot") -> DataFrame:
    """(group, idx, reply): what each command answers."""
    return _dealt(log, group).mapInPandas(_run("replies"), "group string, idx long, reply string")


def _settled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    group, store = None, BlockingStore()
    columns = ["group", "idx", "settled_by", "reply"]

    def waiting() -> pd.DataFrame:
        return pd.DataFrame([(group, i, None, "WAITING") for i, _ in store.waiting], columns=columns)

    for part in parts:
        out = []
        for g, idx, argv, now in zip(part["group"], part["idx"], part["argv"], part["now"]):
            if g != group:
                if store.waiting:
                    yield waiting()
                group, store = g, BlockingStore()
            out += [(g, i, by, text_of(reply)) for i, by, reply in store.entry(int(idx), [str(x) for x in argv], int(now))]
        yield pd.DataFrame(out, columns=columns)
    if store.waiting:
        yield waiting()


def settled(log: DataFrame, group: str = "slot") -> DataFrame:
    """(group, idx, settled_by, reply) of each command where blocking ones wait: the entry that settled it, or none and WAITING."""
    return _dealt(log, group).mapInPandas(_settled, "group string, idx long, settled_by long, reply string")
