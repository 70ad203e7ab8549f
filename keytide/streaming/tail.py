"""Streaming forms: tailing a log into counters, waiters and sessions with state of their own.

Batch operators are the meaning; each stream gives the same rows. Timeouts are events of the log, never clocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructType

from keytide.functions.interpreter import BlockingStore
from keytide.operators.orderedfold import text_of


def apply_once(batch: DataFrame, applied: int) -> DataFrame:
    """Rows of a micro-batch that weren't applied before; for foreachBatch sinks that keep the last index with their state."""
    return batch.where(batch["idx"] > applied)


#: What a counter command does to a value with its number.
STEPS: dict[str, Callable[[int | None, int], int | None]] = {
    "SET": lambda value, n: n, "INCR": lambda value, n: (value or 0) + 1, "DECR": lambda value, n: (value or 0) - 1, "INCRBY": lambda value, n: (value or 0) + n, "DECRBY": lambda value, n: (value or 0) - n,
    "DEL": lambda value, n: None, "UNLINK": lambda value, n: None,
}


def counters(log: DataFrame) -> DataFrame:
    """Stream of (key, idx, value) after each batch's last change of a key; rows of a batch are put in order by idx, other commands are left out."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("idx")
        for cmd, num in zip(rows["cmd"], rows["num"]):
            value = STEPS[cmd](value, 0 if pd.isna(num) else int(num))
        state.update((value,))
        yield pd.DataFrame({"key": [key[0]], "idx": [int(rows["idx"].iloc[-1])], "value": [value]})

    return log.where(F.col("cmd").isin(*STEPS)).groupBy("key").applyInPandasWithState(step, "key string, idx long, value long", "value long", "update", GroupStateTimeout.NoTimeout)


def settled(log: DataFrame) -> DataFrame:
    """Stream of (group, idx, settled_by, reply) as commands (group, idx, argv) are settled, blocking ones by a later entry.

    The state of a group, its waiters with it, is kept with the stream's checkpoint, so a restart goes on where it stopped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        store = BlockingStore.load(state.get[0]) if state.exists else BlockingStore()
        rows = pd.concat(list(parts)).sort_values("idx")
        out = [(key[0], i, by, text_of(reply)) for idx, argv in zip(rows["idx"], rows["argv"]) for i, by, reply in store.entry(int(idx), [str(x) for x in argv])]
        state.update((store.dump(),))
        yield pd.DataFrame(out, columns=["group", "idx", "settled_by", "reply"])

    return log.groupBy("group").applyInPandasWithState(step, "group string, idx long, settled_by long, reply string", "store string", "append", GroupStateTimeout.NoTimeout)


class Sessions(StatefulProcessor):
    """Per client: opens at WATCH, closes at END or at a NO_OP that is sent to every client; emits (client, opened, closed)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opened = handle.getValueState("opened", StructType().add("idx", LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("idx")
        held = self.opened.get()
        opened, out = held[0] if held is not None else None, []
        for idx, event in zip(frame["idx"], frame["event"]):
            if event == "WATCH":
                opened = int(idx) if opened is None else opened
            elif opened is not None:
                out.append((key[0], opened, int(idx)))
                opened = None
        if opened is None:
            self.opened.clear()
        else:
            self.opened.update((opened,))
        yield pd.DataFrame(out, columns=["client", "opened", "closed"])

    def close(self) -> None:
        pass


def sessions(events: DataFrame) -> DataFrame:
    """Stream of sessions (client, opened, closed) that have ended, from (client, idx, event); needs the RocksDB state store."""
    schema = StructType().add("client", LongType()).add("opened", LongType()).add("closed", LongType())
    return events.groupBy("client").transformWithStateInPandas(Sessions(), schema, "append", "none")


class Waiters(StatefulProcessor):
    """Per key: waiting clients in order and elements in order; emits (key, waiter, served_by, value).

    Input rows: key, idx, event (WAIT, PUSH, TIMEOUT), ref (the index of the waiter that a TIMEOUT ends) and value.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", StructType().add("idx", LongType()))
        self.items = handle.getListState("items", StructType().add("idx", LongType()).add("value", StringType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("idx")
        waiting = [w[0] for w in self.waiting.get()]
        items = [(i[0], i[1]) for i in self.items.get()]
        out = []
        for idx, event, ref, value in zip(frame["idx"], frame["event"], frame["ref"], frame["value"]):
            if event == "WAIT":
                if items:
                    out.append((key[0], int(idx), *items.pop(0)))
                else:
                    waiting.append(int(idx))
            elif event == "PUSH":
                if waiting:
                    out.append((key[0], waiting.pop(0), int(idx), value))
                else:
                    items.append((int(idx), value))
            elif ref in waiting:
                waiting.remove(int(ref))
                out.append((key[0], int(ref), int(idx), None))
        for state, left in ((self.waiting, [(w,) for w in waiting]), (self.items, items)):
            state.put(left) if left else state.clear()
        yield pd.DataFrame(out, columns=["key", "waiter", "served_by", "value"])

    def close(self) -> None:
        pass


def waiters(events: DataFrame) -> DataFrame:
    """Stream of served and ended waiters; needs the RocksDB state store."""
    schema = StructType().add("key", StringType()).add("waiter", LongType()).add("served_by", LongType()).add("value", StringType())
    return events.groupBy("key").transformWithStateInPandas(Waiters(), schema, "append", "none")


def deliveries(messages: DataFrame, subscriptions: DataFrame, late: str = "10 minutes", longest: str = "1 day") -> DataFrame:
    """Stream of messages (ts, channel, message) to subscriptions (channel, client, since, until), both streams or the latter a table.

    Where both are streams, both have watermarks and a subscription is renewed at least once in `longest`, so state is bounded:
    a message joins subscriptions that began up to that long before it.
    """
    m = messages.withWatermark("ts", late) if messages.isStreaming else messages
    s = subscriptions.withWatermark("since", late) if subscriptions.isStreaming else subscriptions
    inside = (m["ts"] >= s["since"]) & (s["until"].isNull() | (m["ts"] < s["until"]))
    if messages.isStreaming and subscriptions.isStreaming:
        inside = inside & (m["ts"] <= s["since"] + F.expr(f"interval {longest}"))
    return m.join(s, (m["channel"] == s["channel"]) & inside).drop(s["channel"])


def publish_once(messages: DataFrame, path: str, checkpoint: str):
    """Starts a sink of messages that writes each row of (idx, ...) once: batches that come again after a restart are told by their index."""
    def write(batch: DataFrame, number: int) -> None:
        # a batch that is tried again overwrites what it wrote before
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def apply_state(log: DataFrame, state_path: str, checkpoint: str):
    """Starts a sink that keeps counters with the index they hold, so that every entry is applied exactly once.

    Each batch reads the last published state (key, value) and its index, applies entries beyond it, and publishes a new snapshot;
    a batch that comes again finds its entries applied.
    """
    from keytide.sources import snapshot

    def apply(batch: DataFrame, _number: int) -> None:
        from keytide.operators.keyspace import Keyspace

        spark = batch.sparkSession
        last, tables = snapshot.latest_or_none(spark, state_path)
        fresh = apply_once(batch, last)
        top = fresh.agg(F.max("idx")).first()[0]
        if top is None:
            return
        state = snapshot.restore_counters(tables["counters"], fresh) if tables else Keyspace(fresh).counters()
        snapshot.write(spark, state_path, {"counters": state}, top)

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
