"""Changes in the events of a user, in event-time order, for streams.

A user's rows wait in a native aggregation by slot, a stretch of event time. When
the watermark has passed a slot, its rows are sorted and cut to the changes in the
JVM, so a busy user is spread over tasks by time and only changes reach Python.
There they meet the last change before the slot, all that is kept for each user.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tabwright.session import ROCKSDB

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def require_rocksdb(spark: SparkSession) -> None:
    """Waiting rows may exceed the memory, so they need the RocksDB store; the setting is the session's to make."""
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise RuntimeError(f"set {PROVIDER} to {ROCKSDB} before this stream is started")


@contextmanager
def ordered_state(spark: SparkSession) -> Iterator[None]:
    """The store of ordered state for streams started inside; the setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def slot_changes(df: DataFrame, slot: str) -> DataFrame:
    """user, at, events, us: the changes inside each closed slot of a user, in order.

    ``df`` has user, ts (with its watermark), us, tie and event. The first row of a
    slot counts as a change, as the row before it is not known here; two missing
    events are equal. Rows of one time and tie are taken in order of the event.
    """
    rows = F.array_sort(F.collect_list(F.struct("us", "tie", "event")))
    closed = df.groupBy(F.window("ts", slot).alias("slot"), "user").agg(rows.alias("rows"))
    before = lambda i: F.get("rows", i - 1)["event"]
    changes = F.filter("rows", lambda r, i: (i == 0) | ~r["event"].eqNullSafe(before(i)))
    found = closed.select("user", F.unix_micros("slot.start").alias("at"), changes.alias("changes"))
    return found.select("user", "at", F.col("changes.event").alias("events"), F.col("changes.us").alias("us"))


class Stitch(StatefulProcessor):
    """Joins the changes of a user's slots; the watermark gives out slots in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "event string, us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """A slot's first row is no change if it equals the last one before the slot.

        The last change before goes in front of a slot's own: ``carried`` of them, 0 or 1.
        """
        slots = pd.concat(list(rows)).sort_values("at")
        last = self.last.get()
        out = []
        for events, us in zip(slots["events"], slots["us"]):
            events, us, carried = list(events), [int(u) for u in us], int(last is not None)
            if carried:
                same = int(events[0] == last[0])
                events, us = [last[0], *events[same:]], [last[1], *us[same:]]
            last = events[-1], us[-1]
            out.append((key[0], carried, events, us))
        self.last.update(last)
        yield pd.DataFrame(out, columns=["user", "carried", "events", "us"])

    def close(self) -> None:
        pass


def user_changes(df: DataFrame, slot: str) -> DataFrame:
    """user, carried, events, us: the changes of a user, one row a slot, each led by the change before it."""
    kind = df.schema["user"].dataType.simpleString()
    out = f"user {kind}, carried int, events array<string>, us array<bigint>"
    return slot_changes(df, slot).groupBy("user").transformWithStateInPandas(Stitch(), out, "append", "None")
