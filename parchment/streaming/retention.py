"""Expiry of kept documents in stream state (W2): a document lives for a time after its upload, and reading a dead one removes it.

State is one number per living document.  A timer removes it at its deadline, in event
time, so state holds the documents that are alive and not all that ever came.  The
operator needs Spark's RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import rules

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, id long, t long, kind string, status string"


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that timers need, for queries started inside; the session's own setting comes back."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


class Retention(StatefulProcessor):
    """Uploads open or renew a document's time; reads find it or not; the timer ends it."""

    def __init__(self, seconds: int):
        self.life = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deadline = handle.getValueState("deadline", "at long")

    def _end(self, at: int | None) -> None:
        if at is not None:
            self.handle.deleteTimer(-(-at // 1000))
            self.deadline.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).sort_values(["t", "id"])
        at, status = self.deadline.get()[0] if self.deadline.exists() else None, []
        before = at
        for t, kind in zip(held["t"].tolist(), held["kind"].tolist(), strict=True):
            if at is not None and t >= at:
                at = None
            if kind == "upload":
                at = t + self.life
                status.append("kept")
            else:
                status.append("gone" if at is None else "found")
        if at != before:
            self._end(before)
            if at is not None and at // 1000 > timerValues.getCurrentWatermarkInMs():
                self.deadline.update((at,))
                self.handle.registerTimer(-(-at // 1000))
        yield held.assign(key=key[0], status=status)[["key", "id", "t", "kind", "status"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.deadline.get()[0]
        self.deadline.clear()
        yield pd.DataFrame({"key": [key[0]], "id": [-1], "t": [at], "kind": ["timer"], "status": ["expired"]})

    def close(self) -> None:
        pass


def retained(events: DataFrame, key: str, ts: str, id_column: str, kind: str, hours: float = rules.RETENTION_HOURS, late: str = "1 hour") -> DataFrame:
    """(key, id, t, kind, status) of a stream of uploads and reads: kept, found, gone, or expired for a deadline that has passed."""
    slim = events.select(F.col(key).cast("string").alias("key"), F.col(id_column).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("at"), F.col(kind).alias("kind")).withWatermark("at", late)
    slim = slim.withColumn("t", F.unix_micros("at"))
    return slim.groupBy("key").transformWithStateInPandas(Retention(round(hours * 3600)), OUT, "Append", "EventTime")
