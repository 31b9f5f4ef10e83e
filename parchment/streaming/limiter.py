"""Sliding-log rate limiter (W1), request spacing.

A hit is accepted while fewer than ``limit`` accepted hits lie within the window;
rejected hits are not logged.  That is recursive, so it is a grouped function per
key in batch and a stateful operator in streams; both run ``decide``.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules


def decide(times, limit: int, window: int, log: deque | None = None) -> list[bool]:
    """Verdicts of hits at ascending microseconds; ``log`` holds the accepted ones and is updated."""
    log = deque() if log is None else log
    out = []
    for t in times:
        while log and t - log[0] >= window:
            log.popleft()
        ok = limit <= 0 or len(log) < limit
        if ok and limit > 0:
            log.append(t)
        out.append(ok)
    return out


def _batch(limit: int, window: int):
    def run(table):
        order = sorted(range(table.num_rows), key=list(zip(table.column("t").to_pylist(), table.column("id").to_pylist(), strict=True)).__getitem__)
        table = table.take(pa.array(order, pa.int64()))
        return table.append_column("allowed", pa.array(decide(table.column("t").to_pylist(), limit, window), pa.bool_()))

    return run


def limited(hits: DataFrame, key: str, ts: str, id_column: str, limit: int, seconds: int = rules.LIMITER_SECONDS) -> DataFrame:
    """(key, id, t, allowed) of a bounded set of hits."""
    slim = hits.select(F.col(key).cast("string").alias("key"), F.col(id_column).cast("long").alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    return slim.groupBy("key").applyInArrow(_batch(limit, seconds * 1_000_000), "key string, id long, t long, allowed boolean")


def _stream(limit: int, window: int):
    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0] if state.exists else ())
        rows = pd.concat(frames).sort_values(["t", "id"])
        rows["allowed"] = decide(rows["t"].tolist(), limit, window, log)
        if log:
            state.update((list(log),))
            # the last accepted hit no longer counts, so the key is as if never seen
            state.setTimeoutTimestamp(max((log[-1] + window) // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield rows[["key", "id", "t", "allowed"]]

    return run


def limited_stream(hits: DataFrame, key: str, ts: str, id_column: str, limit: int, seconds: int = rules.LIMITER_SECONDS, late: str = "1 hour") -> DataFrame:
    """The same on a stream; the state of a key is its log of accepted hits, at most ``limit`` numbers, and goes when they no longer count.

    ``late`` bounds how far behind the latest hit one may come.
    """
    slim = hits.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    slim = slim.select(F.col(key).cast("string").alias("key"), F.col(id_column).cast("long").alias("id"), F.unix_micros("at").alias("t"), "at")
    return slim.groupBy("key").applyInPandasWithState(_stream(limit, seconds * 1_000_000), "key string, id long, t long, allowed boolean", "log array<long>", "append", "EventTimeTimeout")


def too_soon(requests: DataFrame, key: str, ts: str, seconds: float = 2.5) -> DataFrame:
    gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(W.partitionBy(key).orderBy(ts)))
    return requests.withColumn("too_soon", F.coalesce(gap < int(seconds * 1e6), F.lit(False)))


def within(ts: Column, now: Column, hours: int = rules.RETENTION_HOURS) -> Column:
    return ts > now - F.make_dt_interval(hours=F.lit(hours))
