"""The edge to a provider of replies (M1): paced, resumable, and stopped by a quota.

A client is a function from a prompt to (status, body, content, retry_after); the rest
is Spark's.  Work goes out in rounds, each a hash share of what is still open.  In a
round every partition asks for its keys one after another, no faster than ``spacing``
allows, retries as ``operators.replies`` says, and stops asking at a quota.  A round's
requests are written before the next begins, so the driver knows of the quota then and
starts none: all partitions stop within a round.  A run that was stopped or lost is
run again: keys with a usable reply, in the saved requests or in a cache, are not
asked for again, and those without are asked anew under a later run number.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import replies
from .sinks import _exists

Reply = tuple[int, str | None, str | None, str | None]
REQUESTS = "key string, run int, attempt int, status int, body string, content string, retry_after string"
SPACING = 2.5
ROUNDS = 8


def _wait(verdict: str, attempt: int, retry_after: str | None) -> float:
    if verdict == "limited" and retry_after and retry_after.replace(".", "", 1).isdigit():
        return float(retry_after)
    return replies.FIRST_WAIT * 2.0**attempt if verdict in ("limited", "unavailable") else 0.0


def _verdict(status: int, body: str | None, content: str | None) -> str:
    if status == 429:
        return "quota" if replies.QUOTA_MARK in (body or "").lower() else "limited"
    if status >= 400:
        return "unavailable" if status >= 500 else "refused"
    return "ok" if content else "empty"


def _asking(client: Callable[[str], Reply], run: int, spacing: float, limit: int, sleep: Callable[[float], None]):
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, stopped = float("-inf"), False
        for frame in frames:
            rows = []
            for key, prompt in zip(frame["key"], frame["prompt"], strict=True):
                for attempt in range(0 if stopped else limit):
                    if (pause := last + spacing - time.monotonic()) > 0:
                        sleep(pause)
                    last = time.monotonic()
                    status, body, content, after = client(prompt)
                    rows.append((key, run, attempt, status, body, content, after))
                    verdict = _verdict(status, body, content)
                    stopped = verdict == "quota"
                    if verdict in ("ok", "quota", "refused") or attempt + 1 == limit:
                        break
                    if (pause := _wait(verdict, attempt, after)) > 0:
                        sleep(pause)
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in REQUESTS.split(", ")])

    return ask


def requests(spark: SparkSession, path: str) -> DataFrame:
    """The saved requests (key, attempt, ...) of each key's latest run, as ``replies.outcomes`` reads them."""
    if not _exists(spark, f"{path}/requests"):
        return spark.createDataFrame([], REQUESTS).drop("run")
    held = spark.read.schema(f"{REQUESTS}, round string").parquet(f"{path}/requests")
    latest = held.groupBy("key").agg(F.max("run").alias("run"))
    return held.join(latest, ["key", "run"]).drop("run", "round")


def open_work(work: DataFrame, saved: DataFrame, cache: DataFrame | None = None, limit: int = replies.MAX_RETRIES) -> DataFrame:
    """Of ``work`` (key, prompt), what neither the cache (key, value) nor the saved requests answer."""
    done = replies.outcomes(saved, limit=limit).where("content IS NOT NULL").select("key")
    left = work.join(done, "key", "left_anti")
    return left if cache is None else left.join(cache.select("key"), "key", "left_anti")


def ask_all(work: DataFrame, path: str, client: Callable[[str], Reply], cache: DataFrame | None = None, rounds: int = ROUNDS, tasks: int = 4, spacing: float = SPACING, limit: int = replies.MAX_RETRIES, sleep: Callable[[float], None] = time.sleep) -> str:
    """Ask for the open keys of ``work`` (key, prompt) and save every request under ``path``; says ``done`` or ``quota``.

    ``tasks`` ask at a time, each with its own pace.
    """
    spark = work.sparkSession
    held = f"{path}/requests"
    run = 1 + ((spark.read.schema(f"{REQUESTS}, round string").parquet(held).agg(F.max("run")).first()[0] or 0) if _exists(spark, held) else 0)
    for n in range(rounds):
        share = work.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == n)
        left = open_work(share.select(F.col("key").cast("string").alias("key"), "prompt"), requests(spark, path), cache, limit)
        asked = left.repartition(tasks, "key").mapInPandas(_asking(client, run, spacing, limit, sleep), REQUESTS)
        at = f"{held}/round={run}-{n}"
        asked.write.mode("overwrite").parquet(at)
        if spark.read.schema(REQUESTS).parquet(at).where(replies.status_verdict(F.col("status"), F.col("body"), F.col("content")) == "quota").limit(1).count():
            return "quota"
    return "done"
