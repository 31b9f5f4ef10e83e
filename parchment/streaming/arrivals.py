"""Streams of arriving files (W2, W3, W5): the batch operators on ``readStream``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def arriving(spark: SparkSession, path: str, schema, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per day and type with a watermark, so that the state of closed days is dropped."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.to_date("w.start").alias("day"), "event_type", "n", "total")
    )


def run_once(stream: DataFrame, table: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process what has arrived and return it; the sink is a memory table, for results of a report's size."""
    query = stream.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(table)


def per_window(events: DataFrame, ts: str, width: str = "1 minute", slide: str | None = None, late: str = "1 minute", keys: tuple[str, ...] = ()) -> DataFrame:
    """(start, end, keys, n) of arrivals by window, told once a window is closed by the watermark."""
    at = F.window("at", width, slide) if slide else F.window("at", width)
    held = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return held.groupBy(at.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


class Progress(StreamingQueryListener):
    """Rows done so far, by query; ``of`` a known total it is (done, total), which reaches the total only at the end.

    A row counts as done when its batch is, and the last one only when the query has ended, so that done equals total
    says that nothing is left to do.
    """

    def __init__(self, total: int | None = None):
        self.total = total
        self.done: dict[str, int] = {}
        self.ended: set[str] = set()

    def of(self, query_id: str) -> tuple[int, int | None]:
        done = self.done.get(query_id, 0)
        if self.total is None or query_id in self.ended:
            return done, self.total
        return min(done, self.total - 1) if self.total else 0, self.total

    def onQueryStarted(self, event):
        self.done[str(event.id)] = 0

    def onQueryProgress(self, event):
        key = str(event.progress.id)
        self.done[key] = self.done.get(key, 0) + event.progress.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception is None:
            self.ended.add(str(event.id))
