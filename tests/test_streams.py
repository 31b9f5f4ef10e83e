"""Streams that are run: expiring state, units of parents and children, progress and arrivals."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parchment.sources import sinks
from parchment.streaming import arrivals, limiter, retention

T0 = datetime(2024, 1, 1)
EVENTS = "id long, key string, ts timestamp, kind string"


def fed(spark, tmp_path, batches, schema):
    """A stream that reads one file of rows per micro-batch, in order."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return reader.parquet(str(tmp_path / "in"))


def run(stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return query, stream.sparkSession.table(name)


def states(query):
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]


def at(hours):
    return T0 + timedelta(hours=hours)


def test_documents_expire_in_state(spark, tmp_path):
    first = [(i, f"d{i}", at(0), "upload") for i in range(20)] + [(20, "d0", at(1), "read"), (21, "new", at(1), "read")]
    later = [(30, "d1", at(23), "read"), (31, "d2", at(23), "upload"), (32, "d3", at(24), "read")]
    last = [(40, "d2", at(40), "read"), (41, "d4", at(41), "read"), (42, "x", at(60), "upload")]
    end = [(50, "x", at(61), "read")]
    with retention.rocksdb(spark):
        stream = retention.retained(fed(spark, tmp_path, [first, later, last, end], EVENTS), "key", "ts", "id", "kind", 24)
        query, out = run(stream, tmp_path, "retained")
    got = {r["id"]: r["status"] for r in out.where("id >= 0").collect()}
    assert {got[i] for i in range(20)} == {"kept"}
    assert (got[20], got[21], got[30], got[31], got[32], got[40], got[41], got[42], got[50]) == ("found", "gone", "found", "kept", "gone", "found", "gone", "kept", "found")
    expired = {r["key"] for r in out.where("status = 'expired'").collect()}
    assert expired >= {f"d{i}" for i in range(5, 20)} and "x" not in expired
    held = states(query)
    assert max(held) >= 20 and held[-1] <= 2, held


def test_limiter_forgets_keys(spark, tmp_path):
    schema = "k string, id long, ts timestamp"
    batches = [[(f"k{i}", i, at(0)) for i in range(30)], [("late", 100, at(5))], [("late", 101, at(9)), ("k1", 102, at(9))], [("late", 103, at(13))]]
    stream = limiter.limited_stream(fed(spark, tmp_path, batches, schema), "k", "ts", "id", 1, 3600)
    query, out = run(stream, tmp_path, "forgets")
    assert out.where("allowed").count() == 34 and out.count() == 34
    held = states(query)
    assert max(held) >= 30 and held[-1] <= 3, held


DOCS = "document_id string, name string, clauses array<string>"
PARTS = {"documents": lambda b: b.select("document_id", "name"), "clauses": lambda b: b.select("document_id", F.posexplode("clauses").alias("order_index", "text"))}


def test_parents_and_children_are_one_unit(spark, tmp_path):
    batches = [[(f"d{b}{i}", "n", ["one", "two"]) for i in range(3)] for b in range(3)]
    path = str(tmp_path / "store")
    broken = [True]

    def clauses(batch):
        if broken and "d10" in {r["document_id"] for r in batch.collect()}:
            broken.clear()
            raise RuntimeError("killed between the two writes")
        return PARTS["clauses"](batch)

    stream = fed(spark, tmp_path, batches, DOCS)
    with pytest.raises(Exception, match="killed"):
        sinks.stream_units(stream, path, {**PARTS, "clauses": clauses}).trigger(availableNow=True).start().awaitTermination()
    # the documents of the second batch are written, but not told
    assert spark.read.parquet(f"{path}/documents").count() == 6
    assert sinks.committed(spark, path, "documents").count() == 3 and sinks.committed(spark, path, "clauses").count() == 6
    sinks.stream_units(stream, path, PARTS).trigger(availableNow=True).start().awaitTermination()
    assert sinks.committed(spark, path, "documents").count() == 9 and sinks.committed(spark, path, "clauses").count() == 18
    # a batch that is replayed changes nothing
    again = spark.createDataFrame([("other", "n", ["x"])], DOCS)
    sinks.write_unit(again, 1, path, PARTS)
    assert sinks.committed(spark, path, "documents").where("document_id = 'other'").count() == 0 and spark.read.parquet(f"{path}/clauses").count() == 18


def test_progress_is_total_only_at_the_end(spark, tmp_path):
    rows = [[(i, "k", at(0), "x")] * 4 for i in range(3)]
    progress = arrivals.Progress(12)
    seen = []

    def look(batch, n):
        batch.count()
        seen.append(progress.of(str(query_id[0])) if query_id else progress.of("none"))

    query_id = []
    spark.streams.addListener(progress)
    try:
        stream = fed(spark, tmp_path, rows, EVENTS)
        query = stream.writeStream.foreachBatch(look).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query_id.append(query.id)
        query.awaitTermination()
        for _ in range(50):
            if progress.of(str(query.id)) == (12, 12):
                break
            spark.sparkContext._jvm.Thread.sleep(100)
    finally:
        spark.streams.removeListener(progress)
    assert progress.of(str(query.id)) == (12, 12) and len(seen) == 3
    assert all(done < 12 for done, _ in seen)
    assert arrivals.Progress(0).of("q") == (0, 0) and arrivals.Progress().of("q") == (0, None)


def test_arrivals_by_window(spark, tmp_path):
    rows = [[(i, "k", T0 + timedelta(seconds=s), "x") for i, s in enumerate((0, 10, 59, 61))], [(9, "k", T0 + timedelta(seconds=200), "x")], [(10, "k", T0 + timedelta(seconds=600), "x")], [(11, "k", T0 + timedelta(seconds=601), "x")]]
    _, out = run(arrivals.per_window(fed(spark, tmp_path, rows, EVENTS), "ts", "1 minute"), tmp_path, "windows")
    assert [(r["start"].minute, r["n"]) for r in out.orderBy("start").collect()][:3] == [(0, 3), (1, 1), (3, 1)]
