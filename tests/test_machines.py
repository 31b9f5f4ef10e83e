"""Sequential machines, windows, store, vectors and streams on small inputs."""

import json
import math
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from parchment.operators import geometry, metrics, ordering, retrieval, segment, splits, store, vectors
from parchment.sources import readers, sinks
from parchment.streaming import arrivals, limiter


def parts(paragraphs):
    return [(p, n, h, t) for p, n, h, t in segment.segment_paragraphs(paragraphs)]


def test_segmentation_rules():
    text = "1. The Lessor agrees. 2. The Lessee pays Rs. 5. The rent is due. 3. Notice is given."
    assert [t for p, _, _, t in parts(["Title", text]) if p == "clause"] == ["1. The Lessor agrees.", "2. The Lessee pays Rs. 5. The rent is due.", "3. Notice is given."]
    got = parts(["LEASE", "This is made today.", "Rent:", "The tenant pays.", "TERMS AND CONDITIONS:", "The first.", "• item one", "LESSOR: ________"])
    assert got[0] == ("title", None, None, "LEASE")
    assert ("clause", None, "Rent", "The tenant pays.") in got
    assert ("clause", None, "TERMS AND CONDITIONS", "The first. • item one") in got
    assert ("signature", None, None, "LESSOR: ________") in got and ("heading", None, None, "TERMS AND CONDITIONS") in got
    assert ("clause", "4", "Security Deposit", "The Tenant pays two months.") in parts(["Clause 4. Security Deposit. The Tenant pays two months."])


def test_segment_numbers_rows(spark):
    df = spark.createDataFrame([("d", 1, "Second. It ends."), ("d", 0, "This opens the text."), ("e", 0, "Only one."), ("f", 0, None)], "document_id string, pos int, paragraph string")
    rows = sorted((r["document_id"], r["clause_id"], r["text"]) for r in segment.segment(df).collect())
    assert rows == [("d", "c001", "This opens the text."), ("d", "c002", "Second. It ends."), ("e", "c001", "Only one.")]


def test_location_and_boxes(spark):
    words = ["The", "tenant", "pays", "rent", "The", "tenant", "pays", "dues", "now"]
    docs = spark.createDataFrame([("d", [(w,) for w in words], [("c001", "The tenant pays rent"), ("c002", "The tenant pays dues now"), ("c003", "absent words entirely")])], "document_id string, words array<struct<text:string>>, clauses array<struct<clause_id:string,text:string>>")
    assert {x["clause_id"]: x["words"] for x in geometry.located(docs).first()["found"]} == {"c001": [0, 1, 2, 3], "c002": [4, 5, 6, 7, 8]}
    assert geometry.cluster_lines([(10, 2, "b"), (12, 1, "a"), (14, 0, "c")]) == [(10, "b a"), (14, "c")]


def test_paragraphs_from_words(spark):
    rows = [("d", 1, float(t), float(x), w) for t, line in ((0, "One two"), (12, "three."), (40, "Next part"), (52, "goes on")) for x, w in enumerate(line.split())]
    rows += [("d", 2, 0.0, 0.0, "and"), ("d", 2, 0.0, 1.0, "ends.")]
    df = spark.createDataFrame(rows, "document_id string, page int, top double, x0 double, text string")
    got = [r["paragraph"] for r in geometry.paragraphs(df).orderBy("pos").collect()]
    assert got == ["One two three.", "Next part goes on and ends."]


def test_limiter(spark):
    times = [0, 10, 20, 61, 71]
    assert limiter.decide([t * 1_000_000 for t in times], 2, 60_000_000) == [True, True, False, True, True]
    assert limiter.decide([1, 2, 3], 0, 60) == [True] * 3
    df = spark.createDataFrame([("k", i, datetime(2024, 1, 1, 0, 0 if t < 60 else 1, t % 60)) for i, t in enumerate(times)], "k string, id long, ts timestamp")
    assert [r["allowed"] for r in limiter.limited(df, "k", "ts", "id", 2, 60).orderBy("id").collect()] == [True, True, False, True, True]


def test_limiter_stream(spark, tmp_path):
    df = spark.createDataFrame([("k", i, datetime(2024, 1, 1, 0, 0, i)) for i in range(4)], "k string, id long, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limiter.limited_stream(arrivals.arriving(spark, str(tmp_path / "in"), df.schema), "k", "ts", "id", 2, 60)
    out = arrivals.run_once(stream, "limited_test", str(tmp_path / "checkpoint"), "append")
    assert [r["allowed"] for r in out.orderBy("id").collect()] == [True, True, False, False]


def test_retrieval_isolation(spark):
    entries = retrieval.with_words(spark.createDataFrame([("M1", "Maharashtra", "deposit refund rules"), ("D1", "Delhi", "deposit refund deposit"), ("C1", "Central", "deposit")], "entry_id string, jurisdiction string, text string"), "text")
    # the bridge wrongly offers a Delhi entry to Maharashtra
    bridge = spark.createDataFrame([("Maharashtra", "x", "M1"), ("Maharashtra", "x", "D1"), ("Central", "x", "C1"), ("Maharashtra", "x", "GONE")], "jurisdiction string, topic string, entry_id string")
    queries = spark.createDataFrame([("q", "Maharashtra", "x", "What is the deposit refund?"), ("r", "Goa", "x", "deposit"), ("s", "Delhi", None, "deposit")], "query_id string, jurisdiction string, topic string, text string")
    own = retrieval.retrieve(queries, bridge, entries)
    assert [(r["query_id"], r["entry_id"], r["score"]) for r in own.collect()] == [("q", "M1", 2)]
    both = retrieval.retrieve(queries, bridge, entries, central=True)
    assert [r["entry_id"] for r in both.orderBy("rank").collect()] == ["M1", "C1"]
    assert {r["query_id"]: r["retrieved"] for r in retrieval.retrieved_arrays(queries, both).collect()} == {"q": ["M1", "C1"], "r": [], "s": []}


def test_store(spark):
    docs = spark.createDataFrame([(1, "a", datetime(2024, 1, 1)), (2, None, None), (3, "b", datetime(2024, 3, 1))], "id int, owner string, expires_at timestamp")
    assert {r["id"] for r in store.visible(docs, "owner", F.lit("a")).collect()} == {1, 2}
    assert {r["id"] for r in store.owned(docs, "owner", F.lit(None).cast("string")).collect()} == set()
    kept, children = store.purge(docs, F.lit("2024-02-01").cast("timestamp"), {"c": docs.select("id")}, "id")
    assert {r["id"] for r in kept.collect()} == {r["id"] for r in children["c"].collect()} == {2, 3}
    merged = store.upsert(docs.select("id", "owner"), spark.createDataFrame([(1, "z"), (9, "n")], "id int, owner string"), "id")
    assert dict(map(tuple, merged.collect())) == {1: "z", 2: None, 3: "b", 9: "n"}


def test_metrics(spark):
    df = spark.createDataFrame([("GREEN", "GREEN"), ("RED", "RED"), ("RED", "YELLOW"), ("YELLOW", "YELLOW")], "t string, p string")
    assert metrics.summary(df, "t", "p").first()["accuracy"] == 0.75
    assert [r["n"] for r in metrics.class_balance(df.where("t = 'RED'"), "t").orderBy("position").collect()] == [0, 0, 2]
    edge = spark.createDataFrame([(0.0, True), (0.1, True), (1.0, False)], "c double, ok boolean")
    assert abs(metrics.expected_calibration_error(edge, "c", F.col("ok")).first()["ece"] - (0.9 + 1.0) / 3) < 1e-9
    assert spark.range(1).select(metrics.wilson(F.lit(0), F.lit(0)).alias("w")).first()["w"]["high"] == 0


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.1, 0.9])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert sorted((r["a"], r["b"]) for r in vectors.shortlist(df, 1, 0.5).collect()) == [(0, 1), (2, 3)]
    edges = spark.createDataFrame([(0, 1), (1, 3)], "a long, b long")
    found = vectors.components(df, edges, lambda x: x.checkpoint())
    assert {r["id"]: r["component"] for r in found.collect()} == {0: 0, 1: 0, 2: 2, 3: 0}
    assert vectors.shortlist(df.limit(1), 2, 0.0).count() == 0


def test_block_split_shares_no_block(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "RED").otherwise("GREEN").alias("label"))
    out = splits.block_split(splits.block_ids(df, "doc_id"), "block", "label", tries=50)
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert 1 <= n["test"] <= 4 and out.select("block").distinct().count() == out.count()


def test_history_orders_differ(spark):
    turns = spark.createDataFrame([("c", i, "system" if i == 5 else "user", "x" * 1500) for i in range(8)], "conv_id string, turn int, role string, text string")
    server = ordering.history(turns, "conv_id", "turn").collect()
    assert sorted(r["turn"] for r in server) == [2, 3, 4, 6, 7] and len(server[0]["text"]) == 1000
    assert sorted(r["turn"] for r in ordering.client_history(turns, "conv_id", "turn").collect()) == [1, 2, 3, 4, 6, 7]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "kb.json").write_text(json.dumps({"entries": [{"id": "A", "jurisdiction": "Delhi", "topic_tags": ["x"], "last_verified_date": "2024-01-02"}]}))
    entry = readers.knowledge_base(spark, str(tmp_path / "kb.json")).first()
    assert entry["id"] == "A" and str(entry["last_verified_date"]) == "2024-01-02"
    (tmp_path / "index.json").write_text(json.dumps({"Delhi": {"notice": ["A", "B"]}}))
    assert [r["entry_id"] for r in readers.bridge(spark, str(tmp_path / "index.json")).orderBy("pos").collect()] == ["A", "B"]
    (tmp_path / "cache.jsonl").write_text('{"key": "a", "value": "1"}\n\n{"key": "a", "value": "2"}\n')
    assert [tuple(r) for r in readers.cache(spark, str(tmp_path / "cache.jsonl")).collect()] == [("a", "2")]
    (tmp_path / "l.csv").write_text('clause_id,clause_text,risk_label\n1," a ",green\n1,b,red\n2,,blue\n')
    rows, bad = readers.labelled(spark, str(tmp_path / "l.csv"))
    assert rows.count() == 3 and {r["problem"] for r in bad.collect()} == {"duplicate id", "empty text"}
    assert readers.saved(spark, str(tmp_path / "none.json"), "jurisdiction string").count() == 0
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "up" / "b.txt").write_bytes(b"hello")
    kinds = {r["path"][-5:]: r["reject_reason"] for r in readers.files(spark, str(tmp_path / "up")).collect()}
    assert kinds == {"a.pdf": None, "b.txt": "unsupported content type"}
    assert sinks.markdown(spark.createDataFrame([(1, "x")], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 | x |"


def test_clauses_are_located_in_all_languages(spark, tmp_path):
    from parchment.plans import heavy

    text = "1. RENT\nThe tenant pays the rent on the first day of every month.\n2. REPAIRS\nThe landlord repairs the roof and the walls without delay."
    rows = [(i, text, lang) for i, lang in enumerate(("en", "fr", "de", "es", None))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = heavy.clause_location(spark, str(tmp_path)).drop("document_id").groupBy("clause_id", "line").count().collect()
    assert found and all(r["count"] == 5 for r in found)


def test_shortlist_within_matches_all_pairs_in_parts(spark, monkeypatch):
    """One large document in several parts and many small ones; ties, repeated places, nulls, NaN and vectors of two lengths."""
    rng = np.random.default_rng(4)
    data = [("big", i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(150)]
    data += [(f"d{k}", i, rng.normal(size=4).tolist()) for k in range(30) for i in range(k % 5)]
    data += [("odd", 1, [1.0, 2.0]), ("odd", 2, [2.0, 1.0]), ("odd", 3, [1.0, 1.0, 1.0]), ("odd", 3, [1.0, 3.0]), ("odd", 4, None), ("odd", None, [1.0, 1.0]), (None, 5, [1.0, 1.0]), ("odd", 6, [None, 1.0]), ("odd", 7, [float("nan"), 1.0])]
    df = spark.createDataFrame(data, "doc string, at int, v array<double>").repartition(3)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "PART_ROWS", 40)
    got = vectors.shortlist_within(df, "doc", "at", "v", 2, 0.5)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()  # pairs below the best never leave a block
    best = {}
    sort = lambda s: (1, 0.0) if math.isnan(s) else (0, round(s, 9))
    for k, a, v in data:
        for k2, b, w in data:
            if k is not None and k == k2 and a is not None and b is not None and a != b and v and w and len(v) == len(w) and None not in v + w:
                s = sum(x * y for x, y in zip(v, w, strict=True))
                if math.isnan(s) or s >= 0.5:
                    best.setdefault((k, a), []).append((sort(s), -b, s))
    want = {}
    for (k, a), found in best.items():
        for rank, b, s in sorted(found, reverse=True)[:2]:
            pair = (k, min(a, -b), max(a, -b))
            want[pair] = max(want.get(pair, (rank, s)), (rank, s))
    assert {(r["doc"], r["a"], r["b"]): sort(r["similarity"]) for r in got.collect()} == {p: sort(s) for p, (_, s) in want.items()}
