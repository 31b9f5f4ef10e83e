import pytest
from pyspark.sql import functions as F

from parchment.operators import findings, metrics, model, segment
from parchment.sources import sinks


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_linked_touches_both_sides_once(spark):
    df = spark.createDataFrame([("c1", "c2"), ("c3", "c3"), (None, "c4")], "clause_id_a string, clause_id_b string")
    assert [r[0] for r in rows(findings.linked(df), "clause_id")] == ["c1", "c2", "c3", "c4"]


def test_first_important(spark):
    df = spark.createDataFrame([(1, "a", "YELLOW", 0), (1, "b", "RED", 2), (1, "c", "RED", 1), (2, "d", "GREEN", 0), (3, "e", None, 0), (3, "f", "YELLOW", 5)], "k int, clause string, label string, at int")
    assert {r["k"]: r["clause"] for r in findings.first_important(df, "k", "clause", "label", "at").collect()} == {1: "c", 2: None, 3: "f"}


def test_resolved_stops_on_a_lost_row(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(ValueError, match="2"):
        findings.resolved(a, b, "k")
    assert findings.resolved(a, b, "k", strict=False).count() == 2


def test_counterpart(spark):
    df = spark.createDataFrame([("LLM zero-shot (partial, n=3)",), ("Trained on few",), ("other",), (None,)], "n string")
    got = [r[0] for r in df.select(findings.counterpart(F.col("n"), ["Trained model", "LLM zero-shot - big"])).collect()]
    assert got == ["LLM zero-shot - big", "Trained model", None, None]
    assert df.select(findings.counterpart(F.col("n"), [])).first()[0] is None


def test_completed_prefix(spark):
    work = spark.createDataFrame([("g", i, f"k{i}") for i in range(5)] + [("h", 0, "k9")], "g string, at int, key string")
    replies = spark.createDataFrame([("k0",), ("k1",), ("k1",), ("k3",), ("k9",)], "key string")
    got = rows(findings.completed_prefix(work, replies, ["g"], "at", "key"), "g", "n_rows", "n_done", "complete")
    assert got == [("g", 5, 2, False), ("h", 1, 1, True)]
    assert rows(findings.pending(work, replies, "key"), "key") == [("k2",), ("k4",)]


def test_askable(spark):
    requests = spark.createDataFrame([(1, "d", "c1"), (2, "d", None), (3, "d", "c9"), (4, "e", "c1"), (5, "f", None)], "id int, document_id string, clause_id string")
    analyses = spark.createDataFrame([("d", "done", "r"), ("e", "running", None), ("f", "done", None)], "document_id string, status string, result string")
    clauses = spark.createDataFrame([("d", "c1"), ("e", "c1")], "document_id string, clause_id string")
    assert rows(findings.askable(requests, analyses, clauses), "id") == [(1,), (2,)]


def test_numbered_selection(spark):
    clauses = spark.createDataFrame([("f", "2", 1, "2. notice"), ("f", "2", 0, "2. rent"), ("g", "1", 0, "1. x")], "form string, number string, at int, text string")
    chosen = spark.createDataFrame([(0, "f", "2", None), (1, "f", "2", "notice")], "pos int, form string, number string, hint string")
    assert rows(findings.numbered_selection(chosen, clauses, "at"), "id", "text") == [("IN-01", "2. rent"), ("IN-02", "2. notice")]
    with pytest.raises(ValueError, match="7"):
        findings.numbered_selection(spark.createDataFrame([(0, "f", "7", None)], chosen.schema), clauses, "at")


def test_cached_vectors_and_misses(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, text string")
    cache = texts.where("id = 1").select(findings.vector_key(F.col("text")).alias("key"), F.array(F.lit(0.5)).alias("vector"))
    have, lack = findings.cached_vectors(texts, cache)
    assert rows(have, "id") == [(1,)] and rows(lack, "text") == [("b",)]
    df = spark.createDataFrame([(1, "RED", "RED"), (2, "RED", None), (3, "GREEN", "RED")], "id int, t string, p string")
    assert rows(findings.misses(df, "t", "p"), "id") == [(2,)]


def test_summary_by_equals_summary(spark):
    df = spark.createDataFrame([(i % 2, "RED" if i % 3 else "GREEN", "RED" if i % 5 else "YELLOW") for i in range(60)], "g int, t string, p string")
    for r in metrics.summary_by(df, ["g"], "t", "p").collect():
        one = metrics.summary(df.where(F.col("g") == r["g"]), "t", "p").first()
        assert (r["n"], r["accuracy"]) == (one["n"], one["accuracy"]) and abs(r["macro_f1"] - one["macro_f1"]) < 1e-12


def test_model_survives_saving(spark, tmp_path):
    df = model.prepared(spark.createDataFrame([([float(i % 3), float(i % 2)], ("GREEN", "YELLOW", "RED")[i % 3]) for i in range(60)], "v array<double>, label string"), "v", "label")
    fitted = model.fit(df, 1.0)
    model.save(fitted, 1.25, str(tmp_path / "m"))
    again, temperature = model.load(str(tmp_path / "m"))
    assert temperature == 1.25
    a, b = (sorted(r["probabilities"] for r in model.predict(m, df).collect()) for m in (fitted, again))
    assert a == b


def test_table_function_and_added_columns(spark):
    segment.register(spark, "segment_parts")
    text = "1. Rent. The tenant shall pay.", "2. Term. The term is one year."
    got = spark.sql(f"SELECT part, text FROM segment_parts(array('{text[0]}', '{text[1]}'))").collect()
    assert [tuple(r) for r in got] == [(p, t) for p, _, _, t in segment.segment_paragraphs(list(text))]
    spark.sql("DROP TABLE IF EXISTS parchment_grown")
    sinks.create_table(spark, "parchment_grown", "a int")
    assert sinks.add_columns(spark, "parchment_grown", "a int, b string") == ["b"]
    assert spark.table("parchment_grown").columns == ["a", "b"]
    spark.sql("DROP TABLE parchment_grown")
