"""The review in one plan, on a small document and saved requests."""

import json

import pytest
from pyspark.sql import functions as F

from parchment.operators import guardrails, replies, retrieval, review

REQUEST = "try int, attempt int, status int, body string, content string, retry_after string"
CLAUSES = [("d", 0, "c001", "NOTICE", "The tenant gives notice of 30 days in Mumbai."), ("d", 1, "c002", None, "The deposit is 5,000 and is returned."), ("d", 2, "c003", None, "Repairs are made by the owner."), ("d", 3, "c004", None, " "), ("e", 0, "c001", None, "The deposit is kept in Chennai.")]


@pytest.fixture(scope="module")
def inputs(spark):
    clauses = spark.createDataFrame(CLAUSES, "document_id string, order_index int, clause_id string, section_heading string, text string")
    bridge = spark.createDataFrame([("Maharashtra", "notice", "M1"), ("Central", "security_deposit", "C1")], "jurisdiction string, topic string, entry_id string")
    entries = retrieval.with_words(spark.createDataFrame([("M1", "Maharashtra", "notice of days"), ("C1", "Central", "deposit returned")], "entry_id string, jurisdiction string, text string"), "text")
    p = {"GREEN": 0.2, "YELLOW": 0.5, "RED": 0.3}
    trained = spark.createDataFrame([(d, c, p) for d, c in (("d", "c001"), ("d", "c002"), ("d", "c004"), ("e", "c001"))], "document_id string, clause_id string, probabilities map<string,double>")
    return clauses, bridge, entries, trained


def requests(spark, keys, rows):
    return spark.createDataFrame(rows, f"{', '.join(f'{k} string' for k in keys)}, {REQUEST}")


def label(name):
    return json.dumps({"label": name, "probabilities": {name: 1}})


def told(says, ids=()):
    return json.dumps({"document_says": says, "concern": "It may cost the tenant money.", "statute_support": [{"entry_id": i, "how_it_applies": ""} for i in ids]})


def test_review_from_saved_requests(spark, inputs):
    clauses, bridge, entries, trained = inputs
    labels = requests(spark, review.KEYS, [("d", "c001", 0, 0, 200, None, label("RED"), None), ("d", "c002", 0, 0, 429, "tokens per day", None, None), ("d", "c003", 0, 0, 200, None, "?", None), ("d", "c003", 1, 0, 500, None, None, None)])
    good, broken = told("The tenant gives notice of 30 days.", ["M1"]), "no JSON"
    explanations = requests(
        spark, review.KEYS,
        [("d", "c001", 0, 0, 503, None, None, None), ("d", "c001", 0, 1, 200, None, good, None), ("d", "c002", 0, 0, 200, None, broken, None), ("d", "c002", 1, 0, 200, None, told("The deposit is 9,000.", ["X"]), None), ("e", "c001", 0, 0, 401, None, None, None)],
    )
    vectors = spark.createDataFrame([("d", "c001", [1.0, 0.0]), ("d", "c002", [0.9, 0.1]), ("d", "c003", [0.8, 0.2]), ("d", "c004", [0.0, 1.0]), ("e", "c001", [1.0, 0.0])], "document_id string, clause_id string, vector array<double>")
    yes, no = json.dumps({"related": True, "relationship_type": " condition "}), json.dumps({"related": False})
    pair = ["document_id", "clause_id_a", "clause_id_b"]
    connections = requests(spark, pair, [("d", "c001", "c002", 0, 0, 200, None, "{}", None), ("d", "c001", "c002", 1, 0, 200, None, yes, None), ("d", "c001", "c003", 0, 0, 200, None, no, None), ("d", "c002", "c003", 0, 0, 404, None, None, None)])
    found = review.analyse(clauses, bridge, entries, review.Saved(labels, explanations, connections), trained, vectors)
    rows = {(r["document_id"], r["clause_id"]): r for r in review.linked_clauses(found).collect()}
    assert len(rows) == 5
    first, second, third, blank, other = (rows[k] for k in (("d", "c001"), ("d", "c002"), ("d", "c003"), ("d", "c004"), ("e", "c001")))
    assert (first["topic"], first["jurisdiction"], first["retrieved"], first["label"], first["approach"], first["error"]) == ("notice", "Maharashtra", ["M1"], "RED", "llm", None)
    assert first["grounding"]["passed"] and first["explanation"]["statute_support"][0]["entry_id"] == "M1"
    assert (second["label"], second["approach"], second["retrieved"], second["error"]) == ("YELLOW", "trained (llm fallback)", ["C1"], None)
    assert set(second["grounding"]["reasons"]) == {"CITATION_RESTRICTED", "DOCUMENT_GROUNDED"}
    assert (third["label"], third["error"], third["explanation"]) == (None, "classification failed", None)
    assert blank["error"] == "classification failed: blank text"
    assert (other["jurisdiction"], other["retrieved"], other["error"]) == (None, [], "explanation generation failed: refused")
    assert [x["clause_id"] for x in first["links"]] == ["c002"] and second["links"][0]["relationship_type"] == "condition" and third["links"] is None
    assert {r["document_id"]: tuple(r)[1:] for r in review.progress(found).collect()} == {"d": (4, 2, 2, 1, 2, 1), "e": (1, 1, 0, 0, 1, 0)}


def test_review_without_a_provider(spark, inputs):
    """Labels and statutes without explanations: none is an error, and nothing is linked."""
    clauses, bridge, entries, trained = inputs
    states = spark.createDataFrame([("d", "Delhi")], "document_id string, jurisdiction string")
    found = review.analyse(clauses, bridge, entries, review.Saved(), trained, states=states, approach="trained")
    rows = {(r["document_id"], r["clause_id"]): r for r in found.clauses.collect()}
    assert rows["d", "c001"]["retrieved"] == [] and rows["d", "c002"]["retrieved"] == ["C1"]
    assert rows["d", "c001"]["error"] is None and rows["d", "c001"]["explanation"] is None and rows["d", "c003"]["error"] == "classification failed"
    assert found.links.count() == 0


def test_tried_asks_again_only_after_a_malformed_answer(spark):
    rows = [("a", 0, "x", None), ("b", 0, "bad", None), ("b", 1, "y", None), ("c", 0, None, "refused"), ("c", 1, "z", None), ("d", 0, "bad", None), ("d", 1, None, "no reply"), ("e", 0, "bad", None), ("f", 1, "q", None), ("g", 0, "bad", None), ("g", 1, "bad", None)]
    df = spark.createDataFrame(rows, "k string, try int, content string, error string")
    out = replies.tried(df, ["k"], lambda c: (c, F.when(c == "bad", "malformed")))
    assert {r["k"]: (r["value"], r["error"]) for r in out.collect()} == {"a": ("x", None), "b": ("y", None), "c": (None, "refused"), "d": (None, "no reply"), "e": (None, "malformed"), "f": (None, "no reply"), "g": (None, "malformed")}


def test_grounding_of_a_table_equals_the_expression(spark):
    rows = [("The rent is 5,000 a month.", "It costs money, and more.", "RED", ["A"], "as section 5 of it", "The rent is 5,000.", ["A"]), ("See section 9", "", "RED", [], "", "nothing", []), (None, None, None, None, None, None, None), ("This is illegal 7", "x", "GREEN", ["B"], "", "7 is illegal", ["A"])]
    df = spark.createDataFrame(rows, "s string, c string, l string, u array<string>, h string, t string, r array<string>")
    x = [F.col(c) for c in "scluhtr"]
    both = guardrails.grounded(df, *x, out="a").withColumn("b", guardrails.grounding(*x)).collect()
    assert all(r["a"] == r["b"] for r in both) and len(both) == 4


def test_placed_reads_clauses_once(spark, inputs):
    """Topics, states and retrieval come in one pass; clauses may be costly to make."""
    clauses, bridge, entries, _ = inputs
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = review.placed(clauses.mapInArrow(counted, clauses.schema), bridge, entries).collect()
    assert len(rows) == made.value == len(CLAUSES)
    assert {(r["document_id"], r["clause_id"]): (r["topic"], r["jurisdiction"], r["retrieved"]) for r in rows} == {
        ("d", "c001"): ("notice", "Maharashtra", ["M1"]), ("d", "c002"): ("security_deposit", "Maharashtra", ["C1"]), ("d", "c003"): ("maintenance", "Maharashtra", []),
        ("d", "c004"): (None, "Maharashtra", []), ("e", "c001"): ("security_deposit", None, []),
    }


def test_placed_takes_the_first_signal(spark, inputs):
    """An unsupported or ambiguous signal before a state leaves the document without one; a null document has none."""
    _, bridge, entries, _ = inputs
    said = [("a", 1, "In Pune."), ("a", 0, "Nothing."), ("b", 0, "In JAIPUR."), ("b", 1, "In Delhi."), ("c", 0, "Delhi or Mumbai."), ("c", 1, "In Mumbai."), ("f", 0, None), ("f", 1, "NCR"), (None, 0, "In Thane."), ("g", 0, "Punekar")]
    clauses = spark.createDataFrame([(d, i, f"c{i}", None, t) for d, i, t in said], "document_id string, order_index int, clause_id string, section_heading string, text string")
    rows = review.placed(clauses, bridge, entries).collect()
    assert len(rows) == len(said)
    assert {r["document_id"]: r["jurisdiction"] for r in rows} == {"a": "Maharashtra", "b": None, "c": None, "f": "Delhi", None: None, "g": None}


def test_ranked_lists_equal_retrieve(spark):
    """In one pass as by rows: ties, an entry named twice, other states' entries, Central, nulls, entries of one id."""
    asked = [(0, "Delhi", "t", "red green blue"), (1, "Maharashtra", "t", "green"), (2, "Delhi", "u", "red"), (3, None, "t", "red"), (4, "Delhi", None, "red"), (5, "Punjab", "t", "red"), (6, "Delhi", "t", None), (7, "Delhi", "t", ""), (8, "Central", "t", "red")]
    asked = spark.createDataFrame(asked, "query_id int, jurisdiction string, topic string, text string")
    bridge = [("Delhi", "t", x) for x in "abbcdxn"] + [("Central", "t", x) for x in "bcez"] + [("Maharashtra", "t", x) for x in "ame"] + [("Punjab", "t", "p"), ("Central", "v", "a"), (None, "t", "a"), ("Delhi", None, "a")]
    bridge = spark.createDataFrame(bridge, "jurisdiction string, topic string, entry_id string")
    entries = [("a", "Delhi", "red"), ("b", "Delhi", "red green blue"), ("c", "Central", "blue"), ("c", "Central", "red blue"), ("c", "Delhi", "blue"), ("d", "Maharashtra", "red"), ("e", "Central", "green red"), ("m", "Maharashtra", "green"), ("n", "Delhi", None), ("p", "Punjab", "red"), ("x", "Delhi", "")]
    entries = retrieval.with_words(spark.createDataFrame(entries, "entry_id string, jurisdiction string, text string"), "text")
    entries = entries.withColumn("entry_words", F.when(F.col("entry_id") != "n", F.col("entry_words")))
    want = retrieval.retrieved_arrays(asked, retrieval.retrieve(asked, bridge, entries, central=True))
    got = {r["query_id"]: r["retrieved"] for r in retrieval.ranked_lists(asked, bridge, entries).collect()}
    assert got == {r["query_id"]: r["retrieved"] for r in want.collect()}
    assert got[0][0] == "b" and got[0].count("c") == 2 and "d" not in got[0] and len(got) == 9
