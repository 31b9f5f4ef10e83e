import json

from pyspark.sql import functions as F

from parchment.operators import guardrails as g


def checks(spark, says, concern="A concern that is long enough.", label="RED", support=(), clause="The tenant shall pay rent of 5,000 monthly.", retrieved=("MH_1",), how=""):
    df = spark.createDataFrame([(says, concern, label, list(support), how, clause, list(retrieved))], "s string, c string, l string, u array<string>, h string, t string, r array<string>")
    return df.select(g.grounding(F.col("s"), F.col("c"), F.col("l"), F.col("u"), F.col("h"), F.col("t"), F.col("r")).alias("g")).first()["g"]


def test_grounding(spark):
    good = "The tenant pays rent of 5,000 monthly."
    assert checks(spark, good)["passed"]
    assert not checks(spark, good, support=["XX"])["checks"]["CITATION_RESTRICTED"]
    assert not checks(spark, good + " See Section 12 of it.")["checks"]["NO_SMUGGLED_CITATION"]
    assert checks(spark, good + " See Section 12 of it.", support=["MH_1"], clause="Section 12: tenant pays rent of 5,000 monthly.")["checks"]["NO_SMUGGLED_CITATION"]
    assert not checks(spark, good + " Also 9,000.")["checks"]["DOCUMENT_GROUNDED"]
    assert not checks(spark, "Bananas grow well.")["checks"]["DOCUMENT_GROUNDED"]
    assert not checks(spark, good + " This is illegal.")["checks"]["NO_LEGAL_CONCLUSION"]
    short = checks(spark, good, concern="short")
    assert not short["checks"]["CONCERN_PRESENT"] and set(short["reasons"]) == {"CONCERN_PRESENT"}
    assert checks(spark, good, concern="", label="GREEN")["passed"]


def test_parsing(spark):
    def run(column, content):
        return spark.createDataFrame([(content,)], "c string").select(column(F.col("c")).alias("x")).first()["x"]

    ok = 'Sure: {"document_says": " a ", "concern": "b", "statute_support": [{"entry_id": "X", "how_it_applies": "y"}, {"how_it_applies": "z"}]} bye'
    x = run(g.parse_explanation, ok)
    assert x["error"] is None and x["document_says"] == "a" and [e["entry_id"] for e in x["statute_support"]] == ["X"]
    assert run(g.parse_explanation, "no json")["error"]
    assert run(g.parse_explanation, '{"document_says": "", "statute_support": []}')["error"]
    assert run(g.parse_explanation, '{"document_says": "a", "statute_support": "x"}')["error"]
    assert run(g.parse_answer, '{"answer": ""}') is None
    assert run(g.parse_answer, '{"answer": "hi", "cited_clauses": ["c001", ""]}')["cited_clauses"] == ["c001"]
    assert run(g.parse_connection, '{"relationship_type": "x"}') is None
    assert run(g.parse_connection, '{"related": true}')["related"]
    p = run(g.parse_label, json.dumps({"label": "red", "probabilities": {"GREEN": 0.7, "RED": 0.3}}))
    assert abs(sum(p.values()) - 1) < 1e-9 and p["RED"] == p["GREEN"] == 0.5
    assert run(g.parse_label, '{"label": "RED", "probabilities": {}}') == {"GREEN": 0.1, "YELLOW": 0.1, "RED": 0.8}
    assert run(g.parse_label, '{"label": "BLUE", "probabilities": {}}') is None


def test_violations_and_attempts(spark):
    df = spark.createDataFrame([("The rent is 5,000. 1. This is legal. Section 9 applies.", "q", ["rent 5,000"], ["Act, 1908"], [])], "a string, q string, c array<string>, s array<string>, e array<string>")
    assert df.select(g.violations(F.col("a"), F.col("q"), F.col("c"), F.col("s"), F.col("e")).alias("v")).first()["v"] == ["verdict", "uncited_law", "invented_number"]
    rows = [
        ("a", 1, "plain", [], False), ("a", 2, "- listed", [], False),
        ("b", 1, "- good", [], False), ("b", 2, "unused", [], False),
        ("c", 1, "x", ["verdict"], False), ("c", 2, "y", ["verdict"], False),
        ("d", 1, "kept", [], False), ("d", 2, None, ["unparseable"], False),
        ("e", 1, None, ["unparseable"], False), ("e", 2, "z", ["invented_number"], False),
    ]
    out = {r["q_id"]: (r["answer"], r["outcome"], r["attempts"]) for r in g.select_attempts(spark.createDataFrame(rows, "q_id string, attempt int, answer string, problems array<string>, out_of_scope boolean")).collect()}
    assert out == {"a": ("- listed", "answered", 2), "b": ("- good", "answered", 1), "c": (None, "verdict fallback", 2), "d": ("kept", "answered", 2), "e": (None, "unreliable fallback", 2)}


def test_classify(spark):
    clauses = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", " ")], "clause_id string, text string")
    llm = spark.createDataFrame([("a", {"GREEN": 0.2, "YELLOW": 0.2, "RED": 0.6})], "clause_id string, probabilities map<string,double>")
    trained = spark.createDataFrame([(k, {"GREEN": 0.5, "YELLOW": 0.5, "RED": 0.0}) for k in "abc"], "clause_id string, probabilities map<string,double>")
    out = {r["clause_id"]: r for r in g.classify(clauses, llm, trained).collect()}
    assert out["a"]["label"] == "RED" and out["b"]["label"] == "GREEN" and out["b"]["approach"] == "trained (llm fallback)" and out["c"]["error"] == "blank text"
    mean = {r["clause_id"]: r for r in g.classify(clauses, llm, trained, "ensemble").collect()}
    assert abs(mean["a"]["probabilities"]["RED"] - 0.3) < 1e-9 and mean["b"]["error"] == "classification failed"
