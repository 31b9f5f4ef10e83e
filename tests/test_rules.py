"""The default rule tables on sentences of each kind, strict retrieval, model selection, caches, guards and reports."""

import pytest
from pyspark.sql import functions as F

from parchment.functions import rules, text
from parchment.operators import model, retrieval, store
from parchment.sources import readers, sinks

TOPIC_OF = {
    "The security deposit is two months of rent.": "security_deposit",
    "A refundable deposit shall be paid.": "security_deposit",
    "The licensor may terminate on breach.": "eviction",
    "The tenant shall vacate the flat.": "eviction",
    "Repairs are borne by the owner.": "maintenance",
    "Maintenance charges are included.": "maintenance",
    "The rent shall increase by ten percent.": "rent_escalation",
    "The licence fee will escalate yearly.": "rent_escalation",
    "Stamp duty is shared equally.": "registration",
    "This deed is to be registered.": "registration",
    "One month notice in writing.": "notice",
    "The parties shall act in good faith.": None,
}
STATE_OF = {
    "The flat is situated at Andheri, Mumbai.": ("Maharashtra", None, False),
    "Premises in Pune within Maharashtra": ("Maharashtra", None, False),
    "Situated at Dwarka, New Delhi.": ("Delhi", None, False),
    "Between a Delhi owner and a Mumbai tenant": (None, None, True),
    "The house in Bengaluru, Karnataka": (None, "Karnataka", False),
    "A shop in Chennai": (None, "Tamil Nadu", False),
    "Flat in Noida, Uttar Pradesh": (None, "Uttar Pradesh", False),
    "Howrah near Kolkata": (None, "West Bengal", False),
    "Sector 17, Chandigarh": (None, "Punjab", False),
    "Jaipur city": (None, "Rajasthan", False),
    "Surat, Gujarat": (None, "Gujarat", False),
    "No place is named here.": (None, None, False),
}


def test_topics(spark):
    df = spark.createDataFrame([(t,) for t in TOPIC_OF], "t string")
    assert {r["t"]: r["topic"] for r in df.select("t", text.topic(F.col("t")).alias("topic")).collect()} == TOPIC_OF


def test_states(spark):
    df = spark.createDataFrame([(t,) for t in STATE_OF], "t string")
    got = df.select("t", text.jurisdiction(F.col("t")).alias("h")).collect()
    assert {r["t"]: (r["h"]["jurisdiction"], r["h"]["unsupported_hint"], r["h"]["ambiguous"]) for r in got} == STATE_OF


def test_strict_retrieval_stops(spark):
    asked = spark.createDataFrame([("q", "Goa", "t", "deposit")], "query_id string, jurisdiction string, topic string, text string")
    entries = retrieval.with_words(spark.createDataFrame([("e", "Delhi", "deposit")], "entry_id string, jurisdiction string, text string"), "text")
    bridge = spark.createDataFrame([("Delhi", "t", "e")], "jurisdiction string, topic string, entry_id string")
    assert retrieval.retrieve(asked, bridge, entries).count() == 0
    with pytest.raises(Exception, match="unsupported jurisdiction: Goa"):
        retrieval.retrieve(asked, bridge, entries, strict=True).collect()


def test_model_selection(spark):
    """The first of the grid's settings with the best out-of-fold macro-F1 is chosen."""
    rows = [(i, [float(i % 3 == k) * 2 - 1 + ((i * 7 + k) % 5) / 10 for k in range(3)], ("GREEN", "YELLOW", "RED")[i % 3], i // 6) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>, risk string, g long")
    df = model.group_folds(model.prepared(df, "v", "risk"), "g", 3)
    c, balanced, f1 = model.select_model(df, "risk", grid=(0.1, 1.0), folds=3)
    assert (c, balanced) == (0.1, False) and f1 == pytest.approx(1.0)


def test_files_written_and_read_again(spark, tmp_path):
    df = spark.createDataFrame([("k1", "a"), ("k2", "b")], "key string, value string")
    sinks.append_cache(df.coalesce(1), str(tmp_path / "cache"))
    assert {r["key"]: r["value"] for r in readers.cache(spark, str(tmp_path / "cache")).collect()} == {"k1": "a", "k2": "b"}
    (tmp_path / "one.jsonl").write_text('{"key": "k1", "value": "old"}\n\n{"key": "k1", "value": "new"}\n')
    assert readers.cache(spark, str(tmp_path / "one.jsonl")).first()["value"] == "new"
    sinks.append(df, str(tmp_path / "t"))
    sinks.append(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    first = sinks.versioned(df, str(tmp_path / "v"), "1")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.versioned(df, str(tmp_path / "v"), "1")
    assert spark.read.parquet(first).count() == 2
    sinks.nested_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    (tmp_path / "r.md").write_text("# R\n## Results\n| a | n | acc |\n|---|---|---|\n| x | 3 | 50% |\n| y | 4 | n/a |\n## Next\n| z | 1 | 9% |\n")
    assert [tuple(r) for r in readers.results_table(spark, str(tmp_path / "r.md")).collect()] == [("x", "3", "50%")]


def test_reports_and_guards(spark):
    df = spark.createDataFrame([(i, "") for i in range(5)], "n int, reviewed string")
    assert sinks.markdown(df.orderBy("n").limit(1)) == "| n | reviewed |\n| --- | --- |\n| 0 |  |"
    with pytest.raises(ValueError, match="more than 3"):
        sinks.markdown(df, limit=3)
    store.reviewed_guard(df, "reviewed")
    with pytest.raises(RuntimeError):
        store.reviewed_guard(df.withColumn("reviewed", F.lit("RED")), "reviewed")
    states = [(0, "S", "City"), (1, "T", "Town")]
    t = spark.createDataFrame([(0, "a", 0, "GREEN", "in {city}, {state}"), (1, "b", 1, "RED", "{state}")], "topic_idx int, topic string, variant int, label string, template string")
    out = {(r["topic"], r["state"]): (r["rotation"], r["clause_text"]) for r in readers.expand_templates(t, states, 2).collect()}
    assert out == {("a", "S"): (0, "in City, S"), ("a", "T"): (1, "in Town, T"), ("b", "S"): (1, "S"), ("b", "T"): (0, "T")}


def test_words_are_in_all_that_their_rules_find(spark):
    """The words by which texts are passed over miss none that a rule finds: each rule's alternatives, in odd case and place."""
    topics = ["security deposit", "DEPOSIT", "évict", "evicted", "terminating", "reenter", "re-entry re-enter", "forfeiture", "repossession", "vacated", "maintains", "maintenance", "repairs", "rent will increase", "licence fee\x0bescalates", "license fees be enhanced", "registered", "REGISTRATION", "Stamp Duty", "notice", "_notice", "Knotice"]
    states = ["Maharashtra", "mumbai", "PUNE", "Nagpur", "thane", "navi mumbai", "nashik", "andheri", "Bandra", "delhi", "New Delhi", "NCR", "karnataka", "bengaluru", "bangalore", "mysuru", "mysore", "tamil nadu", "chennai", "coimbatore", "madurai", "uttar pradesh", "lucknow", "kanpur", "noida", "ghaziabad", "west bengal", "kolkata", "howrah", "punjab", "chandigarh", "ludhiana", "amritsar", "rajasthan", "jaipur", "jodhpur", "udaipur", "gujarat", "ahmedabad", "surat", "vadodara"]
    pieces = [(None, t) for t in (*topics, *states, "", "rent", "Punekar", "Kolkata", None)] + [("Stamp", "duty"), ("SECURITY", "Deposit"), ("Rent", "to increase"), ("", "x")]
    df = spark.createDataFrame([(h, t if t is None else f"{a}{t}{b}") for h, t in pieces for a, b in (("", ""), ("(", ")"), ("é", ""), ("In ", " ist"))], "h string, t string")
    hint = text.jurisdiction(F.col("t"))
    said = hint["jurisdiction"].isNotNull() | hint["unsupported_hint"].isNotNull() | hint["ambiguous"]
    whole = text.headed(F.col("t"), F.col("h"))
    rows = df.select("t", text.topic(F.col("t"), F.col("h")).isNotNull().alias("a"), text.holds_any(whole, rules.TOPIC_WORDS).alias("b"), said.alias("c"), text.holds_any(whole, rules.STATE_WORDS).alias("d")).collect()
    assert all(r["b"] for r in rows if r["a"]) and all(r["d"] for r in rows if r["c"])
    assert sum(r["a"] for r in rows) > len(topics) and sum(r["c"] or False for r in rows) > len(states)
    assert not any(r["b"] or r["d"] for r in rows if r["t"] in ("", "x", "rent"))
