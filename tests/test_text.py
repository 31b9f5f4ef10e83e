"""Column functions against plain Python restatements."""

from pyspark.sql import functions as F

from parchment.functions import text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_numbers_have_no_boundaries(spark):
    assert one(spark, text.numbers(F.col("t")), t="2,00,000 and 50000 and 2026") == ["2", "00,000", "500", "00", "202", "6"]
    assert one(spark, text.numbers(F.col("t")), t="Rs. 50,000, refundable") == ["50,000"]


def test_topics(spark):
    cases = {
        "The security deposit is two months": "security_deposit",
        "Terminate on one month's notice": "eviction",
        "Repairs are the tenant's": "maintenance",
        "The rent shall increase yearly": "rent_escalation",
        "Stamp duty is shared": "registration",
        "A notice shall be sent": "notice",
        "Nothing here": None,
    }
    for t, topic in cases.items():
        assert one(spark, text.topic(F.col("t")), t=t) == topic, t


def test_jurisdiction(spark):
    hint = lambda t: one(spark, text.jurisdiction(F.col("t")), t=t)
    assert hint("at Mumbai and Pune")["jurisdiction"] == "Maharashtra"
    assert hint("at Mumbai and Pune")["evidence"] == ["mumbai", "pune"]
    assert hint("New Delhi")["jurisdiction"] == "Delhi"
    both = hint("Delhi and Mumbai")
    assert both["jurisdiction"] is None and both["ambiguous"] and both["evidence"] == ["mumbai", "delhi"]
    assert hint("in Bengaluru")["unsupported_hint"] == "Karnataka"
    assert hint("nowhere")["unsupported_hint"] is None


def test_out_of_scope(spark):
    ask = lambda q, j: one(spark, text.out_of_scope_state(F.col("q"), F.col("j")), q=q, j=j)
    assert ask("what about Delhi law?", "Maharashtra") == "Delhi"
    assert ask("what about Mumbai?", "Maharashtra") is None
    assert ask("and in Chennai?", "Delhi") == "Tamil Nadu"
    assert ask("Delhi or Mumbai?", "Delhi") is None


def test_names_and_errors(spark):
    assert one(spark, text.slug(F.col("f")), f="01_maharashtra_leave_license_mumbai.pdf") == "maharashtra-leave-license-mumbai"
    assert one(spark, text.title(F.col("f")), f="01_maharashtra_leave_license_mumbai.pdf") == "Maharashtra Leave & Licence · Mumbai"
    assert one(spark, text.excerpt(F.col("t")), t="x" * 700) == "x" * 700
    assert one(spark, text.excerpt(F.col("t")), t="ab " * 300) == "ab " * 232 + "ab …"
    assert one(spark, text.public_error(F.col("t")), t="HTTP 429 org-123").startswith("The AI provider's daily limit")
    assert one(spark, text.public_error(F.col("t")), t="") is None
    assert one(spark, text.client_key(F.col("t")), t="  ") is None
    assert one(spark, text.visitor_key(F.col("a"), F.col("b")), a=" , x", b="peer") == "peer"
    assert one(spark, text.fill_blanks(F.col("t")), t="2. Rent of ____ ...... per  month") == "Rent of [blank] per month"
    assert one(spark, text.template_form(F.col("t")), t="The Tenant pays Rs. 5,000 for the premises") == "the PARTY_A pays AMOUNT for the PROPERTY"
    assert one(spark, text.fix_glyphs(F.col("t")), t="(cid:127) a (cid:9)") == "• a (cid:9)"
    assert one(spark, text.mid_sentence(F.col("t")), t="Ends here. ") is False
    assert one(spark, text.mid_sentence(F.col("t")), t="and goes") is True
