"""Segmentation by array columns against the same rules on a list."""

import random

from parchment.functions import arrays
from parchment.operators import segment

BITS = (
    "1. The Lessor|2. The Lessee pays Rs. 5,000.|1.1. Rent is due.|3) (a) first|ARTICLE IV - RENT AND DUES|ARTICLE 5: the tenant|RENT:|TERMS AND CONDITIONS:|Notice:|• item|* item two|LESSOR: ________|IN WITNESS WHEREOF the parties|"
    "NOW THIS DEED WITNESSETH AS FOLLOWS:|BETWEEN : the owner|AND the tenant|word word|SECTION 2|Maintenance Charges: paid monthly|4. Security Deposit. The Tenant pays.|SCHEDULE OF PROPERTY: 1. The flat|X. ____ 2. ___|the end.|TITLE DEED|"
    "1. ______|é1. Abc|  |(b) Next|5. “Quoted”|10. Ten|II. Second|CLAUSE 7. NOTICE The tenant|Rent is 1. Two. 2. Three; 3. Four|A B C|_|Straße 5. Weg|12. a|ENDS HERE 1. Start"
).split("|")


def documents(n, seed=1):
    rng = random.Random(seed)
    out = [[" ".join(rng.choice(BITS) for _ in range(rng.choice((1, 1, 1, 2, 3, 5)))) for _ in range(rng.randrange(30))] for _ in range(n)]
    return [*out, [], [""], [None, "   "], out[0] * 60, ["One line"], ["A. B"] * 3, [None, "Clause:", None]]


def test_arrays_say_what_the_list_says(spark):
    data = [(str(i), p) for i, p in enumerate(documents(300))]
    df = spark.createDataFrame(data, "document_id string, paragraphs array<string>").repartition(4)
    found = {r["document_id"]: [(x["part"], x["clause_number"], x["section_heading"], x["text"]) for x in r["parts"]] for r in segment.segment_arrays(df).collect()}
    assert found == {d: segment.segment_paragraphs(p) for d, p in data}


def test_rows_are_numbered_by_part(spark):
    rows = [(d, i, p) for d, paragraphs in enumerate(documents(20)) for i, p in enumerate(paragraphs)]
    random.Random(2).shuffle(rows)
    out = segment.segment(spark.createDataFrame(rows, "document_id string, pos int, paragraph string"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    numbers = {}
    for r in out.collect():
        numbers.setdefault((r["document_id"], r["part"]), []).append(r["order_index"])
        assert r["clause_id"] == (f"c{r['order_index'] + 1:03d}" if r["part"] == "clause" else None)
    assert all(sorted(x) == list(range(len(x))) for x in numbers.values()) and numbers


def test_fold_over_chunks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 2, 3, 4, 7, 1000)], "a array<int>")
    total = arrays.fold(F.col("a"), F.lit(0), lambda s, x: (s + x, s + x), "int", chunk=3)
    for r in df.select("a", total.alias("b")).collect():
        assert r["b"] == [sum(r["a"][: i + 1]) for i in range(len(r["a"]))]
    runs = df.select("a", arrays.starts_of(F.transform("a", lambda x: x % 3 == 0)).alias("s")).select("a", arrays.joined_runs(F.transform("a", lambda x: x.cast("string")), F.col("s"), "-").alias("j"))
    assert {tuple(r["j"]) for r in runs.collect() if len(r["a"]) == 7} == {("0-1-2", "3-4-5", "6")}
