"""Clause location by array columns against a plain restatement."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parchment.operators import geometry
from parchment.plans import heavy
from tests.plain_location import line_boxes, locate

WORDS = "the tenant pays rent on time and shall not sublet premises without consent of owner 5,000 days (30) notice-period é".split()


def document(rng, n):
    words = [rng.choice(WORDS) for _ in range(n)]
    clauses = []
    for k in range(rng.randrange(1, 12)):
        at, size = rng.randrange(n), rng.choice((1, 2, 3, 5, 12, 40))
        body = [w for w in words[at : at + size] if rng.random() > 0.15]
        if rng.random() < 0.2:
            body.insert(0, "absent")
        clauses.append((k, f"c{k + 1:03d}", " ".join(body)))
    boxes = [(i, 1 + i // 60, (i % 10) / 10, (i // 10 % 6) * 0.02 + rng.choice((0, 0.004, 0.011)), (i % 10 + 1) / 10, (i // 10 % 6) * 0.02 + 0.015) for i in range(n)]
    return words, clauses, boxes


def test_locations(spark):
    rng = random.Random(6)
    docs = {f"d{i}": document(rng, rng.choice((1, 5, 40, 300))) for i in range(60)}
    docs["long"] = document(rng, 9000)
    far = [f"w{i}" for i in range(6000)]
    docs["far"] = (far, [(0, "c001", "w10 w11 w12"), (1, "c002", "w5500 w5501 w5502 w5503"), (2, "c003", "w20 w21 w22"), (3, "c004", ""), (4, "c005", "w9999"), (5, "c006", "w5990 w5999")], [(i, 1, 0.0, i * 0.1, 0.1, i * 0.1 + 0.05) for i in range(6000)])
    words = [(d, *b, w) for d, (ws, _, boxes) in docs.items() for w, b in zip(ws, boxes, strict=True)]
    clauses = [(d, *c) for d, (_, cs, _) in docs.items() for c in cs]
    rng.shuffle(words)
    rng.shuffle(clauses)
    w = spark.createDataFrame(words, "document_id string, pos long, page int, x0 double, top double, x1 double, bottom double, text string")
    c = spark.createDataFrame(clauses, "document_id string, order_index int, clause_id string, text string")
    out = geometry.locations(w, c)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {}
    for r in out.orderBy("document_id", "clause_id", "line").collect():
        got.setdefault((r["document_id"], r["clause_id"]), []).append([r[k] for k in ("page", "x0", "top", "x1", "bottom")])
    want = {}
    for d, (ws, cs, boxes) in docs.items():
        for clause, at in locate(ws, [(i, t) for _, i, t in cs]).items():
            want[d, clause] = [[b[0], *(round(v, 4) for v in b[1:])] for b in line_boxes([boxes[i][1:] for i in at])]
    assert set(got) == set(want) and len(want) > 100
    for k, lines in want.items():
        assert len(lines) == len(got[k]) and all(a[0] == b[0] and all(abs(x - y) < 2e-4 for x, y in zip(a[1:], b[1:], strict=True)) for a, b in zip(lines, got[k], strict=True)), k


def test_nothing_to_locate(spark):
    w = spark.createDataFrame([("d", 0, 1, 0.0, 0.0, 0.1, 0.1, "—"), ("e", 0, 1, 0.0, 0.0, 0.1, 0.1, None), ("f", 0, 1, 0.0, 0.0, 0.1, 0.1, "only")], "document_id string, pos long, page int, x0 double, top double, x1 double, bottom double, text string")
    c = spark.createDataFrame([("d", 0, "c001", "words"), ("e", 0, "c001", None), ("f", 0, "c001", "ONLY"), ("g", 0, "c001", "no document")], "document_id string, order_index int, clause_id string, text string")
    assert [(r["document_id"], r["page"]) for r in geometry.locations(w, c).collect()] == [("f", 1)]
    assert geometry.locations(w.where(F.lit(False)), c).count() == 0


def test_openings_are_looked_up_by_halving(spark):
    """No search through the whole token stream, whose cost is a document's length for each clause; clauses of three tokens, far ones and absent ones."""
    words = [f"w{i % 700}" for i in range(5000)]
    clauses = [(k, f"c{k + 1:03d}", t) for k, t in enumerate(("w699 w0 w1", "w5 w6 w9 w10", "x1 w6", "w400", "w698 w699 w0", "absent", "w1 w2", "w3 w5 w6 w7 w8"))]
    boxes = [(i, 1, (i % 10) / 10, i // 10 * 0.1, (i % 10 + 1) / 10, i // 10 * 0.1 + 0.05) for i in range(len(words))]
    w = spark.createDataFrame([("d", *b, t) for b, t in zip(boxes, words, strict=True)], "document_id string, pos long, page int, x0 double, top double, x1 double, bottom double, text string")
    c = spark.createDataFrame([("d", *x) for x in clauses], "document_id string, order_index int, clause_id string, text string")
    out = geometry.locations(w, c)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "locate(" not in plan and "position(" not in plan
    got = {}
    for r in out.orderBy("clause_id", "line").collect():
        got.setdefault(r["clause_id"], []).append((r["x0"], round(r["top"], 1)))
    want = {k: [(b[1], round(b[2], 1)) for b in line_boxes([boxes[i][1:] for i in at])] for k, at in locate(words, [(i, t) for _, i, t in clauses]).items()}
    assert got == want and len(want) == 6


def test_runs_are_sorted_only_for_clauses_that_are_not_close(spark, monkeypatch):
    """Clauses in their order, some with tokens left out, need no list of a document's runs; one that stands far does."""
    words = [f"w{i % 90}" for i in range(400)]
    order = ["w0 w1 w2 w3 w4", "", "w9 w10 w11 w12 w14 w16", "w20 w21 w22", "w30 w31", "w32", "w33 w34 w35 w36 w38 w39 w40 absent w43", "w89 w0 w1 w2"]
    rows = {"near": order, "far": [*order, "w80 w81 w82 w83", "w10 w11"], "absent": ["w3 w4 w5 w6", "absent", "w7 w8 w9 w10"]}
    boxes = [(i, 1, (i % 10) / 10, i // 10 * 0.1, (i % 10 + 1) / 10, i // 10 * 0.1 + 0.05) for i in range(len(words))]
    w = spark.createDataFrame([(d, *b, t) for d in rows for b, t in zip(boxes, words, strict=True)], "document_id string, pos long, page int, x0 double, top double, x1 double, bottom double, text string")
    c = spark.createDataFrame([(d, k, f"c{k + 1:03d}", t) for d, x in rows.items() for k, t in enumerate(x)], "document_id string, order_index int, clause_id string, text string")

    def found(out):
        got = {}
        for r in out.orderBy("document_id", "clause_id", "line").collect():
            got.setdefault((r["document_id"], r["clause_id"]), []).append((r["x0"], round(r["top"], 1), r["x1"]))
        return got

    want = {(d, k): [(b[1], round(b[2], 1), b[3]) for b in line_boxes([boxes[i][1:] for i in at])] for d, x in rows.items() for k, at in locate(words, [(f"c{n + 1:03d}", t) for n, t in enumerate(x)]).items()}
    assert found(geometry.locations(w, c)) == want and len(want) == 7 + 9 + 2
    monkeypatch.setattr(geometry, "_CLOSE", (2, 5), raising=False)
    assert found(geometry.locations(w, c)) == want
    monkeypatch.undo()
    monkeypatch.setattr(geometry, "_runs", lambda codes, k: F.raise_error(F.lit("runs are made")).cast("array<struct<gram:bigint,at:int>>"))
    assert found(geometry.locations(w, c.where("document_id = 'near'"))) == {k: v for k, v in want.items() if k[0] == "near"}
    with pytest.raises(Exception, match="runs are made"):
        geometry.locations(w, c).collect()


def test_query_gives_boxes_of_words_on_its_grid(spark, tmp_path, monkeypatch):
    """The lines of ``clause_location`` are those of word boxes, which it no longer makes; words without a token, with several, empty and null texts."""
    rng = random.Random(8)
    made = lambda n: " ".join(rng.choice([*WORDS, "—", "...", "a/b/c", "É", "x_y"]) for _ in range(n))
    texts = ["\n".join(f"{k + 1}. {made(rng.choice((1, 4, 9, 40, 500)))}." for k in range(rng.randrange(1, 9))) for _ in range(40)]
    texts += ["", None, "  \n ", "1. RENT\n—", "  1. The tenant\t\tpays.  \n\n2. The owner repairs."]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["document_id", "clause_id", "line", "page", "x0", "top", "x1", "bottom"]
    clauses = heavy.paragraph_segmentation(spark, str(tmp_path)).where("part = 'clause'").select("document_id", "order_index", "clause_id", "text")
    words = [(str(i), k, k // 400 + 1, k % 10 / 10, k // 10 % 40 / 40, (k % 10 + 1) / 10, (k // 10 % 40 + 0.9) / 40, w) for i, t in enumerate(texts) if t is not None for k, w in enumerate(re.split(r"[ \t\n]+", t.strip(" ")))]
    w = spark.createDataFrame(words, "document_id string, pos long, page int, x0 double, top double, x1 double, bottom double, text string")
    want = sorted(tuple(r) for r in geometry.locations(w, clauses).select(*columns).collect())
    monkeypatch.setattr(geometry, "locations_of", lambda docs: pytest.fail("boxes of words are made"))
    got = heavy.clause_location(spark, str(tmp_path))
    assert got.columns == columns and dict(got.dtypes)["line"] == dict(got.dtypes)["page"] == "int"
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 300


def test_lines_are_clustered_in_the_jvm(spark):
    """No Python call for each page; a line keeps the first top that opened it."""
    rng = random.Random(3)
    pages = {(d, p): [(rng.randrange(400) / 4, float(i), f"w{i}") for i in range(rng.choice((1, 30, 700)))] for d in "ab" for p in (1, 2, 3)}
    rows = [(d, p, *w) for (d, p), ws in pages.items() for w in ws] + [("c", 1, 0.0, 0.0, "(cid:127)"), ("c", 1, 3.0, 0.0, "x"), ("c", 1, 3.5, 0.0, "y")]
    rng.shuffle(rows)
    out = geometry.lines(spark.createDataFrame(rows, "document_id string, page int, top double, x0 double, text string"))
    assert "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.orderBy("document_id", "page", "line_no").collect():
        got.setdefault((r["document_id"], r["page"]), []).append((r["top"], r["text"]))
    assert got.pop(("c", 1)) == [(0.0, "• x"), (3.5, "y")]
    assert got == {k: geometry.cluster_lines(ws) for k, ws in pages.items()}
