"""Fill-in-the-middle against a plain restatement, and its checkpoint index against full lists of units."""

import hashlib
import random
import re

import brute
import duckdb
import numpy as np
import pytest
from conftest import lines
from pyspark.sql import functions as F

from parchment.llm import infill


def plain(d, t, rate=100, spm=50, unit=r"[^\n]*\n|[^\n]+"):
    t = t or ""
    u = re.findall(unit, t, re.S)
    h = hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return d, len(u), "plain", None, None, brute.sha(t), brute.sha(t)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return d, len(u), "spm" if h4 % 100 < spm else "psm", len(p), len(m), brute.sha(out), brute.sha(t)


def cases():
    rng = random.Random(3)
    pieces = ["a", "é", "😀", "word ", "\n", "\n\n", "\r\n", "\x00", " ", "<", "<P", "P>"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.choice((1, 5, 40, 700)))) for _ in range(80)]
    texts += [None, "", "\n", "no end", "x\n" * 5000, "😀" * 9000, "has <M> inside\nsecond\n", "<P>", "<\nP>\n<\nS>"]
    return [*enumerate(texts), (None, "a\nb\nc\n"), (-100, "a\nb\nc\n"), (3, "again\nagain\n"), (3, "again\nagain\n")]


def made(df, spark, **options):
    out = infill.infill(df, **options).withColumns({"o": F.sha2("output", 256), "r": F.sha2(infill.restored(F.col("output"), F.col("form")), 256)})
    return lines(out, "row.doc_id", "n", "form", "prefix_chars", "middle_chars", "o", "r")


@pytest.mark.parametrize("unit,pattern", [("line", r"[^\n]*\n|[^\n]+"), ("character", ".")])
def test_infill(spark, unit, pattern):
    data = cases()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in data], "doc_id long, text string, row string, n int").repartition(3)
    assert made(df, spark, unit=unit) == sorted((plain(d, t, unit=pattern) for d, t in data), key=repr)
    some = made(df, spark, unit=unit, rate=60, spm=30)
    assert some == sorted((plain(d, t, 60, 30, pattern) for d, t in data), key=repr)
    assert {r[2] for r in some} == {"plain", "psm", "spm"}
    assert infill.infill(df).select("row.n").distinct().collect() == [(1,)]


def test_shared_rows(docs, rows, nothing, spark):
    assert made(docs, spark) == sorted((plain(d, t) for d, t, _ in rows), key=repr)
    assert infill.infill(nothing).count() == 0


@pytest.mark.parametrize("every,window", [(1, 1), (2, 3), (7, 16), (64, 1 << 16)])
@pytest.mark.parametrize("unit", ["line", "character"])
def test_checkpoints(unit, every, window):
    for t in ("", "\n", "a", "a\n", "\n\n\n", "é😀\n" * 40, "x" * 50, "ab\n\ncd" * 30 + "end", "😀" * 33):
        data = np.frombuffer(t.encode(), np.uint8)
        index = infill.Checkpoints(data, unit, every, window)
        units = re.findall(r"[^\n]*\n|[^\n]+" if unit == "line" else r"(?s:.)", t)
        assert index.n == len(units)
        assert len(index.at_byte) == -(-len(units) // every)
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert index.find(k) == (len(before.encode()), len(before))


def test_index_is_sparse():
    data = np.frombuffer(("word " * 20 + "\n").encode() * 20_000, np.uint8)
    index = infill.Checkpoints(data)
    assert index.n == 20_000 and len(index.at_byte) == -(-20_000 // infill.EVERY)


def test_sql(spark):
    data = [(d, t) for d, t in cases() if "\x00" not in (t or "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", data)
    found = con.execute(f"SELECT doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 FROM ({infill.OP13_SQL})").fetchall()
    assert sorted(found, key=repr) == made(df, spark)
