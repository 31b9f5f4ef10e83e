"""Edges: scanned uploads as a data source, and a provider of replies with pace, retries and a quota."""

import json

import pytest

from parchment.operators import replies
from parchment.sources import client, scan
from tests.outside import Fake

PNG, PDF = b"\x89PNG", b"%PDF"


@pytest.fixture
def uploads(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(PDF + b"-1.4\nA page with more than twenty characters\nshort image\nshort")
    (tmp_path / "sub" / "b.png").write_bytes(PNG + b"\nOne photo")
    (tmp_path / "c.txt").write_bytes(b"plain")
    (tmp_path / "d.pdf").write_bytes(PDF + b"\nbroken")
    (tmp_path / "e.pdf").write_bytes(PDF)
    (tmp_path / "f.jpg").write_bytes(b"")
    return str(tmp_path)


def scanned(spark, path, **options):
    scan.register(spark)
    rows = spark.read.format("scanned").options(**options).load(path).collect()
    return {(r["path"].rsplit("/", 1)[1], r["page"]): r for r in rows}


def test_scan(spark, uploads):
    found = scanned(spark, uploads, recogniser="tests.outside:lines", partitionBytes="40")
    assert {k: r["reject_reason"] for k, r in found.items() if r["reject_reason"]} == {("c.txt", None): "unsupported content type", ("d.pdf", None): "recogniser failed: ValueError: bad page", ("e.pdf", None): "no pages", ("f.jpg", None): "unsupported content type"}
    assert [found["a.pdf", n]["method"] for n in (1, 2, 3)] == ["text", "ocr", "text"] and found["b.png", 1]["method"] == "ocr"
    assert found["a.pdf", 1]["n_chars"] == 33 and found["b.png", 1]["width"] == 100.0 and found["b.png", 1]["tsv"].endswith("One photo")


def test_scan_without_a_recogniser(spark, uploads):
    assert {r["reject_reason"] for r in scanned(spark, uploads).values()} == {"no recogniser", "unsupported content type"}
    away = scanned(spark, uploads, recogniser="tests.outside:missing")
    assert away["b.png", None]["reject_reason"] == "recogniser unavailable: no such program"
    assert scanned(spark, uploads, maxBytes="3")["a.pdf", None]["reject_reason"] == "unsupported content type"


def test_scan_feeds_the_page_rules(spark, uploads):
    from pyspark.sql import functions as F

    from parchment.operators import geometry
    from parchment.sources import readers

    scan.register(spark)
    pages = spark.read.format("scanned").option("recogniser", "tests.outside:lines").load(uploads).where("reject_reason IS NULL")
    assert geometry.page_methods(pages).where("content_type = 'application/pdf'").where(F.col("method") == "ocr").count() == 1
    cells = readers.tsv_rows(pages.select("path", "page", "tsv"), ["path", "page"])
    assert {r["cells"]["text"] for r in cells.collect()} >= {"One photo", "short image"}


def test_scan_partitions():
    assert scan.planned([("b", 5), ("a", 6), ("c", 100), ("d", 1), ("e", 0)], 10) == [("a",), ("b",), ("c",), ("d", "e")]
    assert scan.planned([], 10) == []


def prompts(folder):
    import os

    return sorted(f.split("~")[0] for f in os.listdir(folder))


def work(spark, names):
    return spark.createDataFrame([(f"k{i}", n) for i, n in enumerate(names)], "key string, prompt string")


def test_replies_are_asked_for_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replies, "FIRST_WAIT", 0.01)
    asked = tmp_path / "asked"
    asked.mkdir()
    names = ["ok-1", "ok-2", "flaky-1", "limited-1", "bad-1", "mute-1", "cached-1"]
    cache = spark.createDataFrame([("k6", "x")], "key string, value string")
    path = str(tmp_path / "saved")
    options = {"cache": cache, "rounds": 2, "tasks": 2, "spacing": 0.0, "limit": 3, "sleep": lambda s: None}
    assert client.ask_all(work(spark, names), path, Fake(str(asked)), **options) == "done"
    assert prompts(asked) == sorted(["ok-1", "ok-2", *["flaky-1"] * 2, *["limited-1"] * 2, "bad-1", *["mute-1"] * 3])
    out = {r["key"]: (r["content"], r["error"], r["attempts"]) for r in replies.outcomes(client.requests(spark, path), limit=3).collect()}
    assert out == {"k0": ("reply to ok-1", None, 1), "k1": ("reply to ok-2", None, 1), "k2": ("reply to flaky-1", None, 2), "k3": ("reply to limited-1", None, 2), "k4": (None, "refused", 1), "k5": (None, "no reply", 3)}
    # a second run asks only for what has no usable reply
    assert client.ask_all(work(spark, names), path, Fake(str(asked)), **options) == "done"
    assert prompts(asked).count("ok-1") == 1 and prompts(asked).count("bad-1") == 2 and prompts(asked).count("mute-1") == 6 and "cached-1" not in prompts(asked)


def test_a_quota_stops_all_and_the_next_run_asks_for_the_rest(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    names = [f"ok-{i}" for i in range(40)]
    path = str(tmp_path / "saved")
    options = {"rounds": 5, "tasks": 2, "spacing": 0.0, "sleep": lambda s: None}
    assert client.ask_all(work(spark, names), path, Fake(str(asked), quota_after=12), **options) == "quota"
    first = prompts(asked)
    assert 12 <= len(first) <= 14 and len(set(first)) == len(first)
    refused = client.requests(spark, path).where("status = 429").count()
    assert 1 <= refused <= 2  # each task stops at its first, and no further round begins
    assert client.ask_all(work(spark, names), path, Fake(str(asked)), **options) == "done"
    assert sorted(prompts(asked)) == sorted(names)
    assert replies.outcomes(client.requests(spark, path)).where("content IS NULL").count() == 0


def test_pace(monkeypatch):
    """Calls of a task are at least the spacing apart, and retries wait as told."""
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    monkeypatch.setattr(client.time, "monotonic", lambda: now[0])
    import pandas as pd

    answers = iter([(200, None, "a", None), (429, "x", None, "7.5"), (503, None, None, None), (200, None, "b", None)])
    ask = client._asking(lambda p: next(answers), 1, 2.5, 6, sleep)
    rows = pd.concat(ask(iter([pd.DataFrame({"key": ["k", "l"], "prompt": ["p", "q"]})])))
    assert rows["attempt"].tolist() == [0, 0, 1, 2] and json.dumps(slept) == "[2.5, 7.5, 10.0]"
