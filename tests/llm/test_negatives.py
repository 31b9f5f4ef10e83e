"""Hard negatives against a plain restatement, on odd vectors, ties, repeats and split blocks."""

import math
import random

import numpy as np
import pytest
from conftest import lines
from pyspark.sql import functions as F

from parchment.llm import negatives

DDL = "vec_id long, embedding array<float>, label int, v string, part int, block string"


def cases():
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(3)]
    out = []
    for i in range(400):
        b = base[i % 3]
        out.append((i, [x + rng.gauss(0, 0.8) for x in b], i % 3))
    out += [(1000 + i, list(base[0]), 1) for i in range(60)]  # one vector many times
    out += [(1100, list(base[0]), 1), (1100, list(base[1]), 1), (1100, list(base[1]), 1)]  # an anchor's id twice, repeated rows
    out += [(2001, list(base[2]), 2)] * 3
    out += [(2100, [], 0), (2200, [1.0], 0), (2300, [1.0] * 12, 1), (2400, [0.0] * 8, 2), (2500, [1.0] * 8, 77)]
    out += [(None, list(base[0]), 0), (None, list(base[1]), 1), (2600, None, 1), (2700, list(base[1]), None)]
    out += [(2800, [1.0, None], 1), (2900, [math.nan] * 8, 1), (3000, [math.inf] + [0.0] * 7, 1), (3100, [3e38] * 8, 0), (-100, list(base[1]), 1)]
    return [(i, v if v is None else [x if x is None else float(np.float32(x)) if abs(x) < 1e39 else x for x in v], lab, "x", 1, "y") for i, v, lab in out]


def plain(data, positives=5, k=10, window=(30, 90)):
    rows = []
    for i, v, label, *_ in data:
        if v is None or label is None or any(x is None or not math.isfinite(x) or abs(x * 256) > negatives.LIMIT for x in v):
            continue
        rows.append((i, label, tuple(math.floor(256 * x) for x in v)))
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, label, v in {r for r in rows if r[0] is not None and r[0] % 100 == 0}:
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), j, other) for j, other, w in rows if j != i]
        for p, j, _ in sorted((s for s in scored if s[2] == label), key=rank)[:positives]:
            inside = sorted((s for s in scored if s[2] != label and window[0] * p <= 100 * s[0] <= window[1] * p), key=rank)[:k]
            out += [(i, j, n + 1, m, p, s) for n, (s, m, _) in enumerate(inside)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows,anchor_rows,cells,options", [(4096, 1024, 64, {}), (37, 5, 4, {}), (50, 3, 16, {"positives": 3, "negatives": 4, "window": (-20, 101)})])
def test_mine(spark, monkeypatch, block_rows, anchor_rows, cells, options):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", anchor_rows)
    monkeypatch.setattr(negatives.cells_of, "__defaults__", (cells,))
    data = cases()
    df = spark.createDataFrame(data, DDL).repartition(3)
    found = negatives.mine(negatives.scaled(df), F.col("vec_id") % 100 == 0, **options)
    want = plain(data, options.get("positives", 5), options.get("negatives", 10), options.get("window", (30, 90)))
    assert lines(found, "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score") == want


def test_nothing(spark):
    empty = negatives.scaled(spark.createDataFrame([], DDL))
    assert negatives.mine(empty, F.col("vec_id") % 100 == 0).count() == 0
    lonely = negatives.scaled(spark.createDataFrame([(100, [1.0], 1, "x", 1, "y"), (3, [1.0], 2, "x", 1, "y")], DDL))
    assert negatives.mine(lonely, F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("cells", [1, 3, 64])
def test_bounds_hold_the_scores(cells):
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(0, 40, (300, 16))).astype(np.int64)
    v[:, 3], v[:100, 5] = 7, -2
    number, low, high = negatives.cells_of(v, cells)
    at = np.arange(16)[:, None]
    assert (low[at, number] <= v.T).all() and (v.T <= high[at, number]).all()
    names = ("ids", "labels", "exact", "cells", "low", "high")
    data = (np.arange(300), np.zeros(300, np.int32), v.astype(np.int32), number, low, high)
    block = negatives.Block({"rows": 300, "width": 16, **{k: x.tobytes() for k, x in zip(names, data, strict=True)}})
    lower, upper = block.bounds(v[:40], slice(0, 300))
    exact = v @ v[:40].T
    assert (lower <= exact).all() and (exact <= upper).all()


def test_few_rows_are_scored(monkeypatch):
    """On 64 dimensions the bounds leave a small share of the rows to be scored."""
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(0, 32, (2000, 64))).astype(np.int64)
    number, low, high = negatives.cells_of(v)
    names = ("ids", "labels", "exact", "cells", "low", "high")
    data = (np.arange(2000), np.ones(2000, np.int32), v.astype(np.int32), number, low, high)
    block = negatives.Block({"rows": 2000, "width": 64, **{k: x.tobytes() for k, x in zip(names, data, strict=True)}})
    scored = []
    exact = block.scores
    monkeypatch.setattr(block, "scores", lambda at, anchor: scored.append(len(at)) or exact(at, anchor))
    lower, upper = block.bounds(v[:50], slice(0, 2000))
    for a in range(50):
        best = np.sort(v @ v[a])[-3]
        negatives.in_windows(block, 0, v[a], lower[:, a], upper[:, a], np.array([[best * 30 // 100, best * 90 // 100]]), 10)
    assert sum(scored) < 0.1 * 50 * 2000
