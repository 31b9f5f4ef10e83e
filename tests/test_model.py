"""The grouped search in few passes against a fit for each grid point and fold."""

import random

import numpy as np
from pyspark.sql import functions as F

from parchment.functions import rules
from parchment.operators import model
from parchment.operators.metrics import summary


def rows(n=240, d=4, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        label = rng.choices(rules.LABELS, (6, 3, 1))[0]
        centre = {"GREEN": 0.0, "YELLOW": 0.7, "RED": 1.5}[label]
        out.append((i, i % 17, label, [centre + rng.gauss(0, 0.9) for _ in range(d)]))
    return out


def one_by_one(df, grid, folds):
    """A fit for each point and fold, by the library's own regression."""
    best = (0.0, False, -1.0)
    for balanced in (False, True):
        for c in grid:
            scored = model.out_of_fold(df, c, balanced, folds).withColumn("predicted", model.top_label(F.col("probabilities")))
            f1 = summary(scored, "risk", "predicted").first()["macro_f1"]
            if f1 > best[2]:
                best = (c, balanced, f1)
    return best


def test_the_search_chooses_as_single_fits_do(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "id int, g int, risk string, v array<double>").repartition(3)
    df = model.group_folds(model.prepared(df, "v", "risk"), "g", 3).cache()
    passes = []
    summed = model._summed
    monkeypatch.setattr(model, "_summed", lambda df, run: passes.append(1) or summed(df, run))
    found = model.select_model(df, "risk", grid=(0.01, 1.0), folds=3)
    few = len(passes)
    want = one_by_one(df, (0.01, 1.0), 3)
    assert found[:2] == want[:2] and abs(found[2] - want[2]) < 1e-9
    model.select_model(df, "risk", grid=(0.01, 0.03, 0.1, 0.3, 1.0), folds=3)
    assert few < 80 and len(passes) - few < 1.5 * few


def test_minimised_solves_many_problems_at_once():
    rng = np.random.default_rng(1)
    a = np.array([m @ m.T + np.eye(5) * 10.0**k for k, m in enumerate(rng.normal(size=(4, 5, 5)))])
    b = rng.normal(size=(4, 5))
    evaluate = lambda x: (np.einsum("mi,mij,mj->m", x, a, x) / 2 - (b * x).sum(axis=1), np.einsum("mij,mj->mi", a, x) - b)
    found = model.minimised(evaluate, np.zeros((4, 5)), tolerance=1e-10)
    assert np.allclose(found, np.linalg.solve(a, b[:, :, None])[:, :, 0], atol=1e-7)


def test_nothing_to_choose_from(spark):
    df = spark.createDataFrame([], "id int, g int, risk string, v array<double>")
    assert model.select_model(model.group_folds(model.prepared(df, "v", "risk"), "g", 3), "risk", folds=3) == (0.0, False, -1.0)


def test_tasks_of_a_fit_follow_the_rows(spark, monkeypatch):
    """Each pass of a fit sends a result per task: few rows in many partitions are fitted in one task, many rows in several."""
    seen = []
    plain = model.LogisticRegression.fit
    monkeypatch.setattr(model.LogisticRegression, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or plain(self, df))
    df = model.prepared(spark.range(60).select("id", F.array((F.col("id") % 7).cast("double"), (F.col("id") % 3).cast("double")).alias("v"), F.element_at(F.array(*map(F.lit, rules.LABELS)), (F.col("id") % 3 + 1).cast("int")).alias("label")).repartition(20), "v", "label")
    one = model.fit(df, 1.0)
    monkeypatch.setattr(model, "FIT_ROWS", 20)
    three = model.fit(df, 1.0)
    assert seen == [1, 3] and abs(one.coefficientMatrix.toArray() - three.coefficientMatrix.toArray()).max() < 1e-5
