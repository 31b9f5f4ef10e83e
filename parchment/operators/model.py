"""Risk model on vectors: multinomial logistic regression, grouped folds, temperature."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from .metrics import summary

FIT_ROWS = 50_000


def prepared(df: DataFrame, vector: str, label: str, labels=rules.LABELS) -> DataFrame:
    index = F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("y", index.cast("double"))


def fit(df: DataFrame, c: float, balanced: bool = False, labels=rules.LABELS, max_iter: int = 2000):
    """L2 regression with penalty 1 / (C n), unpenalised intercept, no standardisation; ``df`` as from ``prepared``."""
    counts = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}  # one row per class
    n = sum(counts.values())
    weight = F.lit(1.0)
    if balanced:
        weight = F.element_at(F.create_map(*[F.lit(x) for y, k in counts.items() for x in (y, n / (len(counts) * k))]), F.col("y"))
    model = LogisticRegression(family="multinomial", featuresCol="features", labelCol="y", weightCol="w", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-8)
    # a pass over few rows is short: tasks follow the rows, so that what all passes send to the driver does not follow the files
    return model.fit(df.withColumn("w", weight).coalesce(max(1, math.ceil(n / FIT_ROWS))))


def predict(model, df: DataFrame, labels=rules.LABELS) -> DataFrame:
    """Adds ``probabilities`` as an array in label order; a class that the model lacks has 0."""
    p = vector_to_array("probability")
    values = F.array(*[F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i in range(len(labels))])
    return model.transform(df).withColumn("probabilities", values).drop("rawPrediction", "probability", "prediction")


def top_label(probabilities: Column, labels=rules.LABELS) -> Column:
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(probabilities, F.array_max(probabilities)).cast("int"))


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """Folds by group, largest first in a snake over the folds, which balances their sizes; one row per group is ranked."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.orderBy(F.col("n").desc(), group)) - 1
    turn, place = F.floor(rank / folds) % 2, rank % folds
    return df.join(sizes.select(group, F.when(turn == 0, place).otherwise(folds - 1 - place).cast("int").alias("fold")), group)


def out_of_fold(df: DataFrame, c: float, balanced: bool, folds: int = 5, labels=rules.LABELS) -> DataFrame:
    out = None
    for k in range(folds):
        part = predict(fit(df.where(F.col("fold") != k), c, balanced, labels), df.where(F.col("fold") == k), labels)
        out = part if out is None else out.unionByName(part)
    return out


class Grid(NamedTuple):
    """The models of a grouped search, one for each grid point and fold, side by side: ``fold`` is left out, ``weight`` is by class."""

    fold: np.ndarray
    penalty: np.ndarray
    weight: np.ndarray


def _batch_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a last 1, class numbers, folds)."""
    values = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    x = np.ones((batch.num_rows, len(values) // max(1, batch.num_rows) + 1))
    x[:, :-1] = values.reshape(batch.num_rows, -1)
    return x, batch.column("y").to_numpy().astype(np.int64), batch.column("fold").to_numpy().astype(np.int64)


def _softmax(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Probabilities (row, model, class) of parameters (model, column, class)."""
    z = np.einsum("nd,mdk->nmk", x, w, optimize=True)
    z -= z.max(axis=2, keepdims=True)
    p = np.exp(z)
    return p / p.sum(axis=2, keepdims=True)


def _losses(grid: Grid, held):
    """Per partition the sums of loss (model) and its gradient (model, column, class) over the rows that each model is fitted on."""

    def run(batches):
        w = held.value
        loss, gradient = np.zeros(len(w)), np.zeros(w.shape)
        for batch in batches:
            if batch.num_rows:
                x, y, fold = _batch_of(batch)
                p = _softmax(x, w)
                own = grid.weight[:, y].T * (fold[:, None] != grid.fold[None, :])
                loss -= (own * np.log(np.maximum(p[np.arange(len(y)), :, y], 1e-300))).sum(axis=0)
                p[np.arange(len(y)), :, y] -= 1
                gradient += np.einsum("nd,nmk->mdk", x, p * own[:, :, None], optimize=True)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([loss, gradient.ravel()]).tobytes()], pa.binary())], names=["sums"])

    return run


def _confusions(grid: Grid, held, n_classes: int):
    """Per partition the counts (model, true class, predicted class) of the rows that each model was not fitted on."""

    def run(batches):
        out = np.zeros((len(grid.fold), n_classes, n_classes))
        for batch in batches:
            if batch.num_rows:
                x, y, fold = _batch_of(batch)
                top = _softmax(x, held.value).argmax(axis=2)
                row, model = np.nonzero(fold[:, None] == grid.fold[None, :])
                np.add.at(out, (model, y[row], top[row, model]), 1)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("sums"))
    return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})


def _summed(df: DataFrame, run) -> np.ndarray:
    """One pass: what ``run`` yields per partition, added in two levels; what comes to the driver is of the size of the models."""
    parts = df.mapInArrow(run, "sums binary").withColumn("part", F.spark_partition_id() % 16)
    return sum(np.frombuffer(r["sums"], np.float64) for r in parts.groupBy("part").applyInArrow(_added, "sums binary").collect())


def minimised(evaluate, start: np.ndarray, tolerance: float = 1e-7, passes: int = 400, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton steps of many problems at once: ``evaluate`` gives (values, gradients) of all in one pass.

    Each problem (first axis) has its own history, direction and step length, and rests once its gradient is small.
    """
    dot = lambda a, b: (a * b).reshape(len(a), -1).sum(axis=1)
    wide = lambda v: v.reshape(-1, *[1] * (start.ndim - 1))
    x = start.copy()
    f, g = evaluate(x)
    scale = np.maximum(1.0, np.abs(g).reshape(len(g), -1).max(axis=1))
    s, y = [np.zeros((memory, *x.shape)) for _ in range(2)]
    rho = np.zeros((memory, len(x)))
    direction, step = -g, 1 / np.maximum(1.0, np.sqrt(dot(g, g)))
    active = np.ones(len(x), bool)
    for _ in range(passes):
        if not active.any():
            break
        trial = x + wide(np.where(active, step, 0.0)) * direction
        f2, g2 = evaluate(trial)
        good = active & (f2 <= f + 1e-4 * step * dot(g, direction))
        step = np.where(active & ~good, step / 2, step)
        active &= good | (step > 1e-12)
        at = np.flatnonzero(good)
        if not len(at):
            continue
        for h, new in ((s, trial - x), (y, g2 - g)):
            h[1:, at], h[0, at] = h[:-1, at].copy(), new[at]
        curve = dot(s[0], y[0])
        rho[1:, at], rho[0, at] = rho[:-1, at].copy(), np.where(curve > 1e-12, 1 / np.maximum(curve, 1e-12), 0.0)[at]
        x[at], f[at], g[at] = trial[at], f2[at], g2[at]
        q, alpha = g.copy(), np.zeros((memory, len(x)))
        for i in range(memory):
            alpha[i] = rho[i] * dot(s[i], q)
            q -= wide(alpha[i]) * y[i]
        length = dot(y[0], y[0])
        q *= wide(np.where(rho[0] > 0, curve / np.maximum(length, 1e-300), 1.0))
        for i in reversed(range(memory)):
            q += wide(alpha[i] - rho[i] * dot(y[i], q)) * s[i]
        down = dot(q, g) > 0
        direction[at] = -np.where(wide(down), q, g)[at]
        step[at] = 1.0
        active &= np.abs(g).reshape(len(g), -1).max(axis=1) > tolerance * scale
    return x


def select_model(df: DataFrame, label: str, grid=rules.C_GRID, folds: int = 5, labels=rules.LABELS) -> tuple[float, bool, float]:
    """(C, balanced, macro-F1): best out-of-fold macro-F1, strict improvement in grid order, unweighted points before balanced ones.

    All models of the search, a fold each for every grid point, are fitted side by side: a pass over the rows gives the
    loss and gradient of all of them, so the number of passes is that of the slowest fit and not of the grid.  ``df`` is as
    from ``group_folds`` of ``prepared``.
    """
    k = len(labels)
    held = df.select(vector_to_array("features").alias("x"), F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold")).persist()
    counts = np.zeros((folds, k))
    for r in held.groupBy("fold", "y").count().collect():  # a row for each fold and class
        counts[r["fold"], r["y"]] = r["count"]
    points = [(c, balanced) for balanced in (False, True) for c in grid]
    weights, penalties, left_out = [], [], []
    for c, balanced in points:
        for fold in range(folds):
            n = counts.sum(axis=0) - counts[fold]
            there = np.maximum(1, (n > 0).sum())
            weights.append(n.sum() / (there * np.maximum(n, 1)) if balanced else np.ones(k))
            penalties.append(1 / c)
            left_out.append(fold)
    models = Grid(np.array(left_out), np.array(penalties), np.array(weights))
    first = held.first()
    if first is None:
        return 0.0, False, -1.0
    shape, context = (len(left_out), len(first["x"]) + 1, k), df.sparkSession.sparkContext

    def evaluate(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = context.broadcast(w)
        sums = _summed(held, _losses(models, shared))
        shared.unpersist()
        loss, gradient = sums[: len(w)].copy(), sums[len(w) :].reshape(w.shape).copy()
        bound = w.copy()
        bound[:, -1] = 0  # the intercept is free
        return loss + models.penalty * (bound**2).sum(axis=(1, 2)) / 2, gradient + models.penalty[:, None, None] * bound

    found = context.broadcast(minimised(evaluate, np.zeros(shape)))
    table = _summed(held, _confusions(models, found, k)).reshape(len(points), folds, k, k).sum(axis=1)
    held.unpersist()
    best = (0.0, False, -1.0)
    for (c, balanced), t in zip(points, table, strict=True):
        hit, both = np.diagonal(t), t.sum(axis=0) + t.sum(axis=1)
        f1 = float(np.where(both > 0, 2 * hit / np.maximum(both, 1), 0.0).mean())
        if f1 > best[2]:
            best = (c, balanced, f1)
    return best


def tempered(probabilities: Column, temperature: Column | float, floor: float = rules.PROBABILITY_FLOOR) -> Column:
    """softmax(log p / T), shifted by its maximum."""
    t = F.lit(temperature) if isinstance(temperature, float) else temperature
    logs = F.transform(probabilities, lambda p: F.log(F.least(F.greatest(p, F.lit(floor)), F.lit(1.0))) / t)
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def fit_temperature(df: DataFrame, steps: int = 48, bounds=rules.TEMPERATURE_RANGE) -> float:
    """The T that minimises the negative log likelihood of ``probabilities`` for class ``y``: repeated narrowing of a grid.

    Each round is one aggregation for ``steps`` candidates; no rows come to the driver.
    """
    low, high = bounds
    for _ in range(4):
        ts = [low + (high - low) * i / (steps - 1) for i in range(steps)]
        loss = [F.avg(-F.log(F.greatest(F.element_at(tempered(F.col("probabilities"), t), (F.col("y") + 1).cast("int")), F.lit(rules.PROBABILITY_FLOOR)))).alias(f"t{i}") for i, t in enumerate(ts)]
        row = df.agg(*loss).first()
        k = min(range(steps), key=lambda i: row[i] if row[i] is not None else math.inf)
        low, high = ts[max(0, k - 1)], ts[min(steps - 1, k + 1)]
    return (low + high) / 2


def save(model, temperature: float, path: str) -> None:
    """The model and its temperature, replacing what is at ``path``."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(float(temperature),)], "temperature double").write.mode("overwrite").parquet(f"{path}/temperature")


def load(path: str) -> tuple[LogisticRegressionModel, float]:
    return LogisticRegressionModel.load(f"{path}/model"), SparkSession.active().read.parquet(f"{path}/temperature").first()[0]
