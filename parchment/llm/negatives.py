"""Operator 12, hard-negative mining with a vector-approximation file.

Anchors are a stated query set of rows.  Of each, the best ``positives`` other rows of
the same label are found first; each positive's score opens a window, a range of
percents of it, and the best ``negatives`` rows of other labels in the window are
returned.  Scores are exact integer inner products.

Rows are packed into blocks.  A block is a vector-approximation file: each dimension
is quantised into up to ``CELLS`` cells of about equal numbers of rows, of which the
block keeps the cell numbers (a byte a component) and the least and greatest component
in each cell.  For an anchor a table of its products with those two gives, by lookup
and addition, a lower and an upper bound of every row's score.  Only rows whose bounds
let them be among the best, or among the best in a window, are scored exactly.

Scale: anchors meet all rows in pairs of blocks, (anchor block, row block), each a row
of its own in one exchange; the number of pairs grows with anchors times rows, as the
query set does, but what is sent of rows is a copy for each ``ANCHOR_ROWS`` anchors, and
of anchors one for each ``BLOCK_ROWS`` rows.  A pair of blocks returns at most
``positives`` rows an anchor, or ``negatives`` a window; Spark's ranked windows cut them
again before their exchange.  Blocks hold any mix of labels, so a label, a vector or an
id of a third of all rows is spread over all of them.  Blocks are checkpointed.

Defined cases: rows with a null label, a null vector, or a null or non-finite component
take no part, nor do those with a scaled component beyond 2**24, whose products need
not fit a long; a shorter vector counts as filled up with zeros, so an empty one scores
0 with all; a null id is no anchor, and comes last among equal scores; rows that share
the anchor's id are no "other" rows; repeated rows are told apart among positives and
negatives, and repeated anchors, equal in all three columns, are one; an anchor without
another row of its label, or with no row in any window, has no result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import cut, read

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
WINDOW = (30, 90)
CELLS = 64
BLOCK_ROWS = 2048
ANCHOR_ROWS = 1024
TILE = 32
LIMIT = 1 << 24
_NO_ID = (1 << 63) - 1


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): the rows that take part, components as floor(scale * x)."""
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(x * scale)) <= LIMIT) & (F.abs(x) <= LIMIT))
    slim = slim.where(F.col("label").isNotNull() & F.col("x").isNotNull()).where(sound)
    return slim.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def _matrix(lists: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of vectors filled up with zeros to the longest, or to ``width``."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), max([0, *sizes.tolist()]) if width is None else width), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def cells_of(v: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers (dimension, row) and the least and greatest component of each (dimension, cell)."""
    rows, width = v.shape
    number = np.zeros((width, rows), np.uint8)
    low, high = (np.zeros((width, cells), np.int64) for _ in range(2))
    for d in range(width):
        x = v[:, d]
        edges = np.unique(np.sort(x)[(np.arange(1, cells) * rows) // cells])
        at = np.searchsorted(edges, x, side="right")
        number[d] = at
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        used = at[order][first]
        low[d, used] = np.minimum.reduceat(x[order], first)
        high[d, used] = np.maximum.reduceat(x[order], first)
    return number, low, high


def _block(batches):
    """The rows of a partition as one approximation file, sorted by label and id."""
    ids, labels, lists = [], [], []
    for batch in batches:
        ids.append(batch.column("vec_id").fill_null(_NO_ID).to_numpy())
        labels.append(batch.column("label").to_numpy())
        lists.append(batch.column("v"))
    if not sum(map(len, ids)):
        return
    ids, labels, v = np.concatenate(ids), np.concatenate(labels), _matrix(pa.concat_arrays(lists))
    order = np.lexsort((ids, labels))
    number, low, high = cells_of(v[order])
    data = (ids[order], labels[order].astype(np.int32), v[order].astype(np.int32), number, low, high)
    columns = [pa.array([len(ids)], pa.int64()), pa.array([v.shape[1]], pa.int64()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in data)]
    yield pa.RecordBatch.from_arrays(columns, names=["rows", "width", "ids", "labels", "exact", "cells", "low", "high"])


_BLOCK_DDL = "rows long, width long, ids binary, labels binary, exact binary, cells binary, low binary, high binary"


def blocks(rows: DataFrame, n: int) -> DataFrame:
    """(block, ...): ``rows`` in ``n`` partitions of equal size, each an approximation file."""
    return cut(rows.repartition(n).mapInArrow(_block, _BLOCK_DDL).withColumn("block", F.spark_partition_id()))


class Block:
    """A row of ``blocks``, read back."""

    def __init__(self, row: dict):
        n, width = row["rows"], row["width"]
        kinds = {"ids": np.int64, "labels": np.int32, "exact": np.int32, "cells": np.uint8, "low": np.int64, "high": np.int64}
        x = {k: np.frombuffer(row[k], kind) for k, kind in kinds.items()}
        self.width, self.ids, self.labels = width, x["ids"], x["labels"]
        self.exact, self.cells = x["exact"].reshape(n, width), x["cells"].reshape(width, n)
        self.low, self.high = (x[k].reshape(width, -1) for k in ("low", "high"))

    def bounds(self, anchors: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (row, anchor) of the scores, summed from a table of each dimension's cells."""
        most = np.abs(anchors).max(initial=0) * max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0)) * self.width
        kind = np.int32 if most < 1 << 31 else np.int64
        lower, upper = (np.zeros((len(self.ids[rows]), len(anchors)), kind) for _ in range(2))
        for d in range(self.width):
            a, b = (edge[d][:, None] * anchors[None, :, d] for edge in (self.low, self.high))
            cell = self.cells[d, rows]
            lower += np.minimum(a, b).astype(kind)[cell]
            upper += np.maximum(a, b).astype(kind)[cell]
        return lower, upper

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.exact[at].astype(np.int64) @ anchor

    def best(self, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` of rows ``at`` by score, ties by id."""
        return np.lexsort((self.ids[at], -score))[:k]


def _greatest(x: np.ndarray, k: int):
    """The k-th greatest, or None where there are fewer."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else None


def nearest(block: Block, anchor_id: int, anchor: np.ndarray, lower: np.ndarray, upper: np.ndarray, first: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the ``k`` best other rows; the bounds are of the rows from ``first`` on, all of the anchor's label."""
    other = block.ids[first : first + len(lower)] != anchor_id
    floor = _greatest(lower[other], k)
    at = np.flatnonzero(other if floor is None else other & (upper >= floor)) + first
    score = block.scores(at, anchor)
    top = block.best(at, score, k)
    return at[top], score[top]


def in_windows(block: Block, label: int, anchor: np.ndarray, lower: np.ndarray, upper: np.ndarray, ranges: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(window, rows, scores): of the rows of other labels the ``k`` best in each of ``ranges`` (least, greatest score)."""
    other = block.labels != label
    maybe = np.zeros(len(other), bool)
    for least, most in ranges.tolist():
        possible = other & (upper >= least) & (lower <= most)
        floor = _greatest(lower[possible & (lower >= least) & (upper <= most)], k)
        maybe |= possible if floor is None else possible & (upper >= floor)
    at = np.flatnonzero(maybe)
    score = block.scores(at, anchor)
    out = []
    for w, (least, most) in enumerate(ranges.tolist()):
        inside = np.flatnonzero((score >= least) & (score <= most))
        top = inside[block.best(at[inside], score[inside], k)]
        if len(top):
            out.append((w, at[top], score[top]))
    return out


def _met_in(left: pa.Table, right: pa.Table):
    """The block, and the anchors' ids, tags, vectors and table, of one pair of blocks; None if a side is empty."""
    if not left.num_rows or not right.num_rows:
        return None
    block = Block(left.to_pylist()[0])
    v = _matrix(right.column("v").combine_chunks())
    # components beyond the block's width meet zeros only
    wide = np.zeros((len(v), block.width), np.int64)
    wide[:, : v.shape[1]] = v[:, : block.width]
    return block, right.column("anchor_id").to_numpy(), right.column("tag").to_numpy(), wide


def _table(out: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in out], names=names)


def _positives(k: int, tile: int = TILE):
    def run(left, right):
        out = [], [], [], []
        if met := _met_in(left, right):
            block, ids, tags, v = met
            labels = right.column("label").to_numpy()
            for label in np.unique(labels).tolist():
                rows = slice(*np.searchsorted(block.labels, [label, label + 1]).tolist())
                mine = np.flatnonzero(labels == label) if rows.start < rows.stop else np.zeros(0, np.int64)
                for low in range(0, len(mine), tile):
                    some = mine[low : low + tile]
                    lower, upper = block.bounds(v[some], rows)
                    for j, a in enumerate(some.tolist()):
                        at, score = nearest(block, ids[a], v[a], lower[:, j], upper[:, j], rows.start, k)
                        for c, x in zip(out, (np.full(len(at), ids[a]), np.full(len(at), tags[a]), block.ids[at], score), strict=True):
                            c.append(x)
        return _table(out, ["anchor_id", "tag", "positive_id", "score"])

    return run


def _negatives(k: int, window: tuple[int, int], tile: int = TILE):
    def run(left, right):
        out = [], [], [], [], []
        if met := _met_in(left, right):
            block, ids, tags, v = met
            labels, opened = right.column("label").to_numpy(), right.column("opened").combine_chunks()
            offsets, (place, p) = opened.offsets.to_numpy(), (opened.flatten().field(i).to_numpy() for i in range(2))
            # the least whole score with 100 * score >= low * p, and the greatest with 100 * score <= high * p
            ranges = np.stack([-((-window[0] * p) // 100), window[1] * p // 100], axis=1)
            offsets = offsets - offsets[0]
            for low in range(0, len(ids), tile):
                lower, upper = block.bounds(v[low : low + tile], slice(0, len(block.ids)))
                for a in range(low, low + lower.shape[1]):
                    own = slice(*offsets[a : a + 2].tolist())
                    for w, at, score in in_windows(block, labels[a], v[a], lower[:, a - low], upper[:, a - low], ranges[own], k):
                        for c, x in zip(out, (np.full(len(at), ids[a]), np.full(len(at), tags[a]), np.full(len(at), place[own][w], np.int64), block.ids[at], score), strict=True):
                            c.append(x)
        return _table(out, ["anchor_id", "tag", "place", "negative_id", "score"])

    return run


def _met(held: DataFrame, n_blocks: int, anchors: DataFrame, n_anchors: int, run, ddl: str) -> DataFrame:
    """``run`` on each pair of a block of rows and a block of anchors; the pairs are dealt evenly."""
    parts = max(1, math.ceil(n_anchors / ANCHOR_ROWS))
    left = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = anchors.withColumn("part", F.pmod(F.xxhash64("anchor_id", "tag"), F.lit(parts)).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, ddl)


def _ranked(found: DataFrame, keys: list[str], other: str, k: int) -> DataFrame:
    """The first ``k`` rows of each key by score, ties by ``other``, numbered from 1."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), other)
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def mine(rows: DataFrame, query: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``rows`` (vec_id, label, v) that ``query`` names.

    A row of another label is in a positive's window if ``window[0] * p <= 100 * score <= window[1] * p``.
    """
    asked = rows.where(query & F.col("vec_id").isNotNull())
    total = rows.agg(F.count("*").alias("n"), F.count_if(query & F.col("vec_id").isNotNull()).alias("a")).first()
    n_blocks = max(1, math.ceil(total["n"] / BLOCK_ROWS))
    held = blocks(rows, n_blocks)
    keyed = asked.select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "v").alias("tag"), "label", "v")
    keyed = cut(keyed.dropDuplicates(["anchor_id", "tag"]))
    near = _met(held, n_blocks, keyed, total["a"], _positives(positives), "anchor_id long, tag long, positive_id long, score long")
    best = cut(_ranked(near, ["anchor_id", "tag"], "positive_id", positives).withColumnsRenamed({"n": "place", "score": "positive_score"}))
    opened = best.groupBy("anchor_id", "tag").agg(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "positive_score")).alias("opened"))
    windowed = keyed.join(opened, ["anchor_id", "tag"])
    hard = _met(held, n_blocks, windowed, total["a"], _negatives(negatives, window), "anchor_id long, tag long, place long, negative_id long, score long")
    hard = _ranked(hard, ["anchor_id", "tag", "place"], "negative_id", negatives).withColumnsRenamed({"n": "rank", "score": "negative_score"})
    named = lambda c: F.when(F.col(c) < _NO_ID, F.col(c)).alias(c)
    return hard.join(best, ["anchor_id", "tag", "place"]).select("anchor_id", named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = scaled(read(spark, sf_dir, "embeddings").withColumn("label", label))
    return mine(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows_ a, rows_ r
  WHERE a.vec_id % 100 = 0 AND (r.vec_id <> a.vec_id OR r.vec_id IS NULL)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
