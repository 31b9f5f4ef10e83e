"""Vector joins and clusters.

Similarity joins are exact.  Vectors of both sides are dealt into blocks of
``block`` rows; each task multiplies one pair of blocks in numpy and emits only
pairs at or above the threshold (or the best of each row), so the quadratic work
is spread evenly and no pair below the threshold leaves a task.  The number of
block pairs follows from the row count; nothing is broadcast or collected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1024
PART_ROWS = 8 * BLOCK


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def unit(v: Column, floor: float = 1e-12) -> Column:
    n = F.greatest(norm(v), F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / n)


def pooled(tokens: DataFrame, keys: list[str], position: str, vector: str, mask: str) -> DataFrame:
    """(keys, vector): the mean of a text's token vectors that are not masked, at unit length; what a model's last step does.

    ``tokens`` has a row per token; a text is bounded by the model's window, so its tokens are gathered.
    """
    held = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(position, F.col(mask).cast("int").alias("m"), F.col(vector).alias("v")))).alias("t"))
    total = F.aggregate("t", F.transform(F.get("t", F.lit(0))["v"], lambda x: F.lit(0.0)), lambda a, t: F.zip_with(a, t["v"], lambda x, y: x + y.cast("double") * t["m"]))
    n = F.greatest(F.aggregate("t", F.lit(0), lambda a, t: a + t["m"]).cast("double"), F.lit(1e-9))
    return held.select(*keys, F.transform(total, lambda x: x / n).alias("mean")).select(*keys, unit(F.col("mean")).alias("vector"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _pairs(threshold: float, best: int, same: bool, once: bool = False):
    def run(key, left, right):
        diagonal = once and key[0].as_py() == key[1].as_py()
        a, b = _matrix(left.column("v")), _matrix(right.column("rv"))
        ia, ib = left.column("id").to_numpy(), right.column("rid").to_numpy()
        if not len(ia) or not len(ib):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        rows, columns, values = [], [], []
        for i in range(0, len(ia), BLOCK):
            for j in range(0, len(ib), BLOCK):
                s = a[i : i + BLOCK] @ b[j : j + BLOCK].T
                keep = s >= threshold
                if same:
                    keep &= ia[i : i + BLOCK, None] < ib[None, j : j + BLOCK] if diagonal else ia[i : i + BLOCK, None] != ib[None, j : j + BLOCK]
                if best:
                    # only rows that can still be among the best leave; ties at the edge all stay
                    masked = np.where(keep, s, -np.inf)
                    k = min(best, masked.shape[1])
                    edge = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]
                    keep &= masked >= edge[:, None] - 1e-9
                x, y = np.nonzero(keep)
                rows.append(ia[i + x])
                columns.append(ib[j + y])
                values.append(s[x, y])
        return pa.table({"a": np.concatenate(rows), "b": np.concatenate(columns), "similarity": np.concatenate(values)})

    return run


def similar(left: DataFrame, right: DataFrame, threshold: float = -2.0, best: int = 0, same: bool = False) -> DataFrame:
    """(a, b, similarity) of (id, v) rows: pairs at or above ``threshold``; with ``best``, a superset of each row's best.

    ``same`` leaves out pairs of equal ids; with one frame on both sides and no ``best``, each pair of blocks is
    computed once and its pairs are returned in both directions.
    """
    once = same and not best and left is right
    n = left.count()
    m = n if left is right else right.count()
    rows, columns = max(1, math.ceil(n / (8 * BLOCK))), max(1, math.ceil(m / (8 * BLOCK)))
    own, other = (F.pmod(F.xxhash64("id"), F.lit(k)).cast("int") for k in (rows, columns))
    a = left.select("id", "v", own.alias("i")).withColumn("j", F.explode(F.sequence(F.col("i") if once else F.lit(0), F.lit(columns - 1))))
    b = right.select(F.col("id").alias("rid"), F.col("v").alias("rv"), other.alias("rj")).withColumn("ri", F.explode(F.sequence(F.lit(0), F.col("rj") if once else F.lit(rows - 1))))
    found = a.groupBy("i", "j").cogroup(b.groupBy("ri", "rj")).applyInArrow(_pairs(threshold, best, same, once), "a long, b long, similarity double")
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")) if once else found


def neighbours(vectors: DataFrame, k: int, threshold: float = -2.0) -> DataFrame:
    """The ``k`` most similar other rows of each row; ties go to the smaller id."""
    found = similar(vectors, vectors, threshold, k, same=True)
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.round("similarity", 9).desc(), "b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def shortlist(vectors: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs (a < b) in which one is among the other's ``k`` best at or above the threshold, each once."""
    near = neighbours(vectors, k, threshold)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _best_within(k: int, threshold: float, names: list[str]):
    """Of two blocks of rows (key, at, v, d), each left row's pairs of the same key that can be among its ``k`` best at or above the threshold."""

    def run(left, right):
        n, right = left.num_rows, right.select(["rkey", "rat", "rv", "rd"]).rename_columns(["key", "at", "v", "d"])
        codes = [pa.chunked_array([*left.column(c).chunks, *right.column(c).chunks]).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("key", "at")]
        width = np.concatenate([t.column("d").to_numpy() for t in (left, right)]).astype(np.int64)
        kind = np.unique(np.stack([codes[0], width], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        sides = [np.argsort(x, kind="stable") for x in (kind[:n], kind[n:])]
        cuts = [np.searchsorted(x[at], np.arange(kind.max() + 2)) for x, at in zip((kind[:n], kind[n:]), sides, strict=True)]
        rows, columns, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for c in range(len(cuts[0]) - 1):
            x, y = (at[edges[c] : edges[c + 1]] for at, edges in zip(sides, cuts, strict=True))
            if not len(x) or not len(y):
                continue
            d = int(width[x[0]])
            u, w = (t.column("v").take(pa.array(at)).combine_chunks().flatten().to_numpy().reshape(len(at), d) for t, at in ((left, x), (right, y)))
            odd = not (np.isfinite(u).all() and np.isfinite(w).all())
            for i in range(0, len(x), BLOCK):
                own = x[i : i + BLOCK]
                edge = np.full(len(own), threshold)
                best = np.full((len(own), k), -np.inf)
                for j in range(0, len(y), BLOCK):
                    other = y[j : j + BLOCK]
                    s = u[i : i + BLOCK] @ w[j : j + BLOCK].T
                    order = np.where(np.isnan(s), np.inf, s) if odd else s  # Spark sorts NaN above all numbers
                    p, q = np.nonzero(order >= edge[:, None])
                    there = codes[1][own[p]] != codes[1][n + other[q]]
                    p, q = p[there], q[there]
                    rows.append(own[p])
                    columns.append(other[q])
                    values.append(s[p, q])
                    # a row's best so far; ties at their edge all stay
                    sorting = np.lexsort([-order[p, q], p])
                    place = np.arange(len(p)) - np.searchsorted(p, p)
                    few = sorting[place < k]
                    fresh = np.full((len(own), k), -np.inf)
                    fresh[p[few], place[place < k]] = order[p[few], q[few]]
                    best = np.sort(np.concatenate([best, fresh], axis=1), axis=1)[:, -k:]
                    edge = np.maximum(threshold, best[:, 0] - 1e-9)
        a, b, found = np.concatenate(rows), np.concatenate(columns), np.concatenate(values)
        # those that later blocks have outdone are left out
        rank = np.where(np.isnan(found), np.inf, found)
        sorting = np.lexsort([-rank, a])
        a, b, found, rank = a[sorting], b[sorting], found[sorting], rank[sorting]
        first = np.searchsorted(a, a)
        last = np.minimum(first + k, np.searchsorted(a, a, side="right")) - 1
        keep = rank >= rank[last] - 1e-9 if len(a) else np.zeros(0, bool)
        return pa.table([left.column("key").take(pa.array(a[keep])), left.column("at").take(pa.array(a[keep])), right.column("at").take(pa.array(b[keep])), pa.array(found[keep])], names=names)

    return run


def shortlist_within(rows: DataFrame, key: str, position: str, vector: str, k: int, threshold: float) -> DataFrame:
    """As ``shortlist`` within each document: blocks of one document's clauses are multiplied, and only the best of a block leave a task.

    Small documents share a group; a large one is dealt into parts, and each pair of its parts is a group of its own.
    """
    kinds = dict(rows.dtypes)
    held = rows.where(F.col(key).isNotNull() & F.col(position).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    held = held.select(F.col(key).alias("key"), F.col(position).alias("at"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("d"))
    sizes = held.groupBy("key").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    buckets = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.join(sizes, "key")
    dealt = dealt.withColumns({"bucket": F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"), "own": F.pmod(F.xxhash64("at", "v"), F.col("parts")).cast("int")})
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = dealt.select("key", "at", "v", "d", "bucket", F.col("own").alias("i"), every.alias("j"))
    right = dealt.select(*[F.col(c).alias(f"r{c}") for c in ("key", "at", "v", "d", "bucket")], F.col("own").alias("rj"), every.alias("ri"))
    names = ["key", "a", "b", "similarity"]
    pairs = left.groupBy("bucket", "i", "j").cogroup(right.groupBy("rbucket", "ri", "rj")).applyInArrow(_best_within(k, threshold, names), f"key {kinds[key]}, a {kinds[position]}, b {kinds[position]}, similarity double")
    rank = F.row_number().over(W.partitionBy("key", "a").orderBy(F.round("similarity", 9).desc(), "b"))
    near = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
    return near.groupBy(F.col("key").alias(key), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))


def components(nodes: DataFrame, edges: DataFrame, checkpoint) -> DataFrame:
    """(id, component) with the smallest id reachable: hash-to-min with pointer jumping, one checkpoint a round.

    ``checkpoint`` cuts lineage (``df.checkpoint()`` or a written table).
    """
    both = checkpoint(edges.select(F.col("a").alias("u"), F.col("b").alias("w")).union(edges.select("b", "a")).distinct())
    label = checkpoint(nodes.select("id", F.col("id").alias("component")))
    while True:
        low = both.join(label, F.col("w") == F.col("id")).groupBy("u").agg(F.min("component").alias("low"))
        new = label.join(low, F.col("id") == F.col("u"), "left").select("id", F.least("component", F.coalesce("low", "component")).alias("component"))
        jump = new.select(F.col("id").alias("j"), F.col("component").alias("jc"))
        new = checkpoint(new.join(jump, F.col("component") == F.col("j")).select("id", F.col("jc").alias("component")))
        changed = new.join(label.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        label = new
        if not changed:
            return label


def keep_first(components_: DataFrame) -> DataFrame:
    return components_.where("id = component").select("id")
