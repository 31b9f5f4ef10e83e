"""Operator 2, SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64-bit SimHashes of 3-word shingles.  Distinct fingerprints are
compared exactly: tiles of a group are combined by numpy exclusive-or and bit
counts, skipping tile pairs whose population counts differ by more than the
radius.  Which fingerprints meet in a group follows from the pigeonhole
principle: of ``blocks`` bit blocks, two fingerprints within the radius agree on
at least ``blocks - radius``, so they share a key in one table and no pair is
missed.  Components follow by alternating large-star and small-star steps.

Scale: fingerprints come from one map-only pass and are aggregated to distinct
values first, so copies, however many, are one value.  Keys use as many leading
bits as keep groups at about ``GROUP_ROWS`` values, so the work grows with the
number of distinct values and not with its square.  Group sizes are counted, and
a group above ``TILE_ROWS`` is split: its values are dealt to parts, and each
pair of parts is a task of its own.  A task returns a forest of its links, never
all pairs.  Links and components stay distributed.

Defined cases: null, empty and wordless texts have fingerprint zero, which links
like any other; repeated rows each get a row; a null id is never the smallest.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .graph import components
from .runtime import cut, pack, read, unpack

SHINGLE = 3
SEED = 42
RADIUS = 3
GROUP_ROWS = 1024
TILE_ROWS = 4096
TILE = 1024
_NO_ID = (1 << 63) - 1

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    words = text.encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(x) + 1 for x in words))
    starts = [0, *ends[: n - width]]
    return np.fromiter([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)], np.uint64, n - width + 1)


def fingerprint(text: str | None) -> int:
    """The SimHash as an unsigned 64-bit number: a bit is 1 if set in over half of the hashes."""
    h = shingle_hashes(text or "")
    if not len(h):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        part = np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += part.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        values = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(values.view(np.int64))], names=[*keep, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp) of ``docs``, with h a hash of the text: small rows, checkpointed."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return cut(slim.mapInArrow(_fingerprints, "doc_id long, h long, fp long"))


def key_tables(n: int, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> tuple[list[list[tuple[int, int]]], int]:
    """Bit ranges (start, length) of each key table, and the bits of a key that are used.

    As many blocks as give keys that split ``n`` values into groups of ``group_rows``.
    """
    need = max(0, math.ceil(math.log2(max(1, n / group_rows))))
    for blocks in range(radius + 1, 64):
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        spans = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        tables = [[spans[i] for i in chosen] for chosen in combinations(range(blocks), blocks - radius)]
        width = min(sum(n for _, n in t) for t in tables)
        if width >= need or width >= 48:
            return tables, min(need, width)
    raise ValueError(radius)


def _key(table: list[tuple[int, int]], bits: int):
    """The first ``bits`` bits of the table's blocks, as a column expression."""
    out, left = F.lit(0).cast("long"), bits
    for start, length in table:
        take = min(length, left)
        if take:
            part = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << take) - 1).cast("long"))
            out = F.shiftleft(out, take).bitwiseOR(part)
        left -= take
    return out


def find_links(values: np.ndarray, part: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within ``radius`` among ``values`` (or between those with part 0 and part 1), as two arrays of rows.

    ``values`` has one fingerprint per row, of one or more 64-bit words.
    """
    values = values.reshape(len(values), -1)
    order = np.argsort(np.bitwise_count(values).sum(axis=1), kind="stable")
    values = values[order]
    part = None if part is None else part[order]
    count = np.bitwise_count(values).sum(axis=1, dtype=np.int32)
    root = np.arange(len(values))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right = [], []
    for i in range(0, len(values), tile):
        a = values[i : i + tile]
        for j in range(i, len(values), tile):
            if count[j] - count[min(i + tile, len(values)) - 1] > radius:
                break
            b = values[j : j + tile]
            apart = np.zeros((len(a), len(b)), np.uint16)
            for w in range(values.shape[1]):
                apart += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
            near = apart <= radius
            if i == j:
                near = np.triu(near, 1)
            if part is not None:
                near &= part[i : i + tile, None] != part[None, j : j + tile]
            x, y = np.nonzero(near)
            while len(x):
                top = np.array([find(k) for k in range(i, min(i + tile, len(values)))])
                low = top if i == j else np.array([find(k) for k in range(j, min(j + tile, len(values)))])
                apart = top[x] != low[y]
                x, y = x[apart], y[apart]
                for p, q in zip(x[:4096].tolist(), y[:4096].tolist(), strict=True):
                    r, s = find(i + p), find(j + q)
                    if r != s:
                        root[s] = r
                        left.append(i + p)
                        right.append(j + q)
                x, y = x[4096:], y[4096:]
    return order[np.array(left, np.int64)], order[np.array(right, np.int64)]


def _compare(radius: int, words: list[str]):
    """The groups of one bucket; each is (table, key, i, j), and ``part`` tells the two sides of a split group."""

    def run(table):
        columns = {c: table.column(c).to_numpy() for c in ("t", "k", "i", "j", "part", "id", *words)}
        order = np.lexsort([columns[c] for c in ("j", "i", "k", "t")])
        columns = {c: x[order] for c, x in columns.items()}
        values = np.stack([columns[c] for c in words], axis=1).view(np.uint64)
        new = np.zeros(len(order), bool)
        for c in ("t", "k", "i", "j"):
            new[1:] |= columns[c][1:] != columns[c][:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(order)]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                x, y = find_links(values[a:b], columns["part"][a:b] if columns["i"][a] != columns["j"][a] else None, radius)
                left.append(columns["id"][a:b][x])
                right.append(columns["id"][a:b][y])
        return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})

    return run


def _compared(keyed: DataFrame, n_rows: int, radius: int, words: list[str]) -> DataFrame:
    """(a, b): links among rows (t, k, id, words...) that share a table's key."""
    spark = keyed.sparkSession
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sized = keyed.join(sizes, ["t", "k"]).withColumn("parts", F.ceil(F.col("n") / TILE_ROWS).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = sized.withColumn("own", own).select("t", "k", "id", *words, "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("part"), "id", *words)
    # each pair of parts is one group; many small groups share a call
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_rows / 200_000))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("t", "k", "i", "j"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(_compare(radius, words), "a long, b long").distinct()


def links(values: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that are within the radius."""
    tables, bits = key_tables(n, radius)
    keyed = values.select(F.col("fp").alias("id"), "fp", F.posexplode(F.array(*[_key(t, bits) for t in tables])).alias("t", "k"))
    return _compared(keyed, n * len(tables), radius, ["fp"])


def component_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): the component of each distinct fingerprint of ``prints``."""
    values = cut(prints.select("fp").distinct())
    found = components(links(values, values.count(), radius))
    return values.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def clusters(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``prints`` with component_id, the smallest doc_id reachable."""
    low = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    rooted = cut(component_of(prints, radius).join(low, "fp"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "component_id"), "fp")


def near_groups(docs: DataFrame, similarity: float = jaccard.SIMILARITY) -> DataFrame:
    """(doc_id, h, root) of each row: groups of near-duplicates.

    Candidates are the fingerprints within RADIUS bits, and for the similar sets that those miss, sets of 5-word
    shingles that share a prefix shingle.  A candidate is a link only if the Jaccard similarity of the two sets, compared
    exactly, is ``similarity`` or more; all such links are found.
    """
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    sets = jaccard.Similar(slim, fingerprint, similarity)
    low = cut(sets.one.groupBy("fp").agg(F.min("id").alias("low")))
    same = sets.one.join(low, "fp").select(F.col("low").alias("a"), F.col("id").alias("b"))
    near = links(low.select("fp"), low.count())
    near = near.join(low.toDF("a", "la"), "a").join(low.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    found = components(sets.links(same.union(near)))
    named = sets.one.select("digest", "id").join(found, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("root", "id").alias("root"))
    return sets.rows.select("doc_id", "h", "digest").join(named, "digest").select("doc_id", "h", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id (none: the last), then the smallest text hash.

    What goes is told to the texts, which are not moved if it fits a broadcast; rows with equal id and text are rare and
    are made one apart.
    """
    groups = cut(near_groups(docs).groupBy("root", "doc_id", "h").agg(F.count("*").alias("n")))
    best = groups.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("low"))
    best = best.select("root", "low.doc_id", "low.h", F.lit(True).alias("stays"))
    told = groups.join(best, ["root", "doc_id", "h"], "left").withColumn("stays", F.coalesce("stays", F.lit(False)))
    told = cut(told.where("NOT stays OR n > 1").select("doc_id", "h", "stays"))
    told = F.broadcast(told) if told.count() <= jaccard.BROADCAST_ROWS else told
    packed = pack(docs).withColumns({"doc_id": F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_NO_ID)), "h": F.xxhash64("text")})
    single = packed.join(told, ["doc_id", "h"], "left_anti")
    repeated = packed.join(told.where("stays").drop("stays"), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    return unpack(single.unionByName(repeated), docs.columns)


def op2_simhash_components(spark, sf_dir: str) -> DataFrame:
    found = clusters(fingerprints(read(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
