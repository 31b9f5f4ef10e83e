"""Operator 11, near-duplicates by bottom-k sketches of one hash function.

The sketch of a document is the ``k`` least hashes of its distinct shingles.  Two
sets of the similarity share at least ``least_shared(k)`` of the ``k`` least hashes
of their union, but for a chance of ``TAIL`` (a binomial tail); of sets that fit
their sketches the shared number is exact.  So their sketches share one of the
``prefix_size`` first values in any one order of all values, and only these go to
inverted lists.  The order puts values that many sketches retain last, by counts
over all of them, so that the lists hold near copies and not common phrases.

Overlaps of a list are found in three rounds, so that a list of a third of all
documents never yields all its pairs.  First its sets meet its most central one, that
whose values most sets retain; near copies of one text become one component.  Where a
list has several components left, its sets meet one drawn by the list, so that a
set meets as many different ones as it has lists.  At last only sets of different
components are compared in tiles by parity bits of their least hashes, a lower bound
of their difference.  In each round these bits, one to two for each value of a set
(of its ``MAP_K`` least, if it has more), tell which candidates may be similar: a pair
of less than about 0.82 goes no further, so that a family of near copies below the
threshold yields few pairs.  What may be similar is verified by the Jaccard similarity
of the full sets, read again from the texts of these documents only; in the last round
sets meet by list with their full sets, and only pairs that join two components leave.

Scale: a row of the first pass is a sketch of at most ``8 k`` bytes and a map of 128,
or of an eighth to a quarter of a byte for each value of a larger set.
Equal sets, told by 128 bits, are one.  A pair sends one set, and the other goes once
to up to ``PAIR_ROWS`` pairs; buckets are bound by bytes.  Counts are combined before
their exchange; the table of frequent values has at most ``ORDER_TERMS`` entries.

Defined cases: a text with fewer words than a shingle has one, of all its words; a
null, empty or wordless text has none and links with nothing, not even its like;
repeated rows each get a row; a null id is never the smallest, and a group of rows
without any id has none.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .graph import components
from .jaccard import BROADCAST_ROWS, shingle_sets
from .runtime import cut, read, settle, shuffle_partitions

WIDTH = 3
PERCENT = 85
K = 64
MAP_K = 1 << 16
MAP_BITS = 1024
MAP_BYTES = 32 << 20
TAIL = 1e-12
ORDER_TERMS = 1_000_000
COMMON = 8
PAIR_ROWS = 256
TILE_ROWS = 4096
TILE = 512
BUCKET_BYTES = 16 << 20
TASK_ROWS = 100_000
LEAST_TASKS = 4


@lru_cache(maxsize=64)
def least_shared(k: int, percent: int = PERCENT, tail: float = TAIL) -> int:
    """Of the ``k`` least values of their union, two sets of the similarity share at least so many, but for a chance of ``tail``."""
    p, below = percent / 100, 0.0
    for c in range(k + 1):
        below += math.exp(math.lgamma(k + 1) - math.lgamma(c + 1) - math.lgamma(k - c + 1) + c * math.log(p) + (k - c) * math.log1p(-p)) if p < 1 else float(c == k)
        if below > tail:
            return c
    return k


def prefix_size(n: int, k: int, percent: int = PERCENT) -> int:
    """So many first values of a sketch, in any one order of all values, hold one of the sketch of each similar set."""
    shared = -(-n * percent // 100)
    if 100 * n > percent * k:  # a similar set may be larger than its sketch
        shared = min(shared, least_shared(k, percent))
    return min(n, k) - shared + 1


def parity(values: np.ndarray) -> bytes:
    """Parity bits of a set, one to two for each value: two sets differ in at least as many values as their bits."""
    n = max(MAP_BITS, 1 << (len(values) - 1).bit_length())
    odd = np.bincount((values & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Parity bits of sets (rows of 64-bit words) as they are with fewer bits."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def most_apart(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Similar sets of ``n`` and ``m`` values differ in at most so many of their ``MAP_K`` least."""
    whole = (100 - percent) * (n + m) // (100 + percent)
    cut_off = np.minimum(n, MAP_K) + np.minimum(m, MAP_K) - 2 * least_shared(MAP_K, percent)
    return np.where((n <= MAP_K) & (m <= MAP_K), whole, cut_off)


def brief(sketch: np.ndarray) -> np.ndarray:
    """The upper halves of the values; values that fall together only make two sketches more alike."""
    return (sketch >> np.uint64(32)).astype(np.uint32)


def may_be_similar(n: int, x: np.ndarray, m: int, y: np.ndarray, k: int = K, percent: int = PERCENT) -> bool:
    """Whether the union of two sketches of sets of ``n`` and ``m`` values allows the similarity."""
    if percent * max(n, m) > 100 * min(n, m):
        return False
    both = np.sort(np.concatenate([x, y]))
    twice = both[1:][both[1:] == both[:-1]]
    union = len(both) - len(twice)
    if n <= k and m <= k:
        return 100 * len(twice) >= percent * union
    # the k-th least of the union: of the values up to it, those that are there twice count once
    last = np.unique(both)[min(k, union) - 1]
    return int((twice <= last).sum()) >= least_shared(k, percent)


def _sets(texts: pa.Array, width: int):
    grams, offsets = shingle_sets(texts, width)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield grams[a:b]


def _measure(width: int, k: int):
    def run(batches):
        for batch in batches:
            for part in textnum.slices(batch, "text"):
                made = [(xxhash.xxh3_128_digest(s.tobytes()), len(s), s[:k].tobytes(), parity(s[:MAP_K])) for s in _sets(part.column("text"), width)]
                columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), *columns], names=["doc_id", "h", "digest", "n", "sketch", "bits"])

    return run


def _values(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.int64))], names=["v"])


def _prefixes(common, k: int, percent: int):
    def run(batches):
        last, count = common.value
        for batch in batches:
            ids, out = batch.column("id").to_numpy(), []
            for n, held in zip(batch.column("n").to_pylist(), batch.column("sketch").to_pylist(), strict=True):
                x = np.frombuffer(held, np.uint64)
                place = np.zeros(len(x), np.int64)
                if len(last):
                    at = np.minimum(np.searchsorted(last, x), len(last) - 1)
                    place = np.where(last[at] == x, count[at], 0)
                out.append(x[np.lexsort((x, place))[: prefix_size(n, k, percent)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64)), pa.array(np.repeat(ids, [len(x) for x in out]))], names=["v", "id"])

    return run


def _named_sets(width: int):
    """(id, data) of the texts that ``id`` names, each once a partition."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in textnum.slices(batch, "text"):
                ids = part.column("id").to_pylist()
                fresh = [i for i, x in enumerate(ids) if x not in seen and not seen.add(x)]
                held = [s.tobytes() for s in _sets(part.column("text").take(pa.array(fresh, pa.int64())), width)] if fresh else []
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in fresh], pa.int64()), pa.array(held, pa.binary())], names=["id", "data"])

    return run


def _judged(alike, kind):
    """The pairs of a bucket for which ``alike`` holds: rows (a, b, n, data) are of b, or of a itself where b is null."""

    def run(table):
        first, second, sizes = (table.column(c).to_pylist() for c in ("a", "b", "n"))
        data = table.column("data").combine_chunks()
        at = lambda i: np.frombuffer(data[i].as_buffer(), kind)
        own = {a: i for i, (a, b) in enumerate(zip(first, second, strict=True)) if b is None}
        keep = [(a, b) for i, (a, b) in enumerate(zip(first, second, strict=True)) if b is not None and alike(sizes[own[a]], at(own[a]), sizes[i], at(i))]
        return pa.table({"a": pa.array([a for a, _ in keep], pa.int64()), "b": pa.array([b for _, b in keep], pa.int64())})

    return run


def _similar(percent: int):
    def alike(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
        both = np.sort(np.concatenate([x, y]))
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
        return 100 * shared >= percent * (n + m - shared)

    return alike


def _near(percent: int):
    """Whether the parity bits of two sets allow the similarity."""

    def alike(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
        if percent * max(n, m) > 100 * min(n, m):
            return False
        words = min(len(x), len(y))
        return int(np.bitwise_count(folded(x[None], words) ^ folded(y[None], words)).sum(dtype=np.int64)) <= int(most_apart(np.int64(n), np.int64(m), percent))

    return alike


class _Maps:
    """The parity bits of a group's sets by length; those of similar sets are of one length or of twice that."""

    def __init__(self, column: pa.ChunkedArray, percent: int):
        held = column.combine_chunks()
        sizes = pc.binary_length(held).to_numpy() // 8
        self.percent, self.words, self.at, self.rows = percent, sizes, {}, {}
        for w in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == w)
            self.rows[w] = np.frombuffer(b"".join(held.take(pa.array(own)).to_pylist()), np.uint64).reshape(len(own), w)
            self.at[w] = np.zeros(len(sizes), np.int64)
            self.at[w][own] = np.arange(len(own))

    def _of(self, which: np.ndarray, words: int) -> np.ndarray:
        out, own = np.empty((len(which), words), np.uint64), self.words[which]
        for w in np.unique(own).tolist():
            here = np.flatnonzero(own == w)
            out[here] = folded(self.rows[w][self.at[w][which[here]]], words)
        return out

    def close(self, s: np.ndarray, t: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Which pairs of rows (s, t), of sets of n and m values, may be similar; at most MAP_BYTES are looked at in one go."""
        out, words = np.zeros(len(s), bool), np.minimum(self.words[s], self.words[t])
        for w in np.unique(words).tolist():
            here, step = np.flatnonzero(words == w), max(1, MAP_BYTES // (8 * w))
            for i in range(0, len(here), step):
                k = here[i : i + step]
                out[k] = np.bitwise_count(self._of(s[k], w) ^ self._of(t[k], w)).sum(axis=1, dtype=np.int64) <= most_apart(n[k], m[k], self.percent)
        return out


def _joins(percent: int, root: np.ndarray, held: pa.ChunkedArray):
    """Which of the pairs of rows, taken in turn, are similar by full sets and join two components; ``root`` names each row's."""
    data, parent, alike = held.combine_chunks(), {}, _similar(percent)
    at = lambda i: np.frombuffer(data[i].as_buffer(), np.uint64)

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def run(s: np.ndarray, t: np.ndarray) -> np.ndarray:
        kept = np.zeros(len(s), bool)
        for k, (i, j) in enumerate(zip(s.tolist(), t.tolist(), strict=True)):
            p, q = top(int(root[i])), top(int(root[j]))
            if p != q:
                x, y = at(i), at(j)
                if alike(len(x), x, len(y), y):
                    kept[k], parent[max(p, q)] = True, min(p, q)
        return kept

    return run


def _tiles(percent: int, tile: int = TILE, *, marks: bool = False):
    """Pairs of each list that are of different components and that sizes and parity bits allow to be similar.

    Where rows have full sets as ``data``, only pairs that are similar by them and that join two components are kept, so
    that a bucket yields fewer pairs than it has sets.  With ``marks`` the rows (v, id) of a list that are in a pair are
    named instead of the pairs.
    """

    def run(table):
        columns = {c: table.column(c).to_numpy() for c in ("v", "i", "j", "part", "id", "root", "n")}
        maps = _Maps(table.column("bits"), percent)
        joins = _joins(percent, columns["root"], table.column("data")) if "data" in table.column_names else None
        order = np.lexsort([columns[c] for c in ("root", "j", "i", "v")])
        columns = {c: x[order] for c, x in columns.items()}
        new = np.zeros(len(order), bool)
        for c in ("v", "i", "j"):
            new[1:] |= columns[c][1:] != columns[c][:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(order)]
        left, right, marked = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(order), bool)
        for low, high in zip(cuts, cuts[1:], strict=False):
            n, root, part, ids, at = (x[low:high] for x in (columns["n"], columns["root"], columns["part"], columns["id"], order))
            split = columns["i"][low] != columns["j"][low]
            names, size = np.unique(root, return_counts=True)
            few = np.flatnonzero(root != names[size.argmax()])  # pairs within the largest component need no look
            for p in range(0, len(few), tile):
                x = few[p : p + tile]
                for q in range(0, high - low, tile):
                    y = np.arange(q, min(q + tile, high - low))
                    near = (root[x, None] != root[None, y]) & (percent * n[None, y] <= 100 * n[x, None]) & (percent * n[x, None] <= 100 * n[None, y])
                    if split:
                        near &= part[x, None] != part[None, y]
                    s, t = np.nonzero(near)
                    s, t = x[s], y[t]
                    close = maps.close(at[s], at[t], n[s], n[t])
                    s, t = s[close], t[close]
                    if marks:
                        marked[low + s] = marked[low + t] = True
                        continue
                    if joins is not None:
                        kept = joins(at[s], at[t])
                        s, t = s[kept], t[kept]
                    left.append(ids[s])
                    right.append(ids[t])
        if marks:
            return pa.table({"v": columns["v"][marked], "id": columns["id"][marked]})
        a, b = np.concatenate(left), np.concatenate(right)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _small(df: DataFrame) -> DataFrame:
    """A frame of few narrow rows is sent to all; beyond BROADCAST_ROWS it is joined by an exchange."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _tasks(n: int) -> int:
    return max(LEAST_TASKS, math.ceil(n / TASK_ROWS))


def _dense(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpointed frame in as few tasks as its rows need, and their number, so that no step leaves many tiny files of exchange."""
    n = _tasks(df.count())
    return df.coalesce(n), n


class Sketched:
    """The sketches of ``docs`` (doc_id, h, text) and their exact links; ``h`` tells texts of one id apart.

    ``rows`` has a row (row, doc_id, h, digest, n, sketch, bits) of each document; ``one`` has each distinct set once,
    with the least row as id.
    """

    def __init__(self, docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, k: int = K):
        self.docs, self.percent, self.width, self.k = docs, percent, width, k
        self.spark = docs.sparkSession
        ddl = "doc_id long, h long, digest binary, n long, sketch binary, bits binary"
        # a checkpoint keeps its partitions and their order, so these numbers stay
        self.rows = cut(docs.mapInArrow(_measure(width, k), ddl)).withColumn("row", F.monotonically_increasing_id())
        full = self.rows.where("n > 0").select("row", "digest")
        least = full.groupBy("digest").agg(F.min("row").alias("id"), F.count("*").alias("copies")).where("copies > 1")
        self.copies = cut(full.join(least, "digest").where("row <> id").select("row", "id"))
        self.one = self.rows.where("n > 0").join(_small(self.copies.select("row")), "row", "left_anti").withColumnRenamed("row", "id")

    def frequent(self):
        """Values that more than COMMON sketches retain, or more where that bounds their number, and the counts; broadcast."""
        total = self.one.agg(F.sum(F.least("n", F.lit(self.k)))).first()[0] or 0
        floor = max(COMMON, math.ceil(total / ORDER_TERMS))
        counts = self.one.select("sketch").mapInArrow(_values, "v long").groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") > floor)
        rows = [(r["v"] & (1 << 64) - 1, r["c"]) for r in counts.toLocalIterator()]
        v, c = np.array([x for x, _ in rows], np.uint64), np.array([x for _, x in rows], np.int64)
        return self.spark.sparkContext.broadcast((v[np.argsort(v)], c[np.argsort(v)]))

    def lists(self) -> DataFrame:
        """(v, id, pop): inverted lists of two or more sets; ``pop`` is how many sets a set meets in its lists.

        ``listed`` is then (id, doc_id, h, n, bits) of the sets that are in a list.
        """
        keyed, n = _dense(cut(self.one.select("id", "n", "sketch").mapInArrow(_prefixes(self.frequent(), self.k, self.percent), "v long, id long")))
        sizes = _small(cut(keyed.groupBy("v").agg(F.count("*").alias("size")).where("size > 1").coalesce(n)))
        held, n = _dense(cut(keyed.join(sizes, "v")))
        pop = cut(held.groupBy("id").agg(F.sum("size").alias("pop")).coalesce(n))
        self.listed = cut(self.one.select("id", "doc_id", "h", "n", "bits").join(_small(pop.select("id")), "id", "left_semi"))
        return held.join(_small(pop), "id").select("v", "id", "pop")

    def _dealt(self, pairs: DataFrame, data: DataFrame, size) -> DataFrame:
        """Rows (a, b, n, data) by bucket: of each pair that of b, and that of a, with null as b, once to PAIR_ROWS pairs; ``size`` is in bytes."""
        pairs, n = _dense(pairs)
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("parts")).coalesce(n)
        dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")).coalesce(n)
        sides = dealt.select(F.col("b").alias("id"), "a", "b", "part").union(dealt.select(F.col("a").alias("id"), "a", F.lit(None).cast("long"), "part").distinct().coalesce(n))
        sides = cut(sides.join(_small(self.listed.select("id", "n")), "id").coalesce(n))
        total = sides.agg(F.sum(size)).first()[0] or 0
        buckets = max(shuffle_partitions(self.spark), math.ceil(total / BUCKET_BYTES))
        held = data.join(sides, "id").coalesce(max(n, math.ceil(total / BUCKET_BYTES)))
        return held.select("a", "b", "n", "data", F.pmod(F.xxhash64("a", "part"), F.lit(buckets)).alias("bucket"))

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """The distinct ``pairs`` (a, b) whose parity bits allow the similarity."""
        pairs = cut(pairs.where("a <> b").distinct())
        held = self._dealt(pairs, self.listed.select("id", F.col("bits").alias("data")), F.greatest("n", F.lit(MAP_BITS)) / 4)
        return held.groupBy("bucket").applyInArrow(_judged(_near(self.percent), np.uint64), "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs`` (a, b) whose full sets are similar; only the texts of sets in a pair that the estimate allows are read."""
        return self._exact(self.estimated(pairs))

    def _exact(self, pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        held = self._dealt(pairs, self._full(ids), F.col("n") * 8)
        return cut(held.groupBy("bucket").applyInArrow(_judged(_similar(self.percent), np.uint64), "a long, b long").distinct())

    def _full(self, ids: DataFrame) -> DataFrame:
        """(id, data): the full sets of ``ids``, read again from their texts."""
        named = cut(self.listed.select("id", "doc_id", "h").join(ids, "id", "left_semi"))
        key = F.coalesce("doc_id", F.lit(-1)).alias("key"), "h"
        texts = self.docs.select(*key, "text").join(_small(named.select("id", *key)), ["key", "h"])
        return texts.select("id", "text").mapInArrow(_named_sets(self.width), "id long, data binary")

    def links(self) -> DataFrame:
        """(a, b): links that connect all similar sets."""
        lists = self.lists()
        settle(self.spark)
        central = lists.groupBy("v").agg(F.max_by("id", F.struct("pop", -F.col("id"))).alias("centre"))
        star = self.verified(lists.join(central, "v").select(F.col("centre").alias("a"), F.col("id").alias("b")))
        settle(self.spark)
        open_, n = _dense(cut(self._open(lists, self._components(star))))
        del lists, central
        settle(self.spark)
        drawn = F.min_by(F.struct("id", "root"), F.xxhash64("v", "id")).alias("centre")
        met = open_.join(open_.groupBy("v").agg(drawn).coalesce(n), "v").where("root <> centre.root")
        again = self.verified(met.select(F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b")).coalesce(n))
        found = star.union(again)
        del met
        settle(self.spark)
        return found.union(self._rest(cut(self._open(open_.select("v", "id"), self._components(found)))))

    def _components(self, found: DataFrame) -> DataFrame:
        return components(found, _tasks(found.count()))

    def _open(self, lists: DataFrame, found: DataFrame) -> DataFrame:
        """(v, id, root, size): the lists that hold sets of several components."""
        rooted = lists.select("v", "id").join(found, F.col("id") == F.col("node"), "left").select("v", "id", F.coalesce("root", "id").alias("root"))
        several = rooted.groupBy("v").agg(F.count("*").alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
        return rooted.join(several.select("v", "size"), "v")

    def _rest(self, open_: DataFrame) -> DataFrame:
        """(a, b): links that join the different components of each list.

        Sets that are in no candidate pair go first; the others meet again, by list, with their full sets.
        """
        sized = open_.join(self.listed.select("id", "n", "bits"), "id").withColumn("parts", F.ceil(F.col("size") / TILE_ROWS).cast("int"))
        buckets = max(shuffle_partitions(self.spark), math.ceil(self.rows.count() / 50_000))
        met = self._met(sized, buckets).groupBy("bucket").applyInArrow(_tiles(self.percent, marks=True), "v long, id long")
        met, n = _dense(cut(met))
        met = cut(met.distinct().coalesce(n).join(open_.select("v", "id", "root"), ["v", "id"]).coalesce(n))
        bits = self.listed.join(_small(met.select("id").distinct().coalesce(n)), "id", "left_semi").select("id", "n", "bits")
        met = cut(met.join(bits, "id").coalesce(n))
        size = F.sum(F.col("n") * 8).alias("size")
        total = met.agg(size).first()[0] or 0
        parts = met.groupBy("v").agg(size).coalesce(n).select("v", F.ceil(F.col("size") / BUCKET_BYTES).cast("int").alias("parts"))
        full = self._full(met.select("id").distinct().coalesce(n))
        held = full.join(met.join(parts, "v").coalesce(n), "id").coalesce(max(n, math.ceil(total / BUCKET_BYTES)))
        buckets = max(shuffle_partitions(self.spark), math.ceil(total / BUCKET_BYTES))
        return cut(self._met(held, buckets, "data").groupBy("bucket").applyInArrow(_tiles(self.percent), "a long, b long"))

    def _met(self, sized: DataFrame, buckets: int, *more: str) -> DataFrame:
        """Rows of lists (v, id, root, n, bits, parts) by bucket; a long list is dealt to parts, and each pair of parts is a group."""
        dealt = sized.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("part"), "id", "root", "n", "bits", *more)
        return dealt.withColumn("bucket", F.pmod(F.xxhash64("v", "i", "j"), F.lit(buckets)))


def clusters(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    sets = Sketched(slim, percent, width, k)
    settle(sets.spark)
    found = sets._components(sets.links())
    rows = sets.rows.select("row", "doc_id", "n")
    # a set's id: its own row, or for a copy the least row of its like
    copied = sets.copies.join(rows, "row").select("id", "doc_id")
    low = sets.one.select("id", "doc_id").union(copied).groupBy("id").agg(F.min("doc_id").alias("low"))
    rooted = cut(low.join(found, F.col("id") == F.col("node"), "left").select("id", "low", F.coalesce("root", "id").alias("root")))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut(rooted.join(named, "root").select("id", "component_id"))
    own = rows.join(sets.copies, "row", "left").select("doc_id", "n", F.coalesce("id", "row").alias("id"))
    out = own.join(named, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op11_bottom_k_dedup(spark, sf_dir: str) -> DataFrame:
    return clusters(read(spark, sf_dir, "documents"))


#: DuckDB: all pairs that share a shingle, their exact similarity, and the components of those that have it.
OP11_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(unnest(CASE WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + {WIDTH - 1}], ' ') FOR i IN range(1, len(w) - {WIDTH - 2})] END)) AS x FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)
), sides AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT sides.b, r.root FROM r JOIN sides ON sides.a = r.id
), c AS (SELECT id AS doc_id, min(root) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
