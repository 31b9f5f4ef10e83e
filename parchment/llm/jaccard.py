"""Exact links of word-shingle sets with a Jaccard similarity of 0.8 or more.

Candidates come from prefix filtering: in any one order of all shingles, two sets
of that similarity share one of their first ``n - ceil(0.8 n) + 1`` shingles, so
only these are exchanged.  The order puts shingles that a bounded sample holds
often last; it decides how much is compared, never what is found.  Within the
sets of one shingle, numpy exclusive-or and bit counts of 512 parity bits bound
the difference of two sets from below, tile by tile; longer maps, of two bits or
more for each shingle, bound it closely.  What is left is confirmed on the sets.

Scale: sets are never stored.  A row keeps its prefix (a fifth of its shingles, 8
bytes each) and is named by a number of its own; equal sets, told by 128 bits,
are one.  Texts are read again for the sets in candidate pairs only.  A shingle
of a third of all rows is counted with map-side combine, joined back by an
equi-join that adaptive execution can split.  Its sets are first compared with one
of them, drawn by the hash of the shingle, so that a set in a large group of near
copies meets as many different ones as it shares shingles with them and the group
becomes one component; only sets that are apart then are compared in pairs of parts.

Defined cases: a null, empty or wordless text has the empty set, like any other
such text; texts of fewer words than a shingle have one, of all their words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .graph import components
from .runtime import cut, settle

WIDTH = 5
SIMILARITY = 0.8
SAMPLE_ROWS = 5_000
ORDER_TERMS = 1_000_000
BROADCAST_ROWS = 1_000_000
TILE_ROWS = 4096
PAIR_ROWS = 256
BUCKET_PAIRS = 2000
TILE = 1024
LANES = 8
_MAPS = [f"w{i}" for i in range(LANES)]
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def shingle_sets(text: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's shingles of ``width`` words (fewer: the whole sequence) in order, end to end, and the texts' offsets in them."""
    data, offsets = textnum.buffer_of(text)
    words = textnum.Words(_LOWER[data], offsets)
    h, rows = words.hashes(), len(words.count)
    grams = textnum.rolling(h, width)
    at = np.flatnonzero(words.doc[: len(grams)] == words.doc[width - 1 : width - 1 + len(grams)])
    grams, doc = grams[at], words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    whole = [textnum.rolling(h[words.first[i] : words.first[i] + words.count[i]], int(words.count[i]))[0] for i in short.tolist()]
    grams, doc = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.searchsorted(doc[new], np.arange(rows + 1))


def _each_set(texts: pa.Array):
    grams, offsets = shingle_sets(texts)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield grams[a:b]


def bitmap(grams: np.ndarray) -> np.ndarray:
    """512 parity bits of a set, as eight words: two sets differ in at least as many shingles as their bitmaps in bits."""
    odd = np.bincount((textnum.mix(grams) >> np.uint64(55)).astype(np.int64), minlength=64 * LANES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fine_map(grams: np.ndarray) -> np.ndarray:
    """Parity bits like ``bitmap``, two to four for each shingle (a power of two of them), as bytes."""
    size = 1 << max(6, (2 * len(grams)).bit_length())
    odd = np.bincount((textnum.mix(grams) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Two sets with fine maps ``x`` and ``y`` differ in at least so many shingles; the longer map is folded to the shorter."""
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, min(len(x), len(y))), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def prefix_size(n: int, percent: int) -> int:
    """So many first shingles of a set, in any one order of all shingles, hold one of each set with that similarity."""
    return n - -(-n * percent // 100) + 1


def _prefix(grams: np.ndarray, common, percent: int) -> np.ndarray:
    if not len(grams):
        return grams
    last, count = common
    place = np.zeros(len(grams), np.int64)
    if len(last):
        k = np.minimum(np.searchsorted(last, grams), len(last) - 1)
        place = np.where(last[k] == grams, count[k], 0)
    return grams[np.lexsort((grams, place))[: prefix_size(len(grams), percent)]]


def _sample(batches):
    for batch in batches:
        for part in textnum.slices(batch, "text"):
            grams, _ = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], names=["gram"])


def common_shingles(docs: DataFrame):
    """Shingles that a sample of the distinct texts holds often, in order, and their counts there; broadcast."""
    share = max(1, math.ceil(docs.count() / SAMPLE_ROWS))
    sample = docs.where(F.pmod("h", F.lit(share)) == 0).dropDuplicates(["h"]).select("text")
    counts = sample.mapInArrow(_sample, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 2")
    rows = [(r["gram"] & (1 << 64) - 1, r["n"]) for r in counts.orderBy(F.desc("n"), "gram").limit(ORDER_TERMS).toLocalIterator()]
    grams, n = np.array([g for g, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64)
    order = np.argsort(grams)
    return docs.sparkSession.sparkContext.broadcast((grams[order], n[order]))


def _measure(common, percent: int, fingerprint):
    def run(batches):
        for batch in batches:
            for part in textnum.slices(batch, "text"):
                texts = part.column("text")
                prints = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts))
                digests, sizes, prefixes, fines, maps = [], [], [], [], np.zeros((len(texts), LANES), np.uint64)
                for i, grams in enumerate(_each_set(texts)):
                    digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                    sizes.append(len(grams))
                    prefixes.append(_prefix(grams, common.value, percent).tobytes())
                    fines.append(fine_map(grams).tobytes())
                    maps[i] = bitmap(grams)
                columns = [part.column("doc_id"), part.column("h"), pa.array(prints.view(np.int64)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(fines, pa.binary())]
                columns += [pa.array(np.ascontiguousarray(maps[:, i]).view(np.int64)) for i in range(LANES)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "fp", "digest", "n", "prefix", "fine", *_MAPS])

    return run


def measured(docs: DataFrame, fingerprint, percent: int) -> DataFrame:
    """(row, doc_id, h, fp, digest, n, prefix, fine, maps) of ``docs`` (doc_id, h, text), checkpointed; ``row`` numbers the rows."""
    ddl = "doc_id long, h long, fp long, digest binary, n long, prefix binary, fine binary, " + ", ".join(f"{c} long" for c in _MAPS)
    out = cut(docs.mapInArrow(_measure(common_shingles(docs), percent, fingerprint), ddl))
    # a checkpoint keeps its partitions and their order, so these numbers stay
    return out.withColumn("row", F.monotonically_increasing_id())


def _keys(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            held = batch.column("prefix").slice(start, 256).to_pylist()
            ids = batch.column("id").slice(start, 256).to_numpy()
            keys = np.frombuffer(b"".join(held), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(ids, [len(x) // 8 for x in held]))], names=["k", "id"])


def _meet(percent: int, tile: int = TILE):
    """Pairs of each group that have different roots and that sizes and bitmaps allow to be similar."""

    def run(table):
        columns = {c: table.column(c).to_numpy() for c in ("k", "i", "j", "part", "id", "root", "n", *_MAPS)}
        order = np.lexsort([columns[c] for c in ("n", "j", "i", "k")])
        columns = {c: x[order] for c, x in columns.items()}
        maps = np.stack([columns[c] for c in _MAPS], axis=1).view(np.uint64)
        n, root, part, ids = (columns[c] for c in ("n", "root", "part", "id"))
        new = np.zeros(len(order), bool)
        for c in ("k", "i", "j"):
            new[1:] |= columns[c][1:] != columns[c][:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(order)]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high - low < 2 or (root[low:high] == root[low]).all():
                continue
            split = columns["i"][low] != columns["j"][low]
            for p in range(low, high, tile):
                x = slice(p, min(p + tile, high))
                for q in range(p, high, tile):
                    y = slice(q, min(q + tile, high))
                    if percent * n[q] > 100 * n[x.stop - 1]:
                        break
                    near = (root[x, None] != root[None, y]) & (percent * n[None, y] <= 100 * n[x, None]) & (percent * n[x, None] <= 100 * n[None, y])
                    if split:
                        near &= part[x, None] != part[None, y]
                    apart = np.zeros(near.shape, np.int64)
                    for w in range(LANES):
                        apart += np.bitwise_count(maps[x, None, w] ^ maps[None, y, w])
                    near &= (100 + percent) * apart <= (100 - percent) * (n[x, None] + n[None, y])
                    a, b = np.nonzero(np.triu(near, 1) if p == q else near)
                    left.append(ids[x][a])
                    right.append(ids[y][b])
        a, b = np.concatenate(left), np.concatenate(right)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _plausible(percent: int):
    """Of pairs with their sizes and fine maps, those that may be similar."""

    def run(batches):
        for batch in batches:
            keep = []
            for m, n, x, y in zip(batch.column("an").to_pylist(), batch.column("bn").to_pylist(), batch.column("ac"), batch.column("bc"), strict=True):
                sized = percent * max(m, n) <= 100 * min(m, n)
                keep.append(sized and (100 + percent) * apart(*(np.frombuffer(c.as_buffer(), np.uint8) for c in (x, y))) <= (100 - percent) * (m + n))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(batches):
    """(id, grams) of the texts that ``id`` names, each once a partition."""
    seen: set[int] = set()
    for batch in batches:
        for part in textnum.slices(batch, "text"):
            ids = part.column("id").to_pylist()
            fresh = [i for i, x in enumerate(ids) if x not in seen and not seen.add(x)]
            held = [x.tobytes() for x in _each_set(part.column("text").take(pa.array(fresh, pa.int64())))] if fresh else []
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in fresh], pa.int64()), pa.array(held, pa.binary())], names=["id", "grams"])


def _exact(percent: int):
    """Of the pairs of a bucket, those of the similarity or more: rows (a, b, grams) with the set of b, or that of a where b is null."""

    def run(table):
        first, second, grams = table.column("a").to_pylist(), table.column("b").to_pylist(), table.column("grams").combine_chunks()
        own = {a: i for i, (a, b) in enumerate(zip(first, second, strict=True)) if b is None}
        keep = []
        for i, (a, b) in enumerate(zip(first, second, strict=True)):
            if b is not None:
                x, y = (np.frombuffer(grams[k].as_buffer(), np.uint64) for k in (own[a], i))
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in keep], pa.int64()), "b": pa.array([b for _, b in keep], pa.int64())})

    return run


class Similar:
    """The sets of ``docs`` and their exact links.

    ``rows`` is as from ``measured``; ``one`` (without prefixes) has each distinct set once, with the least row as id.
    """

    def __init__(self, docs: DataFrame, fingerprint, similarity: float = SIMILARITY):
        self.percent = round(100 * similarity)
        self.docs = docs
        self.rows = measured(docs, fingerprint, self.percent)
        least = self.rows.groupBy("digest").agg(F.min("row").alias("least"), F.count("*").alias("n_rows")).where("n_rows > 1")
        again = cut(self.rows.select("row", "digest").join(least, "digest").where("row <> least").select("row"))
        again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
        self.first = self.rows.join(again, "row", "left_anti").withColumnRenamed("row", "id")
        self.one = cut(self.first.select("id", "digest", "doc_id", "h", "fp", "n", "fine", *_MAPS))

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """The distinct ``pairs`` (a, b) that sizes and fine maps allow to be similar."""
        side = {s: self.one.select(F.col("id").alias(s), F.col("n").alias(f"{s}n"), F.col("fine").alias(f"{s}c")) for s in "ab"}
        both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().join(side["a"], "a").join(side["b"], "b")
        return both.mapInArrow(_plausible(self.percent), "a long, b long")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs`` whose sets are as similar by exact comparison; only texts of sets in a pair are read as sets.

        The set of b goes straight to its pair (a, b), and that of a once to up to PAIR_ROWS of its pairs, in one exchange.
        """
        pairs = cut(self.plausible(pairs))
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("parts"))
        dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
        sides = dealt.select(F.col("b").alias("id"), "a", "b", "part").union(dealt.select(F.col("a").alias("id"), "a", F.lit(None).cast("long"), "part").distinct())
        named = cut(self.one.select("id", "doc_id", "h").join(sides.select("id").distinct(), "id", "left_semi"))
        few = named.count() <= BROADCAST_ROWS
        texts = self.docs.join(F.broadcast(named) if few else named, ["doc_id", "h"]).select("id", "text")
        buckets = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs.count() / BUCKET_PAIRS))
        held = texts.mapInArrow(_sets, "id long, grams binary").join(sides, "id").select("a", "b", "grams", F.pmod(F.xxhash64("a", "part"), F.lit(buckets)).alias("bucket"))
        return cut(held.groupBy("bucket").applyInArrow(_exact(self.percent), "a long, b long").distinct())

    def links(self, more: DataFrame) -> DataFrame:
        """(a, b): links that connect all similar sets; ``more`` (a, b) are further candidates, confirmed alike."""
        keyed = self.first.select("id", "prefix").mapInArrow(_keys, "k long, id long")
        # seven bits of a hash of shingle and set, before the id, put the sets in an order of the shingle's own
        order = F.shiftleft(F.xxhash64("k", "id").bitwiseAND(F.lit(127)), 56).bitwiseOR(F.col("id"))
        groups = keyed.groupBy("k").agg(F.min(order).alias("low"), F.max(order).alias("high")).where("low <> high")
        met = cut(keyed.join(groups.select("k", F.col("low").bitwiseAND(F.lit((1 << 56) - 1)).alias("centre")), "k"))
        settle(met.sparkSession)
        star = self.confirmed(met.select(F.col("centre").alias("a"), F.col("id").alias("b")).union(more))
        settle(met.sparkSession)
        found = components(star)
        rooted = met.select("k", "id").join(found, F.col("id") == F.col("node"), "left").select("k", "id", F.coalesce("root", "id").alias("root"))
        open_ = rooted.groupBy("k").agg(F.count("*").alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
        sized = rooted.join(open_.select("k", "size"), "k").withColumn("parts", F.ceil(F.col("size") / TILE_ROWS).cast("int"))
        sized = sized.join(self.one.select("id", "n", *_MAPS), "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        dealt = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("part"), "id", "root", "n", *_MAPS)
        buckets = max(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(met.count() / 200_000))
        dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("k", "i", "j"), F.lit(buckets)))
        rest = dealt.groupBy("bucket").applyInArrow(_meet(self.percent), "a long, b long")
        return star.union(self.confirmed(rest))
