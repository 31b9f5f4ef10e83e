"""Operator 4, mixing sources to target weights by a low-discrepancy schedule.

Sources get targets by weight, none above ``max_epochs`` times its own size; the
excess is reshared by weight among the others (water filling).  Each source's
documents are laid out in hashed order as one run of tokens, cut into blocks of
``block_tokens``.  Slots are the points of the golden-ratio sequence, mapped
through the cumulative target shares to a source; the r-th slot of a source takes
its r-th block, wrapping around at the end of the source (a new epoch) and taking
only the missing part when the target is reached.  So every prefix of the
schedule holds the sources in the target proportions.

Everything is DataFrame expressions.  Scale: nothing orders a whole source in one
task.  Ranks (of documents' tokens, and of slots) are two-level: a window within
chunks plus the running total of the chunks before; there are as many chunks as a
chunk has rows, the square root of their number, so neither window grows faster.
A source with a third of all rows is so dealt over all chunks.

Defined cases: null text has size 0 and is never taken; the null source comes last;
a source without words has target 0; rows with equal ids are summed per row and
reported per row; no documents give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import cut, pack, read

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BLOCK_TOKENS = 512
#: The golden ratio's fraction in 64 bits: multiples modulo 2**64 are exact however many slots there are.
GOLDEN = 0x9E3779B97F4A7C15

def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, low, high): targets by water filling, and each source's part of [0, 1).

    One row per source goes through the global windows, never documents.  With the level L,
    target = min(max_epochs * size, L * weight) and all targets sum to all sizes: ordered by
    size / weight, the capped sources are a prefix.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    weighed = sources.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    # the level that holds if just the sources before this one are capped; the first source that it does not cap fixes it
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = weighed.withColumn("level", level).withColumn("position", F.row_number().over(by_ratio))
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("position", "level"))
    leveled = leveled.withColumn("level", F.min(free).over(everything)["level"])
    out = leveled.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    running = F.sum("target").over(by_name.rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("high", F.coalesce(F.try_divide(running, F.sum("target").over(everything)), F.lit(0.0)))
    return out.withColumn("low", F.coalesce(F.lag("high").over(by_name), F.lit(0.0))).select("source", "source_size", "target", "low", "high")


def _with_offsets(rows: DataFrame, keys: list[str], chunk: str, order: list, size: str, out: str) -> DataFrame:
    """Running total of ``size`` before each row within ``keys``, by chunk and then ``order``; two-level."""
    chunks = rows.groupBy(*keys, chunk).agg(F.sum(size).alias("chunk_total"))
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("chunk_before", F.coalesce(F.sum("chunk_total").over(before), F.lit(0))).drop("chunk_total")
    inside = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("local_before", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return local.join(chunks, [*keys, chunk]).withColumn(out, F.col("chunk_before") + F.col("local_before")).drop("chunk_before", "local_before")


def _wrapped_multiple(column: str, factor: int):
    """``column * factor`` modulo 2**64 as a long, in 32-bit halves that do not overflow; the column is under 2**62."""
    low, high = factor & 0xFFFFFFFF, factor >> 32
    x0, x1 = F.col(column).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(column, 32)
    # the low product is under 2**64: its own halves are added one by one
    a = x0.bitwiseAND(F.lit(0xFFFF)) * low
    b = F.shiftright(x0, 16) * low
    carried = b + F.shiftright(a, 16)
    low32 = F.shiftleft(carried.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(a.bitwiseAND(F.lit(0xFFFF)))
    cross = lambda x, y: ((F.shiftright(x, 16) * y).bitwiseAND(F.lit(0xFFFF)) * (1 << 16) + x.bitwiseAND(F.lit(0xFFFF)) * y).bitwiseAND(F.lit(0xFFFFFFFF))
    high32 = (F.shiftright(carried, 16) + cross(x0, F.lit(high)) + cross(x1, F.lit(low))).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(high32, 32).bitwiseOR(low32)


def schedule(goals: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(sid, rank): the slots of each source, ranked from 0 in the order of the golden-ratio sequence.

    ``goals`` has sid, source_size, goal, low, high and needed (its number of slots).  A source that
    the sequence leaves short, by a few slots, gets them at the end; slots beyond its need are left out.
    """
    spark = goals.sparkSession
    row = goals.agg(F.sum("goal").alias("total"), F.count("*").alias("n")).first()
    points = int((row["total"] or 0) / block_tokens) + 1
    cells = 4 * row["n"] + 1
    # the upper 53 bits of the product modulo 2**64, which a double holds exactly
    slots = spark.range(points).select(F.col("id").alias("slot"), (F.shiftrightunsigned(_wrapped_multiple("id", GOLDEN), 11) / F.lit(float(1 << 53))).alias("u"))
    chunk_rows = max(1, math.isqrt(points))
    slots = slots.withColumn("cell", F.floor(F.col("u") * cells))
    bounds = goals.where("high > low").select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))).alias("cell"))
    dealt = slots.join(bounds, "cell").where("u >= low AND u < high")
    dealt = dealt.select("sid", "slot", F.floor(F.col("slot") / chunk_rows).alias("chunk"), F.lit(1).alias("one"))
    ranked = _with_offsets(dealt, ["sid"], "chunk", ["slot"], "one", "rank").select("sid", "rank")
    got = dealt.groupBy("sid").agg(F.count("*").alias("got"))
    short = goals.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < needed")
    tail = short.select("sid", F.explode(F.sequence(F.col("got"), F.col("needed") - 1)).alias("rank"))
    return ranked.unionByName(tail)


def sized(docs: DataFrame) -> DataFrame:
    """(key, number, doc_id, source, size) of ``docs`` (doc_id, source, text), checkpointed without texts.

    Rows that are alike in all three have one key and are numbered from 1.
    """
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), content_key().alias("key"))
    alike = slim.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("n"))
    return cut(alike.select("key", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("number"), "doc_id", "source", "size"))


def _content(doc_id, source, text):
    return F.struct(doc_id.alias("doc_id"), source.alias("source"), F.xxhash64(text).alias("h"), F.length(text).alias("n"))


def content_key():
    return F.unhex(F.md5(F.to_json(_content(F.col("doc_id"), F.col("source"), F.col("text")))))


def mix(rows: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """``rows`` as from ``sized`` with source_size, target and taken (words the mix takes, repeats counted)."""
    block = F.lit(block_tokens)
    rows = rows.withColumn("sid", F.xxhash64("source", F.isnull("source")))
    goals = targets(rows, weights, max_epochs).withColumn("sid", F.xxhash64("source", F.isnull("source"))).withColumn("goal", F.round("target").cast("long"))
    n_blocks = F.ceil(F.col("source_size") / block)
    epochs = F.coalesce(F.try_divide("goal", "source_size").cast("long"), F.lit(0))
    goals = cut(goals.withColumn("needed", epochs * n_blocks + F.ceil((F.col("goal") - epochs * F.col("source_size")) / block)))

    chunks = max(1, math.isqrt(rows.count()))
    dealt = rows.where("size > 0").withColumn("order", F.xxhash64("key", "number", F.lit(seed)))
    dealt = dealt.withColumn("chunk", F.pmod("order", F.lit(chunks)))
    laid = _with_offsets(dealt, ["sid"], "chunk", ["order", "key", "number"], "size", "first")
    blocks = F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))
    pieces = laid.select("key", "number", "sid", "first", "size", F.explode(blocks).alias("block"))
    start = F.col("block") * block
    pieces = pieces.select("key", "number", "sid", "block", (F.greatest("first", start) - start).alias("a"), (F.least(F.col("first") + F.col("size"), start + block) - start).alias("z"))

    # a slot takes its whole block, or the part that is missing when the target is reached
    slots = schedule(goals, block_tokens).join(goals.select("sid", "source_size", "goal"), "sid")
    at = F.pmod(F.col("rank"), n_blocks)
    begun = F.floor(F.col("rank") / n_blocks) * F.col("source_size") + at * block
    length = F.least(block, F.col("source_size") - at * block, F.col("goal") - begun)
    takes = slots.select("sid", at.alias("block"), length.alias("length")).where("length > 0").groupBy("sid", "block", "length").agg(F.count("*").alias("times"))
    overlap = F.greatest(F.lit(0), F.least("z", "length") - F.col("a"))
    taken = pieces.join(takes, ["sid", "block"]).groupBy("key", "number").agg(F.sum(overlap * F.col("times")).alias("taken"))
    out = rows.join(taken, ["key", "number"], "left").join(goals.select("sid", "source_size", "target"), "sid")
    return out.select("key", "number", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, with size, source_size, target and taken added."""
    plan = mix(sized(docs)).where("taken > 0").select("key", "number", *[F.col(c).alias(f"m_{c}") for c in ("size", "source_size", "target", "taken")])
    key = F.unhex(F.md5(F.to_json(_content(F.col("row.doc_id"), F.col("row.source"), F.col("text")))))
    # rows alike in id, source and text are numbered by all their other columns
    ties = W.partitionBy("key").orderBy(F.to_json("row", {"ignoreNullFields": "false"}))
    packed = pack(docs).withColumn("key", key).withColumn("number", F.row_number().over(ties))
    both = packed.join(plan, ["key", "number"])
    added = {"size": "m_size", "source_size": "m_source_size", "target": "m_target", "taken": "m_taken"}
    kept = [c for c in docs.columns if c not in added]
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in kept]
    return both.select(*columns, *[F.col(v).alias(k) for k, v in added.items()])


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(sized(read(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "source")
