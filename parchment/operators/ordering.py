"""Order-dependent operators as windows.

Every sequence has a position column, and every rank a total order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules

RANGE_ROWS = 100_000


def gaps(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "gap") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value).over(W.partitionBy(*keys).orderBy(*order)))


def mode_bucket(df: DataFrame, keys: list[str], value: str, out: str = "mode_gap") -> DataFrame:
    """Per key the most frequent value, bucketed to 0.5 (half-even); ties go to the smaller bucket."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, (F.bround(F.col(value) * 2) / 2 + 0.0).alias(out)).agg(F.count("*").alias("n"))
    best = F.max_by(out, F.struct("n", (-F.col(out)).alias("small")))
    return counted.groupBy(*keys).agg(best.alias(out)) if keys else counted.agg(best.alias(out))


def grouped(df: DataFrame, keys: list[str], order: list[str], starts: Column, out: str = "group") -> DataFrame:
    """Number groups from 0: a new one where ``starts`` holds (nulls do not start one)."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1
    return df.withColumn(out, F.sum(F.when(~first & F.coalesce(starts, F.lit(False)), 1).otherwise(0)).over(w))


def joined(df: DataFrame, keys: list[str], position: str, text: str, sep: str = " ") -> DataFrame:
    """The texts of each group in order of position, with the group's first position."""
    parts = F.array_sort(F.collect_list(F.struct(position, text)))
    return df.groupBy(*keys).agg(F.min(position).alias(position), F.array_join(F.transform(parts, lambda x: x[text]), sep).alias(text))


def paragraphs_by_gap(lines: DataFrame, keys: list[str], ratio: float = rules.PARAGRAPH_GAP) -> DataFrame:
    """Lines (keys, line_no, top, text) to paragraphs: a gap above ``ratio`` times the key's mode gap starts one."""
    spaced = gaps(lines, keys, ["line_no"], "top")
    modes = mode_bucket(spaced, keys, "gap")
    marked = spaced.join(modes, keys, "left") if keys else spaced.crossJoin(F.broadcast(modes))
    return joined(grouped(marked, keys, ["line_no"], F.col("gap") > F.col("mode_gap") * ratio), [*keys, "group"], "line_no", "text")


def rejoin(paragraphs: DataFrame, keys: list[str], position: str = "pos", text: str = "text", page_start: Column | None = None) -> DataFrame:
    """Join fragments torn by a page break: the one before ends no sentence and this one carries on."""
    before = F.lag(text).over(W.partitionBy(*keys).orderBy(position))
    opens = F.col(text).rlike(r"^\p{Ll}")
    if page_start is not None:
        opens = opens | (page_start & F.col(text).rlike(rules.DEFINED_TERM_OPENING) & ~F.col(text).rlike(rules.NUMBERED_OPENING))
    carries = (before != "") & ~before.rlike(r"[.;:!?]\s*\z") & opens
    return joined(grouped(paragraphs, keys, [position], ~F.coalesce(carries, F.lit(False))), [*keys, "group"], position, text)


def merge_bullets(paragraphs: DataFrame, keys: list[str], position: str = "pos", text: str = "text", bullet: str = rules.BULLET_LINE) -> DataFrame:
    """Bullet paragraphs append, trimmed, to the one before."""
    is_bullet = F.col(text).rlike(bullet)
    first = F.row_number().over(W.partitionBy(*keys).orderBy(position)) == 1
    marked = grouped(paragraphs, keys, [position], ~is_bullet).withColumn(text, F.when(is_bullet & ~first, F.trim(text)).otherwise(F.col(text)))
    return joined(marked, [*keys, "group"], position, text)


def title_block(paragraphs: DataFrame, keys: list[str], position: str = "pos", text: str = "text") -> DataFrame:
    """Marks ``is_title``: leading paragraphs, three at most, up to the first that ends like prose or is long."""
    w = W.partitionBy(*keys).orderBy(position)
    n = F.row_number().over(w)
    stops = F.col(text).rlike(r"[.;!?:]\s*\z") | (F.length(text) > rules.TITLE_CHARS) | (n > rules.TITLE_PARAGRAPHS)
    stopped = F.max(F.when(stops, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return paragraphs.withColumn("is_title", stopped == 0)


def numbered(clauses: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    order = F.row_number().over(W.partitionBy(*keys).orderBy(position)) - 1
    return clauses.withColumn("order_index", order).withColumn("clause_id", F.format_string("c%03d", F.col("order_index") + 1))


def dense_ids(df: DataFrame, key: str, position: str, out: str) -> DataFrame:
    """Number keys from 0 by first appearance (a numeric position), then by key; a null key is one of them.

    Keys are told by 128 bits and never moved themselves.  The order is two-level: ranks within ranges of the position,
    plus the number of keys in the ranges before, of which there is one row per ``RANGE_ROWS`` keys.
    """
    name = F.md5(F.col(key).cast("string")) if dict(df.dtypes)[key] in ("string", "binary") else F.col(key)
    named = df.withColumn("_name", F.coalesce(name.cast("string"), F.lit("")))
    firsts = named.groupBy("_name").agg(F.min(position).alias("_first"), F.min(F.substring(F.col(key).cast("string"), 1, 64)).alias("_key"))
    end = firsts.agg(F.min("_first").alias("low"), F.max("_first").alias("high"), F.count("*").alias("n")).first()
    low, width = end["low"] or 0, (end["high"] or 0) - (end["low"] or 0) + 1
    placed = firsts.withColumn("_range", F.coalesce(F.floor((F.col("_first") - F.lit(low)) * F.lit(max(1, math.ceil(end["n"] / RANGE_ROWS))) / F.lit(width)), F.lit(-1)))
    inside = placed.withColumn("_local", F.row_number().over(W.partitionBy("_range").orderBy("_first", "_key", "_name")) - 1)
    before = placed.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ids = inside.join(before.select("_range", "_before"), "_range").select("_name", (F.col("_local") + F.col("_before")).cast("int").alias(out))
    return named.join(ids, "_name").drop("_name")


def history(turns: DataFrame, key: str, position: str, limit: int = rules.HISTORY_TURNS, chars: int = rules.TURN_CHARS) -> DataFrame:
    """Server side: the last turns are cut first, then filtered to non-empty user and assistant ones."""
    last = turns.withColumn("back", F.row_number().over(W.partitionBy(key).orderBy(F.col(position).desc()))).where(F.col("back") <= limit)
    return last.where(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != "")).withColumn("text", F.substring("text", 1, chars)).drop("back")


def client_history(turns: DataFrame, key: str, position: str, limit: int = rules.HISTORY_TURNS) -> DataFrame:
    """Client side: filtered first, then cut."""
    spoken = turns.where(F.col("role").isin("user", "assistant"))
    return spoken.withColumn("back", F.row_number().over(W.partitionBy(key).orderBy(F.col(position).desc()))).where(F.col("back") <= limit).drop("back")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= limit)


def context_clauses(clauses: DataFrame, key: str, anchor: Column, similarity: Column, chars: int = rules.CONTEXT_CHARS, k: int = rules.CONTEXT_CLAUSES) -> DataFrame:
    """All of a short document; else the anchor and the most similar clauses, ``k`` in all."""
    total = F.sum(F.length("text")).over(W.partitionBy(key))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.when(anchor, 0).otherwise(1), similarity.desc(), "order_index"))
    return clauses.withColumns({"total_chars": total, "context_rank": rank}).where((F.col("total_chars") <= chars) | (F.col("context_rank") <= k))


def context_statutes(clauses: DataFrame, key: str, anchor: Column, similarity: Column, limit: int = rules.CONTEXT_STATUTES) -> DataFrame:
    """Statutes of the context clauses (``statutes``: ids in order), each once; beyond ``limit`` the anchored and most similar."""
    flat = clauses.select(key, "order_index", anchor.alias("anchored"), similarity.alias("similarity"), F.posexplode("statutes").alias("at", "entry_id"))
    first = flat.groupBy(key, "entry_id").agg(F.min(F.struct("order_index", "at")).alias("first"), F.max("anchored").alias("anchored"), F.max("similarity").alias("similarity"))
    n = F.count("*").over(W.partitionBy(key))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.when(F.col("anchored"), 0).otherwise(1), F.col("similarity").desc(), "first"))
    return first.withColumns({"n": n, "rank": rank}).where((F.col("n") <= limit) | (F.col("rank") <= limit)).drop("n")


def risk_rank(label: Column) -> Column:
    return F.when(label == "RED", 0).when(label == "YELLOW", 1).otherwise(2)


def signalled(hint: str) -> Column:
    """Does a hint say something: definitive, unsupported or ambiguous?"""
    h = F.col(hint)
    return h["jurisdiction"].isNotNull() | h["unsupported_hint"].isNotNull() | h["ambiguous"]


def first_signal(rows: DataFrame, key: str, order: str, hint: str) -> DataFrame:
    """Per key, the hint of the first row with a signal."""
    h, some = F.col(hint), signalled(hint)
    return rows.groupBy(key).agg(F.min_by(F.when(some, h), F.when(some, F.col(order))).alias(hint), F.min(F.when(some, F.col(order))).alias("at"))
