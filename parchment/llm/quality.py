"""Operator 3, quality rules with host-level verdicts.

Per document the base statistics decide ``base_failed``.  Rule failures are then
aggregated by host (here the documents' ``source``).  Each rule has a beta prior of
the hosts' failure rates, fitted by moments: mean m, and the variance between hosts
left when that of drawing documents is taken off.  A host's posterior under that
prior has a mean and a deviation; the host is rejected when, for any rule, its rate
exceeds both ``FACTOR`` times the corpus rate m and ``FLOOR`` at a certainty of 95 %
(the mean less CERTAIN deviations).  The verdict is relative, so a host is judged
against all others; the floor keeps hosts whose documents nearly all pass, whatever
the corpus rate.  Documents of a rejected host go even if they passed.

Scale: one map-only pass over texts gives small rows, which are checkpointed.
The aggregation by host combines on the map side, so a host with a third of all
rows is one row per map task; the prior needs one row in all.  Host verdicts are
joined back on the small rows, broadcast by Spark's own size estimate or else
sort-merged, where adaptive execution splits a hot host.

Defined cases: a null text has no words and fails; a null host is a host of its
own; a host's repeated rows all count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .runtime import cut, pack, read, unpack

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
FACTOR = 2.0
FLOOR = 0.2
CERTAIN = 1.645
MAX_STRENGTH = 1000.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[offsets])


def repeat_words(words: textnum.Words, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Per document, the words inside a window that occurs twice or more in that document."""
    n = len(words.start) - width + 1
    out = np.zeros(len(words.count), np.int64)
    if n <= 0:
        return out
    h = textnum.rolling(words.hashes(), width)
    at = np.flatnonzero(words.doc[:n] == words.doc[width - 1 :])
    key = textnum.mix(h[at] + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    again = at[order][same[1:] | same[:-1]]
    marks = np.zeros(len(words.start), bool)
    marks[again] = True
    return _per_doc(textnum.covered(marks, width, len(words.start)), words.first)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word, and those of them equal to an earlier one."""
    size = len(offsets) - 1
    if not len(data):
        return np.zeros(size, np.int64), np.zeros(size, np.int64)
    newline = np.zeros(256, bool)
    newline[0x0A] = True
    lines = textnum.Words(data, offsets, newline)
    solid = np.concatenate([[0], np.cumsum(~textnum.SPACE[data])])
    full = np.flatnonzero(solid[lines.end] > solid[lines.start])
    doc = lines.doc[full]
    h = textnum.mix(lines.hashes()[full] + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(h, return_index=True)
    n_lines = np.bincount(doc, minlength=size)
    return n_lines, n_lines - np.bincount(doc[first], minlength=size)


def statistics(text: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = textnum.buffer_of(text)
    words = textnum.Words(data, offsets)
    solid = ~textnum.SPACE[data]
    n_lines, n_dup = duplicate_lines(data, offsets)
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": _per_doc(solid & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_doc(_SYMBOL[data], offsets),
        "n_dup_lines": n_dup.astype(np.int64),
        "n_repeat_words": repeat_words(words),
        "n_lines": n_lines.astype(np.int64),
    }


_ADDED = (*STATS, "n_lines")


def _measure(batches):
    for batch in batches:
        for part in textnum.slices(batch, "text"):
            found = statistics(part.column("text"))
            keep = [c for c in part.schema.names if c not in _ADDED]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(found[c]) for c in _ADDED)], names=[*keep, *_ADDED])


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text`` and ``host``) with the base statistics and the rules' verdicts added."""
    docs = docs.drop(*_ADDED)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in _ADDED)])
    out = docs.mapInArrow(_measure, schema)
    out = out.withColumns({f"fails_{k}": F.expr(v) for k, v in RULES.items()})
    return out.withColumn("base_failed", F.col("fails_short") | F.col("fails_repeats"))


def host_verdicts(stats: DataFrame, factor: float = FACTOR, floor: float = FLOOR) -> DataFrame:
    """(host, n_docs, rate_<rule>, low_<rule>, host_rejected): posterior mean and lower bound of each rule's failure rate, and the verdict.

    ``stats`` has a row per document, or counts ``n`` of documents with equal verdicts.
    """
    names = [*RULES, "base"]
    failed = {**{k: F.col(f"fails_{k}") for k in RULES}, "base": F.col("base_failed")}
    weight = F.col("n") if "n" in stats.columns else F.lit(1)
    hosts = cut(stats.groupBy("host").agg(F.sum(weight).alias("n_docs"), *[F.sum(F.when(failed[k], weight).otherwise(0)).alias(f"n_{k}") for k in names]))
    totals = hosts.agg(F.avg(1 / F.col("n_docs")).alias("inverse"), *[F.avg(F.col(f"n_{k}") / F.col("n_docs")).alias(f"m_{k}") for k in names], *[F.var_pop(F.col(f"n_{k}") / F.col("n_docs")).alias(f"v_{k}") for k in names])
    row = totals.first()
    rates, lows, verdict = [], [], F.lit(False)
    for k in names:
        m = min(max(row[f"m_{k}"] or 0.0, 1e-6), 1 - 1e-6)
        between = (row[f"v_{k}"] or 0.0) - m * (1 - m) * (row["inverse"] or 0.0)
        strength = min(max(m * (1 - m) / between - 1, 1.0), MAX_STRENGTH) if between > 0 else MAX_STRENGTH
        rate = (F.col(f"n_{k}") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength))
        low = rate - F.lit(CERTAIN) * F.sqrt(rate * (1 - rate) / (F.col("n_docs") + F.lit(strength + 1)))
        rates.append(rate.alias(f"rate_{k}"))
        lows.append(low.alias(f"low_{k}"))
        verdict = verdict | (F.col(f"low_{k}") > F.lit(max(factor * m, floor)))
    return hosts.select("host", "n_docs", *rates, *lows).withColumn("host_rejected", verdict)


def judged(docs: DataFrame, host: str = "source", factor: float = FACTOR, floor: float = FLOOR) -> DataFrame:
    """One small row per document: doc_id, host, statistics, base_failed, host_rejected, kept."""
    stats = cut(measured(docs.select("doc_id", F.col(host).alias("host"), "text")).drop("text"))
    hosts = host_verdicts(stats, factor, floor).withColumnRenamed("host", "v_host")
    both = stats.join(hosts, F.col("host").eqNullSafe(F.col("v_host")), "left")
    return both.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))


def keep_good(docs: DataFrame, host: str = "source", factor: float = FACTOR, floor: float = FLOOR) -> DataFrame:
    """The rows of ``docs`` that pass their own rules and whose host is not rejected; texts are not shuffled.

    Rejected hosts are few by their nature; their number is checked before they are broadcast.
    """
    slim = docs.select("doc_id", F.col(host).alias("host"), "text")
    stats = cut(measured(slim).groupBy("host", *[f"fails_{k}" for k in RULES], "base_failed").agg(F.count("*").alias("n")))
    bad = cut(host_verdicts(stats, factor, floor).where("host_rejected").select(F.col("host").alias("v_host")))
    fresh = measured(pack(docs).withColumn("host", F.col(f"row.`{host}`")))
    on = F.col("host").eqNullSafe(F.col("v_host"))
    small = bad.count() <= 100_000
    return fresh.where(~F.col("base_failed")).join(F.broadcast(bad) if small else bad, on, "left_anti").transform(unpack, docs.columns)


def op3_host_quality(spark, sf_dir: str) -> DataFrame:
    out = judged(read(spark, sf_dir, "documents"))
    return out.select("doc_id", *STATS, "base_failed", "kept")


_NAMES = (*RULES, "base")
_PRIORS = "".join(
    f"""
, {k}_m AS (SELECT least(greatest(avg(n_{k} / n_docs), 1e-6), 1 - 1e-6) AS m, var_pop(n_{k} / n_docs) AS v, avg(1 / n_docs) AS inverse FROM hosts)
, {k}_p AS (SELECT m, CASE WHEN v - m * (1 - m) * inverse > 0 THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * inverse) - 1, 1.0), {MAX_STRENGTH}) ELSE {MAX_STRENGTH} END AS s FROM {k}_m)
, {k}_r AS (SELECT source, n_docs + s + 1 AS n, (n_{k} + m * s) / (n_docs + s) AS rate, greatest({FACTOR} * m, {FLOOR}) AS bad FROM hosts, {k}_p)
, {k}_v AS (SELECT source, rate - {CERTAIN} * sqrt(rate * (1 - rate) / n) > bad AS rejected FROM {k}_r)"""
    for k in _NAMES
)
OP3_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM again) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), stats AS (
  SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
), f AS (
  SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeats, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS dups FROM stats
), hosts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n_docs, count_if(short) AS n_short, count_if(repeats) AS n_repeats, count_if(symbols) AS n_symbols,
         count_if(dups) AS n_lines, count_if(short OR repeats) AS n_base
  FROM f GROUP BY source
)"""
    + _PRIORS
    + f"""
, verdicts AS (SELECT source, bool_or(rejected) AS rejected FROM ({" UNION ALL ".join(f"SELECT * FROM {k}_v" for k in _NAMES)}) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed, NOT (short OR repeats) AND NOT rejected AS kept
FROM f JOIN verdicts ON f.source IS NOT DISTINCT FROM verdicts.source
"""
)
