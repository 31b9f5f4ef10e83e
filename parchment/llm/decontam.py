"""Operator 9, benchmark decontamination with one Aho-Corasick automaton.

Texts and benchmark items are normalised alike (A-Z lower-cased, every ASCII
byte that is neither letter nor digit is a separator), so a window of item
words is one byte string.  All windows of all items go into one automaton and
each text is scanned once; hits are mapped back to words and to code point
offsets of the original text.

Scale: the pass over documents is map-only.  The automaton is shipped to the
executors, so the benchmark's size is checked: above ``shard_bytes`` the items
are dealt over several automata that scan in turn, each within the bound.

Defined cases: a null or wordless text has no hits; a null or wordless item has
no windows; items with equal ids count once; a null item id reads as ''.
Repeated document rows each get their own row.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .runtime import pack, project, read, unpack

WINDOW = 10
SHARD_BYTES = 16 << 20

_WORD_BYTES = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_LOWER = [b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)]
_TABLE = bytes(b if b in _WORD_BYTES else 0x20 for b in _LOWER)
_SEPARATOR = np.array([b == 0x20 for b in _TABLE])


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def item_windows(items: list[tuple[str, str]], window: int = WINDOW) -> dict[str, tuple[int, tuple[str, ...]]]:
    """Padded window -> (its number of words, ids of the items that have it)."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item_id, text in items:
        words = normal_words(text or "")
        if not words:
            continue
        for i in range(max(1, len(words) - window + 1)):
            part = words[i : i + window]
            key = (b" " + b" ".join(part) + b" ").decode("latin-1")
            found.setdefault(key, (len(part), set()))[1].add(item_id)
    return {k: (n, tuple(sorted(ids))) for k, (n, ids) in found.items()}


class Scanner:
    def __init__(self, windows: dict[str, tuple[int, tuple[str, ...]]]):
        self.automaton = ahocorasick.Automaton()
        for key, value in windows.items():
            self.automaton.add_word(key, (len(key), *value))
        if windows:
            self.automaton.make_automaton()
        self.empty = not windows

    def scan(self, text: str) -> tuple[int, np.ndarray | None, set[str]]:
        """Number of words, mask of the hit words (None if none is hit), ids of the items found."""
        words = normal_words(text)
        if self.empty or not words:
            return len(words), None, set()
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
        hits = list(self.automaton.iter(joined))
        if not hits:
            return len(words), None, set()
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        edge = np.zeros(len(words) + 1, np.int64)
        ids: set[str] = set()
        last = np.searchsorted(ends, np.array([e for e, _ in hits]))
        for at, (_, (_, n, owners)) in zip(last.tolist(), hits, strict=True):
            edge[at + 1] -= 1
            edge[at + 1 - n] += 1
            ids.update(owners)
        return len(words), np.cumsum(edge[:-1]) > 0, ids


def original_spans(text: str, mask: np.ndarray) -> list[tuple[int, int]]:
    """Code point spans, in the original text, of the maximal runs of hit words."""
    data = np.frombuffer(text.encode(), np.uint8)
    words = textnum.Words(data, np.array([0, len(data)]), _SEPARATOR)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return [(int(points[words.start[a]]), int(points[words.end[b - 1]])) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


_STATE = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.StringType()),
    T.StructField("hit_mask", T.BinaryType()),
]
_NAMES = [f.name for f in _STATE]
_ARROW = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.binary()]


def _scan_stage(windows):
    def run(batches):
        scanner = Scanner(windows.value)
        for batch in batches:
            names = batch.schema.names
            masks = batch.column("hit_mask").to_pylist() if "hit_mask" in names else [None] * batch.num_rows
            items = batch.column("item_ids").to_pylist() if "item_ids" in names else [None] * batch.num_rows
            rows = []
            for text, mask0, items0 in zip(batch.column("text"), masks, items, strict=True):
                text = text.as_py() or ""
                n, mask, ids = scanner.scan(text)
                if mask0:
                    old = np.unpackbits(np.frombuffer(mask0, np.uint8), count=n).astype(bool)
                    mask = old if mask is None else mask | old
                ids |= set(items0 or ())
                if mask is None:
                    rows.append((n, 0, [], "", None))
                else:
                    spans = ",".join(f"{a}:{b}" for a, b in original_spans(text, mask))
                    rows.append((n, int(mask.sum()), sorted(ids), spans, np.packbits(mask).tobytes()))
            keep = [c for c in names if c not in _NAMES]
            made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], t) for t in _ARROW]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, *_NAMES])

    return run


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Add n_words, n_hit, item_ids, hit_spans and hit_mask to ``docs``, which has a ``text`` column.

    ``items`` has ``item_id`` and ``text``.  All other columns of ``docs`` are kept.
    """
    spark = docs.sparkSession
    docs = docs.drop(*_NAMES)
    items = project(items, item_id="item_id", text="text").where(F.col("text").isNotNull())
    # a window repeats each of an item's words up to ``window`` times in the automaton
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(total * window / shard_bytes))
    schema = T.StructType([*docs.schema.fields, *_STATE])
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == shard)
        rows = part.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").toLocalIterator()
        windows = spark.sparkContext.broadcast(item_windows([(r["i"], r["text"]) for r in rows], window))
        docs = docs.mapInArrow(_scan_stage(windows), schema)
    return docs


def remove_hits(docs: DataFrame, items: DataFrame, max_share: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose share of hit words is at most ``max_share``."""
    found = scan(pack(docs), items)
    return unpack(found.where(F.col("n_hit") <= F.col("n_words") * F.lit(max_share)), docs.columns)


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = scan(project(read(spark, sf_dir, "documents"), doc_id="doc_id", text="text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p:p + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), dp AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0
), hit AS (
  SELECT dp.doc_id, dp.p, iw.k, iw.item_id
  FROM (SELECT DISTINCT k FROM iw) ks
  JOIN dp ON dp.p + ks.k - 1 <= len(dp.w)
  JOIN iw ON iw.k = ks.k AND iw.win = array_to_string(dp.w[dp.p:dp.p + ks.k - 1], ' ')
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
