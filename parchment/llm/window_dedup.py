"""Operator 5, removal of repeated token windows by Rabin-Karp hashes.

Every window of 13 words gets a rolling hash.  Occurrences are counted over the
corpus; the first owner of a window is the smallest doc_id that has it, and the
windows of later documents merge into maximal removal intervals.  Windows are
identified by 128 bits (two hashes of different bases).

Scale and skew: see ``exchange``.  Only windows that hold a repeated anchor (a
6-word minimizer) leave their part, each distinct one once.  Texts are shuffled
once by id and reused; no task gathers the copies of a window.

Defined cases: a null text has no words; rows with equal ids do not remove each
other; a null id is larger than all others; a document of fewer words than a
window loses nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, textnum
from .runtime import read

WINDOW = 13
ANCHOR = 6


class _Part:
    """The windows of a part's documents, slice by slice."""

    def __init__(self, group: pa.Table, width: int):
        group = group.combine_chunks()
        self.width = width
        self.slices = [s for b in group.to_batches() for s in textnum.slices(b, "text")]

    def words(self):
        for s in self.slices:
            data, offsets = textnum.buffer_of(s.column("text"))
            yield s, textnum.Words(data, offsets)

    def anchors(self, words: textnum.Words):
        """Per start of a window: whether it is whole, and the hashes and mask of the anchors."""
        h = words.hashes()
        n = max(0, len(h) - self.width + 1)
        whole = words.doc[:n] == words.doc[self.width - 1 : self.width - 1 + n]
        grams = textnum.rolling(h, ANCHOR)
        low = exchange.anchors_by_start(grams, self.width - ANCHOR + 1)
        return h, whole, low

    def windows(self):
        """(doc_id, words, whole, low, hash, second hash) of each slice."""
        for s, words in self.words():
            h, whole, low = self.anchors(words)
            ids = s.column("doc_id").fill_null(exchange.NO_ID).to_numpy(zero_copy_only=False)
            yield ids, s, words, whole, low, textnum.rolling(h, self.width), textnum.rolling(words.hashes(1), self.width, 1)


def _send_anchors(width: int, buckets: int):
    def run(key, group):
        part = _Part(group, width)
        found = [np.zeros(0, np.uint64)]
        for _, words in part.words():
            _, whole, low = part.anchors(words)
            found.append(np.unique(low[whole]))
        keys = np.unique(np.concatenate(found))
        return exchange.table([(b, key[0].as_py(), x) for b, x in exchange.split(keys, buckets, anchors=True)], exchange.KEYS)

    return run


_OWNED = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("ids", pa.binary())])
_OWNED_DDL = "bucket int, part int, keys binary, checks binary, ids binary"
_BACK = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("ids", pa.binary())])
_BACK_DDL = "part int, keys binary, checks binary, ids binary"


def _smallest(keys, checks, ids):
    """The distinct (key, check) in order, each with its smallest id."""
    order = np.lexsort((ids, checks, keys))
    keys, checks, ids = keys[order], checks[order], ids[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    return keys[first], checks[first], ids[first]


def _joined(held: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(held) if held else np.zeros(0, kind)


def _all_back(back: pa.Table):
    kinds = {"keys": np.uint64, "checks": np.uint64, "ids": np.int64}
    return {c: _joined(exchange.arrays(back.column(c), kinds[c]), kinds[c]) for c in back.column_names if c in kinds}


def _send_windows(width: int, buckets: int):
    def run(key, group, back):
        wanted = np.sort(_joined(exchange.anchors_of(back.column("keys")), np.uint64))
        held: list[list[np.ndarray]] = [[], [], []]
        for ids, _, words, whole, low, first, second in _Part(group, width).windows():
            at = np.flatnonzero(whole)
            at = at[exchange.in_sorted(low[at], wanted)]
            for to, x in zip(held, _smallest(first[at], second[at], ids[words.doc[at]]), strict=True):
                to.append(x)
        keys, checks, ids = _smallest(_joined(held[0], np.uint64), _joined(held[1], np.uint64), _joined(held[2], np.int64))
        part = key[0].as_py() if key[0].is_valid else None
        return exchange.table([(b, part, k, c, i) for b, k, c, i in exchange.split(keys, buckets, checks, ids)], _OWNED)

    return run


def _owners(group: pa.Table) -> pa.Table:
    """To each part, its windows that another part has under a smaller id, with that id."""
    held = {c: exchange.arrays(group.column(c), k) for c, k in (("keys", np.uint64), ("checks", np.uint64), ("ids", np.int64))}
    source = np.repeat(np.arange(len(held["keys"])), [len(x) for x in held["keys"]])
    keys, checks, ids = (np.concatenate(held[c]) for c in ("keys", "checks", "ids"))
    order = np.lexsort((ids, checks, keys))
    keys, checks, ids, source = keys[order], checks[order], ids[order], source[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    owner = ids[first][np.cumsum(first) - 1]
    later = np.flatnonzero(owner < ids)
    later = later[np.argsort(source[later], kind="stable")]
    edges = np.searchsorted(source[later], np.arange(len(held["keys"]) + 1))
    rows = []
    for i, part in enumerate(group.column("part").to_pylist()):
        if len(x := later[edges[i] : edges[i + 1]]):
            rows.append((part, keys[x].tobytes(), checks[x].tobytes(), owner[x].tobytes()))
    return exchange.table(rows, _BACK)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("intervals", pa.string()), ("kept", pa.string())])
_OUT_DDL = "doc_id long, n_words long, n_removed long, intervals string, kept string"


def _remove(width: int, texts: bool):
    def run(key, group, back):
        more = _all_back(back)
        slices = list(_Part(group, width).windows())
        held: list[list[np.ndarray]] = [[more["keys"]], [more["checks"]], [more["ids"]]]
        for ids, _, words, whole, _, first, second in slices:
            at = np.flatnonzero(whole)
            for to, x in zip(held, _smallest(first[at], second[at], ids[words.doc[at]]), strict=True):
                to.append(x)
        keys, checks, owner = _smallest(*(np.concatenate(x) for x in held))
        clash = bool((keys[1:] == keys[:-1]).any())
        rows = []
        for ids, s, words, whole, _, first, second in slices:
            at = np.flatnonzero(whole)
            place = np.searchsorted(keys, first[at])
            if clash:
                while (wrong := checks[place] != second[at]).any():
                    place[wrong] += 1
            gone = np.zeros(len(words.start), bool)
            gone[at[owner[place] < ids[words.doc[at]]]] = True
            removed = textnum.covered(gone, width, len(words.start))
            rows += _rows(s, words, removed, texts)
        return exchange.table(rows, _OUT)

    return run


def _rows(s: pa.RecordBatch, words: textnum.Words, removed: np.ndarray, texts: bool):
    counts = np.diff(np.concatenate([[0], np.cumsum(removed)])[words.first]).tolist()
    data = words.data.tobytes()
    for i, doc_id in enumerate(s.column("doc_id").to_pylist()):
        a, b = words.first[i], words.first[i + 1]
        all_words = data[words.offsets[i] : words.offsets[i + 1]].split()
        intervals = ""
        if counts[i]:
            edge = np.diff(np.concatenate([[0], removed[a:b].astype(np.int8), [0]]))
            intervals = ",".join(f"{x}:{y}" for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
            all_words = [w for w, gone in zip(all_words, removed[a:b].tolist(), strict=True) if not gone]
        kept = b" ".join(all_words)
        yield doc_id, int(b - a), counts[i], intervals, kept.decode() if texts else hashlib.sha256(kept).hexdigest()


def dedup(docs: DataFrame, width: int = WINDOW, texts: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, word intervals removed, and the kept text (or its SHA-256)."""
    parted, parts = exchange.dealt(docs)
    buckets = exchange.n_buckets(docs, parts)
    anchors = parted.groupBy("part").applyInArrow(_send_anchors(width, buckets), exchange.KEYS_DDL)
    repeated = exchange.repeated(anchors)
    windows = parted.groupBy("part").cogroup(repeated.groupBy("part")).applyInArrow(_send_windows(width, buckets), _OWNED_DDL)
    owners = windows.groupBy("bucket").applyInArrow(_owners, _BACK_DDL)
    return parted.groupBy("part").cogroup(owners.groupBy("part")).applyInArrow(_remove(width, texts), _OUT_DDL)


def op5_token_window_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p
), own AS (
  SELECT s, min(doc_id) AS first FROM win GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN own USING (s) WHERE first < doc_id
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(count(g.i) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(words.word, ' ' ORDER BY words.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = words.doc_id AND g.i = words.i
GROUP BY d.doc_id, len(d.w)
"""
