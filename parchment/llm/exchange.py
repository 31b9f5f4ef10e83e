"""The exchange behind exact substring removal (operators 5 and 6).

Documents are dealt over ``parts`` by a hash of their id, a few MB of text each.
A part sends what other parts must know of it as sorted numpy arrays, one binary
per bucket, so a row of the exchange stands for thousands of hashes:

1. ``repeated``: every part sends the distinct anchor hashes of its documents.
   Anchors are window minimizers: each window to be judged contains at least one,
   and equal windows contain equal ones.  Hashes of two or more parts come back.
2. A window without a repeated anchor occurs in its own part only.  Of the others
   each part sends its distinct ones once, with the smallest doc_id that has them,
   and gets back those that another part has under a smaller doc_id.

A window copied into a third of all rows is so sent once by each part, whatever
the number of copies, and no task holds more than a bucket of distinct values.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .runtime import shuffle_partitions

NO_ID = (1 << 63) - 1
PART_BYTES = 4 << 20


def dealt(docs: DataFrame, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """(part, doc_id, text) and the number of parts; a null doc_id counts as larger than all others."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(total / part_bytes))
    slim = docs.select(
        F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.lit(parts)).cast("int").alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
    )
    return slim, parts


#: Anchors are compared by their upper 48 bits, which is what is sent of them.  A chance match only makes more windows candidates.
ANCHOR_MASK = np.uint64(0xFFFFFFFFFFFF0000)


def anchors_by_start(grams: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each ``window`` of gram hashes: the least, hashed again, as least values crowd at the low end and buckets are ranges."""
    return textnum.mix(textnum.sliding_min(grams & ANCHOR_MASK, window)) & ANCHOR_MASK


def pack(anchors: np.ndarray) -> bytes:
    return np.ascontiguousarray(anchors).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)


def anchors_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [unpack(x) for x in column.to_pylist()]


def n_buckets(docs: DataFrame, parts: int) -> int:
    return max(shuffle_partitions(docs.sparkSession), parts // 2, 1)


def split(keys: np.ndarray, buckets: int, *more: np.ndarray, anchors: bool = False):
    """Rows (bucket, keys, more...) as bytes of sorted ``keys`` (unsigned) dealt by their high bits; ``anchors`` are packed."""
    at = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        own = keys[edges[b] : edges[b + 1]]
        yield (b, pack(own) if anchors else own.tobytes(), *(x[edges[b] : edges[b + 1]].tobytes() for x in more))


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrays(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def first_of(key: np.ndarray) -> np.ndarray:
    """Of a sorted array, the mask of first occurrences."""
    out = np.ones(len(key), bool)
    out[1:] = key[1:] != key[:-1]
    return out


KEYS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("keys", pa.binary())])
KEYS_DDL = "bucket int, part int, keys binary"
BACK = pa.schema([("part", pa.int32()), ("keys", pa.binary())])
BACK_DDL = "part int, keys binary"


def _repeated(group: pa.Table) -> pa.Table:
    held = anchors_of(group.column("keys"))
    sizes = [len(x) for x in held]
    keys = np.concatenate(held)
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    sorted_keys = keys[order]
    same[1:-1] = sorted_keys[1:] == sorted_keys[:-1]
    again = np.zeros(len(keys), bool)
    again[order] = same[1:] | same[:-1]
    edges = np.cumsum([0, *sizes])
    rows = []
    for i, part in enumerate(group.column("part").to_pylist()):
        if len(x := held[i][again[edges[i] : edges[i + 1]]]):
            rows.append((part, pack(x)))
    return table(rows, BACK)


def repeated(sent: DataFrame) -> DataFrame:
    """(part, keys): of the distinct keys that each part has sent, those that another part sent too."""
    return sent.groupBy("bucket").applyInArrow(_repeated, BACK_DDL)


def in_sorted(values: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``within``."""
    if not len(within):
        return np.zeros(len(values), bool)
    at = np.searchsorted(within, values)
    at[at == len(within)] = 0
    return within[at] == values
