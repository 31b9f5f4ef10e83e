"""Operator 6, exact substring removal by interval expansion on a Burrows-Wheeler transform.

Strings of 50 bytes that start in an earlier document (smaller doc_id) are
removed from later ones.  Candidate strings meet in buckets, as fragments; each
bucket builds the suffix array and the Burrows-Wheeler transform of its
fragments and expands intervals backwards breadth-first, by increasing common
prefix length, stopping at 50.  The intervals at 50 are the classes of equal
strings; the owner of a class is the smallest doc_id in it.

A fragment is a run of consecutive candidate strings with the same anchor (the
minimizer of their 20-byte grams), so equal strings are in fragments with equal
anchors and meet in one bucket.  See ``exchange`` for scale and skew: strings
without an anchor repeated in another part stay in their part, equal fragments
of a part are sent once, and no task gathers the copies of a fragment.

Defined cases: a null text is empty; matches never cross documents; rows with
equal ids do not remove each other; a null id is larger than all others; texts
shorter than 50 bytes lose nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, textnum
from .runtime import read

LENGTH = 50
ANCHOR = 20
SEPARATOR = 0xFF  # in no UTF-8 text
#: Common prefixes below this are read from packed 8-byte keys; wider ones come from interval expansion.
PACKED = 8
CHUNK_BYTES = 1 << 19


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions ordered by their first ``depth`` bytes or more (prefix doubling), and the first 8-byte keys in that order.

    ``data`` ends with ``depth`` separators at least.
    """
    n = len(data)
    key = np.zeros(n, np.uint64)
    for j in range(PACKED):
        key <<= np.uint64(8)
        key[: n - j] |= data[j:].astype(np.uint64)
    order = np.argsort(key)
    packed = key[order]
    fresh = exchange.first_of(packed)
    # a suffix's rank is the first row of its group, so a split changes the ranks of the split group only
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    tied = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))
    have = PACKED
    while have < depth and len(tied):
        at = order[tied]
        both = (rank[at] << 32) | rank[np.minimum(at + have, n - 1)]
        again = np.argsort(both)
        both, at = both[again], at[again]
        order[tied] = at
        new = exchange.first_of(both)
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~new | ~np.append(new[1:], True)]
        have *= 2
    return order, packed


def interval_starts(data: np.ndarray, order: np.ndarray, packed: np.ndarray, length: int) -> np.ndarray:
    """Mask of the suffix-array rows whose common prefix with the row before is shorter than ``length``.

    Breadth-first by prefix length: an interval of suffixes that start with w is
    extended backwards by each byte c in its part of the transform, to the interval
    of cw.  Where cw's interval ends, the common prefix is |w| if no smaller one is
    known; only intervals that settle such a value are extended further.
    """
    n = len(order)
    settled = np.zeros(n + 1, bool)
    settled[[0, n]] = True
    # lengths below PACKED, from the packed keys: the intervals at PACKED are their runs
    runs = np.flatnonzero(exchange.first_of(packed))
    settled[runs] = True
    transform = data[order - 1]  # the byte before each suffix; data[-1] is a separator
    # last-to-first mapping: where the suffix one byte longer stands
    position = np.empty(n, np.int32)
    position[order] = np.arange(n, dtype=np.int32)
    longer = position[order - 1]
    low, high = runs, np.append(runs[1:], n)
    for _ in range(PACKED, length):
        if not len(low):
            break
        sizes = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        c = transform[rows]
        solid = c != SEPARATOR
        interval = np.repeat(np.arange(len(low), dtype=np.int64), sizes)[solid]
        rows = rows[solid]
        # rows of an interval with the same byte are consecutive after the mapping
        key = (interval << 8) | c[solid]
        by = np.argsort(key)
        key, to = key[by], longer[rows[by]].astype(np.int64)
        first = np.flatnonzero(exchange.first_of(key)) if len(key) else np.zeros(0, np.int64)
        # suffixes that tie to the sorted depth stand in any order, so the interval begins at the least row
        left = np.minimum.reduceat(to, first) if len(first) else first
        count = np.diff(np.append(first, len(key)))
        right = left + count
        new = ~settled[right]
        settled[right[new]] = True
        low, high = left[new], right[new]
    return settled[:n]


def classes(fragments: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class number of the string of ``length`` at each byte of the joined fragments (-1: none starts there), the fragment of each byte, and its offset in it."""
    pad = bytes([SEPARATOR])
    joined = pad.join(fragments) + pad * (length + 1)
    data = np.frombuffer(joined, np.uint8)
    order, packed = suffix_array(data, length)
    starts = interval_starts(data, order, packed, length)
    number = np.empty(len(data), np.int64)
    number[order] = np.cumsum(starts) - 1
    sizes = np.array([len(x) + 1 for x in fragments])
    first = np.concatenate([[0], np.cumsum(sizes)])
    fragment = np.repeat(np.arange(len(fragments)), sizes)
    offset = np.arange(first[-1]) - np.repeat(first[:-1], sizes)
    number = number[: first[-1]]
    number[offset > np.repeat(sizes - 1 - length, sizes)] = -1
    return number, fragment, offset


class _Bytes:
    """The strings of a part's documents, slice by slice."""

    def __init__(self, group, length: int):
        self.length = length
        self.slices = [s for b in group.combine_chunks().to_batches() for s in textnum.slices(b, "text")]

    def anchors(self):
        """Of each slice: rows, data, offsets, mask of whole strings by start, and the anchor hash of each start."""
        for s in self.slices:
            data, offsets = textnum.buffer_of(s.column("text"))
            n = max(0, len(data) - self.length + 1)
            grams = _grams(data)
            low = exchange.anchors_by_start(grams, self.length - ANCHOR + 1)
            doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
            whole = doc[:n] == doc[self.length - 1 : self.length - 1 + n]
            yield s, data, offsets, doc, whole, low


def _grams(data: np.ndarray) -> np.ndarray:
    n = len(data) - ANCHOR + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = textnum.powers(0, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return textnum.mix((total[ANCHOR:] - total[:n]) * down[:n])


def _send_anchors(length: int, buckets: int):
    def run(key, group):
        found = [np.zeros(0, np.uint64)]
        for _, _, _, _, whole, low in _Bytes(group, length).anchors():
            x = low[whole]
            found.append(np.unique(x[exchange.first_of(x)]))
        keys = np.unique(np.concatenate(found))
        return exchange.table([(b, key[0].as_py(), x) for b, x in exchange.split(keys, buckets, anchors=True)], exchange.KEYS)

    return run


def _runs(low: np.ndarray, take: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of maximal runs of taken starts with one anchor and document."""
    n = len(low)
    edge = np.ones(n + 1, bool)
    if n:
        edge[1:-1] = (low[1:] != low[:-1]) | (take[1:] != take[:-1]) | (doc[1:n] != doc[: n - 1])
    at = np.flatnonzero(edge)
    first, last = at[:-1], at[1:]
    keep = take[first] if n else np.zeros(0, bool)
    return first[keep], last[keep]


def _fragments(group, length: int, wanted: np.ndarray | None):
    """Of each slice: its rows, bytes, and the fragments' start, end, anchor and doc_id; ``wanted`` None takes all."""
    for s, data, _, doc, whole, low in _Bytes(group, length).anchors():
        take = whole
        if wanted is not None and len(low):
            edge = exchange.first_of(low)
            take = whole & exchange.in_sorted(low[edge], wanted)[np.cumsum(edge) - 1]
        first, last = _runs(low, take, doc)
        ids = s.column("doc_id").fill_null(exchange.NO_ID).to_numpy(zero_copy_only=False)
        yield s, data.tobytes(), first, last + length - 1, low[first], ids[doc[first]]


def _collected(held: dict[bytes, int], lows: list[int], raw: bytes, first, last, ids) -> np.ndarray:
    """Number the distinct contents, keep the smallest id of each, and return the fragments' numbers."""
    out = np.empty(len(first), np.int64)
    for j, (a, b, doc_id) in enumerate(zip(first.tolist(), last.tolist(), ids.tolist(), strict=True)):
        k = held.setdefault(raw[a:b], len(lows))
        if k == len(lows):
            lows.append(doc_id)
        elif doc_id < lows[k]:
            lows[k] = doc_id
        out[j] = k
    return out


def _owner_runs(contents: list[bytes], lows: list[int], anchors: np.ndarray, length: int):
    """Runs of consecutive strings of a content with one owner: content, start, number of strings, owner.

    Equal strings are in contents of equal anchors, so contents go by anchor in
    chunks of about ``CHUNK_BYTES``, each with a transform of its own.
    """
    order = np.argsort(anchors, kind="stable")
    sizes = np.cumsum([len(contents[k]) for k in order.tolist()])
    edges, begun = [0], 0
    for k in (np.flatnonzero(anchors[order][1:] != anchors[order][:-1]) + 1).tolist():
        if sizes[k - 1] - begun >= CHUNK_BYTES:
            edges.append(k)
            begun = sizes[k - 1]
    edges.append(len(order))
    low = np.array(lows, np.int64)
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        chunk = order[a:b]
        number, fragment, offset = classes([contents[k] for k in chunk.tolist()], length)
        whole = number >= 0
        fragment, offset, number = chunk[fragment[whole]], offset[whole], number[whole]
        owner = np.full(number.max() + 1, exchange.NO_ID, np.int64)
        np.minimum.at(owner, number, low[fragment])
        owned = owner[number]
        edge = np.ones(len(owned), bool)
        edge[1:] = (fragment[1:] != fragment[:-1]) | (owned[1:] != owned[:-1])
        first = np.flatnonzero(edge)
        out.append((fragment[first], offset[first], np.diff(np.append(first, len(owned))), owned[first]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    by = np.argsort(columns[0], kind="stable")
    return [x[by] for x in columns]


_SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("anchors", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])
_SENT_DDL = "bucket int, part int, anchors binary, ids binary, sizes binary, bytes binary"
_BACK = pa.schema([("part", pa.int32()), ("anchors", pa.binary()), ("keys", pa.binary()), ("starts", pa.binary()), ("lengths", pa.binary()), ("owners", pa.binary())])
_BACK_DDL = "part int, anchors binary, keys binary, starts binary, lengths binary, owners binary"


def _digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def _send_fragments(length: int, buckets: int):
    def run(key, group, back):
        wanted = np.sort(np.concatenate([np.zeros(0, np.uint64), *exchange.anchors_of(back.column("keys"))]))
        held: dict[bytes, int] = {}
        lows: list[int] = []
        anchor_of = [np.zeros(0, np.uint64)]
        numbers = [np.zeros(0, np.int64)]
        for _, raw, first, last, anchors, ids in _fragments(group, length, wanted):
            numbers.append(_collected(held, lows, raw, first, last, ids))
            anchor_of.append(anchors)
        part = key[0].as_py() if key[0].is_valid else None
        anchors = np.zeros(len(lows), np.uint64)
        anchors[np.concatenate(numbers)] = np.concatenate(anchor_of)
        contents, ids = list(held), np.array(lows, np.int64)
        order = np.argsort(anchors, kind="stable")
        rows = []
        for b, keys, place in exchange.split(anchors[order], buckets, order, anchors=True):
            place = np.frombuffer(place, np.int64)
            own = [contents[k] for k in place.tolist()]
            rows.append((b, part, keys, ids[place].tobytes(), np.array([len(x) for x in own], np.int32).tobytes(), pa.compress(b"".join(own), "zstd", asbytes=True)))
        return exchange.table(rows, _SENT)

    return run


def _own(length: int):
    def run(group):
        held: dict[bytes, int] = {}
        lows: list[int] = []
        received, anchor_of = [], [np.zeros(0, np.uint64)]
        for part, anchors, ids, sizes, blob in zip(group.column("part").to_pylist(), exchange.anchors_of(group.column("anchors")), *(exchange.arrays(group.column(c), k) for c, k in (("ids", np.int64), ("sizes", np.int32))), group.column("bytes").to_pylist(), strict=True):
            blob = pa.decompress(blob, int(sizes.sum()), "zstd", asbytes=True)
            last = np.cumsum(sizes, dtype=np.int64)
            received.append((part, anchors, ids, _collected(held, lows, blob, last - sizes, last, ids)))
            anchor_of.append(anchors)
        contents, own_anchors = list(held), np.zeros(len(lows), np.uint64)
        own_anchors[np.concatenate([x[3] for x in received])] = np.concatenate(anchor_of)
        fragment, start, count, owner = _owner_runs(contents, lows, own_anchors, length)
        begin = np.searchsorted(fragment, np.arange(len(contents) + 1))
        rows = []
        for part, anchors, ids, place in received:
            n = begin[place + 1] - begin[place]
            runs = np.repeat(begin[place] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            tell = owner[runs] < np.repeat(ids, n)
            runs, of = runs[tell], np.repeat(np.arange(len(place)), n)[tell]
            if len(runs):
                keys = b"".join(_digest(contents[k]) for k in place[of].tolist())
                rows.append((part, exchange.pack(anchors[of]), keys, *(x[runs].astype(t).tobytes() for x, t in ((start, np.int32), (count, np.int32), (owner, np.int64)))))
        return exchange.table(rows, _BACK)

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.string()), ("kept", pa.binary())])
_OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, spans string, kept binary"


def _remove(length: int, texts: bool):
    def run(key, group, back):
        told: dict[bytes, list[tuple[int, int, int]]] = {}
        for keys, *columns in zip(*(back.column(c).to_pylist() for c in ("keys", "starts", "lengths", "owners")), strict=True):
            xs = zip(*(np.frombuffer(x, t).tolist() for x, t in zip(columns, (np.int32, np.int32, np.int64), strict=True)), strict=True)
            for k, x in enumerate(xs):
                told.setdefault(keys[16 * k : 16 * k + 16], []).append(x)
        far = np.unique(np.concatenate([np.zeros(0, np.uint64), *exchange.anchors_of(back.column("anchors"))]))
        # strings within the part: the same classes over the part's own distinct fragments
        slices = list(_fragments(group, length, None))
        near = _repeated_here(slices)
        held: dict[bytes, int] = {}
        lows: list[int] = []
        place = []
        for _, raw, first, last, anchors, ids in slices:
            at = np.flatnonzero(exchange.in_sorted(anchors, near))
            mine = np.full(len(first), -1, np.int64)
            mine[at] = _collected(held, lows, raw, first[at], last[at], ids[at])
            place.append(mine)
        runs: list[list[tuple[int, int, int]]] = [[] for _ in lows]
        if lows:
            own_anchors = np.zeros(len(lows), np.uint64)
            for (_, _, _, _, anchors, _), mine in zip(slices, place, strict=True):
                own_anchors[mine[mine >= 0]] = anchors[mine >= 0]
            for f, *x in zip(*(x.tolist() for x in _owner_runs(list(held), lows, own_anchors, length)), strict=True):
                runs[f].append(x)
        rows = []
        for (s, raw, first, last, anchors, ids), mine in zip(slices, place, strict=True):
            edge = np.zeros(len(raw) + 1, np.int32)
            at = np.flatnonzero((mine >= 0) | exchange.in_sorted(anchors, far))
            for a, b, k, doc_id in zip(first[at].tolist(), last[at].tolist(), mine[at].tolist(), ids[at].tolist(), strict=True):
                here = runs[k] if k >= 0 else ()
                for o, n, w in (*here, *told.get(_digest(raw[a:b]), ())):
                    if w < doc_id:
                        edge[a + o] += 1
                        edge[a + o + n + length - 1] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            _, offsets = textnum.buffer_of(s.column("text"))
            for i, doc_id in enumerate(s.column("doc_id").to_pylist()):
                x, y = int(offsets[i]), int(offsets[i + 1])
                part, text = gone[x:y], raw[x:y]
                spans = ""
                n_spans = 0
                if part.any():
                    step = np.diff(np.concatenate([[0], part.astype(np.int8), [0]]))
                    pairs = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))
                    n_spans, spans = len(pairs), ",".join(f"{p}:{q}" for p, q in pairs)
                    text = np.frombuffer(text, np.uint8)[~part].tobytes()
                rows.append((doc_id, y - x, int(part.sum()), n_spans, spans, text if texts else hashlib.sha256(text).digest()))
        return exchange.table(rows, _OUT)

    return run


def _repeated_here(slices) -> np.ndarray:
    """Anchors in more than one document of the part, in order."""
    anchors = np.concatenate([np.zeros(0, np.uint64), *(x[4] for x in slices)])
    ids = np.concatenate([np.zeros(0, np.int64), *(x[5] for x in slices)])
    order = np.lexsort((ids, anchors))
    anchors, ids = anchors[order], ids[order]
    return np.unique(anchors[1:][(anchors[1:] == anchors[:-1]) & (ids[1:] != ids[:-1])])


def dedup(docs: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, byte spans removed, and the kept bytes (or their SHA-256)."""
    parted, parts = exchange.dealt(docs)
    buckets = 2 * exchange.n_buckets(docs, parts)
    anchors = parted.groupBy("part").applyInArrow(_send_anchors(length, buckets), exchange.KEYS_DDL)
    repeated = exchange.repeated(anchors)
    sent = parted.groupBy("part").cogroup(repeated.groupBy("part")).applyInArrow(_send_fragments(length, buckets), _SENT_DDL)
    owned = sent.groupBy("bucket").applyInArrow(_own(length), _BACK_DDL)
    return parted.groupBy("part").cogroup(owned.groupBy("part")).applyInArrow(_remove(length, texts), _OUT_DDL)


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"), "spans")


# Bytes are pairs of hexadecimal digits.  Texts are first cut into overlapping chunks, so that no window is sought in a whole text.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), chunk AS (
  SELECT doc_id, n, c, substring(h, 2000 * c + 1, 2098) AS s FROM (SELECT doc_id, h, n, unnest(range(0, n // 1000 + 1)) AS c FROM d)
), win AS (
  SELECT doc_id, 1000 * c + i AS a, substring(s, 2 * i + 1, 100) AS w FROM (SELECT doc_id, c, s, unnest(range(0, least(1000, n - 49 - 1000 * c))) AS i FROM chunk WHERE n - 49 > 1000 * c)
), first_in AS (
  SELECT w, min(doc_id) AS low FROM win GROUP BY w HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT doc_id, a, a > coalesce(lag(a) OVER (PARTITION BY doc_id ORDER BY a), -100) + 50 AS fresh FROM win JOIN first_in USING (w) WHERE low < doc_id
), span AS (
  SELECT doc_id, min(a) AS a, max(a) + 50 AS z FROM (SELECT doc_id, a, count_if(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS g FROM gone) GROUP BY doc_id, g
), kept AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span
), cut AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head,
         string_agg(a || ':' || z, ',' ORDER BY a) AS spans
  FROM kept JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head || substring(h, 2 * last + 1), h))) AS kept_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN cut USING (doc_id)
"""
