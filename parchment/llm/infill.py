"""Operator 13, fill-in-the-middle transformation with a sparse checkpoint index.

A text is cut at two unit boundaries drawn from a hash of its id, and its parts are
put in one of two orders between sentinels.  Units are counted in one pass over the
UTF-8 bytes, window by window; while counting, every ``EVERY`` units the byte offset
and the code-point offset of the unit are recorded.  A cut is then found by binary
search among these checkpoints and a short scan from the one before it, so neither
the list of all units nor a decoded copy of the text is ever made: a text of a
hundred megabytes has an index of a few kilobytes to a megabyte.

Scale: one map over the rows, no exchange; a task holds a slice of a batch, its
output and one index.

Defined cases: a null or empty text is plain and stays as it is (null becomes empty);
a text that holds a sentinel is plain, so that every output can be taken apart again;
a null id draws from the seed alone; repeated rows each get a row; the columns of the
input come back in the struct ``row``, so that none clashes with those added.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .runtime import pack, read

EVERY = 64
WINDOW = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _line_starts(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Offsets in [low, high) at which a line begins."""
    before = data[max(low - 1, 0) : high - 1]
    at = np.flatnonzero(before == 0x0A) + max(low, 1)
    return np.concatenate([[0], at]) if low == 0 and high > 0 else at


def _character_starts(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Offsets in [low, high) at which a code point begins."""
    return np.flatnonzero((data[low:high] & 0xC0) != 0x80) + low


UNITS = {"line": _line_starts, "character": _character_starts}


class Checkpoints:
    """Unit ``every * i`` of ``data`` (UTF-8 bytes) begins at byte ``at_byte[i]`` and code point ``at_point[i]``; ``n`` units in all."""

    def __init__(self, data: np.ndarray, unit: str = "line", every: int = EVERY, window: int = WINDOW):
        self.data, self.starts, self.every, self.window = data, UNITS[unit], every, window
        self.n = self.points = 0
        at_byte, at_point = [], []
        for low in range(0, len(data), window):
            high = min(low + window, len(data))
            begins = self.starts(data, low, high)
            kept = begins[-self.n % every :: every]
            points = np.cumsum((data[low:high] & 0xC0) != 0x80)
            at_byte.append(kept)
            at_point.append(self.points + points[kept - low] - 1)
            self.n += len(begins)
            self.points += int(points[-1])
        self.at_byte = np.concatenate([np.zeros(0, np.int64), *at_byte])
        self.at_point = np.concatenate([np.zeros(0, np.int64), *at_point])
        self.at_unit = np.arange(len(self.at_byte)) * every

    def find(self, unit: int) -> tuple[int, int]:
        """The byte and code-point offset at which ``unit`` begins; those of the end for the number of units."""
        if unit >= self.n:
            return len(self.data), self.points
        i = int(np.searchsorted(self.at_unit, unit, side="right")) - 1
        left, low, begin = unit - i * self.every, int(self.at_byte[i]), int(self.at_byte[i])
        while left:
            high = min(low + self.window, len(self.data))
            begins = self.starts(self.data, low, high)
            begins = begins[begins > begin]
            if len(begins) >= left:
                end = int(begins[left - 1])
                break
            left, low = left - len(begins), high
        else:
            end = begin
        points = sum(int(np.count_nonzero((self.data[a : min(a + self.window, end)] & 0xC0) != 0x80)) for a in range(begin, end, self.window))
        return end, int(self.at_point[i]) + points


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def infill_one(data: np.ndarray, doc_id: int | None, seed: int, rate: int, spm: int, unit: str) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix and of the middle, output) of one text."""
    index, whole = Checkpoints(data, unit), data.tobytes()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not whole or any(s.encode() in whole for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return index.n, "plain", None, None, whole
    (a, p), (b, q) = (index.find(u) for u in sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
    prefix, middle, suffix = whole[:a], whole[a:b], whole[b:]
    ps, ss, ms = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < spm:
        return index.n, "spm", p, q - p, b"".join((ss, suffix, ps, prefix, ms, middle))
    return index.n, "psm", p, q - p, b"".join((ps, prefix, ss, suffix, ms, middle))


def _infill(seed: int, rate: int, spm: int, unit: str):
    names = ["row", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches):
        for batch in batches:
            for part in textnum.slices(batch, "text"):
                data, offsets = textnum.buffer_of(part.column("text"))
                ids = part.column("id").to_pylist()
                made = [infill_one(data[offsets[i] : offsets[i + 1]], x, seed, rate, spm, unit) for i, x in enumerate(ids)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("row"), *columns, pa.array([m[4] for m in made], pa.binary()).cast(pa.string())], names=names)

    return run


def infill(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output) of each row of ``docs``.

    ``rate`` of 100 texts are transformed, ``spm`` of 100 of these suffix first; ``unit`` is ``line`` or ``character``.
    ``row`` holds all columns of the input but the text.
    """
    packed = pack(docs, text).withColumn("id", F.col(f"row.`{key}`").cast("long"))
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(_infill(seed, rate, spm, unit), f"row {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from which ``infill`` made ``output``."""
    first = lambda c, at: F.split(c, at, 2)
    body = F.substring(output, len(PREFIX) + 1, 2147483647)
    psm, spm = first(body, SUFFIX), first(body, PREFIX)
    p, s = first(psm[1], MIDDLE), first(spm[1], MIDDLE)
    return F.when(form == "psm", F.concat(psm[0], p[1], p[0])).when(form == "spm", F.concat(s[0], s[1], spm[0])).otherwise(output)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = infill(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        F.col("row.doc_id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: DuckDB: lines by one regular expression, cuts by list slices.
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), c AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a,
         CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) % 100 AS r,
         CAST('0x' || h[25:32] AS BIGINT) % 100 AS f
  FROM d
), p AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r >= 100 THEN 'plain'
              WHEN f < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(u[greatest(a, b) + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
