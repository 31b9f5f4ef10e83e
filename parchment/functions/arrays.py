"""Sequential work over an array column, inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def fold(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], emits: str, chunk: int = CHUNK) -> Column:
    """What ``step`` (state, item) -> (state, emission) emits for each item of an array, from the state ``zero`` on.

    An array that grows by one is copied each time, so items are folded in chunks: the work is in proportion to the
    items times ``chunk``, not to their square.  ``items`` should be a plain column, as it is read once a chunk.
    """

    def one(acc: Column, item: Column) -> Column:
        state, emission = step(acc["state"], item)
        return F.struct(state.alias("state"), F.array_append(acc["out"], emission).alias("out"))

    return _folded(items, zero, one, emits, chunk)


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column], Column], emits: str, chunk: int = CHUNK) -> Column:
    """As ``fold``, for a costly step: it gives the new state, is evaluated once, and ``emit`` reads what it emits from that."""

    # what a state emits is appended a step later: ``once`` would copy all that was emitted before with each result
    def one(acc: Column, item: Column) -> Column:
        return F.struct(step(acc["state"], item).alias("state"), F.array_append(acc["out"], emit(acc["state"])).alias("out"))

    def ended(chunks: Column) -> Column:
        out = F.array_append(_outs(chunks), emit(F.element_at(chunks, -1)["state"]))
        return F.slice(out, F.lit(2), F.size(out) - 1)

    return _folded(items, zero, one, emits, chunk, ended)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` reads it."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def part(items: Column, first: Column, n: Column) -> Column:
    """``n`` items from place ``first`` on, counted from 0 and at least one; ``slice`` would copy the whole array each time."""
    return F.transform(F.sequence(first, first + n - 1), lambda i: F.get(items, i))


def _outs(chunks: Column) -> Column:
    return F.flatten(F.transform(chunks, lambda x: x["out"]))


def _folded(items: Column, zero: Column, one: Callable[[Column, Column], Column], emits: str, chunk: int, ended: Callable[[Column], Column] = _outs) -> Column:
    nothing = F.array().cast(f"array<{emits}>")

    def many(acc: Column, part: Column) -> Column:
        return F.array_append(acc, F.aggregate(part, F.struct(F.element_at(acc, -1)["state"].alias("state"), nothing.alias("out")), one))

    n = F.size(items)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda i: part(items, i * chunk, F.least(n - i * chunk, F.lit(chunk))))
    chunks = F.when(n > 0, chunks).otherwise(F.slice(F.array(items), 1, 0))
    start = F.array(F.struct(zero.alias("state"), nothing.alias("out")))
    return F.aggregate(chunks, start, many, ended)


def starts_of(flags: Column) -> Column:
    """The positions, from 1, at which an array of flags is true."""
    return F.array_compact(F.transform(flags, lambda x, i: F.when(x, i + 1)))


def joined_runs(texts: Column, starts: Column, sep: str) -> Column:
    """The texts from each position of ``starts`` up to the next, joined; ``starts`` should be a plain column."""
    end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(texts) + 1)
    return F.transform(starts, lambda a, k: F.array_join(part(texts, a - 1, end(k) - a), sep))
