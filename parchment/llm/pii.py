"""Operator 7, information-theoretic sanitisation of personal data.

Patterns find the protected entities (e-mail, ip, card, phone).  Corpus-wide
co-occurrence then estimates how strongly the terms of its documents reveal it:

    disclosure(t, e) = PMI(t, e) / IC(e) = 1 + log P(e | t) / -log P(e)
    P(e) = n_e / N,  P(e | t) = (n_et + SMOOTH * P(e)) / (n_t + SMOOTH)

with counts of documents; term and entity occur together if one document holds
both, at whatever distance.  The smoothing draws terms that are seen little
towards P(e).  A pair is evidence only if SUPPORT documents of distinct ids hold
it, so a document and its repeated rows are none.  In documents that hold the
entity, every occurrence of a term that reaches THRESHOLD becomes a span of kind
``term``.

Generalisation ladder: a term (``Zebulon``) has a class, that of all terms with
its last CLASS_LETTERS letters (``[*on]``).  In the text a disclosing term becomes
its class if the class itself, scored alike, is under the threshold, and is
removed otherwise.

Scale: one map-only pass finds the entities and is checkpointed without texts.
Pairs are counted for entities of enough documents only, over all terms of their
documents; they and the document frequencies of all terms are pre-aggregated per
partition.  A last map-only pass marks the occurrences by the disclosing pairs, a
broadcast of up to BROADCAST_TERMS of them; more are joined to the pairs of each
document, which Spark splits where one pair is in many documents.
Texts are never shuffled for the report.  Work within a document grows with its
entities of enough documents times its distinct terms.

Defined cases: a null text is empty and has no spans; failing matches are dropped
and not retried; rows with equal id and text get equal spans; a null id is kept.
Terms are runs of three or more letters or code points above 127, A-Z lower-cased,
outside all base spans; the frequency of a term counts it inside them too.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .runtime import cut, pack, project, read, unpack

SUPPORT = 2
SMOOTH = 1.0
THRESHOLD = 0.9
CLASS_LETTERS = 2
BROADCAST_TERMS = 1_000_000
_NO_ID = (1 << 63) - 1

KINDS = ("email", "ip", "card", "phone", "term")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_CHARS = re.compile(r"[A-Za-z0-9._%+@-]*")
_LOCAL_CHARS = re.compile(r"[A-Za-z0-9._%+-]*")
# A digit run is taken whole, so that a long one is scanned once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """An address lies inside a run of its own characters, so only runs around an @ are searched.

    If no address starts at one place of a local part, none starts later in it, so each run is read once.
    """
    at = text.find("@")
    while at >= 0:
        start = at
        while start and _is_local(text[start - 1]):
            start -= 1
        end = _EMAIL_CHARS.match(text, at).end()
        while start < end:
            if m := _EMAIL.match(text, start, end):
                yield m.span()
                start = m.end()
            else:
                start = max(start + 1, _LOCAL_CHARS.match(text, start, end).end())
        at = text.find("@", end)


def _is_local(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "._%+-@")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all base matches, by start and then kind as listed."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_NOT_LETTER = np.array([not (0x61 <= b <= 0x7A or b >= 0x80) for b in range(256)])


def _entity(kind: str, value: str) -> int:
    """A signed 64-bit hash of an entity."""
    h = xxhash.xxh64_intdigest(f"{kind}:{value}")
    return h - (1 << 64) if h >> 63 else h


def _entities(text: str, spans) -> list[int]:
    return sorted({_entity(kind, text[a:b]) for a, kind, b in spans})


def _class_hashes(words: textnum.Words) -> np.ndarray:
    """The hash of each word's class: its last CLASS_LETTERS letters, unlike that of a word of these letters."""
    letters = np.flatnonzero((words.data & 0xC0) != 0x80)
    begin = letters[np.maximum(np.searchsorted(letters, words.end) - CLASS_LETTERS, 0)]
    h = textnum.span_hashes(words.data, np.maximum(begin, words.start), words.end)
    return textnum.mix(h ^ np.uint64(0x5851F42D4C957F2D))


def terms_of(texts: pa.Array, spans: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, row, start, end) of all terms of ``texts`` outside the rows' ``spans``, in order; places in characters."""
    data, offsets = textnum.buffer_of(texts)
    words = textnum.Words(_LOWER[data], offsets, _NOT_LETTER)
    inner = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
    origin = (offsets - inner[offsets])[words.doc]
    start, end = words.start - inner[words.start] - origin, words.end - inner[words.end] - origin
    keep = end - start >= 3
    for i, found in enumerate(spans):
        low, high = words.first[i], words.first[i + 1]
        if found:
            # base spans of different kinds may overlap: a word is inside one or more if more begin before its end than end by its start
            a, b = np.sort([x for x, _, _ in found]), np.sort([y for _, _, y in found])
            keep[low:high] &= np.searchsorted(a, end[low:high], "left") == np.searchsorted(b, start[low:high], "right")
    return words.hashes().view(np.int64)[keep], _class_hashes(words).view(np.int64)[keep], words.doc[keep], start[keep], end[keep]


_FOUND = "doc_id long, h long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>"


def _candidate_rows(column: pa.Array) -> np.ndarray:
    """Rows with an @ or at least four digits: no base kind matches any other."""
    data, offsets = textnum.buffer_of(column)
    digit = (data >= 0x30) & (data <= 0x39)
    at = np.concatenate([[0], np.cumsum(data == 0x40)])
    count = np.concatenate([[0], np.cumsum(digit)])
    return (np.diff(at[offsets]) > 0) | (np.diff(count[offsets]) >= 4)


def _find(batches):
    for batch in batches:
        for part in textnum.slices(batch, "text", 2 << 20):
            texts = part.column("text")
            likely = _candidate_rows(texts)
            base, entities = [""] * len(texts), [None] * len(texts)
            counts = np.zeros((4, len(texts)), np.int64)
            for i in np.flatnonzero(likely).tolist():
                text = texts[i].as_py()
                spans = base_spans(text)
                if spans:
                    base[i], entities[i] = joined(spans), _entities(text, spans)
                    for _, kind, _ in spans:
                        counts[KINDS.index(kind), i] += 1
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("h"), *(pa.array(c) for c in counts), pa.array(base, pa.string()), pa.array(entities, pa.list_(pa.int64()))],
                names=["doc_id", "h", "n_email", "n_ip", "n_card", "n_phone", "base", "entities"],
            )


def _term_counts(batches):
    """Per partition, in how many of its documents each term or class occurs."""
    terms, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, size = [], 0
    for batch in batches:
        for part in textnum.slices(batch, "text"):
            data, offsets = textnum.buffer_of(part.column("text"))
            words = textnum.Words(_LOWER[data], offsets, _NOT_LETTER)
            for h in (words.hashes().view(np.int64), _class_hashes(words).view(np.int64)):
                order = np.lexsort((h, words.doc))
                h, doc = h[order], words.doc[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                held.append(h[first])
                size += len(held[-1])
            if size > 500_000:
                terms, n = _summed(terms, n, held)
                held, size = [], 0
    terms, n = _summed(terms, n, held)
    for i in range(0, len(terms), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["term", "n"])


def _summed(terms, n, more):
    unique, at = np.unique(np.concatenate([terms, *more]), return_inverse=True)
    weights = np.concatenate([n, *(np.ones(len(x), np.int64) for x in more)])
    return unique, np.bincount(at, weights=weights, minlength=len(unique)).astype(np.int64)


def find(docs: DataFrame) -> DataFrame:
    """Base spans and entities of each row of ``docs`` (doc_id, text); small rows without the text, checkpointed."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return cut(docs.mapInArrow(_find, _FOUND))


def _holding(part: pa.RecordBatch, chosen: set[int] | None):
    """Rows of ``part`` that hold (chosen) entities: their numbers, base spans and entities."""
    rows, spans, about = [], [], []
    for i in np.flatnonzero(_candidate_rows(part.column("text"))).tolist():
        text = part.column("text")[i].as_py()
        found = base_spans(text)
        held = [e for e in _entities(text, found) if chosen is None or e in chosen]
        if held:
            rows.append(i)
            spans.append(found)
            about.append(held)
    return rows, spans, about


def _pairs(chosen):
    """Per partition, of each (chosen) entity and term or class that share documents: how many, and up to SUPPORT of their ids."""

    def run(batches):
        entities = None if chosen is None else set(chosen.value.tolist())
        held, size = [], 0
        for batch in batches:
            for part in textnum.slices(batch, "text"):
                rows, spans, about = _holding(part, entities) if entities is None or entities else ((), (), ())
                if not rows:
                    continue
                h, kind, row, _, _ = terms_of(part.column("text").take(pa.array(rows)), spans)
                edges = np.searchsorted(row, np.arange(len(rows) + 1))
                for i, seen in enumerate(about):
                    doc = part.column("doc_id")[rows[i]].as_py()
                    terms, at = np.unique(h[edges[i] : edges[i + 1]], return_index=True)
                    kinds = kind[edges[i] : edges[i + 1]][at]
                    t = np.concatenate([terms, np.unique(kinds)])
                    k = np.concatenate([kinds, np.zeros(len(t) - len(kinds), np.int64)])
                    for entity in seen:
                        held.append((np.full(len(t), entity, np.int64), t, np.full(len(t), doc, np.int64), np.ones(len(t), np.int64), k))
                        size += len(t)
                        if size > 500_000:
                            held = [_paired(held)]
                            size = len(held[0][0])
                            if size > 250_000:
                                yield from _batches(held[0])
                                held, size = [], 0
        if held:
            yield from _batches(_paired(held))

    return run


def _paired(held):
    """Sums of n by (entity, term, document), with the term's class; documents of a pair beyond the least SUPPORT are counted with its first."""
    e, t, c, n, k = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((c, t, e))
    e, t, c, n, k = e[order], t[order], c[order], n[order], k[order]
    pair = np.ones(len(e), bool)
    pair[1:] = (e[1:] != e[:-1]) | (t[1:] != t[:-1])
    new = pair.copy()
    new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    e, t, c, n, k, pair = e[at], t[at], c[at], np.add.reduceat(n, at) if len(at) else n, k[at], pair[at]
    first = np.flatnonzero(pair)
    which = np.cumsum(pair) - 1
    keep = np.arange(len(e)) - first[which] < SUPPORT
    np.add.at(n, first[which[~keep]], n[~keep])
    return e[keep], t[keep], c[keep], n[keep], k[keep]


def _batches(columns, step: int = 100_000):
    for i in range(0, len(columns[0]), step):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + step]) for x in columns], names=["entity", "term", "doc", "n", "class"])


def _broadcast(df: DataFrame, column: str):
    """The distinct values of ``column``, sorted, on all executors; None if there are too many."""
    values = df.select(column).distinct()
    if values.count() > BROADCAST_TERMS:
        return None
    return df.sparkSession.sparkContext.broadcast(np.array(sorted(r[0] for r in values.toLocalIterator()), np.int64))


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, disclosure, level) of the pairs of enough documents that reach the threshold; level 1: to its class, 2: removed."""
    seen = found.select(F.explode("entities").alias("entity"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc")).distinct()
    able = cut(seen.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text").where(F.col("text").isNotNull())
    once = texts.mapInArrow(_pairs(_broadcast(able, "entity")), "entity long, term long, doc long, n long, class long")
    once = once.groupBy("entity", "term", "doc").agg(F.sum("n").alias("n"), F.max("class").alias("class"))
    pairs = once.groupBy("entity", "term").agg(F.count("*").alias("docs"), F.sum("n").alias("n_both"), F.max("class").alias("class"))
    pairs = cut(pairs.where(F.col("docs") >= SUPPORT).drop("docs"))
    counts = texts.select("text").mapInArrow(_term_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    p = F.least(F.lit(0.5), F.col("n_entity") / F.lit(max(found.count(), 1)))
    given = F.least(F.lit(1.0), (F.col("n_both") + SMOOTH * p) / (F.col("n_term") + SMOOTH))
    scored = cut(pairs.join(counts, "term").join(entities, "entity").select("entity", "term", "class", (1 + F.log(given) / -F.log(p)).alias("disclosure")).where(F.col("disclosure") >= THRESHOLD))
    # a class among those that reach the threshold itself hides nothing
    kinds = scored.select("entity", F.col("term").alias("class"), F.lit(2).alias("level"))
    terms = scored.where("class <> 0").join(kinds, ["entity", "class"], "left")
    return terms.select("entity", "term", "disclosure", F.coalesce("level", F.lit(1)).alias("level"))


def _mark(table):
    """All occurrences of the terms that disclose an entity of their document."""

    def run(batches):
        entity, term, level = table.value
        known = set(entity.tolist())
        for batch in batches:
            for part in textnum.slices(batch, "text"):
                rows, spans, about = _holding(part, known) if known else ((), (), ())
                if not rows:
                    continue
                h, _, row, start, end = terms_of(part.column("text").take(pa.array(rows)), spans)
                edges = np.searchsorted(row, np.arange(len(rows) + 1))
                for i, held in enumerate(about):
                    at = np.concatenate([np.arange(*np.searchsorted(entity, [e, e + 1])) for e in held])
                    at = at[np.lexsort((-level[at], term[at]))]
                    at = at[np.unique(term[at], return_index=True)[1]]
                    here = slice(edges[i], edges[i + 1])
                    k = np.minimum(np.searchsorted(term[at], h[here]), len(at) - 1)
                    hit = np.flatnonzero(term[at][k] == h[here])
                    if len(hit):
                        yield pa.RecordBatch.from_arrays(
                            [
                                *(pa.array([part.column(c)[rows[i]].as_py()] * len(hit), pa.int64()) for c in ("doc_id", "h")),
                                *(pa.array(x[here][hit].astype(np.int32)) for x in (start, end)),
                                pa.array(level[at][k[hit]].astype(np.int32)),
                            ],
                            names=["doc_id", "h", "start", "end", "level"],
                        )

    return run


def _term_rows(places: bool):
    """Of documents that hold entities: the terms, by entity and without places, or by place and without entities."""

    def run(batches):
        for batch in batches:
            for part in textnum.slices(batch, "text"):
                rows, spans, about = _holding(part, None)
                if not rows:
                    continue
                h, _, row, start, end = terms_of(part.column("text").take(pa.array(rows)), spans)
                edges = np.searchsorted(row, np.arange(len(rows) + 1))
                for i, held in enumerate(about):
                    here = slice(edges[i], edges[i + 1])
                    if places:
                        found = [[pa.array(h[here]), *(pa.array(x[here].astype(np.int32)) for x in (start, end))]]
                    else:
                        terms = pa.array(np.unique(h[here]))
                        found = ([terms, pa.array(np.full(len(terms), e, np.int64))] for e in held)
                    for columns in found:
                        ids = [pa.array([part.column(c)[rows[i]].as_py()] * len(columns[0]), pa.int64()) for c in ("doc_id", "h")]
                        yield pa.RecordBatch.from_arrays([*ids, *columns], names=["doc_id", "h", "term", *(("start", "end") if places else ("entity",))])

    return run


def _joined_hits(keyed: DataFrame, scored: DataFrame) -> DataFrame:
    """The occurrences to mark, with disclosing pairs and texts' terms joined: nothing goes to the driver."""
    held = keyed.mapInArrow(_term_rows(False), "doc_id long, h long, term long, entity long")
    told = held.join(scored.select("entity", "term", "level"), ["entity", "term"])
    told = told.groupBy(F.col("doc_id").alias("t_doc_id"), F.col("h").alias("t_h"), F.col("term").alias("t_term")).agg(F.max("level").alias("level"))
    places = keyed.mapInArrow(_term_rows(True), "doc_id long, h long, term long, start int, end int")
    same = F.col("doc_id").eqNullSafe(F.col("t_doc_id")) & (F.col("h") == F.col("t_h")) & (F.col("term") == F.col("t_term"))
    return places.join(told, same).select("doc_id", "h", "start", "end", "level")


def term_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, h, terms): the spans that the method adds, one row per distinct (doc_id, h)."""
    scored = cut(disclosures(docs, found))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").where(F.col("text").isNotNull())
    if scored.count() <= BROADCAST_TERMS:
        some = sorted(tuple(r) for r in scored.select("entity", "term", "level").toLocalIterator())
        e, t, level = zip(*some, strict=True) if some else ((), (), ())
        table = docs.sparkSession.sparkContext.broadcast((np.array(e, np.int64), np.array(t, np.int64), np.array(level, np.int64)))
        hits = keyed.mapInArrow(_mark(table), "doc_id long, h long, start int, end int, level int")
    else:
        hits = _joined_hits(keyed, scored)
    hit = hits.groupBy("doc_id", "h", "start", "end").agg(F.max("level").alias("level"))
    return hit.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end", "level"))).alias("terms"))


def spans_column():
    """All spans as text: base spans and term spans by start, then kind as listed."""
    base = F.when(F.col("base") == "", F.array()).otherwise(
        F.transform(
            F.split("base", ","),
            lambda x: F.struct(
                F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("a"),
                F.array_position(F.array(*map(F.lit, KINDS)), F.split_part(x, F.lit(":"), F.lit(1))).cast("int").alias("k"),
                F.split_part(x, F.lit(":"), F.lit(3)).cast("int").alias("z"),
            ),
        )
    )
    terms = F.transform(F.coalesce("terms", F.array()), lambda x: F.struct(x["start"].cast("int").alias("a"), F.lit(len(KINDS)).alias("k"), x["end"].cast("int").alias("z")))
    both = F.array_sort(F.concat(base, terms))
    return F.array_join(F.transform(both, lambda x: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), x["k"]), F.lit(":"), x["a"], F.lit(":"), x["z"])), ",")


def report(docs: DataFrame) -> DataFrame:
    docs = project(docs, doc_id="doc_id", text="text")
    found = find(docs)
    terms = term_spans(docs, found).withColumnsRenamed({"doc_id": "t_doc_id", "h": "t_h"})
    both = found.join(terms, F.col("doc_id").eqNullSafe(F.col("t_doc_id")) & (F.col("h") == F.col("t_h")), "left")
    return both.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), spans_column().alias("spans"), F.size(F.coalesce("terms", F.array())).cast("long").alias("n_term")
    )


_MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def _mask_text(text: str, spans, terms) -> str:
    marks = [(a, b, _MASKS[k]) for a, k, b in spans]
    marks += [(x["start"], x["end"], "" if x["level"] > 1 else f"[*{text[max(x['start'], x['end'] - CLASS_LETTERS) : x['end']]}]") for x in terms or ()]
    out, at = [], 0
    for a, b, mask in sorted(marks):
        if a < at:  # overlaps what is masked already: only its rest is taken out
            at = max(at, b)
            continue
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def _mask(batches):
    for batch in batches:
        for part in textnum.slices(batch, "text", 2 << 20):
            texts, terms = part.column("text"), part.column("terms").to_pylist()
            likely = _candidate_rows(texts)
            new = []
            for i, text in enumerate(texts):
                text = text.as_py()
                new.append(_mask_text(text, base_spans(text), terms[i]) if text is not None and (likely[i] or terms[i]) else text)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(new, pa.string())], names=["row", "text"])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans masked in ``text``; every row and column is kept."""
    slim = project(docs, doc_id="doc_id", text="text")
    terms = term_spans(slim, find(slim)).withColumnsRenamed({"doc_id": "t_doc_id", "h": "t_h"})
    keyed = pack(docs).withColumn("h", F.xxhash64("text"))
    both = keyed.join(terms, F.col("row.doc_id").cast("long").eqNullSafe(F.col("t_doc_id")) & (F.col("h") == F.col("t_h")), "left").select("row", "text", "terms")
    schema = T.StructType([both.schema["row"], both.schema["text"]])
    return unpack(both.mapInArrow(_mask, schema), docs.columns)


def op7_pii_sanitisation(spark, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"))
