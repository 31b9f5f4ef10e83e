"""Clause segmentation of one document at a time (E2: N6, N7, N9, X-R1 to X-R9).

Numbering, label and section state run through a document's paragraphs in order.
``segment`` gathers these by document, one shuffle, and folds them as array columns
(``functions.arrays``), so no row leaves the JVM; memory is bounded by one document.
``segment_paragraphs`` says the same for a list of paragraphs, for use as a table
function in SQL; tests hold the two against each other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import arrays, rules

_INLINE = re.compile(rules.INLINE_NUMBER)
_ARTICLE = re.compile(rules.ARTICLE)
_CLAUSE_NUMBER = re.compile(rules.CLAUSE_NUMBER)
_STANDALONE = re.compile(rules.STANDALONE_HEADING)
_BULLET = re.compile(rules.BULLET_LINE)
_CLOSING = re.compile(rules.CLOSING_FORMULA)
_DIVIDER = re.compile(rules.SECTION_DIVIDER)
_BANNER = re.compile(rules.INLINE_BANNER)
_SIGNATURE = re.compile(rules.SIGNATURE_RUN)
_CONNECTOR = re.compile(rules.DEED_CONNECTOR)
_HEADINGS = ((re.compile(rules.NUMBERED_HEADING), 2), (re.compile(rules.COLON_HEADING), 1), (re.compile(rules.CAPS_HEADING), 1))
_CAPS_END = re.compile(r"\b[A-Z]{3,}$")


def number_cuts(paragraph: str, last: int | None) -> tuple[list[int], int | None]:
    """Where a paragraph opens a new numbered clause, and the number reached."""
    cuts = []
    for m in _INLINE.finditer(paragraph):
        top, nested, inside = int(m[1]), m[2] != "", m.start() > 0
        lead = paragraph[: m.start()].rstrip()
        ends = lead.endswith(rules.SENTENCE_ENDS)
        if top == 1 and not nested and (not inside or ends or _CAPS_END.search(lead)):
            last = 1
            opens = ends
        elif last is not None and (top == last + 1 or nested and top == last):
            last = top
            opens = True
        else:
            continue
        if inside and opens:
            cuts.append(m.start())
    return cuts, last


def split_numbered(paragraphs):
    last = None
    for p in paragraphs:
        cuts, last = number_cuts(p, last)
        if cuts:
            yield from filter(None, (p[a:b].strip() for a, b in zip([0, *cuts], [*cuts, len(p)], strict=True)))
        else:
            yield p


def merge_bullets(paragraphs):
    held = None
    for p in paragraphs:
        if held is not None and _BULLET.match(p):
            held += " " + p.strip()
        else:
            if held is not None:
                yield held
            held = p
    if held is not None:
        yield held


def bare_heading(p: str) -> bool:
    return len(p) <= rules.BARE_HEADING_CHARS and (p.endswith(":") or _STANDALONE.match(p) is not None)


def section_banner(p: str) -> bool:
    p = p.rstrip(":").strip()
    return p == p.upper() and any(map(str.isalpha, p))


def merge_labels(paragraphs):
    """A bare label joins the paragraph after it, unless that is numbered."""
    label = None
    for p in paragraphs:
        if label is not None and not _CLAUSE_NUMBER.match(p):
            yield f"{label} {p}"
            label = None
            continue
        if label is not None:
            yield label
        label = p if bare_heading(p) and not section_banner(p) and not _ARTICLE.match(p) else None
        if label is None:
            yield p
    if label is not None:
        yield label


def split_heading(p: str) -> tuple[str | None, str]:
    for pattern, group in _HEADINGS:
        m = pattern.match(p)
        if m and len(m[group]) <= rules.HEADING_CHARS and len(m[group].split()) <= rules.HEADING_WORDS:
            return m[group].strip(), p[m.end() :].strip()
    m = _CONNECTOR.match(p)
    return (m[1], p[m.end() :].strip()) if m else (None, p.strip())


def title_size(paragraphs: list[str]) -> int:
    for i, p in enumerate(paragraphs[: rules.TITLE_PARAGRAPHS]):
        if p.rstrip().endswith((".", ";", "!", "?", ":")) or len(p) > rules.TITLE_CHARS:
            return i
    return min(len(paragraphs), rules.TITLE_PARAGRAPHS)


def segment_paragraphs(paragraphs: list[str | None]) -> list[tuple[str, str | None, str | None, str]]:
    """(part, clause_number, section_heading, text) with part one of title, clause, signature, heading."""
    clean = [p.strip() for p in paragraphs if p and p.strip()]
    n = title_size(clean)
    titles = [("title", None, None, p) for p in clean[:n]]
    clauses, signatures, headings = [], [], []
    section, compound = None, False
    for p in merge_labels(merge_bullets(split_numbered(clean[n:]))):
        if "_" in p:
            signatures += [("signature", None, None, m.strip()) for m in _SIGNATURE.findall(p) if m.strip()]
            p = _SIGNATURE.sub("", p).strip(" _")
        if m := _ARTICLE.match(p):
            section = (m[1] or "").strip(" .:-–—") or section
            p = m[2].strip()
        if not p:
            continue
        if bare_heading(p):
            heading = p.rstrip(":").strip()
            section = f"{section} {heading}" if compound else heading
            if compound and headings:
                headings.pop()
            headings.append(section)
            compound = True
            continue
        if _CLOSING.match(p) or _DIVIDER.match(p):
            section = None
        if m := _BANNER.match(p):
            section = m[1].strip()
            headings.append(section)
            p = p[m.end() :].strip()
        number = _CLAUSE_NUMBER.match(p)
        heading, text = split_heading(p)
        if text:
            compound = False
            clauses.append(("clause", number[1] if number else None, heading or section, text))
    return [*titles, *clauses, *signatures, *[("heading", None, None, h) for h in headings]]


#: Classes with their Unicode meaning, and \n as the only line end.
_U = "(?Ud)"
_BLANK = r"[\s\x1c-\x1f]"
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_NUMBER_START = r"\d{1,3}(?:\.\d{1,2})*[.)]\s*[A-Z\"“(]"
_ENDS = "[" + "".join("\\" + x for x in rules.SENTENCE_ENDS) + "]"


def _strip(c: Column, chars: str = _SPACES) -> Column:
    return F.btrim(c, F.lit(chars))


def _colons(c: Column) -> Column:
    return F.rtrim(c, F.lit(":"))


def _has(c: Column, p: str) -> Column:
    return F.regexp_like(c, F.lit(_U + p))


def _group(c: Column, p: str, n: int) -> Column:
    return F.regexp_extract(c, _U + p, n)


def _bare(p: Column) -> Column:
    return (F.length(p) <= rules.BARE_HEADING_CHARS) & (p.endswith(":") | _has(p, rules.STANDALONE_HEADING))


def _banner(p: Column) -> Column:
    p = _strip(_colons(p))
    return (p == F.upper(p)) & _has(p, r"\p{L}")


def _numbering(last: Column, x: Column) -> tuple[Column, Column]:
    """The number reached, and whether a piece starts a paragraph of its own."""
    there = x["top"].isNotNull()
    first = there & (x["top"] == 1) & ~x["nested"] & (~x["inside"] | x["ends"] | x["caps"])
    chain = there & last.isNotNull() & ((x["top"] == last + 1) | (x["nested"] & (x["top"] == last)))
    opens = F.when(first, x["ends"]).otherwise(F.coalesce(chain, F.lit(False)))
    return F.when(first, F.lit(1)).when(chain, x["top"]).otherwise(last), ~x["inside"] | opens


def _labelling(held: Column, x: Column) -> tuple[Column, Column]:
    """Whether a bare label is held, and whether a paragraph stands on its own."""
    joins = held & ~x["numbered"]
    return ~joins & x["label"], ~joins


def _sections(state: Column, x: Column) -> tuple[Column, Column]:
    """(section, compound), and the heading told (with ``pop`` in place of the one before) or the clause."""
    section = F.when(x["article"], F.coalesce(x["name"], state["section"])).otherwise(state["section"])
    empty, bare = x["p"] == "", x["bare"]
    full = F.when(state["compound"], F.concat(section, F.lit(" "), x["heading"])).otherwise(x["heading"])
    here = F.coalesce(x["banner"], F.when(~x["closes"], section))
    new = F.when(empty, section).when(bare, full).otherwise(here)
    compound = F.when(empty, state["compound"]).otherwise(bare)
    told = F.when(~empty & bare, full).when(~empty, x["banner"])
    body = F.when(~empty & ~bare, x["text"])
    emission = F.struct(told.alias("told"), (bare & state["compound"]).alias("pop"), F.when(body.isNotNull(), x["number"]).alias("number"), F.when(body.isNotNull(), F.coalesce(x["own"], here)).alias("heading"), body.alias("text"))
    return F.struct(new.alias("section"), compound.alias("compound")), emission


_ROW = "struct<part:string,order_index:int,clause_id:string,clause_number:string,section_heading:string,text:string>"


def _rows(items: Column, part: str, text=lambda x: x, number=None, heading=None) -> Column:
    none = F.lit(None).cast("string")
    clause = (lambda i: F.format_string("c%03d", i + 1)) if part == "clause" else lambda i: none
    return F.transform(items, lambda x, i: F.struct(F.lit(part).alias("part"), i.alias("order_index"), clause(i).alias("clause_id"), (number(x) if number else none).alias("clause_number"), (heading(x) if heading else none).alias("section_heading"), text(x).alias("text")))


def segment_arrays(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, parts, keep) of ``docs`` (document_id, paragraphs: array of texts in order); parts are title, clause, signature and heading rows.

    Where a document is one row, this needs no exchange; ``segment`` is for paragraphs that are rows.
    """
    c = F.col
    steps: list[tuple[str, Column]] = []
    add = lambda name, column: steps.append((name, column))
    add("clean", F.filter(F.transform("paragraphs", lambda p: _strip(p)), lambda p: p != ""))
    prose = lambda p: F.endswith(p, F.lit(".")) | _has(p, r"[;!?:]\z") | (F.length(p) > rules.TITLE_CHARS)
    head = F.slice("clean", F.lit(1), F.lit(rules.TITLE_PARAGRAPHS))
    add("titles", F.coalesce(F.array_min(F.array_compact(F.transform(head, lambda p, i: F.when(prose(p), i)))), F.size(head)))
    # a paragraph is cut before every number that could open a clause; whether it does, the numbers before decide
    add("cut", F.transform(F.slice("clean", c("titles") + 1, F.greatest(F.size("clean") - c("titles"), F.lit(0))), lambda p: F.split(p, f"{_U}(?={_NUMBER_START})(?<![\\w.])")))
    number = lambda t, n: F.regexp_extract(t, _U + r"^(\d{1,3})((?:\.\d{1,2})*)[.)]\s*(?=[A-Z\"“(])", n)
    before = lambda q, j, p: F.coalesce(_has(F.get(q, j - 1), p + _BLANK + r"*\z"), F.lit(False))
    # a failed cast raises inside Spark, which is costly, so only what starts like a number is cast
    digit = lambda t: _has(F.substring(t, 1, 1), r"\d")
    top = lambda t: F.when(digit(t), F.nullif(number(t, 1), F.lit("")).try_cast("int"))
    piece = lambda q: F.transform(q, lambda t, j: F.struct(t.alias("text"), (j > 0).alias("inside"), top(t).alias("top"), (digit(t) & (number(t, 2) != "")).alias("nested"), before(q, j, _ENDS).alias("ends"), before(q, j, r"\b[A-Z]{3,}").alias("caps")))
    add("pieces", F.flatten(F.transform("cut", piece)))
    add("starts", arrays.starts_of(arrays.fold(c("pieces"), F.lit(None).cast("int"), _numbering, "boolean")))
    add("texts", F.transform(arrays.joined_runs(c("pieces")["text"], c("starts"), ""), lambda p: _strip(p)))
    add("starts", arrays.starts_of(F.transform("texts", lambda p, i: (i == 0) | ~_has(p, rules.BULLET_LINE))))
    add("texts", arrays.joined_runs(c("texts"), c("starts"), " "))
    add("labels", F.transform("texts", lambda p: F.struct((_bare(p) & ~_banner(p) & ~_has(p, rules.ARTICLE)).alias("label"), _has(p, rules.CLAUSE_NUMBER).alias("numbered"))))
    add("starts", arrays.starts_of(arrays.fold(c("labels"), F.lit(False), _labelling, "boolean")))
    add("texts", arrays.joined_runs(c("texts"), c("starts"), " "))
    runs = lambda p: F.filter(F.transform(F.regexp_extract_all(p, F.lit(_U + rules.SIGNATURE_RUN), 0), lambda m: _strip(m)), lambda m: m != "")
    add("signed", F.flatten(F.transform("texts", lambda p: F.when(F.contains(p, F.lit("_")), runs(p)).otherwise(F.array().cast("array<string>")))))
    add("texts", F.transform("texts", lambda p: F.when(F.contains(p, F.lit("_")), _strip(F.regexp_replace(p, _U + rules.SIGNATURE_RUN, ""), " _")).otherwise(p)))
    add("x", F.transform("texts", lambda p: F.struct(p.alias("p"), _has(p, rules.ARTICLE).alias("article"))))
    name = lambda p: F.nullif(_strip(_group(p, rules.ARTICLE, 1), " .:-–—"), F.lit(""))
    add("x", F.transform("x", lambda x: F.struct(F.when(x["article"], _strip(_group(x["p"], rules.ARTICLE, 2))).otherwise(x["p"]).alias("p"), x["article"].alias("article"), F.when(x["article"], name(x["p"])).alias("name"))))
    add("x", F.transform("x", lambda x: F.struct(x["p"].alias("p"), x["article"].alias("article"), x["name"].alias("name"), _bare(x["p"]).alias("bare"), (_has(x["p"], rules.CLOSING_FORMULA) | _has(x["p"], rules.SECTION_DIVIDER)).alias("closes"), _has(x["p"], rules.INLINE_BANNER).alias("banner"))))
    add("x", F.transform("x", lambda x: F.struct(
        x["p"].alias("p"), x["article"].alias("article"), x["name"].alias("name"), x["bare"].alias("bare"), _strip(_colons(x["p"])).alias("heading"), x["closes"].alias("closes"),
        F.when(x["banner"], _strip(_group(x["p"], rules.INLINE_BANNER, 1))).alias("banner"), F.when(x["banner"], _strip(F.regexp_replace(x["p"], _U + rules.INLINE_BANNER, ""))).otherwise(x["p"]).alias("body"),
    )))
    own, text = None, None
    for pattern, n in ((rules.NUMBERED_HEADING, 2), (rules.COLON_HEADING, 1), (rules.CAPS_HEADING, 1)):
        hit = lambda b, p=pattern, n=n: _has(b, p) & (F.length(_group(b, p, n)) <= rules.HEADING_CHARS) & (F.size(F.split(_strip(_group(b, p, n)), _U + _BLANK + "+")) <= rules.HEADING_WORDS)
        head_, rest = lambda b, p=pattern, n=n: _strip(_group(b, p, n)), lambda b, p=pattern: _strip(F.regexp_replace(b, _U + p, ""))
        own = (lambda b, f=hit, g=head_: F.when(f(b), g(b))) if own is None else lambda b, o=own, f=hit, g=head_: o(b).when(f(b), g(b))
        text = (lambda b, f=hit, g=rest: F.when(f(b), g(b))) if text is None else lambda b, o=text, f=hit, g=rest: o(b).when(f(b), g(b))
    deed = lambda b: _has(b, rules.DEED_CONNECTOR)
    add("x", F.transform("x", lambda x: F.struct(
        *[x[k].alias(k) for k in ("p", "article", "name", "bare", "heading", "closes", "banner")], F.when(_has(x["body"], rules.CLAUSE_NUMBER), _group(x["body"], rules.CLAUSE_NUMBER, 1)).alias("number"),
        own(x["body"]).when(deed(x["body"]), _group(x["body"], rules.DEED_CONNECTOR, 1)).alias("own"), text(x["body"]).when(deed(x["body"]), _strip(F.regexp_replace(x["body"], _U + rules.DEED_CONNECTOR, ""))).otherwise(_strip(x["body"])).alias("text"),
    )))
    zero = F.struct(F.lit(None).cast("string").alias("section"), F.lit(False).alias("compound"))
    add("out", arrays.fold(c("x"), zero, _sections, "struct<told:string,pop:boolean,number:string,heading:string,text:string>"))
    add("told", F.filter("out", lambda x: x["told"].isNotNull()))
    kept = F.filter(F.transform("told", lambda x, i: F.when(~F.coalesce(F.get("told", i + 1)["pop"], F.lit(False)), x["told"])), lambda h: h.isNotNull())
    parts = F.concat(
        _rows(F.slice("clean", F.lit(1), c("titles")), "title"),
        _rows(F.filter("out", lambda x: x["text"].isNotNull()), "clause", lambda x: x["text"], lambda x: x["number"], lambda x: x["heading"]),
        _rows(c("signed"), "signature"),
        _rows(kept, "heading"),
    )
    add("parts", parts)
    made = docs.select("document_id", "paragraphs", *keep)
    for name, column in steps:
        made = made.withColumn(name, column)
    return made.select("document_id", "parts", *keep)


def rows_of(made: DataFrame) -> DataFrame:
    """The ``parts`` of documents as rows."""
    # the outer form, as a plain one has the size of the array as a filter, which Spark pushes down and so spells all steps again
    return made.select("document_id", F.inline_outer("parts")).where("part IS NOT NULL")


def segment(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (document_id, pos, paragraph) to title, clause, signature and heading rows, numbered within their part."""
    # gathering saves no rows before the exchange, so rows go first and are gathered where they meet
    held = paragraphs.repartition("document_id").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pos", "paragraph"))).alias("p"))
    return rows_of(segment_arrays(held.select("document_id", F.col("p.paragraph").alias("paragraphs"))))


@udtf(returnType="part string, clause_number string, section_heading string, text string")
class SegmentTable:
    """segment(paragraphs): the parts of one document as a table function, for SQL with a lateral join."""

    def eval(self, paragraphs: list):
        yield from segment_paragraphs(paragraphs or [])


def register(spark, name: str = "segment") -> None:
    spark.udtf.register(name, SegmentTable)
