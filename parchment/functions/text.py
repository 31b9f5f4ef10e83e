"""Column functions for text: tokens, numbers, normal forms, names.

``unicode=True`` gives ``\\w``, ``\\d``, ``\\s`` and ``\\b`` their Unicode meaning;
the default here is ASCII, as most SQL engines read them.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def pattern(p: str, unicode: bool = False) -> Column:
    return F.lit(f"(?U){p}" if unicode else p)


def strings(values) -> Column:
    return F.array(*map(F.lit, values))


def words(text: Column, stop=(), longer_than: int = 0) -> Column:
    """Distinct lower-case ASCII words, in order of first occurrence, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0))
    found = F.array_except(found, strings(stop)) if stop else found
    return F.filter(found, lambda x: F.length(x) > longer_than) if longer_than else found


def retrieval_words(text: Column, stop=rules.RETRIEVAL_STOP_WORDS) -> Column:
    return words(text, stop)


def grounding_words(text: Column, stop=rules.GROUNDING_STOP_WORDS) -> Column:
    return words(text, stop, longer_than=2)


def layout_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def coverage_tokens(text: Column) -> Column:
    """Tokens as a bag: trailing punctuation stripped, lower case, empties dropped."""
    found = F.regexp_extract_all(text, F.lit(rules.COVERAGE_TOKEN), 0)
    return F.filter(F.transform(found, lambda t: F.lower(F.regexp_replace(t, "[.,;:]+$", ""))), lambda t: t != "")


def numbers(text: Column) -> Column:
    """Number literals as printed; no boundaries, so ``50000`` reads as 500 and 00."""
    return F.regexp_extract_all(text, F.lit(rules.NUMBER), 0)


def json_object(text: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def fix_glyphs(text: Column) -> Column:
    return F.regexp_replace(text, r"\(cid:(?:" + "|".join(map(str, rules.BULLET_GLYPHS)) + r")\)", "•")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def ocr_paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), squeeze), lambda p: p != "")


def fill_blanks(text: Column) -> Column:
    t = F.regexp_replace(text, rules.LEADING_NUMBER, "")
    t = F.regexp_replace(t, rules.BLANK, "[blank]")
    return squeeze(F.regexp_replace(t, r"(\[blank\]\s*)+", "[blank] "))


def template_form(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), rules.PARTY_A, "PARTY_A")
    t = F.regexp_replace(t, rules.PARTY_B, "PARTY_B")
    t = F.regexp_replace(t, rules.PROPERTY, "PROPERTY")
    return squeeze(F.regexp_replace(t, rules.AMOUNT, "AMOUNT"))


def excerpt(text: Column, limit: int = rules.EXCERPT_CHARS) -> Column:
    """At most ``limit`` characters, cut at the last space, with an ellipsis if cut."""
    head = F.regexp_replace(F.substring(text, 1, limit), " [^ ]*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit(" …")))


def snippet(text: Column, limit: int = rules.SNIPPET_CHARS) -> Column:
    return F.substring(text, 1, limit)


def display_name(heading: Column, text: Column, shared: Column, n: int = 7) -> Column:
    """Its own heading, capitalised, unless several rows share it; else the first words and an ellipsis."""
    own = F.concat(F.upper(F.substring(heading, 1, 1)), F.lower(F.substring(heading, 2, 1 << 30)))
    first = F.concat(F.array_join(F.slice(F.split(text, r"\s+"), 1, n), " "), F.lit("…"))
    return F.when((F.coalesce(heading, F.lit("")) != "") & ~F.coalesce(shared, F.lit(False)), own).otherwise(first)


def slug(filename: Column) -> Column:
    return F.lower(F.translate(F.regexp_replace(F.regexp_replace(filename, r"^\d+_", ""), r"(?i)\.pdf$", ""), "_", "-"))


def title(filename: Column, cities=rules.CITIES, small=rules.SMALL_WORDS) -> Column:
    parts = F.split(slug(filename), "-")
    city = F.element_at(parts, -1)
    has_city = city.isin(*cities)
    own = F.when(has_city, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    named = F.replace(F.array_join(F.transform(own, lambda w, i: F.when((i > 0) & w.isin(*small), w).otherwise(cap(w))), " "), F.lit("Leave License"), F.lit("Leave & Licence"))
    return F.when(has_city, F.concat(named, F.lit(" · "), cap(city))).otherwise(named)


def mid_sentence(text: Column) -> Column:
    """Does the text read as torn: opens in lower case, or has no bullet and does not end a sentence."""
    t = F.regexp_replace(text, r"(?U)\s+\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", False).when(text.rlike(r"^\p{Ll}"), True).when(F.contains(text, F.lit("•")), False).otherwise(~t.rlike(r"[.;:!?]\z"))


def public_error(raw: Column) -> Column:
    low = F.lower(raw)
    limit = low.rlike("|".join(rules.LIMIT_MARKERS))
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None).cast("string"))
        .when(F.startswith(low, F.lit("classification failed")), rules.ERROR_CLASSIFICATION)
        .when(limit, rules.ERROR_LIMIT)
        .otherwise(rules.ERROR_OTHER)
    )


def client_key(header: Column) -> Column:
    return F.when(F.trim(header) != "", F.sha2(F.trim(header), 256))


def visitor_key(forwarded: Column, host: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.element_at(F.split(forwarded, ","), 1)), F.lit("")), host, F.lit("unknown"))


def rating_words(label: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rules.RATING_WORDS.items() for x in kv]), label), F.lit("not assessed"))


def question_for(template: Column, clause_id: Column, label: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{clause_id}"), clause_id), F.lit("{rating}"), rating_words(label))


def truth_label(reviewed: Column, proposed: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(F.trim(reviewed), F.lit("")), proposed))


def subtlety(key: Column) -> Column:
    return F.when(F.contains(key, F.lit("obvious")), "obvious").when(F.contains(key, F.lit("red")), "subtle").otherwise("na")


def coverage_badge(explained: Column, total: Column) -> Column:
    return F.when(explained == total, "all explained").when(explained == 0, "none explained").otherwise(F.concat(explained.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" explained")))


def spaced_lines(text: Column) -> Column:
    """A blank line before a line that is neither bullet nor indented and follows a non-blank one."""
    lines = F.split(text, "\n")
    gap = lambda x, i: (i > 0) & (F.trim(x) != "") & ~x.rlike(r"^(\s|[-*] )") & (F.trim(F.get(lines, i - 1)) != "")
    return F.array_join(F.transform(lines, lambda x, i: F.when(gap(x, i), F.concat(F.lit("\n"), x)).otherwise(x)), "\n")


def cache_key(*parts: Column) -> Column:
    return F.sha1(F.to_json(F.array(*[p.cast("string") for p in parts])))


def page_chars(paragraphs: Column) -> Column:
    return F.aggregate(paragraphs, F.lit(0), lambda a, p: a + F.length(p))


def full_text(paragraphs: Column) -> Column:
    return F.array_join(paragraphs, "\n\n")


def document_method(methods: Column) -> Column:
    """From the set of a document's page methods; anything but one of text and ocr, also no pages, is mixed."""
    return F.when(methods == strings(["text"]), "text").when(methods == strings(["ocr"]), "ocr").otherwise("mixed")


def first_rule(text: Column, table=rules.TOPICS, unicode: bool = False) -> Column:
    """Name of the first rule, in order of priority, whose pattern is found; null if none."""
    out = None
    for name, p in table:
        hit = F.regexp_like(text, pattern(p, unicode))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def headed(text: Column, heading: Column | None = None) -> Column:
    return F.concat(F.coalesce(heading, F.lit("")), F.lit(" "), text) if heading is not None else F.concat(F.lit(" "), text)


def topic(text: Column, heading: Column | None = None, table=rules.TOPICS, unicode: bool = False) -> Column:
    return first_rule(headed(text, heading), table, unicode)


def holds_any(text: Column, literals) -> Column:
    """Is one of the literals in a text, in either case?  One scan of Arrow batches for all of them.

    Rules that need one of these words read only such texts: Java tries each rule at each character of a text.
    """
    p = "|".join(map(re.escape, literals))

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern=p, ignore_case=True)

    return found(text)


def signals(text: Column, p: str, unicode: bool = False) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, pattern(p, unicode), 1), F.lower)))


def jurisdiction(text: Column, first=("Maharashtra", rules.MAHARASHTRA_SIGNALS), second=("Delhi", rules.DELHI_SIGNALS), others=rules.OTHER_STATE_SIGNALS, unicode: bool = False) -> Column:
    """struct(jurisdiction, evidence, unsupported_hint, ambiguous) of one text."""
    a, b = signals(text, first[1], unicode), signals(text, second[1], unicode)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    none = (F.size(a) == 0) & (F.size(b) == 0)
    state = F.when(both, F.lit(None)).when(F.size(a) > 0, first[0]).when(F.size(b) > 0, second[0])
    other = F.when(none, first_rule(text, others, unicode)) if others else F.lit(None).cast("string")
    return F.struct(state.alias("jurisdiction"), F.concat(a, b).alias("evidence"), other.alias("unsupported_hint"), both.alias("ambiguous"))


def out_of_scope_state(question: Column, state: Column, **tables) -> Column:
    hint = jurisdiction(question, **tables)
    named = F.coalesce(hint["jurisdiction"], hint["unsupported_hint"])
    return F.when(named.isNotNull() & ~named.eqNullSafe(state), named)
