"""Words on a page to lines and paragraphs, and clauses back to boxes.

Line clustering compares with a moving anchor, folded over a page's words as an array;
paragraphs from lines are windows (``ordering.paragraphs_by_gap``).  Locating clauses moves a
cursor through a document: its tokens are one array of codes, in which a clause is sought close to
the cursor.  Only where one is not found so, the list of the document's runs is
sorted, in which an opening is found by halving; clauses are folded over it
(``functions.arrays``), so no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, rules, text
from .ordering import paragraphs_by_gap, rejoin


def cluster_lines(words: list[tuple[float, float, str]], tolerance: float = rules.LINE_TOLERANCE) -> list[tuple[float, str]]:
    """(top, x0, text) to lines: a word within ``tolerance`` of the line's first top belongs to it."""
    lines: list[tuple[float, list[str]]] = []
    for top, _, word in sorted(words, key=lambda w: w[:2]):
        if lines and abs(top - lines[-1][0]) <= tolerance:
            lines[-1][1].append(word)
        else:
            lines.append((top, [word]))
    return [(top, " ".join(x)) for top, x in lines]


def _anchored(anchor: Column, word: Column) -> tuple[Column, Column]:
    """The top of the line's first word, and whether a word starts a line."""
    here = F.coalesce(F.abs(word["top"] - anchor) <= rules.LINE_TOLERANCE, F.lit(False))
    return F.when(here, anchor).otherwise(word["top"]), ~here


def lines(words: DataFrame) -> DataFrame:
    """(document_id, page, line_no, top, text) of word boxes, as ``cluster_lines`` says for one page."""
    word = F.struct(F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), "text")
    clean = words.select("document_id", F.col("page").cast("int").alias("page"), word.alias("w"))
    # gathering saves no rows before the exchange, so rows go first and are gathered where they meet
    pages = clean.repartition("document_id", "page").groupBy("document_id", "page").agg(F.sort_array(F.collect_list("w")).alias("w"))
    pages = pages.withColumn("starts", arrays.starts_of(arrays.fold(F.col("w"), F.lit(None).cast("double"), _anchored, "boolean")))
    pages = pages.withColumn("texts", F.col("w")["text"])
    tops = F.transform("starts", lambda a: F.get("w", a - 1)["top"])
    found = pages.select("document_id", "page", F.posexplode_outer(F.arrays_zip(tops.alias("top"), arrays.joined_runs(F.col("texts"), F.col("starts"), " ").alias("text"))).alias("line_no", "line"))
    # no glyph holds a space, so a line's are those of its words
    return found.select("document_id", "page", "line_no", F.col("line.top").alias("top"), text.fix_glyphs(F.col("line.text")).alias("text"))


def paragraphs(words: DataFrame) -> DataFrame:
    """(document_id, pos, paragraph) of word boxes: lines, paragraphs by spacing, fragments rejoined across pages."""
    on_page = paragraphs_by_gap(lines(words), ["document_id", "page"])
    placed = on_page.withColumn("at", F.struct("page", "line_no"))
    torn = placed.select("document_id", F.col("at").alias("pos"), "text", (F.col("line_no") == 0).alias("starts_page"))
    whole = rejoin(torn, ["document_id"], page_start=F.col("starts_page"))
    return whole.select("document_id", F.col("pos.page").cast("long").alias("page"), (F.col("pos.page") * 1_000_000 + F.col("pos.line_no")).alias("pos"), F.col("text").alias("paragraph"))


def page_methods(pages: DataFrame, min_chars: int = rules.PAGE_TEXT_CHARS) -> DataFrame:
    """A page (with n_chars, has_image) is read as text if it has enough text or no image, else by OCR."""
    return pages.withColumn("method", F.when((F.col("n_chars") >= min_chars) | ~F.col("has_image"), "text").otherwise("ocr"))


def normalised(words: DataFrame, width: str, height: str) -> DataFrame:
    return words.withColumns({"x0": F.col("x0") / F.col(width), "x1": F.col("x1") / F.col(width), "top": F.col("top") / F.col(height), "bottom": F.col("bottom") / F.col(height)})


def ocr_words(rows: DataFrame, width: float, height: float) -> DataFrame:
    """OCR result rows (level, conf, left, top, width, height, text as strings) to word boxes in page fractions."""
    num = lambda c: F.expr(f"try_cast({c} as double)")
    good = rows.where((F.col("level") == "5") & (num("conf") >= 0) & (F.trim("text") != ""))
    return good.select(
        *[c for c in rows.columns if c not in ("level", "conf", "left", "top", "width", "height", "text")],
        (num("left") / width).alias("x0"), (num("top") / height).alias("top"), ((num("left") + num("width")) / width).alias("x1"), ((num("top") + num("height")) / height).alias("bottom"), F.trim("text").alias("text"),
    )


#: Openings of a clause that are looked up, in tokens, longest first; of three only what is a whole clause.
_OPENINGS = (4, 3, 2, 1)
#: Tokens from the cursor on at which an opening is sought before a document's runs are sorted, in steps; fewer than the search window.
_CLOSE = (16, 512)


def _gram(codes: Column, first: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(codes, first + i) for i in range(k)])


def _runs(codes: Column, k: int) -> Column:
    n = F.size(codes) - (k - 1)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda j: F.struct(_gram(codes, j, k).alias("gram"), j.alias("at")))


def _first(index: Column, halves: Column, gram: Column, low: Column) -> Column:
    """The first place of a run at ``low`` or after it, or null."""

    def found(key: Column) -> Column:
        before = F.aggregate(halves, F.lit(0), lambda n, h: F.when(F.get(index, n + h - 1) < key, n + h).otherwise(n))
        return arrays.once(before, lambda n: arrays.once(F.get(index, n), lambda x: F.when(x["gram"] == key["gram"], x["at"])))

    return arrays.once(F.struct(gram.alias("gram"), low.alias("at")), found)


def _hits(codes: Column, wanted: Column, start: Column) -> Column:
    """The places at which ``wanted`` is met from ``start`` on, in order, skipping up to MAX_SKIP tokens before each, and those not found."""

    def step(state: Column, token: Column) -> Column:
        place = F.coalesce(*[F.when(F.get(codes, state["at"] + i) == token, state["at"] + i) for i in range(rules.MAX_SKIP + 1)])
        return arrays.once(place, lambda p: F.struct(F.coalesce(p + 1, state["at"]).alias("at"), p.alias("hit")))

    zero = F.struct(start.alias("at"), F.lit(None).cast("int").alias("hit"))
    return F.array_compact(arrays.scan(wanted, zero, step, lambda s: s["hit"], "int"))


def _found(codes: Column, index: Column, halves: Column, cursor: Column, x: Column) -> Column:
    """The places of a clause's tokens (codes, tries), or null: its longest opening first, near the cursor before anywhere; no try is made once one holds."""
    covers = lambda h: (F.size(h) > 0) & (F.size(h) >= rules.MIN_COVERAGE * F.size(x["codes"]))
    aligned = lambda j: F.get(F.filter(F.array(_hits(codes, x["codes"], j)), covers), F.lit(0))

    def tried(t: Column) -> Column:
        fits = lambda j: ~t["near"] | (j + t["k"] <= F.least(F.size(codes), cursor + rules.SEARCH_WINDOW))
        return arrays.once(_first(index, halves, t["gram"], F.when(t["near"], cursor).otherwise(0)), lambda j: F.when(j.isNotNull() & fits(j), aligned(j)))

    return F.aggregate(x["tries"], F.lit(None).cast("array<int>"), lambda acc, t: F.when(acc.isNotNull(), acc).otherwise(tried(t)))


def _close(codes: Column, cursor: Column, wanted: Column, steps: tuple[int, ...]) -> Column:
    """(at, hits) of a clause whose longest opening is met close to the cursor: ``at`` if its tokens all follow there, ``hits`` if enough of them do.

    The first try of ``_found`` is the same, so what is found here is what is found there; null if it is to be made.
    """
    n = F.size(wanted)
    same = lambda j, i: (n <= i) | (F.get(codes, j + i) == F.get(wanted, F.lit(i)))
    opens = lambda j: same(j, 0) & same(j, 1) & same(j, 2) & same(j, 3)
    first = F.coalesce(*[F.get(F.filter(F.sequence(cursor + low, cursor + (high - 1)), opens), F.lit(0)) for low, high in zip((0, *steps), steps)])
    place = lambda at, hits: F.struct(at.alias("at"), hits.cast("array<int>").alias("hits"))
    covered = lambda j: F.get(F.filter(F.array(_hits(codes, wanted, j)), lambda h: F.size(h) >= rules.MIN_COVERAGE * n), F.lit(0))
    skipping = lambda j: arrays.once(covered(j), lambda h: F.when(h.isNotNull(), place(j, h)))
    return arrays.once(first, lambda j: F.when(j.isNotNull(), F.when(arrays.part(codes, j, n) == wanted, place(j, F.lit(None))).otherwise(skipping(j))))


def _same_line(line: Column, box: Column) -> tuple[Column, Column]:
    """The page and top of the line so far, and whether a box starts a line."""
    here = F.coalesce((line["page"] == box["page"]) & (F.abs(line["top"] - box["top"]) <= rules.SAME_LINE), F.lit(False))
    return F.struct(box["page"].alias("page"), F.when(here, F.least(line["top"], box["top"])).otherwise(box["top"]).alias("top")), ~here


def located(docs: DataFrame, texts: Column | None = None) -> DataFrame:
    """``docs`` (document_id, words, clauses: arrays in order) with ``found``, the (clause_id, words: numbers in order) of each clause located.

    ``texts`` are the words' texts, by default their field of that name.
    """
    tokens = docs.withColumn("t", F.transform(F.col("words")["text"] if texts is None else texts, text.layout_tokens))
    tokens = tokens.withColumns({"whole": ~F.exists("t", lambda t: F.size(t) == 0), "owner": F.flatten(F.transform("t", lambda t, i: F.array_repeat(i, F.size(t)))), "codes": F.transform(F.flatten("t"), lambda t: F.xxhash64(t))}).drop("t")
    codes = F.col("codes")
    asked = tokens.withColumn("c", F.transform("clauses", lambda x: F.transform(text.layout_tokens(x["text"]), lambda u: F.xxhash64(u))))
    # after a clause: the cursor, and the place of the clause as ``_close`` says, if any; ``lost`` from the first one on that is not found close to the cursor
    kind = "struct<cursor:int,at:int,hits:array<int>,lost:boolean>"
    state = lambda cursor, at, hits, lost: F.struct(cursor.cast("int").alias("cursor"), at.cast("int").alias("at"), hits.cast("array<int>").alias("hits"), lost.alias("lost"))
    stays = lambda s, lost: state(s["cursor"], F.lit(None), F.lit(None), lost)
    after = lambda p, t: state(F.coalesce(F.element_at(p["hits"], -1) + 1, p["at"] + F.size(t)), p["at"], p["hits"], F.lit(False))
    zero = state(F.lit(0), F.lit(None), F.lit(None), F.lit(False))
    asks = lambda t: F.coalesce(F.size(t) > 0, F.lit(False))
    close = lambda s, t: F.when(s["lost"] | ~asks(t), stays(s, s["lost"])).otherwise(arrays.once(_close(codes, s["cursor"], t, _CLOSE), lambda p: F.when(p.isNotNull(), after(p, t)).otherwise(stays(s, F.lit(True)))))
    asked = asked.withColumn("places", arrays.scan(F.col("c"), zero, close, lambda s: s, kind))
    asked = asked.withColumn("lost", F.exists("places", lambda s: s["lost"]))
    three = F.exists("c", lambda t: F.size(t) == 3)
    runs = F.concat(*[_runs(codes, k) for k in _OPENINGS if k != 3], F.when(three, _runs(codes, 3)).otherwise(F.slice(_runs(codes, 1), F.lit(1), F.lit(0))))
    # all runs of an opening's length in order of the run, then the place, so that a run is found by halving
    asked = asked.withColumn("index", F.when(F.col("lost"), F.sort_array(runs)))
    asked = asked.withColumn("halves", F.transform(F.sequence(F.floor(F.log2(F.greatest(F.size("index"), F.lit(1)))).cast("int"), F.lit(0)), lambda i: F.call_function("shiftleft", F.lit(1), i)))
    fits = lambda t, k: F.size(t) == 3 if k == 3 else F.size(t) >= k
    tries = lambda t: F.array_compact(F.array(*[F.when(fits(t, k), F.struct(F.lit(k).alias("k"), _gram(t, F.lit(0), k).alias("gram"), F.lit(near).alias("near"))) for k in _OPENINGS for near in (True, False)]))
    asked = asked.withColumn("x", F.when(F.col("lost"), F.transform("c", lambda t: F.struct(t.alias("codes"), tries(t).alias("tries")))))
    far = lambda s, x: arrays.once(_found(codes, F.col("index"), F.col("halves"), s["cursor"], x), lambda h: F.when(h.isNotNull(), F.struct(F.get(h, F.lit(0)).alias("at"), h.alias("hits"))))
    place = lambda s, x: F.when(asks(x["codes"]), F.coalesce(_close(codes, s["cursor"], x["codes"], _CLOSE[:1]), far(s, x)))
    again = arrays.scan(F.col("x"), zero, lambda s, x: arrays.once(place(s, x), lambda p: F.when(p.isNotNull(), after(p, x["codes"])).otherwise(stays(s, F.lit(False)))), lambda s: s, kind)
    held = asked.withColumn("places", F.when(F.col("lost"), again).otherwise(F.col("places")))
    # places ascend, and so do the words that own them; where each word has a token, no word is left out between two
    owners = lambda s: F.array_distinct(F.transform(F.coalesce(s["hits"], F.sequence(s["at"], s["cursor"] - 1)), lambda j: F.get("owner", j)))
    words = lambda s: F.when(F.col("whole") & s["hits"].isNull(), F.sequence(F.get("owner", s["at"]), F.get("owner", s["cursor"] - 1))).otherwise(owners(s))
    found = F.transform("places", lambda s, i: F.struct(F.get("clauses", i)["clause_id"].alias("clause_id"), F.when(s["at"].isNotNull(), words(s)).alias("words")))
    return held.withColumn("found", F.filter(found, lambda x: x["words"].isNotNull())).drop("c", "x", "places", "lost", "whole", "owner", "codes", "index", "halves")


def locations(words: DataFrame, clauses: DataFrame) -> DataFrame:
    """One row per line box of each located clause; words and clauses meet by document."""
    box = [F.col("page").cast("int").alias("page"), *[F.col(c).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom")]]
    # gathering saves no rows before the exchange, so rows go first and are gathered where they meet
    w = words.repartition("document_id").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pos", *box, "text"))).alias("words"))
    c = clauses.repartition("document_id").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "clause_id", "text"))).alias("clauses"))
    return locations_of(w.join(c, "document_id"))


def locations_of(docs: DataFrame) -> DataFrame:
    """As ``locations``, where a document is one row with arrays of words and clauses in order; no exchange is needed."""
    held = located(docs).withColumn("found", F.transform("found", lambda x: F.struct(x["clause_id"].alias("clause_id"), F.transform(x["words"], lambda i: F.get("words", i).dropFields("pos", "text")).alias("boxes"))))
    line = F.struct(F.lit(None).cast("int").alias("page"), F.lit(None).cast("double").alias("top"))
    held = held.withColumn("found", F.transform("found", lambda x: F.struct(x["clause_id"].alias("clause_id"), x["boxes"].alias("boxes"), arrays.starts_of(arrays.fold(x["boxes"], line, _same_line, "boolean")).alias("starts"))))
    end = lambda x, k: F.coalesce(F.get(x["starts"], k + 1), F.size(x["boxes"]) + 1)
    runs = lambda x: F.transform(x["starts"], lambda at, k: arrays.part(x["boxes"], at - 1, end(x, k) - at))
    of = lambda b, c, f: F.round(f(F.transform(b, lambda y: y[c])), 4).alias(c)
    merged = lambda b, k: F.struct(k.cast("int").alias("line"), F.get(b, F.lit(0))["page"].alias("page"), of(b, "x0", F.array_min), of(b, "top", F.array_min), of(b, "x1", F.array_max), of(b, "bottom", F.array_max))
    held = held.withColumn("found", F.transform("found", lambda x: F.struct(x["clause_id"].alias("clause_id"), F.transform(runs(x), merged).alias("lines"))))
    # outer, so that no filter on the arrays is pushed down, which would spell all steps again
    each = held.select("document_id", F.inline_outer("found")).where("clause_id IS NOT NULL")
    return each.select("document_id", "clause_id", F.inline("lines"))


def boxes_by_page(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("document_id", "page", "clause_id").agg(F.array_sort(F.collect_list(F.struct("line", "x0", "top", "x1", "bottom"))).alias("boxes"), F.min_by("top", "line").alias("margin_top"), F.max_by("bottom", "line").alias("margin_bottom"))
