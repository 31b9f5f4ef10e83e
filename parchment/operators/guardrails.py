"""Guardrails over generated text: grounding, reply parsing, violations, attempt selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text


def any_of(t: Column, patterns) -> Column:
    return F.regexp_like(t, F.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns)))


def _tokens(document_says: Column, concern: Column, how: Column, clause: Column) -> dict[str, Column]:
    """What the checks of a grounding read, each computed once."""
    return {
        "everything": F.concat_ws(" ", document_says, concern, how),
        "new_numbers": F.array_except(text.numbers(document_says), text.numbers(clause)),
        "says": text.grounding_words(document_says),
        "source": text.grounding_words(clause),
    }


def _flags(t: dict[str, Column], concern: Column, label: Column, support: Column, retrieved: Column) -> dict[str, Column]:
    shared = F.size(F.array_intersect(t["says"], t["source"]))
    ratio = F.when(F.size(t["says"]) > 0, shared / F.size(t["says"])).otherwise(0.0)
    return {
        "CITATION_RESTRICTED": F.size(F.array_except(support, retrieved)) == 0,
        "NO_SMUGGLED_CITATION": (F.regexp_count(t["everything"], F.lit(rules.STATUTE_REFERENCE)) == 0) | (F.size(support) > 0),
        "DOCUMENT_GROUNDED": (F.size(t["new_numbers"]) == 0) & ((ratio >= rules.MIN_OVERLAP_RATIO) | (shared >= rules.MIN_OVERLAP_WORDS)),
        "NO_LEGAL_CONCLUSION": ~any_of(t["everything"], rules.CONCLUSIONS),
        "CONCERN_PRESENT": ~label.isin("YELLOW", "RED") | (F.length(F.trim(concern)) >= rules.MIN_CONCERN_CHARS),
    }


_REASONS = {
    "CITATION_RESTRICTED": "cites an entry that was not retrieved",
    "NO_SMUGGLED_CITATION": "names a statute without citing one",
    "DOCUMENT_GROUNDED": "not supported by the clause",
    "NO_LEGAL_CONCLUSION": "states a legal conclusion",
    "CONCERN_PRESENT": "no concern given",
}


def _verdict(flags: Column) -> Column:
    """struct(checks map, reasons map, passed) of an array of flags in the order of ``_REASONS``."""
    names = text.strings(_REASONS)
    told = F.arrays_zip(names.alias("name"), text.strings(_REASONS.values()).alias("why"), flags.alias("ok"))
    failed = F.filter(told, lambda x: ~x["ok"])
    reasons = F.map_from_entries(F.transform(failed, lambda x: F.struct(x["name"], x["why"])))
    return F.struct(F.map_from_arrays(names, flags).alias("checks"), reasons.alias("reasons"), F.forall(flags, lambda x: x).alias("passed"))


def grounding(document_says: Column, concern: Column, label: Column, support: Column, how: Column, clause: Column, retrieved: Column) -> Column:
    """struct(checks map, reasons map, passed) of one explanation, as one expression; ``grounded`` is for tables.

    ``support`` are cited ids and ``retrieved`` the ids offered; ``how`` is the text of how the citations apply.
    """
    flags = _flags(_tokens(document_says, concern, how, clause), concern, label, support, retrieved)
    return _verdict(F.array(*[F.coalesce(x, F.lit(False)) for x in flags.values()]))


def grounded(df: DataFrame, document_says: Column, concern: Column, label: Column, support: Column, how: Column, clause: Column, retrieved: Column, where: Column | None = None, out: str = "grounding") -> DataFrame:
    """``df`` with ``out``, as ``grounding`` has it; words, numbers and flags are columns of their own, so each text is read once.

    Rows for which ``where`` does not hold get null.
    """
    tokens = _tokens(document_says, concern, how, clause)
    names = {t: f"_{out}_{t}" for t in tokens}
    held = df.withColumns({names[t]: c if where is None else F.when(where, c) for t, c in tokens.items()})
    flags = _flags({t: F.col(c) for t, c in names.items()}, concern, label, support, retrieved)
    held = held.withColumn(f"_{out}_flags", F.array(*[F.coalesce(x, F.lit(False)) for x in flags.values()]))
    verdict = _verdict(F.col(f"_{out}_flags"))
    return held.withColumn(out, verdict if where is None else F.when(where, verdict)).drop(*names.values(), f"_{out}_flags")


def parse(content: Column, schema: str) -> Column:
    """The JSON object in a reply; null if there is none or it does not parse."""
    return F.from_json(text.json_object(content), schema, {"mode": "PERMISSIVE"})


EXPLANATION = "document_says string, concern string, statute_support array<struct<entry_id:string,how_it_applies:string>>"
ANSWER = "answer string, cited_clauses array<string>, cited_statutes array<string>, out_of_scope boolean"
CONNECTION = "related boolean, relationship_type string, explanation string"
LABEL = "label string, probabilities map<string,double>"


def parse_explanation(content: Column) -> Column:
    """struct(document_says, concern, statute_support, error); entries without an id are dropped."""
    x = parse(content, EXPLANATION)
    raw = F.get_json_object(text.json_object(content), "$.statute_support")
    support = F.filter(F.coalesce(x["statute_support"], F.array()), lambda e: F.coalesce(F.trim(e["entry_id"]), F.lit("")) != "")
    error = F.when(text.json_object(content).isNull() | x.isNull(), "no JSON object").when(raw.isNotNull() & ~F.startswith(F.ltrim(raw), F.lit("[")), "statute_support is not a list").when(F.coalesce(F.trim(x["document_says"]), F.lit("")) == "", "document_says is empty")
    return F.struct(F.trim(x["document_says"]).alias("document_says"), F.trim(x["concern"]).alias("concern"), support.alias("statute_support"), error.alias("error"))


def parse_answer(content: Column) -> Column:
    x = parse(content, ANSWER)
    keep = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != "")
    answer = F.nullif(F.trim(x["answer"]), F.lit(""))
    return F.when(answer.isNotNull(), F.struct(answer.alias("answer"), keep(x["cited_clauses"]).alias("cited_clauses"), keep(x["cited_statutes"]).alias("cited_statutes"), F.coalesce(x["out_of_scope"], F.lit(False)).alias("out_of_scope")))


def parse_connection(content: Column) -> Column:
    x = parse(content, CONNECTION)
    return F.when(F.get_json_object(text.json_object(content), "$.related").isNotNull(), x)


def parse_label(content: Column, labels=rules.LABELS) -> Column:
    """Probabilities by label, consistent with the stated label; null if the label is not known."""
    x = parse(content, LABEL)
    label = F.upper(F.trim(x["label"]))
    return F.when(label.isin(*labels), normal_probabilities(label, x["probabilities"], labels))


def normal_probabilities(label: Column, given: Column, labels=rules.LABELS) -> Column:
    """Negatives clamp to 0; without a positive sum 0.8 / 0.1 / 0.1; the stated label never has less than the top."""
    raw = F.transform(text.strings(labels), lambda k: F.greatest(F.coalesce(F.try_element_at(given, k), F.lit(0.0)), F.lit(0.0)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    at = F.array_position(text.strings(labels), label).cast("int")
    even = F.transform(text.strings(labels), lambda k: F.when(k == label, 0.8).otherwise(0.1))
    p = F.when(total > 0, F.transform(raw, lambda v: v / total)).otherwise(even)
    top = F.array_max(p)
    lifted = F.transform(p, lambda v, i: F.when(i == at - 1, top).otherwise(v))
    whole = F.aggregate(lifted, F.lit(0.0), lambda a, v: a + v)
    fixed = F.when(F.array_position(p, top) == at, p).otherwise(F.transform(lifted, lambda v: v / whole))
    return F.map_from_arrays(text.strings(labels), fixed)


def argmax(probabilities: Column, labels=rules.LABELS) -> Column:
    values = F.transform(text.strings(labels), lambda k: F.coalesce(F.try_element_at(probabilities, k), F.lit(0.0)))
    return F.element_at(text.strings(labels), F.array_position(values, F.array_max(values)).cast("int"))


def violations(answer: Column, question: Column, context: Column, citations: Column, excerpts: Column) -> Column:
    """Problems of a reply: verdict, uncited_law, invented_number.  ``context``, ``citations`` and ``excerpts`` are arrays of text."""
    offered = F.lower(F.array_join(citations, " "))
    law = F.regexp_extract_all(answer, F.lit(rules.STATUTE_REFERENCE), 0)
    allowed = text.numbers(F.concat_ws(" ", question, F.array_join(context, " "), F.array_join(excerpts, " "), F.array_join(citations, " ")))
    stated = text.numbers(F.regexp_replace(F.regexp_replace(answer, rules.LIST_MARKER, " "), rules.ID_TOKEN, " "))
    return F.array_compact(
        F.array(
            F.when(any_of(answer, rules.VERDICTS), "verdict"),
            F.when(F.exists(law, lambda m: ~F.contains(offered, F.lower(m))), "uncited_law"),
            F.when(F.size(F.array_except(stated, allowed)) > 0, "invented_number"),
        )
    )


def select_attempts(attempts: DataFrame, key: str = "q_id", limit: int = 2) -> DataFrame:
    """One outcome per question from its attempts (attempt, answer, problems, out_of_scope).

    Attempts stop after the first safe reply with bullets or out of scope.  The latest safe reply
    seen is used; without one, the last attempt's problems choose the fallback.
    """
    safe = F.col("answer").isNotNull() & (F.size("problems") == 0)
    good = safe & (F.col("out_of_scope") | F.regexp_like("answer", F.lit(rules.BULLET)))
    seen = attempts.where(F.col("attempt") <= limit)
    seen = seen.withColumn("stop", F.min(F.when(good, F.col("attempt"))).over(W.partitionBy(key)))
    seen = seen.where(F.col("stop").isNull() | (F.col("attempt") <= F.col("stop")))
    out = seen.groupBy(key).agg(F.max_by(F.when(safe, F.col("answer")), F.when(safe, F.col("attempt"))).alias("answer"), F.max_by("problems", "attempt").alias("last_problems"), F.max("attempt").alias("attempts"))
    outcome = F.when(F.col("answer").isNotNull(), "answered").when(F.array_contains("last_problems", "verdict"), "verdict fallback").otherwise("unreliable fallback")
    return out.select(key, "answer", outcome.alias("outcome"), "attempts")


def known_citations(cited: Column, known: Column) -> Column:
    """Cited ids that were offered, each once, in the order cited."""
    return F.filter(F.array_distinct(cited), lambda c: F.array_contains(known, c))


def confirmed(shortlist: DataFrame, replies: DataFrame) -> DataFrame:
    """Shortlisted pairs whose reply says that they are related; pairs without a usable reply are skipped."""
    parsed = replies.withColumn("reply", parse_connection(F.col("content")))
    return shortlist.join(parsed, ["a", "b"]).where(F.col("reply.related")).select(*shortlist.columns, "reply.relationship_type", "reply.explanation")


def messages(system: Column, context: Column, history: Column, question: Column, reminder: Column) -> Column:
    """Two system messages, the history turns, and the question with the format reminder."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.concat(F.array(say("system", system), say("system", context)), history, F.array(say("user", F.concat_ws("\n\n", question, reminder))))


def explanation_prompt(clause: Column, label: Column, statutes: Column) -> Column:
    listed = F.array_join(F.transform(statutes, lambda s: F.concat(F.lit("- ["), s["entry_id"], F.lit("] "), s["citation"], F.lit(": "), s["excerpt_text"])), "\n")
    none = F.lit("No statute was retrieved; cite none.")
    return F.concat(F.lit("Clause ("), label, F.lit("):\n"), clause, F.lit("\n\nStatutes:\n"), F.when(F.size(statutes) > 0, listed).otherwise(none))


def classify(clauses: DataFrame, llm: DataFrame, trained: DataFrame, approach: str = "llm", keys: tuple[str, ...] = ("clause_id",)) -> DataFrame:
    """Probabilities by approach (llm falls back to trained, ensemble is the mean of both); tables are (keys, probabilities)."""
    if approach not in ("llm", "trained", "ensemble"):
        raise ValueError(f"unknown approach: {approach}")
    both = clauses.join(llm.withColumnRenamed("probabilities", "p_llm"), [*keys], "left").join(trained.withColumnRenamed("probabilities", "p_trained"), [*keys], "left")
    mean = F.map_zip_with("p_llm", "p_trained", lambda k, a, b: (a + b) / 2)
    p = {"llm": F.coalesce("p_llm", "p_trained"), "trained": F.col("p_trained"), "ensemble": mean}[approach]
    used = F.when((F.lit(approach) == "llm") & F.col("p_llm").isNull(), "trained (llm fallback)").otherwise(approach)
    out = both.withColumn("probabilities", F.when(F.trim("text") != "", p)).withColumn("approach", used)
    out = out.withColumn("error", F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "blank text").when(F.col("probabilities").isNull(), "classification failed"))
    label = argmax(F.col("probabilities"))
    return out.withColumn("label", F.when(F.col("error").isNull(), label)).withColumn("confidence", F.array_max(F.map_values("probabilities"))).drop("p_llm", "p_trained")
