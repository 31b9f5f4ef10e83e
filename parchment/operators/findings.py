"""Findings, lookups and reports around a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from .ordering import risk_rank


def linked(connections: DataFrame, key: str = "clause_id", a: str = "clause_id_a", b: str = "clause_id_b") -> DataFrame:
    """A row per connection and clause that it touches on either side; one row where both sides are one clause."""
    sides = F.array_distinct(F.array(a, b))
    return connections.withColumn(key, F.explode(sides)).where(F.col(key).isNotNull())


def partition_counts(clauses: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Issues (any label but GREEN) and standard clauses."""
    return clauses.groupBy(*keys).agg(F.count_if(F.col(label) != "GREEN").alias("n_issues"), F.count_if(F.col(label) == "GREEN").alias("n_standard"))


def first_important(clauses: DataFrame, key: str, clause: str, label: str, order: str) -> DataFrame:
    """The first RED clause of each document, else the first YELLOW one, else null."""
    at = F.when(F.col(label).isin("RED", "YELLOW"), F.struct(risk_rank(F.col(label)).alias("risk"), F.col(order).alias("at"), F.col(clause).alias("clause")))
    return clauses.groupBy(key).agg(F.min(at).alias("low")).select(key, F.col("low.clause").alias(clause))


def shown_support(support: DataFrame, retrieved: DataFrame, keys: list[str], entry: str = "entry_id") -> DataFrame:
    """Each support with the citation of its retrieved entry; the bare id where that entry was not retrieved."""
    known = retrieved.select(*keys, entry, "citation", "source_url").dropDuplicates([*keys, entry])
    return support.join(known, [*keys, entry], "left").withColumn("shown", F.coalesce("citation", F.col(entry).cast("string")))


def resolved(rows: DataFrame, table: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """``rows`` with the columns of ``table``; with ``strict``, a row that resolves to nothing stops the run."""
    if strict:
        lost = rows.join(table.select(key), key, "left_anti").select(key).limit(3).collect()
        if lost:
            raise ValueError(f"rows without a match, such as {[r[0] for r in lost]}")
    return rows.join(table, key, "left")


def counterpart(name: Column, reports: list[str], prefix: str = "Trained") -> Column:
    """The first report whose name holds the last word of ``name``, or shares the prefix; suffixes in brackets do not count."""
    base = F.split_part(name, F.lit(" ("), F.lit(1))
    last = F.element_at(F.split(F.trim(F.lower(base)), r"\s+"), -1)
    known = F.array(*[F.lit(r) for r in reports]) if reports else F.array().cast("array<string>")
    fits = F.filter(known, lambda k: F.contains(F.lower(k), last) | (base.startswith(prefix) & k.startswith(prefix)))
    return F.get(fits, F.lit(0))


def misses(df: DataFrame, true: str, predicted: str, label: str = "RED") -> DataFrame:
    """The rows of a label that were predicted as another, or not at all."""
    return df.where((F.col(true) == label) & ~F.col(predicted).eqNullSafe(F.lit(label)))


def margin(boxes: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Top of the first box and bottom of the last, and the height between them."""
    out = boxes.groupBy(*keys).agg(F.min_by("top", position).alias("top"), F.max_by("bottom", position).alias("bottom"))
    return out.withColumn("height", F.col("bottom") - F.col("top"))


def leakage(rows: DataFrame, closest: DataFrame, block: str, id_column: str, split: str = "split", threshold: float = rules.DEDUP_SIMILARITY, close: float = rules.CLOSE_SIMILARITY) -> DataFrame:
    """One row on a train/test split: shared blocks and ids, the highest similarity across, test rows with a close train row, sizes.

    ``closest`` has ``max_similarity``, one row per test row.  Blocks and ids are counted by aggregation, not by a join of the sides.
    """

    def shared(column: str) -> DataFrame:
        return rows.groupBy(column).agg(F.count_distinct(split).alias("sides")).agg(F.count_if(F.col("sides") > 1).alias(f"shared_{column}"))

    sizes = rows.agg(F.count_if(F.col(split) == "test").alias("test_size"), F.count_if(F.col(split) == "train").alias("train_size"))
    near = closest.agg(F.max("max_similarity").alias("max_similarity"), F.count_if(F.col("max_similarity") >= close).alias("close_rows"))
    one = sizes
    for part in (shared(block), shared(id_column), near):
        one = one.crossJoin(F.broadcast(part))  # one row by one row
    clean = (F.col(f"shared_{block}") == 0) & (F.col(f"shared_{id_column}") == 0) & (F.coalesce("max_similarity", F.lit(-1.0)) < threshold)
    return one.withColumn("clean", clean)


def combined(real: DataFrame, synthetic: DataFrame, group: str = "group", offset: int = rules.SYNTHETIC_GROUP_OFFSET) -> DataFrame:
    """Both training sets as one; groups of the synthetic set are moved so that they meet none of the real set."""
    return real.unionByName(synthetic.withColumn(group, F.col(group) + F.lit(offset)))


def askable(requests: DataFrame, analyses: DataFrame, clauses: DataFrame) -> DataFrame:
    """Chat requests (document_id, clause_id or null) whose document has a finished analysis and whose clause exists."""
    done = analyses.where((F.col("status") == "done") & F.col("result").isNotNull()).select("document_id").distinct()
    ready = requests.join(done, "document_id", "left_semi")
    pairs = clauses.select("document_id", "clause_id").distinct()
    return ready.where("clause_id IS NULL").unionByName(ready.join(pairs, ["document_id", "clause_id"], "left_semi").select(*ready.columns))


def pending(work: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """Work without a reply yet; running it again after a stop asks for these only."""
    return work.join(replies.select(key), key, "left_anti")


def completed_prefix(work: DataFrame, replies: DataFrame, keys: list[str], position: str, key: str) -> DataFrame:
    """Per group, how many rows from the start have a reply before the first that has none, and whether all have."""
    asked = work.join(replies.select(key).distinct().withColumn("_has", F.lit(True)), key, "left")
    gap = F.min(F.when(F.col("_has").isNull(), F.col(position)))
    ends = asked.groupBy(*keys).agg(gap.alias("_gap"), F.count("*").alias("n_rows"))
    done = asked.join(ends.select(*keys, "_gap"), keys).where(F.col("_gap").isNull() | (F.col(position) < F.col("_gap"))).groupBy(*keys).agg(F.count("*").alias("n_done"))
    return ends.join(done, keys, "left").select(*keys, "n_rows", F.coalesce("n_done", F.lit(0)).alias("n_done"), F.col("_gap").isNull().alias("complete"))


def vector_key(text: Column) -> Column:
    return F.sha1(text)


def cached_vectors(texts: DataFrame, cache: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with their vector, distinct texts that the cache (key, vector) lacks); the key is by text, so a new text recomputes no other."""
    keyed = texts.withColumn("key", vector_key(F.col(text)))
    return keyed.join(cache.select("key", "vector"), "key"), keyed.join(cache.select("key"), "key", "left_anti").select("key", text).dropDuplicates(["key"])


def ocr_pages(pages: DataFrame, key: str) -> DataFrame:
    """The numbers of the pages that were read by OCR, in order."""
    return pages.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("method") == "ocr", F.col("number")))).alias("ocr_page_numbers"))


def clause_rows(clauses: DataFrame) -> DataFrame:
    """Clauses as callers see them: ``order`` for order_index, and [] where there are no boxes."""
    return clauses.select("clause_id", F.col("order_index").alias("order"), "clause_number", "section_heading", "text", F.coalesce("boxes", F.array()).alias("boxes"))


def numbered_selection(selection: DataFrame, clauses: DataFrame, order: str, strict: bool = True) -> DataFrame:
    """For each (pos, form, number, hint or null) the first clause of that form and number whose text holds the hint, as IN-01, IN-02, ...

    With ``strict`` a selection that finds nothing stops the run.
    """
    hit = selection.join(clauses, ["form", "number"], "left")
    hit = hit.withColumn("_fits", F.col("text").isNotNull() & (F.col("hint").isNull() | F.contains("text", "hint")))
    first = F.row_number().over(W.partitionBy("pos").orderBy(F.col("_fits").desc(), order))
    chosen = hit.withColumn("_first", first).where("_first = 1")
    if strict and (lost := chosen.where("NOT _fits").first()):
        raise ValueError(f"clause {lost['number']} not found in {lost['form']}")
    return chosen.where("_fits").drop("_first", "_fits").withColumn("id", F.format_string("IN-%02d", F.col("pos") + 1))


def few_shot_messages(system: Column, shots: list[tuple[str, str]], text: Column, labels=rules.LABELS) -> Column:
    """The prompt of a classifier with examples: each shot is a question and an answer that gives its label 0.9 and the others 0.05."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    out = [say("system", system)]
    for shot, label in shots:
        shares = ", ".join(f'"{x}": {0.9 if x == label else 0.05}' for x in labels)
        out += [say("user", F.lit(f"Clause: {shot}")), say("assistant", F.lit(f'{{"label": "{label}", "probabilities": {{{shares}}}}}'))]
    return F.array(*out, say("user", F.concat(F.lit("Clause: "), text)))
