"""The review of a corpus in one plan (D3, R5, G1-G7, C1, C3, D1): clauses to topics, statutes, labels, checked explanations and links."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text
from . import guardrails, ordering, replies, retrieval, vectors

KEYS = ["document_id", "clause_id"]
_EXPLANATION = f"struct<{guardrails.EXPLANATION.replace(' array', ':array').replace(' string', ':string')},error:string>"
_GROUNDING = "struct<checks:map<string,boolean>,reasons:map<string,string>,passed:boolean>"


def placed(clauses: DataFrame, bridge: DataFrame, entries: DataFrame, states: DataFrame | None = None, topics=rules.TOPICS) -> DataFrame:
    """Each clause (document_id, order_index, clause_id, section_heading, text) with topic, jurisdiction and the ranked ids of its entries.

    ``states`` (document_id, jurisdiction) says each document's state; without it the first clause that names one decides.
    Clauses are read once: a document's state comes by a window over its clauses, and ids are ranked in a clause's row.
    """
    said, heading = F.col("text"), F.col("section_heading")
    whole, topic = text.headed(said, heading), text.topic(said, heading, topics)
    if topics == rules.TOPICS:
        topic = F.when(text.holds_any(whole, rules.TOPIC_WORDS), topic)
    if states is not None:
        return retrieval.ranked_lists(clauses.withColumn("topic", topic).join(states, "document_id", "left"), bridge, entries)
    hint = F.when(text.holds_any(whole, rules.STATE_WORDS), text.jurisdiction(said))
    hints = clauses.withColumns({"topic": topic, "_hint": hint})
    # of the texts that pass the window only those with a topic are ever searched with, so a caller that drops ``text`` moves no others
    some, kept = ordering.signalled("_hint"), F.when(F.col("topic").isNotNull(), said)
    told = hints.select("*", F.when(some, F.col("_hint.jurisdiction")).alias("_state"), F.when(some, F.col("order_index")).alias("_at"), kept.alias("_said")).drop("_hint")
    first = F.min_by("_state", "_at").over(W.partitionBy("document_id"))
    asked = told.withColumn("jurisdiction", F.when(F.col("document_id").isNotNull(), first)).drop("_state", "_at")
    return retrieval.ranked_lists(asked, bridge, entries, query="_said").drop("_said")


def review(clauses: DataFrame, bridge: DataFrame, entries: DataFrame, labels: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """The review without any provider: ``placed`` clauses with the ``labels`` (document_id, clause_id, label) given.

    Failures are columns: a clause without a label has ``error``.
    """
    out = placed(clauses, bridge, entries, states).join(labels, KEYS, "left")
    return out.withColumn("error", F.when(F.col("label").isNull(), "classification failed"))


class Saved(NamedTuple):
    """The requests of a review's model calls, as a client saved them: rows (keys, try, attempt, status, body, content, retry_after).

    ``labels`` and ``explanations`` are by document_id and clause_id, ``connections`` by document_id, clause_id_a and clause_id_b.
    None leaves a stage out: without ``explanations`` no clause is explained, and without ``connections`` none is linked.
    """

    labels: DataFrame | None = None
    explanations: DataFrame | None = None
    connections: DataFrame | None = None


class Analysis(NamedTuple):
    clauses: DataFrame
    links: DataFrame


def _labelled(content):
    p = guardrails.parse_label(content)
    return p, F.when(p.isNull(), "no label")


def _explained(content):
    x = guardrails.parse_explanation(content)
    return x, x["error"]


def _connected(content):
    x = guardrails.parse_connection(content)
    return x, F.when(x.isNull(), "no verdict")


def candidates(clauses: DataFrame, embedded: DataFrame, top: int = rules.SHORTLIST_TOP, threshold: float = rules.SHORTLIST_SIMILARITY) -> DataFrame:
    """(document_id, clause_id_a, clause_id_b, similarity): each clause's ``top`` most similar others of its document, in document order, each pair once."""
    near = vectors.shortlist_within(clauses.join(embedded, KEYS), "document_id", "order_index", "vector", top, threshold)
    names = clauses.select("document_id", "order_index", "clause_id")
    for side in "ab":
        near = near.join(names.withColumnsRenamed({"order_index": side, "clause_id": f"clause_id_{side}"}), ["document_id", side])
    return near.select("document_id", "clause_id_a", "clause_id_b", "similarity")


def analyse(clauses: DataFrame, bridge: DataFrame, entries: DataFrame, saved: Saved, trained: DataFrame, embedded: DataFrame | None = None, states: DataFrame | None = None, topics=rules.TOPICS, approach: str = "llm", limit: int = replies.MAX_RETRIES, top: int = rules.SHORTLIST_TOP, threshold: float = rules.SHORTLIST_SIMILARITY) -> Analysis:
    """The whole review: every clause placed, labelled, explained and checked, and the confirmed links between clauses of a document.

    A label comes from the model's saved replies, or from ``trained`` (document_id, clause_id, probabilities) where they
    give none.  A clause that cannot be labelled has an error and no explanation; one that cannot be explained keeps its
    label beside the error; a pair whose calls fail or that the reply calls unrelated is no link.  ``embedded`` (document_id,
    clause_id, vector at unit length) is what pairs are shortlisted by.  No stage stops another, and each can be rerun from
    the same saved rows.
    """
    found = placed(clauses, bridge, entries, states, topics)
    nothing = clauses.sparkSession.createDataFrame([], "document_id string, clause_id string, probabilities map<string,double>")
    told = nothing if saved.labels is None else replies.tried(replies.calls(saved.labels, KEYS, limit), KEYS, _labelled).select(*KEYS, F.col("value").alias("probabilities"))
    labelled = guardrails.classify(found, told, trained, approach, tuple(KEYS))
    why = F.when(F.col("label").isNull(), F.when(F.col("error") == "blank text", "classification failed: blank text").otherwise("classification failed"))
    labelled = labelled.withColumn("_why", why).drop("error", "probabilities")
    if saved.explanations is None:
        rows = labelled.withColumns({"explanation": F.lit(None).cast(_EXPLANATION), "grounding": F.lit(None).cast(_GROUNDING), "error": F.col("_why")})
    else:
        said = replies.tried(replies.calls(saved.explanations, KEYS, limit), KEYS, _explained)
        said = said.select(*KEYS, F.col("value").alias("explanation"), F.concat(F.lit(replies.FAILED), "error").alias("reply_error"))
        rows = replies.reviewed(labelled, said, KEYS)
        rows = rows.withColumn("error", F.coalesce("_why", "error"))
    rows = rows.drop("_why")
    pair = ["document_id", "clause_id_a", "clause_id_b"]
    if saved.connections is None or embedded is None:
        links = clauses.sparkSession.createDataFrame([], "document_id string, clause_id_a string, clause_id_b string, similarity double, relationship_type string, explanation string")
    else:
        told = replies.tried(replies.calls(saved.connections, pair, limit), pair, _connected)
        links = candidates(clauses, embedded, top, threshold).join(told, pair).where(F.col("value.related"))
        links = links.select(*pair, "similarity", F.trim("value.relationship_type").alias("relationship_type"), F.trim("value.explanation").alias("explanation"))
    return Analysis(rows, links)


def linked_clauses(analysis: Analysis) -> DataFrame:
    """The analysed clauses with ``links``, the (clause_id, relationship_type) of the clauses they are linked to, in order."""
    both = F.array(F.struct(F.col("clause_id_a").alias("clause_id"), F.col("clause_id_b").alias("to")), F.struct(F.col("clause_id_b").alias("clause_id"), F.col("clause_id_a").alias("to")))
    sides = analysis.links.withColumn("side", F.explode(both)).select("document_id", "side.clause_id", F.struct(F.col("side.to").alias("clause_id"), "relationship_type").alias("link"))
    gathered = sides.groupBy(*KEYS).agg(F.array_sort(F.collect_list("link")).alias("links"))
    return analysis.clauses.join(gathered, KEYS, "left")


def progress(analysis: Analysis) -> DataFrame:
    """Per document: clauses, those labelled, explained, passed and failed, and links."""
    n = analysis.clauses.groupBy("document_id").agg(F.count("*").alias("total"), F.count("label").alias("labelled"), F.count("explanation").alias("explained"), F.count_if("grounding.passed").alias("passed"), F.count("error").alias("failed"))
    m = analysis.links.groupBy("document_id").agg(F.count("*").alias("links"))
    return n.join(m, "document_id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
