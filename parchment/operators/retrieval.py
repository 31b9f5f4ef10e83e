"""Ranked retrieval under isolation rules.

Filtering precedes scoring: candidates come from the bridge of (state, topic) to
entries, entries of another state are dropped, and only then are words compared.
The knowledge base is reference data of bounded size; Spark broadcasts it by its
own size estimate and falls back to a shuffle join on entry_id beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays, rules, text


def with_words(entries: DataFrame, *columns: str, stop=rules.RETRIEVAL_STOP_WORDS) -> DataFrame:
    """Entries with the distinct words of their searchable columns, tokenised once."""
    return entries.withColumn("entry_words", text.retrieval_words(F.concat_ws(" ", *columns), stop))


def relevance(query_words: Column, entry_words: Column) -> Column:
    return F.size(F.array_intersect(query_words, entry_words))


def retrieve(queries: DataFrame, bridge: DataFrame, entries: DataFrame, query_id: str = "query_id", central: bool = False, states=rules.STATES, strict: bool = False) -> DataFrame:
    """Ranked candidates of each query (query_id, jurisdiction, topic, text): score desc, entry_id asc; no limit.

    ``bridge`` is (jurisdiction, topic, entry_id); ``entries`` has entry_id, jurisdiction and entry_words.
    Null states and topics retrieve nothing; nor do unsupported states, which with ``strict`` stop the run.
    """
    if strict:
        known = F.col("jurisdiction").isNull() | F.col("jurisdiction").isin(*states)
        queries = queries.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("unsupported jurisdiction: "), "jurisdiction")).cast("boolean")))
    asked = queries.where(F.col("jurisdiction").isin(*states) & F.col("topic").isNotNull()).withColumn("query_words", text.retrieval_words(F.col("text")))
    own = bridge.select(F.col("jurisdiction").alias("b_jurisdiction"), F.col("topic").alias("b_topic"), "entry_id").distinct()
    match = (F.col("jurisdiction") == F.col("b_jurisdiction")) & (F.col("topic") == F.col("b_topic"))
    wanted = asked
    if central:
        wanted = asked.withColumn("look", F.explode(F.array("jurisdiction", F.lit(rules.CENTRAL))))
        match = (F.col("look") == F.col("b_jurisdiction")) & (F.col("topic") == F.col("b_topic"))
    kb = entries.withColumnRenamed("jurisdiction", "entry_jurisdiction").drop("topic", "text")
    # scored in the join with the reference data, so that no word list is shuffled
    found = wanted.join(own, match).join(kb, "entry_id").withColumn("score", relevance(F.col("query_words"), F.col("entry_words")))
    # the other states' entries never pass, whatever the bridge says
    found = found.where((F.col("entry_jurisdiction") == F.col("jurisdiction")) | (F.col("entry_jurisdiction") == rules.CENTRAL))
    # an entry comes twice only if the bridge names it for the state and for Central
    found = found.drop("b_jurisdiction", "b_topic", "query_words", "entry_words", "look")
    best = F.row_number().over(W.partitionBy(query_id).orderBy(F.col("score").desc(), F.col("entry_id"))) - 1
    again = F.row_number().over(W.partitionBy(query_id, "score", "entry_id").orderBy("entry_jurisdiction")) if central else F.lit(1)
    if central:
        found = found.repartition(query_id).withColumn("again", again).where("again = 1").drop("again")
    return found.withColumn("rank", best + 1)


def retrieved_arrays(queries: DataFrame, ranked: DataFrame, query_id: str = "query_id") -> DataFrame:
    """All queries, with their ranked entry ids; [] where nothing is retrieved."""
    lists = ranked.groupBy(query_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry_id"))), lambda x: x["entry_id"]).alias("retrieved"))
    return queries.join(lists, query_id, "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))


def ranked_lists(queries: DataFrame, bridge: DataFrame, entries: DataFrame, query: str = "text", states=rules.STATES) -> DataFrame:
    """All queries (jurisdiction, topic, ``query``: text) with ``retrieved``: the ids that ``retrieve`` ranks with ``central``, in one pass.

    A query meets the entries of its state and topic as one list and ranks them in its row, so that queries, which may be
    costly to make, are read once and need no id.  The lists are reference data of bounded size and are broadcast.
    """
    of = F.col("jurisdiction")
    own = bridge.select(F.explode(F.filter(text.strings(states), lambda s: (of == s) | (of == rules.CENTRAL))).alias("b_jurisdiction"), F.col("topic").alias("b_topic"), "entry_id").distinct()
    # the other states' entries never pass, whatever the bridge says
    held = own.join(entries.select("entry_id", "jurisdiction", "entry_words"), "entry_id").where((of == F.col("b_jurisdiction")) | (of == rules.CENTRAL))
    lists = held.groupBy("b_jurisdiction", "b_topic").agg(F.collect_list(F.struct("entry_id", "entry_words")).alias("b_entries"))
    # no score, of a text or an entry that is null, comes last
    place = lambda words, e: F.struct(F.coalesce(-relevance(words, e["entry_words"]), F.lit(1)).alias("place"), e["entry_id"].alias("entry_id"))
    ranked = arrays.once(text.retrieval_words(F.col(query)), lambda words: F.array_sort(F.array_distinct(F.transform("b_entries", lambda e: place(words, e)))))
    found = queries.join(F.broadcast(lists), (of == F.col("b_jurisdiction")) & (F.col("topic") == F.col("b_topic")), "left")
    return found.withColumn("retrieved", F.when(F.col("b_entries").isNull(), F.array().cast("array<string>")).otherwise(F.transform(ranked, lambda x: x["entry_id"]))).drop("b_jurisdiction", "b_topic", "b_entries")


def central_policy(states=rules.STATES) -> list[dict]:
    return [{"jurisdiction": s, "own": True, "central": "opt-in, same topic", "other": False} for s in states]


def traceable(retrieved: Column, field: str, claimed: Column) -> Column:
    """Does some retrieved entry have exactly this citation, excerpt or URL?"""
    return F.exists(retrieved, lambda e: e[field] == claimed)


def tagged(entries: DataFrame, state: Column, tag: Column) -> DataFrame:
    """Array membership: entries of the state that carry the tag, by id."""
    return entries.where((F.col("jurisdiction") == state) & F.array_contains("topic_tags", tag))


def violations(entries: DataFrame, required=("entry_id", "jurisdiction", "citation", "excerpt_text", "source_url"), states=(*rules.STATES, rules.CENTRAL)) -> DataFrame:
    """(entry_id, problem) of entries that break the corpus rules."""
    problems = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", f"missing {c}") for c in required]
    problems += [
        F.when(~F.col("jurisdiction").isin(*states), "jurisdiction"),
        F.when(F.coalesce(F.size("topic_tags"), F.lit(0)) < 1, "no topic tags"),
        F.when(~F.col("source_url").rlike("^https?://"), "source_url scheme"),
        F.when(F.col("same_citation") > 1, "citation not unique"),
    ]
    return entries.withColumn("same_citation", F.count("*").over(W.partitionBy("citation"))).select("entry_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def coverage(arrays: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per jurisdiction: queries, those with a match, their share, and leaks of another state's entries."""
    leaks = ranked.where((F.col("entry_jurisdiction") != F.col("jurisdiction")) & (F.col("entry_jurisdiction") != rules.CENTRAL)).groupBy("jurisdiction").agg(F.count("*").alias("leaks"))
    n = arrays.groupBy("jurisdiction").agg(F.count("*").alias("queries"), F.count_if(F.size("retrieved") > 0).alias("matched"))
    return n.join(leaks, "jurisdiction", "left").select("jurisdiction", "queries", "matched", (F.col("matched") / F.col("queries")).alias("share"), F.coalesce("leaks", F.lit(0)).alias("leaks"))
