"""Document store semantics on immutable DataFrames.

Every function returns new frames; writing them is the sinks' business.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules


def visible(df: DataFrame, owner: str, caller: Column) -> DataFrame:
    """Rows without an owner or of the caller; others look missing."""
    return df.where(F.col(owner).isNull() | (F.col(owner) == caller))


def owned(df: DataFrame, owner: str, caller: Column) -> DataFrame:
    """Listing: the caller's rows only; a null caller has none."""
    return df.where(F.col(owner) == caller)


def expired(df: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return df.where(F.col(expires).isNotNull() & (F.col(expires) <= now))


def expiry(created: Column, hours: int = rules.RETENTION_HOURS) -> Column:
    return created + F.make_dt_interval(hours=F.lit(hours))


def cascade_delete(parent: DataFrame, doomed: DataFrame, children: dict[str, DataFrame], key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parent and child tables without the doomed keys."""
    keys = doomed.select(key).distinct()
    return parent.join(keys, key, "left_anti"), {n: c.join(keys, key, "left_anti") for n, c in children.items()}


def purge(parent: DataFrame, now: Column, children: dict[str, DataFrame], key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    return cascade_delete(parent, expired(parent, now), children, key)


def stale(df: DataFrame, now: Column, minutes: int = rules.STALE_MINUTES) -> DataFrame:
    return df.where((F.col("status") == "running") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes))))


def startable(analyses: DataFrame, now: Column, states=rules.STATES) -> DataFrame:
    """Requests (with jurisdiction) that may start: supported or no state, and not running unless stale."""
    is_stale = F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(rules.STALE_MINUTES))
    return analyses.where((F.col("jurisdiction").isNull() | F.col("jurisdiction").isin(*states)) & ((F.coalesce("status", F.lit("")) != "running") | is_stale))


def describe(documents: DataFrame, analyses: DataFrame, now: Column, key: str = "document_id") -> DataFrame:
    """Status view: not_started by default, stale runs failed, a result only when done."""
    both = documents.join(analyses, key, "left")
    is_stale = (F.col("status") == "running") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(rules.STALE_MINUTES)))
    status = F.when(F.col("status").isNull(), "not_started").when(is_stale, "failed").otherwise(F.col("status"))
    return both.withColumn("shown_status", status).withColumn("result", F.when(F.col("shown_status") == "done", F.col("result")))


def admission(content_type: Column, n_bytes: Column, n_clauses: Column) -> Column:
    """Reason to reject an upload, or null."""
    return F.when(~content_type.isin(*rules.UPLOAD_TYPES), "415").when(n_bytes == 0, "400").when(n_bytes > rules.UPLOAD_BYTES, "413").when(n_clauses == 0, "422")


def request_problem(action: Column, clause_id: Column, question: Column, n_history: Column) -> Column:
    ask = F.coalesce(F.trim(question), F.lit(""))
    return (
        F.when(action.isNotNull() & clause_id.isNull(), "action needs a clause")
        .when(action.isNull() & (ask == ""), "question is blank")
        .when(F.length(question) > rules.QUESTION_CHARS, "question too long")
        .when(n_history > 20, "history too long")
    )


def recent(df: DataFrame, owner: str, created: str, tie: str, limit: int = rules.LIST_LIMIT) -> DataFrame:
    """The newest rows of each owner; for one owner use ``orderBy().limit()``."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(owner).orderBy(F.col(created).desc(), F.col(tie).desc()))).where(F.col("rank") <= limit)


def with_child_count(parent: DataFrame, child: DataFrame, key: str, out: str) -> DataFrame:
    n = child.groupBy(key).agg(F.count("*").alias(out))
    return parent.join(n, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def with_children(parent: DataFrame, child: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """Children as one array per parent in order, [] without any."""
    columns = [c for c in child.columns if c not in (key, order)]
    lists = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(out))
    return parent.join(lists, key, "left").withColumn(out, F.coalesce(out, F.array()))


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows, replaced by incoming rows of equal key, plus the new ones."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def override(base: DataFrame, better: DataFrame, key: str) -> DataFrame:
    """Full outer merge in which ``better`` wins, row by row."""
    return upsert(base, better, key)


def last_by(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """One value per key: that of the last position (the last write wins)."""
    return df.groupBy(key).agg(F.max_by(value, position).alias(value))


def serialised(clauses: DataFrame, links: DataFrame, key: str, fields: list[str], statute_fields: list[str]) -> DataFrame:
    """One nested result per document: clauses in order with whitelisted fields and public error, and their links."""
    from ..functions import text

    keep = [F.col(c) for c in fields]
    statutes = F.transform("retrieved_statutes", lambda s: F.struct(*[s[f].alias(f) for f in statute_fields]))
    shown = clauses.select(key, F.struct("order_index", *keep, statutes.alias("retrieved_statutes"), text.public_error(F.col("error")).alias("error")).alias("c"))
    a = shown.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("clauses"))
    b = links.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("clause_id_a", "clause_id_b", "relationship_type", "explanation"))).alias("cross_clause"))
    return a.join(b, key, "left").withColumn("cross_clause", F.coalesce("cross_clause", F.array()))


def summary(results: DataFrame, key: str) -> DataFrame:
    return results.select(key, F.size("clauses").alias("clause_count"), F.size(F.filter("clauses", lambda c: c["error"].isNull())).alias("explained_count"), F.size("cross_clause").alias("connection_count"))


def reviewed_guard(df: DataFrame, reviewed: str) -> None:
    """Refuse to overwrite work that was reviewed by hand."""
    if df.where(F.coalesce(F.trim(reviewed), F.lit("")) != "").limit(1).count():
        raise RuntimeError("reviewed rows would be lost")
