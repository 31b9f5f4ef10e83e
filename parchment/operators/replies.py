"""Replies of language models as tables (G7, L13, M1, M2, C3, D3, M4): attempts, retries, stops, and the explain stage.

A client writes what it got as rows (key, attempt from 0, status, body, retry_after); everything after that is
declarative, so a run can be resumed and rechecked from saved replies without calling anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import guardrails

MAX_RETRIES = 6
FIRST_WAIT = 5.0
QUOTA_MARK = "per day"


def status_verdict(status: Column, body: Column, content: Column) -> Column:
    """What one reply means: ok, empty, quota (stop for today), limited, unavailable, or refused (not worth a retry)."""
    return (
        F.when((status == 429) & F.contains(F.lower(F.coalesce(body, F.lit(""))), F.lit(QUOTA_MARK)), "quota")
        .when(status == 429, "limited")
        .when(status >= 500, "unavailable")
        .when(status >= 400, "refused")
        .when(F.coalesce(content, F.lit("")) != "", "ok")
        .otherwise("empty")
    )


def wait_seconds(verdict: Column, attempt: Column, retry_after: Column) -> Column:
    """How long to wait after a reply: what the provider says of a limit if that is a number, else twice as long each time."""
    told = F.when(retry_after.rlike(r"^[0-9]+(\.[0-9]+)?$"), retry_after.try_cast("double"))
    backoff = F.lit(FIRST_WAIT) * F.pow(F.lit(2.0), attempt)
    return F.when(verdict == "limited", F.coalesce(told, backoff)).when(verdict == "unavailable", backoff).otherwise(0.0)


def outcomes(attempts: DataFrame, key: str = "key", limit: int = MAX_RETRIES) -> DataFrame:
    """(key, content, error, attempts, waited) of each key: the first ok reply within ``limit`` attempts; quota and refusal stop at once."""
    verdict = status_verdict(F.col("status"), F.col("body"), F.col("content"))
    seen = attempts.where(F.col("attempt") < limit).withColumn("verdict", verdict)
    stops = F.col("verdict").isin("ok", "quota", "refused")
    ends = seen.groupBy(key).agg(F.min(F.when(stops, F.col("attempt"))).alias("stop"), F.max("attempt").alias("last"))
    used = seen.join(ends, key).where(F.col("stop").isNull() | (F.col("attempt") <= F.col("stop")))
    # nobody waits after the last attempt
    wait = F.when(F.col("attempt") < F.coalesce("stop", F.lit(limit - 1)), wait_seconds(F.col("verdict"), F.col("attempt"), F.col("retry_after"))).otherwise(0.0)
    end = F.max_by("verdict", "attempt")
    out = used.groupBy(key).agg(F.max_by("content", "attempt").alias("content"), end.alias("end"), F.count("*").alias("attempts"), F.sum(wait).alias("waited"))
    error = F.when(F.col("end") == "ok", F.lit(None).cast("string")).when(F.col("end") == "quota", "daily limit").when(F.col("end") == "refused", "refused").otherwise("no reply")
    return out.select(key, F.when(F.col("end") == "ok", F.col("content")).alias("content"), error.alias("error"), "attempts", "waited")


def cached(work: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(work with the cached value, work that the cache (key, value) lacks)."""
    both = work.join(cache, key, "left")
    return both.where(F.col("value").isNotNull()), both.where(F.col("value").isNull()).drop("value")


def explained(replies: DataFrame, keys: list[str], tries: int = 2) -> DataFrame:
    """Per key the first well-formed explanation of its replies (attempt, content), with one retry; else the last error."""
    parsed = replies.where(F.col("attempt") < tries).withColumn("x", guardrails.parse_explanation(F.col("content")))
    good = F.col("x.error").isNull()
    out = parsed.groupBy(*keys).agg(F.min_by(F.when(good, F.col("x")), F.when(good, F.col("attempt"))).alias("explanation"), F.max_by("x.error", "attempt").alias("last"))
    return out.select(*keys, "explanation", F.when(F.col("explanation").isNull(), F.concat(F.lit("explanation generation failed: "), "last")).alias("reply_error"))


def calls(attempts: DataFrame, keys: list[str], limit: int = MAX_RETRIES) -> DataFrame:
    """(keys, try, content, error) of each call: a call is one try of one prompt, ``attempts`` (keys, try, attempt, ...) are its requests."""
    out = outcomes(attempts.withColumn("call", F.struct(*keys, "try")), "call", limit)
    return out.select("call.*", "content", "error")


def tried(answers: DataFrame, keys: list[str], parse) -> DataFrame:
    """(keys, value, error) of ``answers`` (keys, try, content, error), asked again once, and only where the first answer is malformed.

    ``parse`` turns a content into (value, problem or null).  A call that failed is not tried again.
    """
    value, problem = parse(F.col("content"))
    parsed = answers.where("try < 2").select(*keys, "try", F.struct(F.col("error"), problem.alias("problem"), value.alias("value")).alias("x"))
    first, second = (F.max_by(F.when(F.col("try") == i, F.col("x")), F.when(F.col("try") == i, F.lit(1))).alias(f"t{i}") for i in (0, 1))
    both = parsed.groupBy(*keys).agg(first, second)
    ok = lambda t: F.col(t).isNotNull() & F.col(f"{t}.error").isNull() & F.col(f"{t}.problem").isNull()
    again = F.col("t0").isNotNull() & F.col("t0.error").isNull() & F.col("t0.problem").isNotNull()
    last = F.coalesce("t1.error", "t1.problem", "t0.problem")
    return both.select(
        *keys,
        F.when(ok("t0"), F.col("t0.value")).when(again & ok("t1"), F.col("t1.value")).alias("value"),
        F.when(F.col("t0").isNull(), "no reply").when(ok("t0"), F.lit(None)).when(~again, F.col("t0.error")).when(~ok("t1"), last).alias("error"),
    )


FAILED = "explanation generation failed: "


def document_review(clauses: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """The explain and grounding stage: ``clauses`` (keys, text, label, retrieved ids) with explanation, grounding and error.

    A clause without a label was not classified and is not explained; one without a usable reply keeps its label.
    Replies may be the saved ones of an earlier run, which so is rechecked.
    """
    return reviewed(clauses, explained(replies, keys), keys)


def reviewed(clauses: DataFrame, explanations: DataFrame, keys: list[str], classified: str = "classification failed") -> DataFrame:
    """``clauses`` with the ``explanations`` (keys, explanation, reply_error), checked against text and retrieved ids; ``classified`` is the error of those without label."""
    both = clauses.join(explanations, keys, "left")
    x, labelled = F.col("explanation"), F.col("label").isNotNull()
    both = both.withColumn("explanation", F.when(labelled, x))
    support = F.coalesce(x["statute_support"], F.array())
    how = F.array_join(F.transform(support, lambda s: F.coalesce(s["how_it_applies"], F.lit(""))), " ")
    checked = guardrails.grounded(both, x["document_says"], F.coalesce(x["concern"], F.lit("")), F.col("label"), F.transform(support, lambda s: s["entry_id"]), how, F.col("text"), F.col("retrieved"), where=x.isNotNull())
    error = F.when(~labelled, classified).otherwise(F.when(x.isNull(), F.coalesce("reply_error", F.lit(f"{FAILED}no reply"))))
    return checked.withColumn("error", error).drop("reply_error")
