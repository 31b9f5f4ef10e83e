"""Operator 10, secret scans with corpus-wide ownership frequency.

Patterns find candidate credentials in every text.  Each candidate's value is
hashed and the corpus is asked how widely it is held: by how many distinct
owners and repositories.  A value that many owners hold, or that stands in many
repositories, is a copied example (documentation, templates); a value of one
owner, in few repositories, that looks drawn by a machine, looks live.  That it
does if it has ``LIVE_BITS`` bits in all, a digit, and changes between words, capitals
and digits at ``LIVE_CHANGES`` of its places, separators left out: words and their
like (``changeme``, ``your_token_here``) do not, however many letters they have.  The contract's three base
kinds are always reported.  The method adds a span of kind ``live`` for the value
of each candidate that looks live, and one of kind ``key`` for credential formats
that the base kinds miss, unless they are copied examples.

Scale: one map-only pass over texts, checkpointed without texts.  Ownership is
counted in two aggregations with map-side combine, first over distinct
(value, owner, repository), so a value copied into a third of all rows reaches
a task once per owner and map task.  The verdicts go back by an equi-join on
the value hash, which adaptive execution may split on the candidates' side.

Defined cases: a null text is empty; null owners and repositories count as one
owner and one repository named ''; failing matches are dropped and not retried;
rows with equal id and text get equal spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pii import joined
from .runtime import cut, read

EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 6
LIVE_REPOSITORIES = 2
LIVE_BITS = 48
LIVE_CHANGES = 0.2

KINDS = ("assign", "access", "hex", "key", "live")
_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ASSIGN_HINT = re.compile(r"(?i:passw|secret|token|api_?key)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
# Public formats of issued credentials: GitHub, Slack, Stripe, Google, JSON web tokens.
_KEYS = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abpr]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_RUNS = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DIGIT = re.compile("[0-9]")
_SEPARATORS = re.compile("[^A-Za-z0-9]+")
_KEYS_HINT = ("gh", "xox", "k_live_", "AIza", "eyJ")


def candidates(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) by start and then kind as listed; added ones must not overlap a base match."""
    found = []
    if _ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    if any(x in text for x in _KEYS_HINT):
        found += [(m.start(), 3, m.end(), m[0]) for m in _KEYS.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b, _ in found)]
    return [(a, KINDS[k], b, v) for a, k, b, v in sorted(found)]


def drawn(value: str) -> bool:
    """Whether a value looks drawn at random: enough information in all, and many changes of the kind of character."""
    n = len(value)
    bits = -sum(c * math.log2(c / n) for c in Counter(value).values())
    plain = _SEPARATORS.sub("", value)
    return bits >= LIVE_BITS and _DIGIT.search(plain) is not None and len(_RUNS.findall(plain)) - 1 >= LIVE_CHANGES * (len(plain) - 1)


_ITEM = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("size", pa.int32()), ("value", pa.string()), ("drawn", pa.bool_())])
_FOUND = "doc_id long, h long, owner string, repository string, n_assign long, n_access long, n_hex long, base string, items array<struct<kind:string,start:int,end:int,size:int,value:string,drawn:boolean>>"


def _find(batches):
    for batch in batches:
        counts = np.zeros((3, batch.num_rows), np.int64)
        base, items = [""] * batch.num_rows, [None] * batch.num_rows
        for i, text in enumerate(batch.column("text")):
            text = text.as_py()
            found = candidates(text) if text else ()
            if found:
                base[i] = joined([(a, k, b) for a, k, b, _ in found if k != "key"])
                items[i] = [{"kind": k, "start": a, "end": b, "size": len(v), "value": v, "drawn": drawn(v)} for a, k, b, v in found]
                for _, k, _, _ in found:
                    if k != "key":
                        counts[KINDS.index(k), i] += 1
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "h", "owner", "repository")), *(pa.array(c) for c in counts), pa.array(base, pa.string()), pa.array(items, pa.list_(_ITEM))],
            names=["doc_id", "h", "owner", "repository", "n_assign", "n_access", "n_hex", "base", "items"],
        )


def find(docs: DataFrame, owner, repository) -> DataFrame:
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("h"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        "text",
    )
    found = slim.mapInArrow(_find, _FOUND)
    # values leave the scan only as hashes
    return cut(found.withColumn("items", F.transform("items", lambda x: x.dropFields("value").withField("value", F.unhex(F.sha2(x["value"], 256))))))


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_owners, n_repositories, verdict) over the whole corpus."""
    held = found.where(F.size("items") > 0).select("owner", "repository", F.explode("items").alias("x")).select("owner", "repository", "x.value", "x.drawn")
    once = held.groupBy("value", "owner", "repository").agg(F.max("drawn").alias("drawn"))
    held_by = once.groupBy("value").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("owner", "repository").alias("n_repositories"), F.max("drawn").alias("drawn"))
    example = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repositories") >= EXAMPLE_REPOSITORIES)
    live = (F.col("n_owners") == 1) & (F.col("n_repositories") <= LIVE_REPOSITORIES) & F.col("drawn")
    verdict = F.when(example, "example").when(live, "live").otherwise("unclear")
    return held_by.select("value", "n_owners", "n_repositories", verdict.alias("verdict"))


def report(docs: DataFrame, owner=None, repository=None) -> DataFrame:
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", owner, F.col("lang")) if repository is None else repository
    found = find(docs, owner, repository)
    each = found.where(F.size("items") > 0).select("doc_id", "h", F.explode("items").alias("x")).select("doc_id", "h", "x.*").distinct()
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    # a value ends where its match ends
    spans = F.when((F.col("kind") != "key") | (F.col("verdict") != "example"), F.struct("start", place.alias("k"), "end"))
    live = F.when(F.col("verdict") == "live", F.struct((F.col("end") - F.col("size")).alias("start"), F.lit(len(KINDS)).alias("k"), "end"))
    judged = each.join(ownership(found), "value").groupBy("doc_id", "h").agg(
        F.size(F.collect_set(live)).alias("n_live"),
        F.count_if(F.col("verdict") == "example").alias("n_example"),
        F.max("n_owners").alias("max_owners"),
        F.max("n_repositories").alias("max_repositories"),
        F.array_sort(F.array_union(F.collect_list(spans), F.collect_set(live))).alias("all"),
    )
    judged = judged.withColumnsRenamed({"doc_id": "j_doc_id", "h": "j_h"})
    both = found.join(judged, F.col("doc_id").eqNullSafe(F.col("j_doc_id")) & (F.col("h") == F.col("j_h")), "left")
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform(F.coalesce("all", F.array()), lambda x: F.concat(F.element_at(kinds, x["k"].cast("int")), F.lit(":"), x["start"], F.lit(":"), x["end"])), ",")
    return both.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"), F.coalesce("max_owners", F.lit(0)).cast("long").alias("max_owners"),
        F.coalesce("max_repositories", F.lit(0)).cast("long").alias("max_repositories"),
    )


def op10_secret_ownership(spark, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"))


_ASSIGN_SQL = _ASSIGN.pattern.replace("'", "''")
#: A match starts after all pieces between the matches up to it and all matches before it.
_STARTS = "list_transform(range(1, len(m) + 1), lambda i: coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))"


def _matches_sql(kind: int, pattern: str, value: str, condition: str) -> str:
    return f"""
  SELECT doc_id, {kind} AS k, CAST(a AS BIGINT) AS a, CAST(a + length(x) AS BIGINT) AS z, v FROM (
    SELECT doc_id, unnest(m) AS x, unnest({value}) AS v, unnest({_STARTS}) AS a
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, {"regexp_extract_all(t, '" + pattern + "', 2)" if value == "g" else "NULL"} AS g, string_split_regex(t, '{pattern}') AS p FROM d WHERE regexp_matches(t, '{pattern}'))
  ) WHERE {condition}"""


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS t FROM documents
), base AS ({_matches_sql(0, _ASSIGN_SQL, "g", "length(v) >= 8")}
  UNION ALL{_matches_sql(1, _ACCESS.pattern, "m", "length(x) >= 16")}
  UNION ALL{_matches_sql(2, "[0-9a-f]{32,}", "m", "true")}
), added AS ({_matches_sql(3, _KEYS.pattern, "m", "true")}
), item AS (
  SELECT * FROM base
  UNION ALL SELECT * FROM added WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = added.doc_id AND base.a < added.z AND added.a < base.z)
), held AS (
  SELECT v, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repository)) AS n_repositories FROM item JOIN d USING (doc_id) GROUP BY v
), entropy AS (
  SELECT v, -sum(n * log2(n / length(v))) >= {LIVE_BITS} AND regexp_matches(v, '[0-9]') AND len(regexp_extract_all(regexp_replace(v, '[^A-Za-z0-9]+', '', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')) - 1 >= {LIVE_CHANGES} * (length(regexp_replace(v, '[^A-Za-z0-9]+', '', 'g')) - 1) AS drawn
  FROM (SELECT v, c, count(*) AS n FROM (SELECT v, unnest(string_split(v, '')) AS c FROM held) GROUP BY v, c) GROUP BY v
), verdicts AS (
  SELECT v, n_owners, n_repositories, CASE WHEN n_owners >= {EXAMPLE_OWNERS} OR n_repositories >= {EXAMPLE_REPOSITORIES} THEN 'example'
         WHEN n_owners = 1 AND n_repositories <= {LIVE_REPOSITORIES} AND drawn THEN 'live' ELSE 'unclear' END AS verdict
  FROM held JOIN entropy USING (v)
), span AS (
  SELECT doc_id, k, a, z FROM item JOIN verdicts USING (v) WHERE k < 3 OR verdict <> 'example'
  UNION SELECT doc_id, 4, z - length(v), z FROM item JOIN verdicts USING (v) WHERE verdict = 'live'
), spans AS (
  SELECT doc_id, string_agg(['assign', 'access', 'hex', 'key', 'live'][k + 1] || ':' || a || ':' || z, ',' ORDER BY a, k) AS spans FROM span GROUP BY doc_id
), judged AS (
  SELECT doc_id, count_if(k = 0) AS n_assign, count_if(k = 1) AS n_access, count_if(k = 2) AS n_hex,
         string_agg(['assign', 'access', 'hex'][k + 1] || ':' || a || ':' || z, ',' ORDER BY a, k) FILTER (k < 3) AS base,
         (SELECT count(*) FROM span WHERE span.doc_id = item.doc_id AND span.k = 4) AS n_live, count_if(verdict = 'example') AS n_example, max(n_owners) AS max_owners, max(n_repositories) AS max_repositories
  FROM item JOIN verdicts USING (v) GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("n_assign", "n_access", "n_hex", "n_live", "n_example", "max_owners", "max_repositories"))},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN judged USING (doc_id) LEFT JOIN spans USING (doc_id)
"""
