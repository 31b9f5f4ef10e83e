"""Queries of findings, lookups, reports and pending work on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import findings, metrics, vectors
from ..operators.common import read
from .evaluation import _L, _labelled
from .heavy import _PAIRS, _vectors

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT clause_id, count(*) AS n FROM (SELECT l_partkey AS clause_id FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem WHERE l_suppkey <> l_partkey) GROUP BY 1")
def linked_connections(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return findings.linked(edges, a="l_partkey", b="l_suppkey").groupBy("clause_id").agg(F.count("*").alias("n"))


@query(f"WITH {_L} SELECT lang, CAST(count_if(label <> 'GREEN') AS BIGINT) AS n_issues, CAST(count_if(label = 'GREEN') AS BIGINT) AS n_standard FROM l JOIN documents USING (doc_id) GROUP BY 1")
def issue_partition(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return findings.partition_counts(_labelled(spark, sf_dir).join(docs, "doc_id"), ["lang"], "label")


_RISK = "CASE p_size % 7 WHEN 0 THEN 'RED' WHEN 1 THEN 'YELLOW' ELSE 'GREEN' END"


@query(
    f"""
WITH p AS (SELECT p_brand || '/' || p_type AS d, p_partkey, p_retailprice AS place, {_RISK} AS label FROM part), r AS (
  SELECT *, row_number() OVER (PARTITION BY d ORDER BY label <> 'RED', place, p_partkey) AS n FROM p WHERE label <> 'GREEN')
SELECT DISTINCT p.d, r.p_partkey FROM p LEFT JOIN r ON p.d = r.d AND r.n = 1
"""
)
def first_important_finding(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("d"), "p_partkey", F.struct("p_retailprice", "p_partkey").alias("place"), F.expr(_RISK).alias("label"))
    return findings.first_important(parts, "d", "p_partkey", "label", "place")


@query("SELECT l_orderkey, l_linenumber, coalesce(p_name, CAST(l_partkey AS VARCHAR)) AS shown FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 25")
def support_citations(spark, sf_dir):
    support = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("entry_id"))
    retrieved = read(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("citation"), F.col("p_brand").alias("source_url"))
    return findings.shown_support(support, retrieved, []).select("l_orderkey", "l_linenumber", "shown")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def complete_lookup(spark, sf_dir):
    """Every row must resolve; one that does not stops the run."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return findings.resolved(orders, names, "key").select("o_orderkey", "c_name")


_REPORTS = ("Trained promo", "Zero-shot Standard", "Few-shot small", "Small ensemble")


@query(
    "SELECT p_partkey, CASE "
    + " ".join(f"WHEN contains('{r.lower()}', lower(p_type)) OR (starts_with(name, 'Trained') AND starts_with('{r}', 'Trained')) THEN '{r}'" for r in _REPORTS)
    + " END AS report FROM (SELECT p_partkey, p_type, CASE WHEN p_size % 10 = 0 THEN 'Trained ' ELSE 'LLM ' END || p_type AS name FROM part)"
)
def report_counterpart(spark, sf_dir):
    name = F.concat(F.when(F.col("p_size") % 10 == 0, "Trained ").otherwise("LLM "), "p_type", F.lit(" (partial, n=3)"))
    return read(spark, sf_dir, "part").select("p_partkey", findings.counterpart(name, list(_REPORTS)).alias("report"))


@query(f"WITH {_L} SELECT doc_id, predicted FROM l WHERE label = 'RED' AND predicted <> 'RED'")
def recall_misses(spark, sf_dir):
    return findings.misses(_labelled(spark, sf_dir), "label", "predicted").select("doc_id", "predicted")


@query("SELECT l_orderkey, arg_min(l_extendedprice, k) AS top, arg_max(l_quantity, k) AS bottom, round(arg_max(l_quantity, k) - arg_min(l_extendedprice, k), 6) AS height FROM (SELECT *, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) GROUP BY 1")
def margin_extent(spark, sf_dir):
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place")
    boxes = read(spark, sf_dir, "lineitem").select("l_orderkey", place, F.col("l_extendedprice").alias("top"), F.col("l_quantity").alias("bottom"))
    return findings.margin(boxes, ["l_orderkey"], "place").withColumn("height", F.round("height", 6))


_F1S = " + ".join(f"CASE WHEN CAST(count_if(label = '{x}') AS BIGINT) + CAST(count_if(predicted = '{x}') AS BIGINT) = 0 THEN 0 ELSE 2.0 * CAST(count_if(label = '{x}' AND predicted = '{x}') AS BIGINT) / (CAST(count_if(label = '{x}') AS BIGINT) + CAST(count_if(predicted = '{x}') AS BIGINT)) END" for x in rules.LABELS)


@query(f"WITH {_L} SELECT doc_id % 4 AS set_no, count(*) AS n, round(avg(CAST(label = predicted AS INTEGER)), 6) AS accuracy, round(({_F1S}) / 3, 6) AS macro_f1 FROM l GROUP BY 1")
def evaluate_sets(spark, sf_dir):
    df = _labelled(spark, sf_dir).withColumn("set_no", F.col("doc_id") % 4)
    return metrics.summary_by(df, ["set_no"], "label", "predicted").withColumns({c: F.round(c, 6) for c in ("accuracy", "macro_f1")})


@query(
    """
WITH s AS (
  SELECT 'by id' AS variant, vec_id, vec_id // 30 AS block, vec_id % 5 = 0 AS test, embedding FROM embeddings
  UNION ALL SELECT 'by block', vec_id, vec_id // 30, (vec_id // 30) % 5 = 0, embedding FROM embeddings
  UNION ALL SELECT 'repeated', vec_id, vec_id // 30, (vec_id // 30) % 5 = 0, embedding FROM embeddings
  UNION ALL SELECT 'repeated', vec_id, vec_id // 30, (vec_id // 30) % 5 <> 0, embedding FROM embeddings WHERE vec_id % 97 = 0
), e AS (SELECT variant, test, vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM s),
c AS (SELECT a.variant, a.vec_id, max(list_dot_product(a.v, b.v)) AS m FROM e a JOIN e b ON a.variant = b.variant AND a.test AND NOT b.test GROUP BY 1, 2),
n AS (SELECT variant, round(max(m), 6) AS max_similarity, CAST(count_if(m >= 0.4) AS BIGINT) AS close_rows FROM c GROUP BY 1),
z AS (SELECT variant, CAST(count_if(test) AS BIGINT) AS test_size, CAST(count_if(NOT test) AS BIGINT) AS train_size FROM s GROUP BY 1),
k AS (SELECT variant, CAST(count_if(sides > 1) AS BIGINT) AS shared_block FROM (SELECT variant, block, count(DISTINCT test) AS sides FROM s GROUP BY 1, 2) GROUP BY 1),
i AS (SELECT variant, CAST(count_if(sides > 1) AS BIGINT) AS shared_id FROM (SELECT variant, vec_id, count(DISTINCT test) AS sides FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT *, shared_block = 0 AND shared_id = 0 AND max_similarity < 0.95 AS clean FROM z JOIN k USING (variant) JOIN i USING (variant) JOIN n USING (variant)
"""
)
def leakage_report(spark, sf_dir):
    """Three splits: rows of a block on both sides, whole blocks on one side, and the same with some rows repeated on the other."""
    v = _vectors(spark, sf_dir).withColumn("block", F.floor(F.col("id") / 30))
    side = lambda test: F.when(test, "test").otherwise("train")
    whole = F.col("block") % 5 == 0
    again = v.where("id % 97 = 0").withColumn("split", side(~whole))
    splits = {"by id": v.withColumn("split", side(F.col("id") % 5 == 0)), "by block": v.withColumn("split", side(whole)), "repeated": v.withColumn("split", side(whole)).unionByName(again)}
    out = None
    for variant, rows in splits.items():
        best = vectors.similar(rows.where("split = 'test'"), rows.where("split = 'train'"), best=1).groupBy("a").agg(F.max("similarity").alias("max_similarity"))
        one = findings.leakage(rows, best, "block", "id", close=0.4).withColumns({"max_similarity": F.round("max_similarity", 6), "variant": F.lit(variant)})
        out = one if out is None else out.unionByName(one)
    return out


@query('SELECT "group", label, count(*) AS n FROM (SELECT CAST(doc_id // 30 AS BIGINT) AS "group", quality AS label FROM labels UNION ALL SELECT 1000000 + CAST(vec_id % 47 AS BIGINT), label % 2 FROM embeddings) GROUP BY 1, 2')
def combined_training_sets(spark, sf_dir):
    real = read(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 30).alias("group"), F.col("quality").alias("label"))
    synthetic = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 47).alias("group"), (F.col("label") % 2).alias("label"))
    return findings.combined(real, synthetic).groupBy("group", "label").agg(F.count("*").alias("n"))


@query(
    """
WITH r AS (SELECT event_id, event_id % 2000 AS document_id, CASE WHEN event_id % 3 > 0 THEN event_id % 7 + 1 END AS clause_id FROM events)
SELECT event_id FROM r WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = document_id AND o_orderstatus = 'F')
  AND (clause_id IS NULL OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = document_id AND l_linenumber = clause_id))
"""
)
def chat_precondition(spark, sf_dir):
    clause = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 7 + 1)
    requests = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 2000).alias("document_id"), clause.alias("clause_id"))
    status = F.when(F.col("o_orderstatus") == "F", "done").otherwise("running")
    analyses = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), status.alias("status"), F.col("o_totalprice").alias("result"))
    clauses = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("clause_id"))
    return findings.askable(requests, analyses, clauses).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')")
def pending_work(spark, sf_dir):
    replies = read(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return findings.pending(read(spark, sf_dir, "orders").select("o_orderkey"), replies, "o_orderkey")


@query(
    """
WITH w AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AS has FROM orders),
g AS (SELECT o_custkey, min(n) FILTER (NOT has) AS gap, count(*) AS n_rows FROM w GROUP BY 1)
SELECT o_custkey, n_rows, coalesce(gap - 1, n_rows) AS n_done, gap IS NULL AS complete FROM g
"""
)
def completed_prefix(spark, sf_dir):
    replies = read(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    work = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("place"))
    return findings.completed_prefix(work, replies, ["o_custkey"], "place", "o_orderkey")


@query("SELECT DISTINCT sha1(text) AS key FROM documents WHERE sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 3 = 0)")
def vector_cache_misses(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 3 = 0").select(findings.vector_key(F.col("text")).alias("key"), F.array(F.lit(0.0)).alias("vector")).dropDuplicates(["key"])
    return findings.cached_vectors(docs, cache)[1].select("key")


@query("SELECT l_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (l_returnflag = 'R'), '') AS pages FROM lineitem GROUP BY 1")
def ocr_page_numbers(spark, sf_dir):
    pages = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("number"), F.when(F.col("l_returnflag") == "R", "ocr").otherwise("text").alias("method"))
    return findings.ocr_pages(pages, "l_orderkey").select("l_orderkey", F.array_join("ocr_page_numbers", ",").alias("pages"))


@query(
    """
WITH s(pos, form, number, hint) AS (VALUES (0, 'PROMO', 7, 'a'), (1, 'SMALL', 3, NULL), (2, 'LARGE', 12, NULL))
SELECT 'IN-0' || (pos + 1) AS id, form, number, p_partkey FROM (
  SELECT s.*, p_partkey, row_number() OVER (PARTITION BY pos ORDER BY p_partkey) AS n FROM s JOIN part ON p_type = form AND p_size = number AND (hint IS NULL OR contains(p_name, hint)))
WHERE n = 1
"""
)
def numbered_selection(spark, sf_dir):
    chosen = spark.createDataFrame([(0, "PROMO", 7, "a"), (1, "SMALL", 3, None), (2, "LARGE", 12, None)], "pos int, form string, number int, hint string")
    clauses = read(spark, sf_dir, "part").select(F.col("p_type").alias("form"), F.col("p_size").alias("number"), "p_partkey", F.col("p_name").alias("text"))
    return findings.numbered_selection(chosen, clauses, "p_partkey", strict=False).select("id", "form", "number", "p_partkey")


@query(
    """
SELECT doc_id, CAST(6 AS INTEGER) AS n_messages, sha256(concat_ws(chr(10), 'system:Label clauses.', 'user:Clause: a fair one', 'assistant:{"label": "GREEN", "probabilities": {"GREEN": 0.9, "YELLOW": 0.05, "RED": 0.05}}',
  'user:Clause: a harsh one', 'assistant:{"label": "RED", "probabilities": {"GREEN": 0.05, "YELLOW": 0.05, "RED": 0.9}}', 'user:Clause: ' || text)) AS prompt_sha256
FROM documents
"""
)
def few_shot_messages(spark, sf_dir):
    m = findings.few_shot_messages(F.lit("Label clauses."), [("a fair one", "GREEN"), ("a harsh one", "RED")], F.col("text"))
    said = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")
    return read(spark, sf_dir, "documents").select("doc_id", m.alias("m")).select("doc_id", F.size("m").alias("n_messages"), F.sha2(said, 256).alias("prompt_sha256"))
