"""Queries of the review in one plan: clauses and saved requests of three model calls to labelled, checked and linked clauses."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import retrieval, review
from ..operators.common import read
from .review import _CONCLUSIONS_SQL, WORD_TOPICS, sql_words

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_TOPIC_NAMES = [n for n, _ in WORD_TOPICS]


def _clauses(spark, sf_dir):
    """The user turns of a conversation as the clauses of a document, with the turn that follows and three numbers that draw what a client met."""
    w = W.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").withColumns({"reply": F.coalesce(F.lead("text").over(w), F.lit(""))}).where("role = 'user'")
    c, t = F.col("conv_id"), F.col("turn")
    order = F.row_number().over(w) - 1
    return turns.select(
        F.col("conv_id").cast("string").alias("document_id"), order.alias("order_index"), F.format_string("c%03d", order + 1).alias("clause_id"), F.lit(None).cast("string").alias("section_heading"), "text", "reply", "conv_id", "turn",
        ((c * 31 + t * 7) % 20).alias("h"), ((c * 13 + t * 3) % 16).alias("e"),
    )


def _requests(rows, keys, kind, good, empty="no idea"):
    """Rows (keys, try, attempt, status, body, content, retry_after) by what ``kind`` says a client met."""
    one = lambda t, a, s, body=None, content=None, after=None: F.struct(F.lit(t).alias("try"), F.lit(a).alias("attempt"), F.lit(s).alias("status"), F.lit(body).cast("string").alias("body"), (F.lit(content) if content is None or isinstance(content, str) else content).cast("string").alias("content"), F.lit(after).cast("string").alias("retry_after"))
    met = {
        "quota": [one(0, 0, 429, "Tokens PER DAY used up"), one(0, 1, 200, content=F.col("_good"))],
        "refused": [one(0, 0, 401), one(1, 0, 200, content=F.col("_good"))],
        "down": [one(0, i, 503) for i in range(6)] + [one(0, 6, 200, content=F.col("_good"))],
        "limited": [one(0, 0, 429, "slow down", after="3"), one(0, 1, 200, content=F.col("_good"))],
        "silent": [one(0, 0, 200, content=""), one(0, 1, 200, content=F.col("_good"))],
        "malformed": [one(0, 0, 200, content=empty), one(1, 0, 502), one(1, 1, 200, content=F.col("_good"))],
        "twice": [one(0, 0, 200, content=empty), one(1, 0, 200, content=empty), one(2, 0, 200, content=F.col("_good"))],
        "stopped": [one(0, 0, 200, content=empty)],
        "lost": [one(0, 0, 200, content=empty), one(1, 0, 403)],
    }
    rows = rows.withColumns({"_kind": kind, "_good": good})
    out = F.when(F.col("_kind") == "none", F.array().cast("array<struct<try:int,attempt:int,status:int,body:string,content:string,retry_after:string>>"))
    for name, requests in met.items():
        out = out.when(F.col("_kind") == name, F.array(*requests))
    return rows.select(*keys, F.explode(out.otherwise(F.array(one(0, 0, 200, content=F.col("_good"))))).alias("r")).select(*keys, "r.*")


def _kinds(n, names):
    return F.coalesce(F.get(text.strings(names), n.cast("int")), F.lit("ok"))


_LABEL_KINDS = ("quota", "down", "refused", "limited", "silent", "malformed", "twice", "stopped", "none", "lost")
_EXPLAIN_KINDS = ("quota", "refused", "down", "limited", "malformed", "twice", "none")
_PAIR_KINDS = ("quota", "twice", "malformed", "unrelated", "lost")
_TYPES = ("combined", "condition", "other")


def _saved(rows):
    c, t = F.col("conv_id"), F.col("turn")
    label = F.element_at(text.strings(rules.LABELS), ((c + t) % 3 + 1).cast("int"))
    shares = F.struct((c % 5).alias("GREEN"), (t % 4).alias("YELLOW"), (F.length("text") % 3).alias("RED"))
    labels = _requests(rows, review.KEYS, _kinds(F.col("h"), _LABEL_KINDS), F.concat(F.lit("Sure: "), F.to_json(F.struct(label.alias("label"), shares.alias("probabilities")))))
    says = F.trim(F.regexp_replace("reply", "[^A-Za-z0-9., ]", " "))
    entry = lambda n: F.concat(F.lit("e"), (n % 20).cast("string"))
    cites = F.when(t % 3 == 0, F.array().cast("array<string>")).when(t % 3 == 1, F.array(entry(c))).otherwise(F.array(entry(c), entry(t)))
    support = F.transform(cites, lambda x: F.struct(x.alias("entry_id"), F.lit("as said").alias("how_it_applies")))
    good = F.concat(F.lit("Here: "), F.to_json(F.struct(says.alias("document_says"), says.substr(F.lit(1), 5 * (t % 8)).alias("concern"), support.alias("statute_support"))))
    told = _requests(rows, review.KEYS, _kinds(F.col("e"), _EXPLAIN_KINDS), good, "{broken")
    a, b = (rows.select("document_id", "conv_id", F.col("order_index").alias(s), F.col("clause_id").alias(f"clause_id_{s}")) for s in "ab")
    pairs = a.join(b.drop("conv_id"), "document_id").where("a < b").withColumn("k", (F.col("conv_id") * 3 + F.col("a") * 5 + F.col("b") * 7) % 12)
    reply = F.to_json(F.struct((F.col("k") != 3).alias("related"), F.concat(F.lit(" "), F.get(text.strings(_TYPES), (F.col("k") % 3).cast("int"))).alias("relationship_type"), F.lit("both").alias("explanation")))
    connected = _requests(pairs, ["document_id", "clause_id_a", "clause_id_b"], _kinds(F.col("k"), _PAIR_KINDS), reply)
    return review.Saved(labels, told, connected)


def _analysed(spark, sf_dir):
    rows = _clauses(spark, sf_dir)
    c, t = F.col("conv_id"), F.col("turn")
    weights = [(1 + c % 3).cast("double"), (1 + t % 5).cast("double"), (1 + F.length("text") % 4).cast("double")]
    total = weights[0] + weights[1] + weights[2]
    trained = rows.where((c + t) % 4 != 0).select(*review.KEYS, F.map_from_arrays(text.strings(rules.LABELS), F.array(*[w / total for w in weights])).alias("probabilities"))
    item = F.col("item_id")
    held = F.when(item % 3 == 0, "Maharashtra").when(item % 3 == 1, "Delhi").otherwise("Central")
    kb = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("e"), item.cast("string")).alias("entry_id"), "text", F.get(text.strings(_TOPIC_NAMES), (item % 4).cast("int")).alias("topic"), held.alias("jurisdiction"))
    states = rows.select("document_id", F.when(c % 3 == 0, "Maharashtra").when(c % 3 == 1, "Delhi").otherwise("Goa").alias("jurisdiction")).distinct()
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    embedded = rows.select(*review.KEYS, ((c * 5 + t) % 500).alias("vec_id")).join(vectors, "vec_id").drop("vec_id")
    clauses = rows.select(*review.KEYS, "order_index", "section_heading", "text")
    bridge = kb.select("jurisdiction", "topic", "entry_id")
    return review.analyse(clauses, bridge, retrieval.with_words(kb, "text"), _saved(rows), trained, embedded, states, WORD_TOPICS, threshold=0.0)


_TOPIC_SQL = "CASE " + " ".join(f"WHEN regexp_matches(' ' || text, '{p}') THEN '{n}'" for n, p in WORD_TOPICS) + " END"
_RELATED = "k NOT IN (0, 1, 3, 4)"
_ANALYSIS_SQL = f"""
l AS (SELECT conv_id, turn, role, text, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS reply FROM conversations),
u AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) - 1 AS ord, (conv_id * 31 + turn * 7) % 20 AS h, (conv_id * 13 + turn * 3) % 16 AS e FROM l WHERE role = 'user'),
c AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, conv_id, turn, text, ord, h, e, 'c' || lpad(CAST(ord + 1 AS VARCHAR), 3, '0') AS clause_id, {_TOPIC_SQL} AS topic,
  CASE conv_id % 3 WHEN 0 THEN 'Maharashtra' WHEN 1 THEN 'Delhi' ELSE 'Goa' END AS jurisdiction, trim(regexp_replace(reply, '[^A-Za-z0-9., ]', ' ', 'g')) AS says,
  CASE turn % 3 WHEN 0 THEN [] WHEN 1 THEN ['e' || (conv_id % 20)] ELSE ['e' || (conv_id % 20), 'e' || (turn % 20)] END AS cites FROM u),
kb AS (SELECT 'e' || item_id AS entry_id, text, ['{"', '".join(_TOPIC_NAMES)}'][CAST(item_id % 4 AS INTEGER) + 1] AS topic, CASE item_id % 3 WHEN 0 THEN 'Maharashtra' WHEN 1 THEN 'Delhi' ELSE 'Central' END AS jurisdiction FROM benchmark),
f AS (SELECT c.document_id, c.clause_id, kb.entry_id, len(list_intersect({sql_words('c.text', rules.RETRIEVAL_STOP_WORDS)}, {sql_words('kb.text', rules.RETRIEVAL_STOP_WORDS)})) AS score
  FROM c JOIN kb ON c.topic = kb.topic AND kb.jurisdiction IN (c.jurisdiction, 'Central') WHERE c.jurisdiction <> 'Goa'),
r AS (SELECT document_id, clause_id, list(entry_id ORDER BY score DESC, entry_id) AS ids FROM f GROUP BY 1, 2),
w AS (SELECT c.*, coalesce(r.ids, []) AS ids, h IN (3, 4, 5) OR h > 9 AS told, (conv_id + turn) % 4 <> 0 AS known,
  CASE WHEN h IN (3, 4, 5) OR h > 9 THEN [CAST(conv_id % 5 AS DOUBLE), CAST(turn % 4 AS DOUBLE), CAST(length(text) % 3 AS DOUBLE)] WHEN (conv_id + turn) % 4 <> 0 THEN [CAST(1 + conv_id % 3 AS DOUBLE), CAST(1 + turn % 5 AS DOUBLE), CAST(1 + length(text) % 4 AS DOUBLE)] END AS raw,
  CAST((conv_id + turn) % 3 + 1 AS INTEGER) AS stated FROM c LEFT JOIN r USING (document_id, clause_id)),
p0 AS (SELECT *, CASE WHEN NOT told AND raw IS NOT NULL THEN [raw[1] / (raw[1] + raw[2] + raw[3]), raw[2] / (raw[1] + raw[2] + raw[3]), raw[3] / (raw[1] + raw[2] + raw[3])]
  WHEN raw[1] + raw[2] + raw[3] > 0 THEN [raw[1] / (raw[1] + raw[2] + raw[3]), raw[2] / (raw[1] + raw[2] + raw[3]), raw[3] / (raw[1] + raw[2] + raw[3])]
  WHEN raw IS NOT NULL THEN [CASE WHEN i = stated THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END FOR i IN [1, 2, 3]] END AS q FROM w),
p1 AS (SELECT *, list_max(q) AS top, [CASE WHEN i = stated THEN list_max(q) ELSE q[i] END FOR i IN [1, 2, 3]] AS lifted FROM p0),
p AS (SELECT *, CASE WHEN NOT told OR list_position(q, top) = stated THEN q ELSE [x / (lifted[1] + lifted[2] + lifted[3]) FOR x IN lifted] END AS probs FROM p1),
b AS (SELECT *, CASE WHEN trim(coalesce(text, '')) <> '' AND probs IS NOT NULL THEN ['GREEN', 'YELLOW', 'RED'][list_position(probs, list_max(probs))] END AS label, CASE WHEN trim(text) <> '' THEN round(list_max(probs), 6) END AS confidence,
  substring(says, 1, 5 * CAST(turn % 8 AS INTEGER)) AS concern FROM p),
t AS (SELECT *, {sql_words('says', rules.GROUNDING_STOP_WORDS, 2)} AS sw, {sql_words('text', rules.GROUNDING_STOP_WORDS, 2)} AS tw, regexp_extract_all(says, '{rules.NUMBER}') AS rn, regexp_extract_all(text, '{rules.NUMBER}') AS sn,
  says || ' ' || trim(concern) || ' ' || array_to_string(['as said' FOR x IN cites], ' ') AS everything, label IS NOT NULL AND (e IN (3, 4) OR e > 6) AND says <> '' AS explained FROM b),
g AS (SELECT *, len([x FOR x IN cites IF NOT list_contains(ids, x)]) = 0 AND (len(regexp_extract_all(everything, '{rules.STATUTE_REFERENCE}')) = 0 OR len(cites) > 0)
  AND len([x FOR x IN rn IF NOT list_contains(sn, x)]) = 0 AND (CASE WHEN len(sw) > 0 THEN len(list_intersect(sw, tw)) / len(sw) ELSE 0 END >= 0.2 OR len(list_intersect(sw, tw)) >= 2)
  AND NOT regexp_matches(everything, '{_CONCLUSIONS_SQL}') AND (label = 'GREEN' OR length(trim(concern)) >= 20) AS passed,
  CASE WHEN trim(coalesce(text, '')) = '' THEN 'classification failed: blank text' WHEN label IS NULL THEN 'classification failed' WHEN e = 0 THEN 'explanation generation failed: daily limit' WHEN e = 1 THEN 'explanation generation failed: refused'
    WHEN e IN (2, 6) THEN 'explanation generation failed: no reply' WHEN e = 5 THEN 'explanation generation failed: no JSON object' WHEN says = '' THEN 'explanation generation failed: document_says is empty' END AS error FROM t),
v AS (SELECT c.document_id, c.conv_id, c.ord, c.clause_id, [CAST(x AS DOUBLE) FOR x IN m.embedding] AS x FROM c JOIN embeddings m ON m.vec_id = (c.conv_id * 5 + c.turn) % 500),
s AS (SELECT a.document_id, a.conv_id, a.ord AS oa, b.ord AS ob, a.clause_id AS ca, b.clause_id AS cb, list_dot_product(a.x, b.x) AS sim FROM v a JOIN v b ON a.document_id = b.document_id AND a.ord <> b.ord),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id, oa ORDER BY round(sim, 9) DESC, ob) AS place FROM s WHERE sim >= 0),
k AS (SELECT DISTINCT document_id, conv_id, least(oa, ob) AS oa, greatest(oa, ob) AS ob, least(ca, cb) AS ca, greatest(ca, cb) AS cb FROM n WHERE place <= 2),
z AS (SELECT *, (conv_id * 3 + oa * 5 + ob * 7) % 12 AS k FROM k),
links AS (SELECT document_id, ca, cb, ['combined', 'condition', 'other'][CAST(k % 3 AS INTEGER) + 1] AS kind FROM z WHERE {_RELATED}),
sides AS (SELECT document_id, ca AS clause_id, cb || ':' || kind AS link FROM links UNION ALL SELECT document_id, cb, ca || ':' || kind FROM links),
joined AS (SELECT document_id, clause_id, string_agg(link, ',' ORDER BY link) AS linked_to FROM sides GROUP BY 1, 2)
"""


@query(
    f"""
WITH {_ANALYSIS_SQL}
SELECT document_id, clause_id, topic, array_to_string(ids, ',') AS retrieved, label, confidence, CASE WHEN told THEN 'llm' ELSE 'trained (llm fallback)' END AS approach, CASE WHEN explained THEN sha256(says) END AS says_sha256,
  CASE WHEN explained THEN passed END AS passed, error, coalesce(linked_to, '') AS linked_to
FROM g LEFT JOIN joined USING (document_id, clause_id)
"""
)
def full_review(spark, sf_dir):
    """Topics, statutes, labels with fallback, explanations checked against text and statutes, and confirmed links, from clauses and saved requests in one plan."""
    out = review.linked_clauses(_analysed(spark, sf_dir))
    links = F.transform(F.coalesce("links", F.array()), lambda x: F.concat(x["clause_id"], F.lit(":"), x["relationship_type"]))
    return out.select(
        "document_id", "clause_id", "topic", F.array_join("retrieved", ",").alias("retrieved"), "label", F.round("confidence", 6).alias("confidence"), "approach", F.sha2("explanation.document_says", 256).alias("says_sha256"),
        F.col("grounding.passed").alias("passed"), "error", F.array_join(links, ",").alias("linked_to"),
    )


@query(
    f"""
WITH {_ANALYSIS_SQL}
SELECT document_id, count(*) AS total, count(label) AS labelled, CAST(count_if(explained) AS BIGINT) AS explained, CAST(count_if(explained AND passed) AS BIGINT) AS passed, count(error) AS failed,
  (SELECT count(*) FROM links WHERE links.document_id = g.document_id) AS links
FROM g GROUP BY document_id
"""
)
def review_progress(spark, sf_dir):
    return review.progress(_analysed(spark, sf_dir))
