"""Queries of requests, replies, scans, stores and reports on the driver's tables: one for each operator that no other query reaches."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import findings, geometry, guardrails, ordering, replies, retrieval, store, vectors
from ..operators.common import checkpoint, read
from ..sources import readers
from ..streaming import limiter
from .heavy import _PAIRS, _vectors
from .review import _CONCLUSIONS_SQL, _LABEL_SQL, _PAIRS_SQL, _QUERIES_SQL, _query_tables, _turn_pairs, sql_words

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _conversations(spark, sf_dir):
    return read(spark, sf_dir, "conversations")


@query("SELECT doc_id, CASE WHEN kind NOT IN ('application/pdf', 'image/jpeg', 'image/png') THEN '415' WHEN n = 0 THEN '400' WHEN n > 20971520 THEN '413' WHEN clauses = 0 THEN '422' END AS problem FROM (SELECT doc_id, ['application/pdf', 'image/jpeg', 'image/png', 'text/plain'][CAST(doc_id % 4 AS INTEGER) + 1] AS kind, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars * 3000 END AS n, doc_id % 5 AS clauses FROM documents)")
def upload_admission(spark, sf_dir):
    n = F.col("doc_id")
    kind = F.get(text.strings(["application/pdf", "image/jpeg", "image/png", "text/plain"]), (n % 4).cast("int"))
    size = F.when(n % 7 == 0, 0).otherwise(F.col("n_chars") * 3000)
    return read(spark, sf_dir, "documents").select("doc_id", store.admission(kind, size, n % 5).alias("problem"))


_REQUESTS = "r AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'explain' END AS action, CASE WHEN turn % 2 = 0 THEN 'c001' END AS clause_id, CASE WHEN conv_id % 9 = 0 THEN ' ' WHEN conv_id % 9 = 1 THEN repeat(text, 9) ELSE text END AS question, (conv_id + turn) % 23 AS n FROM conversations)"


@query(f"WITH {_REQUESTS} SELECT conv_id, turn, CASE WHEN action IS NOT NULL AND clause_id IS NULL THEN 'action needs a clause' WHEN action IS NULL AND trim(coalesce(question, '')) = '' THEN 'question is blank' WHEN length(question) > 1000 THEN 'question too long' WHEN n > 20 THEN 'history too long' END AS problem FROM r")
def chat_request_problems(spark, sf_dir):
    turn, conv = F.col("turn"), F.col("conv_id")
    question = F.when(conv % 9 == 0, " ").when(conv % 9 == 1, F.repeat("text", F.lit(9))).otherwise(F.col("text"))
    problem = store.request_problem(F.when(turn % 5 == 0, "explain"), F.when(turn % 2 == 0, "c001"), question, (conv + turn) % 23)
    return _conversations(spark, sf_dir).select("conv_id", "turn", problem.alias("problem"))


_NOW = "2024-01-05 00:00:00"
_JOBS = "j AS (SELECT event_id, ts, CASE WHEN user_id % 3 = 0 THEN 'Goa' WHEN user_id % 3 = 1 THEN 'Delhi' END AS jurisdiction, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'done' END AS status FROM events)"


def _jobs(spark, sf_dir):
    user, kind = F.col("user_id"), F.col("event_type")
    state = F.when(user % 3 == 0, "Goa").when(user % 3 == 1, "Delhi")
    return read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("updated_at"), state.alias("jurisdiction"), F.when(kind == "view", "running").when(kind == "click", "done").alias("status"), F.col("value").alias("result"))


@query(f"WITH {_JOBS} SELECT event_id FROM j WHERE (jurisdiction IS NULL OR jurisdiction IN ('Maharashtra', 'Delhi')) AND (coalesce(status, '') <> 'running' OR ts < TIMESTAMP '{_NOW}' - INTERVAL 15 MINUTE)")
def startable_jobs(spark, sf_dir):
    return store.startable(_jobs(spark, sf_dir), F.lit(_NOW).cast("timestamp")).select("event_id")


@query(f"WITH {_JOBS} SELECT o_orderkey AS event_id, CASE WHEN status IS NULL THEN 'not_started' WHEN status = 'running' AND j.ts < TIMESTAMP '{_NOW}' - INTERVAL 15 MINUTE THEN 'failed' ELSE status END AS shown_status, CASE WHEN status = 'done' THEN value END AS result FROM orders LEFT JOIN j ON j.event_id = o_orderkey LEFT JOIN events e ON e.event_id = j.event_id")
def status_view(spark, sf_dir):
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"))
    return store.describe(docs, _jobs(spark, sf_dir), F.lit(_NOW).cast("timestamp"), "event_id").select("event_id", "shown_status", "result")


@query(f"SELECT event_id, strftime(ts + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS expires_at, ts > TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR AS kept FROM events")
def file_expiry(spark, sf_dir):
    """When each stored file expires, and whether a cache that is purged now keeps it."""
    ts, now = F.col("ts"), F.lit(_NOW).cast("timestamp")
    return read(spark, sf_dir, "events").select("event_id", F.date_format(store.expiry(ts), "yyyy-MM-dd HH:mm:ss").alias("expires_at"), limiter.within(ts, now).alias("kept"))


@query("WITH d AS (SELECT DISTINCT user_id, ts FROM events) SELECT user_id, epoch_us(ts) AS at, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000, false) AS too_soon FROM d")
def request_spacing(spark, sf_dir):
    hits = read(spark, sf_dir, "events").select("user_id", "ts").distinct()
    return limiter.too_soon(hits, "user_id", "ts", 3600).select("user_id", F.unix_micros("ts").alias("at"), "too_soon")


@query(
    """
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p, CASE doc_id % 4 WHEN 0 THEN ['text'] WHEN 1 THEN ['ocr'] WHEN 2 THEN ['ocr', 'text'] ELSE [] END AS m FROM documents)
SELECT doc_id, CAST(list_sum(list_transform(p, lambda x: length(x))) AS INTEGER) AS n_chars, sha256(array_to_string(p, chr(10) || chr(10))) AS full_sha256, CASE WHEN m = ['text'] THEN 'text' WHEN m = ['ocr'] THEN 'ocr' ELSE 'mixed' END AS method FROM p
"""
)
def page_measures(spark, sf_dir):
    p, n = F.split("text", "\n"), F.col("doc_id")
    methods = F.when(n % 4 == 0, text.strings(["text"])).when(n % 4 == 1, text.strings(["ocr"])).when(n % 4 == 2, text.strings(["ocr", "text"])).otherwise(F.array().cast("array<string>"))
    return read(spark, sf_dir, "documents").select("doc_id", text.page_chars(p).alias("n_chars"), F.sha2(text.full_text(p), 256).alias("full_sha256"), text.document_method(methods).alias("method"))


@query("SELECT doc_id, CAST(sum(length(t)) AS BIGINT) AS n_chars, CAST(count(DISTINCT pos // 40) AS BIGINT) AS n_pages FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents) GROUP BY 1")
def embedded_text_totals(spark, sf_dir):
    """Characters of embedded text and pages of each document, forty lines to a page."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n_chars"), F.count_distinct(F.expr("pos div 40")).alias("n_pages"))


@query("SELECT doc_id, CASE WHEN n >= 20 OR NOT img THEN 'text' ELSE 'ocr' END AS method FROM (SELECT doc_id, n_chars % 40 AS n, doc_id % 3 > 0 AS img FROM documents)")
def scan_methods(spark, sf_dir):
    pages = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 40).alias("n_chars"), (F.col("doc_id") % 3 > 0).alias("has_image"))
    return geometry.page_methods(pages).select("doc_id", "method")


@query("WITH t AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10)) AS t FROM documents), p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')) AS p FROM t) SELECT doc_id, sha256(p) AS paragraph_sha256, count(*) AS n FROM p GROUP BY 1, 2")
def ocr_paragraph_split(spark, sf_dir):
    t = F.replace("text", F.lit(". "), F.lit(".\n\n"))
    each = read(spark, sf_dir, "documents").select("doc_id", F.explode(text.ocr_paragraphs(t)).alias("p"))
    return each.groupBy("doc_id", F.sha2("p", 256).alias("paragraph_sha256")).agg(F.count("*").alias("n"))


@query(
    """
SELECT l_orderkey, l_linenumber - 1 AS pos, round(l_partkey / 500, 6) AS x0, round(l_suppkey / 700, 6) AS top, round((l_partkey + l_quantity) / 500, 6) AS x1, round((l_suppkey + l_linenumber) / 700, 6) AS bottom, trim(' ' || l_linestatus || ' ') AS text
FROM (SELECT *, CAST(l_linenumber AS DOUBLE) AS n FROM lineitem) WHERE l_linenumber % 3 > 0 AND l_linenumber % 4 > 0 AND l_returnflag <> 'R' AND l_returnflag <> 'A' AND l_linestatus = 'F'
""".replace("l_linenumber - 1 AS pos", "CAST(l_linenumber AS INTEGER) AS line")
)
def ocr_tsv_words(spark, sf_dir):
    """Lines of an order as the tab-separated output of an OCR program, read back by its header."""
    n, tab = F.col("l_linenumber"), F.lit("\t")
    level = F.when(n % 3 > 0, "5").otherwise("4")
    conf = F.when(F.col("l_returnflag") == "R", "-1").when(F.col("l_linestatus") == "F", "91.5").otherwise("n/a")
    word = F.when(F.col("l_returnflag") == "A", " ").otherwise(F.concat(F.lit(" "), "l_linestatus", F.lit(" ")))
    cells = F.concat_ws("\t", level, F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("string"), n.cast("string"), conf, n.cast("string"), word)
    row = F.when(n % 4 > 0, cells).otherwise(F.concat(cells, tab, F.lit("one cell more")))
    tsv = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))), lambda x: x["r"]), "\n").alias("r"))
    tsv = tsv.select("l_orderkey", F.concat(F.lit("level\tleft\ttop\twidth\theight\tconf\tline\ttext\n"), "r").alias("tsv"))
    rows = readers.tsv_rows(tsv, ["l_orderkey"]).select("l_orderkey", *[F.element_at("cells", c).alias(c) for c in ("level", "left", "top", "width", "height", "conf", "line", "text")])
    found = geometry.ocr_words(rows, 500, 700)
    return found.select("l_orderkey", F.col("line").cast("int").alias("line"), *[F.round(c, 6).alias(c) for c in ("x0", "top", "x1", "bottom")], "text")


@query("SELECT l_orderkey, l_linenumber, round(l_partkey / (l_suppkey + 1), 6) AS x0, round(l_quantity / (l_suppkey + 1), 6) AS x1, round(l_partkey / (l_orderkey + 1), 6) AS top, round(l_quantity / (l_orderkey + 1), 6) AS bottom FROM lineitem")
def page_fractions(spark, sf_dir):
    q = F.col("l_quantity")
    boxes = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("x0"), q.alias("x1"), F.col("l_partkey").alias("top"), q.alias("bottom"), (F.col("l_suppkey") + 1).alias("w"), (F.col("l_orderkey") + 1).alias("h"))
    return geometry.normalised(boxes, "w", "h").select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("x0", "x1", "top", "bottom")])


@query("SELECT event_id, upper(coalesce(nullif(trim(CASE event_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN ' red ' END), ''), event_type)) AS truth, CASE WHEN contains(k, 'obvious') THEN 'obvious' WHEN contains(k, 'red') THEN 'subtle' ELSE 'na' END AS subtlety FROM (SELECT *, ['green', 'red_obvious', 'red_subtle', 'yellow_v2'][CAST(event_id % 4 AS INTEGER) + 1] AS k FROM events)")
def truth_labels(spark, sf_dir):
    n = F.col("event_id")
    key = F.get(text.strings(["green", "red_obvious", "red_subtle", "yellow_v2"]), (n % 4).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", text.truth_label(F.when(n % 3 == 0, " ").when(n % 3 == 1, " red "), F.col("event_type")).alias("truth"), text.subtlety(key).alias("subtlety"))


@query("SELECT l_orderkey, CASE WHEN k = n THEN 'all explained' WHEN k = 0 THEN 'none explained' ELSE k || ' of ' || n || ' explained' END AS badge FROM (SELECT l_orderkey, count(*) AS n, count_if(l_returnflag = 'R') AS k FROM lineitem GROUP BY 1)")
def coverage_badges(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    return c.select("l_orderkey", text.coverage_badge(F.col("k"), F.col("n")).alias("badge"))


_ANSWER_LINES = "string_split(replace(replace(text, '. ', '.' || chr(10) || CASE turn % 3 WHEN 0 THEN '- ' WHEN 1 THEN '' ELSE '  ' END), ', ', chr(10)), chr(10))"


@query(f"WITH a AS (SELECT conv_id, turn, {_ANSWER_LINES} AS l FROM conversations) SELECT conv_id, turn, sha256(array_to_string(list_transform(l, lambda x, i: CASE WHEN i > 1 AND trim(x) <> '' AND NOT regexp_matches(x, '^(\\s|[-*] )') AND trim(l[i - 1]) <> '' THEN chr(10) || x ELSE x END), chr(10))) AS shown_sha256 FROM a")
def answer_lines(spark, sf_dir):
    lead = F.when(F.col("turn") % 3 == 0, "- ").when(F.col("turn") % 3 == 1, "").otherwise("  ")
    t = F.replace(F.replace(F.col("text"), F.lit(". "), F.concat(F.lit(".\n"), lead)), F.lit(", "), F.lit("\n"))
    return _conversations(spark, sf_dir).select("conv_id", "turn", F.sha2(text.spaced_lines(t), 256).alias("shown_sha256"))


@query("""SELECT o_orderkey, sha1('["v1","' || o_orderpriority || '","' || o_custkey || '"]') AS key FROM orders""")
def reply_keys(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.cache_key(F.lit("v1"), F.col("o_orderpriority"), F.col("o_custkey")).alias("key"))


@query(
    """
WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS cited, regexp_extract_all(lower(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')), '[a-z]+') AS known FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(cited, lambda x, i: list_position(cited, x) = i AND list_contains(known, x)), ',') AS known FROM c
"""
)
def citations_known(spark, sf_dir):
    """The words of a turn as cited ids, and those of the turn before as the ids that were offered."""
    ids = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0)
    before = F.coalesce(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    turns = _conversations(spark, sf_dir).withColumn("before", before)
    return turns.select("conv_id", "turn", F.array_join(guardrails.known_citations(ids(F.col("text")), ids(F.col("before"))), ",").alias("known"))


@query("SELECT l_partkey AS a, l_suppkey AS b, 'overlap' AS relationship_type, min(l_linestatus) AS explanation FROM lineitem WHERE (l_partkey + l_suppkey) % 3 = 1 GROUP BY 1, 2")
def connections_confirmed(spark, sf_dir):
    """Shortlisted pairs and replies about them: related, not related, or no JSON at all."""
    pairs = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.min("l_linestatus").alias("m"))
    n = (F.col("a") + F.col("b")) % 3
    body = F.concat(F.lit('Sure: {"related": '), F.when(n == 1, "true").otherwise("false"), F.lit(', "relationship_type": "overlap", "explanation": "'), "m", F.lit('"} '))
    return guardrails.confirmed(pairs.select("a", "b"), pairs.select("a", "b", F.when(n == 2, "no answer").otherwise(body).alias("content")))


@query(
    """
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 5 ELSE 4 END AS n, array_to_string(list_concat(['system=S', 'system=' || role], CASE WHEN turn % 2 = 0 THEN ['user=a', 'assistant=b'] ELSE ['user=a'] END, ['user=' || substring(text, 1, 20) || chr(10) || chr(10) || 'R']), '|') AS said FROM conversations
"""
)
def chat_messages(spark, sf_dir):
    say = lambda r, c: F.struct(F.lit(r).alias("role"), F.lit(c).alias("content"))
    past = F.when(F.col("turn") % 2 == 0, F.array(say("user", "a"), say("assistant", "b"))).otherwise(F.array(say("user", "a")))
    m = guardrails.messages(F.lit("S"), F.col("role"), past, F.substring("text", 1, 20), F.lit("R"))
    return _conversations(spark, sf_dir).select("conv_id", "turn", F.size(m).alias("n"), F.array_join(F.transform(m, lambda x: F.concat_ws("=", x["role"], x["content"])), "|").alias("said"))


@query(
    """
SELECT item_id, sha256('Clause (RED):' || chr(10) || text || chr(10) || chr(10) || 'Statutes:' || chr(10) || CASE WHEN item_id % 2 = 0 THEN '- [e1] Act 1: ' || item_id || chr(10) || '- [e2] Act 2: x' ELSE 'No statute was retrieved; cite none.' END) AS prompt_sha256 FROM benchmark
"""
)
def explanation_prompts(spark, sf_dir):
    entry = lambda i, c, e: F.struct(F.lit(i).alias("entry_id"), F.lit(c).alias("citation"), e.alias("excerpt_text"))
    two = F.array(entry("e1", "Act 1", F.col("item_id").cast("string")), entry("e2", "Act 2", F.lit("x")))
    statutes = F.when(F.col("item_id") % 2 == 0, two).otherwise(F.slice(two, 1, 0))
    return read(spark, sf_dir, "benchmark").select("item_id", F.sha2(guardrails.explanation_prompt(F.col("text"), F.lit("RED"), statutes), 256).alias("prompt_sha256"))


@query("SELECT doc_id, 'c001' AS clause_id, doc_id % 9 AS \"order\", lang AS clause_number, source AS section_heading, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_boxes FROM documents")
def clause_contract(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    c = docs.select(F.lit("c001").alias("clause_id"), (F.col("doc_id") % 9).alias("order_index"), F.col("lang").alias("clause_number"), F.col("source").alias("section_heading"), F.col("doc_id").cast("string").alias("text"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1), F.lit(2))).alias("boxes"))
    out = findings.clause_rows(c)
    if out.columns != ["clause_id", "order", "clause_number", "section_heading", "text", "boxes"]:
        raise ValueError(out.columns)
    return out.select(F.col("text").cast("long").alias("doc_id"), "clause_id", "order", "clause_number", "section_heading", F.size("boxes").alias("n_boxes"))


@query("SELECT o_orderkey, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1")
def children_in_order(spark, sf_dir):
    children = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    out = store.with_children(read(spark, sf_dir, "orders").select("o_orderkey"), children, "o_orderkey", "l_linenumber", "items")
    return out.select("o_orderkey", F.array_join(F.transform("items", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query(
    """
WITH h AS (SELECT item_id % 8 AS topic, list({'c': 'Act ' || (item_id % 10), 'e': text, 'u': 'https://a.example/' || (item_id % 6)}) AS held FROM benchmark WHERE item_id % 3 > 0 GROUP BY 1),
c AS (SELECT item_id, item_id % 8 AS topic, 'Act ' || (item_id % 7) AS citation, CASE item_id % 4 WHEN 0 THEN text || ' ' WHEN 1 THEN upper(text) ELSE text END AS excerpt, 'https://a.example/' || (item_id % 6) || CASE WHEN item_id % 5 = 0 THEN '/' ELSE '' END AS url FROM benchmark)
SELECT item_id, len([x FOR x IN held IF x.c = citation]) > 0 AS citation_ok, len([x FOR x IN held IF x.e = excerpt]) > 0 AS excerpt_ok, len([x FOR x IN held IF x.u = url]) > 0 AS url_ok FROM c JOIN h USING (topic)
"""
)
def traceability(spark, sf_dir):
    """Is a claimed citation, excerpt or URL, byte for byte, that of some entry retrieved for its topic?"""
    n = F.col("item_id")
    items = read(spark, sf_dir, "benchmark").withColumn("topic", n % 8)
    url = F.concat(F.lit("https://a.example/"), (n % 6).cast("string"))
    entry = F.struct(F.concat(F.lit("Act "), (n % 10).cast("string")).alias("citation"), F.col("text").alias("excerpt_text"), url.alias("source_url"))
    held = items.where("item_id % 3 > 0").groupBy("topic").agg(F.collect_list(entry).alias("held"))
    claimed = items.join(held, "topic")
    excerpt = F.when(n % 4 == 0, F.concat("text", F.lit(" "))).when(n % 4 == 1, F.upper("text")).otherwise(F.col("text"))
    said = {"citation": F.concat(F.lit("Act "), (n % 7).cast("string")), "excerpt_text": excerpt, "source_url": F.concat(url, F.when(n % 5 == 0, "/").otherwise(""))}
    return claimed.select("item_id", *[retrieval.traceable(F.col("held"), field, c).alias(name) for (field, c), name in zip(said.items(), ("citation_ok", "excerpt_ok", "url_ok"), strict=True)])


@query(
    f"""
WITH {_QUERIES_SQL}
SELECT q.jurisdiction, kb.jurisdiction AS entry_jurisdiction, count(*) AS n, count(DISTINCT q.doc_id) AS queries FROM q JOIN kb ON q.topic = kb.topic AND kb.jurisdiction IN (q.jurisdiction, 'Central') AND q.jurisdiction IN ('Maharashtra', 'Delhi') GROUP BY 1, 2
"""
)
def isolation_policy(spark, sf_dir):
    """What each state retrieves, by the state of the entry, through a bridge that names every entry for every state: isolation must not depend on it."""
    asked, bridge, entries = _query_tables(spark, sf_dir)
    every = bridge.withColumn("jurisdiction", F.explode(text.strings([*(r["jurisdiction"] for r in retrieval.central_policy()), "Central", "Karnataka"])))
    found = retrieval.retrieve(asked, every, entries, "doc_id", central=True)
    return found.groupBy("jurisdiction", "entry_jurisdiction").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("queries"))


@query(
    f"""
WITH {_QUERIES_SQL}, f AS (SELECT q.doc_id, q.jurisdiction, kb.jurisdiction AS other FROM q JOIN kb ON q.topic = kb.topic AND (kb.jurisdiction IN (q.jurisdiction, 'Central') OR q.doc_id % 5 = 0) WHERE q.jurisdiction IS NOT NULL),
n AS (SELECT jurisdiction, count(*) AS queries, CAST(count_if(doc_id IN (SELECT doc_id FROM f)) AS BIGINT) AS matched FROM q GROUP BY 1)
SELECT jurisdiction, queries, matched, round(matched / queries, 6) AS share, coalesce((SELECT CAST(count_if(other NOT IN (n.jurisdiction, 'Central')) AS BIGINT) FROM f WHERE f.jurisdiction = n.jurisdiction), 0) AS leaks FROM n
"""
)
def leak_audit(spark, sf_dir):
    """The coverage report of a retrieval that leaks on purpose: for every fifth document it takes the entries of any state."""
    asked, _, entries = _query_tables(spark, sf_dir)
    kb = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("topic")).join(entries.select("entry_id", F.col("jurisdiction").alias("entry_jurisdiction")), "entry_id")
    leaky = asked.where("jurisdiction IS NOT NULL").join(kb, "topic").where((F.col("entry_jurisdiction") == F.col("jurisdiction")) | (F.col("entry_jurisdiction") == "Central") | (F.col("doc_id") % 5 == 0))
    ranked = leaky.select("doc_id", "jurisdiction", "entry_jurisdiction", F.col("entry_id").cast("string").alias("entry_id"), F.lit(1).alias("rank"))
    return retrieval.coverage(retrieval.retrieved_arrays(asked, ranked, "doc_id"), ranked).withColumn("share", F.round("share", 6))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x * x)) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 1e-12), 4) AS length FROM embeddings")
def unit_vectors(spark, sf_dir):
    v = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.dot(vectors.unit(v), v), 4).alias("length"))


@query(
    """
WITH t AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), m AS (SELECT label, vec_id % 3 AS g, count(*) FILTER (vec_id % 4 > 0) AS n FROM t GROUP BY 1, 2),
s AS (SELECT label, vec_id % 3 AS g, i, sum(CASE WHEN vec_id % 4 > 0 THEN x ELSE 0 END) AS v FROM (SELECT label, vec_id, unnest(e) AS x, unnest(range(0, len(e))) AS i FROM t) GROUP BY 1, 2, 3),
p AS (SELECT label, g, i, v / greatest(n, 1e-9) AS v FROM s JOIN m USING (label, g)), u AS (SELECT label, g, greatest(sqrt(sum(v * v)), 1e-12) AS norm FROM p GROUP BY 1, 2)
SELECT label, g, round(sum(v / norm * (i + 1)), 5) AS weighed FROM p JOIN u USING (label, g) GROUP BY 1, 2
"""
)
def pooled_embeddings(spark, sf_dir):
    """Token vectors, some masked, pooled to one unit vector a text."""
    v = read(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 3).alias("g"), "embedding", (F.col("vec_id") % 4 > 0).alias("mask"), "vec_id")
    out = vectors.pooled(v, ["label", "g"], "vec_id", "embedding", "mask")
    return out.select("label", "g", F.round(F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 5).alias("weighed"))


_COMPONENTS = f"{_PAIRS}, e AS (SELECT a, b FROM p WHERE s >= 0.42), r(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), c AS (SELECT id, min(root) AS component FROM r GROUP BY id)"


@query(f"WITH RECURSIVE {_COMPONENTS}, d AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS cluster FROM c GROUP BY component) SELECT id, CAST(cluster AS INTEGER) AS cluster, id = component AS kept FROM c JOIN d USING (component)")
def component_ids(spark, sf_dir):
    """Clusters of similar vectors, numbered by first appearance, and the first row of each, which is kept."""
    v = _vectors(spark, sf_dir)
    edges = vectors.similar(v, v, 0.42, same=True).where("a < b").select("a", "b")
    found = checkpoint(vectors.components(v, edges, checkpoint))
    kept = vectors.keep_first(found).withColumn("kept", F.lit(True))
    return ordering.dense_ids(found, "component", "id", "cluster").join(kept, "id", "left").select("id", "cluster", F.coalesce("kept", F.lit(False)).alias("kept"))


@query(f"WITH {_PAIRS} SELECT a, b, round(s, 6) AS similarity FROM p WHERE a < b ORDER BY round(s, 9) DESC, a, b LIMIT 6")
def top_duplicates(spark, sf_dir):
    """The six most similar pairs, as an audit lists them."""
    best = vectors.shortlist(_vectors(spark, sf_dir), 6, -2.0)
    return best.orderBy(F.round("similarity", 9).desc(), "a", "b").limit(6).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("SELECT l_orderkey, l_linenumber, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'R') WHERE n <= 3")
def first_explained(spark, sf_dir):
    done = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    return ordering.top_per_key(done, ["l_orderkey"], [F.col("l_linenumber")], 3).select("l_orderkey", "l_linenumber", "rank")


_KEYS = ("green", "yellow", "red_obvious", "red_subtle", "green_v2", "yellow_v2", "red_subtle_v2")


@query(
    f"""
WITH t AS (SELECT r_regionkey AS topic_idx, r_name AS topic, unnest([{", ".join(f"'{k}'" for k in _KEYS)}]) AS key FROM region),
s AS (SELECT n_nationkey AS state_idx, n_name AS state FROM nation WHERE n_nationkey < 5),
b AS (SELECT *, (state_idx - topic_idx + 5) % 5 AS place FROM t, s)
SELECT topic, state, upper(string_split(key, '_')[1]) AS label, key || ' of ' || state || ' in flat ' || state_idx AS text,
  CASE WHEN key LIKE 'red%_v2' THEN 'extra-subtle' WHEN key LIKE '%_v2' THEN 'extra' WHEN key = 'red_obvious' THEN 'base-obvious' WHEN key = 'red_subtle' THEN 'base-subtle' ELSE 'base' END AS round
FROM b WHERE key IN ('green', 'yellow') OR (key = 'red_obvious' AND place < 3) OR (key = 'red_subtle' AND place >= 3) OR (key LIKE '%_v2' AND topic IN ('ASIA', 'EUROPE'))
"""
)
def template_rounds(spark, sf_dir):
    templates = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("topic_idx"), F.col("r_name").alias("topic"), F.explode(text.strings(_KEYS)).alias("key"))
    templates = templates.withColumn("template", F.concat("key", F.lit(" of {l1} in {premises}")))
    states = read(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("state_idx"), F.col("n_name").alias("state"), F.col("n_name").alias("l1"), F.lit("x").alias("l2"), F.concat(F.lit("flat "), F.col("n_nationkey").cast("string")).alias("premises"))
    return readers.template_rounds(templates, states, ["ASIA", "EUROPE"])


_ATTEMPTS = """a AS (SELECT user_id AS key, n - 1 AS attempt, CASE WHEN value < 40 THEN 200 WHEN value < 120 THEN 429 WHEN value < 200 THEN 503 WHEN value < 210 THEN 401 ELSE 200 END AS status,
  CASE WHEN value >= 40 AND value < 60 THEN 'Limit Per Day reached' ELSE 'slow down' END AS body, CASE WHEN value >= 210 THEN event_type END AS content, CASE WHEN value < 90 THEN '2.5' WHEN value < 100 THEN 'soon' END AS retry_after
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)),
v AS (SELECT *, CASE WHEN status = 429 AND contains(lower(body), 'per day') THEN 'quota' WHEN status = 429 THEN 'limited' WHEN status >= 500 THEN 'unavailable' WHEN status >= 400 THEN 'refused' WHEN coalesce(content, '') <> '' THEN 'ok' ELSE 'empty' END AS verdict FROM a WHERE attempt < 5)"""


@query(
    f"""
WITH {_ATTEMPTS}, e AS (SELECT *, min(CASE WHEN verdict IN ('ok', 'quota', 'refused') THEN attempt END) OVER (PARTITION BY key) AS stop FROM v), u AS (SELECT * FROM e WHERE stop IS NULL OR attempt <= stop),
g AS (SELECT key, arg_max(verdict, attempt) AS fin, arg_max(coalesce(content, ''), attempt) AS content, count(*) AS attempts,
  sum(CASE WHEN attempt >= coalesce(stop, 4) THEN 0 WHEN verdict = 'limited' THEN CASE WHEN retry_after = '2.5' THEN 2.5 ELSE 5 * pow(2, attempt) END WHEN verdict = 'unavailable' THEN 5 * pow(2, attempt) ELSE 0 END) AS waited FROM u GROUP BY 1)
SELECT key, CASE WHEN fin = 'ok' THEN content END AS content, CASE fin WHEN 'ok' THEN NULL WHEN 'quota' THEN 'daily limit' WHEN 'refused' THEN 'refused' ELSE 'no reply' END AS error, attempts, CAST(waited AS DOUBLE) AS waited FROM g
"""
)
def reply_outcomes(spark, sf_dir):
    v = F.col("value")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    status = F.when(v < 40, 200).when(v < 120, 429).when(v < 200, 503).when(v < 210, 401).otherwise(200)
    attempts = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), n.alias("attempt"), status.alias("status"), F.when((v >= 40) & (v < 60), "Limit Per Day reached").otherwise("slow down").alias("body"),
        F.when(v >= 210, F.col("event_type")).alias("content"), F.when(v < 90, "2.5").when(v < 100, "soon").alias("retry_after"),
    )
    return replies.outcomes(attempts, limit=5)


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) AS cached FROM orders")
def cached_replies(spark, sf_dir):
    work = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    cache = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    have, lack = replies.cached(work, cache)
    return have.select("o_orderkey", F.lit(True).alias("cached")).unionByName(lack.select("o_orderkey", F.lit(False).alias("cached")))


_SAYS = "trim(regexp_replace(substring(reply, 1, 300), '[^A-Za-z0-9., ]', ' ', 'g'))"
_CITES = "CASE turn % 4 WHEN 0 THEN [] WHEN 1 THEN ['e1'] WHEN 2 THEN ['e1', 'e2'] ELSE ['x9'] END"


@query(
    f"""
WITH {_PAIRS_SQL}, c AS (SELECT conv_id, turn, text, CASE WHEN conv_id % 11 > 0 THEN {_LABEL_SQL} END AS label, {_SAYS} AS says, substring({_SAYS}, 1, 5 * CAST(turn % 8 AS INTEGER)) AS concern, {_CITES} AS cites,
  conv_id % 7 = 0 AS none, conv_id % 5 = 0 AS broken FROM p),
t AS (SELECT *, trim(concern) AS con, {sql_words('says', rules.GROUNDING_STOP_WORDS, 2)} AS w, {sql_words('text', rules.GROUNDING_STOP_WORDS, 2)} AS src, regexp_extract_all(says, '{rules.NUMBER}') AS rn, regexp_extract_all(text, '{rules.NUMBER}') AS sn,
  says || ' ' || trim(concern) || ' ' || array_to_string(list_transform(cites, lambda x: 'as said'), ' ') AS everything, label IS NOT NULL AND NOT none AND says <> '' AS explained FROM c),
g AS (SELECT *, NOT list_contains(cites, 'x9') AS a, len(regexp_extract_all(everything, '{rules.STATUTE_REFERENCE}')) = 0 OR len(cites) > 0 AS b,
  len(list_filter(rn, lambda x: NOT list_contains(sn, x))) = 0 AND (CASE WHEN len(w) > 0 THEN len(list_intersect(w, src)) / len(w) ELSE 0 END >= 0.2 OR len(list_intersect(w, src)) >= 2) AS d,
  NOT regexp_matches(everything, '{_CONCLUSIONS_SQL}') AS e, label = 'GREEN' OR length(con) >= 20 AS f FROM t)
SELECT conv_id, turn, label, CASE WHEN explained THEN sha256(says) END AS says_sha256, CASE WHEN explained THEN a END AS citation_restricted, CASE WHEN explained THEN b END AS no_smuggled_citation, CASE WHEN explained THEN a AND b AND d AND e AND f END AS passed,
  CASE WHEN label IS NULL THEN 'classification failed' WHEN none THEN 'explanation generation failed: no JSON object' WHEN says = '' THEN 'explanation generation failed: document_says is empty' END AS error FROM g
"""
)
def explained_review(spark, sf_dir):
    """User turns as classified clauses, explained and checked from saved replies; some replies need the retry, some never parse."""
    label = F.element_at(text.strings(rules.LABELS), (F.col("turn") % 3 + 1).cast("int"))
    says = F.trim(F.regexp_replace(F.substring("reply", 1, 300), "[^A-Za-z0-9., ]", " "))
    concern = says.substr(F.lit(1), 5 * (F.col("turn") % 8))
    cites = F.when(F.col("turn") % 4 == 0, F.array().cast("array<string>")).when(F.col("turn") % 4 == 1, text.strings(["e1"])).when(F.col("turn") % 4 == 2, text.strings(["e1", "e2"])).otherwise(text.strings(["x9"]))
    support = F.transform(cites, lambda c: F.struct(c.alias("entry_id"), F.lit("as said").alias("how_it_applies")))
    good = F.concat(F.lit("Here: "), F.to_json(F.struct(says.alias("document_says"), concern.alias("concern"), support.alias("statute_support"))))
    p = _turn_pairs(spark, sf_dir).withColumn("good", good)
    clauses = p.select("conv_id", "turn", "text", F.when(F.col("conv_id") % 11 > 0, label).alias("label"), text.strings(["e1", "e2", "e3"]).alias("retrieved"))
    bad = (F.col("conv_id") % 5 == 0) & (F.col("conv_id") % 7 > 0)
    content = F.when(F.col("conv_id") % 7 == 0, "I cannot say").when(bad & (F.col("attempt") == 0), "{broken").otherwise(F.col("good"))
    saved = p.withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("conv_id", "turn", "attempt", content.alias("content"))
    out = replies.document_review(clauses, saved, ["conv_id", "turn"])
    checks = F.col("grounding.checks")
    return out.select("conv_id", "turn", "label", F.sha2("explanation.document_says", 256).alias("says_sha256"), F.element_at(checks, "CITATION_RESTRICTED").alias("citation_restricted"), F.element_at(checks, "NO_SMUGGLED_CITATION").alias("no_smuggled_citation"), F.col("grounding.passed").alias("passed"), "error")


@query(
    """
SELECT source, doc_id AS order_index, lang, CASE WHEN l.doc_id IS NULL THEN 'Y' ELSE 'N' END AS failed, 'e' || doc_id % 3 AS statute FROM documents LEFT JOIN labels l USING (doc_id)
"""
)
def nested_result_rows(spark, sf_dir):
    """The nested export of each document, read back row by row: order, fields kept, public error text, no raw error."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    statute = F.struct(F.concat(F.lit("e"), (F.col("doc_id") % 3).cast("string")).alias("entry_id"), F.lit("secret").alias("notes"))
    c = docs.join(labels, "doc_id", "left").select("source", F.col("doc_id").alias("order_index"), F.col("doc_id").cast("string").alias("clause_id"), "lang", F.when(F.col("toxic").isNull(), "Traceback: key=abc").alias("error"), F.array(statute).alias("retrieved_statutes"))
    links = c.limit(0).select("source", F.col("clause_id").alias("clause_id_a"), F.col("clause_id").alias("clause_id_b"), F.lit("").alias("relationship_type"), F.lit("").alias("explanation"))
    nested = store.serialised(c, links, "source", ["lang"], ["entry_id"]).select("source", F.to_json("clauses").alias("j"))
    back = nested.select("source", F.explode(F.from_json("j", "array<struct<order_index:bigint,lang:string,error:string,clause_id:string,retrieved_statutes:array<struct<entry_id:string,notes:string>>>>")).alias("c"))
    leaked = F.col("c.clause_id").isNotNull() | F.get("c.retrieved_statutes", F.lit(0))["notes"].isNotNull()
    failed = F.when(leaked, "leak").when(F.col("c.error") == rules.ERROR_OTHER, "Y").when(F.col("c.error").isNull(), "N").otherwise(F.col("c.error"))
    return back.select("source", "c.order_index", "c.lang", failed.alias("failed"), F.get("c.retrieved_statutes", F.lit(0))["entry_id"].alias("statute"))


@query("SELECT 'ok' AS status, count(*) > 0 AS store_answers FROM region")
def liveness(spark, sf_dir):
    return read(spark, sf_dir, "region").limit(1).agg(F.count("*").alias("n")).select(F.when(F.col("n") > 0, "ok").otherwise("degraded").alias("status"), (F.col("n") > 0).alias("store_answers"))
