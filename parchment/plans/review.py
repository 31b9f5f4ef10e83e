"""Queries of retrieval, tagging, guardrails and names on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import guardrails, ordering, retrieval
from ..operators.common import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_words(column: str, stop=(), longer: int = 0) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({column}), '[a-z]+')), lambda x: x NOT IN ({quoted(stop or ('',))}) AND length(x) > {longer})"


_QUERIES_SQL = """q AS (
  SELECT doc_id, text, source AS topic, CASE lang WHEN 'en' THEN 'Maharashtra' WHEN 'fr' THEN 'Delhi' WHEN 'de' THEN 'Karnataka' END AS jurisdiction FROM documents
), kb AS (
  SELECT item_id, text, 'src' || (item_id % 20) AS topic, CASE item_id % 3 WHEN 0 THEN 'Maharashtra' WHEN 1 THEN 'Delhi' ELSE 'Central' END AS jurisdiction FROM benchmark
)"""


def _query_tables(spark, sf_dir):
    lang = F.col("lang")
    state = F.when(lang == "en", "Maharashtra").when(lang == "fr", "Delhi").when(lang == "de", "Karnataka")
    asked = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("topic"), state.alias("jurisdiction"))
    rest = F.col("item_id") % 3
    held = F.when(rest == 0, "Maharashtra").when(rest == 1, "Delhi").otherwise("Central")
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry_id"), "text", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("topic"), held.alias("jurisdiction"))
    return asked, items.select("jurisdiction", "topic", "entry_id"), retrieval.with_words(items, "text")


def _ranked_sql(states: str) -> str:
    return f"""
WITH {_QUERIES_SQL}, c AS (
  SELECT q.doc_id, q.jurisdiction, q.topic, kb.item_id AS entry_id, kb.jurisdiction AS entry_jurisdiction,
         CAST(len(list_intersect({sql_words('q.text', rules.RETRIEVAL_STOP_WORDS)}, {sql_words('kb.text', rules.RETRIEVAL_STOP_WORDS)})) AS INTEGER) AS score
  FROM q JOIN kb ON q.topic = kb.topic AND kb.jurisdiction IN ({states}) WHERE q.jurisdiction IN ('Maharashtra', 'Delhi')
)
SELECT doc_id, entry_id, jurisdiction, entry_jurisdiction, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, entry_id) AS INTEGER) AS rank FROM c
"""


_RANKED = ("doc_id", "entry_id", "jurisdiction", "entry_jurisdiction", "score", "rank")


@query(_ranked_sql("q.jurisdiction"))
def retrieval_ranked(spark, sf_dir):
    asked, bridge, entries = _query_tables(spark, sf_dir)
    return retrieval.retrieve(asked, bridge, entries, "doc_id").select(*_RANKED)


@query(_ranked_sql("q.jurisdiction, 'Central'"))
def retrieval_policy_central(spark, sf_dir):
    asked, bridge, entries = _query_tables(spark, sf_dir)
    return retrieval.retrieve(asked, bridge, entries, "doc_id", central=True).select(*_RANKED)


@query(
    f"""
WITH {_QUERIES_SQL}, n AS (SELECT q.doc_id, q.jurisdiction, count(kb.item_id) AS c FROM q LEFT JOIN kb ON q.topic = kb.topic AND kb.jurisdiction IN (q.jurisdiction, 'Central') AND q.jurisdiction IN ('Maharashtra', 'Delhi') GROUP BY 1, 2)
SELECT jurisdiction, count(*) AS queries, CAST(count_if(c > 0) AS BIGINT) AS matched, round(CAST(count_if(c > 0) AS BIGINT) / count(*), 6) AS share, CAST(0 AS BIGINT) AS leaks FROM n GROUP BY 1
"""
)
def retrieval_coverage(spark, sf_dir):
    asked, bridge, entries = _query_tables(spark, sf_dir)
    entries = entries.withColumn("entry_id", F.col("entry_id").cast("string"))
    ranked = retrieval.retrieve(asked, bridge.withColumn("entry_id", F.col("entry_id").cast("string")), entries, "doc_id", central=True)
    out = retrieval.coverage(retrieval.retrieved_arrays(asked, ranked, "doc_id").withColumn("jurisdiction", F.col("jurisdiction")), ranked)
    return out.withColumn("share", F.round("share", 6))


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' AND list_contains([lang, source, 'len' || (n_chars // 1000)], 'src3')")
def array_membership_filter(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    tags = F.array("lang", "source", F.concat(F.lit("len"), F.expr("n_chars div 1000").cast("string")))
    return retrieval.tagged(docs.withColumns({"topic_tags": tags, "jurisdiction": F.col("lang")}), F.lit("en"), F.lit("src3")).select("doc_id", "source")


@query(
    """
SELECT item_id AS entry_id, problem FROM (
  SELECT item_id, unnest(list_filter([CASE WHEN trim(text) = '' THEN 'missing citation' END, CASE WHEN item_id % 7 = 0 THEN 'jurisdiction' END,
    CASE WHEN length(text) < 100 THEN 'no topic tags' END, CASE WHEN item_id % 5 = 0 THEN 'source_url scheme' END,
    CASE WHEN count(*) OVER (PARTITION BY length(text)) > 1 THEN 'citation not unique' END], lambda x: x IS NOT NULL)) AS problem FROM benchmark)
"""
)
def corpus_violations(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark")
    entries = items.select(
        F.col("item_id").alias("entry_id"),
        F.when(F.col("item_id") % 7 == 0, "Goa").otherwise("Delhi").alias("jurisdiction"),
        F.length("text").cast("string").alias("citation"),
        F.col("text").alias("excerpt_text"),
        F.when(F.col("item_id") % 5 == 0, "ftp://x").otherwise("https://x").alias("source_url"),
        F.when(F.length("text") < 100, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("topic_tags"),
    )
    return retrieval.violations(entries)


#: Word rules that occur in the test corpus, in order of priority.  Boundaries are spelled out: engines differ on \\b beside non-ASCII letters.
_A, _Z = "(?i)(?:^|[^a-z])", "(?:$|[^a-z])"
WORD_TOPICS = (("ending", f"{_A}(with|from){_Z}"), ("joining", f"{_A}(and|und|et){_Z}"), ("place", f"{_A}(in|de){_Z}"), ("plain", f"{_A}the{_Z}"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in WORD_TOPICS) + " END AS topic FROM documents")
def topic_tag_first_match(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.topic(F.col("text"), table=WORD_TOPICS).alias("topic"))


_FIRST, _SECOND, _OTHERS = ("A", f"{_A}(with|from|avec){_Z}"), ("B", f"{_A}(para|pour|and){_Z}"), (("C", f"{_A}(nicht){_Z}"), ("D", f"{_A}(des|del){_Z}"))
_TABLES = {"first": _FIRST, "second": _SECOND, "others": _OTHERS}


def _hint_sql(column: str) -> str:
    a = f"list_sort(list_distinct(list_transform(regexp_extract_all({column}, '{_FIRST[1]}', 1), lambda x: lower(x))))"
    b = f"list_sort(list_distinct(list_transform(regexp_extract_all({column}, '{_SECOND[1]}', 1), lambda x: lower(x))))"
    other = "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for n, p in _OTHERS) + " END"
    return f"""CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN NULL WHEN len({a}) > 0 THEN 'A' WHEN len({b}) > 0 THEN 'B' END AS jurisdiction,
      array_to_string(list_concat({a}, {b}), ',') AS evidence, CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {other} END AS unsupported_hint, len({a}) > 0 AND len({b}) > 0 AS ambiguous"""


@query(f"SELECT doc_id, {_hint_sql('text')} FROM documents")
def jurisdiction_row(spark, sf_dir):
    hint = text.jurisdiction(F.col("text"), **_TABLES)
    out = read(spark, sf_dir, "documents").select("doc_id", hint.alias("h")).select("doc_id", "h.*")
    return out.withColumn("evidence", F.array_join("evidence", ","))


@query(
    f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
h AS (SELECT doc_id, pos, {_hint_sql('line')} FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM h WHERE jurisdiction IS NOT NULL OR unsupported_hint IS NOT NULL OR ambiguous)
SELECT d.doc_id, coalesce(r.pos, -1) AS first_pos, r.jurisdiction, r.unsupported_hint, coalesce(r.ambiguous, false) AS ambiguous FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND n = 1
"""
)
def jurisdiction_first_in_doc(spark, sf_dir):
    lines = lines_of(read(spark, sf_dir, "documents")).withColumn("hint", text.jurisdiction(F.col("text"), **_TABLES))
    out = ordering.first_signal(lines, "doc_id", "pos", "hint")
    return out.select("doc_id", F.coalesce("at", F.lit(-1)).cast("long").alias("first_pos"), "hint.jurisdiction", "hint.unsupported_hint", F.coalesce("hint.ambiguous", F.lit(False)).alias("ambiguous"))


def lines_of(docs):
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


@query(f"SELECT doc_id, CASE WHEN named IS NOT NULL AND named IS DISTINCT FROM lang THEN named END AS refused FROM (SELECT doc_id, lang, coalesce(jurisdiction, unsupported_hint) AS named FROM (SELECT doc_id, lang, {_hint_sql('text')} FROM documents))")
def out_of_scope_state(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.out_of_scope_state(F.col("text"), F.col("lang"), **_TABLES).alias("refused"))


def _turn_pairs(spark, sf_dir):
    """User turns as clauses with the assistant turn that follows as the explanation."""
    turns = read(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    return turns.withColumns({"reply_role": F.lead("role").over(w), "reply": F.lead("text").over(w)}).where("role = 'user' AND reply_role = 'assistant'")


_PAIRS_SQL = """p AS (SELECT * FROM (SELECT conv_id, turn, role, text, lead(role) OVER w AS reply_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND reply_role = 'assistant')"""
_CONCLUSIONS_SQL = "(?i)" + "|".join(f"(?:{p})" for p in rules.CONCLUSIONS)
_VERDICTS_SQL = "(?i)" + "|".join(f"(?:{p})" for p in rules.VERDICTS)
_LABEL_SQL = "CASE turn % 3 WHEN 0 THEN 'GREEN' WHEN 1 THEN 'YELLOW' ELSE 'RED' END"


@query(
    f"""
WITH {_PAIRS_SQL}, t AS (
  SELECT conv_id, turn, reply, {_LABEL_SQL} AS label, CASE turn % 4 WHEN 0 THEN [] WHEN 1 THEN ['e1'] WHEN 2 THEN ['e1', 'e2'] ELSE ['x9'] END AS cites, {sql_words('reply', rules.GROUNDING_STOP_WORDS, 2)} AS says, {sql_words('text', rules.GROUNDING_STOP_WORDS, 2)} AS src,
    regexp_extract_all(reply, '{rules.NUMBER}') AS rn, regexp_extract_all(text, '{rules.NUMBER}') AS sn FROM p
), c AS (
  SELECT conv_id, turn, NOT list_contains(cites, 'x9') AS citation_restricted, len(regexp_extract_all(reply || ' ' || substring(reply, 1, 30) || ' section 5', '{rules.STATUTE_REFERENCE}')) = 0 OR len(cites) > 0 AS no_smuggled_citation,
    len(list_filter(rn, lambda x: NOT list_contains(sn, x))) = 0 AND (CASE WHEN len(says) > 0 THEN len(list_intersect(says, src)) / len(says) ELSE 0 END >= 0.2 OR len(list_intersect(says, src)) >= 2) AS document_grounded,
    NOT regexp_matches(reply || ' ' || substring(reply, 1, 30), '{_CONCLUSIONS_SQL}') AS no_legal_conclusion, label = 'GREEN' OR length(trim(substring(reply, 1, 30))) >= 20 AS concern_present FROM t
)
SELECT *, citation_restricted AND no_smuggled_citation AND document_grounded AND no_legal_conclusion AND concern_present AS passed FROM c
"""
)
def grounding_checks(spark, sf_dir):
    rest = F.col("turn") % 4
    cites = F.when(rest == 0, F.array().cast("array<string>")).when(rest == 1, text.strings(["e1"])).when(rest == 2, text.strings(["e1", "e2"])).otherwise(text.strings(["x9"]))
    label = F.element_at(text.strings(rules.LABELS), (F.col("turn") % 3 + 1).cast("int"))
    out = guardrails.grounded(_turn_pairs(spark, sf_dir), F.col("reply"), F.substring("reply", 1, 30), label, cites, F.lit("section 5"), F.col("text"), text.strings(["e1", "e2", "e3"]), out="g")
    names = ("CITATION_RESTRICTED", "NO_SMUGGLED_CITATION", "DOCUMENT_GROUNDED", "NO_LEGAL_CONCLUSION", "CONCERN_PRESENT")
    return out.select("conv_id", "turn", *[F.element_at("g.checks", n).alias(n.lower()) for n in names], "g.passed")


_MARKED = "regexp_replace(regexp_replace(reply, '(?m)^\\s*\\d+[.)]\\s', ' ', 'g'), '" + rules.ID_TOKEN + "', ' ', 'g')"
_PROBLEMS_SQL = f"""list_filter([CASE WHEN regexp_matches(reply, '{_VERDICTS_SQL}') THEN 'verdict' END,
  CASE WHEN len(list_filter(regexp_extract_all(reply, '{rules.STATUTE_REFERENCE}'), lambda m: NOT contains('act, 1908', lower(m)))) > 0 THEN 'uncited_law' END,
  CASE WHEN len(list_filter(regexp_extract_all({_MARKED}, '{rules.NUMBER}'), lambda x: NOT list_contains(regexp_extract_all(text || ' rent ' || turn || ' 12 of 30 act, 1908', '{rules.NUMBER}'), x))) > 0 THEN 'invented_number' END], lambda x: x IS NOT NULL)"""


def _problems():
    rent = F.concat(F.lit("rent "), F.col("turn").cast("string"))
    return guardrails.violations(F.col("reply"), F.col("text"), F.array(rent), F.array(F.lit("act, 1908")), F.array(F.lit("12 of 30")))


@query(f"WITH {_PAIRS_SQL} SELECT conv_id, turn, array_to_string({_PROBLEMS_SQL}, ',') AS problems FROM p")
def chat_violations(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.array_join(_problems(), ",").alias("problems"))


@query(
    f"""
WITH {_PAIRS_SQL}, a AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS attempt, reply AS answer, {_PROBLEMS_SQL} AS problems, turn % 4 = 2 AS oos FROM p
), s AS (
  SELECT *, len(problems) = 0 AS safe, len(problems) = 0 AND (oos OR regexp_matches(answer, '(?m)^\\s*[-*] ')) AS good FROM a WHERE attempt <= 2
), k AS (SELECT *, min(CASE WHEN good THEN attempt END) OVER (PARTITION BY conv_id) AS stop FROM s), v AS (SELECT * FROM k WHERE stop IS NULL OR attempt <= stop)
SELECT conv_id, sha256(coalesce(arg_max(CASE WHEN safe THEN answer END, CASE WHEN safe THEN attempt END), '')) AS answer_sha256,
  CASE WHEN CAST(count_if(safe) AS BIGINT) > 0 THEN 'answered' WHEN list_contains(arg_max(problems, attempt), 'verdict') THEN 'verdict fallback' ELSE 'unreliable fallback' END AS outcome, CAST(max(attempt) AS INTEGER) AS attempts
FROM v GROUP BY conv_id
"""
)
def chat_attempt_selection(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    attempts = _turn_pairs(spark, sf_dir).select("conv_id", n.alias("attempt"), F.col("reply").alias("answer"), _problems().alias("problems"), (F.col("turn") % 4 == 2).alias("out_of_scope"))
    out = guardrails.select_attempts(attempts, "conv_id")
    return out.select("conv_id", F.sha2(F.coalesce("answer", F.lit("")), 256).alias("answer_sha256"), "outcome", "attempts")


@query("SELECT conv_id, turn, role, substring(text, 1, 1000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 AND role IN ('user', 'assistant') AND coalesce(text, '') <> ''")
def history_window(spark, sf_dir):
    return ordering.history(read(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant')) WHERE n <= 6")
def client_history_window(spark, sf_dir):
    return ordering.client_history(read(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props IS NOT NULL AND json_extract_string(props, '$.k') IS NULL AS unparsed FROM events")
def json_props_parse(spark, sf_dir):
    wrapped = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" done"))
    x = guardrails.parse(wrapped, "k int")
    return read(spark, sf_dir, "events").select("event_id", x["k"].alias("k"), (F.col("props").isNotNull() & x["k"].isNull()).alias("unparsed"))


@query(
    """
WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'GREEN' WHEN 'click' THEN 'YELLOW' ELSE 'RED' END AS label,
  greatest(value - 100, 0) AS g, greatest(250 - value, 0) AS y, greatest(value - 300, 0) AS r FROM events),
n AS (SELECT *, g + y + r AS total, CASE label WHEN 'GREEN' THEN 1 WHEN 'YELLOW' THEN 2 ELSE 3 END AS i FROM e),
p AS (SELECT event_id, label, i, CASE WHEN total > 0 THEN [g / total, y / total, r / total] ELSE list_transform([1, 2, 3], lambda k: CASE WHEN k = i THEN 0.8 ELSE 0.1 END) END AS p FROM n),
t AS (SELECT *, list_max(p) AS top FROM p),
l AS (SELECT *, list_transform([1, 2, 3], lambda k: CASE WHEN k = i THEN top ELSE p[k] END) AS lifted FROM t),
f AS (SELECT event_id, label, CASE WHEN list_position(p, top) = i THEN p ELSE list_transform(lifted, lambda v: v / list_sum(lifted)) END AS p FROM l)
SELECT event_id, label, round(p[1], 6) AS green, round(p[2], 6) AS yellow, round(p[3], 6) AS red FROM f
"""
)
def label_probabilities(spark, sf_dir):
    kind, value = F.col("event_type"), F.col("value")
    label = F.when(kind == "view", "GREEN").when(kind == "click", "YELLOW").otherwise("RED")
    given = F.create_map(F.lit("GREEN"), value - 100, F.lit("YELLOW"), 250 - value, F.lit("RED"), value - 300)
    p = guardrails.normal_probabilities(label, given)
    out = read(spark, sf_dir, "events").select("event_id", label.alias("label"), p.alias("p"))
    return out.select("event_id", "label", *[F.round(F.element_at("p", x), 6).alias(x.lower()) for x in rules.LABELS])


@query("SELECT c_custkey, CASE WHEN trim(c_mktsegment) <> '' THEN sha256(trim(c_mktsegment || ' ' || c_custkey)) END AS client_key FROM customer")
def sha_client_key(spark, sf_dir):
    header = F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" "))
    return read(spark, sf_dir, "customer").select("c_custkey", text.client_key(header).alias("client_key"))


@query("SELECT page_id, coalesce(nullif(trim(string_split(CASE page_id % 3 WHEN 0 THEN url || ', 10.0.0.1' WHEN 1 THEN ' , x' END, ',')[1]), ''), CASE WHEN page_id % 2 = 0 THEN 'peer' END, 'unknown') AS visitor FROM pages")
def visitor_key(spark, sf_dir):
    n = F.col("page_id")
    forwarded = F.when(n % 3 == 0, F.concat("url", F.lit(", 10.0.0.1"))).when(n % 3 == 1, " , x")
    return read(spark, sf_dir, "pages").select("page_id", text.visitor_key(forwarded, F.when(n % 2 == 0, "peer")).alias("visitor"))


_ERRORS = ["", "Classification failed: x", "Daily limit hit", "HTTP 429", "timeout"]


@query(
    f"""
SELECT event_id, CASE WHEN coalesce(raw, '') = '' THEN NULL WHEN starts_with(lower(raw), 'classification failed') THEN '{rules.ERROR_CLASSIFICATION}'
  WHEN regexp_matches(lower(raw), '{"|".join(rules.LIMIT_MARKERS)}') THEN '{rules.ERROR_LIMIT.replace("'", "''")}' ELSE '{rules.ERROR_OTHER}' END AS public_error
FROM (SELECT event_id, [{quoted(_ERRORS)}][CAST(event_id % 6 AS INTEGER) + 1] AS raw FROM events)
"""
)
def public_error(spark, sf_dir):
    raw = F.get(text.strings(_ERRORS), (F.col("event_id") % 6).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", text.public_error(raw).alias("public_error"))


@query("SELECT doc_id, CASE WHEN length(text) <= 700 THEN text ELSE regexp_replace(substring(text, 1, 700), ' [^ ]*$', '') || ' …' END AS excerpt, substring(text, 1, 140) AS snippet FROM documents")
def excerpt_trim(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"), text.snippet(F.col("text")).alias("snippet"))


@query(
    """
WITH h AS (SELECT doc_id, text, CASE WHEN doc_id % 3 > 0 THEN upper(lang || ' ' || source) END AS heading FROM documents), n AS (SELECT heading FROM h GROUP BY heading HAVING count(*) > 20)
SELECT doc_id, CASE WHEN coalesce(heading, '') <> '' AND heading NOT IN (SELECT heading FROM n WHERE heading IS NOT NULL) THEN upper(substring(heading, 1, 1)) || lower(substring(heading, 2))
  ELSE array_to_string(regexp_split_to_array(text, '\\s+')[1:7], ' ') || '…' END AS name FROM h
"""
)
def display_name(spark, sf_dir):
    h = read(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, F.upper(F.concat_ws(" ", "lang", "source"))).alias("heading"))
    shared = h.groupBy("heading").agg(F.count("*").alias("n")).where("n > 20").select("heading", F.lit(True).alias("shared"))
    return h.join(shared, "heading", "left").select("doc_id", text.display_name(F.col("heading"), F.col("text"), F.col("shared")).alias("name"))


@query(
    """
WITH f AS (SELECT p_partkey, (p_partkey % 90) || '_' || replace(p_name, ' ', '_') || CASE p_partkey % 3 WHEN 0 THEN '_pune' WHEN 1 THEN '_of_the_Leave_License' ELSE '' END || '.pdf' AS filename FROM part),
s AS (SELECT p_partkey, lower(replace(regexp_replace(regexp_replace(filename, '^\\d+_', ''), '(?i)\\.pdf$', ''), '_', '-')) AS slug FROM f),
w AS (SELECT *, string_split(slug, '-') AS ws FROM s), c AS (SELECT *, ws[-1] IN ('mumbai','bangalore','chennai','lucknow','kolkata','chandigarh','jaipur','pune') AS city FROM w),
t AS (SELECT *, replace(array_to_string(list_transform(CASE WHEN city THEN ws[:-2] ELSE ws END, lambda x, i: CASE WHEN i > 1 AND x IN ('and','of','the') THEN x ELSE upper(x[1]) || x[2:] END), ' '), 'Leave License', 'Leave & Licence') AS title FROM c)
SELECT p_partkey, slug, CASE WHEN city THEN title || ' · ' || upper(ws[-1][1]) || ws[-1][2:] ELSE title END AS title FROM t
"""
)
def slug_title(spark, sf_dir):
    n = F.col("p_partkey")
    tail = F.when(n % 3 == 0, "_pune").when(n % 3 == 1, "_of_the_Leave_License").otherwise("")
    name = F.concat((n % 90).cast("string"), F.lit("_"), F.translate("p_name", " ", "_"), tail, F.lit(".pdf"))
    return read(spark, sf_dir, "part").select("p_partkey", text.slug(name).alias("slug"), text.title(name).alias("title"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\d{1,3}(?:,\\d{3})*(?:\\.\\d+)?')) AS n_numbers, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\\s*(?:\\d+(?:\\.\\d+)*[.)])\\s*', ''), '" + rules.BLANK + "', '[blank]', 'g'), '(\\[blank\\]\\s*)+', '[blank] ', 'g'), '\\s+', ' ', 'g'))) AS clean_sha256 FROM documents")
def blanks_and_numbers(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(text.numbers(F.col("text"))).cast("long").alias("n_numbers"), F.sha2(text.fill_blanks(F.col("text")), 256).alias("clean_sha256"))


@query("SELECT conv_id, turn, replace(replace('Why was clause {clause_id} rated {rating}?', '{clause_id}', 'c' || lpad(CAST(turn AS VARCHAR), 3, '0')), '{rating}', CASE turn % 4 WHEN 0 THEN 'Looks standard' WHEN 1 THEN 'Worth a look' WHEN 2 THEN 'Needs attention' ELSE 'not assessed' END) AS question FROM conversations")
def template_question(spark, sf_dir):
    label = F.get(text.strings(rules.LABELS), (F.col("turn") % 4).cast("int"))
    clause = F.format_string("c%03d", "turn")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.question_for(F.lit("Why was clause {clause_id} rated {rating}?"), clause, label).alias("question"))
