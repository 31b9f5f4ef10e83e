"""Queries of metrics, order, store and splits on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import metrics, ordering, splits, store
from ..operators.common import read
from .review import lines_of, sql_words

QUERIES, SQL = {}, {}
_LABEL = "CASE WHEN toxic = 1 THEN 'RED' WHEN quality = 0 THEN 'YELLOW' ELSE 'GREEN' END"
_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _labelled(spark, sf_dir):
    """labels with a risk label, and a prediction by id."""
    true = F.when(F.col("toxic") == 1, "RED").when(F.col("quality") == 0, "YELLOW").otherwise("GREEN")
    guess = F.when(F.col("doc_id") % 5 == 0, "RED").when(F.col("doc_id") % 5 == 1, "YELLOW").otherwise("GREEN")
    return read(spark, sf_dir, "labels").withColumns({"label": true, "predicted": guess})


_L = f"l AS (SELECT doc_id, {_LABEL} AS label, CASE doc_id % 5 WHEN 0 THEN 'RED' WHEN 1 THEN 'YELLOW' ELSE 'GREEN' END AS predicted FROM labels)"


@query(f"WITH {_L}, k(position, label) AS (VALUES (0, 'GREEN'), (1, 'YELLOW'), (2, 'RED')) SELECT position, k.label, count(l.doc_id) AS n, round(count(l.doc_id) / (SELECT count(*) FROM l), 6) AS share FROM k LEFT JOIN l USING (label) GROUP BY 1, 2")
def label_balance(spark, sf_dir):
    return metrics.class_balance(_labelled(spark, sf_dir), "label").withColumn("share", F.round("share", 6))


@query(f"WITH {_L}, c AS (SELECT d.lang, l.label, count(*) AS n FROM l JOIN documents d USING (doc_id) GROUP BY 1, 2) SELECT lang, label, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, CASE label WHEN 'GREEN' THEN 0 WHEN 'YELLOW' THEN 1 ELSE 2 END, label) AS r FROM c) WHERE r = 1")
def majority_label(spark, sf_dir):
    both = _labelled(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.majority(both, ["lang"], "label", 2 - ordering.risk_rank(F.col("label")))


@query(f"WITH {_L} SELECT label AS true_label, CAST(count_if(predicted = 'GREEN') AS BIGINT) AS pred_green, CAST(count_if(predicted = 'YELLOW') AS BIGINT) AS pred_yellow, CAST(count_if(predicted = 'RED') AS BIGINT) AS pred_red FROM l GROUP BY 1")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_labelled(spark, sf_dir), "label", "predicted")


_PRF = f"""{_L}, k(label) AS (VALUES ('GREEN'), ('YELLOW'), ('RED')),
c AS (SELECT k.label, CAST(count_if(l.label = k.label AND predicted = k.label) AS BIGINT) AS tp, CAST(count_if(predicted = k.label) AS BIGINT) AS p, CAST(count_if(l.label = k.label) AS BIGINT) AS support FROM k, l GROUP BY 1),
m AS (SELECT label, support, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re FROM c),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m)"""


@query(f"WITH {_PRF} SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def per_class_prf(spark, sf_dir):
    return metrics.per_class(_labelled(spark, sf_dir), "label", "predicted").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"WITH {_PRF} SELECT (SELECT count(*) FROM l) AS n, round((SELECT avg(CAST(label = predicted AS INTEGER)) FROM l), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(avg(f1) FILTER (support > 0), 6) AS macro_f1_present FROM f")
def accuracy_macro_f1(spark, sf_dir):
    return metrics.summary(_labelled(spark, sf_dir), "label", "predicted").withColumns({c: F.round(c, 6) for c in ("accuracy", "macro_f1", "macro_f1_present")})


_CONF = "e AS (SELECT least(value, 250) / 250 AS conf, event_type IN ('view', 'click') AS ok FROM events)"


def _confident(spark, sf_dir):
    return read(spark, sf_dir, "events").select((F.least("value", F.lit(250.0)) / 250).alias("conf"), F.col("event_type").isin("view", "click").alias("ok"))


@query(f"WITH {_CONF}, k AS (SELECT unnest(range(0, 10)) AS b), j AS (SELECT b, conf, ok FROM k JOIN e ON conf > b / 10 AND conf <= (b + 1) / 10), g AS (SELECT b, count(*) AS n, avg(CAST(ok AS INTEGER)) AS a, avg(conf) AS c FROM j GROUP BY b) SELECT round(sum(n * abs(a - c)) / (SELECT count(*) FROM e), 6) AS ece FROM g")
def calibration_ece(spark, sf_dir):
    return metrics.expected_calibration_error(_confident(spark, sf_dir), "conf", F.col("ok")).select(F.round("ece", 6).alias("ece"))


@query(f"WITH {_CONF} SELECT round(avg(conf), 6) AS mean_confidence, round(avg(CAST(conf >= 0.8 AS INTEGER)), 6) AS coverage, round(avg(CAST(ok AS INTEGER)) FILTER (conf >= 0.8), 6) AS accuracy_when_confident FROM e")
def confident_subset(spark, sf_dir):
    return metrics.confident(_confident(spark, sf_dir), "conf", F.col("ok")).select(*[F.round(c, 6).alias(c) for c in ("mean_confidence", "coverage", "accuracy_when_confident")])


@query("WITH c AS (SELECT lang, count(*) AS n, sum(quality) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1), p AS (SELECT *, k / n AS p, 1.96 AS z FROM c) SELECT lang, n, CAST(k AS BIGINT) AS correct, round((p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS high FROM p")
def wilson_interval(spark, sf_dir):
    both = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    c = both.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("correct"))
    return c.withColumn("w", metrics.wilson(F.col("correct"), F.col("n"))).select("lang", "n", "correct", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


_GAPS = "g AS (SELECT user_id, event_id, ts, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)"
_MODE = "m AS (SELECT user_id, b FROM (SELECT user_id, b, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, b) AS r FROM (SELECT user_id, round_even(CAST(gap * 2 AS DOUBLE), 0) / 2 + CAST(0 AS DOUBLE) AS b, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2)) WHERE r = 1)"


@query(f"WITH {_GAPS}, {_MODE} SELECT user_id, b AS mode_gap FROM m")
def mode_bucket_gap(spark, sf_dir):
    return ordering.mode_bucket(ordering.gaps(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value"), ["user_id"], "gap")


@query(
    """
WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, sum(round(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS top FROM events),
g AS (SELECT *, top - lag(top) OVER (PARTITION BY user_id ORDER BY line_no) AS gap FROM s),
m AS (SELECT user_id, b FROM (SELECT user_id, b, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, b) AS r FROM (SELECT user_id, round_even(CAST(gap * 2 AS DOUBLE), 0) / 2 + CAST(0 AS DOUBLE) AS b, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2)) WHERE r = 1),
p AS (SELECT g.user_id, line_no, event_id, sum(CASE WHEN gap > b * 1.35 THEN 1 ELSE 0 END) OVER (PARTITION BY g.user_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS grp FROM g JOIN m USING (user_id))
SELECT user_id, CAST(min(line_no) AS INTEGER) AS line_no, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY line_no) AS text FROM p GROUP BY user_id, grp
"""
)
def gap_paragraph_grouping(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", F.row_number().over(w).alias("line_no"), F.sum(F.round("value")).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("top"), F.col("event_id").cast("string").alias("text"))
    return ordering.paragraphs_by_gap(e, ["user_id"]).select("user_id", "line_no", "text")


@query(
    f"""
WITH {_LINES}, c AS (SELECT doc_id, pos, t, lag(t) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM l),
g AS (SELECT doc_id, pos, t, sum(CASE WHEN b IS NOT NULL AND NOT (b <> '' AND NOT regexp_matches(b, '[.;:!?]\\s*$') AND regexp_matches(t, '^\\p{{Ll}}')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM c)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS pos, string_agg(t, ' ' ORDER BY pos) AS text FROM g GROUP BY doc_id, grp
"""
)
def rejoin_fragments(spark, sf_dir):
    return ordering.rejoin(lines_of(read(spark, sf_dir, "documents")).drop("lang"), ["doc_id"]).select("doc_id", "pos", "text")


@query(
    f"""
WITH {_LINES}, c AS (SELECT doc_id, pos, t, regexp_matches(t, '^[A-M]') AS bullet FROM l),
g AS (SELECT doc_id, pos, CASE WHEN bullet AND pos > 0 THEN trim(t) ELSE t END AS t, sum(CASE WHEN pos > 0 AND NOT bullet THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM c)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS pos, string_agg(t, ' ' ORDER BY pos) AS text FROM g GROUP BY doc_id, grp
"""
)
def bullet_merge(spark, sf_dir):
    return ordering.merge_bullets(lines_of(read(spark, sf_dir, "documents")).drop("lang"), ["doc_id"], bullet="^[A-M]").select("doc_id", "pos", "text")


@query(f"WITH {_LINES}, s AS (SELECT doc_id, pos, t, max(CASE WHEN regexp_matches(t, '[.;!?:]\\s*$') OR length(t) > 150 OR pos >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) = 0 AS is_title FROM l) SELECT doc_id, CAST(pos AS INTEGER) AS pos, is_title FROM s")
def title_block(spark, sf_dir):
    return ordering.title_block(lines_of(read(spark, sf_dir, "documents")), ["doc_id"]).select("doc_id", "pos", "is_title")


@query(f"WITH {_LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS order_index, printf('c%03d', row_number() OVER (PARTITION BY doc_id ORDER BY pos)) AS clause_id FROM l WHERE length(t) > 20")
def clause_numbering(spark, sf_dir):
    return ordering.numbered(lines_of(read(spark, sf_dir, "documents")).where(F.length("text") > 20), ["doc_id"]).select("doc_id", "pos", "order_index", "clause_id")


_TOKENS = "list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9''/,.\\-]*'), lambda x: lower(regexp_replace(x, '[.,;:]+$', ''))), lambda x: x <> '')"


@query(
    f"""
WITH a AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents), b AS (SELECT doc_id, unnest({_TOKENS.format('substring(text, 1, 1000)')}) AS token FROM documents),
s AS (SELECT doc_id, token, count(*) AS s FROM a GROUP BY 1, 2), e AS (SELECT doc_id, token, count(*) AS e FROM b GROUP BY 1, 2),
d AS (SELECT s.doc_id, s.token, s, greatest(s - coalesce(e, 0), 0) AS lost FROM s LEFT JOIN e USING (doc_id, token))
SELECT doc_id, CAST(sum(s) AS BIGINT) AS source_words, CAST(sum(lost) AS BIGINT) AS missing_words, CAST(sum(CASE WHEN NOT regexp_matches(token, '^[0-9]+$') THEN lost ELSE 0 END) AS BIGINT) AS unexplained_words,
  round(CAST((sum(s) - sum(lost)) * 100.0 / sum(s) AS DOUBLE), 6) AS percent FROM d GROUP BY 1
"""
)
def coverage_multiset(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    source = docs.select("doc_id", F.explode(text.coverage_tokens(F.col("text"))).alias("token"))
    emitted = docs.select("doc_id", F.explode(text.coverage_tokens(F.substring("text", 1, 1000))).alias("token"))
    return metrics.token_loss(source, emitted, ["doc_id"], "^[0-9]+$").withColumn("percent", F.round("percent", 6))


@query("WITH c AS (SELECT doc_id, len(string_split(text, chr(10))) AS e, len(string_split(text, '. ')) AS g FROM documents) SELECT round(sum(greatest(0, e - abs(g - e))) / sum(e), 6) AS accuracy FROM c")
def segmentation_accuracy(spark, sf_dir):
    c = read(spark, sf_dir, "documents").select(F.size(F.split("text", "\n")).alias("e"), F.size(F.split("text", r"\. ")).alias("g"))
    return metrics.segmentation_accuracy(c, "e", "g").select(F.round("accuracy", 6).alias("accuracy"))


_FORM = "lower(text)"
for _p, _r in ((rules.PARTY_A, "PARTY_A"), (rules.PARTY_B, "PARTY_B"), (rules.PROPERTY, "PROPERTY"), (rules.AMOUNT, "AMOUNT"), (r"\s+", " ")):
    _FORM = f"regexp_replace({_FORM}, '{_p}', '{_r}', 'g')"
_CLUSTERS = f"t AS (SELECT doc_id, source, lang, trim({_FORM}) AS template FROM documents), i AS (SELECT template, row_number() OVER (ORDER BY min(doc_id), template) - 1 AS template_id FROM t GROUP BY template)"


def _clusters(spark, sf_dir):
    return splits.template_clusters(read(spark, sf_dir, "documents"), "text", "doc_id")


@query(f"WITH {_CLUSTERS} SELECT doc_id, CAST(template_id AS INTEGER) AS template_id FROM t JOIN i USING (template)")
def normalise_template_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir).select("doc_id", "template_id")


@query("SELECT event_id, CAST(d AS INTEGER) AS dense_id FROM events JOIN (SELECT user_id, row_number() OVER (ORDER BY min(event_id), user_id) - 1 AS d FROM events GROUP BY user_id) USING (user_id)")
def dense_first_seen_ids(spark, sf_dir):
    return ordering.dense_ids(read(spark, sf_dir, "events"), "user_id", "event_id", "dense_id").select("event_id", "dense_id")


@query(f"WITH {_CLUSTERS}, c AS (SELECT template_id, count(DISTINCT source) AS a, count(DISTINCT lang) AS b FROM t JOIN i USING (template) GROUP BY 1) SELECT count(*) AS clusters, CAST(count_if(a > 1) AS BIGINT) AS mixed_source, CAST(count_if(b > 1) AS BIGINT) AS mixed_lang FROM c")
def cluster_purity(spark, sf_dir):
    return metrics.purity(_clusters(spark, sf_dir), "template_id", "source", "lang")


@query(f"WITH {_CLUSTERS}, c AS (SELECT template_id, count(DISTINCT source) AS a FROM t JOIN i USING (template) GROUP BY 1) SELECT count(*) AS groups, CAST(count_if(a > 1) AS BIGINT) AS leaked FROM c")
def split_leakage(spark, sf_dir):
    return metrics.leaks(_clusters(spark, sf_dir), "template_id", "source")


@query("SELECT doc_id, CAST(floor((doc_id - 1) / 30) AS BIGINT) AS block FROM labels")
def block_ids(spark, sf_dir):
    return splits.block_ids(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "block")


@query(f"WITH {_L}, r AS (SELECT doc_id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || '|42'), doc_id) AS k FROM l) SELECT doc_id, label, CASE WHEN k <= greatest(1, round_even(CAST(n * 0.25 AS DOUBLE), 0)) THEN 'test' ELSE 'train' END AS split FROM r")
def stratified_cluster_split(spark, sf_dir):
    return splits.stratified(_labelled(spark, sf_dir).select("doc_id", "label"), "label", "doc_id")


@query(f"WITH {_L}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || '|7'), doc_id) AS shot FROM l) SELECT doc_id, label, CAST(shot AS INTEGER) AS shot FROM r WHERE shot <= 2")
def few_shot_sample(spark, sf_dir):
    return splits.few_shots(_labelled(spark, sf_dir), "label", "doc_id").select("doc_id", "label", "shot")


@query(
    f"""
WITH {_L}, b AS (SELECT CAST(floor((doc_id - 1) / 30) AS BIGINT) AS block, label FROM l), c AS (SELECT block, label, count(*) AS n FROM b GROUP BY 1, 2), s AS (SELECT block, sum(n) AS size FROM c GROUP BY 1),
total AS (SELECT sum(size) AS n FROM s), laid AS (SELECT block, size, try, md5(block || '|' || try || '|0') AS o FROM s, range(0, 400) t(try)),
run AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY try ORDER BY o, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM laid),
test AS (SELECT try, block, size FROM run, total WHERE before < 0.2 * total.n), k(label) AS (VALUES ('GREEN'), ('YELLOW'), ('RED')),
whole AS (SELECT label, sum(c.n) / max(total.n) AS share FROM c, total GROUP BY 1), sums AS (SELECT try, sum(size) AS size FROM test GROUP BY 1),
drawn AS (SELECT try, label, sum(n) AS n FROM test JOIN c USING (block) GROUP BY 1, 2),
score AS (SELECT sums.try, sum(abs(coalesce(drawn.n, 0) / sums.size - whole.share)) + max(abs(sums.size / total.n - 0.2)) AS score
  FROM sums JOIN whole ON true JOIN total ON true LEFT JOIN drawn ON drawn.try = sums.try AND drawn.label = whole.label GROUP BY 1),
best AS (SELECT try FROM score ORDER BY round(score, 12), try LIMIT 1)
SELECT block, CASE WHEN block IN (SELECT block FROM test JOIN best USING (try)) THEN 'test' ELSE 'train' END AS split FROM s
"""
)
def block_split_search(spark, sf_dir):
    return splits.block_split(splits.block_ids(_labelled(spark, sf_dir), "doc_id"), "block", "label")


@query("SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 12")
def recent_per_owner(spark, sf_dir):
    return store.recent(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query("SELECT c_custkey, c_name, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def child_counts(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return store.with_child_count(read(spark, sf_dir, "customer"), orders, "c_custkey", "n_orders").select("c_custkey", "c_name", "n_orders")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END IS NULL OR CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END = 7")
def owner_visibility(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("owner", F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")))
    return store.visible(orders, "owner", F.lit(7)).select("o_orderkey", "o_custkey")


@query("WITH d AS (SELECT o_orderkey FROM orders WHERE o_orderdate IS NOT NULL AND o_orderdate <= TIMESTAMP '1996-06-30') SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM d WHERE o_orderkey = l_orderkey) GROUP BY 1")
def retention_purge(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    now = F.lit("1996-06-30 00:00:00").cast("timestamp")
    doomed = store.expired(orders, now, "o_orderdate")
    _, children = store.cascade_delete(orders, doomed, {"lineitem": read(spark, sf_dir, "lineitem")}, "l_orderkey")
    return children["lineitem"].groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 15 MINUTE")
def stale_jobs(spark, sf_dir):
    jobs = read(spark, sf_dir, "events").withColumns({"status": F.when(F.col("event_type") == "view", "running").otherwise("done"), "updated_at": F.col("ts")})
    return store.stale(jobs, F.lit("2024-01-05 00:00:00").cast("timestamp")).select("event_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def upsert_latest(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    stored, incoming = orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 3 = 0").withColumn("price", F.col("price") * 2)
    return store.upsert(stored, incoming, "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'clean' ELSE 'raw' END AS origin FROM customer")
def override_merge(spark, sf_dir):
    base = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    better = base.where("c_acctbal > 5000").select("c_custkey", F.lit("clean").alias("origin"))
    return store.override(base.select("c_custkey", F.lit("raw").alias("origin")), better, "c_custkey")


@query("SELECT user_id, event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_write_wins(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("key", F.struct("user_id", "event_type"))
    return store.last_by(e, "key", "value", "event_id").select("key.user_id", F.col("key.event_type").alias("key"), "value")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS cited FROM orders")
def anti_semi_citations(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    cited = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(cited, "o_orderkey", "left_semi").withColumn("cited", F.lit(True)).unionByName(orders.join(cited, "o_orderkey", "left_anti").withColumn("cited", F.lit(False)))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'RED' WHEN 1 THEN 'YELLOW' ELSE 'GREEN' END AS label, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3, p_partkey) AS INTEGER) AS place FROM part")
def finding_order(spark, sf_dir):
    label = F.when(F.col("p_size") % 3 == 0, "RED").when(F.col("p_size") % 3 == 1, "YELLOW").otherwise("GREEN")
    place = F.row_number().over(W.partitionBy("p_brand").orderBy(ordering.risk_rank(F.col("label")), "p_partkey"))
    return read(spark, sf_dir, "part").withColumn("label", label).select("p_partkey", "label", place.alias("place"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def shared_headings(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY 1")
def count_by_group(spark, sf_dir):
    return read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n")).orderBy("r_name")


@query("SELECT event_type, count(*) AS total, CAST(count_if(value > 400) AS BIGINT) AS errors, CAST(count_if(value <= 100) AS BIGINT) AS grounded, round(CASE WHEN CAST(count_if(value <= 400) AS BIGINT) > 0 THEN CAST(count_if(value <= 100) AS BIGINT) / CAST(count_if(value <= 400) AS BIGINT) ELSE 0 END, 6) AS rate FROM events GROUP BY 1")
def grounding_pass_rate(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumns({"passed": F.col("value") <= 100, "error": F.when(F.col("value") > 400, "x")})
    return metrics.pass_rate(e, "passed", "error", ["event_type"]).withColumn("rate", F.round("rate", 6))


@query(f"WITH {_L} SELECT lang, count(*) AS n, CAST(count_if(predicted = 'RED') AS BIGINT) AS found FROM l JOIN documents USING (doc_id) WHERE label = 'RED' GROUP BY 1")
def recall_by_group(spark, sf_dir):
    both = _labelled(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.recall_by(both, ["lang"], "label", "predicted")


@query("SELECT count(*) AS n, CAST(count_if(CASE WHEN lang <> 'de' THEN lang END IS NOT DISTINCT FROM CASE WHEN source <> 'src1' THEN 'en' END) AS BIGINT) AS correct FROM documents")
def inference_scorecard(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.when(F.col("lang") != "de", F.col("lang")).alias("a"), F.when(F.col("source") != "src1", "en").alias("b"))
    return metrics.scorecard(d, "a", "b")


def _turn_context(spark, sf_dir):
    similar = F.size(F.array_intersect(text.words(F.col("text")), text.words(F.first("text").over(W.partitionBy("conv_id").orderBy("turn")))))
    c = read(spark, sf_dir, "conversations").withColumns({"sim": similar, "order_index": F.col("turn")})
    return c.withColumn("statutes", F.array(F.col("role"), F.concat(F.lit("t"), (F.col("turn") % 3).cast("string")), F.concat(F.lit("u"), (F.col("conv_id") % 5 + F.col("turn")).cast("string"))))


_CONTEXT = f"""c AS (SELECT conv_id, turn, role, text, len(list_intersect({sql_words('text')}, {sql_words('first_value(text) OVER (PARTITION BY conv_id ORDER BY turn)')})) AS sim FROM conversations),
k AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn = 1 THEN 0 ELSE 1 END, sim DESC, turn) AS r FROM c), x AS (SELECT * FROM k WHERE total <= 3000 OR r <= 3)"""


@query(f"WITH {_CONTEXT} SELECT conv_id, turn, CAST(total AS BIGINT) AS total_chars FROM x")
def context_budget_select(spark, sf_dir):
    return ordering.context_clauses(_turn_context(spark, sf_dir), "conv_id", F.col("turn") == 1, F.col("sim"), 3000, 3).select("conv_id", "turn", "total_chars")


@query(
    f"""
WITH {_CONTEXT}, f AS (SELECT conv_id, turn, sim, turn = 1 AS anchored, unnest([role, 't' || (turn % 3), 'u' || (conv_id % 5 + turn)]) AS entry_id, unnest([0, 1, 2]) AS seq FROM x),
g AS (SELECT conv_id, entry_id, min(turn * 10 + seq) AS first, bool_or(anchored) AS anchored, max(sim) AS sim FROM f GROUP BY 1, 2),
h AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN anchored THEN 0 ELSE 1 END, sim DESC, first) AS r FROM g)
SELECT conv_id, entry_id, CAST(r AS INTEGER) AS rank FROM h WHERE n <= 4 OR r <= 4
"""
)
def context_statute_select(spark, sf_dir):
    chosen = ordering.context_clauses(_turn_context(spark, sf_dir), "conv_id", F.col("turn") == 1, F.col("sim"), 3000, 3)
    return ordering.context_statutes(chosen, "conv_id", F.col("turn") == 1, F.col("sim")).select("conv_id", "entry_id", "rank")


@query(
    """
WITH c AS (SELECT d.source, d.doc_id, d.lang, CASE WHEN l.doc_id IS NULL THEN 'timeout' END AS error FROM documents d LEFT JOIN labels l USING (doc_id)),
k AS (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1)
SELECT c.source, CAST(count(*) AS INTEGER) AS clause_count, CAST(count_if(error IS NULL) AS INTEGER) AS explained_count, CAST(coalesce(max(k.n), 0) AS INTEGER) AS connection_count FROM c LEFT JOIN k USING (source) GROUP BY 1
"""
)
def nested_result_export(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    c = docs.join(labels, "doc_id", "left").select("source", F.col("doc_id").alias("order_index"), F.col("doc_id").cast("string").alias("clause_id"), "lang", F.when(F.col("toxic").isNull(), "timeout").alias("error"), F.array(F.struct(F.col("lang").alias("entry_id"), F.lit("c").alias("citation"))).alias("retrieved_statutes"))
    links = docs.join(labels.where("toxic = 1"), "doc_id").select("source", F.col("doc_id").cast("string").alias("clause_id_a"), F.col("lang").alias("clause_id_b"), F.lit("same").alias("relationship_type"), F.lit("x").alias("explanation"))
    return store.summary(store.serialised(c, links, "source", ["clause_id", "lang"], ["entry_id"]), "source")
