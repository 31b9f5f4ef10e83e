"""Operator 8, Merkle fixity audit of archived records.

Records (leaves) are hashed and stand by offset within segments (an archive file
each).  A leaf's place in the tree is its slot, a number that follows from its key
and not from its rank, so a lost or added record moves no other.  ``fanout``
consecutive nodes hash to a parent together with the offset ranges that they cover,
counted from the parent's own start, so what stands behind a record that is lost or
cut short has the same hashes as before.  To compare replicas, roots are compared
first, and only the children of mismatching nodes are joined at the next level down,
so intact branches are never read below their root.  Leaves are judged by key and
content: ``intact``, ``corrupt`` (same key, other content), ``missing`` or ``extra``;
where an intact record stands in the replica is told apart from that.

Scale: a level is one aggregation by (segment, slot div fanout) of at most
``fanout`` nodes a group.  Segments have a bounded number of records, so no
group grows with the corpus, and the tree height is the same for all segments.
All levels together are a fraction 1/(fanout-1) larger than the leaves.

Defined cases: a null field hashes unlike an empty one; repeated rows are records
of their own, paired by content first, and share a slot; a record without an order
key (null segment) goes to one of as many segments of their own as hold about half
the bound each, by a hash of the columns given for that, equal in both replicas;
records that only the replica has are rows with verdict ``extra``; an empty table has
no roots and no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import cut, read

FANOUT = 16
SEGMENT_RECORDS = 4096
LEVELS = 3


def warc_record(url: Column, body: Column) -> Column:
    """The bytes of a WARC response record, as text: header lines, a blank line, the payload and two line ends."""
    length = F.coalesce(F.octet_length(body), F.lit(0)).cast("string")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("\\N")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(body.isNull(), F.lit("-")).otherwise(length), F.lit("\r\n\r\n"), F.coalesce(body, F.lit("")), F.lit("\r\n\r\n"),
    )


def leaves(records: DataFrame, segment: Column, order: list[str], content: Column, slot: Column, slots: int) -> DataFrame:
    """(segment, slot, position, from, to, hash, key) and the ``order`` columns: records by offset within their segment."""
    slim = records.select(segment.alias("segment"), F.pmod(slot, F.lit(slots)).cast("long").alias("slot"), *order, F.octet_length(content).cast("long").alias("n_bytes"), F.sha2(content, 256).alias("hash"))
    by = W.partitionBy("segment").orderBy("slot", *order, "hash")
    slim = slim.withColumn("position", F.row_number().over(by).cast("long") - 1).withColumn("to", F.sum("n_bytes").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return slim.select("segment", "slot", "position", (F.col("to") - F.col("n_bytes")).alias("from"), "to", "hash", F.to_json(F.struct(*order)).alias("key"), *order)


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level up (segment, slot, position, from, to, hash): a hash over the ordered children and their offset ranges from the parent's start on."""
    child = F.struct("position", F.struct("from", "to", "hash").alias("of"))
    up = nodes.groupBy("segment", F.floor(F.col("slot") / fanout).alias("parent")).agg(F.min("from").alias("from"), F.max("to").alias("to"), F.array_sort(F.collect_list(child)).alias("children"))
    told = F.transform("children", lambda x: F.concat_ws(":", x["of"]["from"] - F.col("from"), x["of"]["to"] - F.col("from"), x["of"]["hash"]))
    return up.select("segment", F.col("parent").alias("slot"), F.col("parent").alias("position"), "from", "to", F.sha2(F.array_join(told, "\n"), 256).alias("hash"))


def tree(leaf_nodes: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels above the leaves up to the roots, for slots below ``fanout ** levels``."""
    out = [leaf_nodes]
    for _ in range(levels):
        out.append(cut(parents(out[-1], fanout)))
    return out[1:]


def paired(mine: DataFrame, other: DataFrame) -> DataFrame:
    """(segment, position, verdict, replica_position): leaves of one key are paired by content, then in order; what is left is missing or extra.

    An extra record has no position of its own.
    """
    same = W.partitionBy("segment", "key", "hash").orderBy("position")
    a, b = (x.select("segment", "key", "hash", "position", F.row_number().over(same).alias("n")) for x in (mine, other))
    both = cut(a.join(b.withColumnRenamed("position", "replica_position"), ["segment", "key", "hash", "n"], "full"))
    intact = both.where("position IS NOT NULL AND replica_position IS NOT NULL").select("segment", "position", F.lit("intact").alias("verdict"), "replica_position")
    left, right = (both.where(f"{y} IS NULL").select("segment", "key", x, F.row_number().over(W.partitionBy("segment", "key").orderBy(x)).alias("n")) for x, y in (("position", "replica_position"), ("replica_position", "position")))
    verdict = F.when(F.col("replica_position").isNull(), "missing").when(F.col("position").isNull(), "extra").otherwise("corrupt")
    return intact.unionByName(left.join(right, ["segment", "key", "n"], "full").select("segment", "position", verdict.alias("verdict"), "replica_position"))


def mismatches(leaf: DataFrame, other: DataFrame, ours: list[DataFrame], theirs: list[DataFrame], fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """The ``paired`` leaves under mismatching nodes, and (segment, nodes_compared)."""
    suspects, visited = None, None
    below = lambda x: x if suspects is None else x.withColumn("parent", F.floor(F.col("slot") / fanout)).join(suspects, ["segment", "parent"], "left_semi").drop("parent")
    for mine, replica in zip(reversed(ours), reversed(theirs), strict=True):
        a = below(mine).select("segment", "slot", F.col("hash").alias("a"))
        b = below(replica).select("segment", "slot", F.col("hash").alias("b"))
        level = cut(a.join(b, ["segment", "slot"], "full"))
        seen = level.groupBy("segment").agg(F.count("*").alias("n"))
        visited = seen if visited is None else visited.union(seen)
        suspects = level.where(~F.col("a").eqNullSafe(F.col("b"))).select("segment", F.col("slot").alias("parent"))
    found = cut(paired(below(leaf), below(other)))
    visited = visited.union(found.groupBy("segment").agg(F.count("*").alias("n")))
    return found, visited.groupBy("segment").agg(F.sum("n").alias("nodes_compared"))


def audit(records: DataFrame, replica: DataFrame, segment: Column, order: list[str], content: Column, spread: list[str] | None = None, slot: Column | None = None) -> DataFrame:
    """The leaves of ``records``, and those that only ``replica`` has, with verdict (intact, corrupt, missing or extra) and ``replica_from``.

    ``replica_from`` is the offset at which the replica has the record, null where it has none; an extra record's ``from``
    and ``to`` are the replica's.  Added are both roots of the segment (null where a replica has none) and the number of
    nodes that were compared in it.  ``slot`` is a record's place in its segment, by default a hash of the order key;
    ``spread`` names the columns whose hash deals out records of a null segment.
    """
    nulls = records.where(segment.isNull()).count()
    slots = FANOUT**LEVELS
    dealt = -1 - F.pmod(F.xxhash64(*(spread or order)), F.lit(max(1, math.ceil(2 * nulls / SEGMENT_RECORDS))))
    placed = F.when(segment.isNotNull(), F.xxhash64(*order) if slot is None else slot.cast("long"))
    placed = F.coalesce(placed, F.xxhash64(F.lit(1), *(spread or order)))
    whole = F.coalesce(segment.cast("long"), dealt)
    leaf, other = (cut(leaves(x, whole, order, content, placed, slots)) for x in (records, replica))
    ours, theirs = tree(leaf), tree(other)
    found, visited = mismatches(leaf, other, ours, theirs)
    # what was not compared is intact, and as far from its node's start as in the replica
    moved = ours[0].select("segment", F.col("slot").alias("parent"), F.col("from").alias("here")).join(theirs[0].select("segment", F.col("slot").alias("parent"), F.col("from").alias("there")), ["segment", "parent"], "left")
    there = other.select("segment", F.col("position").alias("replica_position"), F.col("from").alias("found_from"))
    judged = found.join(there, ["segment", "replica_position"], "left")
    mine = leaf.withColumn("parent", F.floor(F.col("slot") / FANOUT)).join(moved, ["segment", "parent"], "left").join(judged.where("position IS NOT NULL"), ["segment", "position"], "left")
    at = F.when(F.col("verdict").isNull(), F.col("from") + F.col("there") - F.col("here")).otherwise(F.col("found_from"))
    columns = [F.col("segment"), F.col("position"), F.col("from"), F.col("to"), F.col("hash"), *map(F.col, order)]
    mine = mine.select(*columns, F.coalesce("verdict", F.lit("intact")).alias("verdict"), at.alias("replica_from"))
    extra = found.where("verdict = 'extra'").select("segment", F.col("replica_position").alias("position"), "verdict")
    extra = other.join(extra, ["segment", "position"]).select(*columns, "verdict", F.col("from").alias("replica_from"))
    roots = [top.where("slot = 0").select("segment", F.col("hash").alias(name)) for top, name in ((ours[-1], "root"), (theirs[-1], "replica_root"))]
    about = visited.join(roots[0], "segment", "left").join(roots[1], "segment", "left")
    return mine.unionByName(extra).join(about, "segment")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` as bad storage would return it, by the last two digits of the html's checksum.

    Of those that end in 00 the first '<' is overwritten, in 10 the record is lost, in 20 cut to its half, and in 30
    another record of the same key is there besides.
    """
    end = F.coalesce(F.right(F.md5("html"), F.lit(2)), F.lit(""))
    other = F.when(end == "00", F.regexp_replace("html", "^([^<]*)<", "$1?")).when(end == "20", F.substring("html", 1, F.floor(F.length("html") / 2).cast("int"))).otherwise(F.col("html"))
    kept = pages.where(end != "10").withColumn("html", other)
    return kept.unionByName(pages.where(end == "30").withColumn("html", F.concat("html", F.lit("x"))))


def op8_merkle_fixity(spark, sf_dir: str) -> DataFrame:
    """Audits the archive of ``pages`` against a replica that was damaged on purpose."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = audit(pages, damaged(pages), F.expr(f"page_id div {SEGMENT_RECORDS}"), ["page_id"], warc_record(F.col("url"), F.col("html")), ["url"], F.col("page_id"))
    return found.select(
        "page_id", "segment", F.col("from").alias("offset_from"), F.col("to").alias("offset_to"), F.col("hash").alias("record_sha256"), "verdict", "replica_from",
        F.col("root").alias("root_sha256"), F.col("replica_root").alias("replica_root_sha256"), "nodes_compared",
    )


def _tree_sql(side: str, pages: str) -> str:
    """Leaves ``<side>0`` to roots ``<side>3`` of the archive of ``pages``."""
    out = f"""
{side}r AS (
  SELECT page_id, page_id // {SEGMENT_RECORDS} AS segment, page_id % {SEGMENT_RECORDS} AS slot, html,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
         || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM ({pages})
), {side}h AS (SELECT page_id, segment, slot, strlen(rec) AS n, sha256(rec) AS hash FROM {side}r
), {side}0 AS (
  SELECT page_id, segment, slot, row_number() OVER w - 1 AS position, CAST(sum(n) OVER w - n AS BIGINT) AS a, CAST(sum(n) OVER w AS BIGINT) AS z, hash
  FROM {side}h WINDOW w AS (PARTITION BY segment ORDER BY slot, page_id, hash ROWS UNBOUNDED PRECEDING)
)"""
    for k in range(1, LEVELS + 1):
        out += f""", {side}{k} AS (
  SELECT segment, slot // {FANOUT} AS slot, slot // {FANOUT} AS position, min(a) AS a, max(z) AS z, sha256(string_agg((a - low) || ':' || (z - low) || ':' || hash, chr(10) ORDER BY position)) AS hash
  FROM (SELECT *, min(a) OVER (PARTITION BY segment, slot // {FANOUT}) AS low FROM {side}{k - 1}) GROUP BY segment, slot // {FANOUT}
)"""
    return out


_REPLICA_SQL = r"""SELECT page_id, url, CASE right(md5(html), 2) WHEN '00' THEN regexp_replace(html, '^([^<]*)<', '\1?') WHEN '20' THEN substring(html, 1, length(html) // 2) ELSE html END AS html FROM pages WHERE right(md5(html), 2) <> '10'
  UNION ALL SELECT page_id, url, html || 'x' FROM pages WHERE right(md5(html), 2) = '30'"""


def _under(k: int, side: str) -> str:
    """Nodes of level ``k`` under the mismatching ones above."""
    return f"{side}{k}" if k == LEVELS else f"(SELECT x.* FROM {side}{k} x JOIN bad{k + 1} b ON x.segment = b.segment AND x.slot // {FANOUT} = b.slot)"


_LEVELS_SQL = "".join(f", both{k} AS (SELECT segment, slot, m.hash AS a, t.hash AS b FROM {_under(k, 'm')} m FULL JOIN {_under(k, 't')} t USING (segment, slot)), bad{k} AS (SELECT segment, slot FROM both{k} WHERE a IS DISTINCT FROM b)" for k in range(LEVELS, 0, -1))
OP8_SQL = f"""
WITH {_tree_sql("m", "SELECT page_id, url, html FROM pages")}, {_tree_sql("t", _REPLICA_SQL)}{_LEVELS_SQL}
, ms AS (SELECT *, row_number() OVER (PARTITION BY segment, page_id, hash ORDER BY position) AS n FROM {_under(0, "m")}), ts AS (SELECT *, row_number() OVER (PARTITION BY segment, page_id, hash ORDER BY position) AS n FROM {_under(0, "t")})
, same AS (SELECT segment, page_id, ms.position AS p, ts.position AS q, ts.a AS b FROM ms JOIN ts USING (segment, page_id, hash, n))
, ml AS (SELECT *, row_number() OVER (PARTITION BY segment, page_id ORDER BY position) AS r FROM ms WHERE (segment, position) NOT IN (SELECT segment, p FROM same))
, tl AS (SELECT *, row_number() OVER (PARTITION BY segment, page_id ORDER BY position) AS r FROM ts WHERE (segment, position) NOT IN (SELECT segment, q FROM same))
, found AS (
  SELECT segment, p AS position, 'intact' AS verdict, b, q FROM same
  UNION ALL SELECT segment, ml.position, CASE WHEN tl.position IS NULL THEN 'missing' WHEN ml.position IS NULL THEN 'extra' ELSE 'corrupt' END, tl.a, tl.position FROM ml FULL JOIN tl USING (segment, page_id, r)
)
, visited AS (SELECT segment, CAST(count(*) AS BIGINT) AS nodes_compared FROM ({" UNION ALL ".join(f"SELECT segment FROM both{k}" for k in range(LEVELS, 0, -1))} UNION ALL SELECT segment FROM found) GROUP BY segment)
, judged AS (
  SELECT m0.page_id, segment, m0.a, m0.z, m0.hash, coalesce(found.verdict, 'intact') AS verdict, CASE WHEN found.verdict IS NULL THEN m0.a + t1.a - m1.a ELSE found.b END AS replica_from
  FROM m0 LEFT JOIN found USING (segment, position) LEFT JOIN m1 ON m1.segment = m0.segment AND m1.slot = m0.slot // {FANOUT} LEFT JOIN t1 ON t1.segment = m0.segment AND t1.slot = m0.slot // {FANOUT}
  UNION ALL SELECT t0.page_id, t0.segment, t0.a, t0.z, t0.hash, 'extra', t0.a FROM t0 JOIN found ON found.segment = t0.segment AND found.q = t0.position AND found.verdict = 'extra'
)
SELECT page_id, segment, judged.a AS offset_from, judged.z AS offset_to, judged.hash AS record_sha256, verdict, replica_from, m{LEVELS}.hash AS root_sha256, t{LEVELS}.hash AS replica_root_sha256, nodes_compared
FROM judged LEFT JOIN m{LEVELS} USING (segment) LEFT JOIN t{LEVELS} USING (segment) JOIN visited USING (segment)
"""
