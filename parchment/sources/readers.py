"""Sources (S1-S16): each returns a DataFrame with an explicit schema; bad rows are told, not dropped silently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

ENTRY = (
    "id string, jurisdiction string, topic_tags array<string>, act string, act_number string, section string, citation string, excerpt_text string, source_url string, "
    "last_verified_date string, notes string, confidence string, source_type string, applicability string, applies_to_clause_examples array<string>"
)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A folder of uploads with their content type by magic bytes, and the reason where it is not supported."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    head = F.hex(F.substring("content", 1, 4))
    kind = F.when(head == "25504446", "application/pdf").when(head.startswith("FFD8FF"), "image/jpeg").when(head == "89504E47", "image/png")
    return df.withColumn("content_type", kind).withColumn("reject_reason", F.when(kind.isNull(), "unsupported content type"))


def knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON document, either single objects or under ``entries``."""
    df = spark.read.schema(f"{ENTRY}, entries array<struct<{', '.join(x.replace(' ', ':', 1) for x in ENTRY.split(', '))}>>").json(path, multiLine=True)
    own = F.array(F.struct(*[F.col(x.split()[0]) for x in ENTRY.split(", ")]))
    out = df.select(F.explode(F.coalesce("entries", own)).alias("e")).select("e.*")
    return out.withColumn("last_verified_date", F.to_date("last_verified_date"))


def bridge(spark: SparkSession, path: str) -> DataFrame:
    """(jurisdiction, topic, entry_id, pos) of a nested JSON index."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    by_state = raw.select(F.explode("m").alias("jurisdiction", "topics"))
    by_topic = by_state.select("jurisdiction", F.explode("topics").alias("topic", "ids"))
    return by_topic.select("jurisdiction", "topic", F.posexplode("ids").alias("pos", "entry_id"))


def cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines key/value cache: blank lines skipped, the last line of a key wins."""
    # by line; a large file is read in splits, whose order is that of their offsets
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"), F.col("value").alias("line"))
    kv = lines.where(F.trim("line") != "").select("at", F.get_json_object("line", "$.key").alias("key"), F.get_json_object("line", "$.value").alias("value"))
    return kv.groupBy("key").agg(F.max_by("value", "at").alias("value"))


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"')
    return (reader.schema(schema) if schema else reader).csv(path)


def labelled(spark: SparkSession, path: str, strict: bool = False, labels=rules.LABELS) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of a labelled table clause_id, clause_text, risk_label; with ``strict`` violations raise."""
    raw = csv(spark, path, "clause_id string, clause_text string, risk_label string").where("clause_id IS NOT NULL OR clause_text IS NOT NULL OR risk_label IS NOT NULL")
    df = raw.select(F.expr("try_cast(clause_id AS long)").alias("clause_id"), F.trim("clause_text").alias("text"), F.upper(F.trim("risk_label")).alias("label"))
    repeated = df.groupBy("clause_id").agg(F.count("*").alias("n")).where("n > 1").select("clause_id", F.lit("duplicate id").alias("problem"))
    bad = df.select("clause_id", F.when(F.coalesce("text", F.lit("")) == "", "empty text").when(~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "unknown label").when(F.col("clause_id").isNull(), "bad id").alias("problem")).where("problem IS NOT NULL")
    violations = bad.union(repeated)
    if strict and (first := violations.first()):
        raise ValueError(f"row {first['clause_id']}: {first['problem']}")
    return df, violations


def saved(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved-results document map<filename, result>; empty if the file is missing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"filename string, {schema}")
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<{schema.replace(' ', ':', 1)}>>")).alias("filename", "r"))
    return raw.select("filename", "r.*")


def results_table(spark: SparkSession, path: str, heading: str = "## Results") -> DataFrame:
    """Rows of the markdown table under a heading whose third cell is a percentage."""
    body = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", f"(?s){heading}(.*?)(?:\n## |\\z)", 1).alias("b"))
    cells = body.select(F.explode(F.split("b", "\n")).alias("l")).where(F.ltrim("l").startswith("|")).select(F.transform(F.split(F.trim("l"), r"\|"), lambda x: F.trim(x)).alias("c"))
    return cells.where(F.get("c", F.lit(3)).endswith("%")).select(F.get("c", F.lit(1)).alias("name"), F.get("c", F.lit(2)).alias("n"), F.get("c", F.lit(3)).alias("value"))


def tsv_rows(texts: DataFrame, keys: list[str], column: str = "tsv") -> DataFrame:
    """Rows of tab-separated text by its own header: (keys, pos, cells), a map from column name to cell; rows of another cell count are left out."""
    lines = texts.select(*keys, F.split(F.regexp_replace(column, "\r", ""), "\n").alias("l"))
    header = F.split(F.get("l", F.lit(0)), "\t")
    each = lines.select(*keys, header.alias("names"), F.posexplode(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))).alias("pos", "line"))
    cells = F.split("line", "\t")
    return each.where(F.size(cells) == F.size("names")).select(*keys, "pos", F.map_from_arrays("names", cells).alias("cells"))


def template_rounds(templates: DataFrame, states: DataFrame, extra_topics: list[str]) -> DataFrame:
    """Filled clauses of ``templates`` (topic_idx, topic, key, template) and ``states`` (state_idx, state, l1, l2, premises).

    Each topic gives every state its green and yellow wording; which states get the obvious red one rotates with the topic:
    the first three from its own place on, the others the subtle one.  Topics of ``extra_topics`` have a second round
    (keys ending in _v2).
    """
    n = states.count()  # a table of a few rows
    place = F.pmod(F.col("state_idx") - F.col("topic_idx"), F.lit(n))
    both = templates.join(F.broadcast(states))
    red = ((F.col("key") == "red_obvious") & (place < 3)) | ((F.col("key") == "red_subtle") & (place >= 3))
    second = F.col("key").isin("green_v2", "yellow_v2", "red_subtle_v2") & F.col("topic").isin(*extra_topics)
    kept = both.where(F.col("key").isin("green", "yellow") | red | second)
    filled = F.col("template")
    for c in ("l1", "l2", "premises"):
        filled = F.replace(filled, F.lit("{" + c + "}"), F.col(c))
    kind = F.when(F.col("key").endswith("_v2"), F.when(F.col("key").startswith("red"), "extra-subtle").otherwise("extra")).otherwise(F.when(F.col("key") == "red_obvious", "base-obvious").when(F.col("key") == "red_subtle", "base-subtle").otherwise("base"))
    return kept.select("topic", "state", F.upper(F.split_part("key", F.lit("_"), F.lit(1))).alias("label"), filled.alias("text"), kind.alias("round"))


def expand_templates(templates: DataFrame, states: list[tuple[int, str, str]], variants: int = 5) -> DataFrame:
    """Templates (topic_idx, topic, variant, label, template) by states (idx, name, city), rotated so that states get different variants first.

    ``states`` is a literal list, so the product is an array explode.
    """
    table = F.array(*[F.struct(F.lit(i).alias("state_idx"), F.lit(n).alias("state"), F.lit(c).alias("city")) for i, n, c in states])
    out = templates.withColumn("s", F.explode(table)).select(*templates.columns, "s.*")
    rotation = F.pmod(F.col("state_idx") - F.col("topic_idx"), F.lit(variants))
    filled = F.replace(F.replace("template", F.lit("{state}"), F.col("state")), F.lit("{city}"), F.col("city"))
    return out.withColumn("rotation", rotation).withColumn("clause_text", filled)
