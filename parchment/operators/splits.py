"""Splits and sampling by seeded hashes (V5-V7, V12, P20, U4). The order is md5, so that any engine reproduces it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text
from .ordering import dense_ids


def seeded(*columns: str, seed: int):
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def block_ids(df: DataFrame, id_column: str, rows: int = rules.BLOCK_ROWS) -> DataFrame:
    return df.withColumn("block", F.floor((F.col(id_column) - 1) / rows))


def template_clusters(df: DataFrame, text_column: str, position: str) -> DataFrame:
    """Clusters of texts with one template form, numbered by first appearance."""
    return dense_ids(df.withColumn("template", text.template_form(F.col(text_column))), "template", position, "template_id")


def stratified(clusters: DataFrame, label: str, cluster: str, share: float = 0.25, seed: int = 42) -> DataFrame:
    """``split`` of each cluster: per label, max(1, half-even share) clusters by seeded order are test."""
    w = W.partitionBy(label)
    n = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy(seeded(cluster, seed=seed), cluster))
    return clusters.withColumn("split", F.when(rank <= F.greatest(F.lit(1), F.bround(n * share)), "test").otherwise("train"))


def few_shots(df: DataFrame, label: str, id_column: str, per_class: int = 2, seed: int = 7) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(label).orderBy(seeded(id_column, seed=seed), id_column))
    return df.withColumn("shot", rank).where(F.col("shot") <= per_class)


def block_split(df: DataFrame, block: str, label: str, share: float = 0.20, tries: int = 400, seed: int = 0) -> DataFrame:
    """(block, split): of ``tries`` seeded block orders, filled until the share is reached, the one whose test set has the least
    deviation of class shares and size.  Works on block by label counts, never on rows."""
    counts = df.groupBy(block, label).agg(F.count("*").alias("n"))
    sizes = counts.groupBy(block).agg(F.sum("n").alias("size"))
    order = F.md5(F.concat_ws("|", F.col(block).cast("string"), F.col("try").cast("string"), F.lit(str(seed))))
    # blocks are rows / 30; attempts are replicated to blocks by an array, not by a join
    laid = sizes.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("order", order)
    total = sizes.agg(F.sum("size")).first()[0] or 0
    before = F.coalesce(F.sum("size").over(W.partitionBy("try").orderBy("order", block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    test = laid.withColumn("before", before).where(F.col("before") < share * total).select("try", block, "size")
    whole = counts.groupBy(label).agg((F.sum("n") / F.lit(max(total, 1))).alias("all_share"))
    drawn = test.join(counts, block).groupBy("try", label).agg(F.sum("n").alias("n"))
    sums = test.groupBy("try").agg(F.sum("size").alias("test_size"))
    wide = sums.join(drawn.groupBy("try").agg(F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("m")), "try")
    shares = {r[label]: r["all_share"] for r in whole.collect()}  # one row per class
    off = sum((F.abs(F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)) / F.col("test_size") - F.lit(v)) for k, v in shares.items()), F.lit(0.0))
    scored = wide.select("try", (off + F.abs(F.col("test_size") / F.lit(max(total, 1)) - share)).alias("score"))
    best = scored.orderBy(F.round("score", 12), "try").limit(1).select("try")
    chosen = test.join(best, "try", "left_semi").select(F.col(block), F.lit("test").alias("split"))
    return sizes.select(block).join(chosen, block, "left").withColumn("split", F.coalesce("split", F.lit("train")))
