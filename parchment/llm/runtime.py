"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that the cluster names.

    The folder is read from ``spark.checkpoint.dir``.  One is made only where none is set and driver and executors
    are one process, as in tests; on a cluster a missing setting is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="parchment-checkpoint-"))
    return df.checkpoint(eager=True)


def settle(spark: SparkSession) -> None:
    """Let Spark drop the exchange files of finished steps now: it does so when the driver collects their handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def project(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, renamed; extra or clashing columns of the input do not come along."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def pack(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns but the text, as a struct) and ``text``, so that added columns clash with none."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    names = {c.lower() for c in docs.columns}
    filler = "_"
    while filler in names:
        filler += "_"
    return docs.select(F.struct(*rest, F.lit(0).alias(filler)).alias("row"), F.col(f"`{text}`").alias("text"))


def unpack(packed: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    return packed.select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns])
