"""Shared helpers of the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the driver; timestamps without zone become UTC timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """The folder that the cluster names for checkpoints; one of its own only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix=prefix)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession, "parchment-checkpoint-"))
    return df.checkpoint()
