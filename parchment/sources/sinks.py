"""Sinks (K1-K12)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_unit(batch: DataFrame, batch_id: int, path: str, parts: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
    """Write what ``parts`` make of a batch, such as parents and their children, as one unit under its number.

    Each part replaces what an earlier try of the batch left; the batch is told in ``commits`` only after all of them,
    and ``committed`` reads told batches only.  So a try that dies between two parts shows nothing, and one that is
    replayed after it was told changes nothing.
    """
    spark = batch.sparkSession
    if _exists(spark, f"{path}/commits/batch={batch_id}/_SUCCESS"):
        return
    for name, make in parts.items():
        make(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
    spark.createDataFrame([(len(parts),)], "n_parts int").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch_id}")


def stream_units(stream: DataFrame, path: str, parts: dict[str, Callable[[DataFrame], DataFrame]]):
    """A writer of ``stream`` that writes each micro-batch as one unit; start it with a trigger of choice."""
    return stream.writeStream.foreachBatch(lambda batch, n: write_unit(batch, n, path, parts)).option("checkpointLocation", f"{path}/checkpoint")


def committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One part of all told batches."""
    told = spark.read.parquet(f"{path}/commits").select("batch").distinct()
    return spark.read.parquet(f"{path}/{name}").join(F.broadcast(told), "batch", "left_semi").drop("batch")


def versioned(df: DataFrame, path: str, version: str, fmt: str = "parquet") -> str:
    """Write beside the versions before, so that no earlier result is overwritten."""
    out = f"{path}/version={version}"
    df.write.mode("errorifexists").format(fmt).save(out)
    return out


def append_cache(df: DataFrame, path: str) -> None:
    df.select("key", "value").write.mode("append").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def nested_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A report frame as a markdown table; reports are one row per metric or class, and one of more than ``limit`` rows is an error."""
    rows = [[str(v) for v in r] for r in df.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    return "\n".join(f"| {' | '.join(r)} |" for r in (df.columns, ["---"] * len(df.columns), *rows))


def create_table(spark, name: str, ddl: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet")


def add_columns(spark, name: str, ddl: str) -> list[str]:
    """Add the columns that a table lacks; existing ones and their data stay.  Returns the names added."""
    have = {c.lower() for c in spark.table(name).columns}
    missing = [f for f in StructType.fromDDL(ddl).fields if f.name.lower() not in have]
    if missing:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in missing)})")
    return [f.name for f in missing]
