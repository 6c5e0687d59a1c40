"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or for local sessions one under /tmp."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return "file:///tmp/checkpoints"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str | None = None, options: dict[str, str | int] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors cost only a reread. codec: of Parquet, the session's by default; options: of its writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if codec:
        writer = writer.option("compression", codec)
    if options:
        writer = writer.options(**options)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df. Frames that read it can't be used afterwards."""
    _delete(df.sparkSession, df._scratch)


def drop_shared(spark: SparkSession) -> None:
    """Deletes all that this application has materialised. Frames that read it can't be used afterwards."""
    _delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)
