"""Session helpers: shared folder, written intermediate tables, partition counts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset a local master, as in tests, gets a local folder; a cluster gets an error, as its executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "vigilake-checkpoints")
        os.makedirs(found, exist_ok=True)
    return found


def new_path(spark: SparkSession, ending: str = "parquet") -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}.{ending}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """df written as Parquet in the shared folder, in folders by those columns, and read again."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() made and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files and broadcasts that no plan refers to any more, which it does when objects are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
