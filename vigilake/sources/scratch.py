"""Tables that a run writes and reads again, in a folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a local master gets a local folder and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="vigilake-")


class Scratch:
    """One run's tables; as a context manager it deletes them at the end."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_folder(spark)}{os.sep}run-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, *partitions: str) -> DataFrame:
        """df written as Parquet and read again, by these partition columns if any."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.partitionBy(*partitions).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def delete(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.delete()
