"""Integrations: a small table of what is connected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, name string, type string, enabled boolean, config string, status string, last_error string, created_at timestamp, updated_at timestamp"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def created(table: DataFrame, id: str, name: str, type: str, config: str = "{}", enabled: bool = True) -> DataFrame:
    row = table.sparkSession.range(1).select(F.lit(id).alias("id"), F.lit(name).alias("name"), F.lit(type).alias("type"), F.lit(enabled).alias("enabled"), F.lit(config).alias("config"), F.lit("active").alias("status"), F.lit("").alias("last_error"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))
    return table.where(F.col("id") != id).unionByName(row)


def get(table: DataFrame, id: str) -> DataFrame:
    return table.where(F.col("id") == id)


def listed(table: DataFrame, only_enabled: bool = True) -> DataFrame:
    return (table.where("enabled") if only_enabled else table).orderBy(F.desc("created_at"), "id")


def with_status(table: DataFrame, id: str, status: str, error: str = "") -> DataFrame:
    hit = F.col("id") == id
    return table.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "last_error": F.when(hit, error).otherwise(F.col("last_error")), "updated_at": F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at"))})
