"""Object keys, and ledgers of what has been processed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FILE = r"^\d{12}_CloudTrail_[^_]+_\d{8}T\d{4}Z_\w+\.json(\.gz)?$"


def cloudtrail_key(key: Column) -> Column:
    """struct<account, region, valid> of a CloudTrail object key, with or without an organization's prefix."""
    parts = F.split(F.regexp_replace(key, "^AWSLogs/", ""), "/")
    shift = F.when(F.startswith(F.get(parts, F.lit(0)), F.lit("o-")), 1).otherwise(0)
    part = lambda i: F.get(parts, shift + i)
    valid = (F.size(parts) >= 4 + shift) & (part(1) == "CloudTrail") & (part(0) != "") & (part(2) != "") & F.substring_index(key, "/", -1).rlike(_FILE)
    valid = F.coalesce(valid, F.lit(False))
    return F.struct(F.when(valid, part(0)).alias("account"), F.when(valid, part(2)).alias("region"), valid.alias("valid"))


def account_regions(keys: DataFrame, key: str = "key") -> DataFrame:
    """Accounts and regions that have objects."""
    return keys.select(cloudtrail_key(F.col(key)).alias("k")).where("k.valid").select("k.account", "k.region").distinct()


def unprocessed(objects: DataFrame, ledger: DataFrame, keys: tuple[str, ...] = ("key", "etag")) -> DataFrame:
    """Objects that are not in the ledger; with an ETag among the keys, changed objects count as new."""
    return objects.join(ledger.select(*keys).distinct(), list(keys), "left_anti")


def after_last(objects: DataFrame, state: DataFrame, key: str = "key") -> DataFrame:
    """Objects whose key follows the last one processed of their bucket, account and region. state: those three and last_key."""
    o = objects.withColumn("_k", cloudtrail_key(F.col(key))).withColumns({"account": F.coalesce("_k.account", F.lit("")), "region": F.coalesce("_k.region", F.lit(""))}).drop("_k")
    joined = o.join(state.select("bucket", "account", "region", "last_key"), ["bucket", "account", "region"], "left")
    return joined.where(F.col("last_key").isNull() | (F.col(key) > F.col("last_key"))).drop("last_key")


def advanced(state: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """state (bucket, account, region, last_key, processed_count) after the objects ``done`` (bucket, account, region, key)."""
    new = done.groupBy("bucket", "account", "region").agg(F.max(key).alias("last_key"), F.count(F.lit(1)).alias("processed_count"))
    return state.unionByName(new).groupBy("bucket", "account", "region").agg(F.max("last_key").alias("last_key"), F.sum("processed_count").alias("processed_count"))
