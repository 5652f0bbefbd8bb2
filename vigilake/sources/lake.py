"""The lake: events by log type and hour.

New tables are proper newline-delimited JSON under gzip, or Parquet; a reader
for old objects, whose gzip members follow one another without newlines, is
kept apart.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short names of log types.
ALIASES = {
    "cloudtrail": "AWS.CloudTrail", "bedrock": "AWS.BedrockModelInvocation", "bedrockmodelinvocation": "AWS.BedrockModelInvocation", "aws.bedrockmodelinvocation": "AWS.BedrockModelInvocation",
    "github": "GitHub.Audit", "github.audit": "GitHub.Audit", "githubaudit": "GitHub.Audit", "github.webhook": "GitHub.Webhook", "githubwebhook": "GitHub.Webhook",
    "gcp": "GCP.AuditLog", "gcp.audit": "GCP.AuditLog", "gcpaudit": "GCP.AuditLog", "gcpauditlog": "GCP.AuditLog",
    "gcp.httplb": "GCP.HTTPLoadBalancer", "gcphttplb": "GCP.HTTPLoadBalancer", "gcp_httploadbalancer": "GCP.HTTPLoadBalancer", "httplb": "GCP.HTTPLoadBalancer",
    "eks": "Amazon.EKS.Audit", "eks.audit": "Amazon.EKS.Audit", "amazon.eks.audit": "Amazon.EKS.Audit", "eks_audit": "Amazon.EKS.Audit",
    "slack": "Slack.AuditLogs", "slack.audit": "Slack.AuditLogs", "slackauditlogs": "Slack.AuditLogs", "cloudflare": "Cloudflare.Firewall", "cloudflare.firewall": "Cloudflare.Firewall", "cffw": "Cloudflare.Firewall",
    "cloudflare.http": "Cloudflare.HttpRequest", "cloudflare.httprequest": "Cloudflare.HttpRequest", "cfhttp": "Cloudflare.HttpRequest",
}
PARTITIONS = ("year", "month", "day", "hour")


def canonical(log_type: str) -> str:
    return ALIASES.get(log_type.strip().lower(), log_type)


def slug(log_type: str) -> str:
    return canonical(log_type).replace(".", "_").lower()


def slug_of(log_type: Column) -> Column:
    return F.lower(F.replace(log_type, F.lit("."), F.lit("_")))


def hour_path(log_type: str, hour: datetime) -> str:
    return f"logs/{slug(log_type)}/year={hour.year}/month={hour.month:02d}/day={hour.day:02d}/hour={hour.hour:02d}"


def object_key(log_type: str, hour: datetime, filename: str) -> str:
    return f"{hour_path(log_type, hour)}/{filename}"


def hours_between(start: datetime, end: datetime) -> list[datetime]:
    """Hours that [start, end) touches."""
    at = start.replace(minute=0, second=0, microsecond=0)
    out = []
    while at < end:
        out.append(at)
        at += timedelta(hours=1)
    return out


def with_hours(events: DataFrame, ts: str = "eventTime") -> DataFrame:
    t = F.col(ts)
    return events.withColumns({"year": F.date_format(t, "yyyy"), "month": F.date_format(t, "MM"), "day": F.date_format(t, "dd"), "hour": F.date_format(t, "HH")})


def write(events: DataFrame, root: str, log_type: str | None = None, format: str = "json", max_records: int = 1_000_000, mode: str = "append", ts: str = "eventTime", by_type: bool = False) -> None:
    """Appends events to root/logs/<slug>/year=/month=/day=/hour=.

    Rows meet by hour first, so a run writes few files for each; an hour of many
    rows is dealt out to several tasks. Each log type
    is a write of its own, from persisted rows; ``by_type`` writes all in one
    pass instead, under root/logs/log_type=<slug>/.
    """
    one = events.where(F.col("log_type") == canonical(log_type)) if log_type else events
    rows = with_hours(one.withColumn("_slug", slug_of(F.col("log_type"))), ts)
    kept = [c for c in rows.columns if c not in ("_slug", *PARTITIONS)]
    if format == "json":
        rows = rows.select(F.to_json(F.struct(*kept)).alias("value"), "_slug", *PARTITIONS)
    else:
        # VARIANT columns are written as the JSON they hold
        rows = rows.withColumns({f.name: F.to_json(f.name) for f in rows.schema if f.dataType.simpleString() == "variant"})
    # meets by hour, and splits an hour that is too much for one task
    rows = rows.hint("rebalance", "_slug", *PARTITIONS)

    def put(part: DataFrame, path: str, *by: str) -> None:
        writer = part.write.mode(mode).option("maxRecordsPerFile", max_records).partitionBy(*by, *PARTITIONS)
        if format == "json":
            writer.option("compression", "gzip").text(path)
        else:
            writer.format(format).save(path)

    if by_type:
        put(rows.withColumnRenamed("_slug", "log_type"), f"{root}/logs", "log_type")
    elif log_type:
        put(rows.drop("_slug"), slug_root(root, log_type))
    else:
        rows = rows.persist()
        try:
            for r in rows.select("_slug").distinct().collect():  # at most one row per format
                put(rows.where(F.col("_slug") == r["_slug"]).drop("_slug"), f"{root}/logs/{r['_slug']}")
        finally:
            rows.unpersist()


def slug_root(root: str, log_type: str, by_type: bool = False) -> str:
    return f"{root}/logs/{'log_type=' if by_type else ''}{slug(log_type)}"


def hour_predicate(start: datetime, end: datetime) -> Column:
    """Partitions of the hours that [start, end) touches, as a predicate that prunes them: ranges of whole days and the hours of the days at the ends."""
    hours = hours_between(start, end)
    if not hours:
        return F.lit(False)
    number = F.col("year") * 1_000_000 + F.col("month") * 10_000 + F.col("day") * 100 + F.col("hour")
    key = lambda h: h.year * 1_000_000 + h.month * 10_000 + h.day * 100 + h.hour
    years = sorted({h.year for h in hours})
    return F.col("year").isin(*years) & number.between(key(hours[0]), key(hours[-1]))


def table(spark: SparkSession, root: str, log_type: str, format: str = "json", schema: str | None = None, by_type: bool = False) -> DataFrame:
    """One log type's events with year, month, day and hour as numbers. A table that does not exist yet is an error, an absent hour is not."""
    reader = spark.read.format(format)
    if schema:
        reader = reader.schema(schema + ", year int, month int, day int, hour int")
    return reader.load(slug_root(root, log_type, by_type))


def in_range(df: DataFrame, start: datetime, end: datetime, exact: bool = False, ts: str = "eventTime") -> DataFrame:
    """Events of the hours that [start, end) touches; with ``exact`` only those within it."""
    found = df.where(hour_predicate(start, end))
    if exact:
        at = F.col(ts).cast("timestamp")
        found = found.where((at >= F.lit(start)) & (at < F.lit(end)))
    return found


def stream(events: DataFrame, root: str, checkpoint: str, format: str = "json", every: str | None = None):
    """Writes a stream of events to the lake, a micro-batch at a time."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return events.writeStream.foreachBatch(lambda df, _: write(df, root, format=format)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def create_table(spark: SparkSession, root: str, log_type: str, database: str = "lake", columns: str | None = None) -> str:
    """Registers a log type's table, idempotently, and its partitions; returns its name."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    name = f"`{database}`.`{slug(log_type)}`"
    own = columns or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table(spark, root, log_type).schema if f.name not in PARTITIONS)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({own}, year int, month int, day int, hour int) USING json PARTITIONED BY (year, month, day, hour) LOCATION '{slug_root(root, log_type)}'")
    spark.catalog.recoverPartitions(f"{database}.{slug(log_type)}")
    return f"{database}.{slug(log_type)}"


def add_partition(spark: SparkSession, name: str, hour: datetime) -> None:
    spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION (year={hour.year}, month={hour.month}, day={hour.day}, hour={hour.hour})")


def read_legacy(spark: SparkSession, *paths: str) -> DataFrame:
    """(raw, file) of old objects: gzip members one after another, JSON objects without newlines between them."""
    files = spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("file"), "content")

    def objects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = json.JSONDecoder()
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                raw = bytes(content)
                text = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8", "replace")
                at, rows = 0, []
                while True:
                    while at < len(text) and text[at].isspace():
                        at += 1
                    if at >= len(text):
                        break
                    try:
                        _, end = decode.raw_decode(text, at)
                    except ValueError:
                        end = text.find("\n", at) + 1 or len(text)
                        at = end
                        continue
                    rows.append(text[at:end])
                    at = end
                yield pd.DataFrame({"raw": rows, "file": [file] * len(rows)})

    return files.mapInPandas(objects, "raw string, file string")


def now() -> datetime:
    return datetime.now(UTC)
