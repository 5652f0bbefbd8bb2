"""Spark session with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def role_settings(bucket: str, role_arn: str) -> dict[str, str]:
    """Settings with which a bucket of another account is read under a role there."""
    at = f"spark.hadoop.fs.s3a.bucket.{bucket}."
    return {at + "aws.credentials.provider": "org.apache.hadoop.fs.s3a.auth.AssumedRoleCredentialProvider", at + "assumed.role.arn": role_arn}


def build(app: str = "vigilake", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Extra settings: key with dots as underscores doubled, or a dict in ``conf``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.python.sql.dataFrameDebugging.enabled": "false"}
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
