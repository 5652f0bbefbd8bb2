"""Queue messages: object notifications, event-bus envelopes and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.paths import at

CREATED = ("ObjectCreated:Put", "ObjectCreated:CompleteMultipartUpload")


def s3_objects(df: DataFrame, body: str = "body") -> DataFrame:
    """df's rows once per new object: bucket and key. A body is a notification, or an envelope of type Notification whose Message is one."""
    top = F.try_parse_json(F.col(body))
    inner = F.try_parse_json(F.when(at(top, "Type") == "Notification", at(top, "Message")))
    records = F.coalesce(at(top, "Records", "array<variant>"), at(inner, "Records", "array<variant>"))
    rows = df.withColumn("_r", F.explode(records))
    return rows.where(at(F.col("_r"), "eventName").isin(*CREATED)).withColumns({"bucket": F.coalesce(at(F.col("_r"), "s3.bucket.name"), F.lit("")), "key": F.coalesce(at(F.col("_r"), "s3.object.key"), F.lit(""))}).drop("_r")


def envelope_source(source: Column, detail_type: Column) -> Column:
    """Log type that an envelope's source or detail type tells; empty if none."""
    return (
        F.when((source == "aws.partner/okta.com") | detail_type.isin("Okta Log Event", "okta-systemlog"), "Okta.SystemLog")
        .when((source == "aws.partner/1password.com") | (detail_type == "1Password Event"), "OnePassword.SignInAttempt")
        .when(source == "aws.partner/sailpoint.com", "Sailpoint.Event")
        .when((source == "google.workspace") | (detail_type == "GSuite Activity"), "GSuite.Reports")
        .when((source == "aws.cloudtrail") | (detail_type.contains("via CloudTrail") & source.startswith("aws.")), "AWS.CloudTrail")
        .otherwise("")
    )


def unwrap_envelopes(df: DataFrame, body: str = "body") -> DataFrame:
    """df with ``raw``, the envelope's detail or the body itself, and ``hint``, the log type its envelope tells."""
    v = F.try_parse_json(F.col(body))
    source, kind, detail = F.coalesce(at(v, "source"), F.lit("")), F.coalesce(at(v, "detail-type"), F.lit("")), at(v, "detail", "variant")
    wrapped = (source != "") & (kind != "") & detail.isNotNull()
    return df.withColumns({"raw": F.when(wrapped, F.to_json(detail)).otherwise(F.col(body)), "hint": F.when(wrapped, envelope_source(source, kind)).otherwise("")})


def split_batches(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per event: of a non-empty array, of an object's non-empty ``events``, or the text itself."""
    v = F.try_parse_json(F.col(raw))
    some = lambda a: F.when(F.size(a) > 0, a)
    is_array = F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))
    items = F.coalesce(F.when(is_array, some(F.try_variant_get(v, "$", "array<variant>"))), some(at(v, "events", "array<variant>")))
    return df.withColumn(raw, F.explode(F.coalesce(F.transform(items, lambda x: F.to_json(x)), F.array(raw))))


def message_metadata(attributes: Column, message_id: Column) -> Column:
    """Times and count of a queue message's attributes (a map of text)."""
    def millis(name: str) -> Column:
        n = F.try_element_at(attributes, F.lit(name)).try_cast("bigint")
        return F.timestamp_millis(F.when(n > 0, n))

    return F.struct(message_id.alias("message_id"), millis("SentTimestamp").alias("sent_at"), millis("ApproximateFirstReceiveTimestamp").alias("first_received_at"), F.coalesce(F.try_element_at(attributes, F.lit("ApproximateReceiveCount")).try_cast("int"), F.lit(0)).alias("receive_count"))
