"""From matches to alerts that go out: deduplication, context, and the forms that sinks take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.ids import alert_id, dedup_key
from vigilake.functions.text import slack_escaped, truncated

from .stateful import PERIOD_MINUTES, alerted

# Colours by severity.
COLOURS = {"CRITICAL": "#d32f2f", "HIGH": "#f57c00", "MEDIUM": "#fbc02d", "LOW": "#689f38", "INFO": "#1976d2", "DEFAULT": "#fbc02d"}
OTHER_COLOUR = "#757575"
HEADER_MOST = 150
CONTEXT = ("eventName", "eventSource", "sourceIPAddress", "recipientAccountId", "awsRegion")


def with_dedup(matches: DataFrame) -> DataFrame:
    """matches whose empty dedup value is their title."""
    return matches.withColumn("dedup", F.coalesce(F.nullif("dedup", F.lit("")), "title"))


def forward(matches: DataFrame, period_minutes: int = PERIOD_MINUTES, open_alerts: DataFrame | None = None, ts: str = "eventTime") -> DataFrame:
    """Every match with its alert. ``is_new_alert`` marks the one match that opened it; whether others go out is the sink's affair."""
    rows = alerted(with_dedup(matches), period_minutes, open_alerts, ts).where("_updated is null")
    present = [c for c in CONTEXT if c in matches.columns]
    context = F.create_map(*(x for c in present for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit(""))))) if present else F.create_map().cast("map<string,string>")
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select(
        *matches.columns, alert_id(F.col("rule_id"), F.col("dedup"), F.col("_created")).alias("alert_id"), dedup_key(F.col("rule_id"), F.col("dedup")).alias("dedup_key"), context.alias("alert_context"),
        time(F.timestamp_micros("_created")).alias("alert_created"), time(ts).alias("alert_updated"), F.col("_new").alias("is_new_alert"),
    )


def colour(severity: Column) -> Column:
    out = F.lit(OTHER_COLOUR)
    for s, c in COLOURS.items():
        out = F.when(severity == s, c).otherwise(out)
    return out


def _lines(pairs: list[tuple[str, Column]]) -> Column:
    return F.array_join(F.array(*(F.concat(F.lit(f"*{name}:* "), slack_escaped(F.coalesce(c.cast("string"), F.lit("")))) for name, c in pairs)), "\n")


def _message(severity: Column, title: Column, *sections: Column) -> Column:
    plain = F.struct(F.lit("header").alias("type"), F.struct(F.lit("plain_text").alias("type"), truncated(title, HEADER_MOST).alias("text")).alias("text"))
    blocks = [plain, *(F.struct(F.lit("section").alias("type"), F.struct(F.lit("mrkdwn").alias("type"), s.alias("text")).alias("text")) for s in sections)]
    return F.to_json(F.struct(F.array(F.struct(colour(severity).alias("color"), F.array(*blocks).alias("blocks"))).alias("attachments")))


def slack_match(m: DataFrame) -> DataFrame:
    """matches with ``payload``, the chat message of each."""
    col = lambda n: F.col(n) if n in m.columns else F.lit("")
    cluster = col("eventSource") == "eks.amazonaws.com"

    def known(name: str, otherwise: str) -> Column:
        value = F.coalesce(col(name), F.lit(""))
        return F.when((value == "") & cluster, otherwise).otherwise(value)

    user = F.col("userIdentity.type") if "userIdentity" in m.columns else F.lit("")
    summary = _lines([("severity", F.col("severity")), ("rule", F.col("rule_id")), ("dedup", F.col("dedup"))])
    event = _lines(
        [
            ("event name", col("eventName")), ("event source", col("eventSource")), ("source ip", known("sourceIPAddress", "N/A (not present on this audit record)")), ("user agent", col("userAgent")),
            ("region", known("awsRegion", "N/A (Kubernetes audit has no AWS region)")), ("user identity type", user), ("account id", known("recipientAccountId", "N/A (Kubernetes audit has no AWS account)")),
        ]
    )
    return m.withColumn("payload", _message(F.col("severity"), F.col("title"), summary, event))


def slack_alert(a: DataFrame) -> DataFrame:
    """forwarded alerts with ``payload``, the chat message of each."""
    meta = _lines([("rule id", F.col("rule_id")), ("severity", F.col("severity")), ("alert id", F.col("alert_id")), ("dedup key", F.col("dedup_key")), ("created", F.col("alert_created")), ("updated", F.col("alert_updated"))])
    names = (("event name", "eventName"), ("event source", "eventSource"), ("source ip", "sourceIPAddress"), ("region", "awsRegion"), ("account id", "recipientAccountId"))
    event = _lines([(label, F.try_element_at("alert_context", F.lit(n))) for label, n in names])
    return a.withColumn("payload", _message(F.col("severity"), F.col("title"), meta, event))


def counts(matches: DataFrame) -> DataFrame:
    """Alerts by severity and rule."""
    return matches.groupBy("severity", "rule_id").agg(F.count(F.lit(1)).alias("n"))
