"""Row types: the normalized event, matches and alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of the envelope that are plain text, in order.
TEXT_FIELDS = ("eventVersion", "eventSource", "eventName", "awsRegion", "sourceIPAddress", "userAgent", "errorCode", "errorMessage", "requestID", "eventID", "eventType", "recipientAccountId")

IDENTITY = (
    "struct<type:string,principalId:string,arn:string,accountId:string,accessKeyId:string,userName:string,"
    "sessionContext:struct<attributes:struct<mfaAuthenticated:string,creationDate:timestamp>,"
    "sessionIssuer:struct<type:string,principalId:string,arn:string,accountId:string,userName:string>>>"
)
RESOURCES = "array<struct<ARN:string,accountId:string,type:string>>"

#: The envelope; requestParameters and responseElements hold the vendor's payload.
ENVELOPE = (
    "eventVersion string, userIdentity " + IDENTITY + ", eventTime timestamp, eventSource string, eventName string, awsRegion string, "
    "sourceIPAddress string, userAgent string, errorCode string, errorMessage string, requestParameters variant, responseElements variant, "
    "requestID string, eventID string, eventType string, recipientAccountId string, resources " + RESOURCES
)
MATCH = "rule_id string, title string, severity string, dedup string, event_id string"
ALERT = "alert_id string, rule_id string, dedup_key string, created_at timestamp, updated_at timestamp, resolved_at timestamp, title string, severity string"

SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def severity_norm(severity: Column) -> Column:
    """Severities are kept as rules give them; this is the upper-cased form, with DEFAULT and blank as INFO."""
    up = F.upper(F.trim(severity))
    return F.when(up.isin(*SEVERITIES), up).otherwise("INFO")
