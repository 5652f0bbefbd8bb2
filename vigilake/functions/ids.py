"""Name-based identifiers as pure expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: namespace of alert identifiers.
ALERT_NAMESPACE = "a3bb189e-8bf9-3888-9912-ace4e6543002"


def uuid5(name: Column, namespace: str = ALERT_NAMESPACE) -> Column:
    """RFC 4122 version 5 UUID of a name in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def dedup_key(rule_id: Column, dedup: Column) -> Column:
    return uuid5(F.concat(rule_id, F.lit(":"), dedup))


def alert_id(rule_id: Column, dedup: Column, created_micros: Column) -> Column:
    """Identifier of an alert: its rule, dedup value and time of creation, in nanoseconds as the name has it."""
    return uuid5(F.concat_ws(":", rule_id, dedup, (created_micros * 1000).cast("string")))


def row_id(event_id: Column, event_time: Column) -> Column:
    return F.concat_ws("-", event_id, F.date_format(event_time, "yyyyMMddHHmmss"))
