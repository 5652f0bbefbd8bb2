"""Stateful operators over streams.

A key's rows count in the order of their event time, however they arrive, as
long as none is over ``late`` behind the newest of the stream; they come out
once the stream's watermark has passed them. Queries over the first three start
within ``in_order.rocksdb(spark)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.ids import alert_id, dedup_key
from vigilake.operators.stateful import PERIOD_MINUTES

from .in_order import Alerting, Crossing, First, folded, with_clock


def threshold_crossed(df: DataFrame, key: str, ts: str, window_us: int, count: int, event_id: str = "eventID", late: str = "0 seconds") -> DataFrame:
    """(key, event_id, event_us) of the events that make it exactly ``count`` in their window. State: the last count + 1 times of a key, until its window has passed."""
    rows = df.select(F.col(key).alias("key"), F.col(event_id).cast("string").alias("event_id"), F.col(ts).alias("ts"))
    return folded(with_clock(rows, F.col("ts"), late).drop("ts"), ["key"], "event_id", Crossing((window_us, count))).select("key", "event_id", "event_us")


def first_seen(df: DataFrame, *keys: str, ts: str | None = None, tie: str | None = None, late: str = "0 seconds", keep_us: int | None = None) -> DataFrame:
    """The first row of each key: by arrival and for ever; with ``ts``, by event time and tie breaker, a key being forgotten ``keep_us`` behind its last row, if that is given."""
    if ts is None:
        return df.dropDuplicates(list(keys))
    return folded(with_clock(df, F.col(ts), late), list(keys), tie or ts, First(keep_us)).select(*df.columns)


def dedup_events(df: DataFrame, ts: str = "eventTime", within: str = "1 day", keys: tuple[str, ...] = ("log_type", "eventID")) -> DataFrame:
    """One event per key, as far as copies are not over ``within`` apart; older state is dropped."""
    return df.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def alerts(matches: DataFrame, period_minutes: int = PERIOD_MINUTES, ts: str = "eventTime", late: str = "0 seconds") -> DataFrame:
    """Every match with the alert it belongs to: alert_id, dedup_key, created_at, updated_at and whether it opened it. State: the open alert, per rule and dedup value, until its period is over."""
    rows = matches.select("rule_id", F.coalesce(F.nullif("dedup", F.lit("")), "title").alias("dedup"), "title", "severity", F.col(ts).alias("ts"))
    done = folded(with_clock(rows, F.col("ts"), late).drop("ts"), ["rule_id", "dedup"], "title", Alerting(period_minutes * 60_000_000))
    return done.select(
        alert_id(F.col("rule_id"), F.col("dedup"), F.col("created")).alias("alert_id"), dedup_key(F.col("rule_id"), F.col("dedup")).alias("dedup_key"), "rule_id", "dedup", "title", "severity",
        F.timestamp_micros("created").alias("created_at"), F.timestamp_micros("event_us").alias("updated_at"), "is_new_alert",
    )


def sessions(df: DataFrame, keys: list[str], gap: str, ts: str = "eventTime", late: str = "1 hour") -> DataFrame:
    """Events per key and session, which ends ``gap`` behind its last event; a session comes out ``late`` after its end."""
    return df.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("events")).select(*keys, F.col("s.start").alias("first"), F.col("s.end").alias("end"), "events")


def hourly(df: DataFrame, ts: str = "eventTime", late: str = "1 hour") -> DataFrame:
    """Events per log type and hour; hours close ``late`` after their end."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), "log_type").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("hour"), "log_type", "events")
