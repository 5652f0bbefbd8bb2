"""Counts and latencies of batches and streams."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def processed(events: DataFrame, seconds: str | None = None) -> DataFrame:
    """Events per log type and, if a column of seconds is named, their mean."""
    extra = [F.avg(seconds).alias("mean_seconds")] if seconds else []
    return events.groupBy("log_type").agg(F.count(F.lit(1)).alias("events"), *extra)


def time_span(events: DataFrame, ts: str = "eventTime") -> DataFrame:
    return events.agg(F.min(ts).alias("first_event"), F.max(ts).alias("last_event"))


def exponential_bucket(x: Column, start: float, factor: float, count: int) -> Column:
    """Number of the first of ``count`` exponential buckets that holds x, from 0; ``count`` for none."""
    over = F.ceil(F.log(x / start) / F.log(F.lit(factor)) - 1e-12)
    return F.least(F.greatest(F.when(x <= start, 0).otherwise(over), F.lit(0)), F.lit(count)).cast("int")


def histogram(df: DataFrame, column: str, start: float, factor: float, count: int) -> DataFrame:
    """Rows per exponential bucket of a column."""
    return df.where(F.col(column).isNotNull()).groupBy(exponential_bucket(F.col(column), start, factor, count).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def latencies(events: DataFrame, message: str = "message", ts: str = "eventTime") -> DataFrame:
    """Seconds from the first and last event to the message's sending and first receipt."""
    sent, got = F.max(f"{message}.sent_at"), F.max(f"{message}.first_received_at")
    span = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 1e6
    return events.agg(F.min(ts).alias("first_event"), F.max(ts).alias("last_event"), span(sent, F.max(ts)).alias("event_to_sent_s"), span(got, sent).alias("sent_to_received_s"))


class Progress(StreamingQueryListener):
    """Rows and batches of running streams, by query name."""

    def __init__(self):
        self.rows: dict[str, int] = defaultdict(int)
        self.batches: dict[str, int] = defaultdict(int)
        self.failed: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        name = event.progress.name or str(event.progress.id)
        self.rows[name] += event.progress.numInputRows
        self.batches[name] += 1

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.failed[str(event.id)] = event.exception
