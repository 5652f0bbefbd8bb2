"""SQL over a time range of the lake."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from vigilake.functions.text import parse_duration
from vigilake.sources import lake

HOLE = "{TABLE}"
#: Where ranges are told apart as recent and historical; both are read alike.
RECENT_DAYS = 30


def tiers(start: datetime, end: datetime, now: datetime | None = None, recent_days: int = RECENT_DAYS) -> list[tuple[str, datetime, datetime]]:
    """The parts of a range before and behind the cutoff: (historical or recent, start, end). A hint only; a query scans all in one."""
    cutoff = (now or lake.now()) - timedelta(days=recent_days)
    if start > cutoff:
        return [("recent", start, end)]
    if end < cutoff:
        return [("historical", start, end)]
    return [("recent", cutoff, end), ("historical", start, cutoff)]


class Lake:
    """A lake at ``root``. All of a query's range is one scan, whose partitions Catalyst prunes; nothing is stitched together afterwards."""

    def __init__(self, spark: SparkSession, root: str, format: str = "json"):
        self.spark, self.root, self.format = spark, root, format

    def view(self, log_type: str, start: datetime, end: datetime, exact: bool = False, schema: str | None = None) -> str:
        """Name of a temporary view of the range."""
        df = lake.in_range(lake.table(self.spark, self.root, log_type, self.format, schema), start, end, exact)
        name = f"lake_{lake.slug(log_type)}"
        df.createOrReplaceTempView(name)
        return name

    def query(self, sql: str, log_type: str = "cloudtrail", start: datetime | None = None, end: datetime | None = None, last: str | None = None, exact: bool = False, schema: str | None = None) -> DataFrame:
        """Result of ``sql``, in which {TABLE} stands for the log type's table; the last 24 hours unless a range is given."""
        end = end or lake.now()
        start = start or end - timedelta(seconds=parse_duration(last) if last else 86_400)
        if start >= end:
            raise ValueError("the range is empty")
        return self.spark.sql(sql.replace(HOLE, self.view(log_type, start, end, exact, schema)))
