"""Stateful operators over finished data: thresholds in sliding windows, first occurrences, event and alert deduplication.

All take an order (a time, then a tie breaker) instead of relying on arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from vigilake.functions.ids import alert_id, dedup_key


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def event_time(payload: Column, otherwise: Column) -> Column:
    """Time of an event for windows: the first of four fields that holds one; text without a zone is UTC, numbers are epoch seconds."""
    from vigilake.functions.paths import at
    from vigilake.functions.text import any_timestamp

    given = F.filter(F.array(*(at(payload, p) for p in ("p_event_time", "Datetime", "EdgeStartTimestamp", "date_create"))), lambda x: x != "")

    def read(first: Column) -> Column:
        number = first.try_cast("double")
        return F.coalesce(F.when(number.isNotNull(), F.timestamp_micros((number * 1_000_000).cast("bigint"))), any_timestamp(first))

    # over a list, so each field is looked up once, however often its value is read
    return F.coalesce(F.get(F.transform(F.slice(given, 1, 1), read), F.lit(0)), otherwise)


def window_count(df: DataFrame, keys: list[str], ts: str, order: list[str], window: int, name: str = "n") -> DataFrame:
    """df with the number of a key's rows, up to this one in order, whose ``ts`` is not over ``window`` before this one's.

    ts and window are whole numbers of one unit. Rows of equal ts count in
    their order, which a plain range frame, that takes peers together, does not.
    """
    upto = F.row_number().over(Window.partitionBy(*keys).orderBy(ts, *order))
    gone = F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(ts).rangeBetween(Window.unboundedPreceding, -(window + 1)))
    return df.withColumn(name, upto - gone)


def threshold_crossed(df: DataFrame, keys: list[str], ts: str, order: list[str], window: int, count: int) -> DataFrame:
    """The rows that make it exactly ``count`` rows of their key in the window that ends with them."""
    return window_count(df, keys, ts, order, window, "_n").where(F.col("_n") == count).drop("_n")


def thresholds_crossed(df: DataFrame, rules: dict[str, tuple[int, int]], rule: str, key: str, ts: str, order: list[str]) -> DataFrame:
    """The same for several rules in one pass; rules: rule_id to (window, count).

    Rows are sorted once; each different length of window is a frame over that.
    """
    if not rules:
        return df.limit(0)
    of = lambda k: F.try_element_at(F.create_map(*(x for r, v in rules.items() for x in (F.lit(r), F.lit(v[k]).cast("bigint")))), F.col(rule))
    upto = F.row_number().over(Window.partitionBy(rule, key).orderBy(ts, *order))
    gone = F.lit(0).cast("bigint")
    for w in sorted({w for w, _ in rules.values()}):
        past = F.count(F.lit(1)).over(Window.partitionBy(rule, key).orderBy(ts).rangeBetween(Window.unboundedPreceding, -(w + 1)))
        gone = F.when(of(0) == w, past).otherwise(gone)
    return df.where(of(0).isNotNull()).withColumn("_n", upto - gone).where(F.col("_n") == of(1)).drop("_n")


def first_seen(df: DataFrame, keys: list[str], order: list[str], seen: DataFrame | None = None) -> DataFrame:
    """The first row of each key, in order, of keys that are not in ``seen``."""
    fresh = df if seen is None else df.join(seen.select(*keys).distinct(), keys, "left_anti")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return fresh.withColumn("_r", rank).where("_r = 1").drop("_r")


def dedup_events(df: DataFrame, keys: tuple[str, ...] = ("log_type", "eventID"), approximate: bool = False) -> DataFrame:
    """One row per key. ``approximate`` compares 64-bit hashes of the keys only: less to shuffle, and rarely an event too few."""
    if not approximate:
        return df.dropDuplicates(list(keys))
    return df.withColumn("_h", F.xxhash64(*keys)).dropDuplicates(["_h"]).drop("_h")


PERIOD_MINUTES = 60


_KEY = ["rule_id", "dedup"]
#: Parts of a period: how finely a key's times are dealt out.
_PARTS = 64


def _nearest(asked: DataFrame, given: DataFrame, width: int, after: bool) -> DataFrame:
    """asked (rule_id, dedup, x) with ``found``: of a key's given times (rule_id, dedup, t) the smallest over x or, if not ``after``, the largest up to x.

    Times are looked for within parts of ``width``, so a key is many tasks; what
    a part does not have is that of the nearest part that has any.
    """
    part = lambda c: F.floor(F.col(c) / width).alias("b")
    rows = given.select(*_KEY, part("t"), F.col("t").alias("x"), F.col("t")).unionByName(asked.select(*_KEY, part("x"), "x", F.lit(None).cast("long").alias("t")))
    best = F.min if after else F.max
    order = Window.partitionBy(*_KEY, "b").orderBy("x", F.col("t").isNull())
    frame = order.rowsBetween(1, Window.unboundedFollowing) if after else order.rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("found", best("t").over(frame)).where("t is null")
    parts = rows.groupBy(*_KEY, "b").agg(best("t").alias("edge"))
    line = Window.partitionBy(*_KEY).orderBy("b")
    line = line.rowsBetween(1, Window.unboundedFollowing) if after else line.rowsBetween(Window.unboundedPreceding, -1)
    beyond = parts.withColumn("beyond", best("edge").over(line)).select(*_KEY, "b", "beyond")
    return here.join(beyond, [*_KEY, "b"]).select(*_KEY, "x", F.coalesce("found", "beyond").alias("found"))


def openings(times: DataFrame, period: int, scratch, before: DataFrame | None = None) -> DataFrame:
    """(rule_id, dedup, c): when each key's alerts are created, from its distinct times (rule_id, dedup, t), by pointer doubling.

    Every time points to the first one over ``period`` later. The times reached
    from a key's first are found in as many rounds as their number has binary
    digits: a round adds what the reached ones point to and doubles how far all
    point. ``before`` (rule_id, dedup, c) are alerts already open, from which
    their keys start.
    """
    width = max(1, period // _PARTS)
    nodes, first = times, times.groupBy(*_KEY).agg(F.min("t").alias("c"))
    if before is not None:
        nodes = nodes.unionByName(before.withColumnRenamed("c", "t")).distinct()
        first = before.unionByName(first.join(before.select(*_KEY), _KEY, "left_anti"))
    reached = scratch.written(first)
    asked = nodes.withColumn("x", F.col("t") + period)
    points = _nearest(asked.drop("t"), times, width, True).where("found is not null").select(*_KEY, (F.col("x") - period).alias("t"), F.col("found").alias("to"))
    points, n = scratch.written(points), reached.count()
    while True:
        more = reached.join(points, reached["c"].eqNullSafe(points["t"]) & (reached["rule_id"] == points["rule_id"]) & (reached["dedup"] == points["dedup"])).select(reached["rule_id"], reached["dedup"], F.col("to").alias("c"))
        reached = scratch.written(reached.unionByName(more).distinct())
        known, n = n, reached.count()
        if n == known:
            return reached
        then = points.select(*_KEY, F.col("t").alias("to"), F.col("to").alias("further"))
        points = scratch.written(points.join(then, [*_KEY, "to"]).select(*_KEY, "t", F.col("further").alias("to")))


def alerted_in_parts(matches: DataFrame, scratch, period_minutes: int = PERIOD_MINUTES, open_alerts: DataFrame | None = None, ts: str = "event_time", seq: str | None = None) -> DataFrame:
    """What alerted() gives, by steps none of which takes a key as a whole: for keys with more matches than a task should read. rule_id and dedup must not be null; tables are in ``scratch``."""
    period = period_minutes * 60_000_000
    rows = matches.withColumns({"_t": micros(F.col(ts)), "_s": (F.col(seq) if seq else F.lit(0)).cast("long"), "_updated": F.lit(None).cast("long")})
    before = None
    if open_alerts is not None:
        before = open_alerts.groupBy(*_KEY).agg(F.min(micros(F.col("created_at"))).alias("c"))
    times = scratch.written(rows.select(*_KEY, F.col("_t").alias("t")).distinct())
    created = openings(times, period, scratch, before)
    owner = _nearest(times.withColumnRenamed("t", "x"), created.withColumnRenamed("c", "t"), max(1, period // _PARTS), False)
    if before is not None:  # a match before an open alert belongs to it
        owner = owner.join(before, _KEY, "left").withColumn("found", F.coalesce("found", "c")).drop("c")
    marked = rows.join(owner.select(*_KEY, F.col("x").alias("_t"), F.col("found").alias("_created")), [*_KEY, "_t"])
    first = F.row_number().over(Window.partitionBy(*_KEY, "_t").orderBy("_s", "title", "severity")) == 1
    new = first & (F.col("_t") == F.col("_created"))
    if before is not None:
        open_ = before.select(*_KEY, F.col("c").alias("_open"))
        marked = marked.join(open_, _KEY, "left")
        new = new & ~F.coalesce(F.col("_open") == F.col("_created"), F.lit(False))
    out = marked.withColumn("_new", new).select(*rows.columns, "_created", "_new")
    if open_alerts is None:
        return out
    old = open_alerts.select(*_KEY, "title", "severity", micros(F.col("created_at")).alias("_t"), F.lit(-1).cast("long").alias("_s"), micros(F.col("updated_at")).alias("_updated"))
    old = old.join(before.withColumnRenamed("c", "_created"), _KEY).withColumn("_new", F.lit(False))
    return out.unionByName(old, allowMissingColumns=True)


def alerted(matches: DataFrame, period_minutes: int = PERIOD_MINUTES, open_alerts: DataFrame | None = None, ts: str = "event_time", seq: str | None = None, hot_rows: int | None = None, scratch=None) -> DataFrame:
    """matches with ``_created``, when their alert was created, in microseconds, and ``_new``, whether they opened it.

    Of equal times the first by ``seq``, title and severity comes first. A match
    before an alert that is already open belongs to it. ``open_alerts`` come out
    too, as rows of which only rule_id, dedup, title, severity, ``_created`` and
    ``_updated`` are set; ``_updated`` is null for matches.

    Rows are sorted within partitions and marked as they stream by, so a key of
    any number of matches takes constant memory, but is one task. With
    ``hot_rows``, keys of more matches go by alerted_in_parts(), whose tables
    are in ``scratch``.
    """
    if hot_rows is not None:
        hot = scratch.written(matches.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select(*_KEY))
        if hot.take(1):
            split = lambda df, how: None if df is None else df.join(F.broadcast(hot), _KEY, how)  # noqa: E731  at most rows / hot_rows keys
            cold = alerted(split(matches, "left_anti"), period_minutes, split(open_alerts, "left_anti"), ts, seq)
            return cold.unionByName(alerted_in_parts(split(matches, "left_semi"), scratch, period_minutes, split(open_alerts, "left_semi"), ts, seq), allowMissingColumns=True)
    period = period_minutes * 60_000_000
    rows = matches.withColumns({"_t": micros(F.col(ts)), "_s": (F.col(seq) if seq else F.lit(0)).cast("long"), "_updated": F.lit(None).cast("long")})
    if open_alerts is not None:
        before = open_alerts.select("rule_id", "dedup", "title", "severity", micros(F.col("created_at")).alias("_t"), F.lit(-1).cast("long").alias("_s"), micros(F.col("updated_at")).alias("_updated"))
        rows = rows.unionByName(before, allowMissingColumns=True)
    ordered = rows.repartition("rule_id", "dedup").sortWithinPartitions("rule_id", "dedup", F.col("_updated").isNull(), "_t", "_s", "title", "severity")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start = None, None
        for batch in batches:
            created, new = [], []
            for rule_id, dedup, t, updated in zip(*(batch.column(c).to_pylist() for c in ("rule_id", "dedup", "_t", "_updated")), strict=True):
                if (rule_id, dedup) != key:
                    key, start = (rule_id, dedup), None
                opens = start is None or (updated is None and start < t - period)
                start = t if opens else start
                created.append(start)
                new.append(opens and updated is None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(created, pa.int64()), pa.array(new, pa.bool_())], names=[*batch.schema.names, "_created", "_new"])

    schema = StructType([*ordered.schema.fields, StructField("_created", LongType()), StructField("_new", BooleanType())])
    return ordered.mapInArrow(mark, schema)


def alert_runs(matches: DataFrame, period_minutes: int = PERIOD_MINUTES, open_alerts: DataFrame | None = None, ts: str = "event_time", seq: str | None = None, hot_rows: int | None = None, scratch=None) -> DataFrame:
    """Alerts that a table of matches leads to.

    matches: rule_id, dedup, title, severity and a time. An alert takes in the
    matches of its rule and dedup value until ``period_minutes`` after its
    creation, the last microsecond included; the next one resolves it and opens
    another. An alert's title and severity are those of its last match. Alerts
    still open from before are given as ``open_alerts`` (rule_id, dedup,
    created_at, updated_at, title, severity).
    """
    kept = matches.select("rule_id", "dedup", "title", "severity", ts, *([seq] if seq else []))
    rows = alerted(kept, period_minutes, open_alerts, ts, seq, hot_rows, scratch)
    last = F.struct(F.col("_updated").isNull(), "_t", "_s", "title", "severity")
    runs = rows.groupBy("rule_id", "dedup", F.col("_created").alias("created")).agg(F.max(F.coalesce("_updated", "_t")).alias("updated"), F.count_if(F.col("_updated").isNull()).alias("hits"), F.max_by(F.struct("title", "severity"), last).alias("last"))
    resolved = F.lead("created").over(Window.partitionBy("rule_id", "dedup").orderBy("created"))
    return runs.withColumn("resolved", resolved).select(
        alert_id(F.col("rule_id"), F.col("dedup"), F.col("created")).alias("alert_id"),
        "rule_id",
        "dedup",
        dedup_key(F.col("rule_id"), F.col("dedup")).alias("dedup_key"),
        F.timestamp_micros("created").alias("created_at"),
        F.timestamp_micros("updated").alias("updated_at"),
        F.timestamp_micros("resolved").alias("resolved_at"),
        "last.title",
        "last.severity",
        "hits",
    )


def resolve(alerts: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """alerts with resolved_at set on those whose alert_id is among ``ids`` and that are open."""
    marked = alerts.join(ids.select("alert_id").distinct().withColumn("_hit", F.lit(True)), "alert_id", "left")
    return marked.withColumn("resolved_at", F.when(F.col("_hit") & F.col("resolved_at").isNull(), now).otherwise(F.col("resolved_at"))).drop("_hit")


MOST_LISTED = 50_000


def open_alerts(alerts: DataFrame, limit: int = 100, offset: int = 0, rule_id: str | None = None) -> DataFrame:
    """A page of the open alerts, the last updated first; of one rule, the last created first."""
    rows = alerts.where("resolved_at is null")
    if rule_id is not None:
        return rows.where(F.col("rule_id") == rule_id).orderBy(F.desc("created_at"), "alert_id")
    limit = 100 if limit <= 0 else min(limit, MOST_LISTED)
    return rows.orderBy(F.desc("updated_at"), "alert_id").offset(max(0, offset)).limit(limit)
