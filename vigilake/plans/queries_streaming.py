"""Queries that replay the driver's events as a stream, out of order, and give what the stream's operators let out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators.detect import RuleSet
from vigilake.rules.model import Event, FirstSeen, Threshold
from vigilake.sources.scratch import Scratch
from vigilake.streaming import detection, stateful
from vigilake.streaming.in_order import rocksdb

from .queries_core import _FOLD, QUERIES, load, query

#: micro-batches, files of one at least, rows of a file at most
_PARTS, _FILES, _ROWS, _DAY = 4, 2, 50_000, 86_400
#: partitions of state at least, if the session has so many, and rows for each further one
_STATES, _STATE_ROWS = 24, 250_000


def replayed(events: DataFrame, run: Callable[[DataFrame], DataFrame], ts: str = "ts") -> DataFrame:
    """What ``run(stream, late)`` gives for a stream of all events, which come up to a day late and in several micro-batches.

    The last micro-batch is a row of nulls but for its time, far enough on to
    let everything before it out.
    """
    spark = events.sparkSession
    root = Scratch(spark).root
    arrival = F.unix_seconds(F.col(ts).cast("timestamp")) + F.pmod(F.xxhash64(*events.columns), F.lit(_DAY))
    dealt = events.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("_arrival", arrival)
    first, last, newest, rows = dealt.agg(F.min("_arrival"), F.max("_arrival"), F.max(ts), F.count(F.lit(1))).first()
    files = max(_FILES, rows // (_PARTS * _ROWS))
    if first is None:
        first = last = 0
    width = (last - first) // _PARTS + 1
    late = f"{width + 2 * _DAY} seconds"
    for k in range(_PARTS):
        part = dealt.where((F.col("_arrival") >= first + k * width) & (F.col("_arrival") < first + (k + 1) * width)).drop("_arrival")
        part.repartition(files).write.mode("append").parquet(f"{root}/in")
    end = dealt.limit(1).select(*(F.lit(None).cast(dealt.schema[c].dataType).alias(c) if c != ts else (F.lit(newest) + F.expr(f"interval {late}") + F.expr("interval 1 minute")).alias(c) for c in events.columns))
    end.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(dealt.drop("_arrival").schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    out = run(stream, late)
    with rocksdb(spark, max(_STATES, rows // _STATE_ROWS)):
        q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query(QUERIES["window_threshold"][1])
def stream_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    tie = F.lpad(F.col("event_id").cast("string"), 20, "0").alias("tie")
    out = replayed(e, lambda s, late: stateful.threshold_crossed(s.select("user_id", "ts", tie), "user_id", "ts", 86_400_000_000, 3, "tie", late).where("key is not null"))
    return out.select(F.col("event_id").cast("long").alias("event_id"), F.col("key").cast("long").alias("user_id"))


@query(QUERIES["first_seen"][1])
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string").alias("user_id"), "event_id", "ts")
    with_tie = lambda s: s.withColumn("tie", F.lpad(F.col("event_id").cast("string"), 20, "0"))
    out = replayed(e, lambda s, late: stateful.first_seen(with_tie(s), "event_type", "user_id", ts="ts", tie="tie", late=late))
    return out.where("event_id is not null").select("event_type", F.col("user_id").cast("long").alias("user_id"), "event_id")


@query(_FOLD + "SELECT CAST(r.k AS VARCHAR) AS dedup, r.c AS created, e.t AS updated, count(*) AS hits FROM r JOIN e ON e.k = r.k AND e.t BETWEEN r.c AND r.c + 86400000000 GROUP BY 1, 2, 3")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where("event_type = 'error'").select(F.lit("errors").alias("rule_id"), F.col("user_id").cast("string").alias("dedup"), F.lit("Error").alias("title"), F.lit("HIGH").alias("severity"), "ts")
    out = replayed(e, lambda s, late: stateful.alerts(s, 1440, "ts", late)).where("dedup is not null and rule_id is not null")
    return out.groupBy("dedup", F.unix_micros("created_at").alias("created"), F.unix_micros("updated_at").alias("updated")).agg(F.count(F.lit(1)).alias("hits"))


def _rules(e: Event) -> list:
    return [
        e.rule("error", e.eq("event_type", "error"), severity="LOW"),
        e.rule("many_clicks", e.eq("event_type", "click"), severity="HIGH", state=Threshold(e.s("user_id"), 86_400, 2)),
        e.rule("many_views", e.eq("event_type", "view"), severity="HIGH", state=Threshold(e.s("user_id"), 172_800, 3)),
        e.rule("new_buyer", e.eq("event_type", "purchase"), severity="INFO", state=FirstSeen(e.s("user_id"))),
    ]


_WINDOW = "(SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND {} PRECEDING) AS n FROM events WHERE event_type = '{}') x WHERE n = {}"


@query(
    "SELECT event_id, 'error' AS rule_id FROM events WHERE event_type = 'error'"
    f" UNION ALL SELECT event_id, 'many_clicks' AS rule_id FROM {_WINDOW.format(86_400_000_001, 'click', 2)}"
    f" UNION ALL SELECT event_id, 'many_views' AS rule_id FROM {_WINDOW.format(172_800_000_001, 'view', 3)}"
    " UNION ALL SELECT event_id, 'new_buyer' AS rule_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase') y WHERE n = 1"
)
def stream_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with and without state in one streaming plan."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")

    def run(s: DataFrame, late: str) -> DataFrame:
        payload = F.parse_json(F.to_json(F.struct("user_id", "event_type")))
        rows = s.select(F.lpad(F.col("event_id").cast("string"), 20, "0").alias("eventID"), F.col("ts").alias("eventTime"), payload.alias("payload"), F.when(F.col("event_id").isNotNull(), "Own").otherwise("none").alias("log_type"))
        return detection.matches(rows, RuleSet("intended", []).add(_rules, ("Own",)), late)

    return replayed(e, run).select(F.col("eventID").cast("long").alias("event_id"), "rule_id")
