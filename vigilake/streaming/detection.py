"""Rules over a stream of events, those with state included.

Hits of rules without state come out with their micro-batch. Hits of the others
are keyed by rule and state value and counted in the order of their event time,
so what comes out does not depend on micro-batches or arrival, as far as no
record is over ``late`` behind the newest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.operators.classify import with_payload
from vigilake.operators.detect import LONG_AGO, RuleSet, found_hits
from vigilake.operators.stateful import event_time
from vigilake.rules.model import Threshold

from .in_order import ByFirstPart, Crossing, First, folded, with_clock


def matches(events: DataFrame, rules: RuleSet, late: str = "1 hour", only: tuple[str, ...] | None = None, keep: tuple[str, ...] = ("eventID", "eventTime", "eventSource", "eventName"), forget_firsts_us: int | None = None) -> DataFrame:
    """log_type, kept columns, rule_id, title, severity and dedup of each match of a stream of classified events. Keys of first-seen rules are forgotten ``forget_firsts_us`` behind their last hit, if that is given. Start the query within ``in_order.rocksdb(spark)``."""
    if "payload" not in events.columns:
        events = with_payload(events, rules.mode)
    order = F.coalesce("eventTime", F.timestamp_seconds(F.lit(0))) if "eventTime" in events.columns else F.timestamp_seconds(F.lit(0))
    timed = with_clock(events, event_time(F.col("payload"), order), late)
    found, states = found_hits(timed, rules, only, ("_ts", *keep))
    columns = ["log_type", *(c for c in keep if c in events.columns), "rule_id", "title", "severity", "dedup"]
    out = found.where(~F.col("rule_id").isin(*states)).select(*columns)
    tie = F.concat_ws("\0", *(c for c in ("eventID", "title") if c in found.columns))
    folds = {k: Crossing((s.seconds * 1_000_000, s.count)) if isinstance(s, Threshold) else First(forget_firsts_us) for k, s in states.items()}
    if folds:
        # all in one keyed state, as each further one reads the micro-batch and evaluates the rules once more
        rows = found.where(F.when(F.col("_ts") >= LONG_AGO, F.col("rule_id").isin(*folds))).drop("_at").withColumn("_tie", tie)
        out = out.unionByName(folded(rows, ["rule_id", "state"], "_tie", ByFirstPart(folds)).select(*columns))
    return out
