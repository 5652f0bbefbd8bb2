"""Whole runs: files or streams of raw records to matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilake.functions.text import parse_duration
from vigilake.operators.classify import classify
from vigilake.operators.detect import Analysis, RuleSet, analyze_by_pack
from vigilake.operators.stateful import dedup_events
from vigilake.rules.model import FirstSeen, Threshold
from vigilake.sources import files, lake
from vigilake.sources.documents import read_documents
from vigilake.sources.notifications import s3_objects, split_batches, unwrap_envelopes
from vigilake.sources.queue import QueueSource
from vigilake.sources.scratch import Scratch
from vigilake.streaming import detection
from vigilake.streaming.in_order import rocksdb
from vigilake.streaming.rule_state import RuleState


def once(spark: SparkSession, *paths: str, rules: RuleSet | None = None, whole: bool = False, split: bool = False, scratch: Scratch | None = None) -> Analysis:
    """Matches of the records in files: lines, with ``whole`` a document each that one task reads, with ``split`` documents of Records or a list that many tasks read."""
    lines = read_documents(spark, *paths, scratch=scratch) if split else files.read_lines(spark, *paths, whole=whole)
    return batch(lines, rules, scratch=scratch)


def batch(lines: DataFrame, rules: RuleSet | None = None, hint: str | None = None, dedup: bool = False, lake_root: str | None = None, spread: int | None = None, seen: DataFrame | None = None, stateful: bool = True, past: DataFrame | None = None, scratch: Scratch | None = None) -> Analysis:
    """Matches of raw records. With ``dedup`` an event counts once; with ``lake_root`` the events are kept; ``spread`` deals records of few files out to that many tasks."""
    events = classify(lines.repartition(spread) if spread else lines, hint=hint)
    if dedup:
        events = dedup_events(events)
    scratch = scratch or Scratch(lines.sparkSession)
    if lake_root:
        events = scratch.written(events)
        lake.write(events.drop("_raw"), lake_root)
    return analyze_by_pack(events, rules, seen=seen, stateful=stateful, past=past, scratch=scratch)


def messages(df: DataFrame, rules: RuleSet | None = None, body: str = "body", **options) -> Analysis:
    """Matches of queue messages: envelopes opened, batches split, the envelope's source as hint."""
    return batch(split_batches(unwrap_envelopes(df, body)), rules, hint="hint", **options)


def _states(rules: RuleSet) -> tuple[list[str], int]:
    """First-seen rules, and the longest window of the others in seconds."""
    states = {r.rule_id: r.state for rs, _ in rules.build() for r in rs if r.state is not None}
    return [k for k, s in states.items() if isinstance(s, FirstSeen)], max([s.seconds for s in states.values() if isinstance(s, Threshold)], default=0)


def _following(stream: DataFrame, checkpoint: str, write, rules: RuleSet, every: str | None, late_s: int, judge):
    """Runs judge(rows, past, seen, scratch) on each micro-batch; what rules remember lies beside the stream's own checkpoint."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    firsts, window = _states(rules)

    def step(df: DataFrame, number: int) -> None:
        memory = RuleState(df.sparkSession, f"{checkpoint}/rules", window, late_s)
        with Scratch(df.sparkSession) as scratch:
            found = judge(df, past=memory.past(number), seen=memory.seen(number), scratch=scratch)
            write(found)
            memory.keep(number, found, firsts)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/stream").trigger(**trigger).start()


def watch(spark: SparkSession, path: str, checkpoint: str, write, rules: RuleSet | None = None, every: str | None = None, late_s: int = 86_400, max_files: int | None = None):
    """A stream over a directory of log files; write(Analysis) gets each micro-batch, whose tables are deleted behind it. Rules with state see earlier micro-batches too, up to ``late_s`` beyond their window."""
    rules = rules or RuleSet()
    return _following(files.stream_lines(spark, path, max_files=max_files), checkpoint, write, rules, every, late_s, lambda df, **kw: batch(df, rules, **kw))


def follow(spark: SparkSession, path: str, checkpoint: str, write, rules: RuleSet | None = None, every: str | None = None, late: str = "1 hour", max_files: int | None = None, only: tuple[str, ...] | None = None, forget_firsts: str | None = None):
    """A stream over a directory of log files as one plan; write(DataFrame, number) gets each micro-batch's matches.

    Unlike watch(), rules with state count records in the order of their event
    time, however they arrive, if none is over ``late`` behind the newest, and
    their memory is the stream's own keyed state, which is dropped behind their
    windows; keys of first-seen rules are kept for good, or ``forget_firsts``
    behind their last hit. The plan grows with the rules: name the packs.
    """
    rules = rules or RuleSet()
    events = classify(files.stream_lines(spark, path, max_files=max_files))
    found = detection.matches(events, rules, late, only, forget_firsts_us=None if forget_firsts is None else parse_duration(forget_firsts) * 1_000_000)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    with rocksdb(spark):
        return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def consume(spark: SparkSession, queue: str, checkpoint: str, write, rules: RuleSet | None = None, every: str | None = None, late_s: int = 86_400, max_messages: int = 1000):
    """A stream over a message queue's folder: event-bus envelopes, or bare records. A message is acknowledged once write() has returned for it."""
    rules = rules or RuleSet()
    stream = QueueSource.stream(spark, queue, max_messages)
    return _following(stream, checkpoint, write, rules, every, late_s, lambda df, **kw: messages(df, rules, **kw))


def consume_notifications(spark: SparkSession, queue: str, store: str, checkpoint: str, write, rules: RuleSet | None = None, every: str | None = None, late_s: int = 86_400, max_messages: int = 1000):
    """A stream over a queue of notifications of new objects, which are read from ``store``/bucket/key."""
    rules = rules or RuleSet()

    def judge(df: DataFrame, **kw) -> Analysis:
        objects = s3_objects(df).select("bucket", "key").distinct().collect()  # a few for each of at most max_messages messages
        paths = [f"{store.rstrip('/')}/{o.bucket}/{o.key}" for o in objects]
        lines = files.read_lines(spark, *paths) if paths else spark.createDataFrame([], "raw string, file string")
        return batch(lines, rules, **kw)

    return _following(QueueSource.stream(spark, queue, max_messages), checkpoint, write, rules, every, late_s, judge)
