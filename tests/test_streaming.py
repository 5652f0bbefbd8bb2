import json
import os
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from vigilake.operators.dsl import cnd, tf
from vigilake.operators.pipeline import Pipeline
from vigilake.operators.detect import RuleSet
from vigilake.plans import modes
from vigilake.sources import files, tail
from vigilake.streaming import stateful
from vigilake.streaming.in_order import rocksdb


def batches(spark, tmp_path, parts, schema):
    """A stream that reads one file per micro-batch, in order."""
    for i, rows in enumerate(parts):
        path = tmp_path / f"in/{i:03}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def collected(df, tmp_path, name):
    with rocksdb(df.sparkSession):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def at(minutes):
    return (datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_threshold_and_alerts_keep_state_between_batches(spark, tmp_path):
    one = [{"eventID": "a", "k": "x", "eventTime": at(0)}, {"eventID": "b", "k": "x", "eventTime": at(1)}]
    two = [{"eventID": "c", "k": "x", "eventTime": at(2)}, {"eventID": "d", "k": "y", "eventTime": at(2)}, {"eventID": "e", "k": "x", "eventTime": at(90)}]
    df = batches(spark, tmp_path, [one, two], "eventID string, k string, eventTime timestamp")
    assert [r.event_id for r in collected(stateful.threshold_crossed(df, "k", "eventTime", 600_000_000, 3), tmp_path, "t1")] == ["c"]
    m = df.select(F.lit("r").alias("rule_id"), F.col("k").alias("dedup"), F.lit("t").alias("title"), F.lit("LOW").alias("severity"), "eventTime")
    rows = collected(stateful.alerts(m), tmp_path, "t2")
    assert sorted((r.dedup, r.updated_at.minute, r.is_new_alert) for r in rows) == [("x", 0, True), ("x", 1, False), ("x", 2, False), ("x", 30, True), ("y", 2, True)]


def test_events_count_once(spark, tmp_path):
    rows = [{"log_type": "L", "eventID": "a", "eventTime": at(0)}, {"log_type": "L", "eventID": "a", "eventTime": at(1)}]
    df = batches(spark, tmp_path, [rows, rows[:1]], "log_type string, eventID string, eventTime timestamp")
    assert len(collected(stateful.dedup_events(df), tmp_path, "t3")) == 1


def test_watching_a_directory(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.jsonl").write_text('{"eventID":"1","eventName":"DeleteTrail"}\n{"Records":[{"eventID":"2","eventName":"DeleteTrail"}]}\n')
    seen = []
    rules = RuleSet("intended", [])
    rules.add(lambda e: [e.rule("trail", e.named("DeleteTrail"))], ("AWS.CloudTrail",))
    q = modes.watch(spark, str(tmp_path / "logs"), str(tmp_path / "cp"), lambda a: seen.extend(r.eventID for r in a.matches.collect()), rules)
    q.awaitTermination()
    assert sorted(seen) == ["1", "2"]


def test_pipeline_over_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"a":1}\n{"b":2}\n')
    got = []
    df = files.stream_lines(spark, str(tmp_path / "in")).select(F.col("raw").alias("data"))
    Pipeline([tf.switch((cnd.exists("a"), [tf.stdout()]))]).stream(df, lambda m, o: got.extend([m.count(), o.count()]), str(tmp_path / "cp")).awaitTermination()
    assert got == [2, 1]


def test_tail_through_rotation_and_truncation(tmp_path):
    path = tmp_path / "audit.log"
    path.write_text("old\n")
    lines, off = tail.advance(str(path), {"at": -1, "inode": 0})
    assert lines == [] and off["at"] == 4
    with path.open("a") as f:
        f.write("one\ntwo")
    lines, off = tail.advance(str(path), off)
    assert lines == ["one"] and off["at"] == 8
    with path.open("a") as f:
        f.write("2\n\n")
    lines, off = tail.advance(str(path), off)
    assert lines == ["two2"]
    path.write_text("x\n")
    lines, off = tail.advance(str(path), off)
    assert lines == ["x"]
    path.rename(tmp_path / "audit.log.1")
    (tmp_path / "new").write_text("fresh line\n")
    (tmp_path / "new").rename(path)
    assert tail.advance(str(path), off)[0] == ["fresh line"]


def stateful_rules():
    from vigilake.rules.model import FirstSeen, Threshold

    return RuleSet("intended", []).add(
        lambda e: [
            e.rule("three", e.named("Try"), state=Threshold(e.s("who"), 600, 3)),
            e.rule("new", e.named("Clone"), state=FirstSeen(e.s("who"))),
        ],
        ("AWS.CloudTrail",),
    )


def record(i, name, who, minute):
    return json.dumps({"eventID": f"{i:03}", "eventName": name, "who": who, "eventTime": at(minute), "eventSource": "x"})


def test_rules_remember_earlier_micro_batches(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    parts = [
        [record(1, "Try", "a", 0), record(2, "Try", "a", 1), record(3, "Clone", "b", 0)],
        [record(4, "Try", "a", 5), record(5, "Clone", "b", 1), record(6, "Clone", "c", 1), record(7, "Try", "d", 5)],
        [record(8, "Try", "a", 9), record(9, "Try", "d", 6), record(10, "Clone", "c", 9)],
        [record(11, "Try", "d", 60 * 24 * 9), record(12, "Try", "d", 7)],
    ]
    seen = []
    write = lambda a: seen.append(sorted((r.rule_id, r.eventID) for r in a.matches.collect()))
    for k, rows in enumerate(parts):  # the stream is stopped and started again between them
        (tmp_path / f"logs/{k}.jsonl").write_text("\n".join(rows))
        modes.watch(spark, str(tmp_path / "logs"), str(tmp_path / "cp"), write, stateful_rules()).awaitTermination()
    assert seen == [[("new", "003")], [("new", "006"), ("three", "004")], [], [("three", "012")]]
    kept = sorted(p.name for p in (tmp_path / "cp/rules/hits").glob("*/*"))
    assert len(kept) == 1  # what no window reaches any more is forgotten


def test_a_queue_is_acknowledged_behind_the_sink(spark, tmp_path):
    queue, seen = tmp_path / "queue", []
    queue.mkdir()
    envelope = {"source": "aws.cloudtrail", "detail-type": "AWS API Call via CloudTrail", "detail": json.loads(record(1, "Clone", "x", 0))}
    bodies = [json.dumps(envelope), record(2, "Clone", "y", 0), "[" + record(3, "Clone", "x", 1) + "," + record(4, "Clone", "z", 1) + "]"]
    for k, body in enumerate(bodies):
        (queue / f"{k:04}").write_text(body)

    def failing(_):
        raise ValueError("sink")

    q = modes.consume(spark, str(queue), str(tmp_path / "cp"), failing, stateful_rules())
    try:
        q.awaitTermination()
    except Exception as e:
        assert "sink" in str(e)
    assert len(list(queue.iterdir())) == 3
    for _ in range(2):  # the second run commits what the first has done
        modes.consume(spark, str(queue), str(tmp_path / "cp"), lambda a: seen.extend(sorted(r.eventID for r in a.matches.collect())), stateful_rules()).awaitTermination()
        (queue / "0009").write_text(record(9, "Clone", "x", 3))
    assert seen == ["001", "002", "004"] and not [p for p in queue.iterdir() if p.name < "0009"]


def test_notified_objects_are_read(spark, tmp_path):
    (tmp_path / "store/b/logs").mkdir(parents=True)
    (tmp_path / "queue").mkdir()
    (tmp_path / "store/b/logs/a.json").write_text(record(1, "Clone", "x", 0))
    body = {"Records": [{"eventName": "ObjectCreated:Put", "s3": {"bucket": {"name": "b"}, "object": {"key": "logs/a.json"}}}]}
    (tmp_path / "queue/1").write_text(json.dumps({"Type": "Notification", "Message": json.dumps(body)}))
    seen = []
    modes.consume_notifications(spark, str(tmp_path / "queue"), str(tmp_path / "store"), str(tmp_path / "cp"), lambda a: seen.extend(r.eventID for r in a.matches.collect()), stateful_rules()).awaitTermination()
    assert seen == ["001"]
