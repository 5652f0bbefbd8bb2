"""Smaller parts: sources, contexts, metrics and the command line."""

import json
import os
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigilake import cli
from vigilake.functions.k8s import K8s
from vigilake.operators import alerts
from vigilake.plans.query import tiers
from vigilake.rules.model import Event
from vigilake.session import role_settings
from vigilake.sources import files, lake, registry, sinks, tail
from vigilake.sources.notifications import message_metadata
from vigilake.streaming import metrics, stateful


def test_tail_source_follows_a_file(spark, tmp_path):
    path = tmp_path / "audit.log"
    path.write_text("one\ntwo\nunfinished")
    spark.dataSource.register(tail.TailSource)
    df = spark.readStream.format("tail").option("path", str(path)).option("fromStart", "true").load()
    q = df.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()

    def seen(n):
        for _ in range(150):
            rows = [r.raw for r in spark.table("tailed").collect()]
            if len(rows) >= n:
                return rows
            time.sleep(0.2)
        return rows

    try:
        assert seen(2) == ["one", "two"]
        with path.open("a") as f:
            f.write(" line\nlast\n")
        assert seen(4)[2:] == ["unfinished line", "last"]
    finally:
        q.stop()


def test_lines_that_are_too_long_are_counted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MAX_LINE", 20)
    (tmp_path / "a.jsonl").write_text('{"a":1}\n' + "x" * 30 + "\n")
    assert [r.raw for r in files.read_lines(spark, str(tmp_path)).collect()] == ['{"a":1}']
    assert [r.lines for r in files.too_long(spark, str(tmp_path)).collect()] == [1]
    q = files.stream_lines(spark, str(tmp_path)).writeStream.format("memory").queryName("short_lines").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.raw for r in spark.table("short_lines").collect()] == ['{"a":1}']


def test_files_of_one_document_among_files_of_lines(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a":1}\n{"a":2}\n')
    (tmp_path / "whole.json").write_text('{\n "Records": [\n  {"a":3},\n  {"a":4}\n ]\n}\n')
    assert sorted(json.loads(r.raw)["a"] for r in files.read_auto(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]


def test_chat_messages_of_matches(spark):
    rows = spark.createDataFrame([("r", "a < b", "HIGH", "k", "N", "eks.amazonaws.com", "", "")], "rule_id string, title string, severity string, dedup string, eventName string, eventSource string, sourceIPAddress string, awsRegion string")
    message = json.loads(alerts.slack_match(rows).first().payload)["attachments"][0]
    assert message["color"] == "#f57c00" and message["blocks"][0]["text"]["text"] == "a < b"
    assert "*source ip:* N/A (not present on this audit record)" in message["blocks"][2]["text"]["text"]


def test_latencies_of_messages(spark):
    at = datetime(2024, 1, 1, tzinfo=UTC)
    millis = int(at.timestamp() * 1000)
    df = spark.createDataFrame([("m", {"SentTimestamp": str(millis + 5000), "ApproximateFirstReceiveTimestamp": str(millis + 7500), "ApproximateReceiveCount": "2"}, at)], "id string, attributes map<string,string>, eventTime timestamp")
    events = df.withColumn("message", message_metadata(F.col("attributes"), F.col("id")))
    assert events.select("message.receive_count").first()[0] == 2
    got = metrics.latencies(events).first()
    assert (got.event_to_sent_s, got.sent_to_received_s) == (5.0, 2.5)


def test_integrations(spark):
    table = registry.created(registry.created(registry.empty(spark), "a", "A", "aws"), "b", "B", "okta", enabled=False)
    bad = registry.with_status(table, "a", "error", "no access")
    assert registry.get(bad, "a").first().last_error == "no access" and registry.get(bad, "b").first().status == "active"
    assert [r.id for r in registry.listed(bad).collect()] == ["a"]


def test_events_by_the_hour_over_a_stream(spark, tmp_path):
    for k, hours in enumerate(((0, 0, 1), (5,), (9,))):
        rows = [{"eventTime": f"2024-01-01T{h:02}:10:00Z", "log_type": "L"} for h in hours]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(tmp_path / f"in/{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    df = spark.readStream.schema("eventTime timestamp, log_type string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stateful.hourly(df).writeStream.format("memory").queryName("by_hour").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.hour.hour, r.events) for r in spark.table("by_hour").collect())[:2] == [(0, 2), (1, 1)]


def test_kubernetes_contexts(spark):
    record = {
        "kind": "Event", "apiVersion": "audit.k8s.io/v1", "verb": "create", "user": {"username": "jo"}, "sourceIPs": ["1.2.3.4"], "objectRef": {"resource": "pods", "namespace": "n", "name": "p"}, "responseStatus": {"code": 201},
        "requestObject": {"metadata": {"ownerReferences": [{"kind": "ReplicaSet", "name": "r"}]}, "spec": {"hostPID": True, "containers": [{"name": "c", "image": "i", "ports": [{"containerPort": 80}], "env": [{"name": "S", "valueFrom": {"secretKeyRef": {"name": "s", "key": "k"}}}]}], "volumes": [{"name": "v", "hostPath": {"path": "/etc/kubernetes/pki"}}]}},
    }
    df = spark.createDataFrame([(json.dumps(record),)], "p string").select(F.parse_json("p").alias("payload"))
    k = K8s(Event(F.col("payload")))
    got = df.select(k.context.alias("c"), k.pod_context.alias("p")).first()
    assert (got.c.username, got.c.namespace, got.c.verb) == ("jo", "n", "create")
    assert got.p.host_settings.hostPID and not got.p.host_settings.hostIPC and got.p.containers[0].ports == [80]
    assert got.p.containers[0].secret_refs[0].secret_name == "s" and got.p.volumes[0].type == "hostPath" and got.p.owner_references[0].name == "r"


def test_ranges_and_roles():
    now = datetime(2024, 3, 1, tzinfo=UTC)
    day = timedelta(days=1)
    assert [k for k, _, _ in tiers(now - 2 * day, now, now)] == ["recent"] and [k for k, _, _ in tiers(now - 50 * day, now - 40 * day, now)] == ["historical"]
    both = tiers(now - 50 * day, now, now)
    assert [k for k, _, _ in both] == ["recent", "historical"] and both[0][1] == both[1][2] == now - 30 * day
    assert role_settings("b", "arn:x")["spark.hadoop.fs.s3a.bucket.b.assumed.role.arn"] == "arn:x"


def test_results_that_nobody_reads_are_refused(spark):
    assert sinks.result_json(spark.range(2)) == '[{"id":0},{"id":1}]'
    with pytest.raises(ValueError):
        sinks.result_table(spark.range(50), most=49)


def test_command_line(spark, tmp_path, capsys):
    at = datetime(2024, 1, 1, 5, 30, tzinfo=UTC)
    events = spark.createDataFrame([("1", "AWS.CloudTrail", at), ("2", "AWS.CloudTrail", at + timedelta(hours=3))], "eventID string, log_type string, eventTime timestamp")
    lake.write(events, str(tmp_path / "lake"), "cloudtrail")
    ask = ["query", "--lake", str(tmp_path / "lake"), "--start", "2024-01-01T05:00:00Z", "--end", "2024-01-01T06:00:00Z", "--sql", "SELECT eventID FROM {TABLE}"]
    for output, want in (("json", '[{"eventID":"1"}]'), ("csv", "eventID\r\n1"), ("table", "eventID\n-------\n1")):
        assert cli.main([*ask, "--output", output], spark) == 0
        assert capsys.readouterr().out.strip() == want
    spark.createDataFrame([("id", "r", "HIGH", at, "T", None)], "alert_id string, rule_id string, severity string, updated_at timestamp, title string, resolved_at timestamp").write.parquet(str(tmp_path / "alerts"))
    cli.main(["alerts", "--table", str(tmp_path / "alerts"), "--json"], spark)
    assert json.loads(capsys.readouterr().out)[0]["rule_id"] == "r"
    (tmp_path / "a.jsonl").write_text('{"eventID":"1","eventTime":"2024-01-01T00:00:00Z","eventName":"DeleteTrail","eventSource":"x"}\n')
    cli.main(["run", str(tmp_path / "a.jsonl"), "--packs", "aws_cloudtrail"], spark)
    assert "aws_cloudtrail_stopped" in capsys.readouterr().out
