import gzip
import json
from datetime import UTC, datetime

from pyspark.sql import functions as F

from vigilake.operators.classify import classify
from vigilake.plans.query import Lake
from vigilake.sources import files, lake, ledger


def events(spark):
    rows = [json.dumps({"eventID": f"e{i}", "eventName": "N", "eventTime": f"2024-01-01T{9 + i:02}:30:00Z", "requestParameters": {"i": i}}) for i in range(4)]
    rows.append(json.dumps({"uuid": "u", "published": "2024-01-01T10:00:00Z", "eventType": "t"}))
    return classify(spark.createDataFrame([(r,) for r in rows], "raw string")).drop("_raw")


def test_write_query_and_prune(spark, tmp_path):
    root = str(tmp_path)
    lake.write(events(spark), root)
    assert (tmp_path / "logs/aws_cloudtrail/year=2024/month=01/day=01/hour=09").is_dir() and (tmp_path / "logs/okta_systemlog").is_dir()
    start, end = datetime(2024, 1, 1, 10, 0, tzinfo=UTC), datetime(2024, 1, 1, 11, 15, tzinfo=UTC)
    at = Lake(spark, root)
    sql = "SELECT a.eventID AS id, count(*) AS n FROM {TABLE} a JOIN {TABLE} b ON a.eventID = b.eventID GROUP BY a.eventID"
    assert sorted(r.id for r in at.query(sql, "cloudtrail", start, end).collect()) == ["e1", "e2"]
    assert [r.id for r in at.query(sql, "cloudtrail", start, end, exact=True).collect()] == ["e1"]
    plan = lake.in_range(lake.table(spark, root, "cloudtrail"), start, end)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "year#" in plan.split("PartitionFilters")[1]
    name = lake.create_table(spark, root, "cloudtrail", "lake_test")
    lake.add_partition(spark, name, start)
    assert spark.table(name).where("hour = 9").count() == 1


def test_one_pass_layout_and_old_objects(spark, tmp_path):
    lake.write(events(spark), str(tmp_path), by_type=True)
    assert lake.table(spark, str(tmp_path), "okta.systemlog", by_type=True).count() == 1
    old = tmp_path / "old.json.gz"
    old.write_bytes(b"".join(gzip.compress(json.dumps({"eventID": f"x{i}"}).encode()) for i in range(3)))
    assert {json.loads(r.raw)["eventID"] for r in lake.read_legacy(spark, str(old)).collect()} == {"x0", "x1", "x2"}


def test_names_and_hours():
    assert lake.slug("cloudtrail") == "aws_cloudtrail" == lake.slug("AWS.CloudTrail")
    hour = datetime(2024, 1, 5, 9)
    assert lake.object_key("gcp", hour, "f.json.gz") == "logs/gcp_auditlog/year=2024/month=01/day=05/hour=09/f.json.gz"
    span = lambda *a: len(lake.hours_between(*a))
    assert span(hour, datetime(2024, 1, 5, 10)) == 1 and span(hour, datetime(2024, 1, 6, 9)) == 24 and span(hour, hour) == 0 and span(datetime(2024, 1, 5, 9, 59), datetime(2024, 1, 5, 10, 1)) == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"eventID":"1"}\n\n{"Records":[{"eventID":"2"},{"eventID":"3"}]}\n[{"eventID":"4"}]\nplain text\n')
    (tmp_path / "b.json").write_text(json.dumps({"Records": [{"eventID": "5"}, {"eventID": "6"}]}, indent=1))
    (tmp_path / "c.json.gz").write_bytes(gzip.compress(b'{"eventID":"7"}\n'))
    got = sorted(r.raw for r in files.read_auto(spark, str(tmp_path)).collect())
    assert [json.loads(x)["eventID"] for x in got if x[0] == "{"] == ["1", "2", "3", "4", "5", "6", "7"] and "plain text" in got
    assert files.read_events(spark, str(tmp_path / "a.jsonl")).where("eventID = '1'").count() == 1


def test_ledgers(spark):
    key = "AWSLogs/o-1/123456789012/CloudTrail/eu-west-1/2024/01/01/123456789012_CloudTrail_eu-west-1_20240101T0000Z_ab.json.gz"
    rows = spark.createDataFrame([("b", key), ("b", "AWSLogs/1/Config/x/y"), ("b", key + ".bak")], "bucket string, key string")
    assert [tuple(r) for r in ledger.account_regions(rows).collect()] == [("123456789012", "eu-west-1")]
    state = spark.createDataFrame([], "bucket string, account string, region string, last_key string, processed_count long")
    todo = ledger.after_last(rows, state)
    state = ledger.advanced(state, todo)
    assert ledger.after_last(rows, state).count() == 0 and state.agg(F.sum("processed_count")).first()[0] == 3
