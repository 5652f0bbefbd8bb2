import json

from pyspark.sql import functions as F

from vigilake.operators.detect import RuleSet, analyze, with_reference
from vigilake.rules.model import Event
from vigilake.rules.registry import PACKS, log_types


def found(spark, log_type, payloads, packs=None, mode="intended", **kw):
    rows = [(f"{i:03}", json.dumps(p), log_type) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "eventID string, p string, log_type string").select("eventID", F.parse_json("p").alias("payload"), "log_type")
    out = analyze(df, RuleSet(mode, packs), only=(log_type,), keep=("eventID",), **kw)
    return out, {(int(r.eventID), r.rule_id): r for r in out.matches.collect()}


def test_console_logins_and_titles(spark):
    root = {"eventName": "ConsoleLogin", "userIdentity": {"type": "Root", "accountId": "42"}, "responseElements": {"ConsoleLogin": "Success"}, "sourceIPAddress": "1.2.3.4"}
    failed = {"eventName": "ConsoleLogin", "responseElements": {"ConsoleLogin": "Failure"}}
    out, hits = found(spark, "AWS.CloudTrail", [root, failed, {"eventName": "StopLogging", "errorCode": "X"}], ["aws_cloudtrail"])
    assert set(hits) == {(0, "aws_console_root_login"), (0, "aws_console_login_without_mfa"), (1, "aws_console_login_failed")}
    assert hits[0, "aws_console_root_login"].title == "AWS root login detected from 1.2.3.4 in account [42]" and hits[0, "aws_console_root_login"].severity == "CRITICAL"
    assert hits[1, "aws_console_login_failed"].dedup == "aws_console_login_failed"
    counts = {r.rule_id: (r.match, r.no_match) for r in out.evaluations.collect()}
    assert counts["aws_console_root_login"] == (1, 2) and len(counts) == 47
    assert with_reference(out.matches).select("detection_ref").first()[0].count(":") == 1


def test_predicates_on_missing_null_and_odd_values(spark):
    rows = ["{}", '{"a":null}', '{"a":""}', '{"a":"0"}', '{"a":0}', '{"a":false}', '{"a":true}', '{"a":[]}', '{"a":[0]}', '{"a":{}}', '{"a":{"b":1}}', '{"a":1.5}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p string").select("i", F.parse_json("p").alias("p")).orderBy("i")
    e = Event(F.col("p"))
    got = df.select(e.truthy("a").alias("t"), e.is_true("a").alias("y"), e.has("a").alias("h"), e.eq("a", "0").alias("z")).collect()
    assert [r.t for r in got] == [False, False, False, True, False, False, True, False, True, False, True, True]
    assert [i for i, r in enumerate(got) if r.y] == [6] and [i for i, r in enumerate(got) if not r.h] == [0, 1] and [i for i, r in enumerate(got) if r.z] == [3, 4]
    walked = df.select(Event(F.parse_json(F.lit('{"x":[{"y":[{"z":"b"},{"z":"a"}]},{"y":[{"z":"b"}]},{}]}'))).walk("x", "y", "z")).first()[0]
    assert walked == ["b", "a"]


def test_unpopular_kubernetes_cases(spark):
    base = {"kind": "Event", "apiVersion": "audit.k8s.io/v1", "user": {"username": "jo"}, "responseStatus": {"code": 200}}
    cp = base | {"verb": "get", "objectRef": {"resource": "pods", "subresource": "exec", "namespace": "n", "name": "p"}, "requestURI": "/x?command=tar&command=cf&command=-&command=%2Fetc%2Fshadow"}
    system = base | {"verb": "create", "objectRef": {"resource": "pods"}, "user": {"username": "system:node:x"}, "requestObject": {"spec": {"hostPID": True}}}
    loose = base | {"verb": "create", "objectRef": {"resource": "pods", "namespace": "kube-system", "name": "q"}, "requestObject": {"spec": {"hostPID": True, "containers": [{"securityContext": {"capabilities": {"add": ["BPF", "X"]}}}], "volumes": [{"hostPath": {"path": "/etc/kubernetes/x"}}]}}}
    gke = {"protoPayload": {"serviceName": "k8s.io", "methodName": "io.k8s.core.v1.pods.create", "resourceName": "core/v1/namespaces/n/pods/p", "authenticationInfo": {"principalEmail": "a@b"}, "request": {"spec": {"hostIPC": True}}}}
    _, hits = found(spark, "Amazon.EKS.Audit", [cp, system, loose], ["kubernetes"])
    assert hits[0, "k8s_kubectl_cp_operation"].severity == "HIGH" and hits[0, "k8s_kubectl_cp_operation"].title.endswith("path [/etc/shadow] via kubectl cp")
    assert {r for i, r in hits if i == 1} == {"k8s_pod_host_pid"}
    assert {r for i, r in hits if i == 2} == {"k8s_pod_host_pid", "k8s_pod_hostpath_volume", "k8s_pod_created_in_system_namespace"}
    assert hits[2, "k8s_pod_hostpath_volume"].severity == "HIGH"
    _, hits = found(spark, "GCP.AuditLog", [gke], ["kubernetes"])
    assert {r for _, r in hits} == {"k8s_pod_host_ipc"}


def test_rules_with_state(spark):
    reset = [{"action": "user_session_invalidated", "date_create": f"2024-01-01 00:{i:02}:00", "entity": {"user": {"name": "u"}}} for i in range(60)]
    _, hits = found(spark, "Slack.AuditLogs", reset, ["slack_audit"])
    assert [i for i, r in hits if r == "slack_application_dos"] == [59]
    _, hits = found(spark, "Slack.AuditLogs", reset[:3], ["slack_audit"], stateful=False)
    assert len(hits) == 3
    clones = [{"action": "git.clone", "actor": "a", "repo": "r"}, {"action": "git.clone", "actor": "a", "repo": "r"}, {"action": "git.push", "actor": "b", "repo": "r"}]
    _, hits = found(spark, "GitHub.Audit", clones, ["github_audit"])
    assert sorted(i for i, _ in hits) == [0, 2]


def test_modes_differ_where_they_should(spark):
    assert log_types("aws_s3") == ("AWS.CloudTrail",) and log_types("aws_s3", "intended") == ("AWS.S3ServerAccess",)
    access = {"operation": "REST.GET.OBJECT", "httpStatus": 403, "bucket": "b", "cipherSuite": "x", "tlsVersion": "y"}
    _, hits = found(spark, "AWS.S3ServerAccess", [access], ["aws_s3"])
    assert set(hits) == {(0, "aws_s3_access_error")}
    _, hits = found(spark, "AWS.CloudTrail", [access], ["aws_s3"], mode="reference")
    assert not hits
    assert len(PACKS) == 17
