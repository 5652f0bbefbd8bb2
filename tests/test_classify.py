import json

from pyspark.sql import functions as F

from vigilake.operators.classify import classify, with_headers, with_payload

ACCESS = 'owner bucket [06/Feb/2019:00:00:38 +0000] 192.0.2.3 - REQ1 REST.GET.OBJECT k "GET /a b HTTP/1.1" 403 AccessDenied 113 - 7 - "-" "Console/0.4" - host= SigV4 ECDHE Auth h.s3 TLSV1.2 extra'
ALB = 'https 2018-07-02T22:23:00.186641Z app/lb 192.0.2.9:2817 10.0.0.1:80 0.086 0.048 0.037 502 200 0 57 "GET https://x:443/a b HTTP/1.1" "curl/7" E T arn "Root" "d" "c" 1 2018-07-02T22:22:48.364000Z "a,b" "-" "-"'
FLOW = "2 123456789010 eni-1 172.31.16.139 172.31.16.21 20641 22 6 20 4249 1418530010 1418530070 ACCEPT OK"
HEADER = "version interface-id srcaddr dstaddr start end action"


def lines():
    j = json.dumps
    return {
        "cloudtrail": ("AWS.CloudTrail", j({"eventID": "e1", "eventTime": "2024-01-01T00:00:00Z", "eventName": "X", "unknownKey": 1, "userIdentity": {"type": "Root", "invokedBy": "y"}})),
        "access": ("AWS.S3ServerAccess", ACCESS),
        "access_short": (None, "a b [06/Feb/2019:00:00:38 +0000] c"),
        "alb": ("AWS.ALB", ALB),
        "flow": ("AWS.VPCFlow", FLOW),
        "flow_header": (None, "version account-id interface-id srcaddr dstaddr srcport"),
        "aurora": ("AWS.AuroraMySQLAudit", "1568129270123456,db,u,10.0.0.5,42,99,QUERY,d,'select a, b',0"),
        "aurora_bad": (None, "x,db,u,h,42,99,QUERY,d,o,0"),
        "bedrock": ("AWS.BedrockModelInvocation", j({"schemaType": "ModelInvocationLog", "requestId": "r", "operation": "Converse", "timestamp": "2025-05-15T14:17:22.123456789", "identity": {"arn": "arn:aws:sts::111:x"}})),
        "okta": ("Okta.SystemLog", j({"uuid": "u", "published": "2024-01-01T00:00:00.5Z", "eventType": "t", "client": {"ipAddress": "1.1.1.1"}, "request": {"ipChain": [{"ip": "9.9.9.9"}]}})),
        "okta_bad_time": (None, j({"uuid": "u", "published": "yesterday"})),
        "gsuite": ("GSuite.Reports", j({"kind": "admin#reports#activity", "id": {"time": "2024-01-01T00:00:00Z", "customerId": "C", "uniqueQualifier": "7"}, "events": [{"name": "n"}]})),
        "onepassword": ("OnePassword.SignInAttempt", j({"uuid": "x", "timestamp": "2024-01-01 01:02:03"})),
        "github_audit": ("GitHub.Audit", j({"action": "repo.create", "created_at": 1710000000000, "actor": "a"})),
        "github_webhook": ("GitHub.Webhook", j({"action": "opened", "created_at": 5, "repository": {"full_name": "o/r"}, "pull_request": {"id": 1, "created_at": "2025-01-01T00:00:00Z"}})),
        "gcp": ("GCP.AuditLog", j({"protopayload": {"methodname": "m"}, "timestamp": "2023-05-23T19:19:40.353Z", "insertid": "i"})),
        "gcp_lb": ("GCP.HTTPLoadBalancer", j({"httpRequest": {"remoteIp": "1.2.3.4"}, "resource": {"type": "http_load_balancer"}, "logName": "cloudaudit.googleapis.com"})),
        "eks": ("Amazon.EKS.Audit", j({"kind": "Event", "apiVersion": "audit.k8s.io/v1", "verb": "create", "objectRef": {"resource": "pods", "subresource": "exec"}, "sourceIPs": ["", "1.1.1.1"]})),
        "eks_bad": (None, j({"kind": "Event", "apiVersion": "evilaudit.k8s.io/v1"})),
        "slack": ("Slack.AuditLogs", j({"action": "a", "actor": {"user": {"email": "e@x"}}, "date_create": "2021-06-08 22:16:15"})),
        "cf_firewall": ("Cloudflare.Firewall", j({"Kind": "Firewall", "Action": "Block", "Source": "WAF", "EdgeStartTimestamp": "2025-01-01T00:00:00Z"})),
        "cf_http": ("Cloudflare.HttpRequest", j({"BotScore": 1, "ClientRequestMethod": "GET", "ClientRequestHost": "h"})),
        "hinted": ("GitHub.Audit", j({"p_log_type": "GitHub.Audit", "action": "x"})),
        "nothing": (None, j({"a": 1})),
        "blank": (None, "  "),
    }


def test_every_format_and_its_neighbours(spark):
    given = lines()
    df = spark.createDataFrame([(k, v[1]) for k, v in given.items()], "name string, raw string")
    events = classify(df)
    rows = {r.name: r for r in with_payload(events, "intended").select("name", "log_type", "eventID", "eventName", "eventTime", "sourceIPAddress", "userIdentity.principalId", F.to_json("payload").alias("payload")).collect()}
    assert {k: (rows[k].log_type if k in rows else None) for k in given} == {k: v[0] for k, v in given.items()}
    assert rows["access"].eventID == "s3-REQ1-20190206000038" and json.loads(rows["access"].payload)["httpStatus"] == 403
    assert rows["alb"].eventName == "ALB-GET" and json.loads(rows["alb"].payload)["requestUrl"] == "https://x:443/a b"
    assert rows["flow"].eventID == "vpcflow-eni-1-20141214040750" and json.loads(rows["flow"].payload)["dstPort"] == 22
    assert json.loads(rows["aurora"].payload)["object"] == "'select a, b'" and str(rows["aurora"].eventTime).endswith(".123456")
    assert rows["okta"].sourceIPAddress == "9.9.9.9" and rows["eks"].eventName == "create.pods.exec" and rows["eks"].sourceIPAddress == "1.1.1.1"
    assert rows["gcp"].eventName == "m" and rows["gcp"].eventID == "i" and rows["gsuite"].eventID == "gsuite-C-20240101000000-7"
    assert rows["cf_firewall"].eventName == "block.waf" and rows["cf_http"].eventName == "get.h" and rows["github_webhook"].eventID == "pr-1"
    assert json.loads(rows["cloudtrail"].payload)["unknownKey"] == 1
    plain = with_payload(events.where("name = 'cloudtrail'")).select(F.to_json("payload").alias("p")).first().p
    assert "unknownKey" not in plain and "invokedBy" not in plain


def test_flow_headers_belong_to_their_file(spark):
    df = spark.createDataFrame([("f", HEADER), ("f", "2 eni-9 1.1.1.1 2.2.2.2 1418530010 1418530070 REJECT"), ("g", FLOW)], "file string, raw string")
    found = {r.file: r for r in classify(with_headers(df, "file"), header="header").select("file", "eventID", F.to_json("requestParameters").alias("p")).collect()}
    assert found["f"].eventID == "vpcflow-eni-9-20141214040750" and json.loads(found["f"].p)["action"] == "REJECT"
    assert json.loads(found["g"].p)["dstPort"] == 22
