"""Seventeen log formats: what a raw record of each looks like, and its normalized fields.

Each parser is a pair of column expressions over a record: ``accept`` decides
by shape, ``fields`` projects the envelope. JSON is parsed once, to VARIANT;
space- and comma-separated text is split by a quote-aware pattern.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.functions.paths import at
from vigilake.functions.text import any_timestamp, blank_to_null, looks_like_csv, plain_timestamp, rfc3339, stamp, to_double, to_int, to_list
from vigilake.schema import IDENTITY, RESOURCES

# The columns of a flow record and the names they get.
VPC_COLUMNS = {
    "version": "version", "account-id": "accountId", "interface-id": "interfaceId", "srcaddr": "srcAddr", "dstaddr": "dstAddr", "srcport": "srcPort",
    "dstport": "dstPort", "protocol": "protocol", "packets": "packets", "bytes": "bytes", "start": "start", "end": "end", "action": "action",
    "log-status": "logStatus", "vpc-id": "vpcId", "subnet-id": "subnetId", "instance-id": "instanceId", "tcp-flags": "tcpFlags", "type": "type",
    "pkt-srcaddr": "pktSrcAddr", "pkt-dstaddr": "pktDstAddr",
}
VPC_NUMBERS = {"version", "srcport", "dstport", "protocol", "packets", "bytes", "tcp-flags"}
#: The header in force where a file has none.
VPC_DEFAULT_HEADER = "version account-id interface-id srcaddr dstaddr srcport dstport protocol packets bytes start end action log-status"
VPC_HEADER_MATCHES = 5
ACCESS_COLUMNS = 25
AURORA_COLUMNS = 9


@dataclass(frozen=True)
class Record:
    """A raw record: its text, its JSON if it is any, else its fields by space and by comma, and the flow-log header in force (None: the default)."""

    raw: Column
    json: Column
    header: Column | None
    spaced: Column
    commaed: Column

    def text(self, path: str) -> Column:
        """The value at a path if it is a JSON string."""
        return F.when(self.kind(path) == "STRING", at(self.json, path))

    def kind(self, path: str) -> Column:
        return F.schema_of_variant(at(self.json, path, "variant"))

    def is_object(self, path: str) -> Column:
        return F.coalesce(F.startswith(self.kind(path), F.lit("OBJECT")), F.lit(False))

    def is_number(self, path: str) -> Column:
        return F.coalesce(self.kind(path).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), F.lit(False))

    def number(self, path: str) -> Column:
        return F.when(self.is_number(path), at(self.json, path, "double"))

    def some(self, path: str) -> Column:
        """A non-empty string."""
        t = self.text(path)
        return F.when(t != "", t)

    def has(self, path: str) -> Column:
        return at(self.json, path, "variant").isNotNull()


@dataclass(frozen=True)
class Parser:
    log_type: str
    accept: Callable[[Record], Column]
    fields: Callable[[Record], dict[str, Column]]
    json: bool = True
    #: Log types whose records are turned down, as they are more specific.
    tests: tuple = field(default=())


def fields_of(line: Column, separator: str) -> Column:
    """Fields of a line; a field in double quotes may hold separators, and loses its quotes."""
    parts = F.regexp_extract_all(line, F.lit(f'(?:^|{separator})("[^"]*"|[^{separator}]*)'), F.lit(1))
    return F.transform(parts, lambda x: F.regexp_replace(x, '^"|"$', ""))


def identity(kind: str, principal: Column, **more: Column) -> Column:
    """A user identity, null where there is no principal."""
    names = ("type", "principalId", "arn", "accountId", "accessKeyId", "userName")
    given = {"type": F.lit(kind), "principalId": principal} | more
    null = F.lit(None).cast("string")
    session = F.lit(None).cast(IDENTITY.split("sessionContext:", 1)[1][:-1])
    return F.when(principal.isNotNull() & (principal != ""), F.struct(*(given.get(n, null).alias(n) for n in names), session.alias("sessionContext")))


def _payload(**columns: Column) -> Column:
    return F.to_variant_object(F.struct(*(c.alias(n) for n, c in columns.items())))


def _epoch() -> Column:
    return F.timestamp_seconds(F.lit(0))


def _seconds(x: Column) -> Column:
    """Timestamp of epoch seconds with a fraction."""
    return F.timestamp_micros((x * 1_000_000).cast("bigint"))


def _or(*columns: Column) -> Column:
    return F.coalesce(*columns)


# ---- CloudTrail ----


def _cloudtrail_accept(r: Record) -> Column:
    return F.coalesce(r.some("eventID").isNotNull(), F.lit(False))


def _cloudtrail(r: Record) -> dict[str, Column]:
    names = ("eventVersion", "eventSource", "eventName", "awsRegion", "sourceIPAddress", "userAgent", "errorCode", "errorMessage", "requestID", "eventID", "eventType", "recipientAccountId")
    who = F.from_json(F.to_json(at(r.json, "userIdentity", "variant")), IDENTITY)
    return {n: _or(r.text(n), F.lit("")) for n in names} | {
        "eventTime": rfc3339(r.text("eventTime")),
        "userIdentity": who,
        "requestParameters": at(r.json, "requestParameters", "variant"),
        "responseElements": at(r.json, "responseElements", "variant"),
        "resources": F.from_json(F.to_json(at(r.json, "resources", "variant")), RESOURCES),
    }


# ---- space- and comma-separated text ----


def _access_cells(r: Record) -> Column:
    return r.spaced


def _s3_time(cells: Column) -> Column:
    text = F.regexp_extract(F.concat(F.get(cells, F.lit(2)), F.get(cells, F.lit(3))), r"^\[(\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}[+-]\d{4})\]$", 1)
    return F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("d/MMM/yyyy:HH:mm:ssZ"))


def _s3_accept(r: Record) -> Column:
    cells = _access_cells(r)
    return looks_like_csv(r.raw) & (F.size(cells) >= ACCESS_COLUMNS) & _s3_time(cells).isNotNull()


def _s3(r: Record) -> dict[str, Column]:
    cells = _access_cells(r)
    cell = lambda i: F.get(cells, F.lit(i))
    at_ = _s3_time(cells)
    text = {"bucketOwner": 0, "bucket": 1, "remoteIP": 4, "requester": 5, "requestID": 6, "operation": 7, "key": 8, "requestURI": 9, "errorCode": 11, "referrer": 16, "userAgent": 17, "versionID": 18, "hostID": 19, "signatureVersion": 20, "cipherSuite": 21, "authenticationType": 22, "hostHeader": 23, "tlsVersion": 24}
    number = {"httpStatus": 10, "bytesSent": 12, "objectSize": 13, "totalTime": 14, "turnAroundTime": 15}
    columns = {n: blank_to_null(cell(i)) for n, i in text.items()} | {n: to_int(cell(i)) for n, i in number.items()}
    columns |= {"time": at_, "additionalFields": F.when(F.size(cells) > ACCESS_COLUMNS, F.slice(cells, F.lit(ACCESS_COLUMNS + 1), F.greatest(F.size(cells) - ACCESS_COLUMNS, F.lit(0))))}
    ident = F.concat_ws("-", F.lit("s3"), columns["requestID"], stamp(at_))
    return {
        "eventTime": at_, "eventID": ident, "requestID": ident, "eventSource": F.lit("s3.amazonaws.com"), "eventName": _or(columns["operation"], F.lit("S3ServerAccess")),
        "eventType": F.lit("AwsApiCall"), "sourceIPAddress": columns["remoteIP"], "userAgent": columns["userAgent"], "requestParameters": _payload(**columns),
    }


def is_vpc_header(raw: Column) -> Column:
    known = F.array(*map(F.lit, VPC_COLUMNS))
    return F.size(F.filter(F.split(raw, " "), lambda x: F.array_contains(known, F.trim(x)))) >= VPC_HEADER_MATCHES


def _vpc_cell(r: Record, name: str) -> Column:
    if r.header is None:
        names = VPC_DEFAULT_HEADER.split(" ")
        return blank_to_null(F.get(r.spaced, F.lit(names.index(name)))) if name in names else F.lit(None).cast("string")
    place = F.array_position(F.transform(F.split(r.header, " "), F.trim), name)
    return F.when(place > 0, blank_to_null(F.get(r.spaced, place.cast("int") - 1)))


def _vpc_accept(r: Record) -> Column:
    width = F.lit(len(VPC_DEFAULT_HEADER.split(" "))) if r.header is None else F.size(F.split(r.header, " "))
    return looks_like_csv(r.raw) & (F.size(r.spaced) == width) & _vpc_cell(r, "start").rlike(r"^\d{1,12}$") & ~is_vpc_header(r.raw)


def _vpc(r: Record) -> dict[str, Column]:
    columns = {}
    for name, ours in VPC_COLUMNS.items():
        c = _vpc_cell(r, name)
        columns[ours] = to_int(c) if name in VPC_NUMBERS else F.timestamp_seconds(F.when(c.rlike(r"^\d{1,12}$"), c).try_cast("bigint")) if name in ("start", "end") else c
    when = _or(columns["end"], columns["start"])
    ident = F.concat_ws("-", F.lit("vpcflow"), columns["interfaceId"], stamp(when))
    return {
        "eventTime": when, "eventID": ident, "requestID": ident, "eventSource": F.lit("vpcflowlogs.amazonaws.com"), "eventName": F.lit("VPCFlow"), "eventType": F.lit("AwsApiCall"),
        "sourceIPAddress": columns["srcAddr"], "requestParameters": _payload(**columns),
    }


def _alb_accept(r: Record) -> Column:
    cells = _access_cells(r)
    return looks_like_csv(r.raw) & (F.size(cells) >= ACCESS_COLUMNS) & rfc3339(F.get(cells, F.lit(1))).isNotNull()


def _alb(r: Record) -> dict[str, Column]:
    cells = _access_cells(r)
    cell = lambda i: F.get(cells, F.lit(i))
    at_ = rfc3339(cell(1))

    def address(i: int) -> tuple[Column, Column]:
        parts = F.split(cell(i), ":")
        two = F.size(parts) == 2
        return F.when(two, F.get(parts, F.lit(0))).otherwise(cell(i)), F.when(two, F.get(parts, F.lit(1)))

    words = F.split(cell(12), " ")
    n = F.size(words)
    full = n >= 3
    method = F.when(full, F.get(words, F.lit(0)))
    url = F.when(full, F.array_join(F.slice(words, F.lit(2), F.greatest(n - 2, F.lit(0))), " "))
    version = F.when(full, F.element_at(words, -1))
    (client, client_port), (target, target_port) = address(3), address(4)
    text = {"type": 0, "elb": 2, "userAgent": 13, "sslCipher": 14, "sslProtocol": 15, "targetGroupArn": 16, "traceId": 17, "domainName": 18, "chosenCertArn": 19, "redirectUrl": 23, "errorReason": 24}
    columns = {k: blank_to_null(cell(i)) for k, i in text.items()}
    columns |= {k: to_int(cell(i)) for k, i in {"elbStatusCode": 8, "targetStatusCode": 9, "receivedBytes": 10, "sentBytes": 11, "matchedRulePriority": 20}.items()}
    columns |= {k: to_double(cell(i)) for k, i in {"requestProcessingTime": 5, "targetProcessingTime": 6, "responseProcessingTime": 7}.items()}
    columns |= {"timestamp": at_, "clientIP": blank_to_null(client), "clientPort": to_int(client_port), "targetIP": blank_to_null(target), "targetPort": to_int(target_port)}
    columns |= {"requestHttpMethod": blank_to_null(method), "requestUrl": blank_to_null(url), "requestHttpVersion": blank_to_null(version)}
    columns |= {"requestCreationTime": _or(rfc3339(cell(21)), at_), "actionsExecuted": to_list(cell(22))}
    ident = F.concat_ws("-", F.lit("alb"), columns["elb"], stamp(at_))
    name = F.when(columns["requestHttpMethod"].isNotNull(), F.concat(F.lit("ALB-"), columns["requestHttpMethod"])).otherwise("ALBAccess")
    return {
        "eventTime": at_, "eventID": ident, "requestID": ident, "eventSource": F.lit("elasticloadbalancing.amazonaws.com"), "eventName": name, "eventType": F.lit("AwsApiCall"),
        "sourceIPAddress": columns["clientIP"], "requestParameters": _payload(**columns),
    }


def _aurora_accept(r: Record) -> Column:
    cells = r.commaed
    return (F.size(cells) >= AURORA_COLUMNS) & F.coalesce(F.get(cells, F.lit(0)).rlike(r"^[+-]?\d{1,18}$"), F.lit(False))


def _aurora(r: Record) -> dict[str, Column]:
    cells = r.commaed
    cell = lambda i: F.get(cells, F.lit(i))
    at_ = F.timestamp_micros(F.when(cell(0).rlike(r"^[+-]?\d{1,18}$"), cell(0)).try_cast("bigint"))
    columns = {k: blank_to_null(cell(i)) for k, i in {"serverHost": 1, "username": 2, "host": 3, "operation": 6, "database": 7}.items()}
    columns |= {k: to_int(cell(i)) for k, i in {"connectionId": 4, "queryId": 5}.items()}
    columns |= {"timestamp": at_, "object": blank_to_null(F.array_join(F.slice(cells, F.lit(9), F.greatest(F.size(cells) - 9, F.lit(0))), ",")), "retCode": to_int(F.try_element_at(cells, F.lit(-1)))}
    ident = F.concat_ws("-", F.lit("aurora"), columns["connectionId"].cast("string"), stamp(at_))
    name = F.when(columns["operation"].isNotNull(), F.concat(F.lit("AuroraMySQL-"), columns["operation"])).otherwise("AuroraMySQLAudit")
    return {
        "eventTime": at_, "eventID": ident, "requestID": ident, "eventSource": F.lit("rds.amazonaws.com"), "eventName": name, "eventType": F.lit("AwsApiCall"),
        "sourceIPAddress": columns["host"], "requestParameters": _payload(**columns),
    }


# ---- JSON ----


def _bedrock_time(r: Record) -> Column:
    return _or(any_timestamp(r.text("timestamp")), _seconds(r.number("timestamp")))


def _bedrock_accept(r: Record) -> Column:
    return (r.text("schemaType") == "ModelInvocationLog") & r.some("requestId").isNotNull() & r.some("operation").isNotNull() & _bedrock_time(r).isNotNull()


def _bedrock(r: Record) -> dict[str, Column]:
    arn = r.some("identity.arn")
    account = _or(F.get(F.split(arn, ":"), F.lit(4)), r.text("accountId"))
    return {
        "eventTime": _bedrock_time(r), "eventID": r.text("requestId"), "requestID": r.text("requestId"), "eventSource": F.lit("aws.bedrock.modelinvocation"), "eventName": r.text("operation"),
        "eventType": F.lit("AWS.BedrockModelInvocation"), "awsRegion": r.text("region"), "recipientAccountId": r.text("accountId"),
        "userIdentity": identity("BedrockCaller", arn, arn=arn, accountId=account), "requestParameters": r.json,
    }


def _okta_accept(r: Record) -> Column:
    return r.text("uuid").isNotNull() & rfc3339(r.text("published")).isNotNull()


def _okta(r: Record) -> dict[str, Column]:
    ip = _or(r.text("request.ipChain.0.ip"), r.text("client.ipAddress"))
    return {
        "eventTime": rfc3339(r.text("published")), "eventID": r.text("uuid"), "requestID": r.text("uuid"), "eventSource": F.lit("okta.com"), "eventName": _or(r.text("eventType"), F.lit("OktaEvent")),
        "eventType": F.lit("OktaSystemLog"), "sourceIPAddress": ip, "userAgent": r.text("client.userAgent.rawUserAgent"), "requestParameters": r.json,
    }


def _gsuite_accept(r: Record) -> Column:
    return (r.text("kind") == "admin#reports#activity") & rfc3339(r.text("id.time")).isNotNull()


def _gsuite(r: Record) -> dict[str, Column]:
    at_ = rfc3339(r.text("id.time"))
    ident = F.concat_ws("-", F.lit("gsuite"), r.text("id.customerId"), stamp(at_), _or(r.text("id.uniqueQualifier"), F.lit("")))
    return {
        "eventTime": at_, "eventID": ident, "requestID": ident, "eventSource": F.lit("googleapis.com"), "eventName": _or(r.text("events.0.name"), F.lit("GSuiteActivity")),
        "eventType": F.lit("GSuiteActivity"), "sourceIPAddress": r.text("ipAddress"), "requestParameters": r.json,
    }


def _onepassword_accept(r: Record) -> Column:
    return r.some("uuid").isNotNull() & plain_timestamp(r.text("timestamp")).isNotNull()


def _onepassword(r: Record) -> dict[str, Column]:
    return {
        "eventTime": plain_timestamp(r.text("timestamp")), "eventID": r.text("uuid"), "requestID": r.text("uuid"), "eventSource": F.lit("1password.com"),
        "eventName": _or(r.text("type"), F.lit("SignInAttempt")), "eventType": F.lit("OnePasswordSignIn"), "sourceIPAddress": r.text("client.ip_address"), "requestParameters": r.json,
    }


def _github_audit_time(r: Record) -> Column:
    n = r.number("created_at").cast("bigint")
    by_number = F.when(n > 1_000_000_000_000, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(F.when(n <= 1_000_000_000_000, n)))
    hinted = (r.text("p_log_type") == "GitHub.Audit") & F.coalesce(r.kind("created_at") == "VOID", F.lit(True))
    return _or(by_number, rfc3339(r.text("created_at")), F.when(hinted, _epoch()))


def _github_audit_accept(r: Record) -> Column:
    shape = r.text("action").isNotNull() & ~r.is_object("repository") & (r.number("created_at") > 0)
    return (F.coalesce(r.text("p_log_type") == "GitHub.Audit", F.lit(False)) | F.coalesce(shape, F.lit(False))) & r.some("action").isNotNull() & _github_audit_time(r).isNotNull()


def _github_audit(r: Record) -> dict[str, Column]:
    when = F.when(r.is_number("created_at"), r.number("created_at").cast("bigint").cast("string")).otherwise(_or(r.text("created_at"), F.lit("0")))
    ident = _or(r.some("id"), r.number("id").cast("bigint").cast("string"), F.concat(_or(r.text("actor"), F.lit("")), F.lit("-"), r.text("action"), F.lit("-"), when))
    actor = r.some("actor")
    return {
        "eventTime": _github_audit_time(r), "eventID": ident, "requestID": ident, "eventSource": F.lit("github.com"), "eventName": r.text("action"), "eventType": F.lit("GitHub.Audit"),
        "userIdentity": identity("GitHubUser", actor, userName=actor), "requestParameters": r.json,
    }


def _github_webhook_accept(r: Record) -> Column:
    shape = r.is_object("sender") | r.is_object("pusher") | r.is_object("workflow_run") | r.is_object("pull_request")
    hinted = F.coalesce(r.text("p_log_type") == "GitHub.Webhook", F.lit(False))
    return r.is_object("repository") & (hinted | shape) & r.some("action").isNotNull()


def _github_webhook(r: Record) -> dict[str, Column]:
    times = [rfc3339(r.text(f"{x}.{y}")) for x in ("workflow_run", "pull_request") for y in ("updated_at", "created_at")]
    number = lambda path: r.number(path).cast("bigint").cast("string")
    ident = _or(
        F.concat(F.lit("wr-"), number("workflow_run.id")),
        F.concat(F.lit("pr-"), number("pull_request.id")),
        F.concat(r.text("action"), F.lit("-"), _or(r.text("repository.full_name"), F.lit(""))),
    )
    login = r.some("sender.login")
    return {
        "eventTime": _or(*times, F.current_timestamp()), "eventID": ident, "requestID": ident, "eventSource": F.lit("github.com.webhook"), "eventName": r.text("action"),
        "eventType": F.lit("GitHub.Webhook"), "userIdentity": identity("GitHubUser", login, userName=login), "requestParameters": r.json,
    }


def _gcp_text(r: Record, *paths: str) -> Column:
    """The first non-empty string among the paths and their lower-case forms."""
    return _or(*(r.some(p) for path in paths for p in dict.fromkeys((path, path.lower()))))


def _gcp_proto(r: Record, name: str) -> Column:
    return _gcp_text(r, f"protoPayload.{name}", f"protopayload.{name}")


def _gcp_time(r: Record) -> Column:
    return _or(any_timestamp(r.text("timestamp")), _seconds(r.number("timestamp")), _epoch())


def _gcp_lb_accept(r: Record) -> Column:
    hinted = F.coalesce(r.text("p_log_type") == "GCP.HTTPLoadBalancer", F.lit(False))
    named = F.coalesce(F.lower(_gcp_text(r, "logName")).contains("/logs/requests"), F.lit(False))
    return hinted | (r.is_object("httpRequest") & (F.coalesce(r.text("resource.type") == "http_load_balancer", F.lit(False)) | named))


def _gcp_lb(r: Record) -> dict[str, Column]:
    ident = _or(_gcp_text(r, "insertId"), r.some("httpRequest.requestUrl"), F.lit("gcp-http-lb"))
    ip = r.some("httpRequest.remoteIp")
    return {
        "eventTime": _gcp_time(r), "eventID": ident, "requestID": ident, "eventSource": F.lit("loadbalancing.googleapis.com"), "eventName": F.lit("httpRequest"),
        "eventType": F.lit("GCP.HTTPLoadBalancer"), "sourceIPAddress": ip, "recipientAccountId": r.text("resource.labels.project_id"), "userIdentity": identity("IPAddress", ip), "requestParameters": r.json,
    }


def _gcp_method(r: Record) -> Column:
    return _or(_gcp_proto(r, "methodName"), r.some("methodName"))


def _gcp_accept(r: Record) -> Column:
    hinted = F.coalesce(r.text("p_log_type") == "GCP.AuditLog", F.lit(False))
    named = F.coalesce(_gcp_text(r, "logName").contains("cloudaudit.googleapis.com"), F.lit(False))
    calls = _gcp_proto(r, "methodName").isNotNull() | _gcp_proto(r, "serviceName").isNotNull() | r.text("methodName").isNotNull()
    return (hinted | (~_gcp_lb_accept(r) & (named | calls))) & _or(_gcp_method(r), _gcp_proto(r, "serviceName")).isNotNull()


def _gcp(r: Record) -> dict[str, Column]:
    when = _or(r.text("timestamp"), r.number("timestamp").cast("bigint").cast("string"), F.lit(""))
    ident = _or(_gcp_text(r, "insertId"), F.concat(_or(_gcp_method(r), F.lit("audit")), F.lit("-"), when))
    who = _or(*(r.some(f"{p}.{a}.{e}") for p in ("protoPayload", "protopayload") for a in ("authenticationInfo", "authenticationinfo") for e in ("principalEmail", "principalemail")))
    return {
        "eventTime": _gcp_time(r), "eventID": ident, "requestID": ident, "eventSource": F.lit("cloudaudit.googleapis.com"), "eventName": _or(_gcp_method(r), _gcp_proto(r, "serviceName")),
        "eventType": F.lit("GCP.AuditLog"), "recipientAccountId": r.text("resource.labels.project_id"), "userIdentity": identity("GCPUser", who, userName=who), "requestParameters": r.json,
    }


def _eks_accept(r: Record) -> Column:
    hinted = F.coalesce(r.text("p_log_type") == "Amazon.EKS.Audit", F.lit(False))
    return hinted | F.coalesce((r.text("kind") == "Event") & r.text("apiVersion").startswith("audit.k8s.io/"), F.lit(False))


def _eks(r: Record) -> dict[str, Column]:
    verb = _or(r.text("verb"), F.lit(""))
    resource = r.some("objectRef.resource")
    name = F.when(resource.isNotNull(), F.concat_ws(".", verb, resource, r.some("objectRef.subresource"))).otherwise(verb)
    ident = _or(r.some("auditID"), F.concat(verb, F.lit("-"), _or(r.text("requestReceivedTimestamp"), F.lit("0"))))
    ips = F.filter(at(r.json, "sourceIPs", "array<variant>"), lambda x: (F.schema_of_variant(x) == "STRING") & (F.try_variant_get(x, "$", "string") != ""))
    user = r.some("user.username")
    return {
        "eventTime": _or(rfc3339(r.text("requestReceivedTimestamp")), rfc3339(r.text("stageTimestamp")), _epoch()), "eventID": ident, "requestID": ident, "eventSource": F.lit("eks.amazonaws.com"),
        "eventName": F.when(name == "", "audit").otherwise(name), "eventType": F.lit("Amazon.EKS.Audit"), "userAgent": r.text("userAgent"), "sourceIPAddress": F.try_variant_get(F.get(ips, F.lit(0)), "$", "string"),
        "userIdentity": identity("K8sUser", user, userName=user), "requestParameters": r.json,
    }


def _slack_accept(r: Record) -> Column:
    hinted = F.coalesce(r.text("p_log_type").contains("Slack.Audit"), F.lit(False))
    return (hinted | (r.is_object("actor") & r.text("date_create").isNotNull())) & r.some("action").isNotNull()


def _slack(r: Record) -> dict[str, Column]:
    ident = _or(r.some("p_row_id"), F.concat(r.text("action"), F.lit("-"), _or(r.text("date_create"), F.lit(""))))
    email = r.some("actor.user.email")
    t = r.text("date_create")
    return {
        "eventTime": _or(plain_timestamp(t), rfc3339(F.trim(t)), _epoch()), "eventID": ident, "requestID": ident, "eventSource": F.lit("slack.com"), "eventName": r.text("action"),
        "eventType": F.lit("Slack.AuditLogs"), "userIdentity": identity("SlackUser", email, userName=email), "requestParameters": r.json,
    }


def _is_firewall(r: Record) -> Column:
    return F.coalesce(F.lower(r.text("Kind")) == "firewall", F.lit(False))


def _cf_firewall_accept(r: Record) -> Column:
    return F.coalesce(r.text("p_log_type") == "Cloudflare.Firewall", F.lit(False)) | _is_firewall(r)


def _cf_time(*texts: Column) -> Column:
    return _or(*(_or(plain_timestamp(t), rfc3339(F.trim(t))) for t in texts), _epoch())


def _cf_firewall(r: Record) -> dict[str, Column]:
    action, ip = r.some("Action"), r.some("ClientIP")
    ident = _or(r.some("RayID"), F.lit("cf-fw"))
    name = F.when(action.isNotNull(), F.concat(F.lower(action), F.lit("."), F.lower(_or(r.text("Source"), F.lit(""))))).otherwise("firewall")
    return {
        "eventTime": _cf_time(r.text("Datetime")), "eventID": ident, "requestID": ident, "eventSource": F.lit("cloudflare.com.firewall"), "eventName": name, "eventType": F.lit("Cloudflare.Firewall"),
        "sourceIPAddress": ip, "userIdentity": identity("IPAddress", ip), "requestParameters": r.json,
    }


def _cf_http_accept(r: Record) -> Column:
    hinted = F.coalesce(r.text("p_log_type") == "Cloudflare.HttpRequest", F.lit(False))
    return ~_cf_firewall_accept(r) & (hinted | r.has("EdgeStartTimestamp") | r.has("BotScore"))


def _cf_http(r: Record) -> dict[str, Column]:
    method, host, ip = r.some("ClientRequestMethod"), r.some("ClientRequestHost"), r.some("ClientIP")
    ident = _or(r.some("RayID"), F.lit("cf-http"))
    name = F.when(method.isNotNull() & host.isNotNull(), F.concat(F.lower(method), F.lit("."), host)).otherwise("http")
    return {
        "eventTime": _cf_time(r.some("EdgeStartTimestamp"), r.some("Datetime")), "eventID": ident, "requestID": ident, "eventSource": F.lit("cloudflare.com.http_request"), "eventName": name,
        "eventType": F.lit("Cloudflare.HttpRequest"), "sourceIPAddress": ip, "userIdentity": identity("IPAddress", ip), "requestParameters": r.json,
    }


#: In the order in which they are tried: the most specific shapes first, and CloudTrail, which asks for an eventID only, last of the JSON ones.
PARSERS: tuple[Parser, ...] = (
    Parser("AWS.BedrockModelInvocation", _bedrock_accept, _bedrock),
    Parser("GSuite.Reports", _gsuite_accept, _gsuite),
    Parser("Amazon.EKS.Audit", _eks_accept, _eks),
    Parser("GCP.HTTPLoadBalancer", _gcp_lb_accept, _gcp_lb),
    Parser("GCP.AuditLog", _gcp_accept, _gcp),
    Parser("GitHub.Webhook", _github_webhook_accept, _github_webhook),
    Parser("GitHub.Audit", _github_audit_accept, _github_audit),
    Parser("Slack.AuditLogs", _slack_accept, _slack),
    Parser("Cloudflare.Firewall", _cf_firewall_accept, _cf_firewall),
    Parser("Cloudflare.HttpRequest", _cf_http_accept, _cf_http),
    Parser("Okta.SystemLog", _okta_accept, _okta),
    Parser("OnePassword.SignInAttempt", _onepassword_accept, _onepassword),
    Parser("AWS.CloudTrail", _cloudtrail_accept, _cloudtrail),
    Parser("AWS.ALB", _alb_accept, _alb, json=False),
    Parser("AWS.S3ServerAccess", _s3_accept, _s3, json=False),
    Parser("AWS.VPCFlow", _vpc_accept, _vpc, json=False),
    Parser("AWS.AuroraMySQLAudit", _aurora_accept, _aurora, json=False),
)
BY_TYPE = {p.log_type: p for p in PARSERS}
