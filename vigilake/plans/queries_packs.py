"""Queries of the remaining packs and parsers, of alerts, and of a whole run over raw lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.operators import alerts, stateful
from vigilake.operators.classify import parse_as
from vigilake.operators.detect import RuleSet
from vigilake.rules import contexts
from vigilake.rules.model import Event

from . import modes
from .queries_core import load, query
from .queries_rules import _case, _expected, _json, _pack

_EVEN, _ODD = "user_id % 2 = 0", "user_id % 2 = 1"


def _even(yes: str | int | bool, no: str | int | bool) -> Column:
    return F.when(F.col("user_id") % 2 == 0, yes).otherwise(no)


# ---- packs ----


@query(_expected(click=[("aws_alb_high_error_rate", "LOW", "")], view=[("aws_alb_high_error_rate", "LOW", _EVEN)], error=[("aws_alb_suspicious_user_agent", "MEDIUM", "")], purchase=[("aws_alb_high_error_rate", "LOW", _ODD), ("aws_alb_suspicious_user_agent", "MEDIUM", _EVEN)]))
def rules_aws_alb(spark, sf_dir):
    kind = F.col("event_type")
    elb = F.when(kind == "click", 502).when(kind == "view", _even(400, 399)).when(kind == "purchase", 200).otherwise(600)
    target = F.when(kind == "purchase", _even(200, 599)).otherwise(200)
    agent = F.when(kind == "error", "SQLMap/1.0").when(kind == "purchase", _even("a Crawler", "curl")).otherwise("Mozilla")
    return _pack(spark, sf_dir, ["aws_alb"], "AWS.ALB", _json(elbStatusCode=elb, targetStatusCode=target, userAgent=agent, clientIP=F.lit("1.2.3.4")))


@query(_expected(click=[("aws_bedrockmodelinvocation_guardrail_intervened", "INFO", "")], view=[("aws_bedrockmodelinvocation_guardrail_intervened", "INFO", _EVEN)]))
def rules_bedrock(spark, sf_dir):
    operation = _case(click="InvokeModel", view="Converse", error="InvokeModel", purchase="Other", signup="InvokeModel")
    stop = _case(click="guardrail_intervened", error="end_turn", purchase="guardrail_intervened")
    trace = F.when(F.col("event_type") == "view", F.struct(F.struct(_even("Guardrail blocked.", "Passed").alias("actionReason")).alias("guardrail")))
    body = F.struct(stop.alias("stopReason"), trace.alias("amazon-bedrock-trace"))
    return _pack(spark, sf_dir, ["aws_bedrockmodelinvocation"], "AWS.BedrockModelInvocation", _json(operation=operation, modelId=F.lit("m"), accountId=F.lit("1"), output=F.struct(body.alias("outputBodyJson"))))


@query(_expected(click=[("aws_s3_access_error", "INFO", "")], view=[("aws_s3_insecure_access", "LOW", "")], error=[("aws_s3_insecure_access", "LOW", _ODD), ("aws_s3_access_error", "INFO", "")]))
def rules_aws_s3(spark, sf_dir):
    kind = F.col("event_type")
    operation = F.when(kind == "signup", "REST.GET.BUCKET").otherwise("REST.GET.OBJECT")
    status = F.when(kind == "click", 403).when(kind == "error", 405).otherwise(200)
    cipher = F.when(kind == "view", "").when(kind == "error", _even("AES", "")).otherwise("AES")
    return _pack(spark, sf_dir, ["aws_s3"], "AWS.S3ServerAccess", _json(operation=operation, httpStatus=status, cipherSuite=cipher, tlsVersion=F.lit("TLSv1.2"), bucket=F.lit("b"), requester=F.lit("r"), userAgent=F.lit("aws-cli")))


@query(_expected(click=[("aws_vpc_inbound_traffic_port_blocklist", "MEDIUM", ""), ("aws_vpc_ssh_allowed_signal", "HIGH", _EVEN)], view=[("aws_vpc_inbound_traffic_port_blocklist", "MEDIUM", "")], error=[("aws_vpc_unapproved_outbound_dns", "MEDIUM", _ODD)]))
def rules_vpcflow(spark, sf_dir):
    kind = F.col("event_type")
    port = F.when(kind == "click", 22).when(kind == "view", 3389).when(kind == "error", 53).when(kind == "purchase", 22).otherwise(443)
    source = F.when(kind.isin("click", "view", "signup"), "9.9.9.9").otherwise("10.0.0.1")
    target = F.when(kind == "error", _even("8.8.8.8", "9.9.9.10")).otherwise("10.0.0.2")
    return _pack(spark, sf_dir, ["aws_vpcflow"], "AWS.VPCFlow", _json(dstPort=port, srcAddr=source, dstAddr=target, action=_even("ACCEPT", "REJECT")))


@query(_expected(click=[("cloudflare_react2shell_rce_attempt", "INFO", "")]))
def rules_cloudflare(spark, sf_dir):
    from vigilake.rules.services import EXPLOIT_RULES

    kind = F.col("event_type")
    payload = _json(RuleID=F.when(kind == "click", EXPLOIT_RULES[0]).otherwise("other"), ClientIP=F.lit("1.2.3.4"), Source=F.lit("waf"), BotScore=F.lit(99), Action=F.lit("block"))
    return _pack(spark, sf_dir, ["cloudflare"], "Cloudflare.Firewall", payload)


@query(_expected(click=[("gcp_access_attempts_violating_iap_access_controls", "INFO", _EVEN)], view=[("gcp_cloud_armor_r2s_rce_attempt", "INFO", "")], error=[("gcp_cloud_armor_r2s_rce_attempt", "INFO", "")]))
def rules_gcp_http_lb(spark, sf_dir):
    kind = F.col("event_type")
    ids = F.array(F.lit("x"), F.lit("google-mrs-v202512-id000002-rce"))
    body = F.struct(_case(click="handled_by_identity_aware_proxy", signup="other").alias("statusDetails"), F.struct(F.when(kind == "view", ids).alias("preconfiguredExprIds")).alias("enforcedSecurityPolicy"), F.struct(F.when(kind == "error", ids).alias("preconfiguredExprIds")).alias("previewSecurityPolicy"))
    balancer = F.struct(F.when(kind == "purchase", "gce_instance").otherwise("http_load_balancer").alias("type"))
    return _pack(spark, sf_dir, ["gcp_http_lb"], "GCP.HTTPLoadBalancer", _json(resource=balancer, httpRequest=F.struct(_even(403, 200).alias("status")), jsonPayload=body))


@query(_expected(click=[("gcp_k8s_exec_into_pod", "INFO", "")], view=[("gcp_k8s_pod_attached_to_node_host_network", "INFO", ""), ("gcp_k8s_pod_using_host_pid_namespace", "INFO", _EVEN)], error=[("gcp_k8s_cron_job_created_or_modified", "INFO", "")], purchase=[("gcp_k8s_new_daemonset_deployed", "INFO", _ODD)], signup=[("gcp_k8s_service_type_node_port_deployed", "INFO", "")]))
def rules_gcp_k8s(spark, sf_dir):
    kind = F.col("event_type")
    method = _case(click="io.k8s.core.v1.pods.exec.create", view="io.k8s.core.v1.pods.create", error="io.k8s.batch.v1.cronjobs.update", purchase="io.k8s.apps.v1.daemonsets.create", signup="io.k8s.core.v1.services.create")
    grants = F.array(F.struct(method.alias("permission"), F.when(kind == "purchase", F.col("user_id") % 2 == 1).when(kind.isin("error", "signup"), True).otherwise(False).alias("granted")))
    spec = F.struct(F.when(kind == "view", True).alias("hostNetwork"), F.when(kind == "view", F.col("user_id") % 2 == 0).alias("hostPID"), _case(signup="NodePort").alias("type"))
    proto = F.struct(method.alias("methodName"), F.lit("core/v1/namespaces/n/pods/p").alias("resourceName"), F.struct(F.lit("a@b.c").alias("principalEmail")).alias("authenticationInfo"), grants.alias("authorizationInfo"), F.struct(spec.alias("spec")).alias("request"))
    return _pack(spark, sf_dir, ["gcp_k8s"], "GCP.AuditLog", _json(protoPayload=proto, resource=F.struct(F.lit("k8s_cluster").alias("type"))))


@query(
    "SELECT event_id, rule_id, severity FROM (" + _expected(click=[("github_malicious_issue_pages", "INFO", _EVEN)], view=[("github_malicious_comment_content", "INFO", "")], error=[("github_malicious_commit_content", "INFO", "")]) + ") x"
)
def rules_github_webhook(spark, sf_dir):
    kind = F.col("event_type")
    bad = F.lit("run $(id) now")
    issue = F.when(kind == "click", F.struct(F.lit("open").alias("state"), F.when(F.col("user_id") % 2 == 0, bad).otherwise("fine").alias("title"), F.lit(7).alias("number")))
    comment = F.when(kind == "view", F.struct(F.lit(3).alias("id"), bad.alias("body")))
    commits = F.when(kind == "error", F.array(F.struct(F.lit("fix").alias("message"), F.struct(F.lit("a`b`").alias("name"), bad.alias("email")).alias("author"))))
    action = _case(click="opened", view="created", error="pushed", purchase="starred", signup="closed")
    repository = F.struct(F.lit("o/r").alias("full_name"), F.lit(True).alias("private"), F.lit("private").alias("visibility"))
    found = _pack(spark, sf_dir, ["github_webhook"], "GitHub.Webhook", _json(action=action, repository=repository, issue=issue, comment=comment, commits=commits))
    return found.where(F.col("rule_id").startswith("github_malicious"))


@query(_expected(click=[("gsuite_2sv_disabled", "MEDIUM", "")], view=[("gsuite_admin_role_assigned", "HIGH", _EVEN), ("gsuite_admin_role_assigned", "INFO", _ODD)], error=[("gsuite_brute_force_by_ip", "INFO", "")], purchase=[("gsuite_user_suspended", "INFO", _EVEN)]))
def rules_gsuite(spark, sf_dir):
    kind = F.col("event_type")
    application = F.when(kind.isin("click", "error"), "login").when(kind == "purchase", _even("admin", "drive")).otherwise("admin")
    parameters = F.array(F.struct(F.lit("USER_EMAIL").alias("name"), F.lit("u@x").alias("value")), F.struct(F.lit("ROLE_NAME").alias("name"), _even("_SEED_ADMIN_ROLE", "Help desk").alias("value")))
    first = F.struct(_case(click="2sv_disable", view="ASSIGN_ROLE", error="login_failure", purchase="SUSPEND_USER", signup="OTHER").alias("name"), parameters.alias("parameters"))
    return _pack(spark, sf_dir, ["gsuite"], "GSuite.Reports", _json(id=F.struct(application.alias("applicationName")), events=F.array(first), ipAddress=F.lit("1.2.3.4")))


@query(_expected(click=[("onepassword_brute_force", "INFO", "")], view=[("onepassword_login_from_new_country", "MEDIUM", "")], error=[("onepassword_unusual_client", "MEDIUM", "")], purchase=[("onepassword_brute_force", "INFO", _EVEN)]))
def rules_onepassword(spark, sf_dir):
    from vigilake.rules.services import CLIENTS

    kind = F.col("event_type")
    category = F.when(kind == "click", "mfa_failed").when(kind == "purchase", _even("firewall_failed", "other")).otherwise("success")
    client = F.struct(F.when(kind == "error", "odd client").otherwise(list(CLIENTS)[0]).alias("app_name"), F.lit("1.2.3.4").alias("ip_address"))
    return _pack(spark, sf_dir, ["onepassword"], "OnePassword.SignInAttempt", _json(category=category, country=F.when(kind == "view", "ZZ"), client=client))


# ---- parsers ----

_SECOND = "epoch_us(date_trunc('second', ts))"


def _parsed(spark, sf_dir, log_type: str, raw: Column, *extra: Column):
    p = parse_as(load(spark, sf_dir, "events").select("event_id", raw.alias("raw")), log_type)
    return p.select(F.col("event_id"), F.unix_micros("eventTime").alias("at"), F.col("eventID").alias("id"), F.col("eventName").alias("name"), F.col("eventSource").alias("source"), *extra)


def _time(pattern: str) -> Column:
    return F.date_format(F.col("ts").cast("timestamp"), pattern)


_ISO, _PLAIN = "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss"


def _id() -> Column:
    return F.col("event_id").cast("string")


def _user() -> Column:
    return F.col("user_id").cast("string")




def _parse_sql(ident: str, name: str, source: str, **extra: str) -> str:
    return f"SELECT event_id, {_SECOND} AS at, {ident} AS id, {name} AS name, '{source}' AS source" + "".join(f", {v} AS {k}" for k, v in extra.items()) + " FROM events"


_E, _U = "CAST(event_id AS VARCHAR)", "CAST(user_id AS VARCHAR)"


@query(_parse_sql(_E, "'Converse'", "aws.bedrock.modelinvocation", region="'eu-west-1'", account="'4' || user_id % 10"))
def parse_bedrock(spark, sf_dir):
    account = F.concat(F.lit("4"), (F.col("user_id") % 10).cast("string"))
    arn = F.concat(F.lit("arn:aws:sts::"), account, F.lit(":role/x"))
    raw = _json(schemaType=F.lit("ModelInvocationLog"), requestId=_id(), operation=F.lit("Converse"), timestamp=_time("yyyy-MM-dd'T'HH:mm:ss"), region=F.lit("eu-west-1"), accountId=F.lit("1"), identity=F.struct(arn.alias("arn")))
    return _parsed(spark, sf_dir, "AWS.BedrockModelInvocation", raw, F.col("awsRegion").alias("region"), F.col("userIdentity.accountId").alias("account"))


@query(_parse_sql(_E, "'user.' || event_type", "okta.com", ip="'10.0.0.' || user_id % 100"))
def parse_okta(spark, sf_dir):
    ip = F.concat(F.lit("10.0.0."), (F.col("user_id") % 100).cast("string"))
    raw = _json(uuid=_id(), published=_time(_ISO), eventType=F.concat(F.lit("user."), F.col("event_type")), client=F.struct(F.lit("9.9.9.9").alias("ipAddress")), request=F.struct(F.array(F.struct(ip.alias("ip"))).alias("ipChain")))
    return _parsed(spark, sf_dir, "Okta.SystemLog", raw, F.col("sourceIPAddress").alias("ip"))


@query(_parse_sql(f"'gsuite-C' || user_id % 7 || '-' || strftime(ts, '%Y%m%d%H%M%S') || '-' || {_E}", "upper(event_type)", "googleapis.com", ip="'1.2.3.4'"))
def parse_gsuite(spark, sf_dir):
    ident = F.struct(_time(_ISO).alias("time"), F.concat(F.lit("C"), (F.col("user_id") % 7).cast("string")).alias("customerId"), _id().alias("uniqueQualifier"))
    raw = _json(kind=F.lit("admin#reports#activity"), id=ident, events=F.array(F.struct(F.upper("event_type").alias("name"))), ipAddress=F.lit("1.2.3.4"))
    return _parsed(spark, sf_dir, "GSuite.Reports", raw, F.col("sourceIPAddress").alias("ip"))


@query(_parse_sql(_E, "CASE WHEN event_type = 'click' THEN 'SignInAttempt' ELSE event_type END", "1password.com", ip="'4.3.2.1'"))
def parse_onepassword(spark, sf_dir):
    raw = _json(uuid=_id(), timestamp=_time(_PLAIN), type=F.when(F.col("event_type") != "click", F.col("event_type")), client=F.struct(F.lit("4.3.2.1").alias("ip_address")))
    return _parsed(spark, sf_dir, "OnePassword.SignInAttempt", raw, F.col("sourceIPAddress").alias("ip"))


@query(_parse_sql(f"CASE user_id % 3 WHEN 0 THEN 'wr-' || {_E} WHEN 1 THEN 'pr-' || {_E} ELSE event_type || '-o/r' END", "event_type", "github.com.webhook", who=f"'u' || {_U}").replace("FROM events", "FROM events WHERE user_id % 3 <> 2"))
def parse_github_webhook(spark, sf_dir):
    u = F.col("user_id") % 3
    run = F.when(u == 0, F.struct(F.col("event_id").alias("id"), _time(_ISO).alias("created_at")))
    pull = F.when(u == 1, F.struct(F.col("event_id").alias("id"), _time(_ISO).alias("updated_at")))
    raw = F.when(u != 2, _json(action=F.col("event_type"), repository=F.struct(F.lit("o/r").alias("full_name")), sender=F.struct(F.concat(F.lit("u"), _user()).alias("login")), workflow_run=run, pull_request=pull)).otherwise("{}")
    return _parsed(spark, sf_dir, "GitHub.Webhook", raw, F.col("userIdentity.userName").alias("who"))


@query(_parse_sql(_E, "'v1.' || event_type", "cloudaudit.googleapis.com", who="'a' || user_id % 5 || '@x'", project="'p1'"))
def parse_gcp_audit(spark, sf_dir):
    who = F.struct(F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string"), F.lit("@x")).alias("principalEmail"))
    proto = F.struct(F.concat(F.lit("v1."), F.col("event_type")).alias("methodName"), who.alias("authenticationInfo"))
    raw = _json(insertId=_id(), timestamp=_time(_ISO), protoPayload=proto, resource=F.struct(F.struct(F.lit("p1").alias("project_id")).alias("labels")), logName=F.lit("projects/p1/logs/cloudaudit.googleapis.com%2Factivity"))
    return _parsed(spark, sf_dir, "GCP.AuditLog", raw, F.col("userIdentity.userName").alias("who"), F.col("recipientAccountId").alias("project"))


@query(_parse_sql(f"CASE WHEN {_EVEN} THEN {_E} ELSE 'http://h/' || {_E} END", "'httpRequest'", "loadbalancing.googleapis.com", ip="'7.7.7.7'"))
def parse_gcp_http_lb(spark, sf_dir):
    request = F.struct(F.lit("7.7.7.7").alias("remoteIp"), F.concat(F.lit("http://h/"), _id()).alias("requestUrl"))
    raw = _json(insertId=F.when(F.col("user_id") % 2 == 0, _id()), timestamp=_time(_ISO), httpRequest=request, resource=F.struct(F.lit("http_load_balancer").alias("type")))
    return _parsed(spark, sf_dir, "GCP.HTTPLoadBalancer", raw, F.col("sourceIPAddress").alias("ip"))


@query(_parse_sql(_E, "CASE event_type WHEN 'click' THEN 'get.pods.exec' WHEN 'view' THEN 'get.pods' ELSE 'get' END", "eks.amazonaws.com", ip="'2.2.2.2'", who=f"'u' || {_U}"))
def parse_eks(spark, sf_dir):
    ref = F.when(F.col("event_type").isin("click", "view"), F.struct(F.lit("pods").alias("resource"), _case(click="exec").alias("subresource")))
    raw = _json(kind=F.lit("Event"), apiVersion=F.lit("audit.k8s.io/v1"), auditID=_id(), verb=F.lit("get"), objectRef=ref, user=F.struct(F.concat(F.lit("u"), _user()).alias("username")), sourceIPs=F.array(F.lit(""), F.lit("2.2.2.2")), requestReceivedTimestamp=_time(_ISO))
    return _parsed(spark, sf_dir, "Amazon.EKS.Audit", raw, F.col("sourceIPAddress").alias("ip"), F.col("userIdentity.userName").alias("who"))


@query(_parse_sql(f"CASE WHEN {_EVEN} THEN {_E} ELSE event_type || '-' || strftime(ts, '%Y-%m-%d %H:%M:%S') END", "event_type", "slack.com", who=f"'u' || {_U} || '@x'"))
def parse_slack(spark, sf_dir):
    actor = F.struct(F.struct(F.concat(F.lit("u"), _user(), F.lit("@x")).alias("email")).alias("user"))
    raw = _json(action=F.col("event_type"), actor=actor, date_create=_time(_PLAIN), p_row_id=F.when(F.col("user_id") % 2 == 0, _id()))
    return _parsed(spark, sf_dir, "Slack.AuditLogs", raw, F.col("userIdentity.userName").alias("who"))


@query(_parse_sql(_E, "CASE WHEN event_type = 'click' THEN 'firewall' ELSE 'block.' || event_type END", "cloudflare.com.firewall", ip="'3.3.3.3'"))
def parse_cf_firewall(spark, sf_dir):
    raw = _json(Kind=F.lit("Firewall"), RayID=_id(), Action=F.when(F.col("event_type") != "click", "BLOCK"), Source=F.upper("event_type"), ClientIP=F.lit("3.3.3.3"), Datetime=_time(_ISO))
    return _parsed(spark, sf_dir, "Cloudflare.Firewall", raw, F.col("sourceIPAddress").alias("ip"))


@query(_parse_sql(_E, "CASE WHEN event_type = 'click' THEN 'http' ELSE 'get.h-' || event_type END", "cloudflare.com.http_request", ip="'3.3.3.3'"))
def parse_cf_http(spark, sf_dir):
    raw = _json(BotScore=F.lit(5), RayID=_id(), ClientRequestMethod=F.when(F.col("event_type") != "click", "GET"), ClientRequestHost=F.concat(F.lit("h-"), F.col("event_type")), ClientIP=F.lit("3.3.3.3"), EdgeStartTimestamp=_time(_ISO))
    return _parsed(spark, sf_dir, "Cloudflare.HttpRequest", raw, F.col("sourceIPAddress").alias("ip"))


# ---- contexts ----


def _context(spark, sf_dir, payload: Column, *columns):
    """columns: (name, function of the event)."""
    e = Event(F.col("payload"))
    rows = load(spark, sf_dir, "events").select("event_id", F.parse_json(payload).alias("payload"))
    return rows.select("event_id", *(f(e).alias(n) for n, f in columns))


@query("SELECT event_id, 'E-' || event_type AS name, '{\"type\":\"' || event_type || '\"}' AS who, CAST(NULL AS VARCHAR) AS agent, CAST(user_id AS VARCHAR) AS severity FROM events")
def context_aws(spark, sf_dir):
    payload = _json(eventName=F.concat(F.lit("E-"), F.col("event_type")), userIdentity=F.struct(F.col("event_type").alias("type")), severity=F.col("user_id"))
    return _context(spark, sf_dir, payload, ("name", lambda e: contexts.aws(e)["eventName"]), ("who", lambda e: contexts.aws(e)["userIdentity"]), ("agent", lambda e: contexts.aws(e)["userAgent"]), ("severity", lambda e: contexts.guardduty(e)["severity"]))


@query("SELECT event_id, 'u' || user_id || '@x' AS actor, CASE WHEN user_id % 2 = 0 THEN 'a,shown' ELSE 'a' END AS users, event_type = 'error' AS failed, event_type <> 'error' AS succeeded, '1.2.3.4' AS ip, CASE WHEN user_id % 2 = 0 THEN 'shown' END AS second FROM events")
def context_okta(spark, sf_dir):
    even = F.col("user_id") % 2 == 0
    target = lambda kind, ident, shown: F.struct(kind.alias("type"), ident.alias("alternateId"), shown.alias("displayName"))
    none = F.lit(None).cast("string")
    targets = F.array(target(F.lit("User"), F.lit("a"), none), target(F.when(even, "User").otherwise("App"), none, F.when(even, "shown")))
    payload = _json(actor=F.struct(F.concat(F.lit("u"), _user(), F.lit("@x")).alias("alternateId")), target=targets, outcome=F.struct(F.when(F.col("event_type") == "error", "FAILURE").otherwise("SUCCESS").alias("result")), client=F.struct(F.lit("1.2.3.4").alias("ipAddress")))
    return _context(
        spark, sf_dir, payload, ("actor", lambda e: contexts.picked(e, contexts.OKTA_ACTOR)["alternateId"]), ("users", lambda e: F.array_join(contexts.okta_target_users(e), ",")), ("failed", contexts.okta_failed), ("succeeded", contexts.okta_succeeded),
        ("ip", lambda e: contexts.okta(e)["sourceIPAddress"]), ("second", lambda e: Event(contexts.okta_target(e, 1)).s("displayName")),
    )


@query("SELECT event_id, 'a@x' AS principal, CASE WHEN user_id % 2 = 0 THEN 'n' ELSE '' END AS namespace, CASE WHEN user_id % 2 = 0 THEN 'p' ELSE '' END AS pod, '' AS project, CAST(NULL AS VARCHAR) AS project_id, CAST(user_id AS VARCHAR) AS port FROM events")
def context_gcp(spark, sf_dir):
    proto = F.struct(_even("core/v1/namespaces/n/pods/p", "core/v1/namespaces/n/services/s").alias("resourceName"), F.struct(F.lit("a@x").alias("principalEmail")).alias("authenticationInfo"))
    payload = _json(protoPayload=proto, jsonPayload=F.struct(F.struct(F.col("user_id").alias("src_port")).alias("connection")))
    info = contexts.gcp_k8s_info
    return _context(
        spark, sf_dir, payload, ("principal", lambda e: info(e)["principal"]), ("namespace", lambda e: info(e)["namespace"]), ("pod", lambda e: info(e)["pod"]), ("project", lambda e: contexts.gcp(e)["project"]), ("project_id", lambda e: info(e)["project_id"]),
        ("port", lambda e: contexts.picked(e, contexts.GCP_FLOW)["src_port"]),
    )


@query("SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'login' ELSE 'sent' END AS actor, CASE user_id % 3 WHEN 0 THEN 'http://pr' WHEN 1 THEN 'http://cmp' ELSE 'http://repo' END AS url, CASE WHEN user_id % 3 = 0 THEN user_id % 2 = 0 END AS crosses, CASE WHEN user_id % 3 = 1 THEN 2 END AS commits, 'o/r' AS repo FROM events")
def context_github(spark, sf_dir):
    u = F.col("user_id") % 3
    side = lambda name: F.struct(F.struct(name.alias("full_name")).alias("repo"))
    pull = F.struct(F.lit("http://pr").alias("html_url"), side(_even("o/fork", "o/r")).alias("head"), side(F.lit("o/r")).alias("base"))
    rest = dict(action=F.lit("opened"), repository=F.struct(F.lit("o/r").alias("full_name"), F.lit("http://repo").alias("html_url")), sender=F.struct(F.lit("sent").alias("login")), pull_request=F.when(u == 0, pull), compare=F.when(u == 1, "http://cmp"), pusher=F.when(u == 1, F.struct(F.lit("n").alias("name"))), commits=F.when(u == 1, F.array(F.lit(1), F.lit(2))))
    payload = F.when(u == 0, _json(actor=F.lit("plain"), **rest)).when(u == 1, _json(actor=F.struct(F.lit("login").alias("login")), **rest)).otherwise(_json(**rest))
    hook = contexts.github_webhook
    return _context(spark, sf_dir, payload, ("actor", lambda e: contexts.github(e)["actor"]), ("url", contexts.github_reference_url), ("crosses", lambda e: hook(e)["fork_analysis"]["is_cross_fork"]), ("commits", lambda e: hook(e)["push_details"]["size"]), ("repo", lambda e: hook(e)["repository"]["full_name"]))


@query("SELECT event_id, '<MISSING_NAME>' AS slack_name, 'e@x' AS slack_email, 'admin' AS gsuite_event, 'C1' AS customer, 'u@x' AS op_user, 'app' AS op_app, '<Action_NOT_IN_EVENT>' AS cf_action, 'waf' AS cf_source, CAST(user_id AS VARCHAR) AS bot FROM events")
def context_others(spark, sf_dir):
    payload = _json(
        actor=F.struct(F.struct(F.lit("e@x").alias("email")).alias("user")), id=F.struct(F.lit("C1").alias("customerId")), events=F.array(F.struct(F.lit("admin").alias("name"))),
        target_user=F.struct(F.lit("u@x").alias("email")), client=F.struct(F.lit("app").alias("app_name")), Source=F.lit("waf"), BotScore=F.col("user_id"),
    )
    return _context(
        spark, sf_dir, payload, ("slack_name", lambda e: contexts.slack(e)["actor-name"]), ("slack_email", lambda e: contexts.slack(e)["actor-email"]), ("gsuite_event", contexts.gsuite_event), ("customer", lambda e: contexts.gsuite(e)["customerId"]),
        ("op_user", lambda e: contexts.picked(e, contexts.ONEPASSWORD_USER)["email"]), ("op_app", lambda e: contexts.onepassword(e)["appName"]), ("cf_action", lambda e: contexts.cloudflare_firewall(e, e.s("Source"))["Action"]),
        ("cf_source", lambda e: contexts.cloudflare_firewall(e, e.s("Source"))["pan_cf_source"]), ("bot", lambda e: contexts.cloudflare_http(e)["BotScore"]),
    )


@query("SELECT event_id, event_type AS first, CAST(user_id AS VARCHAR) AS last, event_type || ',' || user_id AS all_, 'none' AS missing, CAST(user_id AS VARCHAR) AS k, CAST(2 AS BIGINT) AS n FROM events")
def helper_walk_and_key_values(spark, sf_dir):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    items = F.array(F.struct(F.col("event_type").alias("x")), F.struct(_user().alias("x")), F.struct(F.col("event_type").alias("x")))
    payload = _json(a=F.struct(items.alias("b")), tags=F.array(pair("k", F.lit("old")), pair("z", F.lit("1")), pair("k", _user())))
    return _context(
        spark, sf_dir, payload, ("first", lambda e: contexts.walked(e, "a", "b", "x", which="first")), ("last", lambda e: contexts.walked(e, "a", "b", "x", which="last")), ("all_", lambda e: F.array_join(contexts.walked(e, "a", "b", "x"), ",")), ("missing", lambda e: contexts.walked(e, "a", "q", default="none", which="first")),
        ("k", lambda e: F.try_element_at(contexts.key_values(e.items("tags"), "key", "value"), F.lit("k"))), ("n", lambda e: F.size(contexts.key_values(e.items("tags"), "key", "value")).cast("long")),
    )


# ---- alerts and windows ----

_RULE = "CASE WHEN event_type = 'error' THEN 'errors' ELSE 'others' END"


def _forwarded(spark, sf_dir, ts: Column, period: int):
    e = load(spark, sf_dir, "events").where("user_id % 10 < 3")
    rule = F.expr(_RULE)
    matches = e.select("event_id", rule.alias("rule_id"), (F.col("user_id") % 10).cast("string").alias("dedup"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("title"), F.lit("LOW").alias("severity"), ts.alias("eventTime"))
    out = alerts.forward(matches, period_minutes=period)
    return out.select("event_id", F.col("alert_created"), "is_new_alert")


def _forwarded_sql(ts: str, period: str) -> str:
    """An alert takes in what comes until a period after its creation: a walk from each creation to the next."""
    return f"""
WITH RECURSIVE m AS (SELECT event_id, {_RULE} AS rule_id, user_id % 10 AS dedup, {ts} AS t, row_number() OVER (PARTITION BY {_RULE}, user_id % 10 ORDER BY {ts}, event_id) AS k FROM events WHERE user_id % 10 < 3),
walk AS (
  SELECT rule_id, dedup, t, event_id FROM m WHERE k = 1
  UNION ALL
  SELECT x.rule_id, x.dedup, x.n.t, x.n.event_id FROM (SELECT w.rule_id, w.dedup, (SELECT struct_pack(t := m.t, event_id := m.event_id) FROM m WHERE m.rule_id = w.rule_id AND m.dedup = w.dedup AND m.t > w.t + {period} ORDER BY m.t, m.event_id LIMIT 1) AS n FROM walk w) x WHERE x.n IS NOT NULL)
SELECT m.event_id, strftime(a.created, '%Y-%m-%dT%H:%M:%SZ') AS alert_created, a.opener = m.event_id AS is_new_alert
FROM m ASOF JOIN (SELECT rule_id, dedup, t AS created, event_id AS opener FROM walk) a ON a.rule_id = m.rule_id AND a.dedup = m.dedup AND m.t >= a.created"""


@query(_forwarded_sql("ts", "INTERVAL 600 MINUTE"))
def alert_forward(spark, sf_dir):
    return _forwarded(spark, sf_dir, F.col("ts").cast("timestamp"), 600)


@query(_forwarded_sql("date_trunc('day', ts)", "INTERVAL 2160 MINUTE"))
def alert_forward_ties(spark, sf_dir):
    """Many matches at one time: one of them opens the alert."""
    return _forwarded(spark, sf_dir, F.date_trunc("day", F.col("ts").cast("timestamp")), 2160)


_LIMITS = {"click": (7, 1), "view": (86_399, 3), "error": (3_600, 2), "purchase": (604_801, 12)}


@query(
    " UNION ALL ".join(
        f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND {w * 1_000_000 + 1} PRECEDING) AS n FROM events WHERE event_type = '{t}') x WHERE n = {c}"
        for t, (w, c) in _LIMITS.items()
    )
)
def threshold_windows_mixed(spark, sf_dir):
    """Windows without a common measure."""
    e = load(spark, sf_dir, "events").withColumn("us", stateful.micros(F.col("ts")))
    limits = {t: (w * 1_000_000, c) for t, (w, c) in _LIMITS.items()}
    return stateful.thresholds_crossed(e, limits, "event_type", "user_id", "us", ["event_id"]).select("event_id")


# ---- a whole run ----

_RUN = {
    0: dict(purchase=[("aws_cloudtrail_stopped", "HIGH")], view=[("aws_s3_bucket_deleted", "HIGH")], click=[("aws_console_login_failed", "INFO")]),
    1: dict(signup=[("okta_support_access", "MEDIUM")], view=[("okta_user_mfa_reset_all", "MEDIUM")]),
    2: dict(click=[("github_repo_created", "INFO")], view=[("github_advanced_security_change", "CRITICAL")], purchase=[("github_org_modified", "INFO")]),
    3: dict(error=[("slack_dlp_modified", "High")], signup=[("slack_org_deleted", "INFO")]),
    4: dict(click=[("gcp_firewall_rule_created", "INFO")], signup=[("gcp_sql_config_changes", "INFO")]),
    5: dict(click=[("gsuite_2sv_disabled", "MEDIUM")]),
    6: dict(),
}


def attack_lines(spark, sf_dir):
    """Events as raw records of six vendors' formats and of none, some of which rules match."""
    time, kind = _time(_ISO), F.col("event_type")
    forms = [
        _json(eventID=_id(), eventTime=time, eventName=_case(purchase="DeleteTrail", view="DeleteBucket", click="ConsoleLogin", error="Describe", signup="Get"), eventSource=_case(view="s3.amazonaws.com"), responseElements=F.struct(_case(click="Failure").alias("ConsoleLogin"))),
        _json(uuid=_id(), published=time, eventType=_case(signup="user.session.impersonation.grant", view="user.mfa.factor.reset_all", click="a", error="b", purchase="c")),
        _json(action=_case(click="repo.create", view="secret_scanning.disable", purchase="org.add_member", error="x", signup="y"), created_at=F.unix_seconds(F.col("ts").cast("timestamp")) * 1000, actor=F.lit("a"), _document_id=_id(), visibility=F.lit("private")),
        _json(action=_case(error="native_dlp_rule_deactivated", signup="organization_deleted", click="x", view="y", purchase="z"), date_create=_time(_PLAIN), p_row_id=_id(), actor=F.struct(F.struct(F.lit("e@x").alias("email")).alias("user"))),
        _json(insertId=_id(), timestamp=time, protoPayload=F.struct(_case(click="v1.compute.firewalls.insert", signup="cloudsql.instances.update", view="x.y", error="x.z", purchase="x.w").alias("methodName"))),
        _json(kind=F.lit("admin#reports#activity"), id=F.struct(time.alias("time"), F.lit("login").alias("applicationName"), _id().alias("uniqueQualifier"), F.lit("C").alias("customerId")), events=F.array(F.struct(F.when(kind == "click", "2sv_disable").otherwise("other").alias("name")))),
        F.concat(F.lit("nothing known "), _id()),
    ]
    raw = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        raw = F.when(F.col("event_id") % len(forms) == k, form).otherwise(raw)
    return load(spark, sf_dir, "events").select(raw.alias("raw"))


@query("SELECT rule_id, severity, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule_id, '{s}' AS severity FROM events WHERE event_id % {len(_RUN)} = {k} AND event_type = '{t}'" for k, by in _RUN.items() for t, rules in by.items() for r, s in rules) + ") x GROUP BY 1, 2")
def once_all_packs(spark, sf_dir):
    """Raw lines of many formats, classified, through all packs."""
    return alerts.counts(modes.batch(attack_lines(spark, sf_dir), RuleSet("intended"), spread=spark.sparkContext.defaultParallelism).matches)
