"""Queries of the rules over the driver's tables, rendered as vendors' records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import aws
from vigilake.operators.detect import Analysis, RuleSet, analyze
from vigilake.rules.code_hosting import SHELL_INJECTIONS, injects_shell
from vigilake.rules.model import Event

from .queries_core import load, query


def _pack(spark: SparkSession, sf_dir: str, packs: list[str], log_type: str, payload: Column) -> DataFrame:
    """(event_id, rule_id, severity) of a pack's matches over events rendered by ``payload``."""
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("eventID"), F.parse_json(payload).alias("payload"), F.lit(log_type).alias("log_type"))
    found = analyze(e, RuleSet("intended", packs), only=(log_type,), keep=("eventID",)).matches
    return found.select(F.col("eventID").alias("event_id"), "rule_id", "severity")


def _json(**columns: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in columns.items())))


def _case(**by_type: str) -> Column:
    out = F.lit(None).cast("string")
    for t, v in by_type.items():
        out = F.when(F.col("event_type") == t, v).otherwise(out)
    return out


def _sample_rules(e: Event):
    return [
        e.rule("any_error", e.eq("event_type", "error"), "Error of {user_id}", "HIGH", "{user_id}"),
        e.rule("large", F.coalesce(e.n("value") > 50, F.lit(False)), "Value {event_id}", "LOW"),
        e.rule("k_high", F.coalesce(e.n("props.k") >= 90, F.lit(False)), "k is {props.k}", "MEDIUM", "{props.k}"),
        e.rule("starts_c", e.starts("event_type", "c"), severity="INFO"),
        e.rule("odd_user", F.coalesce(e.n("user_id") % 2 == 1, F.lit(False)), severity="INFO", dedup="{user_id}"),
        e.rule("never", e.has("missing")),
    ]


def _sampled(spark: SparkSession, sf_dir: str) -> Analysis:
    e = load(spark, sf_dir, "events")
    payload = F.parse_json(F.to_json(F.struct("event_id", "user_id", "event_type", "value", F.from_json("props", "k long").alias("props"))))
    rows = e.select(F.col("event_id").alias("eventID"), payload.alias("payload"), F.lit("Own").alias("log_type"))
    return analyze(rows, RuleSet("intended", []).add(_sample_rules), keep=("eventID",))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_PREDICATES = {"any_error": "event_type = 'error'", "large": "value > 50", "k_high": f"{_K} >= 90", "starts_c": "starts_with(event_type, 'c')", "odd_user": "user_id % 2 = 1", "never": "false"}
_TITLES = {"any_error": ("'Error of ' || CAST(user_id AS VARCHAR)", "HIGH", "CAST(user_id AS VARCHAR)"), "large": ("'Value ' || CAST(event_id AS VARCHAR)", "LOW", "'large'"), "k_high": (f"'k is ' || CAST({_K} AS VARCHAR)", "MEDIUM", f"CAST({_K} AS VARCHAR)"), "starts_c": ("'starts_c'", "INFO", "'starts_c'"), "odd_user": ("'odd_user'", "INFO", "CAST(user_id AS VARCHAR)")}


@query(" UNION ALL ".join(f"SELECT event_id, '{r}' AS rule_id, {t} AS title, '{s}' AS severity, {d} AS dedup FROM events WHERE {_PREDICATES[r]}" for r, (t, s, d) in _TITLES.items()))
def rule_match_long(spark, sf_dir):
    return _sampled(spark, sf_dir).matches.select(F.col("eventID").alias("event_id"), "rule_id", "title", "severity", "dedup")


@query(" UNION ALL ".join(f"SELECT '{r}' AS rule_id, count(*) FILTER (WHERE {p}) AS match, count(*) - count(*) FILTER (WHERE {p}) AS no_match FROM events" for r, p in _PREDICATES.items()))
def rule_evaluations(spark, sf_dir):
    return _sampled(spark, sf_dir).evaluations


def _expected(**by_type: list[tuple[str, str, str]]) -> str:
    """SQL of (event_id, rule_id, severity) for lists of (rule, severity, further condition) by event type."""
    return " UNION ALL ".join(f"SELECT event_id, '{r}' AS rule_id, '{s}' AS severity FROM events WHERE event_type = '{t}'" + (f" AND {c}" if c else "") for t, rules in by_type.items() for r, s, c in rules)


@query(
    _expected(
        signup=[("aws_iam_user_created", "MEDIUM", ""), ("aws_iam_backdoor_users", "HIGH", "user_id % 2 = 0"), ("aws_iam_entity_creation_by_new_user", "MEDIUM", "user_id % 2 = 1"), ("aws_iam_unusual_user_agent", "MEDIUM", "user_id % 3 = 0"), ("aws_iam_resource_exposure", "MEDIUM", "")],
        purchase=[("aws_cloudtrail_stopped", "HIGH", "")],
        error=[("aws_unauthorized_api_call", "LOW", "")],
        click=[("aws_console_login_failed", "INFO", "")],
        view=[("aws_s3_bucket_deleted", "HIGH", "")],
    )
)
def rules_cloudtrail(spark, sf_dir):
    kind = F.when(F.col("user_id") % 2 == 0, "AssumedRole").otherwise("IAMUser")
    payload = _json(
        eventName=_case(signup="CreateUser", purchase="DeleteTrail", error="ListBuckets", click="ConsoleLogin", view="DeleteBucket"), eventSource=_case(signup="iam.amazonaws.com", view="s3.amazonaws.com"), errorCode=_case(error="AccessDenied"),
        userAgent=F.when(F.col("user_id") % 3 == 0, "curl").otherwise("aws-cli/2"), userIdentity=F.struct(kind.alias("type")), responseElements=F.struct(_case(click="Failure").alias("ConsoleLogin")),
    )
    return _pack(spark, sf_dir, ["aws_cloudtrail", "aws_iam"], "AWS.CloudTrail", payload)


@query(
    _expected(
        click=[("okta_brute_force_by_ip", "INFO", ""), ("okta_anonymizing_vpn_login", "MEDIUM", "user_id % 2 = 0")],
        view=[("okta_user_mfa_reset_all", "MEDIUM", "")],
        error=[("okta_threatinsight_alert", "CRITICAL", "")],
        purchase=[("okta_admin_mfa_disabled", "CRITICAL", "")],
        signup=[("okta_support_access", "MEDIUM", "")],
    )
)
def rules_okta(spark, sf_dir):
    payload = _json(
        eventType=_case(click="user.session.start", view="user.mfa.factor.reset_all", error="security.threat.detected", purchase="system.mfa.factor.deactivate", signup="user.session.impersonation.grant"),
        outcome=F.struct(F.lit("FAILURE").alias("result")), securityContext=F.struct((F.col("user_id") % 2 == 0).alias("isProxy")), debugContext=F.struct(F.struct(F.lit('{"x": CRITICAL}').alias("threatDetections")).alias("debugData")),
    )
    return _pack(spark, sf_dir, ["okta"], "Okta.SystemLog", payload)


@query(
    _expected(
        click=[("github_repo_created", "INFO", ""), ("github_public_repository_created", "INFO", "user_id % 2 = 0")],
        view=[("github_advanced_security_change", "CRITICAL", "")],
        error=[("github_repo_hook_modified", "MEDIUM", ""), ("github_webhook_modified", "MEDIUM", "")],
        purchase=[("github_org_modified", "INFO", "")],
    )
    + " UNION ALL SELECT event_id, 'github_repo_initial_access' AS rule_id, 'INFO' AS severity FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY lpad(CAST(event_id AS VARCHAR), 12, '0')) AS r FROM events WHERE event_type = 'signup') x WHERE r = 1"
)
def rules_github(spark, sf_dir):
    actor = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    payload = _json(action=_case(click="repo.create", view="secret_scanning.disable", error="hook.create", purchase="org.add_member", signup="git.clone"), visibility=F.when(F.col("user_id") % 2 == 0, "public").otherwise("private"), actor=actor, repo=F.lit("o/r"))
    e = load(spark, sf_dir, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("eventID"), F.parse_json(payload).alias("payload"), F.lit("GitHub.Audit").alias("log_type"))
    found = analyze(e, RuleSet("intended", ["github_audit"]), only=("GitHub.Audit",), keep=("eventID",)).matches
    return found.select(F.col("eventID").cast("long").alias("event_id"), "rule_id", "severity")


@query(
    _expected(
        click=[("slack_app_added", "High", "user_id % 2 = 0"), ("slack_app_added", "Medium", "user_id % 2 = 1")],
        view=[("slack_passthrough_anomaly", "MEDIUM", "")],
        error=[("slack_dlp_modified", "High", "")],
        purchase=[("slack_user_privilege_escalation", "Critical", "")],
        signup=[("slack_org_deleted", "INFO", "")],
    )
)
def rules_slack(spark, sf_dir):
    scopes = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("admin"))).otherwise(F.array(F.lit("chat:read")))
    payload = _json(action=_case(click="app_installed", view="anomaly", error="native_dlp_rule_deactivated", purchase="role_change_to_owner", signup="organization_deleted"), entity=F.struct(F.struct(scopes.alias("scopes")).alias("app")), details=F.struct(F.array(F.lit("session_fingerprint")).alias("reason")))
    return _pack(spark, sf_dir, ["slack_audit"], "Slack.AuditLogs", payload)


@query(
    _expected(
        click=[("gcp_firewall_rule_created", "INFO", "")],
        view=[("gcp_privileged_operation", "INFO", "")],
        error=[("gcp_logging_sink_modified", "INFO", "")],
        purchase=[("gcp_iam_roles_update_privilege_escalation", "INFO", "user_id % 2 = 0")],
        signup=[("gcp_sql_config_changes", "INFO", "")],
    )
)
def rules_gcp(spark, sf_dir):
    grant = F.array(F.struct(F.lit("iam.roles.update").alias("permission"), (F.col("user_id") % 2 == 0).alias("granted")))
    info = F.when(F.col("event_type") == "purchase", grant)
    method = _case(click="v1.compute.firewalls.insert", view="orgpolicy.policy.set", error="google.logging.v2.ConfigServiceV2.UpdateSink", purchase="x.y", signup="cloudsql.instances.update")
    return _pack(spark, sf_dir, ["gcp_audit"], "GCP.AuditLog", _json(protoPayload=F.struct(method.alias("methodName"), info.alias("authorizationInfo"))))


@query(
    _expected(
        click=[("k8s_exec_into_pod", "INFO", "")],
        view=[("k8s_pod_host_network", "INFO", ""), ("k8s_privileged_pod_created", "HIGH", "user_id % 2 = 0")],
        error=[("k8s_role_wildcard", "CRITICAL", ""), ("k8s_role_write_permissions", "CRITICAL", "")],
        purchase=[("k8s_multiple_403_public_ip", "INFO", "")],
        signup=[("k8s_service_nodeport", "INFO", "")],
    )
)
def rules_kubernetes(spark, sf_dir):
    container = F.array(F.struct(F.struct((F.col("user_id") % 2 == 0).alias("privileged")).alias("securityContext")))
    view = F.col("event_type") == "view"
    spec = F.struct(F.when(view, F.lit(True)).alias("hostNetwork"), F.when(view, container).alias("containers"), _case(signup="NodePort").alias("type"))
    rules = F.when(F.col("event_type") == "error", F.array(F.struct(F.array(F.lit("secrets"), F.lit("*")).alias("resources"), F.array(F.lit("create")).alias("verbs"))))
    ref = F.struct(_case(click="pods", view="pods", error="clusterroles", purchase="secrets", signup="services").alias("resource"), _case(click="exec").alias("subresource"))
    payload = _json(verb=F.when(F.col("event_type") == "purchase", "get").otherwise("create"), objectRef=ref, user=F.struct(F.lit("jo").alias("username")), sourceIPs=F.array(F.lit("8.8.8.8")), responseStatus=F.struct(F.when(F.col("event_type") == "purchase", 403).otherwise(200).alias("code")), requestObject=F.struct(spec.alias("spec"), rules.alias("rules")))
    return _pack(spark, sf_dir, ["kubernetes"], "Amazon.EKS.Audit", payload)


@query("SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'PrivEsc,ResourceExposure' WHEN 1 THEN 'DataAccess' WHEN 2 THEN 'CredentialExposure' WHEN 3 THEN 'CredentialExposure,PrivEsc,ResourceExposure' ELSE '' END AS categories FROM events")
def helper_iam_action_category(spark, sf_dir):
    source = F.expr("CASE user_id % 5 WHEN 0 THEN 'iam.amazonaws.com' WHEN 1 THEN 's3.amazonaws.com' WHEN 2 THEN 'sts.amazonaws.com' WHEN 3 THEN 'iam.amazonaws.com' ELSE 'sesv2.amazonaws.com' END")
    name = F.expr("CASE user_id % 5 WHEN 0 THEN 'PassRole' WHEN 1 THEN 'GetObject' WHEN 2 THEN 'AssumeRole' WHEN 3 THEN 'CreateAccessKey' ELSE 'SendEmail' END")
    return load(spark, sf_dir, "events").select("event_id", F.array_join(aws.categories(aws.action(source, name)), ",").alias("categories"))


@query("SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'u' || CAST(user_id AS VARCHAR) WHEN 1 THEN 'issuer' WHEN 2 THEN 'root' WHEN 3 THEN 's-' || event_type ELSE 'a@x' END AS actor FROM events")
def helper_actor_cascade(spark, sf_dir):
    u = F.col("user_id")
    who = F.struct(
        F.expr("CASE user_id % 5 WHEN 0 THEN 'IAMUser' WHEN 1 THEN 'AssumedRole' WHEN 2 THEN 'Root' WHEN 3 THEN 'FederatedUser' END").alias("type"), F.concat(F.lit("u"), u.cast("string")).alias("userName"),
        F.concat(F.lit("arn:aws:sts::1:role/x/s-"), F.col("event_type")).alias("arn"), F.struct(F.struct(F.lit("issuer").alias("userName")).alias("sessionIssuer")).alias("sessionContext"),
    )
    payload = F.parse_json(_json(userIdentity=F.when(u % 5 != 4, who), actor=F.struct(F.lit("a@x").alias("alternateId"))))
    return load(spark, sf_dir, "events").select("event_id", Event(payload).actor.alias("actor"))


@query("SELECT conv_id, turn, " + " OR ".join("regexp_matches(coalesce(text, ''), '(?im)" + p.replace("'", "''") + "')" for p in SHELL_INJECTIONS) + " AS hit FROM conversations")
def bash_injection(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", injects_shell(F.col("text")).alias("hit"))
