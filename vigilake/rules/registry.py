"""Rule packs, the log types each applies to, and their rules as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.k8s import COLUMN, K8s, once

from . import aws, code_hosting, gcp, kubernetes, services
from .model import AtomEvent, Event, Pack, Rule

#: Packs by name, with the log types they are indexed to.
PACKS: dict[str, tuple[Callable[..., list[Rule]], tuple[str, ...]]] = {
    "aws_alb": (aws.aws_alb, ("AWS.ALB",)),
    "aws_bedrockmodelinvocation": (aws.aws_bedrockmodelinvocation, ("AWS.BedrockModelInvocation",)),
    "aws_cloudtrail": (aws.aws_cloudtrail, ("AWS.CloudTrail",)),
    "aws_iam": (aws.aws_iam, ("AWS.CloudTrail",)),
    "aws_s3": (aws.aws_s3, ("AWS.CloudTrail",)),
    "aws_vpcflow": (aws.aws_vpcflow, ("AWS.VPCFlow",)),
    "cloudflare": (services.cloudflare, ("Cloudflare.Firewall", "Cloudflare.HttpRequest")),
    "gcp_audit": (gcp.gcp_audit, ("GCP.AuditLog",)),
    "gcp_http_lb": (gcp.gcp_http_lb, ("GCP.HTTPLoadBalancer",)),
    "gcp_k8s": (gcp.gcp_k8s, ("GCP.AuditLog",)),
    "github_audit": (code_hosting.github_audit, ("GitHub.Audit",)),
    "github_webhook": (code_hosting.github_webhook, ("GitHub.Webhook",)),
    "gsuite": (services.gsuite, ("GSuite.Reports",)),
    "kubernetes": (kubernetes.kubernetes, ("Amazon.EKS.Audit",)),
    "okta": (services.okta, ("Okta.SystemLog",)),
    "onepassword": (services.onepassword, ("OnePassword.SignInAttempt",)),
    "slack_audit": (services.slack_audit, ("Slack.AuditLogs",)),
}
#: What "intended" mode changes: where the packs' fields really are.
INTENDED_TYPES = {"aws_s3": ("AWS.S3ServerAccess",), "kubernetes": ("Amazon.EKS.Audit", "GCP.AuditLog")}
INTENDED_OPTIONS = {"aws_s3": {"intended": True}, "github_webhook": {"intended": True}}
#: Packs whose rules share values that are worked out once, and their column.
SHARING, SHARED, COMMON = ("aws_cloudtrail", "okta"), ("actor", "succeeded", "account"), "_common"
#: Rules that cannot be loaded in "reference" mode.
REFERENCE_BROKEN = ("aws_iam_high_risk_action", "aws_iam_privilege_escalation", "aws_iam_resource_exposure")


def log_types(pack: str, mode: str = "reference") -> tuple[str, ...]:
    return INTENDED_TYPES.get(pack, PACKS[pack][1]) if mode == "intended" else PACKS[pack][1]


def packs_for(log_type: str, mode: str = "reference") -> list[str]:
    return [p for p in PACKS if log_type in log_types(p, mode)]


def prepared(events: DataFrame, packs: list[str]) -> DataFrame:
    """events with what many rules of the packs read: worked out once per event and not once per rule."""
    if "kubernetes" in packs and COLUMN not in events.columns:
        events = K8s.unified(events)
    if set(SHARING) & set(packs) and COMMON not in events.columns:
        e = Event(F.col("payload"))
        events = events.withColumn(COMMON, once(F.struct(*(getattr(e, n).alias(n) for n in SHARED))))
    return events


_BUILT: dict[tuple, Pack] = {}


def pack_rules(pack: str, own_type: bool, mode: str, **options) -> Pack:
    """rules_of() over the columns payload and log_type, built once per session: expressions that name columns fit any table."""
    context = SparkContext._active_spark_context
    key = (id(context._gateway if context else None), pack, own_type, mode, repr(sorted(options.items())))
    if key not in _BUILT:
        _BUILT[key] = rules_of(pack, F.col("payload"), F.col("log_type") if own_type else None, mode, **options)
    return _BUILT[key]


def rules_of(pack: str, payload: Column, log_type: Column | None = None, mode: str = "reference", **options) -> Pack:
    e = AtomEvent(payload, log_type)
    if pack in SHARING:
        e.__dict__.update({n: F.col(COMMON)[n] for n in SHARED})
    found = PACKS[pack][0](e, **(INTENDED_OPTIONS.get(pack, {}) if mode == "intended" else {}) | options)
    return Pack([r for r in found if r.rule_id not in REFERENCE_BROKEN] if mode == "reference" else found, e.atoms)


def index(mode: str = "intended") -> list[tuple[str, str, tuple[str, ...]]]:
    """(rule_id, pack, log types) of all rules."""
    return [(r.rule_id, p, log_types(p, mode)) for p in PACKS for r in rules_of(p, F.col("payload"), F.col("log_type"), mode)]
