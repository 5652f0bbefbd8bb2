"""What alerts carry along of an event, by vendor, and accessors of single vendors' records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .code_hosting import crosses_forks, is_pull_request
from .model import Event

# Names in a context and where each value stands in the record.
AWS = {n: n for n in ("eventName", "eventTime", "sourceIPAddress", "userAgent", "recipientAccountId", "userIdentity", "requestParameters", "responseElements")}
GUARDDUTY = {n: n for n in ("severity", "type", "title", "description", "accountId", "region")}
OKTA = {n: n for n in ("eventType", "uuid", "published", "severity", "displayMessage", "actor", "client", "outcome", "target")} | {"sourceIPAddress": "client.ipAddress", "userAgent": "client.userAgent.rawUserAgent"}
OKTA_ACTOR = {n: f"actor.{n}" for n in ("id", "type", "alternateId", "displayName")}
GSUITE = {"applicationName": "id.applicationName", "customerId": "id.customerId", "time": "id.time"} | {n: n for n in ("actor", "ipAddress", "ownerDomain", "events")}
GSUITE_ACTOR = {n: f"actor.{n}" for n in ("email", "profileId", "callerType")}
ONEPASSWORD = {n: n for n in ("uuid", "timestamp", "category", "type", "country")} | {"targetUser": "target_user", "client": "client", "sourceIPAddress": "client.ip_address", "appName": "client.app_name"}
ONEPASSWORD_USER = {n: f"target_user.{n}" for n in ("email", "name", "uuid")}
ONEPASSWORD_CLIENT = {"appName": "client.app_name", "appVersion": "client.app_version", "ipAddress": "client.ip_address", "osName": "client.os_name", "osVersion": "client.os_version", "platformName": "client.platform_name", "platformVersion": "client.platform_version"}
GCP = {"project": "resource.labels.project_id", "principal": "protoPayload.authenticationInfo.principalEmail", "caller_ip": "protoPayload.requestMetadata.callerIP", "methodName": "protoPayload.methodName", "resourceName": "protoPayload.resourceName", "serviceName": "protoPayload.serviceName"}
GCP_INFO = {"principal": "protoPayload.authenticationInfo.principalEmail", "project_id": "resource.labels.project_id", "caller_ip": "protoPayload.requestMetadata.callerIP", "user_agent": "protoPayload.requestMetadata.callerSuppliedUserAgent", "method_name": "protoPayload.methodName"}
GCP_FLOW = {n: f"jsonPayload.connection.{n}" for n in ("src_ip", "dest_ip", "src_port", "dest_port", "protocol")} | {n: f"jsonPayload.{n}" for n in ("bytes_sent", "reporter")}
SLACK = {"actor-name": ("actor.user.name", "<MISSING_NAME>"), "actor-email": ("actor.user.email", "<MISSING_EMAIL>"), "actor-ip": ("context.ip_address", "<MISSING_IP>"), "user-agent": ("context.ua", "<MISSING_UA>")}
CLOUDFLARE_FIREWALL = ("Action", "ClientIP", "ClientRequestHost", "Datetime", "EdgeColoCode", "EdgeResponseStatus", "Kind", "RuleID", "Source")
CLOUDFLARE_HTTP = ("BotScore", "BotScoreSrc", "CacheCacheStatus", "CacheResponseStatus", "ClientIP", "ClientDeviceType", "ClientRequestHost", "ClientRequestMethod", "ClientRequestPath", "EdgeResponseStatus")
WEBHOOK_PARTS = {
    "repository": {n: f"repository.{n}" for n in ("name", "full_name", "private", "fork", "default_branch", "html_url")},
    "sender": {n: f"sender.{n}" for n in ("login", "id", "type", "html_url")},
    "pull_request": {n: f"pull_request.{n}" for n in ("number", "title", "state", "draft", "html_url", "created_at", "updated_at")} | {"user": "pull_request.user.login"},
    "fork_analysis": {"head_repo": "pull_request.head.repo.full_name", "base_repo": "pull_request.base.repo.full_name", "head_ref": "pull_request.head.ref", "base_ref": "pull_request.base.ref", "head_sha": "pull_request.head.sha", "base_sha": "pull_request.base.sha"},
    "push_details": {n: n for n in ("pusher", "ref", "before", "after", "forced")},
    "head_commit": {"id": "head_commit.id", "message": "head_commit.message", "author": "head_commit.author.name", "committer": "head_commit.committer.name", "timestamp": "head_commit.timestamp", "url": "head_commit.url"},
}


def picked(e: Event, paths: dict[str, str], default: str | None = None) -> Column:
    """The values at these paths as a struct of text; objects and lists as JSON."""
    return F.struct(*(e.s(p, default).alias(n) for n, p in paths.items()))


def aws(e: Event) -> Column:
    return picked(e, AWS)


def guardduty(e: Event) -> Column:
    return picked(e, GUARDDUTY)


def okta(e: Event) -> Column:
    return picked(e, OKTA)


def okta_target(e: Event, index: int = 0) -> Column:
    """One of the targets, as VARIANT; null if there are not so many."""
    return F.get(e.items("target"), F.lit(index))


def okta_target_users(e: Event) -> Column:
    users = F.filter(e.items("target"), lambda t: Event(t).eq("type", "User"))
    return F.transform(users, lambda t: Event(t).first_true("alternateId", "displayName"))


def okta_succeeded(e: Event) -> Column:
    return e.eq("outcome.result", "SUCCESS")


def okta_failed(e: Event) -> Column:
    return e.eq("outcome.result", "FAILURE")


def gsuite(e: Event) -> Column:
    return picked(e, GSUITE)


def gsuite_event(e: Event, field: str = "name", index: int = 0) -> Column:
    """name or type of one of the events."""
    return e.s(f"events.{index}.{field}")


def onepassword(e: Event) -> Column:
    return picked(e, ONEPASSWORD)


def gcp(e: Event) -> Column:
    return picked(e, GCP, "")


def gcp_k8s_info(e: Event) -> Column:
    """GCP_INFO with the namespace and pod of a resource name such as core/v1/namespaces/n/pods/p."""
    parts = F.split(e.s("protoPayload.resourceName", ""), "/")
    pod = (F.size(parts) >= 6) & (F.get(parts, F.lit(2)) == "namespaces") & (F.get(parts, F.lit(4)) == "pods")
    part = lambda i: F.when(pod, F.get(parts, F.lit(i))).otherwise("")
    return F.struct(*(e.s(p).alias(n) for n, p in GCP_INFO.items()), part(3).alias("namespace"), part(5).alias("pod"))


def slack(e: Event) -> Column:
    return F.struct(*(e.s(p, default).alias(n) for n, (p, default) in SLACK.items()))


def cloudflare_firewall(e: Event, source_name: Column) -> Column:
    """``source_name``: what the record's Source is called."""
    return F.struct(*(e.s(n, f"<{n}_NOT_IN_EVENT>").alias(n) for n in CLOUDFLARE_FIREWALL), source_name.alias("pan_cf_source"))


def cloudflare_http(e: Event) -> Column:
    return picked(e, {n: n for n in CLOUDFLARE_HTTP})


def github(e: Event) -> Column:
    login = F.coalesce(e.first_true("actor.login", "actor.name"), F.lit(""))
    actor = F.when(F.startswith(e.kind("actor"), F.lit("OBJECT")) & e.truthy("actor"), login).when(e.truthy("actor"), e.s("actor")).otherwise(e.s("sender.login", ""))
    return F.struct(e.s("action", "").alias("action"), actor.alias("actor"), e.s("actor_location.country_code").alias("actor_location"), *(e.s(n, "").alias(n) for n in ("org", "repo", "user")))


def github_webhook(e: Event) -> Column:
    """A struct of parts, each null where the record has none of it."""
    there = {"repository": e.is_object("repository"), "sender": e.truthy("sender"), "pull_request": is_pull_request(e), "fork_analysis": is_pull_request(e), "push_details": e.truthy("pusher"), "head_commit": e.truthy("pusher") & e.truthy("head_commit")}
    parts = {n: [e.s(p).alias(k) for k, p in paths.items()] for n, paths in WEBHOOK_PARTS.items()}
    parts["fork_analysis"].append(crosses_forks(e).alias("is_cross_fork"))
    parts["push_details"].append(F.size(e.items("commits")).alias("size"))
    return F.struct(e.s("action").alias("action"), *(F.when(there[n], F.struct(*fields)).alias(n) for n, fields in parts.items()))


def github_reference_url(e: Event) -> Column:
    pull = F.when(is_pull_request(e), e.first_true("pull_request.html_url"))
    return F.coalesce(pull, e.first_true("compare", "workflow_run.html_url", "repository.html_url"))


def key_values(items: Column, key: str, value: str) -> Column:
    """Map of a list of objects by two of their fields; of equal keys the last counts."""
    pairs = F.transform(items, lambda x: F.struct(Event(x).s(key).alias("k"), Event(x).s(value).alias("v")))
    known = F.filter(pairs, lambda p: p.k.isNotNull())
    last = F.filter(known, lambda p, i: ~F.exists(F.slice(known, i + 2, F.size(known)), lambda q: q.k == p.k))
    return F.map_from_entries(last)


def walked(e: Event, *keys: str, default: str | None = None, which: str = "all") -> Column:
    """walk() by its first or last value as text, or all of them as a list, the default where there are none."""
    found = F.filter(e.walk(*keys), lambda x: x.isNotNull())
    if which == "all":
        return found if default is None else F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))
    value = F.try_element_at(found, F.lit(1 if which == "first" else -1))
    return value if default is None else F.coalesce(value, F.lit(default))
