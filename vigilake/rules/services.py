"""Rules over identity, chat and edge services."""

# The ids, severities and titles of the rules below, and the names and values that their predicates ask for.

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.functions.text import any_of, matches_glob

from .model import Event, Rule, Threshold

# ---- Okta ----

# Rate limit events, and calls that support makes.
RATE_LIMITS = ("app.oauth2.client_id_rate_limit_warning", "application.integration.rate_limit_exceeded", "system.client.rate_limit.*", "system.client.concurrency_rate_limit.*", "system.operation.rate_limit.*", "system.org.rate_limit.*", "core.concurrency.org.limit.violation")
SUPPORT_RESETS = ("user.account.reset_password", "user.mfa.factor.update", "system.mfa.factor.deactivate", "user.mfa.attempt_bypass")


def target_ids(e: Event, kind: str) -> Column:
    """Different alternate ids of the targets of a kind, sorted."""
    found = F.transform(F.filter(e.items("target"), lambda t: Event(t).eq("type", kind)), lambda t: Event(t).s("alternateId"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.coalesce(x != "", F.lit(False)))))


def okta(e: Event) -> list[Rule]:
    t = lambda *names: e.among("eventType", *names)
    ok = e.eq("outcome.result", "SUCCESS")
    first = Event(F.get(e.items("target"), F.lit(0)))
    has_target = F.size(e.items("target")) > 0
    of_first = lambda path, missing, none: F.when(has_target, first.s(path, missing)).otherwise(none)
    event_type = e.s("eventType", "")
    last = F.element_at(F.split(event_type, r"\."), -1)
    who = "{actor.displayName|<UNKNOWN>} <{actor.alternateId|<UNKNOWN>}>"
    whom = "{actor.displayName|<displayName-not-found>} <{actor.alternateId|<alternateId-not-found>}>"
    by_uuid = lambda other: F.coalesce(e.first_true("uuid"), other)
    request = e.s("debugContext.debugData.requestId")
    key_name = of_first("displayName", "MISSING DISPLAY NAME", "MISSING TARGET")
    id_of = of_first("alternateId", "<id-not-found>", "<id-not-found>")
    named = {"actor": e.actor}
    ip = [("IP", "client.ipAddress"), ("ASO", "securityContext.asOrg"), ("ISP", "securityContext.isp"), ("Domain", "securityContext.domain")]
    ip_context = F.concat(F.lit("{"), F.concat_ws(", ", *(F.when(e.truthy(p), F.concat(F.lit(f"'{k}': '"), e.s(p), F.lit("'"))) for k, p in ip)), F.lit("}"))
    provider = Event(F.get(F.filter(e.items("target"), lambda x: Event(x).truthy("displayName")), F.lit(0))).s("displayName")
    mfa_user = Event(F.get(F.filter(e.items("target"), lambda x: Event(x).eq("type", "User")), F.lit(0)))
    users, apps = target_ids(e, "User"), target_ids(e, "AppInstance")
    threat = e.s("debugContext.debugData.threatDetections", "")
    threat_level = F.when(e.eq("outcome.result", "DENY"), "INFO")
    for level in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"):
        threat_level = threat_level.when(threat.contains(level), level)
    factor = F.get(F.split(F.trim(e.s("outcome.reason", "")), r"\s+"), F.lit(2))
    limited = F.when(e.eq("actor.alternateId", "unknown"), e.s("actor.displayName", "<id-not-found>")).otherwise(e.s("actor.alternateId"))
    helped = F.coalesce(first.first_true("alternateId", "displayName"), F.lit("<unknown-user>"))
    org_apps = ("application.lifecycle.update", "application.lifecycle.create", "application.lifecycle.activate")
    return [
        e.rule("okta_account_locked", t("user.account.lock", "user.account.lock.limit"), "Okta account locked: [{$actor}] - {displayMessage|account has been locked}", "MEDIUM", **named),
        e.rule("okta_admin_mfa_disabled", t("system.mfa.factor.deactivate"), "Okta system-wide MFA disabled by admin [{$actor}]", "CRITICAL", **named),
        e.rule("okta_admin_role_assigned", t("user.account.privilege.grant") & ok & e.search("debugContext.debugData.privilegeGranted", "[aA]dministrator"), who + " granted [{debugContext.debugData.privilegeGranted|<UNKNOWN_PRIVILEGE>}] to {$name} <{$id}>", F.when(e.contains("debugContext.debugData.privilegeGranted", "Super administrator"), "HIGH").otherwise("INFO"), "{debugContext.debugData.requestId|<UNKNOWN_REQUEST_ID>}", name=of_first("displayName", "MISSING DISPLAY NAME", ""), id=of_first("alternateId", "MISSING ALTERNATE ID", "")),
        e.rule("okta_anonymizing_vpn_login", t("user.session.start") & e.is_true("securityContext.isProxy"), whom + " attempted to sign-in from anonymizing VPN - {$context}", "MEDIUM", by_uuid(e.fmt("{actor.id}-{published|}")), context=ip_context),
        e.rule("okta_api_key_created", t("system.api_token.create") & ok, who + " created API key: {$key}", "INFO", key=key_name),
        e.rule("okta_api_key_revoked", t("system.api_token.revoke") & ok, who + " revoked API key - <{$key}>", "INFO", by_uuid(F.coalesce(request, F.lit(""))), key=key_name),
        e.rule("okta_app_unauthorized_access_attempt", t("app.generic.unauth_app_access_attempt"), "[{actor.alternateId|<id-not-found>}] attempted unauthorized access to [{$id}]", "MEDIUM", by_uuid(e.fmt("unauth-app-{actor.id}-{published|}")), id=id_of),
        e.rule("okta_brute_force_by_ip", t("user.session.start") & e.eq("outcome.result", "FAILURE"), "Okta: Failed login attempts from IP [{client.ipAddress|<UNKNOWN_IP>}] exceeded threshold", "INFO", "{client.ipAddress|<UNKNOWN_IP>}"),
        e.rule("okta_group_admin_role_assigned", t("group.privilege.grant"), "Okta Admin Privileges Assigned to Group [{$id}]", "INFO", by_uuid(e.fmt("group.privilege.grant-{published|}")), id=id_of),
        e.rule("okta_idp_modified", e.contains("eventType", "system.idp.lifecycle"), "Okta Identity Provider [{$idp|<UNKNOWN>}] {$action}d by [{$actor}]", F.when(event_type.contains("create"), "HIGH").otherwise("MEDIUM"), idp=provider, action=last, **named),
        e.rule("okta_mfa_factor_suspended", t("user.mfa.factor.suspend") & ok, "Okta MFA factor suspended for [{$user|<UNKNOWN>}] by [{$actor}]", "HIGH", user=mfa_user.first_true("alternateId", "displayName"), **named),
        e.rule("okta_org2org_creation_modification", t(*org_apps) & e.any("target", lambda x: x.contains("displayName", "Org2Org")), whom + " {$action}d Org2Org app [{$id}]", F.when(event_type.contains("create"), "HIGH").otherwise("MEDIUM"), by_uuid(e.fmt("org2org-{eventType|}-{published|}")), action=last, id=of_first("alternateId", "<alternateId-not-found>", "<alternateId-not-found>")),
        e.rule("okta_password_accessed", t("application.user_membership.show_password") & ~F.array_contains(users, e.s("actor.alternateId", "")), "Okta: [{$actor}] accessed password for [{$users}] in [{$apps}]", "HIGH", "{actor.alternateId|}:{$users}:{$apps}", users=F.array_join(users, ", "), apps=F.array_join(apps, ", "), **named),
        e.rule("okta_password_extraction_via_scim", t("application.lifecycle.update") & e.contains("outcome.reason", "Pushing user passwords"), whom + " extracted cleartext user passwords via SCIM app [{$id}]", "HIGH", by_uuid(e.fmt("scim-password-{published|}")), id=of_first("alternateId", "<alternateId-not-found>", "<alternateId-not-found>")),
        e.rule("okta_phishing_blocked", t("user.authentication.auth_via_mfa") & e.eq("outcome.result", "FAILURE") & e.eq("outcome.reason", "FastPass declined phishing attempt"), "Okta FastPass blocked phishing attempt for [{$actor}]", "HIGH", **named),
        e.rule("okta_rate_limits", matches_glob(event_type, RATE_LIMITS) & F.lower(event_type).contains("violation"), "Okta Rate Limit Event: [{eventType|}] by [{$who}/{actor.type|<type-not-found>}]", "MEDIUM", F.coalesce(e.first_true("actor.id"), e.s("uuid"), F.lit("")), who=limited),
        e.rule("okta_support_access", t("user.session.impersonation.grant", "user.session.impersonation.initiate"), "Okta: Support access {$what} by [{actor.alternateId|<UNKNOWN>}]", "MEDIUM", what=F.when(event_type.contains("grant"), "granted").otherwise("initiated")),
        e.rule("okta_support_reset", t(*SUPPORT_RESETS) & e.eq("actor.alternateId", "system@okta.com") & e.eq("transaction.id", "unknown") & ~e.has("client.userAgent.rawUserAgent") & ~e.has("client.geographicalContext.country"), "Okta Support Reset Password or MFA for user {$user}", "HIGH", by_uuid(e.fmt("{eventType|}-{published|}")), user=helped),
        e.rule("okta_suspicious_activity_reported", t("user.account.report_suspicious_activity_by_enduser"), "Okta: User [{$actor}] reported suspicious activity", "HIGH", **named),
        e.rule("okta_threatinsight_alert", t("security.threat.detected"), "Okta ThreatInsight detected threat for [{$actor}]", threat_level.otherwise("MEDIUM"), **named),
        e.rule("okta_user_mfa_reset", t("user.mfa.factor.deactivate"), "Okta: MFA factor [{$factor|<FACTOR_NOT_FOUND>}] reset for [{$id}] by [{actor.alternateId|<id-not-found>}]", "INFO", factor=F.nullif(factor, F.lit("")), id=id_of),
        e.rule("okta_user_mfa_reset_all", t("user.mfa.factor.reset_all"), "Okta: All MFA factors were reset for [{$id}] by [{actor.alternateId|<id-not-found>}]", "MEDIUM", by_uuid(F.coalesce(request, F.lit(""))), id=id_of),
    ]


# ---- 1Password ----

# Allowed countries and clients.
COUNTRIES = ("US", "CA", "GB", "DE", "FR")
CLIENTS = ("1Password CLI", "1Password for Web", "1Password for Mac", "1Password SCIM Bridge", "1Password for Windows", "1Password for iOS", "1Password Browser Extension", "1Password for Android", "1Password for Linux", "1Password SDK")


def onepassword(e: Event, countries=COUNTRIES, clients=CLIENTS) -> list[Rule]:
    return [
        e.rule("onepassword_brute_force", e.among("category", "credentials_failed", "mfa_failed", "firewall_failed"), "1Password: Failed login attempts from IP [{client.ip_address|<UNKNOWN_IP>}] exceeded threshold", "INFO", "{client.ip_address|<UNKNOWN_IP>}"),
        e.rule("onepassword_login_from_new_country", e.eq("category", "success") & e.truthy("country") & ~e.among("country", *countries), "1Password: Login from [{country|<UNKNOWN_COUNTRY>}] by [{target_user.email|<UNKNOWN_USER>}]", "MEDIUM"),
        e.rule("onepassword_unusual_client", e.truthy("client.app_name") & ~e.among("client.app_name", *clients), "1Password: Unusual client detected - {client.app_name|<UNKNOWN_CLIENT>}", "MEDIUM"),
    ]


# ---- Google Workspace ----


def gsuite_parameter(e: Event, name: str) -> Column:
    """A parameter of the first event, by the first of its value fields that is not empty."""
    found = Event(F.get(F.filter(e.items("events.0.parameters"), lambda p: Event(p).eq("name", name)), F.lit(0)))
    return found.first_true("value", "intValue", "boolValue", "multiValue")


def gsuite(e: Event) -> list[Rule]:
    named = lambda n: e.eq("events.0.name", n)
    login, admin = e.eq("id.applicationName", "login"), e.eq("id.applicationName", "admin")
    role = gsuite_parameter(e, "ROLE_NAME")
    low = F.lower(F.coalesce(role, F.lit("")))
    return [
        e.rule("gsuite_2sv_disabled", login & named("2sv_disable"), "GSuite: 2-Step Verification disabled for [{actor.email|<UNKNOWN_USER>}]", "MEDIUM"),
        e.rule("gsuite_admin_role_assigned", admin & named("ASSIGN_ROLE"), "GSuite: [{$role|<UNKNOWN_ROLE>}] role assigned to [{$user|<UNKNOWN_USER>}] by [{actor.email|<UNKNOWN_ACTOR>}]", F.when(low.contains("super") | low.contains("admin"), "HIGH").otherwise("INFO"), role=role, user=gsuite_parameter(e, "USER_EMAIL")),
        e.rule("gsuite_brute_force_by_ip", named("login_failure"), "GSuite: Failed login attempts from IP [{ipAddress|<UNKNOWN_IP>}] exceeded threshold", "INFO", "{ipAddress|<UNKNOWN_IP>}"),
        e.rule("gsuite_user_suspended", admin & named("SUSPEND_USER"), "GSuite: User suspended by [{actor.email|<UNKNOWN_ACTOR>}]", "INFO"),
    ]


# ---- Slack ----

# Actions and what their alerts are called.
IDP_ACTIONS = {"idp_configuration_added": "Slack IDP Configuration Added", "idp_configuration_deleted": "Slack IDP Configuration Deleted", "idp_prod_configuration_updated": "Slack IDP Configuration Updated"}
BARRIER_ACTIONS = {"barrier_deleted": "Slack Information Barrier Deleted", "barrier_updated": "Slack Information Barrier Updated"}
LEGAL_HOLD_ACTIONS = {"legal_hold_policy_entities_deleted": "Slack Legal Hold Policy Entities Deleted", "legal_hold_policy_exclusion_added": "Slack Exclusions Added to Legal Hold Policy", "legal_hold_policy_released": "Slack Legal Hold Released", "legal_hold_policy_updated": "Slack Legal Hold Updated"}
PRIVILEGE_ACTIONS = {"owner_transferred": "Slack Owner Transferred", "permissions_assigned": "Slack User Assigned Permissions", "role_change_to_admin": "Slack User Made Admin", "role_change_to_owner": "Slack User Made Owner"}
ANOMALIES = {
    "asn": "An ASN was on a list of suspicious ASNs", "excessive_downloads": "A user downloaded an excessive amount of files", "excessive_file_shares": "A user shared an excessive amount of files",
    "excessive_malware_uploads": "A user uploaded an excessive amount of malware files", "ip_address": "An anomaly was detected in the IP address used for the user token",
    "search_volume": "An unusual volume of search activity was detected", "session_fingerprint": "The session cookie has an unusual timestamp or client fingerprint",
    "spoofed_user_agent": "Characteristics of the client do not match the user agent", "tor": "A Tor exit node was used", "unexpected_admin_action": "An unexpected admin action was performed",
    "unexpected_api_call_volume": "An unexpected volume of API calls was detected", "unexpected_client": "An anomalous Slack client was detected",
    "unexpected_credential_testing": "Unexpected credential testing activity was detected", "unexpected_message_deletion": "Unexpected message deletion activity was detected",
    "unexpected_scraping": "Unexpected scraping activity was detected", "unexpected_user_agent": "An unexpected user agent was detected", "user_agent": "An anomaly was detected in the user agent used for the user token",
}
ELEVATED_ANOMALIES = ("excessive_malware_uploads", "session_fingerprint", "unexpected_admin_action")


def _names(e: Event, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for action, title in table.items():
        out = F.when(e.eq("action", action), title).otherwise(out)
    return out


def slack_audit(e: Event) -> list[Rule]:
    a = lambda *names: e.among("action", *names)
    admin = any_of(F.coalesce(F.array_contains(e.texts(p), "admin"), F.lit(False)) for p in ("entity.app.scopes", "details.new_scope", "details.bot_scopes"))
    level = F.when(admin, "High").otherwise("Medium")
    added = F.size(F.array_except(e.texts("details.new_scopes"), e.texts("details.previous_scopes"))) > 0
    workspace, email = "{context.location.domain|<UNKNOWN_WORKSPACE>}", "{actor.user.email|<UNKNOWN_ACTOR>}"
    reason = F.get(e.texts("details.reason"), F.lit(0))
    meaning = F.lit(None).cast("string")
    for key, text in ANOMALIES.items():
        meaning = F.when(reason == key, text).otherwise(meaning)
    anomaly = F.concat(F.lit("Slack Anomaly Detected"), F.coalesce(F.concat(F.lit(" for "), e.first_true("actor.user.email")), F.lit("")), F.coalesce(F.concat(F.lit(": "), meaning), F.lit("")))
    privileged = _names(e, PRIVILEGE_ACTIONS)
    by_actor, of_entity = " {actor.user.name|<unknown-actor>} ({actor.user.email|<unknown-email>})", " {entity.user.name|<unknown-actor>} ({entity.user.email|<unknown-email>})"
    escalation = F.when(a("owner_transferred"), F.concat(privileged, F.lit(" from"), e.fmt(by_actor))).when(a("permissions_assigned"), F.concat(privileged, e.fmt(by_actor))).otherwise(F.concat(privileged, e.fmt(of_entity)))
    dos_key = F.concat(F.lit("Slack.AuditLogs.ApplicationDoS"), e.s("entity.user.name", ""))
    hold = F.when(a("legal_hold_policy_updated"), e.fmt("Slack Legal Hold Updated [{details.old_legal_hold_policy.name}]")).otherwise(_names(e, LEGAL_HOLD_ACTIONS))
    return [
        e.rule("slack_app_access_expanded", a("app_resources_added", "app_resources_granted", "bot_token_upgraded") | (a("app_scopes_expanded") & added), "Slack App [{entity.app.name}] Access Expanded by [{actor.user.name}]", level),
        e.rule("slack_app_added", a("app_approved", "app_installed", "org_app_workspace_added"), "Slack App [{entity.app.name}] Added by [{actor.user.name}]", level),
        e.rule("slack_app_removed", a("app_restricted", "app_uninstalled", "org_app_workspace_removed"), "Slack App [{entity.app.name}] Removed by [{actor.user.name}]"),
        e.rule("slack_application_dos", a("bulk_session_reset_by_admin", "user_session_invalidated", "user_session_reset_by_admin"), "Slack: Potential DoS - Admin [{actor.user.email|<UNKNOWN_ADMIN>}] performed [{action|<UNKNOWN_ACTION>}] on user [{entity.user.name|<UNKNOWN_USER>}]", dedup=dos_key, state=Threshold(dos_key, 86400, 60)),
        e.rule("slack_dlp_modified", a("native_dlp_rule_deactivated", "native_dlp_violation_deleted"), F.when(a("native_dlp_rule_deactivated"), "Slack DLP Rule Deactivated").otherwise("Slack DLP Violation Deleted"), F.when(a("native_dlp_violation_deleted"), "Medium").otherwise("High")),
        e.rule("slack_ekm_config_changed", a("ekm_logging_config_set")),
        e.rule("slack_ekm_slackbot_unenrolled", a("ekm_slackbot_unenroll_notification_sent")),
        e.rule("slack_ekm_unenrolled", a("ekm_unenrolled"), f"Slack: Workspace [{workspace}] unenrolled from Enterprise Key Management by [{email}] - Customer-controlled encryption disabled"),
        e.rule("slack_idp_configuration_change", a(*IDP_ACTIONS), _names(e, IDP_ACTIONS)),
        e.rule("slack_information_barrier_modified", a(*BARRIER_ACTIONS), _names(e, BARRIER_ACTIONS)),
        e.rule("slack_intune_mdm_disabled", a("intune_disabled"), f"Microsoft Intune: MDM disabled for Slack workspace [{workspace}] by [{email}] - Mobile security controls removed"),
        e.rule("slack_legal_hold_policy_modified", a(*LEGAL_HOLD_ACTIONS), hold),
        e.rule("slack_mfa_settings_changed", a("pref.two_factor_auth_changed")),
        e.rule("slack_org_created", a("organization_created")),
        e.rule("slack_org_deleted", a("organization_deleted")),
        e.rule("slack_passthrough_anomaly", a("anomaly"), anomaly, F.when(F.arrays_overlap(e.texts("details.reason"), F.array(*map(F.lit, ELEVATED_ANOMALIES))), "MEDIUM").otherwise("INFO")),
        e.rule("slack_potentially_malicious_file_shared", a("file_malicious_content_detected"), f"Slack: Malicious file detected in Slack workspace [{workspace}] uploaded by [{{actor.user.email|<UNKNOWN_USER>}}] - Potential malware or phishing attack"),
        e.rule("slack_private_channel_made_public", a("private_channel_converted_to_public"), "Slack private channel {entity.channel.name|<unknown_channel>} made public by {actor.user.name|<unknown_user>} <{actor.user.email|<unknown_email>}>"),
        e.rule("slack_privilege_changed_to_user", a("role_change_to_user"), "Slack {entity.user.name|<unknown-entity>}'s ({entity.user.email|<unknown-email>}) role changed to User"),
        e.rule("slack_service_owner_transferred", a("service_owner_transferred"), f"Slack: Primary Owner transferred for workspace [{workspace}] from [{{actor.user.email|<UNKNOWN_PREVIOUS_OWNER>}}] to [{{entity.user.email|<UNKNOWN_NEW_OWNER>}}] - Highest privilege transfer"),
        e.rule("slack_sso_settings_changed", a("pref.sso_setting_changed")),
        e.rule("slack_user_privilege_escalation", a(*PRIVILEGE_ACTIONS), escalation, F.when(a("permissions_assigned"), "Medium").otherwise("Critical")),
    ]


# ---- Cloudflare ----

# What firewall sources are called, and rules that catch one exploit.
FIREWALL_SOURCES = {
    "unknown": "Unknown", "asn": "ASN", "country": "Country", "ip": "IP", "iprange": "IP Range", "securitylevel": "Security Level", "zonelockdown": "Zone Lockdown", "waf": "WAF",
    "firewallrules": "Firewall Rules", "uablock": "User Agent", "ratelimit": "Rate Limit", "bic": "Browser Integrity Check", "hot": "Hotlink Protection", "l7ddos": "L7 DDoS", "botfight": "Bot Fight (Classic)",
    "validation": "Invalid", "apishield": "API Shield", "botmanagement": "Bot Management", "dlp": "Data Loss Prevention", "firewallmanaged": "Firewall Managed Rules", "firewallcustom": "Firewall Custom Rulesets",
}
EXPLOIT_RULES = ("33aa8a8a948b48b28d40450c5fb92fba", "2b5d06e34a814a889bee9a0699702280")


def firewall_source(source: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in FIREWALL_SOURCES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(source)), source, F.lit("<NO_SOURCE>"))


def cloudflare(e: Event) -> list[Rule]:
    ddos = F.concat_ws(":", F.lit("cf_fw_l7ddos"), e.s("ZoneID", ""), F.coalesce(e.first_true("ClientRequestHost"), F.lit("")))
    bots = F.concat_ws(":", F.lit("cf_http_botvol"), e.s("ClientRequestHost", ""), e.s("ClientIP", ""))
    score = F.coalesce(e.n("BotScore"), F.lit(100.0))
    return [
        e.rule("cloudflare_firewall_ddos", e.eq("Source", "l7ddos"), "Cloudflare: Detected L7 DDoS", F.when(e.eq("Action", "block"), "Info").otherwise("Medium"), state=Threshold(ddos, 3600, 100)),
        e.rule("cloudflare_httpreq_bot_high_volume", (score >= 1) & (score <= 30), "Cloudflare: High Volume of Bot Requests to [{ClientRequestHost|<NO_REQ_HOST>}]", state=Threshold(bots, 3600, 7560)),
        e.rule("cloudflare_react2shell_rce_attempt", e.among("RuleID", *EXPLOIT_RULES), "Cloudflare React2Shell (CVE-2025-55182) Exploit Detected from [{ClientIP|<UNKNOWN_IP>}]"),
    ]
