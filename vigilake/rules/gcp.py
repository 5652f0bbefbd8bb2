"""Rules over Google Cloud logs."""

# The ids, severities and titles of the rules below, and the names and values that their predicates ask for.

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.functions.text import any_of, glob_regex, starts_with_any

from .aws import RANSOM_NOTES, looks_like_ransom_note
from .model import Event, Rule

PP = "protoPayload."
METHOD, SERVICE, RESOURCE = PP + "methodName", PP + "serviceName", PP + "resourceName"
EMAIL = PP + "authenticationInfo.principalEmail"
ACTOR = "{protoPayload.authenticationInfo.principalEmail|<ACTOR_NOT_FOUND>}"
PROJECT = "{resource.labels.project_id|<PROJECT_NOT_FOUND>}"
NAME = "{protoPayload.resourceName|<RESOURCE_NOT_FOUND>}"
PERFORMED = f"[GCP]: [{ACTOR}] performed [{{protoPayload.methodName|<OPERATION_NOT_FOUND>}}] on project [{PROJECT}]"
STORAGE = "storage.googleapis.com"

# Accounts and namespaces of the platform itself.
SYSTEM_ACCOUNT_PREFIXES = (
    "system:kube-controller-manager", "system:kube-scheduler", "system:addon-manager", "system:serviceaccount:kube-system:", "system:serviceaccount:kube-public:", "system:serviceaccount:kube-node-lease:",
    "system:serviceaccount:gke-system:", "system:serviceaccount:gke-managed-system:", "system:serviceaccount:gmp-system:", "system:serviceaccount:gmp-public:", "system:serviceaccount:config-management-system:",
    "system:serviceaccount:istio-system:", "system:serviceaccount:asm-system:",
)
SYSTEM_ACCOUNT_PATTERNS = (
    r"^[\d]+-compute@developer\.gserviceaccount\.com$",
    r"^container-engine-robot@.*\.iam\.gserviceaccount\.com$",
    r"^gke-[\d]+@.*\.iam\.gserviceaccount\.com$",
    r"^service-[\d]+@container-engine-robot\.iam\.gserviceaccount\.com$",
    r"^service-[\d]+@containerregistry\.iam\.gserviceaccount\.com$",
    r"^[\d]+@cloudservices\.gserviceaccount\.com$",
    r"^.*\.svc\.id\.goog\[kube-system/.*\]$",
    r"^.*\.svc\.id\.goog\[gke-system/.*\]$",
    r"^.*\.svc\.id\.goog\[gke-managed-system/.*\]$",
)
SYSTEM_NAMESPACES = ("kube-system", "kube-public", "kube-node-lease", "gke-system", "gke-managed-system", "gmp-system", "gmp-public", "config-management-system", "istio-system", "asm-system")
BUCKET_ACCOUNTS = "gs-project-accounts.iam.gserviceaccount.com"
SUSPICIOUS_HOST_PATHS = ("/var/run/docker.sock", "/var/run/crio/crio.sock", "/var/lib/kubelet", "/var/lib/kubelet/pki", "/var/lib/docker/overlay2", "/etc/kubernetes", "/etc/kubernetes/manifests", "/etc/kubernetes/pki", "/home/admin")


def is_system_principal(email: Column) -> Column:
    return starts_with_any(email, SYSTEM_ACCOUNT_PREFIXES) | F.coalesce(any_of(email.rlike(p) for p in SYSTEM_ACCOUNT_PATTERNS), F.lit(False))


def is_system_namespace(resource: Column) -> Column:
    parts = F.split(resource, "/")
    return F.coalesce((F.get(parts, F.lit(2)) == "namespaces") & F.get(parts, F.lit(3)).isin(*SYSTEM_NAMESPACES), F.lit(False))


def granted(e: Event, *permissions: str) -> Column:
    """The call was authorized with one of the permissions."""
    return e.any(PP + "authorizationInfo", lambda a: a.among("permission", *permissions) & a.is_true("granted"))


def domain(email: Column) -> Column:
    return F.element_at(F.split(email, "@"), -1)


def is_bucket_account(member: Column) -> Column:
    """An account of a project's storage service, with or without the serviceAccount: prefix."""
    low = F.lower(F.element_at(F.split(F.trim(member), "@"), -1))
    return F.coalesce(member.contains("@") & ((low == BUCKET_ACCOUNTS) | low.endswith("." + BUCKET_ACCOUNTS)), F.lit(False))


def _after(text: Column, mark: str, until: str) -> Column:
    return F.nullif(F.regexp_extract(text, f"{mark}(.*?)(?:{until}|$)", 1), F.lit(""))


def _following(path: Column, name: str) -> Column:
    """The part of a path that follows the part ``name``."""
    parts = F.split(path, "/")
    return F.get(parts, F.array_position(parts, name).cast("int"))


def gcp_audit(e: Event, privileged_groups: tuple[str, ...] = (), own_domain: str = "@your-domain.tld", active_regions: tuple[str, ...] = ("us",)) -> list[Rule]:
    not_error = ~e.eq("severity", "ERROR")
    no_response_error = ~e.truthy(PP + "response.error")
    method, service = e.s(METHOD, ""), e.s(SERVICE, "")
    job = PP + "metadata.jobChange.job."
    is_storage = e.eq(SERVICE, STORAGE)
    object_name = F.when(e.contains(RESOURCE, "/objects/"), F.element_at(F.split(e.s(RESOURCE), "/objects/"), -1))
    actor = e.s(EMAIL, "<ACTOR_NOT_FOUND>")

    # metadata keys that give shell access
    changed = F.flatten(F.array(*(e.texts(PP + f"metadata.{a}.{b}") for a in ("projectMetadataDelta", "instanceMetadataDelta") for b in ("addedMetadataKeys", "modifiedMetadataKeys"))))
    metadata = (service == "compute.googleapis.com") & e.ends(METHOD, ".setCommonInstanceMetadata", ".setMetadata") & F.arrays_overlap(changed, F.array(F.lit("ssh-keys"), F.lit("sshKeys")))
    serial = service.rlike(r"^(ssh-)?serialport\.googleapis\.com$|^[^.]+-ssh-serialport\.googleapis\.com$") & (method == "google.ssh-serialport.v1.connect") & F.lower(e.s(PP + "status.message", "")).contains("succeeded")
    ssh = ((service == "iap.googleapis.com") & (method == "AuthorizeUser")) | ((service == "oslogin.googleapis.com") & e.ends(METHOD, ".CheckPolicy", ".ContinueSession")) | metadata | serial

    needed = ("compute.disks.create", "compute.instances.create", "compute.instances.setMetadata", "compute.instances.setServiceAccount", "compute.subnetworks.use", "compute.subnetworks.useExternalIp")
    all_granted = F.lit(True)
    for p in needed:
        all_granted = all_granted & e.any(PP + "authorizationInfo", lambda a, p=p: a.eq("permission", p) & a.truthy("granted"))

    destination = e.s(PP + "metadata.destination", "")
    to_bucket = F.when(destination.contains("buckets/") & destination.contains("objects/"), _after(destination, "buckets/", "/objects/"))
    to_project = F.when(destination.contains("projects/") & destination.contains("buckets/"), F.nullif(_after(destination, "projects/", "/buckets/"), F.lit("_")))
    from_bucket, from_project = e.s("resource.labels.bucket_name"), e.s("resource.labels.project_id")
    crosses = F.coalesce((to_project != "") & (to_project != from_project), F.lit(False))
    exfiltration = e.eq(METHOD, "storage.objects.get") & is_storage & not_error & e.truthy(PP + "metadata.destination") & F.coalesce((from_bucket != "") & (to_bucket != "") & (from_project != "") & (from_bucket != to_bucket), F.lit(False)) & crosses

    first_create = Event(F.get(F.filter(e.items(PP + "authorizationInfo"), lambda a: Event(a).eq("permission", "storage.objects.create")), F.lit(0))).s("resource")
    rewrite = is_storage & e.eq(METHOD, "storage.objects.create") & F.coalesce((first_create != "") & (first_create == e.s(RESOURCE)), F.lit(False)) & e.search(PP + "requestMetadata.callerSuppliedUserAgent", "(?i)command/rewrite-k", "(?i)gsutil.*rewrite")

    deltas = PP + "serviceData.policyDelta.bindingDeltas"
    accepted = ("serviceAccount:*@*.gserviceaccount.com", "serviceAccount:*.svc.id.goog[*", "principalSet://iam.googleapis.com/projects/*/workloadIdentityPools/*")
    expected = domain(e.s(EMAIL, ""))
    stranger = e.any(deltas, lambda d: d.eq("action", "ADD") & ~F.coalesce(any_of(d.s("member", "").rlike(glob_regex(p)) for p in accepted), F.lit(False)) & ~F.endswith(d.s("member", ""), F.concat(F.lit("@"), expected)))
    public = e.any(deltas, lambda d: d.eq("action", "ADD") & d.among("member", "allUsers", "allAuthenticatedUsers") & d.among("role", "roles/storage.objectAdmin", "roles/storage.objectViewer", "roles/storage.admin"))

    log_parts, res_parts = F.split(e.s("logName"), "/"), F.split(e.s(RESOURCE), "/")
    other_key = e.starts("logName", "projects/") & e.starts(RESOURCE, "projects/") & F.coalesce((F.get(log_parts, F.lit(1)) != "") & (F.get(log_parts, F.lit(1)) != F.get(res_parts, F.lit(1))), F.lit(False))
    encrypting = e.any(PP + "request.policy.bindings", lambda b: b.contains_ci("role", ["cryptokey"]) & b.contains_ci("role", ["encrypt", "decrypt"]) & F.exists(b.texts("members"), is_bucket_account))
    last_delta = lambda name: F.try_element_at(F.array_distinct(F.transform(e.items(deltas), lambda d: Event(d).s(name))), F.lit(-1))
    key_roles = e.contains(METHOD, "SetIAMPolicy") & F.coalesce(last_delta("role").isin("roles/iam.serviceAccountTokenCreator", "roles/iam.serviceAccountUser") & (last_delta("action") == "ADD"), F.lit(False))
    place = F.coalesce(e.first_true("resource.labels.location"), e.first_true("resource.labels.zone"))
    unused = e.ends(METHOD, "insert", "create") & F.coalesce(~any_of(place.startswith(r) for r in active_regions), F.lit(False))

    added = F.filter(e.items(PP + "metadata.event"), lambda x: Event(x).eq("eventname", "ADD_GROUP_MEMBER"))
    parameter = lambda x, name: Event(F.try_element_at(F.filter(Event(x).items("parameter"), lambda p: Event(p).eq("name", name)), F.lit(-1))).s("value")
    privileged = F.filter(added, lambda x: F.coalesce(parameter(x, "GROUP_EMAIL").isin(*privileged_groups), F.lit(False)) if privileged_groups else F.lit(False))
    member = F.get(privileged, F.lit(0))

    resource_id = "resource.labels.firewall_rule_id"
    firewall = lambda verb: F.when(e.has(resource_id), e.fmt(f"[GCP]: [{ACTOR}] {verb} firewall rule with resource ID [{{{resource_id}}}]")).otherwise(e.fmt(f"[GCP]: [{ACTOR}] {verb} firewall rule for resource [{NAME}]"))
    roles = F.filter(F.transform(e.items(PP + "response.bindings"), lambda b: Event(b).s("role")), lambda r: F.coalesce(r != "", F.lit(False)))
    roles_text = F.when(F.size(roles) == 0, "<NO_ROLES_FOUND>").when(F.size(roles) == 1, F.get(roles, F.lit(0))).otherwise(F.concat(F.size(roles).cast("string"), F.lit(" roles including "), F.get(roles, F.lit(0))))
    statement = job + "jobConfig.queryConfig.statementType"
    destroyed = F.when(e.eq(job + "jobConfig.type", "QUERY"), e.fmt(f"GCP: [{ACTOR}] performed a destructive BigQuery [{{{statement}|<STATEMENT_NOT_FOUND>}}] query")).when(e.truthy(PP + "metadata.tableDeletion"), e.fmt(f"GCP: [{ACTOR}] deleted a table in BigQuery")).when(e.truthy(PP + "metadata.datasetDeletion"), e.fmt(f"GCP: [{ACTOR}] deleted a dataset in BigQuery")).otherwise(e.fmt(f"GCP: [{ACTOR}] performed a destructive BigQuery query"))
    emails = F.transform(e.items(PP + "request.serviceAccounts"), lambda a: Event(a).s("email"))
    accounts = F.when(F.size(emails) > 0, F.concat(F.lit("['"), F.array_join(emails, "', '"), F.lit("']"))).otherwise("<SERVICE_ACCOUNT_EMAILS_NOT_FOUND>")
    method_parts = F.split(method, r"\.")
    storage_copy = F.when(crosses & from_project.isNotNull(), e.fmt("CROSS-PROJECT: GCS object copied from [{resource.labels.project_id}/{resource.labels.bucket_name|Unknown}] to [{$project}/{$bucket|Unknown}] by [{protoPayload.authenticationInfo.principalEmail|Unknown}]", project=to_project, bucket=to_bucket)).otherwise(e.fmt("GCS object copied from bucket [{resource.labels.bucket_name|Unknown}] to [{$bucket|Unknown}] by [{protoPayload.authenticationInfo.principalEmail|Unknown}]", bucket=to_bucket))
    created_kind = F.when(method == "google.iam.admin.v1.CreateServiceAccountKey", "Service Account Key for").otherwise("Service Account")
    any_granted = e.any(PP + "authorizationInfo", lambda a: a.truthy("granted"))

    return [
        e.rule("gcp_access_attempts_violating_vpc_service_controls", e.eq("severity", "ERROR") & F.coalesce(e.n(PP + "status.code") == 7, F.lit(False)) & F.array_contains(F.flatten(F.transform(e.items(PP + "status.details"), lambda d: F.transform(Event(d).items("violations"), lambda x: Event(x).s("type", "")))), "VPC_SERVICE_CONTROLS"), f"GCP: [{ACTOR}] performed a [{{protoPayload.methodName|<METHOD_NOT_FOUND>}}] request that violates VPC Service Controls"),
        e.rule("gcp_bigquery_large_scan", e.starts("resource.type", "bigquery") & e.is_true("operation.last") & e.eq(job + "jobConfig.type", "QUERY") & e.eq(statement, "SELECT") & F.coalesce(e.n(job + "jobStats.queryStats.totalBilledBytes") > 1073741824, F.lit(False)), f"GCP: [{ACTOR}] ran a large BigQuery query exceeding 1.07 GB threshold."),
        e.rule("gcp_cloud_run_service_created", not_error & e.ends(METHOD, "Services.CreateService") & granted(e, "run.services.create"), f"[GCP]: [{ACTOR}] created new Run Service in project [{PROJECT}]"),
        e.rule("gcp_cloud_run_set_iam_policy", not_error & e.ends(METHOD, "Services.SetIamPolicy") & granted(e, "run.services.setIamPolicy"), f"[GCP]: [{ACTOR}] modified IAM policy for Cloud Run service [{{$service}}] with [{{$roles}}] in project [{PROJECT}]", service=F.element_at(F.split(e.s(RESOURCE, "<RESOURCE_NOT_FOUND>"), "/"), -1), roles=roles_text),
        e.rule("gcp_cloud_storage_buckets_modified_or_deleted", is_storage & e.among(METHOD, "storage.buckets.delete", "storage.buckets.update") & not_error, f"GCP: [{ACTOR}] performed a [{{protoPayload.methodName|<OPERATION_NOT_FOUND>}}] on bucket [{{resource.labels.bucket_name|<BUCKET_NOT_FOUND>}}] in project [{PROJECT}]."),
        e.rule("gcp_cloudbuild_potential_privilege_escalation", e.ends(METHOD, "CloudBuild.CreateBuild") & ~e.ends(EMAIL, "@gcf-admin-robot.iam.gserviceaccount.com") & granted(e, "cloudbuild.builds.create"), PERFORMED),
        e.rule("gcp_cloudfunctions_functions_create", granted(e, "cloudfunctions.functions.create"), PERFORMED),
        e.rule("gcp_cloudfunctions_functions_update", granted(e, "cloudfunctions.functions.update"), PERFORMED),
        e.rule("gcp_compute_set_iam_policy", no_response_error & e.among(METHOD, "v1.compute.disks.setIamPolicy", "v1.compute.images.setIamPolicy", "v1.compute.snapshots.setIamPolicy"), f"[GCP]: [{ACTOR}] updated IAM policy for [{{$items}}] on project [{PROJECT}]", items=F.try_element_at(method_parts, F.lit(-2))),
        e.rule("gcp_compute_ssh_connection", ssh),
        e.rule("gcp_computeinstances_create_privilege_escalation", no_response_error & e.ends(METHOD, "compute.instances.insert") & ~e.ends(EMAIL, "@cloudservices.gserviceaccount.com") & all_granted, f"[GCP]: [{ACTOR}] created a new Compute Engine instance with [{{$accounts}}] Service Account on project [{PROJECT}]", accounts=accounts),
        e.rule("gcp_destructive_queries", (e.starts("resource.type", "bigquery") & e.eq(job + "jobConfig.type", "QUERY") & e.among(statement, "UPDATE", "DELETE", "DROP_TABLE", "ALTER_TABLE", "TRUNCATE_TABLE")) | e.truthy(PP + "metadata.tableDeletion") | e.truthy(PP + "metadata.datasetDeletion"), destroyed, F.when(e.among(statement, "UPDATE", "DELETE"), "INFO").otherwise("DEFAULT")),
        e.rule("gcp_dns_zone_modified_or_deleted", e.among(METHOD, "dns.changes.create", "dns.managedZones.delete", "dns.managedZones.patch", "dns.managedZones.update"), f"[GCP]: [{ACTOR}] modified managed DNS zone [{NAME}]", dedup=actor),
        e.rule("gcp_firewall_rule_created", e.contains(METHOD, ".Firewall.Create", ".compute.firewalls.insert"), firewall("created"), dedup=actor),
        e.rule("gcp_firewall_rule_deleted", e.contains(METHOD, ".Firewall.Delete", ".compute.firewalls.delete"), firewall("deleted"), dedup=actor),
        e.rule("gcp_firewall_rule_modified", e.contains(METHOD, ".Firewall.Update", ".compute.firewalls.patch", ".compute.firewalls.update"), f"[GCP]: [{ACTOR}] modified firewall rule on [{NAME}]", dedup=actor),
        e.rule("gcp_gcs_bulk_deletion", e.eq(METHOD, "storage.objects.delete") & is_storage & not_error, "GCP: Bulk object deletion in resource [{protoPayload.resourceName}] by principal [{protoPayload.authenticationInfo.principalEmail}]"),
        e.rule("gcp_gcs_iam_changes", e.eq("resource.type", "gcs_bucket") & e.eq(METHOD, "storage.setIamPermissions"), dedup="{resource.labels.project_id|<UNKNOWN_PROJECT>}"),
        e.rule("gcp_gcs_object_exfiltration", exfiltration, storage_copy, F.when(crosses, "DEFAULT").otherwise("LOW")),
        e.rule("gcp_gcs_object_rewrite", rewrite, "GCS object [{$object|Unknown}] rewritten in [{resource.labels.bucket_name|Unknown}] by [{protoPayload.authenticationInfo.principalEmail|Unknown}]", dedup="{resource.labels.bucket_name|unknown}-{protoPayload.authenticationInfo.principalEmail|unknown}", object=object_name),
        e.rule("gcp_gcs_public", e.eq(METHOD, "storage.setIamPermissions") & public, "GCS bucket [{resource.labels.bucket_name|<UNKNOWN_BUCKET>}] made public"),
        e.rule("gcp_gcs_ransom_note_upload", is_storage & e.eq(METHOD, "storage.objects.create") & looks_like_ransom_note(object_name, RANSOM_NOTES), "[GCP] Potential ransomware note uploaded to GCS bucket: [{$object|<UNKNOWN_FILE>}] in bucket [{resource.labels.bucket_name|<UNKNOWN_BUCKET>}] by user [{protoPayload.authenticationInfo.principalEmail|<UNKNOWN_USER>}]", object=object_name),
        e.rule("gcp_iam_corp_email", e.eq(METHOD, "SetIamPolicy") & stranger, "A GCP IAM account has been created with an unexpected email domain in {resource.labels.project_id|<UNKNOWN_PROJECT>}"),
        e.rule("gcp_iam_custom_role_changes", e.eq("resource.type", "iam_role") & e.among(METHOD, "google.iam.admin.v1.CreateRole", "google.iam.admin.v1.DeleteRole", "google.iam.admin.v1.UpdateRole"), dedup="{resource.labels.project_id|<UNKNOWN_PROJECT>}"),
        e.rule("gcp_iam_org_folder_changes", e.eq(METHOD, "SetIamPolicy") & e.starts("logName", "organizations", "folder") & e.ends("logName", "/logs/cloudaudit.googleapis.com%2Factivity"), f"{{p_log_type}}: [{ACTOR}] made manual changes to Org policy", F.when(e.contains_ci(PP + "requestMetadata.callerSuppliedUserAgent", ["terraform"]), "INFO").otherwise("HIGH")),
        e.rule("gcp_iam_roles_update_privilege_escalation", granted(e, "iam.roles.update"), PERFORMED),
        e.rule("gcp_iam_service_account_key_create", granted(e, "iam.serviceAccountKeys.create"), PERFORMED),
        e.rule("gcp_iam_service_accounts_sign_blob", granted(e, "iam.serviceAccounts.signBlob"), PERFORMED),
        e.rule("gcp_iam_serviceaccounts_signjwt", e.eq(METHOD, "SignJwt") & granted(e, "iam.serviceAccounts.signJwt"), PERFORMED),
        e.rule("gcp_iam_tag_enumeration", e.contains(METHOD, "GetIamPolicy", "TagKeys.ListTagKeys", "TagKeys.ListTagValues", "TagBindings.ListEffectiveTags"), "GCP IAM and Tag Enumeration by {protoPayload.authenticationInfo.principalEmail|<UNKNOWN>} - {protoPayload.methodName|<UNKNOWN>}"),
        e.rule("gcp_inbound_sso_profile_created_or_updated", e.among(METHOD, "google.admin.AdminService.inboundSsoProfileCreated", "google.admin.AdminService.inboundSsoProfileUpdated"), f"GCP: [{ACTOR}] performed {{$event|<EVENT_NAME_NOT_FOUND>}} in organization {{$org}}", event=F.coalesce(Event(F.get(e.items(PP + "metadata.event"), F.lit(0))).s("eventName"), e.s(PP + "metadata.event.eventName")), org=_following(e.s(RESOURCE), "organizations")),
        e.rule("gcp_invite_external_user_as_owner", no_response_error & e.eq(METHOD, "InsertProjectOwnershipInvite") & ~F.endswith(e.s(PP + "request.member", ""), F.concat(F.lit("@"), expected)), "[GCP]: External user [{protoPayload.request.member|<MEMBER_NOT_FOUND>}] was invited as owner to project [{protoPayload.resourceName|<PROJECT_NOT_FOUND>}]"),
        e.rule("gcp_kms_bulk_encryption", e.eq(METHOD, "Encrypt") & e.eq(SERVICE, "cloudkms.googleapis.com") & is_bucket_account(e.s(EMAIL, "")) & not_error, "GCS service account performing bulk KMS encryption with key [{resource.labels.crypto_key_id|Unknown}]"),
        e.rule("gcp_kms_cross_project_encryption", e.eq(SERVICE, "cloudkms.googleapis.com") & e.eq(METHOD, "Encrypt") & e.contains(EMAIL, BUCKET_ACCOUNTS) & other_key, "Cross-project KMS encryption by [{protoPayload.authenticationInfo.principalEmail|<UNKNOWN_PRINCIPAL>}] using key [{protoPayload.resourceName|<UNKNOWN_KMS_KEY>}] detected"),
        e.rule("gcp_kms_enable_key", e.eq(METHOD, "SetIamPolicy") & e.eq(SERVICE, "cloudkms.googleapis.com") & ~e.truthy(PP + "status.code") & encrypting, "GCP KMS key [{protoPayload.resourceName|Unknown}] granted encryption permissions by [{protoPayload.authenticationInfo.principalEmail|Unknown}]"),
        e.rule("gcp_kms_erase_key", e.eq(SERVICE, "cloudkms.googleapis.com") & (e.eq(METHOD, "DestroyCryptoKeyVersion") | (e.eq(METHOD, "UpdateCryptoKeyVersion") & e.eq(PP + "request.updateMask", "state") & e.among(PP + "request.cryptoKeyVersion.state", "DISABLED", "DESTROY_SCHEDULED", "DESTROYED"))), "GCP KMS key [{protoPayload.request.cryptoKeyVersion.name|Unknown}] version disabled or destroyed by {protoPayload.authenticationInfo.principalEmail|Unknown}"),
        e.rule("gcp_log_bucket_or_sink_deleted", any_granted & e.search(METHOD, r"(?:\w+\.)*v\d\.(?:ConfigServiceV\d\.(?:Delete(Bucket|Sink)))"), f"[GCP]: [{ACTOR}] deleted logging bucket or sink [{NAME}]"),
        e.rule("gcp_logging_settings_modified", e.eq(SERVICE, "logging.googleapis.com") & e.contains(METHOD, "Update"), f"GCP [{NAME}] logging settings modified by [{ACTOR}].", dedup=actor),
        e.rule("gcp_logging_sink_modified", e.search(METHOD, r"(?:\w+\.)*v\d\.(?:ConfigServiceV\d\.(?:UpdateSink))"), f"[GCP]: [{ACTOR}] updated logging sink [{NAME}]"),
        e.rule("gcp_permissions_granted_to_create_or_manage_service_account_key", key_roles, f"GCP: [{ACTOR}] granted permissions to create or manage service account keys to [{{$target|<TARGET_NOT_FOUND>}}]", target=F.coalesce(e.first_true("resource.labels.email_id"), e.s("resource.labels.project_id"))),
        e.rule("gcp_privilege_escalation_by_deployments_create", granted(e, "deploymentmanager.deployments.create"), PERFORMED),
        e.rule("gcp_privileged_operation", e.ends(METHOD, "setIamPolicy", "setIamPermissions") | e.among(METHOD, "iam.serviceAccounts.getAccessToken", "orgpolicy.policy.set", "storage.hmacKeys.create", "serviceusage.apiKeys.create", "serviceusage.apiKeys.list"), "GCP Privileged Operation by {protoPayload.authenticationInfo.principalEmail|<UNKNOWN>} - {protoPayload.methodName|<UNKNOWN>}"),
        e.rule("gcp_service_account_access_denied", e.walk("protoPayload", "status", "details", "reason") == F.array(F.lit("IAM_PERMISSION_DENIED")), f"[GCP]: [{ACTOR}] performed multiple requests resulting in [IAM_PERMISSION_DENIED]"),
        e.rule("gcp_service_account_or_keys_created", e.eq("resource.type", "service_account") & e.contains(METHOD, "CreateServiceAccount") & ~e.ends(EMAIL, ".gserviceaccount.com"), f"GCP: [{ACTOR}] created {{$kind}} [{{resource.labels.email_id}}] in project [{{resource.labels.project_id}}]", kind=created_kind),
        e.rule("gcp_serviceusage_apikeys_create_privilege_escalation", e.ends(METHOD, "ApiKeys.CreateKey") & granted(e, "serviceusage.apiKeys.create"), f"[GCP]: [{ACTOR}] created new API Key in project [{PROJECT}]"),
        e.rule("gcp_snapshot_insert", no_response_error & e.eq(METHOD, "v1.compute.snapshots.insert") & ~e.ends(EMAIL, own_domain), f"[GCP]: Unexpected domain [{ACTOR}] created a snapshot on project [{PROJECT}]"),
        e.rule("gcp_sql_config_changes", e.eq(METHOD, "cloudsql.instances.update"), dedup="{resource.labels.project_id|<UNKNOWN_PROJECT>}"),
        e.rule("gcp_storage_hmac_keys_create", e.any(PP + "authorizationInfo", lambda a: a.truthy("granted") & a.eq("permission", "storage.hmacKeys.create"))),
        e.rule("gcp_tag_binding_creation", e.ends(METHOD, "TagBindings.CreateTagBinding"), "GCP Tag Binding Creation by {protoPayload.authenticationInfo.principalEmail|<UNKNOWN>} - {protoPayload.resourceName|<UNKNOWN>}"),
        e.rule("gcp_unused_regions", unused, "GCP resource(s) created in unused region/zone in project {resource.labels.project_id|<UNKNOWN_PROJECT>}"),
        e.rule("gcp_user_added_to_iap_protected_service", e.eq(METHOD, "google.cloud.iap.v1.IdentityAwareProxyAdminService.SetIamPolicy"), f"GCP: [{ACTOR}] modified user access to IAP Protected Service [{{protoPayload.request.resource|<RESOURCE_NOT_FOUND>}}]"),
        e.rule("gcp_user_added_to_privileged_group", F.size(privileged) > 0, "{actor.email|} has added {$user} to the privileged group {$group}", user=parameter(member, "USER_EMAIL"), group=parameter(member, "GROUP_EMAIL")),
        e.rule("gcp_vpc_flow_logs_disabled", e.eq(METHOD, "v1.compute.subnetworks.patch") & e.is_false(PP + "request.enableFlowLogs"), f"GCP: [{ACTOR}] disabled VPC Flow Logs for [{NAME}]"),
        e.rule("gcp_workforce_pool_created_or_updated", e.among(METHOD, "google.iam.admin.v1.WorkforcePools.CreateWorkforcePool", "google.iam.admin.v1.WorkforcePools.UpdateWorkforcePool"), f"GCP: [{ACTOR}] created or updated workforce pool [{{$pool|}}] in organization [{{$org}}]", pool=F.element_at(F.split(e.s(PP + "request.workforcePool.name"), "/"), -1), org=_following(e.s("logName"), "organizations")),
        e.rule("gcp_workload_identity_pool_created_or_updated", e.among(METHOD, "google.iam.v1.WorkloadIdentityPools.CreateWorkloadIdentityPoolProvider", "google.iam.v1.WorkloadIdentityPools.UpdateWorkloadIdentityPoolProvider"), f"GCP: [{ACTOR}] created or updated workload identity pool [{{$pool}}] in project [{PROJECT}]", pool=_following(e.s(RESOURCE), "workloadIdentityPools")),
    ]


def gcp_http_lb(e: Event) -> list[Rule]:
    balancer = e.eq("resource.type", "http_load_balancer")
    status = F.coalesce(e.s("httprequest.status"), e.s("httpRequest.status"), F.lit(""))
    signatures = F.array(F.lit("google-mrs-v202512-id000001-rce"), F.lit("google-mrs-v202512-id000002-rce"))
    policies = [F.arrays_overlap(e.texts(f"jsonPayload.{p}.preconfiguredExprIds"), signatures) for p in ("enforcedSecurityPolicy", "previewSecurityPolicy")]
    return [
        e.rule("gcp_access_attempts_violating_iap_access_controls", balancer & e.eq("jsonPayload.statusDetails", "handled_by_identity_aware_proxy") & ~(status.startswith("2") | status.startswith("3")), "GCP: Request Violating IAP controls from [{jsonPayload.remoteIp|<SRC_IP_NOT_FOUND>}] to [{$url|<REQUEST_URL_NOT_FOUND>}]", url=F.coalesce(e.s("httprequest.requestUrl"), e.s("httpRequest.requestUrl"))),
        e.rule("gcp_cloud_armor_r2s_rce_attempt", balancer & (F.coalesce(policies[0], F.lit(False)) | F.coalesce(policies[1], F.lit(False))), "Cloud Armor React2Shell (CVE-2025-55182) Exploit Detected from {httpRequest.remoteIp|<UNKNOWN_IP>}"),
    ]


def gcp_k8s(e: Event) -> list[Rule]:
    pods = tuple(f"io.k8s.core.v1.pods.{v}" for v in ("create", "update", "patch"))
    system = is_system_principal(e.s(EMAIL, "")) | is_system_namespace(e.s(RESOURCE, ""))
    failed = e.eq(PP + "response.status", "Failure")
    actor = e.s(EMAIL, "<ACTOR_NOT_FOUND>")
    parts = F.split(e.s(RESOURCE, ""), "/")
    in_pod = F.coalesce((F.get(parts, F.lit(2)) == "namespaces") & (F.get(parts, F.lit(4)) == "pods") & (F.size(parts) >= 6), F.lit(False))
    mounts = e.any(PP + "request.spec.volumes", lambda v: v.among("hostPath.path", *SUSPICIOUS_HOST_PATHS))
    loose = e.any(PP + "response.spec.containers", lambda c: c.is_true("securityContext.privileged") | c.is_false("securityContext.runAsNonRoot"))
    return [
        e.rule("gcp_k8s_cron_job_created_or_modified", granted(e, "io.k8s.batch.v1.cronjobs.create", "io.k8s.batch.v1.cronjobs.update"), PERFORMED),
        e.rule("gcp_k8s_exec_into_pod", e.eq(METHOD, "io.k8s.core.v1.pods.exec.create") & e.eq("resource.type", "k8s_cluster"), "Exec into pod namespace/{$namespace|}/pod/{$pod|} by {protoPayload.authenticationInfo.principalEmail|<NO PRINCIPAL>} in {resource.labels.project_id|}", namespace=F.when(in_pod, F.get(parts, F.lit(3))), pod=F.when(in_pod, F.get(parts, F.lit(5)))),
        e.rule("gcp_k8s_ioc_activity", e.eq("operation.producer", "k8s.io") & e.truthy("p_enrichment.tor_exit_nodes"), PERFORMED),
        e.rule("gcp_k8s_new_daemonset_deployed", granted(e, "io.k8s.apps.v1.daemonsets.create"), PERFORMED),
        e.rule("gcp_k8s_pod_attached_to_node_host_network", e.among(METHOD, *pods) & e.is_true(PP + "request.spec.hostNetwork") & ~system, f"[GCP]: [{ACTOR}] created or modified pod which is attached to the host's network in project [{PROJECT}]", dedup=actor),
        e.rule("gcp_k8s_pod_create_or_modify_host_path_vol_mount", ~failed & e.among(METHOD, *pods) & mounts & ~system & granted(e, *pods), f"[GCP]: [{ACTOR}] created k8s pod [{NAME}] with a hostPath volume mount in project [{PROJECT}]", dedup=actor),
        e.rule("gcp_k8s_pod_using_host_pid_namespace", e.among(METHOD, *pods) & (e.is_true(PP + "request.spec.hostPID") | e.is_true(PP + "response.spec.hostPID")) & ~system, f"[GCP]: [{ACTOR}] created or modified pod using the host PID namespace in project [{PROJECT}]"),
        e.rule("gcp_k8s_privileged_pod_created", ~failed & e.eq(METHOD, pods[0]) & ~system & granted(e, pods[0]) & loose, f"[GCP]: [{ACTOR}] created a privileged pod [{NAME}] in project [{PROJECT}]", dedup=actor),
        e.rule("gcp_k8s_service_type_node_port_deployed", ~failed & e.eq(METHOD, "io.k8s.core.v1.services.create") & e.eq(PP + "request.spec.type", "NodePort") & granted(e, "io.k8s.core.v1.services.create"), f"[GCP]: [{ACTOR}] created NodePort service in project [{PROJECT}]"),
    ]
